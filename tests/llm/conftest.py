import random

import pytest

# Names that the operators use inside stand as columns of the input here.
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, doc string, tag string, row string, "
           "node string, host string, h string, kind string, score string")


def rows_of(texts):
    """Rows from (doc_id, text, source)."""
    return [(i, t, None if k % 3 else "en", s, None if t is None else len(t), "x", None, "y", "z", None, "h", "k", "s")
            for k, (i, t, s) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_texts():
    random.seed(11)
    words = ["Alpha", "beta", "gamma,", "délta", "epsilon", "zeta.", "eta", "theta", "<|endoftext|>", "it's", "42", "\U0001F600"]
    long = " ".join(random.choice(words) + str(random.randrange(50)) for _ in range(9000))
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [(0, "", "a"), (1, None, "a"), (2, "  \n\t ", None), (3, "one", "a"), (4, "one two", "a"), (None, "null id text here", "b"),
             (5, long, "b"), (6, f"start of six {passage} end of six", "a"), (7, f"seven begins {passage} seven ends", "a"),
             (8, "same text for several rows of the table", "a"), (9, "same text for several rows of the table", "b"),
             (10, "twice", "a"), (10, "twice", "a"), (10, "twice with another text", "a"), (11, "word " * 60, "c")]
    for i in range(12, 40):
        texts.append((i, "\n".join(" ".join(random.choice(words) for _ in range(12)) for _ in range(random.randrange(1, 6))), "d"))
    return texts


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    return spark.createDataFrame(rows_of(edge_texts), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
