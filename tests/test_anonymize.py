import json
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bucketwise.operators import anonymize as an
from suite import anonymizing, registry  # noqa: F401
from tests.conftest import SMALL, plan_of


def derived_scramble(text):
    """The generator, restated one character at a time."""
    state, out = zlib.crc32(text.encode()), []
    for i, ch in enumerate(text):
        state = (state * 1103515245 + 12345 + i) % 2 ** 31
        base = "A" if ch.isupper() else "a" if ch.islower() else "0" if ch.isdigit() else None
        out.append(ch if base is None else chr(ord(base) + state % (10 if base == "0" else 26)))
    return "".join(out)


def derived_entropy(text):
    data = text.encode()
    return -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()) if data else 0.0


TEXTS = ["Jane.Doe@example.com", "", "a", "Äöü Straße 12", "x" * 128, "Ab1" * 43, "p" * 257, "Hello World 2024 " * 60, "\n\t x"]


def test_scramble_and_entropy(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", an.scramble(F.col("t")).alias("s"), an.shannon_entropy(F.col("t")).alias("e")).collect():
        assert r.s == derived_scramble(r.t)
        assert abs(r.e - derived_entropy(r.t)) < 1e-9


def test_scramble_keeps_the_shape(spark):
    df = spark.createDataFrame([("Jane Doe, 42!",)], "t string")
    got = df.select(an.scramble(F.col("t")).alias("s")).first().s
    assert re.fullmatch(r"[A-Z][a-z]{3} [A-Z][a-z]{2}, \d\d!", got)


@pytest.mark.parametrize("text", ["", "0.0.0.0", "::", "localhost"])
def test_addresses_that_stay(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(an.scramble_ip(F.col("t"))).first()[0] == text


def test_scrambled_addresses(spark):
    row = spark.createDataFrame([("203.0.113.7", "fe80::1:2")], "a string, b string").select(
        an.scramble_ip(F.col("a")).alias("a"), an.scramble_ip(F.col("b")).alias("b")).first()
    crc = zlib.crc32(b"203.0.113.7")
    assert row.a == ".".join(str(crc >> s & 255) for s in (24, 16, 8, 0))
    segment = lambda i: f"{zlib.crc32(f'fe80::1:2:{i}'.encode()) & 0xffff:04x}"
    assert row.b == ":".join([segment(0), "", segment(2), segment(3)])


def masked(spark, text, chain=None):
    df = spark.createDataFrame([(text,)], "message string")
    return an.anonymize(df, chain or an.default_rules()).first().message


@pytest.mark.parametrize("text, wanted", [
    ("mail a@b.com_c@d.org now", "mail <EMAIL><EMAIL> now"), ("x%40example.com", "<EMAIL>"),
    ("from 10.0.0.5:80", "from <IP>:80"), ("ä10.0.0.5", "ä<IP>"), ("v1234.1.1.1.1", "v1234.<IP>"),
    ("2001:db8:0:0:0:0:0:1", "<IP6>"), ("DE89370400440532013000", "<IBAN>"), ("nothing here", "nothing here"),
    ("key aB3dE6gH9jK2mN5pQ8sT1vW4yZ7cF0hL  end", "key <SECRET>  end"), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a" * 38)])
def test_default_rules(spark, text, wanted):
    assert masked(spark, text) == wanted


def test_long_runs_stay_linear(spark):
    run = "a" * 300_000
    assert masked(spark, run + " x@y.org") == run + " <EMAIL>"


def test_random_tokens_equal_a_direct_computation(spark):
    rnd = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/äöü€"
    texts = [" ".join("".join(rnd.choice(alphabet[:rnd.randrange(2, len(alphabet))]) for _ in range(rnd.randrange(1, 60)))
                      for _ in range(12)) for _ in range(60)]
    want = [re.sub(r"[^\t\n\f\r ]+", lambda m: "<SECRET>" if len(m[0].encode()) >= 12 and derived_entropy(m[0]) >= 4.0 else m[0], t)
            for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = an.anonymize(df, an.redact_random_tokens(4.0, 12)).orderBy("i").collect()
    assert [r.t for r in got] == want and "<SECRET>" in " ".join(want)


def test_rules_by_name_and_nesting(spark):
    df = spark.sql("""SELECT 'A@b.co' AS Email, 5 AS ip, named_struct('user_name', 'Bob', 'list', array('a@b.org', 'ok'),
        'drop_me', 1, 'm', map('user_agent', 'Mozilla', 'note', 'c@d.net')) AS body, '' AS full_name""")
    chain = an.chain(an.drop_fields("drop_me"), None, an.default_rules())
    out = an.anonymize(df, chain)
    row = out.first()
    assert row.Email == "<EMAIL>" and row.ip == "5" and row.full_name == ""
    assert row.body.user_name == derived_scramble("Bob") and row.body.list == ["<EMAIL>", "ok"]
    assert "drop_me" not in row.body.asDict() and row.body.m == {"user_agent": "REDACTED", "note": "<EMAIL>"}
    assert "PythonUDF" not in plan_of(out) and "EvalPython" not in plan_of(out)


def test_maps_and_variants_are_walked(spark):
    df = spark.sql("""SELECT map('password', 'hunter2', 'x', 'y') AS m, map(1, 'a@b.com') AS n,
        parse_json('{"k": "a@b.com", "l": [1, "c@d.net"]}') AS v, parse_json(NULL) AS w""")
    row = an.anonymize(df, an.chain(an.drop_fields("password"), an.default_rules())).selectExpr(
        "m", "n", "to_json(v) AS v", "w IS NULL AS w").first()
    assert row.m == {"x": "y"} and row.n == {1: "<EMAIL>"} and row.v == '{"k":"<EMAIL>","l":[1,"<EMAIL>"]}' and row.w


NAMES = ["a", "b", "password", "User_Name", "note", "x y", 'q"t', "ip", "0", "~"]


def made_json(rnd, depth):
    kind = rnd.random()
    if depth and kind < .35:
        return {n: made_json(rnd, depth - 1) for n in rnd.sample(NAMES, rnd.randrange(5))}
    if depth and kind < .55:
        return [made_json(rnd, depth - 1) for _ in range(rnd.randrange(5))]
    return rnd.choice(["mail a@b.com", "", None, 5, 1.5, True, "plain", 'é"\\\n{['])


def walked_json(value, name):
    """The rules of ``VARIANT_RULES``, restated on Python values."""
    if name == "note":
        return "<TRUNCATED>"
    if isinstance(value, dict):
        return {k: walked_json(v, k) for k, v in value.items() if k != "password"}
    if isinstance(value, list):
        return [walked_json(v, name) for v in value]
    if name.lower() == "user_name" and value not in (None, ""):
        return "N"
    return re.sub(r"[a-z]+@[a-z.]+", "<EMAIL>", value) if isinstance(value, str) else value


VARIANT_RULES = an.chain(an.drop_fields("password"), an.truncate_fields("note"), an.by_column({"user_name": an.replace_with("N")}),
                         an.text_pattern("[a-z]+@[a-z.]+", "<EMAIL>"))


def test_rules_reach_any_depth_of_a_variant(spark):
    rnd = random.Random(1)
    values = [made_json(rnd, 6) for _ in range(300)]
    deep = {"a": "x@y.z"}
    for i in range(40):
        deep = {"b": [deep, 1]} if i % 2 else {"password": 1, "User_Name": deep}
    values += [deep, {f"k{i}": {"password": i, "v": "a@b.c"} for i in range(400)}, [[]], {}, "top a@b.c", None, 7]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").selectExpr(
        "i", "parse_json(j) AS v", "array(parse_json(j)) AS l", "map('note', parse_json(j), 'k', parse_json(j)) AS m")
    for r in an.anonymize(df, VARIANT_RULES).selectExpr("i", "to_json(v) AS v", "to_json(l[0]) AS l", "to_json(m['note']) AS n", "to_json(m['k']) AS k").collect():
        value = values[r.i]
        assert json.loads(r.v) == walked_json(value, "v") and json.loads(r.l) == walked_json(value, "l")
        assert json.loads(r.k) == walked_json(value, "k") and json.loads(r.n) == "<TRUNCATED>"


def test_missing_variants_stay_missing(spark):
    df = spark.sql("SELECT parse_json(CAST(NULL AS STRING)) AS v, 1 AS i")
    assert an.anonymize(df, an.default_rules()).first().v is None
    assert an.anonymize(df, an.drop_fields("v")).columns == ["i"]


def test_long_texts_are_scrambled_by_jumps_over_blocks(spark):
    text = "Long Text 42, " * 3000  # some hundred blocks
    assert spark.createDataFrame([(text,)], "t string").select(an.scramble(F.col("t"))).first()[0] == derived_scramble(text)


@pytest.mark.parametrize("name", ["an8_scrambled_names", "an9_scrambled_addresses", "an10_named_columns",
                                  "an10_named_fields_in_variants", "an2_variant_fields", "an2_variant_rules"])
def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path, name):
    n = 25_000
    ids = spark.range(0, n, 1, 1)
    ids.select(F.col("id").alias("c_custkey"), F.lit("Ann").alias("c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    ids.select(F.col("id").alias("event_id"), F.col("id").alias("user_id")).write.parquet(str(tmp_path / "events.parquet"))
    parts = registry.QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 3 and sum(r["count"] for r in parts) == n and max(r["count"] for r in parts) <= 10_000


def test_a_rule_stands_once_for_all_its_names(spark):
    calls = []
    rule = lambda text: calls.append(1) or F.upper(text)
    p = an.by_column({"a": rule, "B": rule, "c": an.replace_with("x")})
    rows = spark.createDataFrame([({"A": "p", "b": "q", "C": "r", "d": "s", "a": None, "c": ""},)], "m map<string,string>")
    assert an.anonymize(rows, p).first().m == {"A": "P", "b": "Q", "C": "x", "d": "s", "a": None, "c": ""}
    assert len(calls) == 2  # the map's probe and its entries


def test_dropping_ends_the_chain(spark):
    def never(value):
        raise AssertionError("must not run")

    df = spark.sql("SELECT 1 AS a, 2 AS b")
    assert an.anonymize(df.select("a", "b"), an.chain(an.drop_fields("a", "b"), None)).columns == []
    assert an.anonymize(df.select("a"), an.chain(an.drop_fields("a"), never)).columns == []


def test_custom_and_truncated_fields(spark):
    df = spark.sql("SELECT 'x' AS a, array(1, 2) AS b, 'y' AS c")
    rules = an.chain(an.truncate_fields("b"), an.custom(lambda name, col: an.DROP if name == "c" else F.upper(col)))
    row = an.anonymize(df, rules).first()
    assert row.asDict() == {"a": "X", "b": "<TRUNCATED>"}


def test_no_pattern_survives_in_the_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text")
    clean = an.anonymize(docs, an.default_rules())
    for pattern, *_ in an.PATTERNS:
        assert clean.where(F.col("text").rlike(pattern)).count() == 0
    assert clean.count() == docs.count()
    again = an.anonymize(docs, an.default_rules())
    assert clean.exceptAll(again).count() == 0
