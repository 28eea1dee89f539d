"""Chat formatting by token-level assembly.

Every turn is START role SEPARATOR text END, where the three marks are reserved ids outside the
vocabulary. Role and text are encoded by themselves and the marks are spliced in between, so no text
can ever produce a mark. For the plain-text form of the marks, strings inside texts that look like one
are escaped: a backslash goes between ``<`` and ``|`` (one more where there already are some), which
can be taken back. The loss mask is the running sum of +1 where an assistant text begins and -1 where
it ends.

Defined cases: a null text or role is an empty one; a null conversation id is a conversation of its own;
turns go by number (null first), then role, the first 32 characters of the text and the ids, so repeated
turns have a fixed order; an empty table gives no rows; other columns of the input are ignored. Turns are
encoded where they are read, however long their conversation; offsets and digests alone need the order, so
only these stream through one task a conversation, with a running state and never held together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.encode import Codec
from bucketwise.llm.ragged import chunks, text_bytes

MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
TIE_CHARS = 32
_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def _escaped(column: pa.Array) -> pa.Array:
    return pa.array([escape(t or "") for t in column.to_pylist()], pa.string())


def _between(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """True from each begin up to its end: the running sum of +1 and -1."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step)[:-1].astype(bool)


def format_turns(turns: DataFrame, path: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """The turns of conversations in order, each with its ids, loss mask and place in its conversation.

    ``turns`` has conv_id, turn, role and text. Rows come sorted by conversation within partitions.
    """
    spark = turns.sparkSession
    shared = spark.sparkContext.broadcast(Codec.from_file(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    kinds = dict(turns.dtypes)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        start, separator, end = (len(codec.tokens) + i for i in range(3))
        for batch in batches:
            for part in chunks(batch):
                role_ids, role_at = codec.encode(*text_bytes(_escaped(part.column("role"))))
                text_ids, text_at = codec.encode(*text_bytes(_escaped(part.column("text"))))
                n_role, n_text = np.diff(role_at), np.diff(text_at)
                at = np.concatenate([[0], np.cumsum(n_role + n_text + 3)])
                ids = np.empty(at[-1], np.int32)
                mark = np.zeros(at[-1], bool)
                for where, value in ((at[:-1], start), (at[:-1] + n_role + 1, separator), (at[1:] - 1, end)):
                    ids[where], mark[where] = value, True
                in_role = _between(at[:-1] + 1, at[:-1] + 1 + n_role, at[-1])
                ids[in_role] = role_ids
                ids[~in_role & ~mark] = text_ids
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(n_role, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], [*part.schema.names, "n_role", "ids"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = object(), 0
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy().astype(np.int64)
            at -= at[0]
            learnt = np.array([r == loss_role for r in batch.column("role").to_pylist()], bool)
            text_from = at[:-1] + batch.column("n_role").to_numpy() + 2
            loss = _between(text_from[learnt], at[1:][learnt] - 1, at[-1])
            offset = np.zeros(batch.num_rows, np.int64)
            for i, (conv, size) in enumerate(zip(batch.column("conv_id").to_pylist(), np.diff(at).tolist(), strict=True)):
                if conv != last:
                    last, place = conv, 0
                offset[i] = place
                place += size
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(offset), lists,
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(loss))],
                ["conv_id", "turn", "offset", "ids", "loss_mask"])

    given = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}"
    encoded = turns.select("conv_id", "turn", "role", "text").mapInArrow(
        assembled, f"{given}, role string, text string, n_role int, ids array<int>")
    # Whole texts do not travel beside their ids: the start orders repeated turns, the ids settle the rest.
    keyed = encoded.select("conv_id", "turn", "role", F.left("text", F.lit(TIE_CHARS)).alias("start"), "n_role", "ids")
    ordered = (keyed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "start", "ids")
               .select("conv_id", "turn", "role", "n_role", "ids"))
    return ordered.mapInArrow(placed, f"{given}, offset long, ids array<int>, loss_mask array<boolean>")


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Digests per conversation, from the ids and masks of ``format_turns`` (its order is used as it is)."""
    spark = formatted.sparkSession
    shared = spark.sparkContext.broadcast(Codec.from_file(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        base, state = len(codec.tokens), None

        def closed(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t or id_type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def digest() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        id_type = None
        for batch in batches:
            out, id_type = [], batch.schema.field("conv_id").type
            lists, masks = batch.column("ids"), batch.column("loss_mask")
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                ids = lists[i].values.to_numpy()
                mask = masks[i].values.to_numpy(zero_copy_only=False)
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(digest())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                marks = np.flatnonzero(ids >= base)
                if ids[marks].tolist() != [base, base + 1, base + 2]:
                    raise ValueError("a turn needs its three marks")
                role, text, learnt = (codec.decode(x).tobytes().decode("utf-8") for x in (
                    ids[marks[0] + 1:marks[1]], ids[marks[1] + 1:marks[2]], ids[mask]))
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                learnt = unescape(learnt)
                state[3] += len(learnt)
                state[4].update(learnt.encode())
                state[5] += sum(map(len, MARKS)) + len(role) + len(text)
            if out:
                yield closed(out, id_type)
        if state is not None:
            yield closed([digest()], id_type)

    return formatted.select("conv_id", "ids", "loss_mask").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def plain_text(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """The formatted text of each turn, with the marks written out."""
    shared = formatted.sparkSession.sparkContext.broadcast(
        Codec.from_file(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))

    @F.pandas_udf("string")
    def text(column):
        codec = shared.value
        base, marks = len(codec.tokens), [m.encode() for m in MARKS]

        def one(ids):
            cuts = [0, *np.flatnonzero(ids >= base).tolist(), len(ids)]
            out = codec.decode(ids[:cuts[1]]).tobytes() if len(cuts) > 2 else b""
            for a, b in zip(cuts[1:-1], cuts[2:], strict=True):
                out += marks[ids[a] - base] + codec.decode(ids[a + 1:b]).tobytes()
            return out.decode("utf-8")

        return column.map(one)

    return formatted.withColumn("text", text("ids"))
