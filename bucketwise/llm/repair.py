"""Repair of conversation structure by depth-first branch-and-bound.

A conversation is right when the first letters of its roles read ``(s?(ua)+)?``. Its rows can be kept (cost 0),
given the role user or assistant (1), deleted (2; blank and repeated rows must be) or joined by empty user or
assistant rows (5 each); a row whose text breaks off costs 5 unless it is deleted. Of the cheapest repairs, the one
whose edits read first in ASCII order (D, I, K, R) is taken.

The search goes down one edit at a time with a stack of its own. A prefix of edits is dropped when its cost plus the
least cost of the rows left is above the best repair found so far (or equal, with edits that read later), or when the
same place (row, letter written last) has been reached at least as well before. What is left at the end is proved
to be the best.

A conversation may hold any share of all rows. Rows are sorted over range partitions, which split it, and searched
in blocks of ``BLOCK`` rows: from each letter that may stand before a block to each that may stand at its end. The
blocks of a conversation are then put together in order, four prefixes at most at a time. Only that, and writing the
repaired rows in order, run through one task a conversation, as a stream.

Defined cases: a null role or text is one blank; a null conversation id is a conversation of its own; turns go by
number (null first), then role and a hash of role and text, and rows that are equal in all of them stay as many rows;
a role with no letter fits nowhere; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketwise.llm.graph import saved

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
BLOCK = 24
BLANK = " \t\n\x0b\x0c\r"
# What was written last (nothing, s, u, a), and what may be written then.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
WRITTEN = {USER: "user", ASSISTANT: "assistant"}
COMPLETE = frozenset((NOTHING, ASSISTANT))
FINE, TRUNCATED, FORBIDDEN = 0, 1, 2  # of a row: may stay, costs more, must go

Best = tuple[int, str]


@lru_cache(1 << 16)
def cheapest(rows: tuple[tuple[str, int], ...], start: int, ends: frozenset[int]) -> Best | None:
    """Cost and edits of the best repair of rows (letter, fault) between what stands before them and one of ``ends``."""
    n = len(rows)
    least = [0] * (n + 1)  # cost of the rows from each on, whatever is done
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if rows[i][1] else KEEP)
    best: Best | None = None
    seen: dict[tuple[int, int], Best] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, last, cost, edits = stack.pop()
        if best and (cost + least[i] > best[0] or (cost + least[i] == best[0] and edits > best[1])):
            continue
        before = seen.get((i, last))
        if before and before <= (cost, edits):
            continue
        seen[i, last] = cost, edits
        if i == n and last in ends and (best is None or (cost, edits) < best):
            best = cost, edits
        follows = FOLLOWS[last]
        written = [to for to in follows.values() if to in WRITTEN]
        # The most promising edit is pushed last.
        stack += [(i, to, cost + INSERT, edits + "I") for to in written]
        if i == n:
            continue
        own, fault = rows[i]
        stack.append((i + 1, last, cost + DELETE, edits + "D"))
        if fault == FORBIDDEN:
            continue
        more = CUT_OFF if fault == TRUNCATED else 0
        stack += [(i + 1, to, cost + REROLE + more, edits + "R") for to in written]
        if own in follows:
            stack.append((i + 1, follows[own], cost + KEEP + more, edits + "K"))
    return best


def ways(rows: tuple[tuple[str, int], ...], starts: tuple[int, ...], whole_end: bool) -> list[tuple[int, int, int, str]]:
    """Start, end, cost and edits of the best way through a block from each start to each end it can have."""
    system = any(letter == "s" and fault != FORBIDDEN for letter, fault in rows)
    out = []
    for start in starts:
        if whole_end:
            targets = [COMPLETE]
        else:
            reachable = [USER, ASSISTANT, *[s for s in (NOTHING, SYSTEM) if s == start or (s == SYSTEM and start == NOTHING and system)]]
            targets = [frozenset((e,)) for e in reachable]
        for ends in targets:
            found = cheapest(rows, start, ends)
            if found:
                out.append((start, ASSISTANT if whole_end else min(ends), *found))
    return out


class Joined:
    """Blocks of one conversation put together in order: the best prefix for each letter that may stand last."""

    def __init__(self):
        self.common: list[str] = []
        self.best: dict[int, Best] = {NOTHING: (0, "")}

    def add(self, found: list[dict]) -> None:
        new: dict[int, Best] = {}
        for way in found:
            if way["start"] in self.best:
                cost, edits = self.best[way["start"]]
                both = cost + way["cost"], edits + way["edits"]
                if way["end"] not in new or both < new[way["end"]]:
                    new[way["end"]] = both
        same = os.path.commonprefix([edits for _, edits in new.values()])
        self.common.append(same)
        self.best = {end: (cost, edits[len(same):]) for end, (cost, edits) in new.items()}

    def result(self) -> Best:
        cost, edits = min(b for end, b in self.best.items() if end in COMPLETE)
        return cost, "".join(self.common) + edits


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK))


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h"), F.col("place")]


def placed(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text and what orders the rows of a turn, as a saved table."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    return saved(rows.select("*", F.xxhash64("role", "text").alias("h"), F.xxhash64("text", F.lit(1), "role").alias("g"),
                             F.monotonically_increasing_id().alias("place")), "turns")


def _flagged(rows: DataFrame) -> DataFrame:
    """Rows without their text, and what is wrong with each: blank, duplicate or truncated."""
    light = rows.select("conv", "turn", "role", "h", "g", "place", (_trimmed(F.col("text")) == "").alias("blank"),
                        F.coalesce(~F.right(_trimmed(F.col("text")), F.lit(1)).isin(".", "!", "?"), F.lit(False)).alias("open"))
    # The first of the rows with one role and text; counted before the shuffle, so a common text is no hot key.
    first = (light.groupBy("conv", "h", "g").agg(F.min(F.struct("turn", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("conv").alias("c"), F.col("h").alias("hh"), F.col("g").alias("gg"), "first"))
    joined = light.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("hh")) & (F.col("g") == F.col("gg")), "left")
    again = F.coalesce(F.struct("turn", "place") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), "b").when(again, "d").when(F.col("open"), "t").otherwise("")
    return joined.select("conv", "turn", "role", "h", "place", F.substring("role", 1, 1).alias("letter"), fault.alias("fault"))


_WAY = "array<struct<start:int,end:int,cost:long,edits:string>>"


def _searched(flagged: DataFrame) -> DataFrame:
    """One row a block: counts of its rows, what stands at its edges, and the ways through it."""
    kinds = dict(flagged.dtypes)
    fields = ("part long, seq long, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
              f"low {kinds['turn']}, high {kinds['turn']}, turns long, ways {_WAY}")
    names = [f.split()[0] for f in fields.replace(_WAY, "x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind = None
        state = {"conv": None, "rows": [], "whole_start": False, "seq": 0, "any": False}

        def block(whole_end: bool) -> pa.RecordBatch:
            rows = state["rows"]
            letters = [r[1] for r in rows]
            turns = [r[0] for r in rows if r[0] is not None]
            faults = [r[2] for r in rows]
            coded = tuple((r[1], FORBIDDEN if r[2] in ("b", "d") else TRUNCATED if r[2] else FINE) for r in rows)
            found = ways(coded, (NOTHING,) if state["whole_start"] else (NOTHING, SYSTEM, USER, ASSISTANT), whole_end)
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
            values = [state["conv"], part, state["seq"], len(rows), faults.count("b"), faults.count("d"), faults.count("t"), illegal,
                      letters[0], letters[-1], min(turns, default=None), max(turns, default=None), len(set(turns)),
                      [dict(zip(("start", "end", "cost", "edits"), w, strict=True)) for w in found]]
            state["seq"] += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["conv", *names])

        types: list[pa.DataType] = []
        for batch in batches:
            if kind is None:
                kind, turn = batch.schema.field("conv").type, batch.schema.field("turn").type
                way = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
                types += [kind, *[pa.int64()] * 7, pa.string(), pa.string(), turn, turn, pa.int64(), way]
            columns = (batch.column(c).to_pylist() for c in ("conv", "turn", "letter", "fault"))
            for conv, turn, letter, fault in zip(*columns, strict=True):
                if state["any"] and conv == state["conv"]:
                    if len(state["rows"]) == BLOCK:
                        yield block(False)
                        state["rows"], state["whole_start"] = [], False
                else:
                    if state["rows"]:
                        yield block(True)
                    # The first conversation of a partition may have begun in the one before.
                    state.update(conv=conv, rows=[], whole_start=state["any"], any=True)
                state["rows"].append((turn, letter, fault))
        if state["rows"]:
            yield block(False)  # it may go on in the next partition

    ordered = flagged.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    return ordered.select("conv", "turn", "letter", "fault").mapInArrow(run, f"conv {kinds['conv']}, {fields}")


_SUMS = ("rows", "blank", "duplicate", "truncated", "illegal")


def _put_together(blocks: DataFrame) -> DataFrame:
    kind = dict(blocks.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, joined, begun, conv_type = {}, Joined(), False, None

        def close() -> pa.RecordBatch:
            cost, edits = joined.result()
            gaps = 0 if own["low"] is None else int(own["high"] - own["low"]) + 1 - own["turns"]
            values = [own["conv"], gaps, *[own[c] for c in _SUMS[1:]], cost, edits]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                values, [conv_type, *[pa.int64()] * 6, pa.string()], strict=True)],
                ["conv", "gaps", *_SUMS[1:], "cost", "audit"])

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if not begun or row["conv"] != own["conv"]:
                    if begun:
                        yield close()
                    own, joined, begun = dict(row), Joined(), True
                else:
                    for c in _SUMS:
                        own[c] += row[c]
                    own["illegal"] += own["last"] + row["first"] not in ("su", "ua", "au")
                    own["last"] = row["last"]
                    own["turns"] += row["turns"] - (row["low"] is not None and own["high"] == row["low"])
                    own["low"] = row["low"] if own["low"] is None else own["low"]
                    own["high"] = own["high"] if row["high"] is None else row["high"]
                joined.add(row["ways"])
        if begun:
            yield close()

    ordered = blocks.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "seq")
    return ordered.mapInArrow(run, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def find_repairs(rows: DataFrame) -> DataFrame:
    """Per conversation of ``placed`` rows: gaps in its turns, its faults, and the cost and edits of its best repair."""
    return _put_together(saved(_searched(_flagged(rows)), "blocks"))


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations: conv, number, role and text, in order within partitions."""
    kind = dict(rows.dtypes)["conv"]
    turn = dict(rows.dtypes)["turn"]
    edits = repairs.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(turn).alias("turn"), F.lit("").alias("role"),
                           F.col("audit").alias("text"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("place"))
    both = edits.unionByName(rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "h", "place"))
    first, *rest = _order()
    ordered = both.repartition("conv").sortWithinPartitions(first, "kind", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, last, number = None, "", 0, NOTHING, 0
        for batch in batches:
            out: list[tuple] = []

            def write(role: str, text: str) -> None:
                nonlocal number
                out.append((conv, number, role, text))
                number += 1

            def inserted() -> None:
                nonlocal at, last
                while at < len(audit) and audit[at] == "I":
                    last = USER if last != USER else ASSISTANT
                    write(WRITTEN[last], "")
                    at += 1

            columns = (batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))
            for c, what, role, text in zip(*columns, strict=True):
                if not what:
                    conv, audit, at, last, number = c, text, 0, NOTHING, 0
                    inserted()
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    last = FOLLOWS[last][role[:1]]
                    write(role, text)
                elif edit == "R":
                    last = USER if last != USER else ASSISTANT
                    write(WRITTEN[last], text)
                inserted()
            kinds = (batch.schema.field("conv").type, pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["conv", "number", "role", "text"])

    return ordered.select("conv", "kind", "role", "text").mapInArrow(run, f"conv {kind}, number long, role string, text string")


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of the lines ``role:text`` of each conversation that has rows; the order of ``repaired_turns`` is used as it is."""
    kind = dict(repaired.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hashed, conv_type = None, None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], conv_type), pa.array(columns[1], pa.string())], ["conv", "digest"])

        for batch in batches:
            conv_type, out = batch.schema.field("conv").type, []
            for c, number, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "number", "role", "text")), strict=True):
                if number == 0:
                    if hashed:
                        out.append((conv, hashed.hexdigest()))
                    conv, hashed = c, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
            yield batch_of(out)
        if hashed:
            yield batch_of([(conv, hashed.hexdigest())])

    return repaired.mapInArrow(run, f"conv {kind}, digest string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults that follow from a checksum of conversation and turn: one in 20 each is dropped, emptied,
    loses its full stops, stands twice, or gets the role user. Nulls count as one blank."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    code = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c), blank) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).where("code <> 0")
    changed = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                       changed.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair_report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation id of ``conversations``: faults in ``turns``, cost and edits of the repair, digest of the repaired rows."""
    rows = placed(turns)
    repairs = saved(find_repairs(rows), "repairs")
    digests = repaired_digests(repaired_turns(rows, repairs)).select(F.col("conv").alias("c"), "digest")
    found = repairs.join(digests, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    ids = conversations.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *_SUMS[1:], "cost")]
    return (ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
            .select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))
