import hashlib
import random
import zlib
from heapq import heappop, heappush

import pytest

from bucketwise.llm import repair
from bucketwise.llm.repair import COMPLETE, FOLLOWS, cheapest, damaged, find_repairs, placed, repair_report, repaired_turns
from tests.conftest import SMALL

BLANK = " \t\n\x0b\x0c\r"
COLUMNS = "conv_id long, turn long, role string, text string, conv string, place string, h string, fault string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else text.translate(str.maketrans("", "", ".!?")) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def brute_best(rows, start=0, ends=COMPLETE):
    """Cheapest edits by trying prefixes in the order of cost and edits, without any bound."""
    heap, seen, best = [(0, "", 0, start)], {}, None
    while heap:
        cost, edits, i, last = heappop(heap)
        if best and cost > best[0]:
            break
        if (i, last) in seen and seen[i, last] <= (cost, edits):
            continue
        seen[i, last] = cost, edits
        if i == len(rows) and last in ends:
            best = min(best or (cost, edits), (cost, edits))
        new = [to for letter, to in FOLLOWS[last].items() if letter in "ua"]
        for to in new:
            heappush(heap, (cost + 5, edits + "I", i, to))
        if i < len(rows):
            letter, fault = rows[i]
            heappush(heap, (cost + 2, edits + "D", i + 1, last))
            if fault != 2:
                for to in new:
                    heappush(heap, (cost + 1 + 5 * fault, edits + "R", i + 1, to))
                if letter in FOLLOWS[last]:
                    heappush(heap, (cost + 5 * fault, edits + "K", i + 1, FOLLOWS[last][letter]))
    return best


def brute_report(rows, hashes, ids):
    """Per conversation what ``repair_report`` returns, from (conv, turn, role, text) rows."""
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashes[r[2], r[3]]))
        counts, coded, seen = {"b": 0, "d": 0, "t": 0}, [], set()
        for _, _, role, text in own:
            body = text.rstrip(BLANK)
            fault = "b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            coded.append((role[:1], 2 if fault in ("b", "d") else 1 if fault else 0))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
        cost, audit = brute_best(coded) if own else (0, "")
        lines, letters, left = [], "", iter(own)
        for edit in audit:
            row = next(left) if edit != "I" else (None, None, None, "")
            if edit == "D":
                continue
            role = row[2] if edit == "K" else "assistant" if letters[-1:] == "u" else "user"
            letters += role[0]
            lines.append(f"{role}:{row[3]}")
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def hashes_of(spark, rows):
    pairs = sorted({(r[2], r[3]) for r in rows})
    found = spark.createDataFrame(pairs, "role string, text string").selectExpr("role", "text", "xxhash64(role, text) AS h").collect()
    return {(r.role, r.text): r.h for r in found}


def odd_turns():
    random.seed(21)
    texts = ["Fine.", "So?", "cut", " ", "", None, "Ends! \t\n", "x." * 4000, "\x0b\x0c\r", "é…", "Fine.", "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "umpire"]
    rows = [(c, t, random.choice(roles), random.choice(texts) if random.random() < 0.5 else f"Text {random.randrange(9)}.")
            for c in range(60) for t in range(random.randrange(1, 12))]
    rows += [(None, t, "user", f"No id {t}.") for t in (None, 3, 1, 3)]
    rows += [(70, None, "user", "Fine."), (70, None, "assistant", "Fine."), (71, 5, "user", "Twice."), (71, 5, "user", "Twice.")]
    rows += [(72, t, random.choice(roles[:6]), f"Long {t % 90}{random.choice('.!,')}") for t in range(300)]  # a third of all rows
    return rows


def test_search_finds_the_cheapest_and_least_edits():
    random.seed(4)
    for _ in range(1500):
        rows = tuple((random.choice(["s", "u", "u", "a", "a", "t", " ", ""]), random.choice([0, 0, 0, 1, 2])) for _ in range(random.randrange(11)))
        start = random.randrange(4)
        for ends in (COMPLETE, frozenset((2,)), frozenset((3,))):
            assert cheapest(rows, start, ends) == brute_best(rows, start, ends), (rows, start, ends)


@pytest.mark.parametrize("block", [3, 24])
def test_report_equals_brute_force(spark, block, monkeypatch):
    rows = odd_turns()
    df = spark.createDataFrame([(*r, "c", "p", "h", "f") for r in rows], COLUMNS).repartition(5)
    monkeypatch.setattr(repair, "BLOCK", block)
    got = sorted((tuple(r) for r in repair_report(damaged(df), df).collect()), key=str)
    after = brute_damage(rows)
    want = brute_report(after, hashes_of(spark, after), {r[0] for r in rows})
    assert got == want


def test_given_conversations_equal_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in repair_report(damaged(df), df).collect()), key=str)
    after = brute_damage(rows)
    assert got == brute_report(after, hashes_of(spark, after), {r[0] for r in rows})


def test_repaired_rows_are_right_and_an_empty_table_gives_none(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (2, 0, "assistant", "cut"), (3, 0, "system", "Be kind."),
                                (3, 1, "user", "Yes?"), (3, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    rows = placed(df)
    found = {r.conv: r for r in find_repairs(rows).collect()}
    assert [(found[c].cost, found[c].audit) for c in (1, 2, 3)] == [(1, "KR"), (2, "D"), (0, "KKK")]
    turns = sorted(map(tuple, repaired_turns(rows, find_repairs(rows)).collect()))
    assert turns == [(1, 0, "user", "Hello."), (1, 1, "assistant", "Again."), (3, 0, "system", "Be kind."), (3, 1, "user", "Yes?"),
                     (3, 2, "assistant", "Yes.")]
    none = df.limit(0)
    assert repair_report(damaged(none), none).count() == 0
    gone = repair_report(none, df).collect()
    assert {(r.cost, r.audit, r.repaired_sha256) for r in gone} == {(0, "", hashlib.sha256(b"").hexdigest())} and len(gone) == 3
