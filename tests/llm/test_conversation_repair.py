"""Conversation repair against a search over all edit sequences, and on edge cases."""

import hashlib
import heapq
import random
import zlib

import pytest

from arterion.llm import conversation_repair as m

MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def searched(rows):
    """The least (cost, audit) by uniform-cost search over edit sequences, and the repaired text."""
    heap, most = [(0, "", 0, "", ())], 4 * len(rows)
    while True:
        cost, audit, k, place, said = heapq.heappop(heap)
        if k == len(rows) and place in ("", "a"):
            return cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()
        for t, role in (("u", "user"), ("a", "assistant")):
            if (place, t) in MOVES and cost + 3 <= most + 6:
                heapq.heappush(heap, (cost + 3, audit + "I", k, t, (*said, role + ":")))
        if k == len(rows):
            continue
        row = rows[k]
        heapq.heappush(heap, (cost + 4, audit + "D", k + 1, place, said))
        if row.blank or row.duplicate:
            continue
        more = 3 * row.truncated
        if (place, row.role[:1]) in MOVES:
            heapq.heappush(heap, (cost + more, audit + "K", k + 1, row.role[:1], (*said, f"{row.role}:{row.text}")))
        for t, role in (("u", "user"), ("a", "assistant")):
            if (place, t) in MOVES:
                heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, t, (*said, f"{role}:{row.text}")))


def test_least_cost_and_audit_equal_a_search_over_all_edits():
    rng = random.Random(5)
    for _ in range(400):
        rows = []
        for k in range(rng.randint(0, 5)):
            fault = rng.choice(["", "", "", "blank", "duplicate", "truncated"])
            rows.append(m.Row(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{k}", fault == "blank", fault == "duplicate", fault == "truncated"))
        assert m.repaired(rows) == searched(rows), rows


def test_a_long_conversation_settles_what_its_derivations_share():
    rows = [m.Row("ua"[k % 2] + "x", f"{k}.") for k in range(5000)]
    chart = m.Chart()
    for row in rows:
        chart.take(row)
    assert max(len(d.audit) for d in chart.column.values()) < 200
    assert chart.repair()[:2] == (0, "K" * 5000)
    odd = [m.Row("tool", f"{k}.") for k in range(2001)]  # what to do with the first row is open until the last
    assert m.repaired(odd)[:2] == (3 * 2000 + 4, "D" + "R" * 2000)


def plain(rows):
    """The contract's result of (conv_id, turn, role, text) rows, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else text.translate({46: None, 33: None, 63: None}) if kind == 2 else text
            role = "user" if kind == 4 else role
            own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, ready = set(), []
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            blank, duplicate = not end, bool(end) and (role, text) in seen
            ready.append(m.Row(role, text, blank, duplicate, bool(end) and not duplicate and end[-1] not in ".!?"))
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(ready, ready[1:]))
        out[conv] = (gaps, *(sum(r[k] for r in ready) for k in (2, 3, 4)), illegal, *m.repaired(ready))
    return out


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(2)
    texts = ["Yes.", "No!", "and so", " \t", None, "", "é?", "x" * 50_000 + ".", "Yes.", "a\nb. "]
    rows = [(rng.randint(1, 40), rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(texts)) for _ in range(400)]
    return rows + [(None, 1, "user", "Hm."), (None, 2, "assistant", "Well."), (None, None, "user", "So."), (99, None, "user", "One."), (98, 5, "user", "Same."), (98, 5, "user", "Same.")]


def test_edge_cases_equal_plain_python(spark, odd_rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in odd_rows], "conv_id long, turn long, role string, text string, cost int, _kind string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in m.repair(m.damaged(df)).collect()}
    assert got == plain(odd_rows)


def test_dropped_conversations_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = m.repair(m.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema))).collect()
    assert [tuple(r) for r in rows] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert m.repair(m.damaged(spark.createDataFrame([], schema))).count() == 0
    kept = m.repair(m.undamaged(spark.createDataFrame([(gone, 0, "user", "Hi."), (gone, 1, "assistant", "Ho.")], schema))).first()
    assert (kept["cost"], kept["audit"]) == (0, "KK")
