"""Conversation structure repair: an error-correcting Earley parse of role sequences.

The role grammar ``(s?(ua)+)?`` is stated left-recursively, so every item of
the chart has origin 0: a column needs column 0 and the column before it, and a
conversation of any length is parsed in one pass over its sorted rows.  Each
production is joined by weighted error productions: a terminal may be kept,
reroled or inserted, and any completed nonterminal may absorb a deleted row.
An item holds the least (cost, audit) of all derivations, and with it the state
of the repaired text's digest; the completed chart is the repair.

Items whose cost is more than SLACK over the column's least can't be part of a
cheapest derivation: from any nonterminal two inserts reach "assistant", and one
delete more stands in for a kept system row, so what follows costs 10 more at
most.  What all audits of a column begin with is settled and moved out of them;
an audit grows with its open end only.

Where rows are damaged and told blank, duplicate or truncated, Spark's own
expressions do it.  Duplicates are found by a window over (conversation, role,
text), so a long conversation is spread for that; the digest over a repaired
conversation is sequential by its definition, so the rows of one conversation
come sorted through one task, and none of them is held.

Defined results: a null conv_id is a conversation of its own; null role and text
are one space, and in the damage key a null conv_id or turn too; rows of one
turn are ordered by role and text; an empty role has no initial, so it must be
reroled or deleted; roles keep their spelling if their first letter fits; null
turns come first and count in no gap; a conversation whose rows are all dropped
has zeros, an empty audit and the digest of nothing; an empty table gives an
empty one; further columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arterion.llm.common import BLANK, table, tidied

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: (nonterminal, the one before it, terminal): nonterminal -> before terminal.  "open" also derives nothing.
PRODUCTIONS = (("system", "open", "s"), ("user", "open", "u"), ("user", "system", "u"), ("user", "assistant", "u"), ("assistant", "user", "a"))
START, GOALS = "open", ("open", "assistant")
#: Terminals that rows can be reroled to and that can be inserted.
ROLES = {"u": "user", "a": "assistant"}
ADJACENT = {"su", "ua", "au"}
SLACK = 12


class Row(NamedTuple):
    """A row of a conversation after damage: what of it the parse needs."""

    role: str
    text: str
    blank: bool = False
    duplicate: bool = False
    truncated: bool = False


class Derivation(NamedTuple):
    """The cheapest derivation of an item; ``said``: digest of the repaired text so far, None before its first row."""

    cost: int
    audit: str
    said: object = None
    more: tuple[str, ...] = ()

    def settled(self) -> Derivation:
        """The derivation with ``more`` gone into its digest."""
        if not self.more:
            return self
        said = self.said.copy() if self.said else hashlib.sha256()
        for k, piece in enumerate(self.more):
            said.update((piece if k == 0 and self.said is None else "\n" + piece).encode("utf-8", "surrogatepass"))
        return Derivation(self.cost, self.audit, said)


#: What waits for a nonterminal in column 0: predicted items whose dot stands before it.
WAITING = {x: tuple((lhs, t) for lhs, before, t in PRODUCTIONS if before == x) for x in (START, *dict.fromkeys(p[0] for p in PRODUCTIONS))}


def completed(offers: dict[str, Derivation]) -> dict[str, Derivation]:
    """A column: scanned nonterminals completed, and the inserted terminals that follow, until nothing gets better."""
    column, agenda = dict(offers), list(offers)
    while agenda:
        nonterminal = agenda.pop()
        done = column[nonterminal]
        for lhs, terminal in WAITING[nonterminal]:
            if terminal in ROLES:
                offer = Derivation(done.cost + INSERT, done.audit + "I", done.said, (*done.more, ROLES[terminal] + ":"))
                if lhs not in column or offer[:2] < column[lhs][:2]:
                    column[lhs] = offer
                    agenda.append(lhs)
    most = min(d.cost for d in column.values()) + SLACK
    return {x: d.settled() for x, d in column.items() if d.cost <= most}


def scanned(column: dict[str, Derivation], row: Row) -> dict[str, Derivation]:
    """Items of the next column whose dot has passed ``row``: kept, reroled or deleted."""
    offers: dict[str, Derivation] = {}
    extra = TRUNCATED if row.truncated else 0
    for before, (cost, audit, said, _) in column.items():
        edits = [(before, cost + DELETE, "D", None)]
        if not (row.blank or row.duplicate):
            for lhs, terminal in WAITING[before]:
                if row.role[:1] == terminal:
                    edits.append((lhs, cost + KEEP + extra, "K", row.role))
                elif terminal in ROLES:
                    edits.append((lhs, cost + REROLE + extra, "R", ROLES[terminal]))
        for lhs, now, letter, role in edits:
            offer = Derivation(now, audit + letter, said, () if role is None else (f"{role}:{row.text}",))
            if lhs not in offers or offer[:2] < offers[lhs][:2]:
                offers[lhs] = offer
    return offers


class Chart:
    """The newest column of a conversation's chart; ``audit``: the beginning that all its derivations share."""

    def __init__(self) -> None:
        self.column, self.audit, self.open = completed({START: Derivation(0, "")}), [], 0

    def take(self, row: Row) -> None:
        self.column = completed(scanned(self.column, row))
        self.open += 1
        if self.open % 64 == 0:
            shared = os.path.commonprefix([d.audit for d in self.column.values()])
            if shared:
                self.audit.append(shared)
                self.column = {x: d._replace(audit=d.audit[len(shared) :]) for x, d in self.column.items()}

    def repair(self) -> tuple[int, str, str]:
        """(cost, audit, hex digest) of the cheapest derivation of a goal."""
        best = min((self.column[g] for g in GOALS if g in self.column), key=lambda d: d[:2])
        return best.cost, "".join(self.audit) + best.audit, (best.said or hashlib.sha256()).hexdigest()


def repaired(rows: Iterable[Row]) -> tuple[int, str, str]:
    """(cost, audit, hex digest of the repaired text) of one conversation's rows, in their order."""
    chart = Chart()
    for row in rows:
        chart.take(row)
    return chart.repair()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): ``rows`` after the damage that crc32 of ``conv_id:turn`` says; a row that
    is dropped stays as a mark, ``gone``, so that its conversation is still known."""
    said = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.pmod(F.crc32(said.cast("binary")), F.lit(20)).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 0, F.lit("")).when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"), (kind == 0).alias("gone"))


def undamaged(rows: DataFrame) -> DataFrame:
    """``rows`` as they are, in the shape of :func:`damaged`."""
    return rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with blank, duplicate and truncated; the first that holds counts alone."""
    order = [F.col("turn").asc_nulls_first(), "copy"]
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(*order)) > 1
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    blank, duplicate = (end == "") & ~F.col("gone"), seen & ~F.col("gone")
    truncated = ~F.substring(end, -1, 1).isin(".", "!", "?") & ~F.col("gone")
    return rows.select("*", blank.alias("blank"), (duplicate & ~blank).alias("duplicate"), (truncated & ~blank & ~duplicate).alias("truncated"))


def repair(rows: DataFrame) -> DataFrame:
    """One row of gaps, faults, cost, audit and digest for each conversation of ``rows`` (as :func:`damaged` gives them)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ready = with_faults(rows).select("conv_id", "turn", "role", "text", "gone", "blank", "duplicate", "truncated")
    ready = ready.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "gone", "role", "text", "duplicate")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id {kind}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string"

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, now, began = [], [], None, False

        def close() -> None:
            found.append((*now.counts(), *now.chart.repair()))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv, turn, role, text, gone, blank, duplicate, truncated in zip(*columns, strict=True):
                if not began or conv != ids[-1]:
                    if began:
                        close()
                    ids.append(conv)
                    now, began = Conversation(), True
                if not gone:
                    now.take(turn, Row(role, text, blank, duplicate, truncated))
            if len(found) > 4096:
                yield rows_of(ids[:-1], found)
                ids, found = ids[-1:], []
        if began:
            close()
            yield rows_of(ids, found)

    def rows_of(ids: list, found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int64()] * 6 + [pa.string()] * 2, strict=True)] if found else [pa.array([], t) for t in [pa.int64()] * 6 + [pa.string()] * 2]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns], ["conv_id", *names, "audit", "repaired_sha256"])

    id_type = to_arrow_type(rows.schema["conv_id"].dataType)
    return ready.mapInArrow(tidied(parsed), schema)


class Conversation:
    """Counts of a conversation's rows, which come in order, and the chart of its parse."""

    def __init__(self) -> None:
        self.chart, self.faults, self.illegal = Chart(), [0, 0, 0], 0
        self.initial = self.first = self.last = None
        self.turns = 0

    def take(self, turn: int | None, row: Row) -> None:
        self.chart.take(row)
        for k, fault in enumerate(row[2:]):
            self.faults[k] += fault
        if self.initial is not None and self.initial + row.role[:1] not in ADJACENT:
            self.illegal += 1
        self.initial = row.role[:1]
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn

    def counts(self) -> tuple[int, ...]:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.faults, self.illegal


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _oracle() -> str:
    """The definition in SQL: crc32 bit by bit, faults by windows, and the cheapest (cost, audit, text) of the four
    places of the role automaton, row after row."""
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({key}, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
    crc = crc.replace("{key}", "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    value = "STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR)"

    def step(x: str, cost: str, letter: str, piece: str | None = None) -> str:
        said = f"{x}.said" if piece is None else f"CASE WHEN {x}.said IS NULL THEN {piece} ELSE {x}.said || chr(10) || {piece} END"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'cost': {x}.cost + {cost}, 'audit': {x}.audit || '{letter}', 'said': {said}}} END"

    def least(*offers: str) -> str:
        return f"list_sort(list_filter([{', '.join(offers)}]::{value}[], lambda v: v IS NOT NULL))[1]"

    extra = "CASE WHEN truncated THEN 3 ELSE 0 END"

    def read(x: str, letter: str, role: str) -> str:
        said = f"CASE WHEN r.initial = '{letter}' THEN r.role ELSE '{role}' END || ':' || r.text"
        cost = f"(CASE WHEN r.initial = '{letter}' THEN 0 ELSE 3 END + {extra})"
        return f"CASE WHEN NOT r.must THEN CASE WHEN r.initial = '{letter}' THEN {step(x, cost, 'K', said)} ELSE {step(x, cost, 'R', said)} END END"

    keep_s = f"CASE WHEN NOT r.must AND r.initial = 's' THEN {step('p.o', extra, 'K', "r.role || ':' || r.text")} END"
    before = {"o": [step("p.o", "4", "D")], "s": [keep_s, step("p.s", "4", "D")], "u": [read(f"p.{x}", "u", "user") for x in "osa"] + [step("p.u", "4", "D")], "a": [read("p.u", "a", "assistant"), step("p.a", "4", "D")]}
    scan = ", ".join(f"{least(*offers)} AS {x}" for x, offers in before.items())
    insert_u = ", ".join(step(x, "3", "I", "'user:'") for x in "osa")
    return f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, n.n AS copy,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM t JOIN (SELECT unnest([0, 1]) AS n) n ON n.n = 0 OR kind = 3 WHERE kind <> 0),
f AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, {blanks}) AS ended,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, copy
  FROM d),
g AS (
  SELECT *, ended = '' AS blank, ended <> '' AND seen AS duplicate, ended <> '' AND NOT seen AND right(ended, 1) NOT IN ('.', '!', '?') AS truncated,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS pos
  FROM f),
r AS (SELECT *, blank OR duplicate AS must, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM g),
steps AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'cost': 0, 'audit': '', 'said': NULL}}::{value} AS o, NULL::{value} AS s,
         {{'cost': 3, 'audit': 'I', 'said': 'user:'}}::{value} AS u, {{'cost': 6, 'audit': 'II', 'said': 'user:' || chr(10) || 'assistant:'}}::{value} AS a
  FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, pos, o, s, u2 AS u, {least('a', step('u2', '3', 'I', "'assistant:'"))} AS a
  FROM (SELECT conv_id, pos, o, s, a, {least('u', insert_u)} AS u2
        FROM (SELECT p.conv_id, r.pos, {scan} FROM steps p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos + 1) x) y),
ends AS (SELECT conv_id, {least('o', 'a')} AS best FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id)
SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(best.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t
LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM t.conv_id
"""


ORACLE_SQL = _oracle()
