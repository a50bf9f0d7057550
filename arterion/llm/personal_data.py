"""Personal data: spans by pattern, and spans that a character tagger adds.

Base spans are those of four patterns, each with its check.  A bidirectional
LSTM under a CRF (:mod:`arterion.llm.char_tagger`) then finds what the patterns
miss since it is written otherwise: "name (at) host dot example", a card with
dots between its groups, a number without its plus.  It is trained in numpy on
labelled spans: windows of the corpus around what the patterns match, and the
same windows with the span rewritten.

Overlapping windows lie on a grid over the whole text.  Every kind holds a digit
or an "@" or a word for it, so windows without one hold no span and needn't be
decoded.  A span that touches the edge of its window is joined with the parts
that the next windows found; of what is left a document's spans are chosen at
once, not overlapping and with the highest sum of margins.  An added span must
read as its kind once it is written plainly (a card passes Luhn, parts of an
address are at most 255), and doesn't overlap a base span.

Bounds: MOST_DOCUMENTS documents, drawn by hash, are looked through for windows
to train on, of which MOST_WINDOWS of each kind are taken, the first by hash.

Defined results: a null or empty text has no span; offsets are code points, ends
exclusive; equal texts have equal spans; rows that repeat a doc_id are rows of
their own; if no window is labelled, as in an empty table, nothing is trained
and only base spans are found; further columns stay, whatever their names, but
for ``spans``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arterion.llm.char_tagger import classes, PAD, Tagger
from arterion.llm.common import table, text_or_empty, tidied

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
WIDTH, STRIDE = 64, 32
MOST_DOCUMENTS, MOST_WINDOWS = 20_000, 400
#: Windows that are decoded together.
TOGETHER = 1024

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What every span of any kind holds: a digit, an "@", or the word for it before a host.
_SIGN = re.compile(r"[0-9@]|(?i:\bat\b(?=[^\n]{1,40}?(?:\bdot\b|\.[a-z])))")
_NARROW = re.compile(r"[0-9@]")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _part_fits(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and (not digits or int(digits) <= 255)


def fits(kind: int, text: str) -> bool:
    """The check of a pattern's match."""
    if kind == EMAIL:
        return True
    if kind == IP:
        return all(_part_fits(x) for x in text.split("."))
    digits = "".join(_RUN.findall(text))
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == CARD else 9 <= len(digits) <= 15


def matches(text: str) -> list[Span]:
    """All matches of the patterns, checked or not, by kind and start; each is leftmost and none overlaps one of its kind.

    The local part of an address is sought backwards from its "@", and addresses of numbers within chains of runs, so
    long runs of one class are read once.
    """
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append(Span(EMAIL, start, done))
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    first = _DIGIT.search(text)
    if not first:
        return out
    for chain in _CHAIN.finditer(text, first.start()):
        if "." in chain.group():
            runs = list(_RUN.finditer(text, chain.start(), chain.end()))
            out.extend(Span(IP, runs[k].start(), runs[k + 3].end()) for k in range(0, len(runs) - 3, 4))
    out.extend(Span(CARD, m.start(), m.end()) for m in _CARD.finditer(text, first.start()))
    if "+" in text:
        out.extend(Span(PHONE, m.start(), m.end()) for m in _PHONE.finditer(text))
    return out


def base_spans(text: str) -> list[Span]:
    """The matches that pass their check."""
    return [s for s in matches(text) if fits(s.kind, text[s.start : s.end])]


def reads_as(kind: int, text: str) -> bool:
    """Whether a span that the tagger found is of its kind once it is written plainly."""
    if kind == EMAIL:
        plain = re.sub(r"\s*[\[(]\s*(?i:at)\s*[\])]\s*|\s+(?i:at)\s+|\s*@\s*", "@", text.strip(), count=1)
        plain = re.sub(r"\s*[\[(]\s*(?i:dot|\.)\s*[\])]\s*|\s+(?i:dot)\s+|\s*\.\s*", ".", plain)
        local, _, host = plain.partition("@")
        return bool(_LOCAL.match(local) and _DOMAIN.fullmatch(host) and host.rpartition(".")[2].isalpha() and len(local) > 1)
    if kind == IP:
        plain = re.sub(r"\s*[\[(]?\s*(?i:dot|\.)\s*[\])]?\s*", ".", text.strip())
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", plain)) and fits(IP, plain)
    digits = "".join(str(int(c)) for c in text if c.isdigit())
    apart = any(not c.isdigit() for c in text.strip())
    return apart and (13 <= len(digits) <= 19 and luhn(digits) if kind == CARD else 9 <= len(digits) <= 15)


def rewritten(kind: int, text: str, rng: np.random.Generator) -> str:
    """A span of ``kind`` written in another way."""
    pick = lambda *ways: ways[rng.integers(len(ways))]
    if kind == EMAIL:
        local, _, host = text.partition("@")
        return local + pick(" @ ", " at ", " (at) ", "[at]", " [at] ", "(at)") + host.replace(".", pick(".", ".", " dot ", "[dot]", " (dot) ", "[.]"))
    if kind == IP:
        return text.replace(".", pick(" . ", "[.]", " dot ", "(.)", "[dot]"))
    digits = "".join(_RUN.findall(text))
    if kind == CARD:
        return pick(".", " - ", "  ", "/", "_", ". ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    head, tail = digits[:-10] or "1", digits[-10:]
    return pick("({b}) {c}-{d}", "{b}-{c}-{d}", "{b}.{c}.{d}", "00{a} {b} {c} {d}", "+{a}/{b}/{c}/{d}", "+ {a} {b} {c} {d}", "{b} {c} {d}").format(a=head, b=tail[:-7], c=tail[-7:-4], d=tail[-4:])


def tags(spans: list[Span], start: int, end: int) -> np.ndarray:
    """The tag of each code point from ``start`` up to ``end``."""
    out = np.zeros(end - start, np.int64)
    for kind, a, b in spans:
        a, b, begins = max(a, start), min(b, end), a >= start
        if a < b:
            out[a - start : b - start] = 2 + 2 * kind
            if begins:
                out[a - start] = 1 + 2 * kind
    return out


def _shaped(spans: list[Span], text: str) -> list[Span]:
    """Of matches those that look like their kind, whether or not their digits check; what the tagger can learn to see."""
    sizes = {CARD: (13, 19), PHONE: (9, 15)}
    fit = [s for s in spans if s.kind not in sizes or sizes[s.kind][0] <= sum(c.isdigit() for c in text[s.start : s.end]) <= sizes[s.kind][1]]
    taken = [s for s in fit if s.kind in (EMAIL, IP, PHONE)]
    return taken + [s for s in fit if s.kind == CARD and not any(o.start < s.end and s.start < o.end for o in taken)]


def training_windows(docs: DataFrame, most_documents: int = MOST_DOCUMENTS, most: int = MOST_WINDOWS) -> list[tuple[str, str, int, int]]:
    """(before, span, after, kind): at most ``most`` windows of each kind, and of those around a sign without a span (kind -1)."""
    every = -(-docs.count() // most_documents)
    some = docs.where(F.col("text").isNotNull())
    if every > 1:
        some = some.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[int, str, int, int]] = set()
            for text in batch.column(0).to_pylist():
                spans = _shaped(matches(text), text)
                for kind, start, end in spans:
                    if end - start < WIDTH:
                        a, b = max(0, start - WIDTH), min(len(text), end + WIDTH)
                        if not any(s.start < b and a < s.end and s != (kind, start, end) for s in spans):
                            rows.add((kind, text[a:b], start - a, end - a))
                for m in list(_NARROW.finditer(text))[:: STRIDE // 4]:
                    a, b = max(0, m.start() - WIDTH), min(len(text), m.start() + WIDTH)
                    if not any(s.start < b and a < s.end for s in spans):
                        rows.add((-1, text[a:b], m.start() - a, m.start() - a))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted(rows), strict=True)], ["kind", "text", "start", "end"])

    found = some.select("text").mapInArrow(tidied(around), "kind long, text string, start long, end long").distinct()
    first = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("text"), "text", "start"))
    rows = found.withColumn("place", first).where(F.col("place") <= most).collect()  # a bounded number of short windows
    return [(r["text"][: r["start"]], r["text"][r["start"] : r["end"]], r["text"][r["end"] :], r["kind"]) for r in sorted(rows, key=lambda r: (r["kind"], r["place"]))]


def trained(docs: DataFrame, most_documents: int = MOST_DOCUMENTS, most: int = MOST_WINDOWS, steps: int = 500, seed: int = 1) -> Tagger | None:
    """A tagger of what the patterns match in ``docs``, and of the same written otherwise; None if nothing is labelled."""
    found = training_windows(docs, most_documents, most)
    if not any(kind >= 0 for *_, kind in found):
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []

    def put(before: str, span: str, after: str, kind: int) -> None:
        text, start = before + span + after, len(before)
        spans = [Span(kind, start, start + len(span))] if kind >= 0 else []
        lead = int(rng.integers(0, WIDTH - min(len(span), WIDTH) + 1))
        a = max(0, min(start - lead, len(text) - WIDTH))
        b = min(len(text), a + WIDTH)
        x.append(np.pad(classes(text[a:b]), (0, WIDTH - (b - a)), constant_values=PAD))
        y.append(np.pad(tags(spans, a, b), (0, WIDTH - (b - a))))

    for before, span, after, kind in found:
        put(before, span, after, kind)
        if kind >= 0:
            for _ in range(3):
                put(before, rewritten(kind, span, rng), after, kind)
    model = Tagger(len(KINDS), seed=seed)
    model.fit(np.stack(x), np.stack(y), steps=steps)
    return model


def window_starts(text: str) -> list[int]:
    """Starts of the windows on the grid that hold a sign."""
    last = max(0, -(-(len(text) - WIDTH) // STRIDE))
    out: dict[int, None] = {}
    for m in _SIGN.finditer(text):
        for k in range(max(0, -(-(m.end() - WIDTH) // STRIDE)), min(last, m.start() // STRIDE) + 1):
            out[k * STRIDE] = None
    return sorted(out)


def reconciled(found: list[tuple[int, int, int, float, bool]]) -> list[Span]:
    """Spans of one document from those of all its windows, (kind, start, end, margin, cut).

    Spans of a kind that overlap are joined if one of them is cut by its window's edge; then those are taken that don't
    overlap and have the highest sum of margins, of equal sums the one that ends first.
    """
    whole = []
    for _, group in groupby(sorted(set(found)), key=lambda s: s[0]):
        row: list[list] = []
        for kind, start, end, margin, cut in group:
            last = row[-1] if row else None
            if last and start <= last[2] and (cut or last[4]) and not (start == last[2] and not cut):
                last[2], last[3], last[4] = max(last[2], end), max(last[3], margin), (last[4] if end < last[2] else cut)
            else:
                row.append([kind, start, end, margin, cut])
        whole.extend(row)
    whole.sort(key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in whole]
    best: list[tuple[float, tuple | None]] = [(0.0, None)]
    for k, (kind, start, end, margin, _) in enumerate(whole):
        before = bisect_right(ends, start, 0, k)
        take = best[before][0] + max(margin, 0.0)
        best.append((take, (before, Span(kind, start, end))) if take > best[k][0] else (best[k][0], (k, None)))
    out, k = [], len(whole)
    while k:
        k, span = best[k][1]
        if span:
            out.append(span)
    return out[::-1]


def decoded(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """What the tagger finds in each of ``texts``, over all its windows."""
    places = ((k, start) for k, text in enumerate(texts) for start in window_starts(text))
    found: list[list] = [[] for _ in texts]
    while chunk := [p for p, _ in zip(places, range(TOGETHER), strict=False)]:
        x = np.zeros((len(chunk), WIDTH), np.int64)
        for row, (k, start) in enumerate(chunk):
            part = classes(texts[k][start : start + WIDTH])
            x[row, : len(part)] = part
        best, margins = model.decode(x)
        for row in np.flatnonzero(best.any(axis=1)):
            k, start = chunk[row]
            line, size = best[row], min(WIDTH, len(texts[k]) - start)
            at = 0
            while at < size:
                if not line[at]:
                    at += 1
                    continue
                kind, end = (line[at] - 1) // 2, at + 1
                while end < size and line[end] == 2 + 2 * kind:
                    end += 1
                cut = (at == 0 and start > 0) or (end == size and start + size < len(texts[k]))
                found[k].append((int(kind), start + at, start + end, float(margins[row, at:end].sum()), cut))
                at = end
    return [reconciled(f) for f in found]


def added(text: str, base: list[Span], failed: list[Span], seen: list[Span]) -> list[Span]:
    """Of the tagger's spans those to add to the base ones, without blanks at their ends."""
    out = []
    for kind, start, end in seen:
        while start < end and text[start] in " \t\n\r,;:\"'":
            start += 1
        while end > start and text[end - 1] in " \t\n\r,;:.\"'":
            end -= 1
        inside = (start and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end].isalnum() and text[end - 1 : end].isalnum())
        clash = any(s.start < end and start < s.end for s in base) or any(s.start < end and start < s.end for s in failed if s.kind in (kind, IP))
        if start < end and not inside and not clash and reads_as(kind, text[start:end]):
            out.append(Span(kind, start, end))
    return out


def find_all(texts: list[str], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    every = [matches(t) for t in texts]
    base = [[s for s in found if fits(s.kind, t[s.start : s.end])] for t, found in zip(texts, every, strict=True)]
    seen = decoded(model, texts) if model else [[]] * len(texts)
    return [(b, added(t, b, [s for s in f if s not in b and (s.kind not in (IP, CARD) or (s.end - s.start < 16 if s.kind == IP else s.end - s.start > 12))], s)) for t, f, b, s in zip(texts, every, base, seen, strict=True)]


def said(spans: list[Span]) -> str:
    """kind:start:end by kind, then start, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: Tagger | None, with_text: bool = True) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, base), by kind, then start, in place of a column of this name."""
    names = [c for c in docs.columns if c.lower() != "spans" and (with_text or c != "text")]
    chosen = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), text_or_empty().alias("_text"))
    part = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500)
                both = find_all(rows.column(1).to_pylist(), model)
                lists = [[{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "base": own} for s, own in sorted([(s, True) for s in b] + [(s, False) for s in a])] for b, a in both]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lists, pa.list_(part))], ["_row", "spans"])

    schema = chosen.select("_row", F.lit(None).cast("array<struct<kind:string,start:int,end:int,base:boolean>>").alias("spans")).schema
    out = chosen.mapInArrow(tidied(spans), schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names], "spans")


def redacted(text: str, spans: str = "spans"):
    """A column: the text of column ``text`` with each of its spans as [kind]; of spans that overlap the first stays.

    For a table that :func:`find` gave.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit("").alias("said"), F.lit(0).alias("at"))
    said_ = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["said"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("said"), s["end"].alias("at")))
    return F.aggregate(ordered, state, said_, lambda acc: F.concat(acc["said"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, trained(docs), with_text=False)
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, label), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", label), ",").alias("spans"))
