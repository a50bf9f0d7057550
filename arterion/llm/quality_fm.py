"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The bracket is the sum over all pairs <v_i, v_j> x_i x_j in time linear in the
features that a document has.  Features: the document's words in hashed buckets
(dampened counts, unit length), statistics of its structure (letter cases,
punctuation, digits, repeated words and lines, word and line lengths, symbols)
and metadata (lengths).  It is fitted on the driver, by minibatches with
per-weight step sizes, on the features of a bounded sample of labelled rows,
which are made where the texts lie.

Defined results: a null text counts as an empty one, which has its own feature
and a score like any other; without labels of both kinds every score is the
share of label 1 (0.5 without any); repeated rows stay, and equal texts have
equal scores; equal labelled texts count once, with label 1 if any has it; texts
are scored whole; labels, lang, source and doc_id are never looked at in
scoring, nor are further columns, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.llm.common import lean, Scratch, table, tidied
from arterion.llm.labelled import MOST_LABELLED, fold, sample

BUCKETS, FACTORS = 1 << 12, 6
THRESHOLD = 0.3
STATISTICS = (
    "empty", "log_chars", "log_words", "log_lines", "upper", "digit", "punctuation", "blank", "other_symbol", "upper_words", "ends_mark", "no_letter",
    "mean_word", "long_words", "distinct_words", "distinct_lines", "mean_line", "top_word", "top_symbol", "digits_words", "distinct_pairs", "ascii",
)
_LETTER = re.compile(r"[^\W_]")
#: Words whose buckets a task remembers, and their characters at most.
REMEMBER, LONGEST = 200_000, 40
_SYMBOLS = [c for c in range(33, 127) if not chr(c).isalnum()]


class Featuriser:
    """Sparse features of texts: BUCKETS of words, then STATISTICS."""

    def __init__(self) -> None:
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.known: dict[str, int] = {}

    def statistics(self, text: str, parts: list[str]) -> list[float]:
        n, m = max(1, len(text)), max(1, len(parts))
        data = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        small = data[data < 128].astype(np.uint8)
        of = np.bincount(small, minlength=128)
        upper, digit, blank = of[65:91].sum(), of[48:58].sum(), of[32] + of[9:14].sum()
        marks = sum(of[ord(c)] for c in ".,;:!?'\"()-")
        letters = of[97:123].sum()
        symbols = len(small) - upper - digit - blank - marks - letters
        lines = text.split("\n")
        distinct = len(set(parts))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) if parts else np.zeros(1, np.int64)
        pairs = len(set(zip(parts, parts[1:], strict=False))) / max(1, len(parts) - 1)
        return [
            float(not parts), np.log1p(len(text)) / 10, np.log1p(len(parts)) / 8, np.log1p(len(lines)) / 6, upper / n, digit / n, marks / n, blank / n, symbols / n,
            sum(x.isupper() and len(x) > 1 for x in parts) / m, sum(x[-1] in ".,;:!?" for x in parts) / m, sum(not _LETTER.search(x) for x in parts) / m,
            min(3.0, float(sizes.mean()) / 10), float((sizes > 20).mean()), distinct / m, len(set(lines)) / len(lines), min(3.0, np.log1p(len(text) / len(lines)) / 8),
            max(Counter(parts).values(), default=0) / m, of[_SYMBOLS].max() / m, sum(x.isdigit() for x in parts) / m, pairs, len(small) / n,
        ]

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        parts = text.split()
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        bucket = lambda w: self.hash(w.lower()) % BUCKETS
        for w in set(parts).difference(known):
            if len(w) <= LONGEST:
                known[w] = bucket(w)
        if parts:
            at, n = np.unique(np.fromiter((known[w] if w in known else bucket(w) for w in parts), np.int64, len(parts)), return_counts=True)
            x = np.log1p(n)
            x /= np.sqrt((x * x).sum())
        else:
            at, x = np.empty(0, np.int64), np.empty(0)
        stats = np.array(self.statistics(text, parts))
        return np.concatenate([at, BUCKETS + np.arange(len(stats))]), np.concatenate([x, stats])


class FactorisationMachine:
    def __init__(self, size: int, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, factors))

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score before the sigmoid, sum_i v_i x_i) of rows that begin at ``starts`` of the flat features; none is empty."""
        vx = self.v[at] * x[:, None]
        s = np.add.reduceat(vx, starts)
        pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + pairs, s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 256, step: float = 0.1, ridge: float = 1e-4, seed: int = 7) -> None:
        rng, size = np.random.default_rng(seed), len(self.w)
        g0, gw, gv = 1e-8, np.full(size, 1e-8), np.full(self.v.shape, 1e-8)
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.w0 = float(np.log(mean / (1 - mean)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                lengths = np.array([len(rows[j][0]) for j in part])
                at, x = np.concatenate([rows[j][0] for j in part]).astype(np.int64), np.concatenate([rows[j][1] for j in part]).astype(np.float64)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                raw, s = self.raw(at, x, starts)
                e = np.repeat((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part), lengths)
                d0 = e[starts].sum()
                dw = np.bincount(at, e * x, size) + ridge * self.w
                grad = (e * x)[:, None] * (np.repeat(s, lengths, 0) - self.v[at] * x[:, None])
                dv = np.stack([np.bincount(at, grad[:, f], size) for f in range(grad.shape[1])], 1) + ridge * self.v
                g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
                self.w0 -= step * d0 / np.sqrt(g0)
                self.w -= step * dw / np.sqrt(gw)
                self.v -= step * dv / np.sqrt(gv)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])[:-1]])
        raw, _ = self.raw(np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> FactorisationMachine | float:
    """A machine fitted on labelled rows whose fold of five is not 0; a constant without labels of both kinds."""
    scratch = Scratch(docs.sparkSession)
    rows = sample(scratch, docs, labels, "quality", fold("doc_id", 5) != 0, most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featuriser = Featuriser()
        for batch in batches:
            found = [featuriser.features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype(np.int16) for a, _ in found], pa.list_(pa.int16())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], ["place", "label", "at", "x"])

    # Places fix the order of the rows, so fitting doesn't depend on how they are dealt.
    with lean(docs.sparkSession):
        got = rows.select(F.xxhash64("text").alias("place"), "text", "label").mapInArrow(tidied(work), "place long, label int, at array<short>, x array<float>").toArrow().sort_by("place")
    scratch.close()
    y = got["label"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    machine = FactorisationMachine(BUCKETS + len(STATISTICS))
    machine.fit([(a.values.to_numpy(), x.values.to_numpy()) for a, x in zip(got["at"], got["x"], strict=True)], y)
    return machine


def score(docs: DataFrame, machine: FactorisationMachine | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the probability of label 1."""
    if isinstance(machine, float):
        return docs.select(key, F.lit(machine).alias("score"))
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featuriser = Featuriser()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                p = held.value.scores([featuriser.features(x.as_py()) for x in rows.column(1)])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p, pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(tidied(work), f"`{key}` {kind}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
