"""Toxicity: maximum-scoring segments over token log-odds.

Each token has a log-odds score of toxic against clean labelled documents, with
a Dirichlet prior whose means are the token's rate in all documents (of tokens
that say little, in the labelled ones).  Every token counted has a score, of
either sign, and each is drawn to 0 the more the less sure its sign is: by
z^2 / (z^2 + c^2), z being its evidence in standard errors, so that a word seen
seldom says little but not nothing.  How much, c, is chosen of CAUTIONS by the
likelihood of documents that the scores weren't fitted on.  A word never
counted takes the score of its first letters.  Every
token pays a small drift, so that a text without toxic words sums to less and
less, and the linear-time scan for all maximal scoring segments finds each
passage where toxic words gather.  A segment of score S in m tokens has the
extreme-value p-value 1 - exp(-K m exp(-lambda S)), lambda being the root of
E[exp(lambda s)] = 1 over tokens of clean documents and K their rate of
segments; the surprise of a document's segments is calibrated to a probability
on documents that the scores weren't fitted on.

Counting, calibrating and scoring are done where the texts lie; the driver sees
numbers, and words of the bounded sample.

Defined results: a null or empty text has no segments and the lowest score;
without labels of both kinds every score is 0; repeated rows stay, and equal
texts have equal scores; texts are scanned whole; a row of the labels that
repeats a doc_id counts once, as toxic if any is; labels, lang, source and
doc_id are never looked at in scoring, nor are further columns, whatever their
names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.llm.common import lean, Scratch, table, tidied
from arterion.llm.labelled import MOST_LABELLED, fold, sample
from arterion.llm.wordhash import WordHasher

#: A word or stem must be in this many labelled training documents to have a score of its own.
LEAST_SEEN = 2
STEM = 5
#: Weight of the prior, in documents, and what each feature has besides.
PRIOR, EVEN = 50.0, 0.01
#: Evidence, in standard errors, at which half of a score is left.
CAUTIONS = (3.0, 3.5, 4.0)
#: Evidence beyond which the prior's mean is counted over all documents; that of others in the labelled ones.
TELLING = 3.0
DRIFT = 0.25
#: Parts of the sample; each is judged by what was fitted on the others.
PARTS = 4
#: Features that a task counts before it hands them on.
HELD = 20_000
#: Steps of the score, as of the tallies of clean tokens.
STEP = 0.001
THRESHOLD = 0.7
SIGNIFICANT = 0.01


def plain(texts: pa.Array) -> pa.Array:
    """Texts as lower-case words, of letters, digits and underscores, with blanks between."""
    return pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\pL\pN_]+", " ")


def words(text: str | None) -> list[str]:
    """The words of a text, as passages count them."""
    return plain(pa.array([text], pa.string()))[0].as_py().split()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) of ``scores``, by the linear-time stack method.

    No segment can be made better by growing or shrinking it, and none crosses another.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    back: list[int] = []  # the nearest segment to the left that begins lower
    for k in at.tolist():
        low, high, start, end = float(total[k]), float(total[k + 1]), k, k + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = back[j]
            if j < 0 or stack[j][1] >= high:
                stack.append((low, high, start, end))
                back.append(j)
                break
            low, start = stack[j][0], stack[j][2]
            del stack[j:], back[j:]
    return [(s, e, b - a) for a, b, s, e in stack]


class Scores(Mapping):
    """Scores by name, kept as two arrays; a name whose score is NaN isn't listed."""

    def __init__(self, names: pa.Array, scores: np.ndarray):
        self.names, self.scores = names, scores

    @cached_property
    def _by_name(self) -> dict[str, float]:
        return {n: v for n, v in zip(self.names.to_pylist(), self.scores.tolist(), strict=True) if v == v}

    def __getitem__(self, name: str) -> float:
        return self._by_name[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._by_name)

    def __len__(self) -> int:
        return int((~np.isnan(self.scores)).sum())


@dataclass
class Lexicon:
    """Scores of words and stems; every other word scores 0."""

    words: Mapping[str, float] = field(default_factory=dict)
    stems: Mapping[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] = (-4.0, 0.0, 0.0)

    def __getstate__(self) -> dict:
        """What tasks need: hashes in place of words."""
        return {k: v for k, v in self.__dict__.items() if k not in ("_hasher", "words", "stems")} | {"_tables": self._tables}

    @cached_property
    def _hasher(self) -> WordHasher:
        return WordHasher(STEM)

    @cached_property
    def _tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Scores by hash of word and by hash of stem, sorted; NaN of a word that isn't listed."""
        found = []
        for listed in (self.words, self.stems):
            h, order = sorted_hashes(listed.names if isinstance(listed, Scores) else pa.array(list(listed), pa.string()))
            values = listed.scores if isinstance(listed, Scores) else np.array(list(listed.values()), float)
            found.append((h, np.concatenate([[np.nan], values])[order]))
        return found

    def places(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text, its tokens' places in the tables of words and of stems, -1 where there is none.  Lexicons that
        were made of the same words share them."""
        (own, _), (stems, _) = self._tables
        for counts, h, first in self._hasher.groups(plain(texts)):
            at = np.minimum(np.searchsorted(own, h), len(own) - 1).astype(np.int32)
            at[own[at] != h] = -1
            near = np.minimum(np.searchsorted(stems, first), len(stems) - 1).astype(np.int32)
            near[(stems[near] != first) | (first == 0)] = -1
            cuts = np.cumsum(counts)[:-1]
            yield from zip(np.split(at, cuts), np.split(near, cuts), strict=True)

    def scored(self, at: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The scores of tokens at these places."""
        (_, value), (_, stem_value) = self._tables
        score = np.where(at >= 0, _real(value[at]), np.nan)
        by_stem = np.where(near >= 0, np.nan_to_num(_real(stem_value[near])), 0.0)
        return np.where(np.isnan(score), by_stem, score) - self.drift

    def scores(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The token scores of each text."""
        return (self.scored(*place) for place in self.places(texts))

    def surprise(self, score: float, m: int) -> float:
        """-ln of the chance of a segment of at least ``score`` among ``m`` clean tokens."""
        e = math.log(self.k * max(m, 1)) - self.lam * score  # ln of the expected number
        return -e if e < -20 else -math.log(max(1e-300, -math.expm1(-math.exp(min(e, 50)))))

    def segments(self, s: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(start word, end word, score, -ln p) of every maximal segment."""
        return [(a, b, x, self.surprise(x, len(s))) for a, b, x in maximal_segments(s)]

    @staticmethod
    def significant(found: list[tuple[int, int, float, float]], worst: float = SIGNIFICANT) -> list[tuple[int, int, float, float]]:
        return [x for x in found if x[3] >= -math.log(worst)]

    @staticmethod
    def features(found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """(surprise of the best segment, summed surprise of the others that are significant), both dampened."""
        x = sorted((x[3] for x in found), reverse=True)
        return (math.log1p(x[0]), math.log1p(sum(y for y in x[1:] if y >= -math.log(SIGNIFICANT)))) if x else (0.0, 0.0)

    def probability(self, found: list[tuple[int, int, float, float]]) -> float:
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(found), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))

    def probabilities(self, texts: list[str | None]) -> list[float]:
        return [self.probability(self.segments(s)) for s in self.scores(pa.array(texts, pa.string()))]


#: In tables that go to many tasks, scores are whole STEPs in two bytes; this one is that of a name that isn't listed.
UNLISTED = -(1 << 15)


def _steps(score: np.ndarray) -> np.ndarray:
    """Scores, which are whole STEPs, in two bytes."""
    return np.where(np.isnan(score), UNLISTED, np.clip(np.rint(np.nan_to_num(score) / STEP), 1 - (1 << 15), (1 << 15) - 1)).astype(np.int16)


def _real(values: np.ndarray) -> np.ndarray:
    """Scores of a table."""
    return np.where(values == UNLISTED, np.nan, values * STEP) if values.dtype == np.int16 else values


def sorted_hashes(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of ``names`` and of nothing, sorted; the order that sorts them), nothing being first."""
    h = np.concatenate([np.zeros(1, np.uint64), *[x for _, x, _ in WordHasher(STEM).groups(names)]])
    order = np.argsort(h)
    return h[order], order


def features_of(tokens: set[str]) -> set[str]:
    """Words, and the stems ("stem*") of those that are longer."""
    return tokens | {x[:STEM] + "*" for x in tokens if len(x) > STEM}


def counts(rows: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Features of a sample (text, label, part), their documents as [feature, part, label], and the numbers of documents.
    Features of fewer than LEAST_SEEN documents are left out; the others are bounded by the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["feature", "class", "n"])

        for batch in batches:
            for x, label, part_ in zip(plain(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen.update((f, 2 * part_ + label) for f in features_of(set(x.as_py().split())) | {"*"})
                if len(seen) >= HELD:
                    yield part()
                    seen.clear()
        if seen:
            yield part()

    rows = rows.mapInArrow(tidied(count), "feature string, class int, n long")
    cells = [F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(2 * PARTS)]
    total = " + ".join(f"n{c}" for c in range(2 * PARTS))
    got = rows.groupBy("feature").agg(*cells).where(f"{total} >= {LEAST_SEEN} OR feature = '*'").toArrow().combine_chunks().sort_by("feature")
    n = np.stack([got.column(f"n{c}").to_numpy() for c in range(2 * PARTS)], axis=1).astype(float).reshape(-1, PARTS, 2)
    names = got.column("feature").combine_chunks()
    every = pc.equal(names, "*").to_numpy(zero_copy_only=False)
    return names.filter(pa.array(~every)), n[~every], n[every].sum(0) if every.any() else np.zeros((PARTS, 2))


def evidence(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How sure the sign of each feature's log-odds is, in standard errors: the signed root of the likelihood ratio of
    its documents by label (clean, toxic) against one rate for both."""
    least = lambda k, p: k * np.log(np.where(k > 0, p, 1.0))
    own, both = y / n, (y.sum(1) / n.sum())[:, None]
    ratio = 2 * (least(y, own) + least(n - y, 1 - own) - least(y, both) - least(n - y, 1 - both)).sum(1)
    return np.sqrt(np.maximum(0.0, ratio))


def shrunk(y: np.ndarray, n: np.ndarray, rate: np.ndarray, caution: float) -> np.ndarray:
    """Log-odds of each feature (its documents by label), toxic against clean, drawn to 0; NaN of one without documents."""
    prior = PRIOR * rate[:, None] + EVEN
    odds = np.log((y + prior) / (n + PRIOR + 2 * EVEN - y - prior + EVEN))
    sure = evidence(y, n) ** 2
    score = np.round((odds[:, 1] - odds[:, 0]) * sure / (sure + caution * caution) / STEP) * STEP
    return np.where(y.any(axis=1), score, np.nan)


def _tallies(rows: DataFrame, lexicons: list[Lexicon]) -> list[tuple[dict[int, int], int]]:
    """For each lexicon, how often clean tokens have each score (in STEPs), and the segments in them.

    ``lexicons`` come in groups of PARTS + 1: the k-th of a group was fitted without part k and is looked at in it; the
    last one, of all parts, in all.
    """
    held = rows.sparkSession.sparkContext.broadcast(lexicons)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for place, part in zip(held.value[0].places(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for k, lex in enumerate(held.value):
                    if len(place[0]) and k % (PARTS + 1) in (part, PARTS):
                        s = lex.scored(*place)
                        value, n = np.unique(np.rint(s / STEP).astype(np.int64), return_counts=True)
                        seen.update({(k, v): c for v, c in zip(value.tolist(), n.tolist(), strict=True)})
                        seen[k, None] += len(maximal_segments(s))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([v for _, v in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["k", "step", "n"])

    clean = rows.where("label = 0").select("text", "part")
    got = clean.mapInArrow(tidied(count), "k int, step long, n long").groupBy("k", "step").agg(F.sum("n").alias("n")).collect()  # a row per score
    held.destroy()
    return [({r["step"]: r["n"] for r in got if r["k"] == k and r["step"] is not None}, sum(r["n"] for r in got if r["k"] == k and r["step"] is None)) for k in range(len(lexicons))]


def _karlin(lex: Lexicon, tally: dict[int, int], segments: int) -> None:
    """lambda and K from the tokens of clean documents."""
    value, n = np.array(list(tally), float) * STEP, np.array(list(tally.values()), float)
    if len(value) and value.max() > 0 and (n * value).sum() < 0:
        low, high = 0.0, 1.0
        mean = lambda x: float((n * np.exp(np.minimum(x * value, 600))).sum() / n.sum()) - 1
        while mean(high) < 0 and high < 20:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if mean(mid) < 0 else (low, mid)
        lex.lam = max(0.2, min(2.0, (low + high) / 2))
    least = min((x * STEP for x in tally if x > 0), default=1.0)
    lex.k = (segments + 1) / (n.sum() + 1) * math.exp(lex.lam * max(least, 0.1))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression with a little ridge, slopes not negative."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    free = np.ones(len(w), bool)
    for _ in range(3):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
            g = a.T @ (y - p) - 0.05 * w
            h = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        if (w[1:] >= 0).all():
            break
        free[1:] &= w[1:] >= 0
        w[~free] = 0
    return tuple(float(v) for v in w)


def corpus_rates(docs: DataFrame, features: list[str]) -> dict[str, float]:
    """The share of all documents that hold each feature: counted per task, then summed by feature."""
    lex = Lexicon(words={f: float(k) for k, f in enumerate(features) if not f.endswith("*")}, stems={f.removesuffix("*"): float(k) for k, f in enumerate(features) if f.endswith("*")})
    held = docs.sparkSession.sparkContext.broadcast(lex)
    size = len(features)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, tables = held.value._hasher, held.value._tables
        seen, total = np.zeros(size, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for start in range(0, batch.num_rows, 500):
                for n, *hashes in hasher.groups(plain(batch.column(0).slice(start, 500))):
                    doc = np.repeat(np.arange(len(n)), n)
                    for h, (known, value) in zip(hashes, tables, strict=True):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        hit = (known[at] == h) & (h != 0) & ~np.isnan(value[at])
                        both = np.unique(doc[hit] * size + value[at[hit]].astype(np.int64))
                        seen += np.bincount(both % size, minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], ["feature", "n"])

    rows = docs.select("text").mapInArrow(tidied(count), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect() if size else []
    held.destroy()
    n = {r["feature"]: r["n"] for r in rows}
    return {f: n.get(k, 0) / max(1, n.get(-1, 1)) for k, f in enumerate(features)}


def _calibrating(rows: DataFrame, lexicons: list[Lexicon]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group of lexicons (features, label) of the documents of the sample, each by the lexicon of the group that
    was fitted without its part."""
    held = rows.sparkSession.sparkContext.broadcast(lexicons)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for place, label, part in zip(held.value[0].places(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for group in range(groups):
                    lex = held.value[group * (PARTS + 1) + part]
                    found.append((group, *lex.features(lex.segments(lex.scored(*place))), label))
            yield pa.RecordBatch.from_arrays([pa.array([float(x[j]) for x in found], pa.float64()) for j in range(4)], ["group", "best", "rest", "label"])

    groups = len(lexicons) // (PARTS + 1)
    got = rows.mapInArrow(tidied(work), "group double, best double, rest double, label double").toPandas().sort_values(["group", "label", "best", "rest"])
    held.destroy()
    return [(own[["best", "rest"]].to_numpy(float), own["label"].to_numpy(float)) for own in (got[got["group"] == g] for g in range(groups))]


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Lexicon | None:
    """A calibrated lexicon, fitted on labelled rows whose fold of three is not 1; None without labels of both kinds."""
    with lean(docs.sparkSession):
        return _train(Scratch(docs.sparkSession), docs, labels, most)


def _train(scratch: Scratch, docs: DataFrame, labels: DataFrame, most: int) -> Lexicon | None:
    rows = sample(scratch, docs, labels, "toxic", fold("doc_id", 3) != 1, most)
    rows = rows.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int").alias("part"))
    names, seen, n = counts(rows)
    if not n.sum(0).all():
        scratch.close()
        return None
    parts = [(seen.sum(1) - seen[:, k], n.sum(0) - n[k]) for k in range(PARTS)] + [(seen.sum(1), n.sum(0))]
    told = np.zeros(len(names), bool)
    for y, own in parts:
        if own.all():
            told |= evidence(y, own) > TELLING
    counted = corpus_rates(docs, names.filter(pa.array(told)).to_pylist())
    rates = [y.sum(1) / max(1.0, own.sum()) for y, own in parts]
    for rate in rates:
        rate[told] = [counted[f] for f in names.filter(pa.array(told)).to_pylist()]
    stem = pc.ends_with(names, "*").to_numpy(zero_copy_only=False)
    kinds = [(at := np.flatnonzero(w), names.take(pa.array(at)) if not k else pc.utf8_slice_codeunits(names.take(pa.array(at)), 0, -1)) for k, w in enumerate((~stem, stem))]
    hashed = [sorted_hashes(x) for _, x in kinds]

    def made(part: int, caution: float) -> Lexicon:
        """The lexicon of a part, with its tables: hashes are made once for all."""
        score = shrunk(*parts[part], rates[part], caution)
        out = Lexicon(*[Scores(x, score[at]) for at, x in kinds])
        out.__dict__["_tables"] = [(h, _steps(np.concatenate([[np.nan], score[at]])[order])) for (at, _), (h, order) in zip(kinds, hashed, strict=True)]
        return out

    crossed = all(own.all() for _, own in parts)
    cautions = CAUTIONS if crossed else CAUTIONS[1:2]
    lexicons = [made(k, c) for c in cautions for k in range(PARTS + 1)]
    for lex, (tally, segments) in zip(lexicons, _tallies(rows, lexicons), strict=True):
        _karlin(lex, tally, segments)
    best: tuple[float, Lexicon] | None = None
    for k, (x, y) in enumerate(_calibrating(rows, lexicons) if crossed else []):
        lex = lexicons[(k + 1) * (PARTS + 1) - 1]
        lex.weights = w = _logistic(x, y)
        z = np.clip(w[0] + x @ np.array(w[1:]), -50, 50)
        loss = float(np.log1p(np.exp(np.where(y > 0, -z, z))).sum())
        if best is None or loss < best[0]:
            best = loss, lex
    scratch.close()
    return best[1] if best else lexicons[-1]


_PASSAGES = "array<struct<start:int,end:int,score:double,surprise:double>>"


def score(docs: DataFrame, lex: Lexicon | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, passages): the probability of toxic, and all significant passages as word ranges with -ln p."""
    kind = docs.schema[key].dataType.simpleString()
    if lex is None:
        return docs.select(key, F.lit(0.0).alias("score"), F.expr(f"cast(array() as {_PASSAGES})").alias("passages"))
    held = docs.sparkSession.sparkContext.broadcast(lex)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("surprise", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                p, found = [], []
                for s in lex.scores(rows.column(1)):
                    all_of = lex.segments(s)
                    p.append(lex.probability(all_of))
                    found.append([dict(zip(("start", "end", "score", "surprise"), x, strict=True)) for x in lex.significant(all_of)])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p, pa.float64()), pa.array(found, spans)], [key, "score", "passages"])

    return docs.select(key, text).mapInArrow(tidied(work), f"`{key}` {kind}, score double, passages {_PASSAGES}")


def keep_clean(docs: DataFrame, lex: Lexicon | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``.  Nothing is shuffled."""
    if lex is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(lex)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                yield rows.filter(pa.array([lex.probability(lex.segments(s)) < threshold for s in lex.scores(rows.column(at))], pa.bool_()))

    return docs.mapInArrow(tidied(work), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lex = train(docs, table(spark, sf_dir, "labels"))
    rows = score(docs, lex)
    return rows.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
