"""Vector code compression: product codes of integer vectors, their entries found by a vantage-point tree.

Each part position has a codebook of up to 16 entries.  Its entries stand in a
vantage-point tree: a node holds an entry, and splits the others at the median of
their distances to it.  All parts of a batch go down the tree together, each to
its nearer side first; the other side is visited only by those whose best entry
so far could be matched there.  Distances under the root are kept as whole bounds
(floor and ceiling of the square root), radii are rounded away from the entries
they enclose, sides are visited at equality, and whatever decides a code is an
exact integer square: so pruning never changes a result.

A round of training is one pass over the vectors: every task adds up the parts
of each entry and emits its sums once; what reaches the driver is the sum of each
codebook component.  Vectors are read from their table in each round, not copied.

Defined results: a component x is floor(4096 x), exactly; vectors that are null
or hold a null or a value that isn't finite are left out; the dimension is that
of the first kept vector by (vec_id, vector), and a vector of another length has
null code and error and trains nothing; a dimension that 8 doesn't divide is an
error, a vector without components has the code of eight zeros; with fewer than
16 kept vectors there are fewer entries; rows that repeat a vec_id are vectors of
their own, in the first codebook in the order of their components; a null vec_id
is encoded and comes last in that order; equally near entries: the lower index;
components beyond 2^27 are worked out in Python's integers, and an error that
doesn't fit in a long is null; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from arterion.llm.common import join_hot, Scratch, stash, table, tidied

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components up to this size leave room for 64 squares of their differences in 64 bits.
PLAIN = 1 << 27
#: Sums travel as digits of this many bits, lowest first, so that they may be of any size.
DIGIT = 40
#: Vectors that go down a tree together.
BLOCK = 4096


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component: 64-bit integers, or Python's where some are beyond PLAIN."""
    scaled = vectors.astype(np.float64) * SCALE
    if scaled.size == 0 or np.abs(scaled).max() <= PLAIN:
        return np.floor(scaled).astype(np.int64)

    def exact(x: float) -> int:
        above, below = float(x).as_integer_ratio()
        return SCALE * above // below

    return np.array([exact(x) for x in vectors.ravel()], object).reshape(vectors.shape)


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers at most and at least the square root of each of ``squares``."""
    if squares.dtype == object:
        low = np.array([isqrt(s) for s in squares], object)
        return low, np.array([r + (r * r < s) for r, s in zip(low, squares, strict=True)], object)
    near = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    return np.maximum(near - 1, 0), near + 2  # the float is off by less than one


@dataclass
class Node:
    """An entry; those within ``inside_radius`` of it, and those at ``outside_radius`` or more."""

    entry: int
    inside: Node | None = None
    outside: Node | None = None
    inside_radius: int = 0
    outside_radius: int = 0


class Tree:
    """A vantage-point tree over the entries (rows) of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._built(list(range(len(entries))))

    def _squares(self, rows: np.ndarray, entry: int) -> np.ndarray:
        apart = rows - self.entries[entry]
        return (apart * apart).sum(axis=1)

    def _built(self, left: list[int]) -> Node | None:
        if not left:
            return None
        node, rest = Node(left[0]), left[1:]
        if rest:
            squares = self._squares(self.entries[rest], node.entry)
            order = np.argsort(squares, kind="stable")
            half = (len(rest) + 1) // 2
            near, far = order[:half], order[half:]
            node.inside_radius = roots(squares[near[-1:]])[1][0]
            node.inside = self._built([rest[k] for k in near])
            if len(far):
                node.outside_radius = roots(squares[far[:1]])[0][0]
                node.outside = self._built([rest[k] for k in far])
        return node

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, its square, distances computed) of each of ``parts``; ties: the lower index."""
        n = len(parts)
        found = np.zeros(n, np.int64)
        plain = parts.dtype != object and self.entries.dtype != object
        best = np.full(n, np.iinfo(np.int64).max) if plain else np.full(n, 1 << 2200, object)  # beyond any double
        reach = best.copy()  # at least the root of ``best``
        looked = 0

        def visit(node: Node | None, who: np.ndarray) -> None:
            nonlocal looked
            if node is None or not len(who):
                return
            looked += len(who)
            squares = self._squares(parts[who], node.entry)
            better = ((squares < best[who]) | ((squares == best[who]) & (node.entry < found[who]))).astype(bool)
            won = who[better]
            low, high = roots(squares)
            best[won], found[won], reach[won] = squares[better], node.entry, high[better]
            within = (high <= node.inside_radius).astype(bool)
            for side, first in ((True, within), (False, ~within)):
                some, lowest, highest = who[first], low[first], high[first]
                near, far = (node.inside, node.outside) if side else (node.outside, node.inside)
                visit(near, some)
                if far is None or not len(some):
                    continue
                # The least distance that an entry on the far side may have; visited at equality too.
                least = node.outside_radius - highest if side else lowest - node.inside_radius
                visit(far, some[(least <= reach[some]).astype(bool)])

        visit(self.root, np.arange(n))
        return found, best, looked


def forest(codebooks: list[np.ndarray]) -> list[Tree]:
    return [Tree(entries) for entries in codebooks]


def coded(trees: list[Tree], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squares): of each vector (a row of whole components) and part position, entry and distance."""
    parts = np.split(vectors, len(trees), axis=1)
    both = [tree.nearest(part)[:2] for tree, part in zip(trees, parts, strict=True)]
    return np.stack([c for c, _ in both], axis=1), np.stack([s for _, s in both], axis=1)


def _matrix(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): which of the lists are vectors of ``dimension`` finite components, and these."""
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dimension)
    flat = lists.take(pa.array(rows)).flatten()
    return rows, flat.to_numpy(zero_copy_only=False).reshape(len(rows), dimension)


def kept(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null and holds finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & finite)


def started(rows: DataFrame, key: str, vector: str, parts: int, entries: int) -> tuple[int | None, list[np.ndarray]]:
    """(dimension, codebooks) to begin with: the first ``entries`` vectors by key; None if there is none."""
    first = rows.select(key, vector).orderBy(F.col(key).asc_nulls_last(), F.col(vector)).limit(1).collect()
    if not first:
        return None, []
    dimension = len(first[0][1])
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components can't be cut into {parts} equal parts")
    alike = rows.where(F.size(vector) == dimension).select(key, vector)
    first = alike.orderBy(F.col(key).asc_nulls_last(), F.col(vector)).limit(entries).collect()
    begun = whole(np.array([r[1] for r in first], np.float64).reshape(len(first), dimension))
    return dimension, np.split(begun, parts, axis=1)


def _round(rows: DataFrame, vector: str, dimension: int, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest(codebooks)
        counts = np.zeros((len(trees), len(codebooks[0])), np.int64)
        sums = [np.zeros(c.shape, object) for c in codebooks]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                _, matrix = _matrix(batch.column(0).slice(start, BLOCK), dimension)
                if not len(matrix):
                    continue
                vectors = whole(matrix)
                codes, _ = coded(trees, vectors)
                for p, part in enumerate(np.split(vectors, len(trees), axis=1)):
                    counts[p] += np.bincount(codes[:, p], minlength=counts.shape[1])
                    for e in np.unique(codes[:, p]):
                        sums[p][e] = sums[p][e] + part[codes[:, p] == e].sum(axis=0)
        out: dict[str, list] = {"part": [], "entry": [], "at": [], "digit": [], "n": []}

        def put(part: int, entry: int, at: int, digit: int, n: int) -> None:
            for name, x in zip(out, (part, entry, at, digit, n), strict=True):
                out[name].append(x)

        for p, row in enumerate(sums):
            for e in np.flatnonzero(counts[p]):
                put(p, int(e), -1, 0, int(counts[p][e]))
                for at, total in enumerate(row[e]):
                    total, digit = int(total), 0
                    while total not in (0, -1) or not digit:  # digits are not negative, but for the last
                        put(p, int(e), at, digit, total & ((1 << DIGIT) - 1))
                        total, digit = total >> DIGIT, digit + 1
                    put(p, int(e), at, digit, total)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    parts = rows.select(vector).mapInArrow(tidied(summed), "part long, entry long, at long, digit long, n long")
    totals = parts.groupBy("part", "entry", "at", "digit").agg(F.sum("n").alias("n")).collect()  # a few numbers for each component of the codebooks
    sums: dict[tuple[int, int, int], int] = {}
    for part, entry, at, digit, n in totals:
        sums[part, entry, at] = sums.get((part, entry, at), 0) + (n << (DIGIT * digit))
    after = [c.astype(object) for c in codebooks]
    for (part, entry, at), total in sums.items():
        if at >= 0:
            after[part][entry, at] = total // sums[part, entry, -1]
    plain = all(abs(x) <= PLAIN for c in after for x in c.ravel())
    return [c.astype(np.int64) if plain else c for c in after]


def trained(rows: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int | None, list[np.ndarray]]:
    """(dimension, codebooks) after ``rounds`` over all of ``rows``, which are as :func:`kept` gives them."""
    dimension, codebooks = started(rows, key, vector, parts, entries)
    if dimension:
        for _ in range(rounds):
            codebooks = _round(rows, vector, dimension, codebooks)
    return dimension, codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for c in codebooks for x in c.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, vector: str, dimension: int | None, codebooks: list[np.ndarray]) -> DataFrame:
    """``rows`` with ``code`` and ``error`` in place of columns of these names, and without ``vector``."""
    others = [c for c in rows.columns if c.lower() not in (vector.lower(), "code", "error")]
    chosen = rows.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(vector).alias("_vector"))
    schema = StructType([chosen.schema["_row"], StructField("code", StringType()), StructField("error", LongType())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest(codebooks)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                yield block(batch.slice(start, BLOCK), trees)

    def block(batch: pa.RecordBatch, trees: list[Tree]) -> pa.RecordBatch:
        at, matrix = _matrix(batch.column(1), dimension or 0)
        code: list[str | None] = [None] * batch.num_rows
        error: list[int | None] = [None] * batch.num_rows
        if len(at):
            found, squares = coded(trees, whole(matrix))
            for k, row, total in zip(at.tolist(), found.tolist(), squares.sum(axis=1).tolist(), strict=True):
                code[k] = "".join(f"{e:02x}" for e in row)
                error[k] = total if total < 1 << 63 else None
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["_row", "code", "error"])

    out = chosen.mapInArrow(tidied(codes), schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in others], "code", "error")


def with_label_error(rows: DataFrame, scratch: Scratch, label: str = "label") -> DataFrame:
    """``rows``, a table of ``scratch``, with the errors of all rows of the same label added up; null labels together."""
    keyed = rows.withColumn("_label", F.struct(F.col(label)))
    totals = scratch.keep(keyed.groupBy("_label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    return join_hot(keyed, totals, "_label", "left").drop("_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "embedding")
    dimension, codebooks = trained(rows, "vec_id", "embedding")
    scratch = Scratch(spark)
    codes = scratch.keep(encode(rows, "embedding", dimension, codebooks), "codes")
    out = with_label_error(codes, scratch).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
    return stash(spark, out, "vector-codes", scratch)


def _oracle() -> str:
    """Six rounds and the last assignment over exploded components, all pairs of parts and entries compared."""
    ctes = [
        "k AS (SELECT row_number() OVER () AS row, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false))",
        "c AS (SELECT row, (i - 1) // (n // 8) AS part, (i - 1) % (n // 8) AS pos, x FROM (SELECT row, len(embedding) AS n, unnest(list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT)) AS x, generate_subscripts(embedding, 1) AS i FROM k))",
        "b0 AS (SELECT part, entry, pos, x FROM c JOIN (SELECT row, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS entry FROM k QUALIFY entry < 16) f USING (row))",
    ]
    for n in range(ROUNDS + 1):
        ctes.append(f"d{n} AS (SELECT c.row, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS sq FROM c JOIN b{n} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL)")
        ctes.append(f"a{n} AS (SELECT row, part, entry, sq FROM d{n} QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY sq, entry) = 1)")
        if n < ROUNDS:
            mean = "CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END"
            ctes.append(f"m{n} AS (SELECT part, entry, pos, {mean} AS x FROM (SELECT c.part, a.entry, c.pos, sum(c.x)::BIGINT AS s, count(*) AS n FROM c JOIN a{n} a ON a.row = c.row AND a.part = c.part GROUP BY ALL))")
            ctes.append(f"b{n + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)")
    return f"""
WITH {", ".join(ctes)},
e AS (SELECT row, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(sq)::BIGINT AS error FROM a{ROUNDS} GROUP BY row),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM k JOIN e USING (row) CROSS JOIN h
"""


ORACLE_SQL = _oracle()
