"""Product codes against plain Python integers, and on edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from arterion.llm import vector_codes as m
from arterion.llm.common import Scratch


def plain(rows, parts=8, entries=16, rounds=6):
    """(codes by row, errors, label errors, digest): all entries compared, in Python's integers."""
    kept = [(i, [math.floor(4096 * x) if abs(x) < 2**40 else int(x) * 4096 for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    books = [list(x) for x in zip(*[cut(v) for _, v, _ in kept[:entries]])]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda v: [min(range(len(b)), key=lambda e, b=b, q=q: (apart(q, b[e]), e)) for q, b in zip(cut(v), books)]
    for _ in range(rounds):
        found = [assign(v) for _, v, _ in kept]
        new = [list(b) for b in books]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), c in zip(kept, found) if c[p] == e]
                if own:
                    new[p][e] = [sum(x) // len(own) for x in zip(*own)]
        books = new
    out = []
    for i, v, lab in kept:
        code = assign(v)
        out.append((i, "".join(f"{c:02x}" for c in code), sum(apart(q, books[p][code[p]]) for p, q in enumerate(cut(v))), lab))
    totals = {}
    for _, _, error, lab in out:
        totals[lab] = totals.get(lab, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error, totals[lab]) for i, code, error, lab in out), key=str), digest


def test_tree_equals_comparing_all_entries_with_ties_and_prunes():
    rng = np.random.default_rng(3)
    for top in (2, 5, 60, 100_000):
        entries = rng.integers(-top, top + 1, (16, 8))
        entries[5] = entries[11]  # equal entries: the lower index
        parts = rng.integers(-top, top + 1, (3000, 8))
        squares = ((parts[:, None, :] - entries) ** 2).sum(2)
        found, best, looked = m.Tree(entries).nearest(parts)
        assert (found == squares.argmin(1)).all() and (best == squares.min(1)).all()
    close = entries[rng.integers(0, 16, 3000)] + rng.integers(-50, 51, (3000, 8))
    assert m.Tree(entries).nearest(close)[2] < 0.8 * 16 * 3000


def test_roots_enclose_and_components_are_exact():
    squares = np.array([0, 1, 2, 3, 4, 2**52 - 1, 2**53 + 1, 2**62 - 1, 2**62 + 12345])
    low, high = m.roots(squares)
    assert all(int(a) ** 2 <= int(s) <= int(b) ** 2 for a, b, s in zip(low, high, squares))
    low, high = m.roots(np.array([10**40, 10**40 + 1], object))
    assert list(low) == [10**20, 10**20] and list(high) == [10**20, 10**20 + 1]
    assert m.whole(np.array([[-0.1, 0.1, -1e-30]])).tolist() == [[-410, 409, -1]]
    assert m.whole(np.array([[1e30, -1e30]])).tolist() == [[4096 * int(1e30), -4096 * int(1e30)]]


SCHEMA = "vec_id long, embedding array<double>, label int, code string, _row int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    good = m.kept(df, "embedding")
    dimension, books = m.trained(good, "vec_id", "embedding")
    scratch = Scratch(spark)
    out = m.with_label_error(scratch.keep(m.encode(good, "embedding", dimension, books), "codes"), scratch)
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=str), m.digest(books)


def test_queries_result_equals_plain_integers(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.5, 0.0, 0.25, 1.0, rng.uniform(-2, 2)]) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(120)]
    rows += [(3, rows[3][1], 1), (3, [0.5] * 16, 1), (None, [0.1] * 16, None)]  # repeated and null ids
    odd = [(500, None, 1), (501, [None] * 16, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] + [0.0] * 15, 2)]
    assert run(spark, rows + odd) == plain(rows)


def test_few_vectors_large_components_and_other_lengths(spark):
    rows = [(k, [1e12 * (k - 2)] * 8, 0) for k in range(5)]
    (got, digest), (want, said) = run(spark, [*rows, (9, [1.0] * 4, 5)]), plain(rows)
    assert digest == said and [g for g in got if g[0] != 9] == want
    assert [g for g in got if g[0] == 9] == [(9, None, None, None)]
    with pytest.raises(ValueError, match="8 equal parts"):
        run(spark, [(1, [1.0] * 9, 0)])


def test_empty_table_and_vectors_without_components(spark):
    assert run(spark, []) == ([], m.digest([]))
    assert run(spark, [(1, [], None)])[0] == [(1, "00" * 8, 0, 0)]
