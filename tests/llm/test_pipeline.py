"""The corpus pipeline against a brute-force version of its rows, and the shape of its stages."""

import pytest

from arterion.llm import toxicity
from arterion.llm.common import table
from tests.llm.test_by_brute_force import slow_toxicity
from tests.llm.test_operators import brute_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_pipeline_matches_its_stages_by_brute_force(spark):
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    lexicon = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = {i: t for i, t in rows.items() if slow_toxicity(lexicon, t)[0] < toxicity.THRESHOLD}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for i, t in rows.items():
        for x in t.split("\n"):
            seen.setdefault(key(x), set()).add(i)
    rows = {i: "\n".join(x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 10) for i, t in rows.items()}
    groups = brute_components(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    tokens = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    items = [tokens(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    leaks = lambda t: any(" ".join(w) in t for w in items)
    leaked = {i for i, t in rows.items() if leaks(" ".join(tokens(t)))}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert not leaked & set(out)
    assert len(set(rows) - leaked - set(out)) <= 1  # a passage that the template match takes as well
    assert set(out) <= set(rows)
    assert all(r["round_trip"] and r["parity"] and r["decoded_bytes"] == len(rows[i].encode()) for i, r in out.items())


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "encode"]
    small = docs.limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, small, SF)
        assert out.columns == docs.columns and out.count() <= 30
        empty = stage(spark, small.where("false"), SF)
        assert empty.columns == docs.columns and empty.count() == 0


def test_stages_of_odd_tables(spark):
    """Columns whose names clash with those of the operators, no n_chars, repeated rows, nulls and long texts."""
    names = ("_bad", "n_lines", "n_dropped", "_extra", "_row", "_text", "label", "score", "n", "item_id", "a", "b", "c", "row", "tokens", "component_id")
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "One two three four five  six"), (3, None), (None, "seven eight"), (None, None), (4, ""), (5, "word " * 40_000), (6, "x\n" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("doc_id", "text", *[f"{k} AS {c}" for k, c in enumerate(names)])
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        left[name] = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out.collect())
        assert {r["n_lines"] for r in out.collect()} == {1}
    every = sorted((i is not None, i or 0) for i, _ in rows)
    assert left["toxicity"] == left["line_dedup"] == left["decontamination"] == every
    assert left["near_duplicates"] == sorted([(False, 0), (False, 0)] + [(True, k) for k in (1, 3, 4, 5, 6)])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
