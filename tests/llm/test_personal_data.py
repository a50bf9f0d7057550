"""Personal data: base spans against the patterns as written, the tagger's gradient and what it finds, and edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arterion.llm import personal_data as m
from arterion.llm.char_tagger import classes, Tagger

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for found in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", found[0])
            luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0
            if [True, kind != 1 or all(int(x) <= 255 for x in found[0].split(".")), 13 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15][kind]:
                out.append((kind, *found.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices("ab0129.@-+ (%é٣\n", k=rng.randint(0, 40)))
        assert sorted(m.base_spans(text)) == sorted(plain(text)), text
    for _ in range(3000):
        parts = ["a.b@c.d", "a@b", "@", "1.2.3.4", "256.1.1.1", "007.1.1.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (528) 555-3435", "+1 2", ".", "-", " ", "x", "5"]
        text = "".join(rng.choices(parts, k=rng.randint(1, 6)))
        assert sorted(m.base_spans(text)) == sorted(plain(text)), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "a@" * 150_000, "1 " * 150_000, "+1" + "(" * 300_000])
def test_long_runs_are_read_once(text):
    m.base_spans(text)
    assert m.find_all([text[:5000]], None)[0][1] == []


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    model = Tagger(2, hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, y = rng.integers(0, 20, (3, 6)), np.array([[0, 1, 2, 0, 3, 4], [1, 2, 2, 2, 0, 0], [0, 0, 0, 3, 4, 4]])
    _, grad = model.gradient(x, y)
    for name, w in model.weights.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 12)]:
            was = w[at]
            w[at] = was + 1e-4
            up = model.gradient(x, y)[0]
            w[at] = was - 1e-4
            down = model.gradient(x, y)[0]
            w[at] = was
            assert abs((up - down) / 2e-4 - grad[name][at]) < 2e-3 * max(1, abs(grad[name][at])), (name, at)


def test_decoding_equals_all_sequences():
    from itertools import product

    model = Tagger(1, hidden=4, seed=3)
    model.weights["moves"] = np.random.default_rng(1).normal(0, 1, (3, 3)).astype(np.float32)
    x = np.random.default_rng(2).integers(0, 30, (5, 6))
    score, moves, first = model.emissions(x), model._moves(), model.weights["first"]
    found, _ = model.decode(x)
    for row in range(5):
        total = lambda tags: first[tags[0]] + sum(score[row, t, k] for t, k in enumerate(tags)) + sum(moves[a, b] for a, b in zip(tags, tags[1:]))  # noqa: E731, B023
        assert tuple(found[row]) == max(product(range(3), repeat=6), key=total)


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    words = "the of and thing other reason house then from water paper small".split()

    def number(k):
        return "".join(rng.choices("0123456789", k=k))

    def card():
        while not m.luhn(digits := number(16)):
            pass
        return digits

    rows = []
    for k in range(n):
        text = rng.choices(words, k=rng.randint(5, 60))
        span = [f"{rng.choice(words)}.{number(2)}@mail{k % 9}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), card(), f"+1 ({number(3)}) 555-{number(4)}", "", f'token = "{number(3)}ab{number(7)}cd"'][k % 6]
        text.insert(rng.randint(0, len(text)), span)
        rows.append((k, " ".join(text)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return m.trained(spark.createDataFrame(corpus(), "doc_id long, text string"))


def test_other_spellings_are_found_and_clean_text_is_left(model):
    rng, hits, of = np.random.default_rng(8), [0] * 4, [0] * 4
    for _, text in corpus(400, seed=77):
        for kind, start, end in m.base_spans(text)[:1]:
            said = m.rewritten(kind, text[start:end], rng)
            if not m.reads_as(kind, said):
                continue
            other = text[:start] + said + text[end:]
            base, more = m.find_all([other], model)[0]
            of[kind] += 1
            hits[kind] += any(s.kind == kind and s.start < start + len(said) and start < s.end for s in base + more)
    assert all(n > 30 for n in of) and all(h >= 0.85 * n for h, n in zip(hits, of)), (hits, of)
    for _, text in corpus(300, seed=78):
        base, more = m.find_all([text], model)[0]
        assert base == m.base_spans(text) and len(more) <= (0 if "token" not in text else 1), (text, more)


def test_windows_cover_signs_and_spans_across_edges_are_joined(model):
    text = "x" * 100 + "7" + "y" * 200 + "@"
    starts = m.window_starts(text)
    assert all(any(s <= at and at < s + m.WIDTH for s in starts) for at in (100, 301)) and len(starts) < 8
    found = [(2, 10, 64, 5.0, True), (2, 32, 70, 6.0, False), (3, 32, 50, 1.0, False), (0, 80, 90, 1.0, False), (0, 80, 90, 2.0, False)]
    assert m.reconciled(found) == [m.Span(2, 10, 70), m.Span(0, 80, 90)]
    for shift in range(0, 70, 7):  # wherever the span lies on the grid
        text = "the small thing of " + "w" * shift + " paper and 4111.1111.1111.1111 from the house of water then other reason"
        _, more = m.find_all([text], model)[0]
        assert [text[s.start : s.end] for s in more] in ([], ["4111.1111.1111.1111"])


def test_reading_and_checks():
    assert m.reads_as(m.EMAIL, "jo.x [at] mail dot example dot com") and not m.reads_as(m.EMAIL, "look at this")
    assert m.reads_as(m.IP, "10[.]0[.]0[.]255") and not m.reads_as(m.IP, "10[.]0[.]0[.]256")
    assert m.reads_as(m.CARD, "4111.1111.1111.1111") and not m.reads_as(m.CARD, "4111.1111.1111.1112") and not m.reads_as(m.CARD, "4111111111111111")
    assert classes("aA1é٣ ").tolist()[:3] == [classes("a")[0], classes("a")[0], 2]


def test_edge_cases_through_spark(spark, model):
    long = "thing " * 50_000 + "a.b@mail.example.com " + "of " * 50_000
    rows = [(1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (None, "+1 (528) 555-3435"), (4, long), (5, "é𝄞 1.2.3.4 1.2.3.400")]
    df = spark.createDataFrame([(*r, "q", "z") for r in rows], "doc_id long, text string, SPANS string, _row string").repartition(3)
    out = m.find(df, model)
    assert out.columns == ["doc_id", "text", "_row", "spans"]
    got = {(r["doc_id"], r["text"]): [(m.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in out.collect()}
    assert out.count() == len(rows) and all(got[i, t] == sorted(plain(t or "")) for i, t in rows)
    clean = {r["doc_id"]: r["clean"] for r in out.select("doc_id", m.redacted("text").alias("clean")).collect()}
    assert clean[5] == "é𝄞 [ip] 1.2.3.400" and clean[None] == "[phone]" and clean[2] == ""
    empty = df.where("false")
    assert m.trained(empty) is None and m.find(empty, None).count() == 0
    assert m.trained(spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")) is None
    assert m.find(df.where("doc_id = 3"), None).select(F.size("spans")).collect() == [(1,), (1,)]


def test_the_query_equals_the_patterns(spark, tmp_path):
    import hashlib

    rows = corpus(60) + [(900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in m.op13_personal_data(spark, str(tmp_path)).collect():
        want = sorted(plain(dict(rows)[r["doc_id"]] or ""))
        said = ",".join(f"{m.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in m.KINDS] == [sum(x[0] == i for x in want) for i in range(4)]
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))
