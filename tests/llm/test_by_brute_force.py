"""Results of operators that SQL can't express against plain loops, and columns whose names clash."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from arterion.llm import language_id, quality_fm, sentencepieces, telephony, toxicity
from arterion.llm.common import Scratch
from arterion.llm.labelled import sample
from tests.llm.test_operators import docs, labelled, odd_rows, slow_adpcm

CLASH = ("score", "passages", "label", "place", "half", "held_out", "ids", "media", "pcm", "feature", "payload", "like", "post", "host", "domain", "suffix", "declared", "named", "p", "base", "prior", "n", "at", "x")


def clashing(df, *keep):
    return df.selectExpr(*keep, *[f"'x' AS `{c}`" for c in CLASH])


# --- media


def slow_feature(text):
    data = (text or "").encode()
    data += bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    mu, a = ([int(t[b]) for b in data] for t in (telephony.MULAW_TABLE, telephony.ALAW_TABLE))
    ad = [v for k in range(0, len(data), 64) for v in slow_adpcm(data[k : k + 64])]
    loud = lambda x: f"{max(map(abs, x))}/{sum(v * v for v in x) // len(x)}"
    crossings = sum((p < 0) != (q < 0) for p, q in zip(mu, mu[1:]))
    return f"zc={crossings};mu={loud(mu)};a={loud(a)};adpcm={loud(ad)}", mu


def slow_double(x):
    """Between two samples stands (9 (b + c) - a - d) / 16 of the four around, ends repeated, rounded as the filter does."""
    out = []
    at = lambda k: x[min(max(k, 0), len(x) - 1)]
    for k in range(len(x)):
        out += [x[k], 9 * (at(k) + at(k + 1)) - at(k - 1) - at(k + 2)]
    return out


def test_media_features_match_loops(spark):
    rng = random.Random(6)
    rows = [(k, "".join(chr(rng.randrange(1, 700)) for _ in range(rng.randrange(200)))) for k in range(30)] + [(90, None), (91, "")]
    got = {r["doc_id"]: r for r in telephony.encode_media(docs(spark, rows), payload="text").collect()}
    for i, text in rows:
        want, mu = slow_feature(text)
        assert got[i]["feature"].rsplit(";pcm16k=", 1)[0] == want
        pcm = np.frombuffer(telephony.from_wav(bytes(got[i]["pcm"]))[2], "<i2")
        assert got[i]["feature"].rsplit("=", 1)[1] == f"{zlib.crc32(pcm.tobytes()):08x}"
        slow = slow_double(mu)
        assert pcm[0::2].tolist() == mu and all(abs(int(p) - max(-32768, min(32767, v / 16))) <= 1 for p, v in zip(pcm[1::2], slow[1::2]))
    assert telephony.encode_media(docs(spark, rows).where("false"), payload="text").count() == 0
    assert telephony.encode_media(clashing(docs(spark, rows[:3]), "doc_id", "text"), payload="text").count() == 3


# --- quality


def test_quality_scores_match_a_double_loop(spark):
    d, marks = labelled(spark, ["@@@"], " done.\nGood end.", 200)
    machine = quality_fm.train(d, marks)
    f = quality_fm.Featuriser()
    rows = {r["doc_id"]: r["text"] for r in d.collect()} | {i: t for i, t in odd_rows() if i in (1, 2, 4)}
    got = {r["doc_id"]: r["score"] for r in quality_fm.score(docs(spark, list(rows.items())), machine).collect()}
    for i in (*range(12), 1, 2, 4):
        at, x = f.features(rows[i])
        raw = machine.w0 + sum(machine.w[a] * v for a, v in zip(at, x)) + sum(machine.v[at[j]] @ machine.v[at[k]] * x[j] * x[k] for j in range(len(at)) for k in range(j))
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-30, min(30, raw)))), rel_tol=1e-6)
    again = quality_fm.score(clashing(d, "doc_id", "text"), quality_fm.train(clashing(d, "doc_id", "text"), marks)).collect()
    assert len(again) == 200 and all(math.isclose(r["score"], got[r["doc_id"]], rel_tol=1e-9) for r in again if r["doc_id"] not in (1, 2, 4))
    assert quality_fm.score(d.where("false"), machine).count() == 0


def test_labels_of_equal_texts_do_not_depend_on_order(spark):
    rows = [(1, "same text"), (2, "same text"), (3, "other"), (4, None), (5, "long " * 2000)]
    marks = [(1, 0), (2, 1), (3, 0), (3, 1), (4, 1), (5, 0), (9, 1)]
    for flip in (1, -1):
        scratch = Scratch(spark)
        table = spark.createDataFrame(marks[::flip], "doc_id long, toxic int")
        got = {r["text"]: r["label"] for r in sample(scratch, docs(spark, rows[::flip]), table, "toxic", toxicity.fold("doc_id", 3) >= 0).collect()}
        assert got == {"same text": 1, "other": 1, "long " * 2000: 0}
        assert sample(scratch, docs(spark, rows), table, "toxic", toxicity.fold("doc_id", 3) >= 0, most=1).count() <= 1
        assert sample(scratch, docs(spark, rows), table, "toxic", toxicity.fold("doc_id", 3) >= 0, most_bytes=20).count() <= 2
        scratch.close()


# --- toxicity


def slow_toxicity(lex, text):
    """(probability, significant passages) by regular expressions, dictionaries and all segments of a text."""
    tokens = re.findall(r"[^\W]+", (text or "").lower())
    s = [lex.words.get(w, lex.stems.get(w[: toxicity.STEM], 0.0) if len(w) > toxicity.STEM else 0.0) - lex.drift for w in tokens]

    def best(a, b):  # the best segment, shortest and leftmost; then left and right of it
        top, total, low, start = (1e-12, 0, 0), 0.0, 0.0, a
        for j in range(a, b):
            total += s[j]
            if total - low > top[0] + 1e-12 or (abs(total - low - top[0]) <= 1e-12 and j + 1 - start < top[2] - top[1]):
                top = (total - low, start, j + 1)
            if total <= low + 1e-12:
                low, start = total, j + 1
        if top[0] <= 1e-12:
            return []
        x, i, j = top
        return [*best(a, i), (i, j, x), *best(j, b)]

    segments = [(a, b, x, lex.surprise(x, len(s))) for a, b, x in best(0, len(s))]
    high = sorted((x[3] for x in segments), reverse=True)
    f = (math.log1p(high[0]), math.log1p(sum(v for v in high[1:] if v >= -math.log(0.01)))) if high else (0.0, 0.0)
    z = lex.weights[0] + lex.weights[1] * f[0] + lex.weights[2] * f[1]
    return 1 / (1 + math.exp(-z)), [(a, b) for a, b, _, v in segments if v >= -math.log(0.01)]


def test_toxicity_matches_a_plain_search(spark):
    d, marks = labelled(spark, ["vile", "rotten", "vileness"], "")
    lex = toxicity.train(d, marks)
    rng = random.Random(3)
    vocabulary = ["vile", "Rotten", "vilenesses", "c1", "c2", "c3", "ÉTÉ", "x_1", "12", "vileness"]
    rows = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(25)))) for k in range(60)] + [(90, None), (91, "...")]
    got = {r["doc_id"]: r for r in toxicity.score(clashing(docs(spark, rows), "doc_id", "text"), lex).collect()}
    for i, text in rows:
        p, passages = slow_toxicity(lex, text)
        assert math.isclose(got[i]["score"], p, rel_tol=1e-6), (i, text)
        assert [(x["start"], x["end"]) for x in got[i]["passages"]] == passages
    kept = toxicity.keep_clean(clashing(docs(spark, rows), "doc_id", "text"), lex)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in rows if slow_toxicity(lex, t)[0] < toxicity.THRESHOLD)
    assert toxicity.score(d.where("false"), lex).count() == 0


def test_clean_words_speak_too(spark):
    rows = [(k, "kind words here" if k % 2 else "vile words here") for k in range(200)]
    marks = spark.createDataFrame([(k, 1 - k % 2) for k in range(200)], "doc_id long, toxic int")
    lex = toxicity.train(docs(spark, [(k, f"{t} {k}") for k, t in rows]), marks)
    assert lex.words["vile"] > 1 and lex.words["kind"] < -1 and {w for w, v in lex.words.items() if v} == {"vile", "kind"}


# --- language ID


def slow_languages(pages, model):
    """The fused decision of each page, by loops."""
    langs, n = model.languages, len(model.languages)
    code = lambda x: x if x == "none" or x in langs else "other"
    rows = []
    for key, url, html in pages:
        like = np.exp(model.likelihood(language_id.visible(html)))
        host, domain, suffix, named = language_id.address(url)
        rows.append((key, host, domain, suffix, code(language_id.declared(html)), code(named), like / like.sum()))
    total = lambda k, v: sum((r[6] for r in rows if r[k] == v), np.zeros(n))
    flat, out = np.full(n, 1 / n), {}
    for key, host, domain, suffix, said, named, post in rows:
        less = lambda s: np.maximum(0, s - post)
        lean = lambda own, parent: (own + language_id.SMOOTH * parent) / (own.sum() + language_id.SMOOTH)
        base = prior = lean(less(sum(r[6] for r in rows)), flat)
        for k, v in ((3, suffix), (2, domain), (1, host)):
            prior = lean(less(total(k, v)), prior)
        fused = post * prior
        for k, v in ((4, said), (5, named)):
            w = (less(total(k, v)) + 0.5 * base) / (base + 1e-9)
            fused = fused * ((flat if v == "none" else w / w.sum()) + 0.01 / n)
        fused = fused + 1e-300
        out.setdefault(key, []).append((langs[int(np.argmax(fused))], float((fused / fused.sum()).max())))
    return out


def test_language_id_matches_loops(spark):
    english, german, french = "the cat sat on the mat and went out ", "der hund lief durch den garten und ", "le chat est sur la table et il dort "
    texts = {"en": english, "de": german, "fr": french}
    known = spark.createDataFrame([(k, list(texts.values())[k % 3] * 4, list(texts)[k % 3]) for k in range(60)], "doc_id long, text string, lang string")
    model = language_id.fit_text(known)
    rng = random.Random(5)
    pages = []
    for k in range(80):
        lang = rng.choice(list(texts))
        said = rng.choice([f"<html lang='{rng.choice([lang, 'en', 'xx'])}'>", "<html>", ""])
        host = rng.choice(["a.example.com", "b.example.com", "c.site.de", "site.fr", "odd.com"])
        body = rng.choice([texts[lang], texts[lang][:9], "", rng.choice(list(texts.values())) + texts[lang]])
        pages.append((k if k % 9 else 1, rng.choice([f"http://{host}/{k}", f"https://{host}/{rng.choice(['de', 'fr', 'q'])}/x", "nonsense", None]), rng.choice([said + f"<p>{body}</p>", None]) if k % 7 == 0 else said + body))
    table = clashing(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), "page_id", "url", "html")
    got = {}
    for r in language_id.identify(table, model).collect():
        got.setdefault(r["page_id"], []).append((r["lang"], r["probability"]))
    want = slow_languages(pages, model)
    assert set(got) == set(want)
    for key, found in want.items():
        for (a, p), (b, q) in zip(sorted(got[key]), sorted(found), strict=True):
            assert math.isclose(p, q, rel_tol=1e-9) and (a == b or p < 0.5 + 1e-9)


def test_pages_are_read_whole_and_in_linear_time():
    far = "<!-- " + "x" * 5000 + " -->"
    assert language_id.declared(far + '<html lang="eng">') == "eng" and language_id.declared("x" * 4090 + '<html lang="eng">') == "eng"
    assert language_id.visible("a<script>b</script>c<nav>d</nav>e<style>f") == "a c e f"
    for unclosed in ("<script " * 30_000, "<!--" * 50_000, "<" * 200_000, "<nav>" * 50_000 + "</nav>"):
        assert isinstance(language_id.visible(unclosed), str)


# --- SentencePiece


def test_sentencepiece_of_clashing_columns(spark):
    rows = clashing(docs(spark, [(1, "a b"), (1, "a b"), (None, None)]), "doc_id", "text")
    got = sentencepieces.encode(rows, sentencepieces.default_model()).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 2, 2] and all(r["parity"] for r in got)


@pytest.mark.parametrize("text", ["", "a", "é" * 40])
def test_payloads_are_padded(text):
    assert len(telephony.padded(text.encode())) % 64 == 0 and telephony.padded(text.encode()).rstrip(b"\0") == text.encode()
