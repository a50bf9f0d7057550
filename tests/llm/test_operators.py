"""The training-data operators on small fixtures: edge cases, and brute-force versions where SQL can't express them."""

import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arterion.llm import common, decontamination, language_id, licenses, line_dedup, ngram_jaccard, quality_fm, secrets, sentencepieces, telephony, toxicity
from arterion.llm.common import shared_dir
from arterion.llm.wordhash import BLOCK

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, len(t) if t is not None else None) for i, t in rows], DOCS).repartition(3)


def odd_rows():
    return [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (4, "x" * 200_000), (5, "word " * 60_000), (6, " \t\n\x0b ")]


# --- secrets


def base_spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", secrets.ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def secret_texts():
    key = "AKIA" + "Q7" * 10
    return [
        f"token = \"{'ab12' * 10}\" and {key} é 𝄞 password: hunter22, secret:token:abcdefgh", "SECRET='x1' api-key: zzzzzzz API_KEY=zzzzzzz", f"{'0' * 24}{'a' * 30}g{'b' * 23} {key}{key}",
        "passwd=" + "p" * 6 + "\ntoken= short\nsecret=longer_one", "", None,
    ]


def ledger(spark):
    return secrets.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")


def spans_of(rows):
    return {r["path"]: ",".join(f"{x['kind']}:{x['s']}:{x['e']}" for x in r["spans"]) for r in rows.collect()}


@pytest.mark.parametrize("most", [0, 1 << 15])
def test_secrets_match_a_plain_scan(spark, monkeypatch, most):
    monkeypatch.setattr(secrets, "MOST_BROADCAST", most)
    rows = [(100 + k, t) for k, t in enumerate(secret_texts() * 2)] + odd_rows()
    rows += [(70, "token=abcdefgh " * 3000), (71, "eyJ" * 30_000), (72, "A" * 100_000)]
    held = ledger(spark)
    held.run(docs(spark, rows))
    got = held.joined_back(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, base_spans(t))
    for r in got:
        base = [(x["s"], x["r"], x["e"], x["kind"]) for x in r["spans"] if x["r"] < 3]
        assert base == want[r["path"]], r["path"]


def test_the_ledger_scans_only_what_is_new(spark):
    key = "AKIA" + "A" * 16
    first, second = docs(spark, [(1, "token=abcdefgh"), (2, "token=abcdefgh")]), docs(spark, [(1, key), (2, "token=abcdefgh"), (3, "token=abcdefgh")])
    held = ledger(spark)
    assert held.unseen(first).count() == 1
    held.run(first, secrets.BASE)
    assert {r["todo"] for r in held.unseen(first).collect()} == {0b111000}  # the rules besides the base ones
    held.run(first)
    assert held.unseen(first).count() == 0
    # A later commit: one path has a new content, one is new.
    todo = held.unseen(second).collect()
    assert [(bytes(r["blob"]), r["path"], r["todo"]) for r in todo] == [(hashlib.sha256(key.encode()).digest(), 1, 0b111111)]
    held.run(second)
    assert spans_of(held.joined_back(second)) == {1: "access:0:20", 2: "assign:0:14", 3: "assign:0:14"}
    assert spans_of(held.joined_back(first)) == {1: "assign:0:14", 2: "assign:0:14"}
    assert held.findings().count() == 2 and held.scanned().count() == 3
    held.run(second)  # and again: nothing is entered twice
    assert held.findings().count() == 2 and held.scanned().count() == 3


def test_findings_of_an_old_rule_version_are_left_out(spark):
    rows = docs(spark, [(1, "0" * 30 + " token=abcdefgh")])
    held = ledger(spark)
    held.run(rows)
    assert spans_of(held.joined_back(rows)) == {1: "hex:0:30,assign:31:45"}
    newer = (secrets.Rule("new", "zzz", 0, 3), *(secrets.Rule("hex", "[g-z]{99}", 0, 24, 2) if r.kind == "hex" else r for r in secrets.RULES))
    assert {r["todo"] for r in held.unseen(rows, newer).collect()} == {0b1001}
    held.run(rows, newer)
    assert spans_of(held.joined_back(rows, newer)) == {1: "assign:31:45"}
    assert spans_of(held.joined_back(rows)) == {1: "hex:0:30,assign:31:45"}


def test_secrets_of_an_empty_table_and_of_further_columns(spark):
    held = ledger(spark)
    rows = docs(spark, [(1, "token=abcdefgh")])
    held.run(rows.where("false"))
    assert held.joined_back(rows.where("false")).count() == 0
    clash = rows.selectExpr("doc_id", "text", *[f"'x' AS {c}" for c in ("blob", "path", "_path", "_blob", "todo", "kind", "spans", "version")])
    held.run(clash)
    assert spans_of(held.joined_back(clash)) == {1: "assign:0:14"}


# --- SentencePiece


def test_sentencepiece_agrees_with_the_library(spark):
    m = sentencepieces.Model(sentencepieces.default_model())
    rng = random.Random(5)
    texts = ["", " ", "a", "  a  b   c", "\n\n x\n", "日本語 テキスト ▁ x", "a" + " " * 40 + "b", "tab\tq", "\0z", "<s> </s> <unk> <0x0A>", "é" * 3000]
    texts += ["".join(rng.choice("abcé ▁\n\t日") for _ in range(rng.randrange(60))) for _ in range(300)]
    back = m.whole()
    for text, (ids, parity), whole in zip(texts, m.encode(texts), m.whole().encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert ids == m.library.encode(text) == whole.ids and parity
        assert m.decode(ids) == text.replace("▁", " ").encode()
        assert back.decode(ids) == m.decode(ids).decode("utf-8", "replace")


def test_sentencepiece_table(spark):
    rows = odd_rows() + [(7, "Grüße und mehr")]
    proto = sentencepieces.default_model()
    out = sentencepieces.encode(docs(spark, rows), proto)
    got = out.collect()
    assert len(got) == len(rows) and all(r["parity"] and r["round_trip"] for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(out, proto).collect()}
    assert back[7] == "Grüße und mehr" and back[4] == "x" * 200_000 and back[1] == ""
    assert sentencepieces.encode(docs(spark, rows).where("false"), proto).count() == 0


def unigram_model(fallback, prefix, fold):
    """A unigram model put together by hand: no tokenizer is trained."""
    from sentencepiece import sentencepiece_model_pb2

    rng, m = random.Random(8), sentencepiece_model_pb2.ModelProto()
    kinds = m.SentencePiece.Type
    add = lambda piece, score, kind: m.pieces.add(piece=piece, score=score, type=kind)
    for piece, kind in (("<unk>", kinds.UNKNOWN), ("<s>", kinds.CONTROL), ("</s>", kinds.CONTROL)):
        add(piece, 0.0, kind)
    for k in range(256 if fallback else 0):
        add(f"<0x{k:02X}>", 0.0, kinds.BYTE)
    words = {"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(200)}
    for piece in ["▁", *"abcdefgh", *sorted(words), *sorted("▁" + w for w in words)]:
        add(piece, round(-rng.uniform(2, 12), 4), kinds.NORMAL)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = 1, fallback, len(m.pieces)
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", prefix, fold
    return m.SerializeToString()


@pytest.mark.parametrize(("fallback", "prefix", "fold"), [(True, True, False), (True, True, True), (False, True, True), (False, False, False)])
def test_unigram_models_agree_with_the_library(fallback, prefix, fold):
    m = sentencepieces.Model(unigram_model(fallback, prefix, fold))
    rng = random.Random(9)
    texts = ["", " ", "  a  b ", "abc\ndef\n\n", "é 日本", "▁ x", "zzz" * 50] + ["".join(rng.choice("abcdefgh  é\n") for _ in range(rng.randrange(80))) for _ in range(300)]
    for text, (ids, parity) in zip(texts, m.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == m.library.encode(text) and parity, text


def test_long_segments_are_not_remembered(monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBER", 3)
    m = sentencepieces.Model(sentencepieces.default_model())
    texts = ["q" * 5000 + " one two", "three four five", "q" * 5000, "one"]
    for _ in range(2):
        assert [np.frombuffer(x, "<i4").tolist() for x, _ in m.encode(texts)] == m.library.encode(texts)
    assert all(len(x) <= sentencepieces.LONGEST for x in m.known)


def joined_texts():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghé日") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    return [" ".join(words), "\n".join(words), "  ".join(words[:99]) + "\n\n", "<0x0A> a <0x0A>\nb", "x" * 3000 + " y", "\0 z ▁\n▁"]


@pytest.mark.parametrize("kind", ["merges", "line feeds elsewhere", "unigram"])
def test_new_segments_are_encoded_together(kind):
    """A call for each segment costs more than its encoding; joined ones keep the ids that each has by itself."""
    m = sentencepieces.Model(unigram_model(True, True, False) if kind == "unigram" else sentencepieces.default_model())
    given, core = [], m.backend

    class Counting:
        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return core.encode_batch_fast(texts, **how)

    m.backend = Counting()
    new = sorted({s for t in joined_texts() for s in m.segments(m.normalise(t))})
    if kind == "line feeds elsewhere":
        m.line = core.encode("a", add_special_tokens=False).ids[0]
    got = {x: (np.frombuffer(ids, "<i4").tolist(), same) for x, ids, same in m.by_both(new)}
    by_one = {x: (core.encode(x, add_special_tokens=False).ids, m.plain.encode(x.replace("▁", " "))) for x in new}
    assert got == {x: (a, a == b) for x, (a, b) in by_one.items()}
    if kind == "merges":
        assert len(given) < len(new) / 10
        assert all(np.frombuffer(ids, "<i4").tolist() == m.library.encode(t) and ok for t, (ids, ok) in zip(joined_texts(), m.encode(joined_texts()), strict=True))


# --- n-gram Jaccard


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [x for x in re.split("[ \t-\r]+", low) if x]


def brute_components(rows, k, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    a, b = find(x), find(y)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "frequent"), [(3, 90, (32, 1 << 14, 4)), (3, 90, (3, 8, 1)), (5, 80, (4, 12, 1))])
def test_near_duplicates_match_brute_force(spark, monkeypatch, k, percent, frequent):
    for name, value in zip(("FREQUENT", "VERY_FREQUENT", "LOCAL"), frequent, strict=True):
        monkeypatch.setattr(ngram_jaccard, name, value)
    rng = random.Random(k * percent)
    vocabulary = [f"w{n}" for n in range(60)] + ["The", "É", "ß"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows, n = [(900, None), (901, ""), (902, " \t "), (903, "one two"), (904, "ONE\n two"), (905, "one"), (906, "a b c")], 0
    for _ in range(18):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((4, 9, 12, 30, 80, 200)))]
        for _ in range(rng.choice((1, 2, 8))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary) + "x"
            rows.append((n, " ".join(copy) if rng.random() < 0.7 else passage + "\n" + " ".join(copy)))
            n += 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(spark, docs(spark, rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_shingles_match_brute_force():
    rng = random.Random(1)
    texts = [None, b"", b" \t", b"a", b"A b", b"a  B\tc", b"a b c", "É é x y".encode()] + [b" ".join(bytes(rng.choice(b"abC") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [b"q" * (2 * BLOCK + 5) + b" w e r t", b"lorem ipsum dolor sit " * 60_000, b"a " * (BLOCK // 2 - 2) + b"hello my dear world"]
    for k in (1, 3):
        shingler, name, back = ngram_jaccard.Shingler(k), {}, {}
        for text, got in zip(texts, shingler.sets(pa.array(texts, pa.binary())), strict=True):
            w = (text or b"").lower().split()
            want = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
            for x in want:
                h = name.setdefault(x, int(shingler.tokens(b" ".join(x))[0]))
                assert back.setdefault(h, x) == x
            assert {name[x] for x in want} == set(got.tolist())


def test_tokens_of_many_sets_are_told_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "MOST_HELD", 5)
    rows = sorted([(1, a) for a in range(3)] + [(2, a) for a in range(40)] * 2 + [(3, 7), (4, 1), (4, 2)])
    for size in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows[k : k + size]]), pa.array([a for _, a in rows[k : k + size]])], ["token", "a"]) for k in range(0, len(rows), size)]
        got = [(r["token"], r["a"], r["held"]) for b in ngram_jaccard._shared(iter(batches)) for r in b.to_pylist()]
        assert set(got) == {(1, a, 3) for a in range(3)} | {(2, a, 5) for a in range(40)} | {(4, 1, 2), (4, 2, 2)}


def test_large_buckets_are_dealt_to_cells(spark, monkeypatch):
    for name, value in (("FREQUENT", 4), ("VERY_FREQUENT", 8), ("LOCAL", 1), ("CELL_MEMBERS", 5), ("CELL_PIVOTS", 3), ("GROWTH", 2)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    rng, rows = random.Random(4), []
    shared = [f"s{n}" for n in range(40)]
    for n in range(40):  # many documents that share half of what they hold, some of them similar
        own = [f"o{rng.randrange(12)}_{k}" for k in range(40)] if n % 3 else [f"p{n % 4}_{k}" for k in range(40)]
        rows.append((n, " ".join(shared + own)))
    rows += [(100 + k, rows[0][1]) for k in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(spark, docs(spark, rows), 1, 80).collect()}
    assert got == brute_components(rows, 1, 80)


def test_near_duplicates_of_odd_rows(spark):
    got = ngram_jaccard.near_duplicates(spark, docs(spark, odd_rows()), 3, 90).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert len(got) == len(odd_rows())
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (1, 3) and by[None] == (1, None) and by[5] == (1, 5)
    assert ngram_jaccard.near_duplicates(spark, docs(spark, odd_rows()).where("false")).count() == 0


def test_near_duplicates_with_a_pivot_larger_than_a_long_member(spark):
    shingler, low, high = ngram_jaccard.Shingler(1), [], []
    for word in (f"w{n}" for n in range(2000)):
        token = int(shingler.tokens(word.encode())[0])
        (low if token < (1 << 64) // 5 else high).append(word) if not 0.2 <= token / 2**64 < 0.3 else None
    shared = low[:20] + high[:63]
    pivot, small, large = low[:20] + high[100:180], [*shared, low[20], *high[63:69]], shared + low[21:33]
    rows = [(n, " ".join(x)) for n, x in enumerate((pivot, small, large))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(spark, docs(spark, rows), 1, 80).collect()}
    assert got == brute_components(rows, 1, 80) == {0: (100, 0), 1: (90, 1), 2: (95, 1)}


# --- media


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = step >> 3
            change += (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_codecs():
    rng = random.Random(3)
    blocks = [bytes(rng.randrange(256) for _ in range(64)) for _ in range(20)]
    got = telephony.decode_adpcm(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 64))
    assert [x.tolist() for x in got] == [slow_adpcm(b) for b in blocks]
    mu, a = telephony.MULAW_TABLE, telephony.ALAW_TABLE
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and (a[0x2A], a[0xAA], a[0x55], a[0xD5]) == (-32256, 32256, -8, 8)
    x = np.array([0, 1000, -1000, 32767], np.int16)
    assert telephony.resample_double(x)[0::2].tolist() == x.tolist() and telephony.resample_double(np.full(8, 77, np.int16)).tolist() == [77] * 16
    for tag in (telephony.MULAW, telephony.ALAW, telephony.ADPCM):
        assert telephony.from_wav(telephony.to_wav(blocks[0], tag)) == (tag, 8000, blocks[0])
    with pytest.raises(ValueError):
        telephony.from_wav(telephony.to_wav(blocks[0], telephony.MULAW)[:-5])


def test_media_columns(spark):
    rows = odd_rows() + [(8, "é" * 31), (9, "y" * 64), (10, "y" * 64)]
    got = telephony.encode_media(docs(spark, rows), payload="text").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert telephony.from_wav(bytes(r["media"]))[2] == padded and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert len(telephony.from_wav(bytes(r["pcm"]))[2]) == 4 * len(padded)
    assert by[9]["feature"] == by[10]["feature"]


# --- classifiers


def labelled(spark, bad, good, n=400):
    rng = random.Random(11)
    common = [f"c{k}" for k in range(80)]
    rows, marks = [], []
    for i in range(n):
        label = int(rng.random() < 0.3)
        words = [rng.choice(common) for _ in range(rng.randrange(20, 120))]
        for _ in range(4 if label else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words) + ("" if label else good)))
        marks.append((i, 1 - label, label))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def auc(score, label):
    pairs = [(s > t) + (s == t) / 2 for s, x in zip(score, label, strict=True) if x for t, y in zip(score, label, strict=True) if not y]
    return sum(pairs) / len(pairs)


def test_toxicity_on_held_out_rows(spark):
    d, marks = labelled(spark, ["vile", "rotten", "vileness"], "")
    got = toxicity.score(d, toxicity.train(d, marks)).join(marks, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert auc([r["score"] for r in held], [r["toxic"] for r in held]) > 0.98
    assert sum((r["score"] >= toxicity.THRESHOLD) != r["toxic"] for r in held) <= 3
    assert all(r["passages"] for r in held if r["score"] > 0.9)


def test_toxicity_of_odd_rows(spark):
    d, marks = labelled(spark, ["vile"], "")
    lex = toxicity.train(d, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, odd_rows()), lex).collect()}
    assert got[1] == got[2] and all(0 <= x < 0.7 for x in got.values())
    assert toxicity.train(d, marks.where("false")) is None and toxicity.score(d, None).where("score = 0").count() == d.count()
    assert toxicity.keep_clean(docs(spark, odd_rows()), lex).count() == len(odd_rows())


def test_passages_of_an_unlikely_document_are_returned(spark):
    lex = toxicity.Lexicon(words={"vile": 9.0}, weights=(-20.0, 0.0, 0.0))
    got = toxicity.score(docs(spark, [(1, "a vile thing"), (2, "a thing")]), lex).collect()
    assert {r["doc_id"]: len(r["passages"]) for r in got} == {1: 1, 2: 0} and all(r["score"] < 0.02 for r in got)


def test_maximal_segments_match_the_definition():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice((-3, -2, -1, 1, 2, 4)) for _ in range(rng.randrange(1, 14))]

        def brute(a, b):  # the best segment, shortest and leftmost; then left and right of it
            best = max(((sum(s[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i, j = -best[2], -best[2] - best[1]
            return [*brute(a, i), (i, j, float(best[0])), *brute(j, b)]

        got = toxicity.maximal_segments(np.array(s, float))
        assert sum(x for _, _, x in got) == sum(x for _, _, x in brute(0, len(s))) and max((x for _, _, x in got), default=0) == max((x for _, _, x in brute(0, len(s))), default=0)


def test_quality_on_held_out_rows(spark):
    d, marks = labelled(spark, ["@@@", "###!!"], " done.\nGood end.")
    got = quality_fm.score(d, quality_fm.train(d, marks)).join(marks, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert auc([r["score"] for r in held], [r["quality"] for r in held]) > 0.98


def test_quality_of_odd_rows(spark):
    d, marks = labelled(spark, ["@@@"], " done.")
    machine = quality_fm.train(d, marks)
    got = {r["doc_id"]: r["score"] for r in quality_fm.score(docs(spark, odd_rows()), machine).collect()}
    assert got[1] == got[2] and all(0 <= x <= 1 for x in got.values())
    assert quality_fm.train(d, marks.where("false")) == 0.5


def test_the_machine_uses_the_sum_of_squares_identity():
    m = quality_fm.FactorisationMachine(6, 3, seed=1)
    m.w = np.arange(6) / 10
    at, x = np.array([0, 2, 5]), np.array([1.0, 2.0, -1.0])
    slow = m.w0 + (m.w[at] * x).sum() + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert np.isclose(m.raw(at, x, np.array([0]))[0][0], slow)


# --- licences


def test_licences(spark):
    mit = licenses.KNOWN["MIT"][0]
    usual = mit.replace("\nThe above", "\n\nThe above").replace("\nTHE SOFTWARE", "\n\nTHE SOFTWARE")
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + mit), (2, "x\n\n" + mit.lower().replace("license", "licence") + "\n\ny"), (3, "a\n  RELEASED under the MIT LICENCE!\nb\nReleased under the MIT License."),
        (4, "This is not released under the MIT License."), (5, None), (6, ""), (7, "All rights reserved"), (None, "All rights reserved."),
        (8, "MIT License\n\nCopyright (c) 2021 A. Body\n\n" + usual), (9, "int main;\n\n" + "".join(f" * {x}\n" for x in usual.split("\n")) + "\n/* code */ x = 1\n" * 50 + usual),
        (10, "long " * 100_000 + "\n" + mit + "\n" + "é " * 1000), (11, mit.replace("without restriction", "with restriction")), (12, "All rights reserved."), (12, "All rights reserved.\nx"),
    ]
    got = {(r["doc_id"], r["license"]): (r["n_places"], r["first_line"], r["whole"]) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {
        (1, "MIT"): (1, 0, True), (2, "MIT"): (1, 1, False), (3, "MIT"): (2, 1, False), (7, "proprietary"): (1, 0, True), (None, "proprietary"): (1, 0, True), (8, "MIT"): (2, 0, False), (9, "MIT"): (2, 1, False),
        (10, "MIT"): (1, 1, False), (12, "proprietary"): (2, 0, True),
    }
    assert licenses.scan(docs(spark, rows).where("false")).count() == 0


def test_a_list_of_licences_of_ones_own(spark):
    known = {"A": ("one two", "one two three four five"), "B": ("One, two!",), "C": ("three\nfour five",)}
    rows = docs(spark, [(1, "one two\nthree\nfour five"), (2, "one\n\ntwo")]).selectExpr("doc_id", "text", "'x' AS license", "'x' AS digest", "1 AS line", "true AS whole")
    got = {(r["doc_id"], r["license"]): (r["n_places"], r["first_line"], r["whole"]) for r in licenses.scan(rows, known).collect()}
    assert got == {(1, "A"): (2, 0, True), (1, "B"): (1, 0, False), (1, "C"): (1, 1, False), (2, "A"): (1, 0, True), (2, "B"): (1, 0, True)}


# --- decontamination


def test_decontamination(spark):
    item = "A train leaves the small town of the valley at 9 and drives 120 km to Berlin with 3 long stops, how many hours does the trip take in all"
    changed = item.replace("120 km", "450 miles").replace(" 9 ", " 7 ").replace(" 3 ", " 5 ").replace("Berlin", "Madrid")
    twice = "The box holds 4 red balls and 4 blue balls and then 4 more green balls are put in by the older child"
    benchmark = spark.createDataFrame([(1, item), (2, twice), (3, ""), (4, None), (5, "what is love")], "item_id long, text string")
    rows = [
        (1, "Some words before. " + item + " And after."), (2, "x y z " + changed), (3, twice.replace("4 red", "6 red").replace("4 blue", "6 blue").replace("4 more", "6 more")),
        (4, twice.replace("4 red", "6 red").replace("4 blue", "7 blue").replace("4 more", "8 more")), (5, "A train leaves the small town and nothing else of it is here at all today"),
        (6, None), (7, ""), (8, "so what is love then"), (None, "oh " + item),
    ]
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontamination.contaminated(docs(spark, rows), benchmark).collect()}
    assert got == {(1, 1): True, (2, 1): False, (3, 2): False, (8, 5): True, (None, 1): True}
    again = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontamination.contaminated(docs(spark, rows), benchmark, most_broadcast=0).collect()}
    assert again == got
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs(spark, rows), benchmark).collect()) == [4, 5, 6, 7]
    assert decontamination.contaminated(docs(spark, rows), benchmark.where("false")).count() == 0
    assert decontamination.contaminated(docs(spark, rows).where("false"), benchmark).count() == 0


def test_decontamination_keeps_passages_apart(spark):
    item = "The box holds 4 red balls and 4 blue balls and then 4 more green balls are put in by the older child"
    other, cut = "The box holds 9 red balls and 9 blue jars. ", item.replace("then 4", "then of course 4")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, other + item), (2, other + "so it goes on here " * 90 + cut), (3, other), (4, item + " " + other), (None, other + "and no more"), (None, item)]
    got = {r["doc_id"]: (r["verbatim"], r["n_slots"]) for r in decontamination.contaminated(docs(spark, rows), benchmark).collect()}
    assert got == {1: (True, 1), 2: (False, 1), 4: (True, 1), None: (True, 1)}  # words were put into the second: not all windows are there


def test_decontamination_refuses_slots_that_disagree_in_any_form(spark):
    words = "the quick brown fox jumps over a lazy dog while seven small birds sing of rain and sun near old stone walls"
    item = f"{words} with 4 apples and then {words} until 9 pears lie there beside {words} for 4 days"
    put = lambda *v: item.replace("4 apples", f"{v[0]} apples").replace("9 pears", f"{v[1]} pears").replace("4 days", f"{v[2]} days")
    named = "in the park Alice met a very old friend of hers by the gate and then walked home where Bob and Alice ate two warm loaves of bread"
    benchmark = spark.createDataFrame([(1, item), (2, named)], "item_id long, text string")
    rows = [(1, put(7, 7, 8)), (2, put(7, 9, 8)), (3, put(7, 9, 7)), (4, item.upper()), (5, put(7, 9, 8).upper()), (6, put(7, 7, 8) + " " + "so it goes " * 300 + item.upper())]
    rows += [(7, named.replace("Alice met", "Carol met").replace("Alice ate", "Dave ate")), (8, named.replace("Alice", "Carol")), (9, named.lower())]
    got = {(r["doc_id"], r["item_id"]): (r["verbatim"], r["n_matched"] == r["n_windows"]) for r in decontamination.contaminated(docs(spark, rows), benchmark).collect()}
    assert got == {(3, 1): (False, True), (4, 1): (True, True), (6, 1): (True, True), (8, 2): (False, True), (9, 2): (True, True)}


def test_decontamination_equals_its_sql_with_several_passages(spark, tmp_path):
    import duckdb

    rng = random.Random(6)
    words = [f"w{chr(97 + k)}{chr(97 + k % 7)}" for k in range(20)]
    text = lambda n: " ".join(rng.choice([*words, "4", "9", "Ann", "Bea", "kg", "."]) for _ in range(n))
    items = [(k, text(rng.choice([2, 5, 12, 30]))) for k in range(25)]
    values = {"4": "7", "9": "9", "Ann": "Cid"}
    change = lambda t: " ".join(rng.choice([w, values.get(w, w)]) for w in t.split())
    rows = [(k, " ".join(x for _ in range(rng.randint(1, 3)) for x in (text(rng.randint(0, 40)), rng.choice([str, str.upper, change, change])(rng.choice(items)[1])))) for k in range(150)]
    con = duckdb.connect()
    for name, data, key in (("documents", rows, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(data, f"{key} long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        con.sql(f"create view {name} as select * from '{tmp_path / name}/*.parquet'")
    want = con.sql(decontamination.ORACLE_SQL).fetchall()
    out = decontamination.contaminated(spark.read.parquet(str(tmp_path / "documents")), spark.read.parquet(str(tmp_path / "benchmark")))
    assert len(want) > 40 and sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_decontamination_by_plain_windows(spark):
    texts = ["What is the capital of France", "Solve 3x + 5 = 20 and 12 - 7", "Ağaç İstanbullular eve gel", "5 7"]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(texts, 1)] + [(1, texts[0])], "item_id long, text string")
    rows = [(1, "Question: What is the capital of France?"), (2, "WHAT IS THE CAPITAL OF FRANCE"), (3, "now solve 3x + 5 = 20 and 12 - 7."), (4, texts[2]), (5, "the capital of France is"), (6, "x " * 150_000 + texts[0]), (7, "5 7"), (8, texts[0]), (8, texts[0])]
    clash = docs(spark, rows).selectExpr("doc_id", "text", *[f"'x' AS {c}" for c in ("item_id", "row", "tokens", "_doc", "_bad", "form", "window", "size")])
    got = {(r["doc_id"], r["item_id"]): (r["verbatim"], r["n_matched"] == r["n_windows"]) for r in decontamination.contaminated(clash, benchmark).collect()}
    assert got == {(d, i): (True, True) for d, i in ((1, 1), (2, 1), (3, 2), (4, 3), (6, 1), (8, 1))}
    left = decontamination.decontaminate(clash, benchmark)
    assert left.columns == clash.columns and sorted(r["doc_id"] for r in left.collect()) == [5, 7]


# --- line dedup


def test_line_dedup(spark):
    rows = [(k, f"own {k}\n Shared LINE \n\nshared line") for k in range(10)] + [(20, None), (21, ""), (22, "shared line"), (23, "rare\nrare"), (23, "rare"), (None, "x\n\x0bSHARED line\r")]
    got = line_dedup.drop_frequent_lines(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got if r["doc_id"] != 23}
    assert by[3] == ("own 3\n", 4, 2) and by[20] == ("", 1, 0) and by[21] == ("", 1, 0) and by[22] == ("", 1, 1) and by[None] == ("x", 2, 1)
    assert {r["text"] for r in got if r["doc_id"] == 23} == {"rare\nrare", "rare"}
    assert line_dedup.drop_frequent_lines(docs(spark, [(k, "é\nq") for k in range(9)] + [(8, "é")] * 5)).where("n_dropped > 0").count() == 0
    assert line_dedup.drop_frequent_lines(docs(spark, rows).where("false")).count() == 0


def test_line_dedup_of_hot_lines_long_texts_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = [(k, f"own {k}\nhot\n" + ("warm\n" if k % 3 else "") + "end " * (50_000 if k == 3 else 1)) for k in range(40)] + [(5, "hot"), (None, "hot\nx")]
    clash = docs(spark, rows).selectExpr("doc_id", "text", *[f"{k} AS {c}" for k, c in enumerate(("_doc", "_key", "_row", "_text", "_dropped", "n_lines", "n_dropped"))])
    got = line_dedup.drop_frequent_lines(clash).collect()
    want = sorted("\n".join(x for x in t.split("\n") if x not in ("hot", "warm", "end ")) if i != 3 else f"own 3\n{'end ' * 50_000}" for i, t in rows)
    assert sorted(r["text"] for r in got) == want and {r["_key"] for r in got} == {1}
    assert {r["n_lines"] for r in got if r["doc_id"] == 4} == {4} and line_dedup.drop_frequent_lines(clash, counts=False).columns == clash.columns


# --- language ID


def test_language_id(spark):
    english, german = "the cat sat on the mat and then went out of the house ", "der hund lief durch den garten und dann nach hause zurück "
    known = spark.createDataFrame([(k, (english if k % 2 else german) * 5, "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit_text(known)
    page = lambda lang, text: f"<html lang='{lang}'><script>der und den</script><p>{text}</p></html>"
    rows = [(k, f"http://www.a.example/{k}", page("en", english)) for k in range(30)] + [(100 + k, f"https://b.example.de/{k}", page("de", german)) for k in range(30)]
    rows += [(200, "http://b.example.de/x", "<html><p></p></html>"), (201, None, page("fr", english)), (202, "nonsense", None), (203, "http://www.a.example/z", ""), (203, "http://www.a.example/z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = language_id.identify(pages, model).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[k]["lang"] == "en" for k in range(30)) and all(by[100 + k]["lang"] == "de" for k in range(30))
    assert by[200]["lang"] == "de" and by[201]["lang"] == "en" and by[203]["lang"] == "en" and 0 <= by[202]["probability"] <= 1
    assert language_id.identify(pages.where("false"), model).count() == 0


def test_all_languages_of_the_documents_are_told_apart(spark):
    rows = [(k, f"word{k % 7} of the common kind", "en") for k in range(300)] + [(1000 + k, f"quite {k} rare", f"l{k:02}") for k in range(70)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit_text(known, most=40).languages == sorted({x[2] for x in rows})
    assert language_id.fit_text(known.where("false")).languages == ["und"]


def test_addresses():
    assert language_id.address("https://u@Blog.Example.co.DE:80/fr/1?x") == ("blog.example.co.de", "co.de", "de", "fr")
    assert language_id.address("http://a.org/english/1") == ("a.org", "a.org", "org", "none") and language_id.address(None) == ("", "", "", "none")


def test_the_rank_of_pivots_is_limited_before_the_shuffle(spark):
    rows = spark.range(100).selectExpr("id % 3 AS sig", "0 AS long", "id AS own", "1 AS n", "id AS c")
    out = ngram_jaccard._pivots(rows, ["own", "n", "c"], 1, 4)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["sig"], r["c"], r["place"]) for r in out.collect()) == sorted((s, s + 3 * k, k) for s in range(3) for k in (1, 2, 3))
