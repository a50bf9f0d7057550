"""SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is parsed and its parts are rebuilt: the normaliser (its
character map, blank folding, dummy prefix), the metaspace marker, the unigram
scores or the merges that piece scores imply, and byte fallback.

No piece of such a model crosses from another character into a marker, or over
a line feed, unless the vocabulary says so.  Where it doesn't, a text is cut
there, each distinct segment is encoded once per worker, in multithreaded
batches of segments joined by line feeds, and a text's ids are the segments' ids
in a row.  Each text is also
normalised, and each distinct segment encoded, by the sentencepiece library:
``parity`` says whether the two agree on the normalised text and on all segments
of a row.  Models whose pieces do cross, or that join unknown characters in a row
to one piece, are encoded and compared by whole texts.

Defined results: a null or empty text has no ids and decodes to an empty text;
repeated rows stay, and equal texts have equal ids; texts of any length are
encoded whole; further columns are not looked at, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.llm.common import kept, table, tidied

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters of text that are worked on at a time; segments that a worker remembers, and the characters of each at most;
#: characters of segments that are joined for encoding, where the next one begins.
CHUNK, REMEMBER, LONGEST, JOINED = 1 << 18, 100_000, 64, 1000
THREADS = 2
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+")
_GLUED = re.compile(f"[^{MARK}]{MARK}|[^\n]\n|\n[^\n]")


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The merges that scores imply: every cut of a piece into two others, best score first."""
    usable = {p for p, _, kind in pieces if kind not in (UNKNOWN, CONTROL, BYTE)}
    found = [(-score, k, i, p[:i], p[i:]) for k, (p, score, _) in enumerate(pieces) if p in usable for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
    return [x[3:] for x in sorted(found)]


class Model:
    """A SentencePiece model over the tokenizers library."""

    def __init__(self, proto: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer, models, normalizers

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(proto)
        pieces = [(p.piece, p.score, p.type) for p in m.pieces]
        spec, self.charsmap = m.normalizer_spec, m.normalizer_spec.precompiled_charsmap
        self.prefix, self.fold = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        if m.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only models that mark blanks before words are read")
        unknown = next(k for k, p in enumerate(pieces) if p[2] == UNKNOWN)
        bytes_too = m.trainer_spec.byte_fallback
        if m.trainer_spec.model_type == 1:
            core = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unknown, byte_fallback=bytes_too)
        elif m.trainer_spec.model_type == 2:
            core = models.BPE({p: k for k, (p, _, _) in enumerate(pieces)}, merges_of(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=bytes_too)
        else:
            raise ValueError("only unigram and BPE models are read")
        self.map = normalizers.Precompiled(self.charsmap) if self.charsmap else None
        #: Segments are normalised before they are cut, so this one has no normaliser; whole() has all of it.
        self.backend = Tokenizer(core)
        # Without byte fallback, unknown characters in a row are one piece, also over a cut.
        self.cuts = bytes_too and not any(_GLUED.search(p) for p, _, kind in pieces if kind not in (UNKNOWN, CONTROL, BYTE))
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.remove_extra_whitespaces = False
        m.normalizer_spec.precompiled_charsmap = b""
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.threads = threads
        line = self.backend.encode("\n", add_special_tokens=False).ids
        #: The one id of a line feed, if segments can be joined by it.  Merges don't depend on what stands beyond a cut;
        #: sums of unigram scores are rounded, so ties may.
        self.line = line[0] if self.cuts and len(line) == 1 and m.trainer_spec.model_type == 2 else None
        self.known: dict[str, bytes] = {}
        self.differ: set[str] = set()

    def whole(self) -> Tokenizer:
        """A tokenizer with the model's normaliser and decoder, for texts as they come."""
        from tokenizers import Regex, Tokenizer, decoders, normalizers

        out = Tokenizer(self.backend.model)
        steps = [self.map] if self.map else []
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()] if self.fold else []
        steps += [normalizers.Prepend(MARK)] if self.prefix else []
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.prefix else [])])
        return out

    def normalise(self, text: str) -> str:
        if self.map:
            text = self.map.normalize_str(text)
        if self.fold:
            text = re.sub(" {2,}", " ", text).strip(" ")
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def segments(self, normal: str) -> list[str]:
        """The cuts of a normalised text: before each run of markers, and around runs of line feeds."""
        if not self.cuts:
            return [normal] if normal else []
        if "\0" in normal or MARK * 2 in normal or "\n\n" in normal:
            return _SEGMENT.findall(normal)
        return [x for x in normal.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0") if x]

    def by_both(self, segments: list[str]) -> Iterator[tuple[str, bytes, bool]]:
        """(segment, its ids as little-endian int32, do the libraries agree) of each, in any order.

        Segments without a line feed are joined by one, as texts may be cut there: a call for each would cost more than
        its encoding.  Where a line feed's id isn't found just between them, each is encoded by itself.
        """
        import numpy as np

        groups: list[list[str]] = []
        held = JOINED
        for x in segments:
            if self.line is None or "\n" in x:
                groups.append([x])
                held = JOINED  # nothing is joined to it
            elif held >= JOINED:
                groups.append([x])
                held = len(x)
            else:
                groups[-1].append(x)
                held += len(x)
        apart: list[list[str]] = []
        while groups:
            joined = ["\n".join(x) for x in groups]
            ours = self.backend.encode_batch_fast(joined, add_special_tokens=False)
            theirs = self.plain.encode([x.replace(MARK, " ") for x in joined], num_threads=self.threads)
            for group, a, b in zip(groups, ours, theirs, strict=True):
                a, b = np.array(a.ids, "<i4"), np.array(b, "<i4")
                if len(group) == 1:
                    yield group[0], a.tobytes(), np.array_equal(a, b)
                    continue
                (data, ends), (other, theirs_end) = [(x.tobytes(), [*(4 * np.flatnonzero(x == self.line)).tolist(), 4 * len(x)]) for x in (a, b)]
                if not len(ends) == len(theirs_end) == len(group):
                    apart += [[x] for x in group]
                    continue
                start = begin = 0
                same = data == other
                for x, end, stop in zip(group, ends, theirs_end, strict=True):
                    yield x, data[start:end], same or data[start:end] == other[begin:stop]
                    start, begin = end + 4, stop + 4
            groups, apart = apart, []

    def learn(self, segments: set[str]) -> tuple[dict[str, bytes], set[str]]:
        """Encodes the segments that are new, by both libraries.  Long ones are not remembered: their ids, and those of
        them on which the libraries differ, are returned."""
        if len(self.known) > REMEMBER:
            self.known.clear()
            self.differ.clear()
        once, apart = {}, set()
        for x, ids, same in self.by_both([x for x in segments if x not in self.known]):
            short = len(x) <= LONGEST
            (self.known if short else once)[x] = ids
            if not same:
                (self.differ if short else apart).add(x)
        return once, apart

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(ids as little-endian int32, do the libraries agree) of each text.

        The libraries also agree on how a text is normalised: the other one's normaliser is asked, text by text.
        """
        normal = [self.normalise(x) for x in texts]
        cut = [self.segments(x) for x in normal]
        once, apart = self.learn(set(chain.from_iterable(cut)))
        apart |= self.differ
        known = self.known
        get = (lambda x: once[x] if x in once else known[x]) if once else known.__getitem__
        same = [self.library.normalize(t) == x for t, x in zip(texts, normal, strict=True)]
        return [(b"".join(map(get, x)), ok and (not apart or apart.isdisjoint(x))) for x, ok in zip(cut, same, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of the text of ``ids``; a lone byte piece gives its byte."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        return out[1:] if self.prefix and out[:1] == b" " else out


def model_of(proto: bytes, threads: int) -> Model:
    """The model, made once for a worker's tasks in a row; some 70 MB of a worker's memory with the segments it knows."""
    return kept(("sentencepieces", proto, threads), lambda: Model(proto, threads))


def encode(rows: DataFrame, proto: bytes, key: str = "doc_id", text: str = "text", threads: int = THREADS, with_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_bytes, round_trip, parity, ids): each text encoded and decoded again.

    ``ids_sha256`` is of the ids as little-endian int32; ``round_trip``: the decoded text is the normalised one.
    ``ids`` is null unless ``with_ids``.
    """
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        m = model_of(proto, threads)

        def part(keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
            coded = m.encode(texts)
            ids = [np.frombuffer(x, "<i4") for x, _ in coded]
            back = [m.decode(x.tolist()) for x in ids]
            same = [b == (t.encode() if not m.map and not m.fold else m.normalise(t).removeprefix(MARK if m.prefix else "").replace(MARK, " ").encode()) for b, t in zip(back, texts, strict=True)]
            return pa.RecordBatch.from_arrays(
                [keys, pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in coded]), pa.array([len(x) for x in back], pa.int64()),
                 pa.array(same), pa.array([ok for _, ok in coded]), pa.array(ids if with_ids else [None] * len(ids), pa.list_(pa.int32()))],
                [key, "n_tokens", "ids_sha256", "decoded_bytes", "round_trip", "parity", "ids"],
            )

        for batch in batches:
            start, held, texts = 0, 0, []
            for k, x in enumerate(batch.column(1)):
                texts.append(x.as_py() or "")
                held += len(texts[-1])
                if held >= CHUNK:
                    yield part(batch.column(0).slice(start, k + 1 - start), texts)
                    start, held, texts = k + 1, 0, []
            if texts:
                yield part(batch.column(0).slice(start, len(texts)), texts)

    return rows.select(key, text).mapInArrow(tidied(work, keeps=True), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_bytes long, round_trip boolean, parity boolean, ids array<int>")


def decode(rows: DataFrame, proto: bytes, key: str = "doc_id", ids: str = "ids", threads: int = THREADS) -> DataFrame:
    """(key, text): the text of each row's ids; bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(proto, threads)
        for batch in batches:
            texts = [m.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return rows.select(key, F.col(ids).cast("array<int>")).mapInArrow(tidied(work, keeps=True), f"`{key}` {kind}, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_model(), with_ids=False).drop("ids")
