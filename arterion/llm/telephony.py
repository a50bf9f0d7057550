"""Media columns: telephony audio.

A payload of bytes is kept as the 8-bit samples of a mu-law or A-law WAV file,
or as the blocks of an IMA ADPCM one.  Reading expands mu-law and A-law by
256-entry tables; ADPCM blocks are decoded for all blocks of a batch at once:
the loop runs over the samples of a block, each step being one numpy operation
over every block.  The linear samples are resampled by a fixed four-tap filter
and may be kept as a 16-bit WAV file.

Defined results: a null payload is an empty one; the payload is padded by bytes
0 to a positive multiple of 64, so an empty text has 64 samples; equal payloads
give equal media and features; repeated rows stay; a payload of any length is
stored whole; nothing depends on a row's neighbours; further columns are not
looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.llm.common import table, tidied

UNIT = 64
RATE, TO_RATE = 8000, 16000
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
#: Samples of linear PCM that are worked on at a time.
CHUNK = 1 << 20


def _mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law, all bits inverted on the wire."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law, even bits inverted on the wire."""
    code = np.arange(256) ^ 0x55
    low, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(segment == 0, low + 8, low + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: each about 1.1 times the one before, from 7 to 32767."""
    # Fixed values of the format; the growth rule alone rounds some of them differently.
    steps = [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ]
    return np.array(steps, np.int32)


MULAW_TABLE, ALAW_TABLE, STEPS = _mulaw_table(), _alaw_table(), _adpcm_steps()
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Change of the predictor by step index and 4-bit code.
_CHANGE = np.array([[(-1 if c & 8 else 1) * ((s >> 3) + (s >> 2) * bool(c & 1) + (s >> 1) * bool(c & 2) + s * bool(c & 4)) for c in range(16)] for s in STEPS.tolist()], np.int32).ravel()
_NEXT = np.clip(np.arange(89)[:, None] + _MOVES[None, :], 0, 88).astype(np.int32).ravel() * 16


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: (n, size) bytes to (n, 1 + 2 * (size - 4)) samples.  A step index over 88 counts as 88."""
    n, size = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(size - 4):
        for j, code in enumerate((body[k] & 15, body[k] >> 4)):
            at = index + code
            value += _CHANGE[at]
            np.clip(value, -32768, 32767, out=value)
            index = _NEXT[at]
            out[1 + 2 * k + j] = value
    return np.ascontiguousarray(out.T)


def resample_double(x: np.ndarray) -> np.ndarray:
    """8 to 16 kHz: samples stay, and a four-tap half-band filter (-1 9 9 -1) / 16 makes those between; ends repeat."""
    p = np.concatenate([x[:1], x, x[-1:], x[-1:]]).astype(np.int32)
    between = (9 * (p[1:-2] + p[2:-1]) - p[:-3] - p[3:] + 8) >> 4
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    out[1::2] = np.clip(between, -32768, 32767)
    return out


def to_wav(data: bytes, tag: int, rate: int = RATE) -> bytes:
    """A mono WAV file.  ``data``: bytes of samples, or of whole ADPCM blocks of UNIT bytes."""
    bits, align = {PCM: (16, 2), ALAW: (8, 1), MULAW: (8, 1), ADPCM: (4, UNIT)}[tag]
    per = 1 + 2 * (UNIT - 4)
    extra = b"" if tag == PCM else struct.pack("<HH", 2, per) if tag == ADPCM else struct.pack("<H", 0)
    speed = rate * UNIT // per if tag == ADPCM else rate * align
    form = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) // UNIT * per if tag == ADPCM else len(data))
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, bytes of samples or blocks) of a mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate = struct.unpack_from("<HHI", media, at + 8)
            if channels != 1:
                raise ValueError("only mono is read")
        elif name == b"data":
            if tag is None or at + 8 + size > len(media):
                raise ValueError("a WAV file that is cut short")
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without data")


def expand(tag: int, data: bytes) -> np.ndarray:
    """Linear 16-bit samples of stored bytes."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return MULAW_TABLE[raw]
    if tag == ALAW:
        return ALAW_TABLE[raw]
    if tag == ADPCM:
        return decode_adpcm(raw.reshape(-1, UNIT)).ravel()
    if tag == PCM:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"format {tag} is not read")


def padded(payload: bytes | None) -> bytes:
    payload = payload or b""
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


SCHEMA = """n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string,
feature string, pcm_bytes long, pcm_sha256 string, media binary, pcm binary"""


def _loud(x: np.ndarray) -> str:
    """Peak and mean square (whole number) of linear samples: exact integers, the same on any machine."""
    y = x.astype(np.int64)
    return f"{int(np.abs(y).max())}/{int((y * y).sum()) // len(y)}"


def encode_media(rows: DataFrame, key: str = "doc_id", payload: str = "payload", files: bool = True, to_rate: int = TO_RATE) -> DataFrame:
    """(key, n_bytes, payload_bytes, ..., feature, pcm_bytes, pcm_sha256, media, pcm): each payload stored as mu-law WAV
    and read back, and the resampled PCM that is stored beside it.

    ``feature``: zero crossings of the mu-law samples, peak and mean square of the payload's bytes taken as mu-law, as
    A-law and as ADPCM blocks, and the CRC-32 of the resampled PCM.  ``media`` is the stored file and ``pcm`` the
    resampled 16-bit one; both are null unless ``files``.
    """
    if to_rate != 2 * RATE:
        raise ValueError("the filter doubles the rate")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        def part(keys: list, stored: list[tuple[int, bytes]]) -> pa.RecordBatch:
            back = [from_wav(m)[2] for _, m in stored]
            blocks = np.frombuffer(b"".join(back), np.uint8).reshape(-1, UNIT)
            linear = decode_adpcm(blocks)
            cuts = np.cumsum([0] + [len(b) // UNIT for b in back])
            cols: dict[str, list] = {k: [] for k in "n p sha crc mb msha f pb psha media pcm".split()}
            for k, ((n, media), data) in enumerate(zip(stored, back, strict=True)):
                mu = expand(MULAW, data)
                pcm = resample_double(mu).astype("<i2").tobytes()
                crossings = int(np.count_nonzero((mu[1:] < 0) != (mu[:-1] < 0)))
                cols["n"].append(n)
                cols["p"].append(len(data))
                cols["sha"].append(hashlib.sha256(data).hexdigest())
                cols["crc"].append(zlib.crc32(data[-UNIT:]))
                cols["mb"].append(len(media))
                cols["msha"].append(hashlib.sha256(media).hexdigest())
                cols["f"].append(f"zc={crossings};mu={_loud(mu)};a={_loud(expand(ALAW, data))};adpcm={_loud(linear[cuts[k] : cuts[k + 1]].ravel())};pcm16k={zlib.crc32(pcm):08x}")
                stored_pcm = to_wav(pcm, PCM, to_rate)
                cols["pb"].append(len(stored_pcm))
                cols["psha"].append(hashlib.sha256(stored_pcm).hexdigest())
                cols["media"].append(media if files else None)
                cols["pcm"].append(stored_pcm if files else None)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([keys, *[pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)]], names)

        for batch in batches:
            start, held, stored = 0, 0, []
            for k, x in enumerate(batch.column(1)):
                x = x.as_py()
                body = padded(x)
                stored.append((len(x or b""), to_wav(body, MULAW)))
                held += len(body)
                if held >= CHUNK:
                    yield part(batch.column(0).slice(start, k + 1 - start), stored)
                    start, held, stored = k + 1, 0, []
            if stored:
                yield part(batch.column(0).slice(start, len(stored)), stored)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256", "media", "pcm"]
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(payload).cast("binary")).mapInArrow(tidied(make), f"`{key}` {kind}, {SCHEMA}")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("payload"))
    return encode_media(docs, files=False).drop("media", "pcm")
