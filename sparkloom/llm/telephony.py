"""Telephony audio columns: mu-law, A-law and ADPCM to PCM (operator 2).

Samples are 8 kHz mono. Companded bytes are expanded by 256-entry tables that are computed from the
companding rules; IMA ADPCM is decoded step by step, but for all blocks at once in numpy; PCM is
resampled by linear interpolation and stored as little-endian 16-bit bytes, a row of a table for each
medium. The query's features come from the stored samples, read back: mu-law, A-law and ADPCM ones
from the container's, all others from the table's PCM.

Defined results: a null payload or text counts as the empty one; an empty payload expands to empty
PCM; equal inputs give equal outputs; a WAV container that is cut short raises ``ValueError``; repeated rows
and rows without ``doc_id`` have a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_types, documents, map_arrow, stored, text_or_empty

RATE = 8000
#: Payloads are padded to whole frames of so many bytes (24 ms), which are ADPCM blocks as well.
FRAME = 192
FORMAT_ALAW, FORMAT_MULAW, FORMAT_IMA = 6, 7, 17
ADPCM_HEADER = 4
#: Payload bytes that are decoded together.
BLOCK_BYTES = 2_000_000


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law: inverted bits; sign, 3 bits of exponent, 4 bits of mantissa, bias 132."""
    b = ~np.arange(256, dtype=np.int32) & 255
    magnitude = ((((b & 15) << 3) + 132) << ((b >> 4) & 7)) - 132
    return np.where(b & 128, -magnitude, magnitude).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law: even bits inverted; sign, 3 bits of exponent, 4 bits of mantissa."""
    b = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (b >> 4) & 7, (b & 15) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(b & 128, magnitude, -magnitude).astype(np.int16)


@lru_cache(maxsize=1)
def ima_steps() -> np.ndarray:
    # Step sizes of IMA ADPCM.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
        1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


#: Change of the step index by the lower three bits of a code.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


@lru_cache(maxsize=1)
def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor and next index, both by index and code."""
    code, step = np.arange(16), ima_steps()[:, None]
    size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
    change = np.where(code & 8, -size, size).astype(np.int32)
    index = np.clip(np.arange(len(step))[:, None] + IMA_INDEX[code & 7], 0, len(step) - 1).astype(np.int32)
    return change.ravel(), index.ravel()


def expand(payload: bytes, codec: str) -> np.ndarray:
    """PCM of companded bytes; ``codec`` is ``mulaw`` or ``alaw``."""
    return {"mulaw": mulaw_table, "alaw": alaw_table}[codec]()[np.frombuffer(payload, np.uint8)]


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks, one block a row: the header's sample, then two a byte, low
    nibble first. The step index of a header is clamped to the table, as decoders do."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(ima_steps()) - 1)
    change, follow = _ima_tables()
    data = np.ascontiguousarray(blocks[:, ADPCM_HEADER:].T)  # step by step in rows
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0], value = head, head
    for k, row in enumerate(data):
        for half, code in enumerate((row & 15, row >> 4)):
            place = index * 16 + code
            value = np.clip(value + change[place], -32768, 32767)
            index = follow[place]
            out[1 + 2 * k + half] = value
    return out.T


def encode_ima(pcm: np.ndarray, block: int = FRAME) -> np.ndarray:
    """IMA ADPCM blocks of ``pcm``; the last block repeats the last sample. Blocks are coded at once."""
    per = 1 + 2 * (block - ADPCM_HEADER)
    n = -(-len(pcm) // per)
    x = np.concatenate([pcm, np.repeat(pcm[-1:], n * per - len(pcm))]).reshape(n, per).astype(np.int32)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = x[:, 0].astype("<i2").view(np.uint8).reshape(n, 2)
    change, follow = _ima_tables()
    value, index = x[:, 0].copy(), np.zeros(n, np.int32)
    for k in range(1, per):
        aims = np.abs(value[:, None] + change.reshape(-1, 16)[index] - x[:, k, None])
        code = np.argmin(aims, axis=1).astype(np.int32)
        place = index * 16 + code
        value, index = np.clip(value + change[place], -32768, 32767), follow[place]
        out[:, ADPCM_HEADER + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation of 16-bit PCM from ``rate`` to ``to`` samples a second."""
    if not len(pcm) or rate == to:
        return pcm.astype(np.int16)
    if to == 2 * rate:  # the telephone case, in whole numbers
        x = pcm.astype(np.int32)
        out = np.empty(2 * len(x), np.int16)
        out[::2] = x
        out[1:-1:2] = (x[:-1] + x[1:]) >> 1
        out[-1] = x[-1]
        return out
    at = np.arange(len(pcm) * to // rate) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def to_wav(payload: bytes, tag: int = FORMAT_MULAW, rate: int = RATE) -> bytes:
    """WAV container of 8-bit companded samples: format, fact and data chunks."""
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and payload of a WAV container."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, tag, rate = 12, -1, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            break
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("WAV container without its data")


def decode_column(df: DataFrame, payload: str, codec: str, out: str = "pcm", rate: int = RATE, to: int = 16000) -> DataFrame:
    """``df`` with ``out``: 16-bit PCM at rate ``to`` of the payload column, ready to be stored.
    ``codec``: ``mulaw``, ``alaw``, ``ima`` (whole blocks of ``FRAME`` bytes) or ``wav``."""

    @F.pandas_udf("binary")
    def pcm(column):
        import pandas as pd

        def one(b):
            if codec == "wav":
                tag, own, b = from_wav(b)
                kind = {FORMAT_ALAW: "alaw", FORMAT_MULAW: "mulaw", FORMAT_IMA: "ima"}[tag]
            else:
                kind, own = codec, rate
            if kind == "ima":
                x = decode_ima(np.frombuffer(b, np.uint8).reshape(-1, FRAME)).ravel() if b else np.zeros(0, np.int16)
            else:
                x = expand(b, kind)
            return resample(x, own, to).astype("<i2").tobytes()

        return pd.Series([one(b or b"") for b in column], dtype=object)

    return df.withColumn(out, pcm(F.col(payload)))


def payload_of(text: str) -> tuple[int, bytes]:
    """Size of a text in UTF-8, and its bytes with spaces up to a positive multiple of ``FRAME``."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b" ")


def media_table(df: DataFrame) -> DataFrame:
    """Each text as the payload of a mu-law WAV, described by what is read back from that: sizes, digests,
    root mean squares of the payload expanded as A-law and ADPCM, and ``pcm``, mu-law resampled to 16 kHz."""

    def block(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k, _ in arrow_types(MEDIA)}
        made = [(n, to_wav(p)) for n, p in map(payload_of, c["text"])]
        read = [from_wav(m)[2] for _, m in made]
        first = 0
        while first < len(read):
            last, size = first, 0
            while last < len(read) and (size == 0 or size + len(read[last]) <= BLOCK_BYTES):
                size += len(read[last])
                last += 1
            frames = np.frombuffer(b"".join(read[first:last]), np.uint8).reshape(-1, FRAME)
            step = BLOCK_BYTES // FRAME
            energy = np.concatenate([(decode_ima(frames[k : k + step]).astype(np.float64) ** 2).sum(axis=1) for k in range(0, len(frames), step)])
            ends = np.cumsum([len(p) // FRAME for p in read[first:last]])
            starts = np.concatenate([[0], ends[:-1]])
            ima = np.add.reduceat(energy, starts) / ((ends - starts) * (1 + 2 * (FRAME - ADPCM_HEADER)))
            for k in range(first, last):
                (n, media), payload = made[k], read[k]
                pcm = resample(expand(payload, "mulaw"), RATE, 2 * RATE).astype("<i2").tobytes()
                row = (c["doc_id"][k], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), rms(expand(payload, "alaw")), round(float(np.sqrt(ima[k - first])), 3), pcm)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            first = last
        return out

    return map_arrow(df.select("doc_id", text_or_empty().alias("text")), block, MEDIA, ["doc_id", "text"], rows=128)


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, alaw_rms double, ima_rms double, pcm binary"


def rms(samples: np.ndarray) -> float:
    return round(float(np.sqrt(np.mean(np.square(samples, dtype=np.float64)))), 3)


def media_digest(df: DataFrame) -> DataFrame:
    """The media of ``df``'s texts: their PCM is stored, read back and described, with what ``media_table``
    says of the container. Of 16 kHz PCM every other sample is one of the 8 kHz signal."""
    table = stored(media_table(df), "op2-pcm", compression="zstd", **{"parquet.compression.codec.zstd.level": 9})
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def block(c: dict[str, list]) -> dict[str, list]:
        features = []
        for alaw, ima, pcm in zip(c["alaw_rms"], c["ima_rms"], c["pcm"], strict=True):
            mu = np.frombuffer(pcm, "<i2")[::2]
            feature = {"alaw_rms": alaw, "crossings": int(np.count_nonzero(np.diff(np.signbit(mu)))), "ima_rms": ima, "mulaw_rms": rms(mu), "pcm16k_bytes": len(pcm), "pcm16k_crc32": zlib.crc32(pcm)}
            features.append(json.dumps(feature, sort_keys=True))
        return {**{n: c[n] for n in names}, "feature": features}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(table, block, schema, [*names, "alaw_rms", "ima_rms", "pcm"], rows=128)


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(documents(spark, sf_dir))
