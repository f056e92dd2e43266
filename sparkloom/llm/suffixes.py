"""Removal of repeated 200-byte strings by blockwise suffix sorting with difference covers (operator 8).

A byte goes if a 200-byte string over it also starts anywhere else. Equality of two such strings is
decided by sorting suffixes, one bucket at a time:

1. Buckets. Each 200-byte string has a minimiser: the place, within it, of the least hash of all its
   50-byte strings (the first one on ties). Equal strings have equal minimisers, so the minimiser's
   50 bytes name the bucket. Consecutive starts with the same minimiser form a run; only runs whose
   bucket has two or more members go on.
2. Runs with equal texts are counted, and each distinct text is sent once to its bucket. A bucket with
   one distinct text has nothing to sort: no two strings of a run are equal, as both would have the
   minimiser at the same offset, so all are repeated if the text occurs twice.
3. Within each other bucket the suffixes are sorted to a depth of 200. A difference cover modulo 3,
   residues {0, 1}, gives the sample: its ranks are computed first, by tripling the depth, to 198
   bytes. Two suffixes of any residues reach sample places at the same small offset, so the order of
   any two, and whether they agree in 200 bytes, follows from at most two bytes and one rank: long
   ties never get compared byte by byte. Memory is bounded by the bucket texts held at once.
4. A bucket of more bytes than a task should hold is halved by the minimiser's offset in the strings:
   equal strings have it at the same one. All strings of a half have more than 50 bytes in common
   places, and these name smaller buckets. At the eighth halving a bucket is one string, so this ends;
   the same sorting settles what it leads to.

A run's text is named by two 64-bit hashes, one of the minimiser's bytes and one of all: for a false
match two texts of one bucket must agree in the second by chance. Rows are named by ``doc_id`` and a
64-bit hash of the text, those without ``doc_id`` by two hashes.

Defined results: a null text counts as the empty one; texts under 200 bytes lose nothing; repeated
rows and equal texts of 200 bytes or more lose all; matches never cross rows; an empty table gives an
empty table. Repeated rows, however many, are counted, and their text is sent to a bucket once.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_types, discard, documents, in_arrow, stored, text_or_empty, unused

DEPTH, CORE = 200, 50
STARTS = DEPTH - CORE + 1
#: Bytes of texts that are hashed together, and of bucket texts that are sorted together (under 2^21).
BLOCK, BUCKET = 500_000, 800_000
#: Bytes of distinct texts of a bucket above which it is halved.
WIDE = 400_000
#: Names of rows that a task remembers, so as to cut repeated ones once.
SEEN = 50_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LOW = np.uint64(0xFFFFFFFF)


@lru_cache(maxsize=8)
def _powers(which: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64, up to 2^bits."""
    base = _BASES[which]
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any stretches of a byte array, from running sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        bits = max(20, int(len(data) + 1).bit_length())
        up, self.down = _powers(which, bits)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        return _mix(x + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, from running minima of blocks and their ends."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """All runs of ``texts``: number of the text, first start, starts, minimiser's offset from the
    first start, hash of the minimiser's bytes, hash of the run's text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < DEPTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = Rolling(data).all_of(CORE)
    # The first place of the least upper half of the hash.
    least = sliding_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), STARTS)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.flatnonzero(np.arange(len(least)) + DEPTH <= ends[owner[: len(least)]])
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    place = (least[starts] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, anchor = starts[new], place[new]
    count = np.diff(np.append(new, len(starts)))
    whole = Rolling(data, 1).of(first, first + count - 1 + DEPTH)
    text = owner[first]
    return text, first - (ends - sizes)[text], count, anchor - first, h[anchor], whole


def _rank(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of keys."""
    order = np.argsort(keys)
    k = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]).astype(np.uint64)
    return out


class CoverRanks:
    """Ranks of the sample's places (residues 0 and 1 modulo 3) by their next 198 bytes."""

    DEPTH = 198

    def __init__(self, data: np.ndarray):
        pad = 3 * DEPTH
        self.data = np.concatenate([data, np.zeros(pad + (-len(data)) % 3, np.uint8)])
        n = len(self.data) // 3
        shift = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), np.uint64)])

        def six(r: int) -> np.ndarray:
            flat = self.data.astype(np.uint64)
            at = np.arange(r, 3 * n, 3)
            out = np.zeros(n, np.uint64)
            for k in range(6):
                out = (out << np.uint64(8)) | flat[np.minimum(at + k, len(flat) - 1)]
            return out

        ranks = _rank(np.concatenate([six(0), six(1)]))
        if len(ranks) >= 1 << 21:
            raise ValueError("too many bytes for one bucket")
        # Places p + 3k keep their residue, so depth grows within each half of ``ranks``.
        for step in (2, 6, 18):  # 6 -> 18 -> 54 -> 162 bytes; steps in units of 3 bytes
            ranks = self._joined(ranks, n, (0, step, 2 * step), shift)
        ranks = self._joined(ranks, n, (0, 12), shift)  # 162 bytes, and 162 from 36 on
        self.of_zero, self.of_one = ranks[:n], ranks[n:]

    @staticmethod
    def _joined(ranks: np.ndarray, n: int, steps: tuple[int, ...], shift) -> np.ndarray:
        halves = []
        for half in (ranks[:n], ranks[n:]):
            key = np.zeros(n, np.uint64)
            for s in steps:
                key = (key << np.uint64(21)) | shift(half, s)
            halves.append(key)
        return _rank(np.concatenate(halves))

    def at(self, place: np.ndarray) -> np.ndarray:
        """Rank at sample places."""
        third, residue = np.divmod(place, 3)
        return np.where(residue == 0, self.of_zero[third], self.of_one[third])


def suffix_ranks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Place of each suffix in the order of all given suffixes to a depth of 200 bytes; suffixes that
    agree in 200 bytes have the same place. All ``starts + 200`` must be within ``data``."""
    cover = CoverRanks(data)
    text = cover.data.astype(np.uint64)
    residue = starts % 3

    def key(at: np.ndarray, offset: int) -> np.ndarray:
        """``offset`` bytes, the rank behind them, and what is left of 200 bytes."""
        out = np.zeros(len(at), np.uint64)
        for k in range(offset):
            out = (out << np.uint64(8)) | text[at + k]
        out = (out << np.uint64(21)) | cover.at(at + offset)
        for k in range(offset + cover.DEPTH, DEPTH):
            out = (out << np.uint64(8)) | text[at + k]
        return out

    zero, one, two = (np.flatnonzero(residue == r) for r in range(3))
    place = np.zeros(len(starts), np.int64)
    # Offset at which both residues are in the sample: 0 and 1 at 0, 0 and 2 at 1, 1 and 2 at 2.
    for a, b, offset in ((zero, one, 0), (zero, two, 1), (one, two, 2)):
        ka, kb = key(starts[a], offset), key(starts[b], offset)
        sa, sb = np.sort(ka), np.sort(kb)
        place[a] += np.searchsorted(sb, ka)
        place[b] += np.searchsorted(sa, kb)
        if offset == 0:
            place[a] += np.searchsorted(sa, ka)
            place[b] += np.searchsorted(sb, kb)
        elif offset == 1:
            place[b] += np.searchsorted(sb, kb)
    return place


def repeated_starts(texts: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each run's text, a mask of the starts whose 200 bytes also start elsewhere: in another of
    ``texts``, or in another run with the same text (``counts`` of two or more)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    n = sizes - DEPTH + 1
    starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    place = suffix_ranks(np.frombuffer(b"".join(texts), np.uint8), starts)
    again = np.bincount(place, minlength=len(place))[place] > 1
    again |= np.repeat(np.array(counts) > 1, n)
    return np.split(again, np.cumsum(n)[:-1])


def stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each maximal run of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _keyed(df: DataFrame) -> DataFrame:
    """Texts as bytes, with the key that spans go back by: rows alike in it have equal texts."""
    text = text_or_empty()
    return df.select("doc_id", *_key(), text.cast("binary").alias("raw"))


def _key(d: str = "d", t: str = "t") -> tuple[Column, Column]:
    text = text_or_empty()
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(7), text)).alias(d), F.xxhash64(text).alias(t)


def _all_runs(rows: DataFrame) -> DataFrame:
    names = ["d", "t", "core", "whole", "first", "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t, raw = (batch.column(i) for i in range(3))
            d, t, raw = d.to_numpy(), t.to_numpy(), raw.to_pylist()
            at = 0
            while at < len(raw):
                last, size = at, 0
                while last < len(raw) and (last == at or size + len(raw[last]) <= BLOCK):
                    size += len(raw[last])
                    last += 1
                text, first, count, offset, core, whole = runs(raw[at:last])
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(d[at + text]), pa.array(t[at + text]), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(first), pa.array(count * 256 + offset)], names=names)
                at = last

    long_ones = rows.where(F.octet_length("raw") >= DEPTH).select("d", "t", "raw")
    return in_arrow(long_ones, run, ", ".join(f"{n} long" for n in names))


TEXT = "key long, whole long, n long, lo int, hi int, offset int, raw binary"


def _run_texts(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """``TEXT`` of each wanted run, cut from its row. Repeated rows may give the same text again."""
    lists = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("core", "whole", "n", "first", "starts", "offset")).alias("runs"))
    types = arrow_types(TEXT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[tuple[int, int], None] = OrderedDict()
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if row[:2] in seen:
                    continue
                seen[row[:2]] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                raw, flat = row[2].as_py(), row[3].values
                core, whole, n, first, starts, offset = (flat.field(i).to_pylist() for i in range(6))
                out = [raw[a : a + k - 1 + DEPTH] for a, k in zip(first, starts, strict=True)]
                cols = (core, whole, n, [0] * len(core), [STARTS - 1] * len(core), offset, out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[k for k, _ in types])

    return in_arrow(rows.select("d", "t", "raw").join(lists.hint("shuffle_hash"), ["d", "t"]).select("d", "t", "raw", "runs"), cut, TEXT)


def _sorted_buckets(texts: DataFrame) -> DataFrame:
    """``key, whole, a, b``: repeated starts a..b-1 of each distinct run text; bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, before = 0, None

        def flush(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[], [], [], []]
            for (key, whole, _, _), mask in zip(rows, repeated_starts([r[3] for r in rows], [r[2] for r in rows]), strict=True):
                first, end = stretches(mask)
                out[0] += [key] * len(first)
                out[1] += [whole] * len(first)
                out[2] += first.tolist()
                out[3] += end.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "whole", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[:2] == before:  # the same text from a repeated row
                    continue
                before = row[:2]
                if size + len(row[3]) > BUCKET:  # all whole buckets so far; the last one may go on
                    done = next((k for k in range(len(held), 0, -1) if held[k - 1][0] != row[0]), 0)
                    if done:
                        yield from flush(held[:done])
                        held = held[done:]
                        size = sum(len(r[3]) for r in held)
                held.append(row)
                size += len(row[3])
        if held:
            yield from flush(held)

    return in_arrow(texts.select("key", "whole", "n", "raw").repartition("key").sortWithinPartitions("key", "whole"), run, "key long, whole long, a long, b long")


def halves(raw: bytes, lo: int, hi: int, offset: int) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """A run text whose strings have the minimiser at offsets lo..hi, by the upper and lower half of
    these: first string, key, hash of the text, lo, hi, offset of the minimiser in it, text."""
    strings, middle = len(raw) - DEPTH + 1, (lo + hi + 1) // 2
    cut = min(max(offset - middle + 1, 0), strings)
    for a, b, low, high in ((0, cut, middle, hi), (cut, strings, lo, middle - 1)):
        if a < b:
            part, at = raw[a : b - 1 + DEPTH], offset - a
            common = part[at - low : at + DEPTH - high]  # in the same place in all strings of this half
            yield a, _signed(xxhash.xxh64_intdigest(common, low << 8 | high)), _signed(xxhash.xxh64_intdigest(part, 1 << 16)), low, high, at, part


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _heavy(sizes: DataFrame, wide: int) -> DataFrame | None:
    """Keys of the buckets (``key, size``) above the bound; ``None`` where there is none."""
    heavy = stored(sizes.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > wide).select("key"), "op8-heavy")
    return None if heavy.isEmpty() else heavy


def _settled(texts: DataFrame, heavy: DataFrame | None, wide: int) -> DataFrame:
    """``key, whole, a, b`` as from ``_sorted_buckets``; ``heavy`` buckets are halved first."""
    if heavy is None:
        return _sorted_buckets(texts)
    texts = stored(texts.dropDuplicates(["key", "whole"]), "op8-texts")
    names = ["key", "whole", "n", "a", "part_key", "part_whole", "lo", "hi", "offset", "raw"]
    schema = "key long, whole long, n long, a long, part_key long, part_whole long, lo int, hi int, offset int, raw binary"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                out = []
                for key, whole, n, lo, hi, offset, raw in zip(*(c.to_pylist() for c in batch.slice(first, 1024).columns), strict=True):
                    out += [(key, whole, n, *half) for half in halves(raw, lo, hi, offset)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), types, strict=True)], names=names)

    wide_ones = texts.join(heavy, "key", "left_semi").select("key", "whole", "n", "lo", "hi", "offset", "raw")
    parts = stored(in_arrow(wide_ones, run, schema), "op8-parts")
    distinct = parts.groupBy("part_key", "part_whole").agg(F.sum("n").alias("n"), F.min(F.struct("lo", "hi", "offset", "raw")).alias("of"))
    distinct = stored(distinct.select(F.col("part_key").alias("key"), F.col("part_whole").alias("whole"), "n", "of.*"), "op8-halves")
    # A bucket of one offset holds one string, counted; it needs no further halving.
    more = _heavy(distinct.where("lo < hi").select("key", F.octet_length("raw").alias("size")), wide)
    found = _settled(distinct, more, wide).select(F.col("key").alias("part_key"), F.col("whole").alias("part_whole"), F.col("a").alias("from"), "b")
    back = parts.select("key", "whole", "a", "part_key", "part_whole").join(found, ["part_key", "part_whole"])
    return _sorted_buckets(texts.join(heavy, "key", "left_anti")).unionByName(back.select("key", "whole", (F.col("a") + F.col("from")).alias("a"), (F.col("a") + F.col("b")).alias("b")))


def repeated_spans(rows: DataFrame, wide: int = WIDE) -> DataFrame:
    """``d, t, spans``: for each row of ``rows`` (see ``_keyed``) that has any, its repeated starts as
    numbers first * 2^32 + end. Spans of a row are as many as its text allows at most."""
    found = stored(_all_runs(rows), "op8-runs")
    shared = found.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("n > 1")
    # Written, so that the join below deals both sides anew: a frequent core's rows can then be split.
    shared = stored(shared.select("core", (F.col("lo") == F.col("hi")).alias("settled")), "op8-shared")
    starts, offset = F.shiftright("shape", 8).alias("starts"), F.col("shape").bitwiseAND(F.lit(255).cast("long")).cast("int").alias("offset")
    members = stored(found.join(shared, "core").select("d", "t", "core", "whole", "first", starts, offset, "settled"), "op8-members")
    discard(found, shared)
    open_ = members.where("NOT settled")
    distinct = open_.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "first", "starts", "offset")).alias("at"))
    distinct = stored(distinct.select("core", "whole", "n", "at.*"), "op8-distinct")
    heavy = _heavy(distinct.select(F.col("core").alias("key"), (F.col("starts") + DEPTH - 1).alias("size")), wide)
    verdict = _settled(_run_texts(distinct, rows), heavy, wide).withColumnRenamed("key", "core")
    packed = lambda a, b: (F.shiftleft(a, 32) + b).alias("span")
    late = open_.join(verdict, ["core", "whole"]).select("d", "t", packed(F.col("first") + F.col("a"), F.col("first") + F.col("b")))
    sure = members.where("settled").select("d", "t", packed(F.col("first"), F.col("first") + F.col("starts")))
    return sure.unionByName(late).groupBy("d", "t").agg(F.collect_set("span").alias("spans"))


def removed(spans: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each maximal removed run of bytes, from spans of starts."""
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, spans >> 32, 1)
    np.add.at(edge, (spans & 0xFFFFFFFF) - 1 + DEPTH, -1)
    return stretches(np.cumsum(edge[:-1]) > 0)


def _kept(raw: bytes, first: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(raw)], strict=True))


def _spans_of(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy() if column[i].is_valid else np.zeros(0, np.int64)


def digest(df: DataFrame, wide: int = WIDE) -> DataFrame:
    rows = _keyed(df)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (doc, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                raw = raw.as_py()
                first, end = removed(_spans_of(batch.column(2), i), len(raw))
                out.append((doc, len(raw), int((end - first).sum()), len(first), hashlib.sha256(_kept(raw, first, end)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], type=t) for t in types], names=names)

    joined = rows.join(repeated_spans(rows, wide).hint("shuffle_hash"), ["d", "t"], "left").select("doc_id", "raw", "spans")
    return in_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(df: DataFrame, wide: int = WIDE) -> DataFrame:
    """``df`` with repeated strings cut out of ``text``. Only characters whose bytes all go are cut, so
    that texts stay valid; rows and other columns stay."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is not None and len(found):
                raw = text.encode()
                first, end = removed(np.asarray(found, np.int64), len(raw))
                inside = (np.frombuffer(raw + b"a", np.uint8) & 0xC0) == 0x80  # bytes within a character
                first, end = first.copy(), end.copy()
                for k in range(len(first)):
                    while first[k] < end[k] and inside[first[k]]:
                        first[k] += 1
                    while end[k] > first[k] and inside[end[k]]:
                        end[k] -= 1
                text = _kept(raw, first, end).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    spans = repeated_spans(_keyed(df), wide)
    d, t, found = (unused(df, k) for k in ("d", "t", "spans"))
    keyed = df.select("*", *_key(d, t))
    joined = keyed.join(spans.select(F.col("d").alias(d), F.col("t").alias(t), F.col("spans").alias(found)).hint("shuffle_hash"), [d, t], "left")
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col(found)))
    return joined.withColumn("text", text).select(*df.columns)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
