"""SimHash near-duplicates by a Gray-order hierarchical index (operator 9).

Fingerprints of equal texts are one entry. Two fingerprints that differ in at most 3 of 64 bits agree
in one of 4 blocks of 16 bits, so entries meet by block value. The entries of each block value are
sorted by Gray rank, so that neighbours differ in few bits, and runs of neighbours become nodes of a
tree. A node holds the bits that all its entries share beyond those its parent holds already: shared
patterns are factored upwards. A search goes down with the differences accumulated so far and drops
a node, with all entries under it, as soon as they exceed the distance; it also drops nodes whose
entries are all linked with the searching entry already. All searches of a block of entries go down
together, one level at a time, in numpy.

A group yields the links of a spanning star for each of its components, never all pairs. Components
over all groups follow by alternating large-star and small-star steps on tables. Block values with
too many entries for one task are split by the same principle on the bits that are left (at most 3
differences among those 48 leave one of 4 parts alike, and so on), again and again until none has:
entries of a group are distinct, so there are few where few bits are left. Other distances take one
part more than the distance.

Defined results: a null text counts as the empty one; texts without words have fingerprint zero, which
links like any other; texts with fewer words than a shingle have one shingle of all of them; equal
and repeated rows are in one component; a component's id is its least non-null ``doc_id``, null if all
its rows lack one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, documents, in_arrow, map_arrow, stored, text_or_empty, unused

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Children of a node, and searches that go down together.
FANOUT, SEARCHES = 8, 8192
#: Entries of one block value that a task takes at most; groups beyond are split by further bits.
GROUP = 20_000
#: Entries that are indexed together, and rows or pairs that are looked at together, at about.
ENTRIES, ROOM = 120_000, 300_000
#: One in so many texts tells which shingles are common: those that so many of them have. Texts of a
#: shingle that meet in a task, at about.
SAMPLE, COMMON, MEET = 16, 4, 2000
#: Central texts of a large family with which all others are compared.
PIVOTS = 8
#: Common shingles that are kept, and sent to all tasks, at most; a step of sizes (log2) in which their texts meet.
COMMON_MOST, STEP = 200_000, 0.07


def shingle_hashes(text: str, size: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bits that are set in over half the shingle hashes, repeats included; unsigned."""
    return majority(shingle_hashes(text, size))


def majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        set_ += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(h)).tobytes(), "big")


def rehashed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent hashes made from one; the first is the hash itself."""
    if not k:
        return h
    x = (h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each component after links a-b; labels point to places with their own label."""
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


class GrayIndex:
    """Trees over groups of fingerprints, one tree a group, level by level.

    ``group`` and ``codes`` must be distinct as pairs. ``self.codes`` is sorted by group and Gray rank.
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        self.order = order = np.lexsort((gray_rank(codes), group))
        self.group, self.codes = group[order], codes[order]
        #: Per level from the leaves: first child, mask of shared bits, their values, first and last leaf.
        self.levels: list[dict[str, np.ndarray]] = []
        n = len(codes)
        place = np.arange(n)
        of = self.group
        level = {"all": self.codes, "any": self.codes, "low": place, "high": place, "child": place, "last": place + 1}
        self.levels.append(level)
        while len(of) > len(np.unique(of)):
            start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            inside = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
            first = np.flatnonzero(inside % fanout == 0)
            last = np.append(first[1:], len(of))
            level = {"all": np.bitwise_and.reduceat(level["all"], first), "any": np.bitwise_or.reduceat(level["any"], first), "low": level["low"][first], "high": level["high"][last - 1], "child": first, "last": last}
            of = of[first]
            self.levels.append(level)
        self.roots = of
        above = np.zeros(len(of), np.uint64)  # bits held by the ancestors
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            shared = ~(level["all"] ^ level["any"])
            level["bits"], level["value"] = shared & ~above, level["all"]
            if k:
                above = np.repeat(shared, level["last"] - level["child"])

    def connected(self, distance: int) -> np.ndarray:
        """For each place, the least place of its component within its group."""
        label = np.arange(len(self.codes))
        root_of = np.searchsorted(self.roots, self.group)
        for at in range(0, len(self.codes), SEARCHES):
            low = [np.minimum.reduceat(label, level["low"]) for level in self.levels]
            high = [np.maximum.reduceat(label, level["low"]) for level in self.levels]
            seek = np.arange(at, min(at + SEARCHES, len(self.codes)))
            found_a, found_b = [], []
            stack = [(len(self.levels) - 1, seek, root_of[seek], np.zeros(len(seek), np.int64))]
            while stack:
                k, q, node, so_far = stack.pop()
                level = self.levels[k]
                acc = so_far + np.bitwise_count((self.codes[q] ^ level["value"][node]) & level["bits"][node])
                mine = label[q]
                go = (acc <= distance) & (level["high"][node] > q) & ~((low[k][node] == mine) & (high[k][node] == mine))
                q, node, acc = q[go], node[go], acc[go]
                if not len(q):
                    continue
                if k == 0:
                    found_a.append(q)
                    found_b.append(node)
                    continue
                first, count = level["child"][node], level["last"][node] - level["child"][node]
                for part in range(0, len(q), ROOM // FANOUT):  # bounds what is open at once
                    cut = slice(part, part + ROOM // FANOUT)
                    c = count[cut]
                    ends = np.cumsum(c)
                    children = np.arange(ends[-1]) - np.repeat(ends - c, c) + np.repeat(first[cut], c)
                    stack.append((k - 1, np.repeat(q[cut], c), children, np.repeat(acc[cut], c)))
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                label = _united(label, a, b)
        return label

    def stars(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (member, centre) of the codes' components within their groups, as places in what was given."""
        label = self.connected(distance)
        away = np.flatnonzero(label != np.arange(len(self.codes)))
        return self.order[away], self.order[label[away]]


def _widths(bits: int, parts: int) -> list[int]:
    return [bits // parts + (j < bits % parts) for j in range(parts)]


def _turned(value: Column, bits: int, by: int) -> Column:
    """The lowest ``bits`` bits of ``value`` turned left by ``by`` places."""
    if not by:
        return value
    turned = F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, bits - by))
    return turned if bits == 64 else turned.bitwiseAND(F.lit((1 << bits) - 1))


def _parted(value: Column, bits: int, parts: int, key: Column, level: int) -> Column:
    """For each part of ``value``: a key for ``key``, level, part and its bits, hashed to 64 bits (keys
    that meet by chance only make a group larger), the other bits, and how many they are."""
    rows, done = [], 0
    for j, width in enumerate(_widths(bits, parts)):
        turned = _turned(value, bits, done)
        part = F.shiftrightunsigned(turned, bits - width)
        rows.append(F.struct(F.xxhash64(key, F.lit(level), F.lit(j), part).alias("key"), turned.bitwiseAND(F.lit((1 << (bits - width)) - 1)).alias("rest"), F.lit(bits - width).alias("bits")))
        done += width
    return F.explode(F.array(*rows))


def _block_keys(entries: DataFrame, distance: int) -> DataFrame:
    """Each fingerprint under its ``distance + 1`` parts: two within the distance agree in one."""
    return entries.select("space", "fp", _parted(F.col("fp"), 64, distance + 1, F.col("space"), 0).alias("at")).select("space", "at.*", "fp")


def _refined(keys: DataFrame, distance: int, limit: int) -> DataFrame:
    """``keys`` with the rows of groups over ``limit`` under parts of the bits that are left, until no group is."""
    level, settled = 0, None
    while True:
        level += 1
        # Groups of few bits are small, since their fingerprints are distinct.
        hot = keys.where((F.col("bits") > distance) & (F.pow(F.lit(2.0), F.col("bits")) > limit)).groupBy("key", "bits").count().where(F.col("count") > limit)
        hot = stored(hot.select("key", "bits", F.lit(True).alias("hot")), "near-hot")
        bits = sorted(r.bits for r in hot.select("bits").distinct().collect())  # two values at most a level
        if not bits:
            return keys if settled is None else settled.unionByName(keys)
        marked = keys.join(hot, ["key", "bits"], "left")
        rest = marked.where("hot IS NULL").select("space", "key", "rest", "bits", "fp")
        split = [marked.where(F.col("hot") & (F.col("bits") == n)).select("space", "fp", _parted(F.col("rest"), n, distance + 1, F.col("key"), level).alias("at")).select("space", "at.*", "fp") for n in bits]
        settled = rest if settled is None else settled.unionByName(rest)
        keys = stored(reduce(DataFrame.unionByName, split), "near-parts")


def star_links(entries: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links ``space, a, b`` between fingerprints (``space, fp``, distinct) of one space: for each block value,
    a star for each component of its entries. What is connected by all of them is what is connected at ``distance``."""
    keys = _refined(_block_keys(entries.withColumn("space", F.col("space").cast("long")), distance), distance, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        size = 0

        def flush(upto: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, size
            cols = [np.concatenate(x) for x in zip(*kept, strict=True)]
            kept, size = [], 0
            if upto:  # the last group may go on
                done = np.searchsorted(cols[0], cols[0][-1])
                kept, size = [[c[done:] for c in cols]], len(cols[0]) - done
                cols = [c[:done] for c in cols]
            order = np.lexsort((cols[2], cols[0]))
            key, fp, space = (c[order] for c in cols)
            same = (key[1:] == key[:-1]) & (space[1:] == space[:-1])  # spaces whose keys meet by chance stay apart
            again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if again.any():
                one = np.cumsum(np.concatenate([[False], ~same]))[again]
                fp, space = fp[again], space[again]
                a, b = GrayIndex(one, fp.view(np.uint64)).stars(distance)
                yield pa.RecordBatch.from_arrays([pa.array(space[a]), pa.array(fp[a]), pa.array(fp[b])], names=["space", "a", "b"])

        for batch in batches:
            kept.append([batch.column(k).to_numpy() for k in range(3)])
            size += batch.num_rows
            if size > ENTRIES and kept[-1][0][-1] != kept[0][0][0]:
                yield from flush(True)
        if kept:
            yield from flush(False)

    return in_arrow(keys.repartition("key").sortWithinPartitions("key").select("key", "fp", "space"), run, "space long, a long, b long").distinct()


def components(links: DataFrame, name: str = "op9", rounds: int | None = None) -> DataFrame:
    """``node, root`` of every node in ``links`` (``a, b``), root the least node of its component.

    Alternating large-star and small-star steps: each hangs a node's neighbours on the least one.
    Minima are partial sums; nodes with very many neighbours are only ever joined, not gathered. Steps
    go on until one changes nothing; more than ``rounds``, where given, are an error.
    """

    def hung(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.join(least, "u")

    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links")
    state = _state(edges)
    done = 0
    while state[0]:
        if done == rounds:
            raise RuntimeError(f"links are not settled after {rounds} rounds")
        done += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hung(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        passed, edges = edges, stored(small.where("u <> v").distinct(), f"{name}-links")
        discard(passed)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


def fingerprints(df: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of each row of ``df`` (``doc_id``, ``text``); fp signed."""

    def block(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "fp": [signed(fingerprint(t, size)) for t in c["text"]]}

    return map_arrow(df.select("doc_id", text_or_empty().alias("text")), block, "doc_id long, fp long", ["doc_id", "text"])


def grouped(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``prints`` (``doc_id``, ``fp``)."""
    entries = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "op9-entries")
    roots = components(star_links(entries.select(F.lit(0).alias("space"), "fp"), distance).select("a", "b"))
    placed = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(ids, "root").select("fp", "component_id"), "fp")


class _Family:
    """Texts of one candidate family: components by the Jaccard similarity of their shingle sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets

    def roots(self, similarity: float) -> np.ndarray:
        """For each text the first text of its component. A search spreads from one text to all that
        are like it and not reached yet; each step compares one set with those still open at once."""
        n = len(self.sets)
        root = np.full(n, -1)
        for start in range(n):
            if root[start] >= 0:
                continue
            root[start] = start
            edge = [start]
            while edge:
                open_ = np.flatnonzero(root < 0)
                if not len(open_):
                    break
                mine = self.sets[edge.pop()]
                sizes = np.array([len(self.sets[k]) for k in open_])
                # Sets whose sizes differ too much cannot be alike.
                fit = (np.minimum(sizes, len(mine)) >= similarity * np.maximum(sizes, len(mine))) & (sizes > 0)
                open_, sizes = open_[fit], sizes[fit]
                if not len(open_) or not len(mine):
                    continue
                every = np.concatenate([self.sets[k] for k in open_])
                at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
                shared = np.add.reduceat((mine[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                like = open_[shared >= similarity * (sizes + len(mine) - shared) - 1e-9]
                root[like] = start
                edge += like.tolist()
        return root


def _shingled(members: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """``t, family, shingles``: the shingle set of each member (``t, d, family``), from its row's text."""
    texts = rows.select("t", "d", "text").join(members.select("t", "d", "family").hint("shuffle_hash"), ["t", "d"])

    def block(c: dict[str, list]) -> dict[str, list]:
        return {"t": c["t"], "family": c["family"], "shingles": [np.unique(shingle_hashes(x, shingle)).tobytes() for x in c["text"]]}

    return map_arrow(texts, block, "t long, family long, shingles binary", ["t", "family", "text"])


def _verified(members: DataFrame, rows: DataFrame, similarity: float, shingle: int, family_bytes: int) -> DataFrame:
    """``a, b``: links between similar texts within candidate families (``members``: ``t, d, size, fp,
    family``). In a family that fits a task all texts that are connected by similar pairs are; texts of a
    larger one are linked with its central texts only, and the other pairs are left to ``_near_pairs``."""
    large = members.groupBy("family").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > family_bytes).select("family")
    large = stored(large, "near-large")
    inside = _shingled(members.join(large, "family", "left_anti"), rows, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            root = _Family([s for _, s in held]).roots(similarity)
            away = np.flatnonzero(root != np.arange(len(held)))
            if len(away):
                ids = np.array([t for t, _ in held], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(ids[root[away]])], names=["a", "b"])

        for batch in batches:
            for key, t, s in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if key != family:
                    if len(held) > 1:
                        yield from flush()
                    family, held = key, []
                if not held or held[-1][0] != t:  # rows alike in id and text are one
                    held.append((t, np.frombuffer(s, np.uint64)))
        if len(held) > 1:
            yield from flush()

    links = in_arrow(inside.select("family", "t", "shingles").repartition("family").sortWithinPartitions("family", "t"), run, "a long, b long")
    if large.isEmpty():
        return links
    return links.unionByName(_central(members.join(large, "family", "left_semi"), rows, similarity, shingle))


def _central(members: DataFrame, rows: DataFrame, similarity: float, shingle: int, pivots: int = PIVOTS) -> DataFrame:
    """``a, b``: links of members with up to ``pivots`` texts of their family, those whose fingerprints are
    the nearest to the majority of the family's bits."""
    members = stored(members, "near-large-members")
    bit = lambda i: F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1).cast("long"))
    sums = members.groupBy("family").agg(F.count("*").alias("n"), *(F.sum(bit(i)).alias(f"b{i}") for i in range(64)))
    parts = [F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(signed(1 << i))).otherwise(F.lit(0).cast("long")) for i in range(64)]
    middle = sums.select("family", reduce(lambda a, b: a.bitwiseOR(b), parts).alias("middle"))
    far = members.join(middle, "family").withColumn("far", F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))))
    nearest = far.groupBy("family").agg(F.array_distinct(F.array(*(F.min(F.struct("far", F.xxhash64("t", F.lit(i)).alias("h"), "t"))["t"] for i in range(pivots)))).alias("ts"))
    sets = stored(_shingled(members, rows, shingle).dropDuplicates(["t"]), "near-large-sets")
    chosen = sets.join(nearest.select("family", F.explode("ts").alias("t")), ["family", "t"], "left_semi")
    chosen = chosen.groupBy("family").agg(F.collect_list(F.struct("t", "shingles")).alias("chosen"))  # as many as ``pivots``

    def block(c: dict[str, list]) -> dict[str, list]:
        a, b = [], []
        for t, own, others in zip(c["t"], c["shingles"], c["chosen"], strict=True):
            own = np.frombuffer(own, np.uint64)
            for other in others:
                if other["t"] != t and _like(own, np.frombuffer(other["shingles"], np.uint64), similarity):
                    a.append(t)
                    b.append(other["t"])
        return {"a": a, "b": b}

    return map_arrow(sets.join(chosen, "family"), block, "a long, b long", ["t", "shingles", "chosen"], rows=64)


def _like(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, distinct) are at least so similar; empty ones are not."""
    if not len(x) or not len(y) or min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def _families(texts: DataFrame, prints: int, distance: int) -> DataFrame:
    """``t, family`` of the texts (``t, fp0, fp1, ...``) that any of the fingerprints connects to others.

    Texts and fingerprints are nodes: a text hangs on each of its fingerprints that it shares or that
    is linked, and linked fingerprints hang together.
    """
    own = texts.select("t", F.posexplode(F.array(*(f"fp{k}" for k in range(prints)))).alias("space", "fp")).withColumn("space", F.col("space").cast("long"))
    counted = stored(own.groupBy("space", "fp").count(), "near-counted")
    links = stored(star_links(counted.select("space", "fp"), distance), "near-stars")
    node = lambda c: F.xxhash64("space", c)
    ends = [links.select("space", F.col(c).alias("fp")) for c in "ab"]
    live = reduce(DataFrame.unionByName, [*ends, counted.where("count > 1").select("space", "fp")]).distinct()
    edges = links.select(node("a").alias("a"), node("b").alias("b")).unionByName(own.join(live, ["space", "fp"]).select(F.col("t").alias("a"), node("fp").alias("b")))
    found = components(edges, "near-families")
    whole = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    return texts.select("t").join(whole.select(F.col("node").alias("t"), F.col("root").alias("family")), "t")


def _prefix(h: np.ndarray, similarity: float, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first elements of the set ``h`` (sorted, distinct) in the order of all sets: by ``count`` where
    an element is in ``common``, then by value. Two sets that are alike share one of them."""
    n = len(h)
    size = n - int(np.ceil(similarity * n - 1e-6)) + 1
    if n and len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.lexsort((h, np.where(common[at] == h, count[at], 0)))]
    return h[:size] if n else h


def _common_shingles(rows: DataFrame, shingle: int, sample: int, most: int = COMMON_MOST) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of one in ``sample`` texts have, sorted, and in how many of those: at most
    ``most``, the most common ones, all from a least class of counts up. This decides how much is
    compared, not what is found."""

    def block(c: dict[str, list]) -> dict[str, list]:
        sets = [np.unique(shingle_hashes(x, shingle)) for x in c["text"]]
        return {"shingle": np.concatenate(sets).view(np.int64) if sets else []}

    taken = rows.where(F.pmod(F.xxhash64("t", F.lit(11)), F.lit(sample)) == 0).dropDuplicates(["t"])
    counted = map_arrow(taken, block, "shingle long", ["text"]).groupBy("shingle").count().where(F.col("count") >= COMMON)
    found = stored(counted.withColumn("class", F.floor(F.log2("count") * 16).cast("int")), "near-common")
    least, sum_ = None, 0
    for r in sorted(found.groupBy("class").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):  # few classes
        sum_ += r.n
        if sum_ > most:
            break
        least = r["class"]
    chosen = found.where(F.col("class") >= least if least is not None else F.lit(False)).select("shingle", "count").toArrow()
    discard(found)
    values, count = chosen.column(0).to_numpy().view(np.uint64), chosen.column(1).to_numpy()
    order = np.argsort(values)
    return values[order], count[order]


def _size_range(n: np.ndarray, place: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest size of a set that can be like one of ``n`` elements, if the element at ``place``
    is the first that both have: n - place and all of the other's at most are shared."""
    low = np.ceil(similarity * n - 1e-6).astype(np.int64)
    high = np.floor((n - place) * (1 + similarity) / similarity - n + 1e-6).astype(np.int64)
    return low, high


def _meetings(key: np.ndarray, t: np.ndarray, root: np.ndarray, rank: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float, probes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts of one ``key`` and different roots whose sizes and places allow that they are alike,
    in blocks. The text of the lesser root (by ``rank``, its number of texts) looks for the other one among
    the sizes that it allows, so texts of a large root don't look for each other. With ``probes``, only
    those that it marks look, and only for the others."""
    order = np.lexsort((n, key))
    key, t, root, rank, n, place = (x[order] for x in (key, t, root, rank, n, place))
    ahead = np.lexsort((root, rank))
    new = np.concatenate([[False], (rank[ahead][1:] != rank[ahead][:-1]) | (root[ahead][1:] != root[ahead][:-1])])
    level = np.empty(len(t), np.int64)
    level[ahead] = np.cumsum(new)
    start = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(start) - 1
    top = np.maximum.reduceat(level, np.flatnonzero(start))[group]
    low, high = _size_range(n, place, similarity)
    look = (level < top) & (high >= low)
    if probes is not None:
        probes = probes[order]
        look = probes & (high >= low)
    at = np.flatnonzero(look)
    line = group << 32 | n.astype(np.int64)
    first = np.searchsorted(line, group[at] << 32 | low[at], "left")
    last = np.searchsorted(line, group[at] << 32 | np.minimum(high[at], (1 << 32) - 1), "right")
    many = np.maximum(last - first, 0)
    ends = np.cumsum(many)
    done = 0
    while done < len(at):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + ROOM, "right")))
        part = slice(done, upto)
        count = many[part]
        a = np.repeat(at[part], count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[part], count)
        ok = (level[a] < level[b]) & (n[a] <= high[b])
        if probes is not None:
            ok &= ~probes[b]
        if ok.any():
            yield t[a[ok]], t[b[ok]]
        done = upto


def _part(h: np.ndarray) -> np.ndarray:
    """16 bits of each element of a set that is in the lowest quarter of all values."""
    return (h[h < np.uint64(1 << 62)] >> np.uint64(46)).astype(np.uint16)


def _parts_allow(x: np.ndarray, y: np.ndarray, sizes: int, similarity: float) -> bool:
    """Whether sets of so many elements together can be alike if these are their parts: what differs
    there differs in all. Values that meet by chance only let more pairs pass."""
    return len(x) + len(y) - 2 * min(np.isin(x, y).sum(), np.isin(y, x).sum()) <= (1 - similarity) / (1 + similarity) * sizes + 1e-6


def _near_pairs(rows: DataFrame, roots: DataFrame, similarity: float, shingle: int, sample: int = SAMPLE, meet: int = MEET) -> DataFrame:
    """Pairs ``a, b`` of texts of different ``root`` (``roots``: ``t, root``) among which are all whose
    shingle sets are at least so similar.

    Each set has a prefix in one order of all shingles, rare ones first; similar sets share an element
    of their prefixes. Texts that share one meet, and pairs that sizes and places rule out are not made.
    Common shingles are told apart by size as well (see ``_common_meetings``). At last a quarter of both
    sets is compared, in 16 bits an element, which rules out nearly all texts that have only a passage in common.
    """
    common, count = _common_shingles(rows, shingle, sample)
    held = rows.sparkSession.sparkContext.broadcast((common, count))

    def block(c: dict[str, list]) -> dict[str, list]:
        sets = [np.unique(shingle_hashes(x, shingle)) for x in c["text"]]
        return {"t": c["t"], "n": [len(h) for h in sets], "prefix": [_prefix(h, similarity, *held.value).tobytes() for h in sets], "part": [_part(h).tobytes() for h in sets]}

    sizes = roots.groupBy("root").agg(F.count("*").alias("rank"))
    made = map_arrow(rows, block, "t long, n int, prefix binary, part binary", ["t", "text"]).where("n > 0").dropDuplicates(["t"])
    prefixes = stored(made.join(roots.join(sizes, "root"), "t"), "near-prefixes")
    names = ["key", "t", "root", "rank", "n", "place"]
    schema = "key long, t long, root long, rank long, n int, place int"

    def spread(often: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common, count = held.value
            frequent = common[count * sample > meet]
            for batch in batches:
                for first in range(0, batch.num_rows, 4096):
                    part = batch.slice(first, 4096)
                    t, root, rank, n = (part.column(k).to_numpy() for k in range(4))
                    sets = [np.frombuffer(b, np.uint64) for b in part.column(4).to_pylist()]
                    size = np.array([len(x) for x in sets])
                    key, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                    place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
                    here = np.isin(key, frequent) if often else ~np.isin(key, frequent)
                    key, of, place = key[here], of[here], place[here]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(t[of]), pa.array(root[of]), pa.array(rank[of]), pa.array(n[of].astype(np.int32)), pa.array(place.astype(np.int32))], names=names)

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        size = 0

        def flush(upto: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, size
            cols = [np.concatenate(x) for x in zip(*kept, strict=True)]
            kept, size = [], 0
            if upto:  # the last group may go on
                done = int(np.searchsorted(cols[0], cols[0][-1]))
                kept, size = [[c[done:] for c in cols]], len(cols[0]) - done
                cols = [c[:done] for c in cols]
            yield from _as_pairs(_meetings(*cols, similarity))

        for batch in batches:
            kept.append([batch.column(k).to_numpy() for k in range(6)])
            size += batch.num_rows
            if size > ROOM and kept[-1][0][-1] != kept[0][0][0]:
                yield from flush(True)
        if size:
            yield from flush(False)

    columns = prefixes.select("t", "root", "rank", "n", "prefix")
    met = in_arrow(in_arrow(columns, spread(False), schema).repartition("key").sortWithinPartitions("key"), run, "a long, b long")
    if (count * sample > meet).any():
        met = met.unionByName(_common_meetings(in_arrow(columns, spread(True), schema), similarity, meet))
    met = stored(met.distinct(), "near-met")
    side = lambda k: prefixes.select(F.col("t").alias(k), F.col("n").alias(f"n_{k}"), F.col("part").alias(f"of_{k}"))

    def allowed(c: dict[str, list]) -> dict[str, list]:
        ok = [_parts_allow(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n, similarity) for x, y, n in zip(c["of_a"], c["of_b"], c["n"], strict=True)]
        return {k: [v for v, good in zip(c[k], ok, strict=True) if good] for k in ("a", "b")}

    return map_arrow(met.join(side("a"), "a").join(side("b"), "b").withColumn("n", F.col("n_a") + F.col("n_b")), allowed, "a long, b long", ["a", "b", "n", "of_a", "of_b"])


def _as_pairs(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of each block, the lesser text first."""
    for x, y in found:
        a, b = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def _common_meetings(rows: DataFrame, similarity: float, meet: int) -> DataFrame:
    """Pairs ``a, b`` as from ``_meetings`` for keys that very many texts have.

    A key's texts are dealt by classes of size, and those of a class into blocks of about ``meet``. A text
    looks for others in the classes that its size and place allow, in each of their blocks, and only where a
    larger root than its own is: the copies of one text that are found to be so already, however many, look
    for nobody. A task holds one block; those that look pass by.
    """
    rows = stored(rows.withColumn("class", F.floor(F.log2("n") / STEP).cast("int")), "near-frequent")
    top = F.max(F.struct("rank", "root")).alias("top")
    classes = rows.groupBy("key", "class").agg(F.ceil(F.count("*") / meet).cast("int").alias("blocks"), top)
    own = F.struct(F.col("rank"), F.col("root"))
    low, high = F.ceil(similarity * F.col("n") - 1e-6), F.floor((F.col("n") - F.col("place")) * ((1 + similarity) / similarity) - F.col("n") + 1e-6)
    of = lambda c: F.floor(F.log2(c) / STEP).cast("int")
    task = lambda block: F.xxhash64("key", "class", block).alias("task")
    carried = ["t", "root", "rank", "n", "place"]
    there = rows.join(classes, ["key", "class"]).select(task(F.pmod(F.xxhash64("t", F.lit(5)), F.col("blocks")).cast("int")), *carried, F.lit(False).alias("probes"))
    seek = rows.where((high >= low) & (low > 0)).select("key", *carried, F.explode(F.sequence(of(low), of(high))).alias("class"))
    seek = seek.join(classes, ["key", "class"]).where(own < F.col("top"))
    seek = seek.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(task(F.col("block").cast("int")), *carried, F.lit(True).alias("probes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["task", *carried, "probes"]
        held: list[pa.RecordBatch] = []  # the texts of the task at hand that others look for
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            for first, last in zip(cuts, [*cuts[1:], len(at)], strict=True):
                part = batch.slice(int(first), int(last - first))
                if held and held[0].column(0)[0] != part.column(0)[0]:
                    held = []
                probing = part.filter(part.column(6))
                rest = part.filter(pa.compute.invert(part.column(6)))
                if rest.num_rows:
                    held.append(rest)
                if probing.num_rows and held:
                    both = pa.Table.from_batches([*held, probing]).combine_chunks()
                    cols = {n: both.column(n).to_numpy() for n in names}
                    yield from _as_pairs(_meetings(cols["task"], *(cols[c] for c in carried), similarity, cols["probes"]))

    # Those that others look for come first in each task.
    return in_arrow(there.unionByName(seek).repartition("task").sortWithinPartitions("task", "probes"), run, "a long, b long")


def _similar(pairs: DataFrame, rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The ``pairs`` (``a, b``) of texts whose shingle sets are at least so similar."""
    wanted = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct()

    def block(c: dict[str, list]) -> dict[str, list]:
        return {"t": c["t"], "shingles": [np.unique(shingle_hashes(x, shingle)).tobytes() for x in c["text"]]}

    texts = rows.select("t", "text").join(wanted, "t", "left_semi")
    sets = stored(map_arrow(texts, block, "t long, shingles binary", ["t", "text"]).dropDuplicates(["t"]), "near-sets")
    side = lambda k: sets.select(F.col("t").alias(k), F.col("shingles").alias(f"of_{k}"))

    def alike(c: dict[str, list]) -> dict[str, list]:
        like = [_like(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(c["of_a"], c["of_b"], strict=True)]
        return {"a": [a for a, ok in zip(c["a"], like, strict=True) if ok], "b": [b for b, ok in zip(c["b"], like, strict=True) if ok]}

    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), alike, "a long, b long", ["a", "b", "of_a", "of_b"])


def keep_one_of_near(df: DataFrame, shingle: int = 5, similarity: float = 0.8, coarse: int = 2, distance: int = 7, prints: int = 3, family_bytes: int = 4_000_000, naming: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``df`` (``doc_id``, ``text``, ...) with one row of each group of near-duplicates: the one of the
    least ``doc_id``. Two texts are linked if the sets of their ``shingle``-word shingles have a Jaccard
    similarity of at least ``similarity``; groups are what links connect, and equal texts.

    A first pass takes families connected by any of ``prints`` independent SimHash fingerprints of
    ``coarse``-word shingles at ``distance``: a copy with scattered edits of single words at a
    similarity of 0.8 on five words has about 6 bits in 64 changed, unrelated texts hardly ever less
    than 12. Copies that were cut, extended or changed in one block have more, so a second pass takes all
    pairs of texts not connected yet that share a rare shingle (see ``_near_pairs``), which leaves out
    no similar pair. Links are decided on the shingle sets themselves in both.
    Of rows alike in ``doc_id`` and text any one stays; a null ``doc_id`` comes last in its group. Texts
    are named by a 64-bit hash (``naming``); where a second one shows that texts share it, all but one get
    another name.
    """
    columns, (dn, tn) = df.columns, (unused(df, k) for k in ("d", "t"))
    d, text = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), text_or_empty()
    names = [f"fp{k}" for k in range(prints)]

    def block(c: dict[str, list]) -> dict[str, list]:
        hashes = [shingle_hashes(x, coarse) for x in c["text"]]
        return {"d": c["d"], "t": c["t"], "again": c["again"], "size": [len(x) for x in c["text"]], **{n: [signed(majority(rehashed(h, k))) for h in hashes] for k, n in enumerate(names)}}

    rows = df.select(d.alias("d"), naming(text).alias("t"), F.xxhash64(F.lit(13), text).alias("again"), text.alias("text"))
    schema = ", ".join(f"{n} long" for n in ("d", "t", "again", "size", *names))
    printed = stored(map_arrow(rows, block, schema, ["d", "t", "again", "text"]), "near-prints")
    every = (F.min("d").alias("d"), F.max("size").alias("size"), *(F.min(n).alias(n) for n in names))
    texts = stored(printed.groupBy("t").agg(*every, F.min("again").alias("one"), F.max("again").alias("other")), "near-texts")
    named, shared = df.select("*", d.alias(dn), naming(text).alias(tn)), texts.where("one <> other")
    if not shared.isEmpty():
        fresh = lambda one, again, t: F.when(F.col(one) < F.col(again), F.xxhash64(again, t)).otherwise(F.col(t))
        renamed = lambda x: x.join(shared.select("t", "one"), "t", "left").withColumn("t", fresh("one", "again", "t")).drop("one")
        again, one = unused(named, "again"), unused(named, "one")
        keys = shared.select(F.col("t").alias(tn), F.col("one").alias(one))
        named = named.withColumn(again, F.xxhash64(F.lit(13), text)).join(keys, tn, "left").withColumn(tn, fresh(one, again, tn)).drop(again, one)
        rows = renamed(rows)
        texts = stored(renamed(printed).groupBy("t").agg(*every), "near-texts")
    rows = rows.drop("again")
    members = stored(texts.select("t", "d", "size", F.col("fp0").alias("fp")).join(_families(texts, prints, distance), "t"), "near-members")
    links = components(_verified(members, rows, similarity, shingle, family_bytes), "near")
    placed = lambda found: texts.join(found.withColumnRenamed("node", "t"), "t", "left").select("t", "d", F.coalesce("root", "t").alias("root"))
    pairs = stored(_near_pairs(rows, placed(links).select("t", "root"), similarity, shingle), "near-pairs")
    links = links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_similar(pairs, rows, similarity, shingle))
    placed = placed(components(links, "near"))
    first = placed.groupBy("root").agg(F.min(F.struct("d", "t")).alias("kept")).select(F.col("kept.d").alias(dn), F.col("kept.t").alias(tn))
    return named.join(first, [dn, tn], "left_semi").dropDuplicates([dn, tn]).select(*columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(fingerprints(documents(spark, sf_dir)), "op9-prints")
    return grouped(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
