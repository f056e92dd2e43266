"""Language-model scores by the marginal likelihood of subword lattices (operator 6).

Texts are lower-cased (A-Z only) and cut into words at white space; each document ends with an end
token. A word, with a space before it, can be segmented into entries of an existing subword
vocabulary in many ways. A unigram model gives each entry a probability, and the word's is the sum
over all its segmentations: a forward recursion in log space over the lattice of entries. The
document's is the product over its words and the end. Entries start from the vocabulary's own order
(its scores: the earlier an entry, the likelier) and are fitted by expectation maximisation on the
words of the training part, counted over all its documents.

Words are counted with partial sums, and each distinct word's probability is computed once. Counts and
probabilities of the most frequent words, a fixed number of words and bytes, go to all tasks; those of
all other words are joined to the few words of a document that need them. No word is dropped, and no
key of that join is frequent, however long it is.

Defined results: a null text counts as the empty one and has just the end token; a null ``doc_id``
counts as empty text in the split (so the row is held out); repeated rows are scored alike, each in
its own row; without any training document all counts are zero and base scores come from smoothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, log10

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe
from sparkloom.llm.bpe_codec import BYTE_BPE
from sparkloom.llm.common import discard, documents, in_arrow, stored, text_or_empty

FOLDS, ALPHA = 10, 0.1
#: Words, and their bytes, whose counts and probabilities go to every task: under 20 MB.
TOP_WORDS, TOP_BYTES = 200_000, 10_000_000
ROUNDS = 3
SMOOTHING = 0.01
#: Distinct words that a task holds before it passes on its partial counts.
HELD_WORDS = 400_000
#: The end token in word tables; words are never empty.
END = b""
_FACTOR, _SLOT_BITS = 0x9E3779B97F4A7C15, 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and six white-space signs


class Lattice:
    """Entries with log probabilities (natural), and recursions over the segmentations of words.

    Words of one length are taken together: for each entry length, the rolling hashes of all their
    substrings are looked up in a table at once, and the recursions run over columns.
    """

    def __init__(self, logp: dict[bytes, float]):
        self.entries = sorted(logp)
        self.logp = np.array([logp[e] for e in self.entries])
        self.longest = max(map(len, self.entries), default=1)
        keys = np.zeros(len(self.entries), np.uint64)
        for k, e in enumerate(self.entries):
            h = 0
            for c in e:
                h = (h * _FACTOR + c + 1) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two entries have the same hash")
        # One slot by the hash's upper bits; what finds its slot taken goes to the sorted rest.
        self.keys = np.append(keys, np.uint64(0))
        slots = self._slot(keys)
        _, first = np.unique(slots, return_index=True)
        self.table = np.full(1 << _SLOT_BITS, len(keys), np.int32)
        self.table[slots[first]] = first
        taken = np.setdiff1d(np.arange(len(keys)), first)
        self.crowded = np.zeros(1 << _SLOT_BITS, bool)
        self.crowded[slots[taken]] = True
        order = taken[np.argsort(keys[taken])]
        self.rest, self.rest_keys = order, keys[order]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _SLOT_BITS)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of the entry with each hash; the number of entries where there is none."""
        slot = self._slot(h)
        at = self.table[slot]
        missed = self.keys[at] != h
        at[missed] = len(self.entries)
        again = np.flatnonzero(missed & self.crowded[slot])
        if len(again):
            k = np.minimum(np.searchsorted(self.rest_keys, h[again]), len(self.rest_keys) - 1)
            hit = self.rest_keys[k] == h[again]
            at[again[hit]] = self.rest[k[hit]]
        return at

    def _edges(self, data: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """By length: the entry at each start of each word (rows: starts, columns: words)."""
        n = len(data)
        found, h = [], np.zeros_like(data)
        for size in range(1, min(n, self.longest) + 1):
            h = h[: n - size + 1] * np.uint64(_FACTOR) + data[size - 1 :] + np.uint64(1)
            at = self._find(h.ravel()).reshape(h.shape)
            if (at < len(self.entries)).any():
                found.append((size, at))
        return found

    def _forward(self, edges: list[tuple[int, np.ndarray]], n: int, words: int) -> np.ndarray:
        """Log of the summed probability of all segmentations of each prefix (rows: prefix ends)."""
        logp = np.append(self.logp, -np.inf)
        alpha = np.zeros((n + 1, words))
        for j in range(1, n + 1):
            into = np.stack([alpha[j - size] + logp[at[j - size]] for size, at in edges if size <= j])
            top = into.max(axis=0)
            alpha[j] = top + np.log(np.exp(into - top).sum(axis=0))
        return alpha

    def _blocks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words of one length, and their bytes with a space before them, in columns."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cuts):
            n = int(sizes[group[0]]) + 1 if len(group) else 0
            step = max(1, 400_000 // max(n, 1))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                data = np.frombuffer(b"".join([b" " + words[i] for i in part]), np.uint8).reshape(len(part), n)
                yield part, np.ascontiguousarray(data.T).astype(np.uint64)

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of each word: the sum over all its segmentations."""
        out = np.zeros(len(words))
        for part, data in self._blocks(words):
            out[part] = self._forward(self._edges(data), len(data), data.shape[1])[-1] / log(10)
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each entry over all occurrences of the words: probabilities of passing
        each place go down from the end, shared out among the entries that lead there."""
        uses = np.zeros(len(self.entries) + 1)
        logp = np.append(self.logp, -np.inf)
        for part, data in self._blocks(words):
            n, edges = len(data), self._edges(data)
            alpha = self._forward(edges, n, data.shape[1])
            passes = np.zeros_like(alpha)
            passes[n] = counts[part]
            for j in range(n, 0, -1):
                for size, at in edges:
                    if size <= j:
                        entry = at[j - size]
                        share = passes[j] * np.exp(alpha[j - size] + logp[entry] - alpha[j])
                        passes[j - size] += share
                        np.add.at(uses, entry, share)
        return uses[:-1]


def entries(path: str) -> list[bytes]:
    """Entries of the vocabulary that can occur in a lower-cased word with a space before it."""
    ids = bpe.vocabulary(path).ids
    inner = lambda t: t[1:] if t[:1] == b" " else t
    return [t for t in sorted(ids, key=ids.get) if t == t.lower() and len((inner(t) + b"x").split()) == 1 and inner(t)[:1].strip() == inner(t)[:1]]


def prior(path: str) -> dict[bytes, float]:
    """Log probabilities by the vocabulary's order: in inverse proportion to an entry's place."""
    found = entries(path)
    mass = sum(1 / (k + 10) for k in range(len(found)))
    return {t: -log(k + 10) - log(mass) for k, t in enumerate(found)}


def word_counts(rows: DataFrame) -> DataFrame:
    """``word binary, c long`` of all words in ``rows`` (``text``, ``out``), the end token included; ``c``
    counts rows that are not held out, so it is zero for words that only held-out rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, out in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    words.append(END)
                    if out:
                        for w in words:
                            held.setdefault(w, 0)
                    else:
                        held.update(words)
                if len(held) > HELD_WORDS:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    return in_arrow(rows.select(text_or_empty().alias("text"), "out"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(held: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])


def _many(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches put together, as words of one length are worked on at once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def scored_words(counts: DataFrame, logp: dict[bytes, float]) -> DataFrame:
    """``counts`` with ``m``: log10 of each word's probability, that of the end included."""
    sent = counts.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = dict(sent.value)
        end = inner.pop(END) / log(10)
        lattice = Lattice(inner)
        for batch in _many(batches):
            words = batch.column(0).to_pylist()
            real = [k for k, w in enumerate(words) if w != END]
            m = np.full(len(words), end)
            m[real] = lattice.marginals([words[k] for k in real])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m)], names=["word", "c", "m"])

    return in_arrow(counts, run, "word binary, c long, m double")


def frequent(scored: DataFrame) -> dict[bytes, tuple[int, float]]:
    """Counts and scores of the most frequent words, at most ``TOP_WORDS`` of ``TOP_BYTES``: all from a
    least class of counts up. Classes are sixteenths of a power of two, so their sizes are few rows; sorting
    for a limit instead would bring that many rows from every partition to the driver."""
    used = scored.where("c > 0").withColumn("class", F.floor(F.log2("c") * 16).cast("int"))
    sizes = used.groupBy("class").agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    least, words, size = None, 0, 0
    for r in sorted(sizes, key=lambda r: -r["class"]):
        words, size = words + r["words"], size + r["bytes"]
        if words > TOP_WORDS or size > TOP_BYTES:
            break
        least = r["class"]
    if least is None:
        return {}
    found = used.where(F.col("class") >= least).select("word", "c", "m").toArrow()
    return {w: (c, m) for w, c, m in zip(*(found[k].to_pylist() for k in ("word", "c", "m")), strict=True)}


def fit(counts: DataFrame, path: str, rounds: int = ROUNDS) -> dict[bytes, float]:
    """Log probabilities of the entries after ``rounds`` of expectation maximisation on all counted
    words. Only sums by entry, at most as many as the vocabulary has, come to the driver."""
    spark = counts.sparkSession
    logp, ends = prior(path), 0.0
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(logp)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(sent.value)
            uses, ends = np.zeros(len(lattice.entries)), 0
            for batch in _many(batches):
                words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                real = [k for k, w in enumerate(words) if w != END]
                ends += int(c.sum() - c[real].sum())
                uses += lattice.expected([words[k] for k in real], c[real].astype(np.float64))
            some = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array([*(lattice.entries[k] for k in some), END], pa.binary()), pa.array([*uses[some].tolist(), float(ends)], pa.float64())], names=["entry", "uses"])

        summed = in_arrow(counts, run, "entry binary, uses double").groupBy("entry").agg(F.sum("uses").alias("uses")).collect()
        uses = {bytes(r.entry): r.uses for r in summed}
        ends = uses.pop(END, 0.0)
        total = sum(uses.values()) + ends + SMOOTHING * (len(logp) + 1)
        logp = {t: log((uses.get(t, 0.0) + SMOOTHING) / total) for t in logp}
        logp[END] = log((ends + SMOOTHING) / total)
    return logp


def score(df: DataFrame, path: str | None = None) -> DataFrame:
    """Base and model scores of each row of ``df`` (``doc_id``, ``text``); learns from its training part."""
    path = path or public_tokenizers.path(BYTE_BPE)
    spark = df.sparkSession
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    rows = df.select("doc_id", text_or_empty().alias("text"), out.alias("out"))
    counts = stored(word_counts(rows), "op6-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    scored = stored(scored_words(counts, fit(counts.where("c > 0"), path)), "op6-words")
    discard(counts)
    floor = float(n + ALPHA * (v + 1))
    top = {w: (c, log10((c + ALPHA) / floor), m) for w, (c, m) in frequent(scored).items()}
    sent = spark.sparkContext.broadcast(top)
    names = ["row", "doc_id", "word", "cnt", "held_out", "n_tokens", "n_known", "base_score", "score"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, row = sent.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made: list[tuple] = []
                for doc, text, out in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = words_of(text)
                    words.append(END)
                    base = model = known = 0
                    rare: list[tuple[bytes, int]] = []
                    for w, k in Counter(words).items():
                        if (found := top.get(w)) is not None:
                            base, model, known = base + k * found[1], model + k * found[2], known + k
                        else:
                            rare.append((w, k))
                    # The document's own row gets a key that is no word (it has a space) and no hot key.
                    made.append((row, doc, b" %d" % row, 0, out, len(words), known, float(base), float(model)))
                    made += [(row, None, w, k, None, None, None, None, None) for w, k in rare]
                    row += 1
                cols = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)

    schema = "row long, doc_id long, word binary, cnt long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    parts = in_arrow(rows, run, schema).join(scored, "word", "left")
    rare = F.col("cnt") * F.log10((F.coalesce(F.col("c"), F.lit(0)) + ALPHA) / F.lit(floor))
    summed = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c") > 0, F.col("cnt")).otherwise(0))).alias("n_known"),
        (F.sum("base_score") + F.sum(rare)).alias("base_score"), (F.sum("score") + F.sum(F.coalesce(F.col("cnt") * F.col("m"), F.lit(0.0)))).alias("score"),
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
