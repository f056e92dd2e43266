"""Vector bin packing of tokenised examples into training sequences (operator 7).

Each item has a vector: tokens, segments, loss-bearing tokens. Sequences are filled one at a time.
The next item is the one of the largest dot product of its vector with the room that is left, each
dimension weighted by how scarce it is, among the items that fit in every dimension. Items of equal
vectors are interchangeable, so a step looks at the distinct vectors only. Where no item fits any
more, the item of the largest dot product is cut to fill the room, and its rest goes back.

Packing takes place in the task that tokenises, over blocks of a bounded number of tokens: ids are
never shuffled, and a block's last sequence is the only one that may stay open.

Instruction data are answers, each after its prompt: only the answer and the end bear loss, so the
three limits are different ones. In plain documents every token bears loss.

Defined results: a null text or prompt counts as the empty one; an empty document still has its end
token, so every row has at least one piece; repeated rows are packed once each, rows without ``doc_id``
too; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe
from sparkloom.llm.bpe_codec import BYTE_BPE
from sparkloom.llm.common import arrow_types, documents, in_arrow, text_or_empty

MAX_TOKENS, MAX_SEGMENTS, END = 1024, 16, 0
#: Loss-bearing tokens of a sequence of instruction data.
MAX_LOSS = 832
#: Tokens of a block that is packed by itself.
BLOCK_TOKENS = 4_000_000
#: A sequence with less room than this stays open rather than taking a cut piece.
LEAST_CUT = 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


#: A stretch of white space that the compiled library's pattern need not take: a few million overflow its stack.
BLANK = 10_000


class CompiledEncoder:
    """Whole texts encoded by the compiled library, which gives the same ids; texts with a special token's
    string, which it would take for ordinary text, or a very long blank go to the encoder of operator 10."""

    def __init__(self, path: str):
        v = bpe.vocabulary(path)
        self.special, self.other = tuple(v.special), bpe.encoder(path)
        self.blank = re.compile(rf"\s{{{BLANK}}}")
        self.ordinary = tiktoken.Encoding("texts", pat_str=bpe.PATTERN, mergeable_ranks=v.ids, special_tokens={})._core_bpe.encode_ordinary

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        return [self.other.encode(t) if self._odd(t) else np.array(self.ordinary(t), "<u4").tobytes() for t in texts]

    def _odd(self, text: str) -> bool:
        return any(s in text for s in self.special) or (len(text) >= BLANK and bool(self.blank.search(text)))


@lru_cache(maxsize=2)
def fast_encoder(path: str) -> CompiledEncoder:
    """One encoder per worker."""
    return CompiledEncoder(path)


def pack(items: list[tuple[int, int, int]], limits: tuple[int, int, int]) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(item, start, length)`` for items ``(item, tokens, loss-bearing tokens)``.

    Loss-bearing tokens are the last ones of an item (an answer follows its prompt). Every token of
    every item is in exactly one piece; each sequence keeps to all three limits.
    """
    room_of = np.array(limits, np.float64)
    out: list[list[tuple[int, int, int]]] = []
    waiting: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)  # vector -> (item, start)

    def offer(item: int, start: int, tokens: int, loss: int) -> None:
        if tokens:
            waiting[tokens, loss].append((item, start))

    for item, tokens, loss in items:
        start = 0
        while tokens - start > limits[0] or loss > limits[2]:  # what alone exceeds a limit is cut first
            size = min(limits[0], tokens - start, tokens - start - loss + limits[2])
            size = max(size, 1)
            plain = max(0, tokens - start - loss)
            used = max(0, size - plain)
            if size == limits[0]:
                out.append([(item, start, size)])
            else:
                offer(item, start, size, used)
            start, loss = start + size, loss - used
        offer(item, start, tokens - start, loss)

    vectors, count = np.zeros((0, 2)), np.zeros(0, np.int64)
    total = np.array([0.0, 0.0, 0.0])

    def index() -> None:
        nonlocal vectors, count, total, keys, at
        keys = sorted(waiting)
        vectors = np.array(keys, np.float64).reshape(-1, 2)
        count = np.array([len(waiting[k]) for k in keys], np.int64)
        at = {k: i for i, k in enumerate(keys)}
        total = np.array([(vectors[:, 0] * count).sum(), count.sum(), (vectors[:, 1] * count).sum()])

    keys: list[tuple[int, int]] = []
    at: dict[tuple[int, int], int] = {}
    index()
    while count.any():
        scarce = total / room_of  # demand by dimension, in sequences
        weight = scarce / max(scarce.max(), 1e-9) / room_of**2
        room, sequence = room_of.copy(), []
        while True:
            live = count > 0
            fits = live & (vectors[:, 0] <= room[0]) & (vectors[:, 1] <= room[2]) & (room[1] >= 1)
            if fits.any():
                score = vectors[:, 0] * room[0] * weight[0] + room[1] * weight[1] + vectors[:, 1] * room[2] * weight[2]
                k = int(np.argmax(np.where(fits, score, -1)))
                (tokens, loss), (item, start) = keys[k], waiting[keys[k]].pop()
                cut, used = tokens, loss
            elif live.any() and room[1] >= 1 and room[0] >= LEAST_CUT and room[2] >= 1:
                score = vectors[:, 0] * room[0] * weight[0] + vectors[:, 1] * room[2] * weight[2]
                k = int(np.argmax(np.where(live, score, -1)))
                (tokens, loss), (item, start) = keys[k], waiting[keys[k]].pop()
                plain = tokens - loss
                cut = int(min(room[0], tokens, plain + room[2]))
                used = max(0, cut - plain)
            else:
                break
            sequence.append((item, start, cut))
            room -= (cut, 1, used)
            total -= (cut, 1, used)
            count[k] -= 1
            if cut < tokens:
                rest = (tokens - cut, loss - used)
                waiting[rest].append((item, start + cut))
                total[1] += 1
                if rest in at:
                    count[at[rest]] += 1
                else:
                    index()
            if room[0] < 1:
                break
        out.append(sequence)
    return out


def pack_documents(df: DataFrame, path: str | None = None, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_TOKENS, prompt: str | None = None, bearing: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of all rows of ``df`` (``doc_id``, ``text``), see ``PIECES``; ``sequence_id`` is unique over
    all tasks, ``offset`` is the place in it, ``loss_tokens`` how many of a piece's tokens bear loss.

    ``prompt`` names a column of texts that come before; their tokens bear no loss. ``bearing`` names a
    column with how many of a row's last tokens bear loss, the end token included; null means all that
    aren't the prompt's, and counts are taken between none and all. Columns in ``keep`` (long) are carried along."""
    path = path or public_tokenizers.path(BYTE_BPE)
    schema = PIECES + "".join(f", {k} long" for k in keep)
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = fast_encoder(path)
        end = END.to_bytes(4, "little")
        next_id = TaskContext.get().partitionId() << 40
        ids: list[tuple[tuple, bytes, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, ids, held
            rows = []
            for sequence in pack([(i, len(b) // 4, bears) for i, (_, b, bears) in enumerate(ids)], (tokens, segments, loss)):
                offset = 0
                for item, start, size in sequence:
                    (doc, *kept), b, bears = ids[item]
                    used = min(size, max(0, start + size - (len(b) // 4 - bears)))
                    rows.append((doc, start, size, zlib.crc32(b[4 * start : 4 * (start + size)]), len(b) // 4, next_id, offset, used, *kept))
                    offset += size
                next_id += 1
            ids, held = [], 0
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(cols, types, strict=True)], names=[n for n, _ in types])

        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                doc, text, before, bears, *kept = (c.to_pylist() for c in batch.slice(first, 512).columns)
                prompts = enc.encode_many([p or "" for p in before]) if prompt else [b""] * len(doc)
                for row, p, b, last in zip(zip(doc, *kept, strict=True), prompts, enc.encode_many(text), bears, strict=True):
                    n = len(b) // 4 + 1
                    ids.append((row, p + b + end, n if last is None else min(max(last, 0), n + len(p) // 4)))
                    held += len(p) // 4 + n
                if held > BLOCK_TOKENS:
                    yield from flush()
        if ids:
            yield from flush()

    before = F.col(prompt) if prompt else F.lit(None).cast("string")
    bears = (F.col(bearing) if bearing else F.lit(None)).cast("long")
    # Named by place: columns of ``df`` may have any names.
    columns = [F.col("doc_id").alias("c0"), text_or_empty().alias("c1"), before.alias("c2"), bears.alias("c3"), *(F.col(k).cast("long").alias(f"c{i + 4}") for i, k in enumerate(keep))]
    return in_arrow(df.select(*columns), run, schema)


def pack_conversations(turns: DataFrame, path: str | None = None, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS) -> DataFrame:
    """Pieces of all answers in ``turns`` (``conv_id``, ``turn``, ``role``, ``text``), each after the turn
    before it, which bears no loss. ``doc_id`` is the conversation's and ``turn`` the answer's.

    An answer is a row of role ``assistant``. Rows meet by conversation and turn, so that a very long
    conversation is no group; of several rows with the same ones the least text is the prompt.
    """
    before = turns.where("NOT role <=> 'assistant'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", "text")
    examples = answers.join(before, ["conv_id", "turn"], "left").withColumnRenamed("conv_id", "doc_id")
    return pack_documents(examples, path, tokens, segments, loss, prompt="prompt", keep=("turn",))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
