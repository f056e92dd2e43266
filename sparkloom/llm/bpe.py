"""Byte-level BPE: exact backtracking encoder and table decoder.

Encoding a piece needs no merge loop. Candidate tokens are the longest vocabulary entries that start
at a position (found for a whole block of pieces in one pass of an Aho-Corasick automaton). A token
may follow another one only if merging would not have joined or cut them differently; this is decided
from the two tokens alone by undoing merges at the seam, and remembered in a pair-compatibility
table. When no token fits after the last one, the last one is taken back and shortened, and the seam
it left is marked as dead, so that each position is left at most once: linear time.

Decoding gathers bytes from one blob of all tokens by a table of offsets.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache of encoded text; beyond, it starts anew. Bounds memory, not results.
CACHE_ENTRIES = 300_000
#: Longer stretches than this are encoded but not remembered.
CACHE_LENGTH = 64
#: Signs that stand alone after a word, and the first letter beyond those whose class is settled.
_SIGNS, _LATIN_END = frozenset(".,;:!?"), "\u0250"
_DOUBLE_SPACE = re.compile(r"\s\s")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: printable Latin-1 bytes stand for
    themselves, the others, in order, for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a ``tokenizers`` file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids: dict[bytes, int] = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for b, i in self.ids.items():
            self.token[i] = b
        for s, i in self.special.items():
            self.token[i] = s.encode()
        # A token's priority is the place of the merge that makes it; single bytes come before all.
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.priority = [-1] * size
        self.joined: dict[tuple[int, int], int] = {}
        for at, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            left, right = raw(left), raw(right)
            a, b, made = self.ids[left], self.ids[right], self.ids[left + right]
            self.joined[a, b] = made
            if self.halves[made] is None:
                self.halves[made], self.priority[made] = (a, b), at
        self.longest = max(map(len, self.ids))
        # Next shorter token that is a prefix of a token; -1 if there is none.
        self.shorter = [-1] * size
        for b, i in self.ids.items():
            for n in range(len(b) - 1, 0, -1):
                if (j := self.ids.get(b[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.token])])
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        self._compatible: dict[tuple[int, int], bool] = {}
        self._automaton = None

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for b, i in self.ids.items():
                self._automaton.add_word(b.decode("latin-1"), (len(b), i))
            self._automaton.make_automaton()
        return self._automaton

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` side by side when it encodes their joined bytes."""
        got = self._compatible.get((a, b))
        if got is None:
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            got = self._compatible[a, b] = self._seam(a, b)
        return got

    def _seam(self, a: int, b: int) -> bool:
        """Undo merges next to the seam, latest first. Whenever the two tokens then at the seam have
        a merge that would have come before the one just undone, BPE would have crossed the seam."""
        rank, halves, joined = self.priority, self.halves, self.joined
        left_done, right_done = float("inf"), float("inf")  # when the tokens at the seam were merged away
        while True:
            made = joined.get((a, b))
            if made is not None:
                at = rank[made]
                # Pairs are merged by priority, equal ones from the left: the left token must still
                # be there (strictly earlier on its side or at the same merge), the right one too.
                if at < left_done and at <= right_done:
                    return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                left_done, a = rank[a], halves[a][1]
                right_done = min(right_done, left_done)
            else:
                right_done, b = rank[b], halves[b][0]
                left_done = min(left_done, right_done + 1)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece by itself (a piece: what the pre-tokeniser returns)."""
        out: list[list[int]] = []
        room, block = 0, []
        for p in pieces:
            block.append(p)
            room += len(p)
            if room > 1_000_000:
                out += self._encode_block(block)
                room, block = 0, []
        return out + self._encode_block(block)

    def _encode_block(self, pieces: list[bytes]) -> list[list[int]]:
        buffer = b"".join(pieces)
        # Longest token from each position. A match that runs over its piece's end is shortened later.
        best = [0] * len(buffer)
        for end, (n, i) in self.automaton.iter(buffer.decode("latin-1")):
            best[end - n + 1] = i  # matches at one start come by rising length
        out, at = [], 0
        for p in pieces:
            out.append(self._walk(best, at, at + len(p)))
            at += len(p)
        return out

    def _walk(self, best: list[int], start: int, end: int) -> list[int]:
        token, shorter, table = self.token, self.shorter, self._compatible
        ids: list[int] = []
        dead: set[int] = set()
        at = start
        follow = best[at] if at < end else -1
        while at < end:
            t = follow
            last = ids[-1] if ids else -1
            while t >= 0:
                stop = at + len(token[t])
                if stop <= end and stop not in dead:
                    if last < 0:
                        break
                    fits = table.get((last, t))
                    if self.compatible(last, t) if fits is None else fits:
                        break
                t = shorter[t]
            if t >= 0:
                ids.append(t)
                at = stop
                follow = best[at] if at < end else -1
            else:
                dead.add(at)
                follow = ids.pop()
                at -= len(token[follow])
        return ids

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of ``ids``, gathered from the blob of all tokens by the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        first, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
        return self.blob[index].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class Encoder:
    """Encodes whole texts into packed little-endian 32-bit ids, remembering frequent stretches.

    A text is cut before single spaces, where no pre-token can cross; each stretch (mostly a word
    with its leading space and the sign after it) is looked up, and encoded only if it is new. Both
    memories are bounded: beyond the bound they keep what the current block of texts uses.
    """

    def __init__(self, vocabulary: Vocabulary, encode_pieces: Callable[[list[bytes]], list[list[int]]] | None = None):
        self.v = vocabulary
        self.encode_pieces = encode_pieces or vocabulary.encode_pieces
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _split(self, word: str) -> list[bytes]:
        """Pre-tokens of a space and ``word``. Latin letters with one sign at most after them need
        no pattern: the letters are one pre-token, the sign is another one."""
        stem, sign = (word[:-1], word[-1]) if word and word[-1] in _SIGNS else (word, "")
        if stem.isalpha() and (stem.isascii() or max(stem) < _LATIN_END):
            return [b" " + stem.encode(), sign.encode()] if sign else [b" " + stem.encode()]
        return [p.encode() for p in self.pattern.findall(" " + word)]

    def _encoded(self, cuts: list[list[bytes]]) -> list[bytes]:
        """Packed ids of each list of pre-tokens."""
        known = self.pieces
        used = set().union(*cuts)
        new = [p for p in used if p not in known]
        for p, ids in zip(new, self.encode_pieces(new), strict=True):
            known[p] = struct.pack(f"<{len(ids)}I", *ids)
        out = [b"".join([known[p] for p in c]) for c in cuts]
        self.pieces = _bounded(known, used)
        return out

    def _stretches(self, texts: list[str]) -> list[bytes]:
        plain = [not _DOUBLE_SPACE.search(t) for t in texts]
        split = [t.split(" ") if ok else [t] for t, ok in zip(texts, plain, strict=True)]
        firsts = self._encoded([[p.encode() for p in self.pattern.findall(ws[0])] for ws in split])
        known = self.words
        used = set().union(*[ws[1:] for ws in split])
        new = [w for w in used if w not in known]
        known.update(zip(new, self._encoded([self._split(w) for w in new]), strict=True))
        out = [b"".join([first, *[known[w] for w in ws[1:]]]) for first, ws in zip(firsts, split, strict=True)]
        self.words = _bounded(known, used)
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; strings of special tokens in a text become those tokens."""
        special = self.v.special
        parts = [self.cut.split(t) if self.cut and any(s in t for s in special) else [t] for t in texts]
        flat = iter(self._stretches([p for ps in parts for p in ps if p not in special]))
        return [b"".join([struct.pack("<I", special[p]) if p in special else next(flat) for p in ps]) for ps in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def _bounded(known: dict, used: set) -> dict:
    """``known``, or what of it was just used and is short, if it has grown beyond the bound."""
    if len(known) <= CACHE_ENTRIES:
        return known
    return {k: known[k] for k in used if len(k) <= CACHE_LENGTH} if len(used) <= CACHE_ENTRIES else {}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(vocabulary(path))
