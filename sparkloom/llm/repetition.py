"""Quality rules by repetition coverage (operator 5).

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and return.
For n from 5 to 10, rolling polynomial hashes of all n-word windows are built in numpy, each length
from the one before; only windows whose shorter window is repeated can be repeated, so each length
looks at fewer places. The characters of words under any repeated window are counted once and set
against all characters in words; so are those of repeated lines. A document fails where a share is
over its limit, or where it has too many signs.

Defined results: a null text counts as having no words; texts without words have zero coverage and
fail the base rule; repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, map_arrow, small_batches, text_or_empty

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Largest share of characters in repeated windows, all occurrences counted, by words in a window, for
#: texts of at most ``SHORT_WORDS``. The limits of published filters for long web pages (``LONG_LIMITS``)
#: would reject a short text for one line that it has twice; these let a text repeat a sixth of itself once.
NGRAM_LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: Largest share of characters in lines that came before, for the same texts.
LINE_LIMIT = 0.25
#: What longer texts may repeat stays as much as a text of ``SHORT_WORDS`` may, until its share is these.
SHORT_WORDS = 300
LONG_LIMITS, LONG_LINE_LIMIT = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}, 0.20
#: Signs per word.
SYMBOL_LIMIT = 0.10
LEAST_WORDS = 50
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    mask = np.zeros(len(k), bool)
    mask[1:] |= same
    mask[:-1] |= same
    out = np.empty(len(k), bool)
    out[order] = mask
    return out


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of places under windows of n places at the given starts."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str) -> dict[str, float]:
    """Base counts of a text, and the shares of its characters in repeated windows and lines."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at these six characters only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    out = {"n_words": n, "word_chars": word_chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": 0, "n_repeat_words": 0, "line_share": 0.0, **{f"share_{k}": 0.0 for k in NGRAM_LIMITS}}
    seen: set[str] = set()
    dup_chars = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            if line in seen:
                out["n_dup_lines"] += 1
                dup_chars += len(line) - sum(map(line.count, SPACE))
            seen.add(line)
    out["line_share"] = dup_chars / max(word_chars, 1)
    if n < 3:
        return out
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    # Exact keys of 3-word windows: pairs are numbered before the third word joins.
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1] if len(number) >= 1 << 20 else ids[:-1] * len(number) + ids[1:]
    again = _repeated(pairs[:-1] * len(number) + ids[2:])
    starts = np.flatnonzero(again)
    if not len(starts):
        return out
    out["n_repeat_words"] = int(_covered(starts, 3, n).sum())
    sizes = None
    hashed = _mixed(ids)
    rolling = (hashed[:-2] * _FACTOR + hashed[1:-1]) * _FACTOR + hashed[2:]
    for k in range(4, max(NGRAM_LIMITS) + 1):
        starts = starts[starts + k <= n]
        rolling = rolling[:-1] * _FACTOR + hashed[k - 1 :] if len(rolling) > 1 else rolling[:0]
        if len(starts) < 2:
            break
        starts = starts[_repeated(rolling[starts])]
        if len(starts) and k in NGRAM_LIMITS:
            if sizes is None:
                sizes = np.fromiter((len(w) for w in words), np.int64, n) if len(text) == len(text.encode("utf-8", "surrogatepass")) else np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
            out[f"share_{k}"] = float(sizes[_covered(starts, k, n)].sum() / word_chars)
    return out


def judged(m: dict[str, float]) -> tuple[bool, bool]:
    """Whether the base rule fails, and whether the document is kept."""
    n = m["n_words"]
    base = n < LEAST_WORDS or 100 * m["n_repeat_words"] > 50 * n
    part = min(1.0, SHORT_WORDS / max(n, 1))
    lines = max(LONG_LINE_LIMIT, LINE_LIMIT * part)
    bad = m["line_share"] > lines or m["n_symbols"] > SYMBOL_LIMIT * n or any(m[f"share_{k}"] > max(LONG_LIMITS[k], limit * part) for k, limit in NGRAM_LIMITS.items())
    return base, not (base or bad)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("line_share", *(f"share_{k}" for k in NGRAM_LIMITS))


def quality(df: DataFrame) -> DataFrame:
    """Counts, shares and verdict of each row of ``df`` (``doc_id``, ``text``)."""

    def block(c: dict[str, list]) -> dict[str, list]:
        found = [measure(t) for t in c["text"]]
        verdict = [judged(m) for m in found]
        return {"doc_id": c["doc_id"], **{k: [m[k] for m in found] for k in (*COUNTS, *SHARES)}, "base_failed": [b for b, _ in verdict], "kept": [k for _, k in verdict]}

    schema = ", ".join(["doc_id long", *(f"{k} long" for k in COUNTS), *(f"{k} double" for k in SHARES), "base_failed boolean", "kept boolean"])
    return map_arrow(df.select("doc_id", text_or_empty().alias("text")), block, schema, ["doc_id", "text"])


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text passes; all columns stay, and no row is matched by an id."""

    @F.pandas_udf("boolean")
    def passes(texts):
        import pandas as pd

        return pd.Series([judged(measure(t))[1] for t in texts], dtype=bool)

    return small_batches(df).where(passes(text_or_empty(text)))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
