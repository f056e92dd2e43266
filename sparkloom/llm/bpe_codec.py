"""BPE encoding and decoding of text columns (operator 10).

Defined results: a null text counts as the empty one; an empty text has no ids and decodes to the
empty text; repeated rows give repeated rows; an empty table gives an empty table; columns of the
input other than those named are carried along untouched by ``encode_column`` unless they clash with
the output's name, which then replaces them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe
from sparkloom.llm.common import documents, map_arrow, text_or_empty

BYTE_BPE = "byte_bpe_50k.json"


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` as packed little-endian unsigned 32-bit integers."""
    path = path or public_tokenizers.path(BYTE_BPE)

    @F.pandas_udf("binary")
    def packed(texts):
        import pandas as pd

        enc, values = bpe.encoder(path), texts.tolist()
        return pd.Series([b for at in range(0, len(values), 512) for b in enc.encode_many(values[at : at + 512])], dtype=object)

    return df.withColumn(out, packed(text_or_empty(text)))


def decode_column(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with ``out``: the text of packed ids (null: the empty text)."""
    path = path or public_tokenizers.path(BYTE_BPE)

    @F.pandas_udf("string")
    def text(packed):
        import pandas as pd

        v = bpe.vocabulary(path)
        return pd.Series([v.decode(np.frombuffer(b or b"", "<u4")) for b in packed], dtype=object)

    return df.withColumn(out, text(F.col(ids)))


def digest(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, and digests of the packed ids and of the decoded text."""
    path = path or public_tokenizers.path(BYTE_BPE)

    def block(c: dict[str, list]) -> dict[str, list]:
        enc = bpe.encoder(path)
        packed = enc.encode_many(c["text"])
        decoded = [enc.v.decode(np.frombuffer(b, "<u4")).encode() for b in packed]
        return {"doc_id": c["doc_id"], "n_tokens": [len(b) // 4 for b in packed], "ids_sha256": [hashlib.sha256(b).hexdigest() for b in packed], "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in decoded]}

    src = df.select("doc_id", text_or_empty().alias("text"))
    return map_arrow(src, block, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id", "text"])


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
