"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage that has it.
QUERIES = {
    "op1_secrets": "secrets",
    "op2_telephony": "telephony",
    "op3_virtual_slots": "sharding",
    "op4_revisits": "revisits",
    "op5_repetition": "repetition",
    "op6_lattice": "lattice",
    "op7_packing": "packing",
    "op8_suffixes": "suffixes",
    "op9_simhash": "simhash",
    "op10_bpe_codec": "bpe_codec",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"sparkloom.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in dict.fromkeys(QUERIES.values()):
        found |= getattr(importlib.import_module(f"sparkloom.llm.{module}"), "ORACLE_SQL", {})
    return found
