"""The registered queries of this package and their SQL."""

from __future__ import annotations

from graphloom.llm import (
    decontam,
    exact,
    langid,
    licenses,
    merkle,
    mixing,
    prefixes,
    quality,
    quotes,
    secrets,
    simhash,
    substring,
    warc,
)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_substring": substring.op2_substring,
    "op3_langid": langid.op3_langid,
    "op4_quality": quality.op4_quality,
    "op5_quotes": quotes.op5_quotes,
    "op6_secrets": secrets.op6_secrets,
    "op7_warc": warc.op7_warc,
    "op8_decontam": decontam.op8_decontam,
    "op9_licenses": licenses.op9_licenses,
    "op10_mixing": mixing.op10_mixing,
    "op11_prefix_trie": prefixes.op11_prefix_trie,
    "op12_merkle": merkle.op12_merkle,
    "op13_exact_dedup": exact.op13_exact_dedup,
}

ORACLES = {
    "op2_substring": substring.ORACLE_SQL,
    "op5_quotes": quotes.ORACLE_SQL,
    "op6_secrets": secrets.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op11_prefix_trie": prefixes.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_exact_dedup": exact.ORACLE_SQL,
}
