"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from tidemark.llm import codes, host_rules, langid, media, mixing, negatives, packing, sharding, simhash, substrings, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_host_rules": host_rules.op2_host_rules,
    "op3_substrings": substrings.op3_substrings,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sharding": sharding.op5_sharding,
    "op6_simhash": simhash.op6_simhash,
    "op7_packing": packing.op7_packing,
    "op8_langid": langid.op8_langid,
    "op9_media": media.op9_media,
    "op10_mixing": mixing.op10_mixing,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_warc": warc.op12_warc,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.SQL,
    "op2_host_rules": host_rules.SQL,
    "op5_sharding": sharding.sql(),
    "op10_mixing": mixing.SQL,
    "op11_vector_codes": codes.sql(),
    "op12_warc": warc.SQL,
    "op13_hard_negatives": negatives.SQL,
}
