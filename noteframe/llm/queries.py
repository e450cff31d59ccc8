"""The queries of this subpackage by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noteframe.llm import classifier, collocations, decontaminate, hmm, langid, near, oracles, packing, rules, secrets, sharding, suffixes, trie, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_repeats": suffixes.op2_repeats,
        "op3_rules": rules.op3_rules,
        "op4_quality": classifier.op4_quality,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_language": hmm.op6_language,
        "op7_near_duplicates": near.op7_near_duplicates,
        "op8_sharding": sharding.op8_sharding,
        "op9_packing": packing.op9_packing,
        "op10_warc": warc.op10_warc,
        "op11_trie": trie.op11_trie,
        "op12_collocations": collocations.op12_collocations,
        "op13_language_id": langid.op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
