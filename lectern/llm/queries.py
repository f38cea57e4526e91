"""The pN_ queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import containers, leaks, looks, mixing, pieces, pii, scans, sentences, terms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": scans.p1_found,
    "p1_repaired": scans.p1_repaired,
    "p2_found": pieces.p2_found,
    "p2_pieces": pieces.p2_pieces,
    "p3_found": containers.p3_found,
    "p3_blocks": containers.p3_blocks,
    "p3_sections": containers.p3_sections,
    "p4_found": terms.p4_found,
    "p4_terms": terms.p4_terms,
    "p5_found": looks.p5_found,
    "p5_unified": looks.p5_unified,
    "p5_groups": looks.p5_groups,
    "p6_found": sentences.p6_found,
    "p6_sentences": sentences.p6_sentences,
    "p7_found": leaks.p7_found,
    "p7_leaks": leaks.p7_leaks,
    "p8_mix": mixing.p8_mix,
    "p8_mix_all": mixing.p8_mix_all,
    "p8_shares": mixing.p8_shares,
    "p8_shares_all": mixing.p8_shares_all,
    "p9_found": pii.p9_found,
    "p9_masked": pii.p9_masked,
}

SQL: dict[str, str] = {"p3_found": containers.P3_FOUND_SQL, "p4_found": terms.P4_FOUND_SQL, "p4_terms": terms.P4_TERMS_SQL}
