"""Queries and SQL of the corpus operators, by the names under which __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embedding_caps, html_text, image_copies, language, mixing, packing, pii, prefix_trie, sessions, simhash, token_files, warc_fixity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_fixity": warc_fixity.op1_warc_fixity,
        "op2_image_copies": image_copies.op2_image_copies,
        "op3_spherical_caps": embedding_caps.op3_spherical_caps,
        "op4_byte_bpe": byte_bpe.op4_byte_bpe,
        "op5_mixing": mixing.op5_mixing,
        "op6_token_files": token_files.op6_token_files,
        "op7_html_text": html_text.op7_html_text,
        "op8_simhash": simhash.op8_simhash,
        "op9_language": language.op9_language,
        "op10_pii": pii.op10_pii,
        "op11_packing": packing.op11_packing,
        "op12_sessions": sessions.op12_sessions,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity": warc_fixity.ORACLE, "op3_spherical_caps": embedding_caps.ORACLE, "op12_sessions": sessions.ORACLE}
