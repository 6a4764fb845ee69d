"""The ten operators as registered queries, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import chat, decontam, hmm, html_blocks, mixing, near_dup, quality, substring, token_fst, warc


def queries():
    return {
        "op1_html_extraction": html_blocks.extract_query,
        "op2_near_dedup": near_dup.near_dup_query,
        "op3_token_counts": token_fst.tokens_query,
        "op4_quality_rules": quality.quality_query,
        "op5_substring_dedup": substring.substring_query,
        "op6_chat_formatting": chat.chat_query,
        "op7_warc_archive": warc.warc_query,
        "op8_hidden_markov_lm": hmm.hmm_query,
        "op9_decontamination": decontam.decontam_query,
        "op10_source_mixing": mixing.mix_query,
    }


def oracle_sql():
    return {
        "op4_quality_rules": quality.QUALITY_SQL,
        "op5_substring_dedup": substring.SUBSTRING_SQL,
        "op6_chat_formatting": chat.CHAT_SQL,
        "op7_warc_archive": warc.WARC_SQL,
        "op10_source_mixing": mixing.MIX_SQL,
    }
