"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgrad.llm import decontamination, exact_dedup, hard_negatives, language_id, licenses, minhash, mixing, secrets, sharding, simhash, substring_dedup, token_counts, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lpt_sharding": sharding.op1_lpt_sharding,
        "op2_simhash_anchor_cover": simhash.op2_simhash_anchor_cover,
        "op3_rank_order_language": language_id.op3_rank_order_language,
        "op4_dice_licences": licenses.op4_dice_licences,
        "op5_length_histogram": token_counts.op5_length_histogram,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_entropy_secrets": secrets.op7_entropy_secrets,
        "op8_raked_mixture": mixing.op8_raked_mixture,
        "op9_bm25_decontamination": decontamination.op9_bm25_decontamination,
        "op10_repeated_substrings": substring_dedup.op10_repeated_substrings,
        "op11_bit_sliced_whitening": whitening.op11_bit_sliced_whitening,
        "op12_minhash_inverted_join": minhash.op12_minhash_inverted_join,
        "op13_hyperplane_tree_negatives": hard_negatives.op13_hyperplane_tree_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.OP6_SQL, "op8_raked_mixture": mixing.OP8_SQL}
