"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenderloom.llm.decontaminate import op7_decontamination
from tenderloom.llm.embedding_pairs import op5_cover_tree
from tenderloom.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from tenderloom.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from tenderloom.llm.licenses import OP2_SQL, op2_licenses
from tenderloom.llm.max_score import OP12_SQL, op12_max_score
from tenderloom.llm.mixing import OP8_SQL, op8_mixing
from tenderloom.llm.pii import op3_pii
from tenderloom.llm.prob_minhash import op10_prob_minhash
from tenderloom.llm.quality import op6_quality
from tenderloom.llm.tables import bounded_batches
from tenderloom.llm.token_counts import op4_token_counts
from tenderloom.llm.token_files import op9_token_files
from tenderloom.llm.toxicity import op1_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    registered = {
        "op1_toxicity": op1_toxicity,
        "op2_licenses": op2_licenses,
        "op3_pii": op3_pii,
        "op4_token_counts": op4_token_counts,
        "op5_cover_tree": op5_cover_tree,
        "op6_quality": op6_quality,
        "op7_decontamination": op7_decontamination,
        "op8_mixing": op8_mixing,
        "op9_token_files": op9_token_files,
        "op10_prob_minhash": op10_prob_minhash,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_max_score": op12_max_score,
        "op13_hard_negatives": op13_hard_negatives,
    }
    return {name: lambda spark, sf, q=q: q(bounded_batches(spark), sf) for name, q in registered.items()}


def statements() -> dict[str, str]:
    return {
        "op2_licenses": OP2_SQL,
        "op8_mixing": OP8_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_max_score": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
