"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .decontam import op6_latent_decontamination
from .langid import op9_string_kernel_langid
from .licenses import op7_license_scan
from .mixing import mixture_sql, op2_raked_mixture
from .near import op3_minhash_join
from .pii import op1_anchor_pii
from .quality import op5_hierarchical_quality
from .rules import op10_risk_controlled_rules
from .rules_sql import rules_sql
from .sharding import op8_hypergeometric_shards
from .tokens import op4_simple8b_tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_anchor_pii": op1_anchor_pii,
        "op2_raked_mixture": op2_raked_mixture,
        "op3_minhash_join": op3_minhash_join,
        "op4_simple8b_tokens": op4_simple8b_tokens,
        "op5_hierarchical_quality": op5_hierarchical_quality,
        "op6_latent_decontamination": op6_latent_decontamination,
        "op7_license_scan": op7_license_scan,
        "op8_hypergeometric_shards": op8_hypergeometric_shards,
        "op9_string_kernel_langid": op9_string_kernel_langid,
        "op10_risk_controlled_rules": op10_risk_controlled_rules,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_raked_mixture": mixture_sql(), "op10_risk_controlled_rules": rules_sql()}
