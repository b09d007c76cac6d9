"""The model space as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.naming import FIRM_RE, POOLED

# Regressors of each model on ``ta_scaled`` (``a:b`` is a product).
FORMULAS = {
    "M01": ["inv_a_lag", "drev_scaled", "ppe_scaled"],
    "M02": ["inv_a_lag", "drev_drec_scaled", "ppe_scaled"],
    "M03": ["inv_a_lag", "drev_drec_scaled", "ppe_scaled", "roa_lag"],
    "M04": ["cfo_lag_scaled", "cfo_curr_scaled", "cfo_lead_scaled"],
    "M05": ["cfo_lag_scaled", "cfo_curr_scaled", "cfo_lead_scaled", "drev_scaled", "ppe_scaled"],
    "M06": ["cfo_lag_scaled", "cfo_curr_scaled", "cfo_lead_scaled", "drev_scaled", "ppe_scaled", "roa_lag"],
    "M07": ["cfo_curr_scaled", "neg_cfo", "cfo_curr_scaled:neg_cfo", "drev_scaled", "ppe_scaled"],
    "M08": ["inv_a_lag", "drev_drec_scaled", "ppe_scaled", "roa_lag", "size", "sd_rev", "sd_cfo"],
    "M09": ["cfo_lag_scaled", "cfo_curr_scaled", "drev_scaled", "ppe_scaled", "roa_lag", "size"],
    "M10": ["inv_a_lag", "drev_drec_scaled", "ppe_scaled", "roa_lag", "operating_cycle", "sales_growth"],
}
SPACE_MODELS = {
    "ex_post": ["M01", "M02", "M03", "M04", "M05", "M06", "M07"],
    "real_time": ["M01", "M02", "M03", "M07", "M09"],
}
SECONDARY = {"M08": ("ROBUSTNESS_M08", "secondary_volatility", ["ex_post"]), "M10": ("ROBUSTNESS_OPERATING_CYCLE", "secondary_operating_cycle", ["ex_post", "real_time"])}


def required_variables(model_id: str) -> list[str]:
    return list(dict.fromkeys(v for term in FORMULAS[model_id] for v in term.split(":")))


def model_space(spark: SparkSession) -> DataFrame:
    """One row per (model, eligible space, heterogeneity variant)."""
    rows = []
    for m in FORMULAS:
        tier, group, spaces = SECONDARY.get(m, ("CORE", "main_common", [s for s, ids in SPACE_MODELS.items() if m in ids]))
        rows.append((m, tier, group, spaces, required_variables(m), FORMULAS[m]))
    registry = spark.createDataFrame(
        rows, "model_id string, tier string, sample_group string, spaces array<string>, required array<string>, terms array<string>"
    )
    variants = F.array(F.lit(POOLED), F.lit(FIRM_RE))
    return (
        registry.withColumn("target_space", F.explode("spaces"))
        .withColumn("variant", F.explode(variants))
        .withColumn("main_stack", F.col("sample_group") == "main_common")
        .drop("spaces")
    )
