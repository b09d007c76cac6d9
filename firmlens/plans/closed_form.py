"""Held-out discretionary accruals from a closed-form normal model of industry and firm means.

Every train-side quantity is a total minus the fold's own part, so no fold is ever refitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.operators.cv import complement

SHRINK = 1.0


def held_out_da(rows: DataFrame, scheme: str, keys: list[str], y: str = "ta_scaled") -> DataFrame:
    """``rows`` carry ``fold_id``. Firms with training rows are pulled towards their own training mean."""
    v = F.col(y)
    cell = rows.groupBy(*keys, "industry", "fold_id").agg(
        F.count("*").cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")
    )
    ind = complement(cell, keys + ["industry"], "fold_id", ["n", "s", "ss"])
    firm = complement(
        rows.groupBy(*keys, "company", "fold_id").agg(F.count("*").cast("double").alias("n"), F.sum(v).alias("s")),
        keys + ["company"], "fold_id", ["n", "s"],
    ).select(*keys, "company", "fold_id", F.col("train_n").alias("fn"), F.col("train_s").alias("fs"))
    j = rows.join(ind, keys + ["industry", "fold_id"]).join(firm, keys + ["company", "fold_id"])
    n, s, ss = F.col("train_n"), F.col("train_s"), F.col("train_ss")
    mean = F.when(n > 0, s / n)  # an industry wholly inside one fold has no training rows: no prediction
    sd = F.when(n > 1, F.sqrt(F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0))))
    pull = F.when(F.col("fn") > 0, F.col("fn") / (F.col("fn") + SHRINK) * (F.col("fs") / F.col("fn") - mean)).otherwise(0.0)
    j = j.select(
        F.lit(scheme).alias("scheme"), *keys, "company", "year", "industry", "fold_id", v.alias("ta_scaled"),
        F.col("fn").cast("long").alias("firm_train_rows"), (mean + pull).alias("nda_mean"),
        F.when(n > 0, sd / F.sqrt(n + F.col("fn"))).alias("nda_sd_epred"), F.when(n > 0, sd * F.sqrt(1 + 1 / (n + F.col("fn")))).alias("nda_sd_predict"),
    )
    # Nine digits: scores that are equal on paper tie exactly, whatever the order of summation.
    raw = F.round(F.col("ta_scaled") - F.col("nda_mean"), 9)
    z = lambda c: F.when(F.col(c) > 0, F.round((F.col("ta_scaled") - F.col("nda_mean")) / F.col(c), 9))
    return j.select(
        "*", raw.alias("da_raw"), z("nda_sd_epred").alias("da_z_est"), z("nda_sd_predict").alias("da_z_pred"),
    ).select(
        "*", (F.abs("da_z_pred") > 1.959964).cast("int").alias("tail95"), (F.abs("da_z_pred") > 2.326348).cast("int").alias("tail98")
    )
