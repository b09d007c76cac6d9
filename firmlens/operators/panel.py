"""Panel construction: contiguous lags, derived ratios, row status, samples, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.functions.columns import all_present, finite, join_key, missing, negative_flag, safe_div, zero_missing

# Names of the panel variables of each sample.
CORE_REAL_TIME = [
    "ta_scaled", "inv_a_lag", "drev_scaled", "drec_scaled", "drev_drec_scaled", "ppe_scaled", "roa_lag",
    "cfo_lag_scaled", "cfo_curr_scaled", "neg_cfo", "size", "sales_growth",
]
CORE_EX_POST = CORE_REAL_TIME + ["cfo_lead_scaled"]
SAMPLES = {
    "ex_post": CORE_EX_POST,
    "real_time": CORE_REAL_TIME,
    "operating_cycle_ex_post": CORE_EX_POST + ["operating_cycle"],
    "operating_cycle_real_time": CORE_REAL_TIME + ["operating_cycle"],
    "m08_ex_post": CORE_EX_POST + ["sd_rev", "sd_cfo"],
    "m08_real_time": CORE_REAL_TIME + ["sd_rev", "sd_cfo"],
}
WINSOR_VARS = [
    "ta_scaled", "inv_a_lag", "drev_scaled", "drec_scaled", "drev_drec_scaled", "ppe_scaled", "roa_lag", "roa_curr",
    "cfo_lag_scaled", "cfo_curr_scaled", "cfo_lead_scaled", "size", "operating_cycle", "sales_growth",
    "revenue_growth", "sd_rev", "sd_cfo",
]
PREDICTORS = [
    "inv_a_lag", "drev_scaled", "drec_scaled", "drev_drec_scaled", "ppe_scaled", "roa_lag", "cfo_lag_scaled",
    "cfo_curr_scaled", "cfo_lead_scaled", "size", "operating_cycle", "sales_growth", "sd_rev", "sd_cfo",
]
ZERO_IS_MISSING = ["ppe", "rec", "cogs"]


def firm_window():
    """One window spec for every lag, lead and rolling value: one shuffle, one sort.

    Firm-years are unique, so a firm's group is bounded by the number of calendar years however large the
    panel gets.
    """
    return W.partitionBy("company").orderBy("year")


def lag_contiguous(x: str | Column, n: int = 1) -> Column:
    """Value of the n-th previous row only if that row is exactly n years older."""
    w = firm_window()
    return F.when(F.lag("year", n).over(w) == F.col("year") - n, F.lag(x, n).over(w))


def lead_contiguous(x: str | Column, n: int = 1) -> Column:
    w = firm_window()
    return F.when(F.lead("year", n).over(w) == F.col("year") + n, F.lead(x, n).over(w))


def rolling_sd3(x: str) -> Column:
    """Sample SD over years t-2, t-1, t; any gap or non-finite value gives NULL."""
    w = firm_window()
    frame = w.rowsBetween(-2, 0)
    ok = (
        (F.lag("year", 1).over(w) == F.col("year") - 1)
        & (F.lag("year", 2).over(w) == F.col("year") - 2)
        & (F.sum(finite(x).cast("int")).over(frame) == 3)
    )
    return F.when(ok, F.stddev_samp(x).over(frame))


def clean_rows(df: DataFrame, base_year: int) -> DataFrame:
    """Drop rows without usable assets, apply the zero rule, drop the base year, normalise the key."""
    df = df.filter((F.col("a") != 0) & ~missing("a") & (F.col("year") > base_year))
    return df.withColumns({c: zero_missing(c) for c in ZERO_IS_MISSING}).withColumn("company", join_key("company"))


def drop_counts(df: DataFrame, base_year: int) -> DataFrame:
    """Counts behind ``clean_rows``, missing and zero assets reported apart."""
    kept = (F.col("a") != 0) & ~missing("a")
    return df.agg(
        F.count("*").alias("n_raw"),
        F.count_if(missing("a")).alias("n_assets_missing"),
        F.count_if(F.col("a") == 0).alias("n_assets_zero"),
        F.count_if(kept & (F.col("year") <= base_year)).alias("n_base_year"),
        F.count_if(kept & (F.col("year") > base_year)).alias("n_kept"),
    )


def derive(df: DataFrame) -> DataFrame:
    """Add lags, leads, scaled ratios, indicators and rolling volatility to cleaned rows."""
    c = F.col
    df = df.select(
        "*",
        *[lag_contiguous(v).alias(f"{v}_lag") for v in ("a", "rev", "rec", "cfo", "roa")],
        *[lead_contiguous(v).alias(f"{v}_lead") for v in ("cfo", "ni", "a")],
    )
    ok = c("a_lag").isNotNull() & (c("a_lag") != 0)
    over = lambda e: F.when(ok, e / c("a_lag"))
    df = df.select(
        "*",
        over(c("ni") - c("cfo")).alias("ta_scaled"),
        over(F.lit(1.0)).alias("inv_a_lag"),
        over(c("rev") - c("rev_lag")).alias("drev_scaled"),
        over(c("rec") - c("rec_lag")).alias("drec_scaled"),
        over((c("rev") - c("rev_lag")) - (c("rec") - c("rec_lag"))).alias("drev_drec_scaled"),
        over(c("ppe")).alias("ppe_scaled"),
        c("roa").alias("roa_curr"),
        over(c("cfo_lag")).alias("cfo_lag_scaled"),
        over(c("cfo")).alias("cfo_curr_scaled"),
        over(c("cfo_lead")).alias("cfo_lead_scaled"),
        negative_flag(over(c("cfo"))).alias("neg_cfo"),
        negative_flag(over(c("ni"))).alias("neg_earn"),
        F.when(c("a") > 0, F.log("a")).alias("size"),
        over(c("rev")).alias("rev_scaled"),
    )
    growth = F.when(c("rev_lag") > 0, c("rev") / c("rev_lag") - 1)
    return df.select(
        "*",
        rolling_sd3("rev_scaled").alias("sd_rev"),
        rolling_sd3("cfo_curr_scaled").alias("sd_cfo"),
        F.when((c("rev") > 0) & (c("cogs") > 0), c("rec") / c("rev") + c("inv") / c("cogs")).alias("operating_cycle"),
        growth.alias("revenue_growth"),
        growth.alias("sales_growth"),
    )


def row_status() -> Column:
    """First matching reason why a firm-year is unusable in the ex-post space."""
    m = missing
    return (
        F.when(m("a") | (F.col("a") == 0), "denominator_invalid")
        .when(m("a_lag") | (F.col("a_lag") == 0), "denominator_invalid")
        .when(m("rev_lag") | m("rec_lag") | m("cfo_lag") | m("roa_lag"), "lag_missing")
        .when(m("ppe") | m("rec"), "data_invalid")
        .when(m("cfo_lead"), "lead_missing")
        .when(m("sales_growth"), "model_variable_missing")
        .when(m("sd_rev") | m("sd_cfo"), "optional_variable_missing")
        .otherwise("eligible")
    )


def sample(df: DataFrame, name: str) -> DataFrame:
    return df.filter(all_present(SAMPLES[name]))


def stacked_samples(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One long table with a ``sample`` column; each input row is scanned once."""
    names = names or list(SAMPLES)
    tags = F.array_compact(F.array(*[F.when(all_present(SAMPLES[n]), F.lit(n)) for n in names]))
    return df.withColumn("sample", F.explode(tags))


def outcomes(df: DataFrame) -> DataFrame:
    """Next-year and current outcomes scaled by own and by harmonised denominators."""
    c = F.col
    df = df.withColumn("ta_scaled_lead", lead_contiguous("ta_scaled"))
    return df.select(
        "*",
        safe_div("cfo_lead", "a").alias("future_cfo"),
        safe_div("ni_lead", "a").alias("future_earnings"),
        F.when(c("a_lead") > 0, safe_div("ni_lead", "a_lead")).alias("future_roa"),
        safe_div("ni", "a_lag").alias("current_earnings"),
        (-c("ta_scaled_lead")).alias("accrual_reversal"),
        safe_div("cfo_lead", "a_lag").alias("future_cfo_lagged_assets"),
        safe_div("ni_lead", "a_lag").alias("future_earnings_lagged_assets"),
        F.when(c("a_lead") > 0, safe_div("cfo_lead", "a_lead")).alias("future_cfo_lead_assets"),
    )


def tenure(df: DataFrame) -> DataFrame:
    """First and last year, panel length and age of each firm, on the shuffle already paid for by the lags."""
    whole = W.partitionBy("company")
    return df.select(
        "*",
        F.min("year").over(whole).alias("first_year"),
        F.max("year").over(whole).alias("last_year"),
        F.size(F.collect_set("year").over(whole)).cast("long").alias("panel_length"),
        (F.col("year") - F.min("year").over(whole) + 1).alias("firm_age"),
    )
