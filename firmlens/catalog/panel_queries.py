"""Sources, projections, joins, windows over firms, set operations, preprocessing."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.catalog.common import (
    BASE_YEAR, cleaned, derived, firm_years, firms, samples, table, winsorized,
)
from firmlens.catalog.registry import query, r, sql_with
from firmlens.functions import naming as N
from firmlens.functions.columns import finite, join_key, missing, negative_flag, rnd, safe_div, to_double, zero_missing
from firmlens.functions.columns import precision_weight
from firmlens.operators import panel as P
from firmlens.operators import prep
from firmlens.operators.ordered import unpivot
from firmlens.session import shared_root
from firmlens.sources.sinks import publish, published, table_fingerprint, verify_published
from firmlens.sources.tables import require_columns

MONEY = ["a", "ni", "rev", "cfo", "rec", "ppe", "cogs", "inv"]
RATIOS = [
    "ta_scaled", "drev_scaled", "drec_scaled", "drev_drec_scaled", "ppe_scaled", "cfo_lag_scaled", "cfo_curr_scaled",
    "cfo_lead_scaled",
]


def cols_sql(cols, digits=6):
    return ", ".join(f"{r(c, digits)} AS {c}" for c in cols)


def cols_df(cols, digits=6):
    return [rnd(c, digits).alias(c) for c in cols]


PROFILE_SQL = ", ".join(
    [f"count(x) AS n_obs, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS sd, {r('min(x)')} AS min, {r('max(x)')} AS max"]
    + [f"{r(f'quantile_cont(x, {p})')} AS {n}" for p, n in zip(prep.PROFILE_PROBS, prep.PROFILE_NAMES)]
)
PROFILE_COLS = ["mean", "sd", "min", "max"] + prep.PROFILE_NAMES


def unpivot_sql(src, keys, cols):
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"(UNPIVOT (SELECT {keys}, {sel} FROM {src}) ON {', '.join(cols)} INTO NAME variable VALUE x)"


FLAG_VARS = ["ta_scaled", "drev_scaled", "drev_drec_scaled", "ppe_scaled", "roa_lag", "size", "sales_growth"]


@query("flagship_winsorized_profile", sql_with("winsorized", f"""
SELECT sample, variable, {PROFILE_SQL} FROM {unpivot_sql("winsorized", "sample", FLAG_VARS)}
WHERE sample = 'real_time' GROUP BY sample, variable"""))
def _(spark, d):
    s = samples(spark, d, ["real_time"]).select("sample", *FLAG_VARS)
    out = prep.profile(prep.winsorize(s, ["sample"], FLAG_VARS), ["sample"], FLAG_VARS)
    return out.select("sample", "variable", "n_obs", *cols_df(PROFILE_COLS))


# --- sources -----------------------------------------------------------------------------------------

@query("src1_firm_year_table", sql_with("firm_years", f"SELECT company, year, industry, {cols_sql(MONEY, 4)} FROM firm_years"))
def _(spark, d):
    df = require_columns(firm_years(spark, d), ["company", "year", *MONEY], "firm-year panel")
    return df.select("company", "year", "industry", *cols_df(MONEY, 4))


@query("src2_optional_table", """
SELECT o.o_orderpriority AS priority, count(*) AS n_orders, CAST(0 AS BIGINT) AS n_reviews FROM orders o GROUP BY o.o_orderpriority""")
def _(spark, d):
    from firmlens.sources.tables import read_table
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("review", T.StringType())])
    reviews = read_table(spark, f"{d}/order_reviews.parquet", schema, required=False)
    o = read_table(spark, f"{d}/orders.parquet")
    return o.join(reviews, "o_orderkey", "left").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("n_orders"), F.count("review").alias("n_reviews")
    )


@query("src3_resolved_columns", "SELECT c_name AS company_name, c_mktsegment AS industry FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    c = N.rename_resolved(c, ["C Name", "firm_name"], "company_name")
    return N.rename_resolved(c, ["C-MktSegment"], "industry").select("company_name", "industry")


@query("src4_tolerant_number", f"""
SELECT event_id, {r("TRY_CAST(substr(props, 6, 3) AS DOUBLE)")} AS parsed FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", rnd(to_double(F.substring("props", 6, 3))).alias("parsed"))


@query("src5_join_key", """
SELECT c_custkey, nullif(trim(substr(c_name, 1, 10)), '') AS k1, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE ' ' || c_mktsegment || ' ' END), '') AS k2 FROM customer""")
def _(spark, d):
    padded = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    return table(spark, d, "customer").select(
        "c_custkey", join_key(F.substring("c_name", 1, 10)).alias("k1"), join_key(padded).alias("k2")
    )


@query("snk2_table_fingerprint", """
SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)), 1, 12)) AS BIGINT)) AS VARCHAR) AS fingerprint
FROM orders""")
def _(spark, d):
    return table_fingerprint(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("snk1_published_table", """
SELECT o_orderstatus, count(*) AS n_rows, (round(CAST(sum(o_totalprice) AS DOUBLE), 2) + 0.0) AS total, true AS committed, true AS files_match, CAST(0 AS BIGINT) AS n_strangers,
 (SELECT CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)), 1, 12)) AS BIGINT)) AS VARCHAR) FROM orders) AS fingerprint
FROM orders GROUP BY o_orderstatus""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    path = f"{shared_root(spark)}/firmlens/{spark.sparkContext.applicationId}/published-{uuid.uuid4().hex}"
    manifest = publish(rows, path, partition_by=["o_orderstatus"])
    back = published(spark, path, rows.schema)
    files = verify_published(spark, path).agg(
        (F.count("*") == F.count_if("in_manifest")).alias("committed"), F.bool_and(F.col("size_matches") & F.col("md5_matches")).alias("files_match"), F.count_if(~F.col("in_manifest")).alias("n_strangers"))
    whole = table_fingerprint(back, ["o_orderkey", "o_custkey", "o_orderstatus"])
    counted = manifest.agg(F.max("n_rows").alias("listed"))
    by = back.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.sum("o_totalprice").cast("double").alias("total"))
    # Single rows of totals beside one row per status.
    j = by.crossJoin(F.broadcast(files)).crossJoin(F.broadcast(whole.select("fingerprint", F.col("n_rows").alias("read")))).crossJoin(F.broadcast(counted))
    return j.select("o_orderstatus", "n_rows", rnd("total", 2).alias("total"), (F.col("committed") & (F.col("listed") == F.col("read"))).alias("committed"), "files_match", "n_strangers", "fingerprint")


# --- projections -------------------------------------------------------------------------------------

@query("prj1_zero_as_missing", sql_with("firm_years", """
SELECT company, year, rec = 0 AS rec_was_zero, nullif(rec, 0) IS NULL AS rec_missing, nullif(ppe, 0) IS NULL AS ppe_missing,
  nullif(cogs, 0) IS NULL AS cogs_missing, inv = 0 AS inv_kept_zero FROM firm_years"""))
def _(spark, d):
    c = F.col
    return firm_years(spark, d).select(
        "company", "year", (c("rec") == 0).alias("rec_was_zero"), zero_missing("rec").isNull().alias("rec_missing"),
        zero_missing("ppe").isNull().alias("ppe_missing"), zero_missing("cogs").isNull().alias("cogs_missing"),
        (c("inv") == 0).alias("inv_kept_zero"),
    )


@query("prj2_row_filters", sql_with("firm_years", f"""
SELECT count(*) AS n_raw, count_if(a IS NULL) AS n_assets_missing, count_if(a = 0) AS n_assets_zero,
  count_if(a <> 0 AND year <= {BASE_YEAR}) AS n_base_year, count_if(a <> 0 AND year > {BASE_YEAR}) AS n_kept FROM firm_years"""))
def _(spark, d):
    return P.drop_counts(firm_years(spark, d), BASE_YEAR)


@query("prj3_scaled_ratios", sql_with("derived", f"SELECT company, year, {cols_sql(RATIOS)}, {r('inv_a_lag', 12)} AS inv_a_lag FROM derived"))
def _(spark, d):
    return derived(spark, d).select("company", "year", *cols_df(RATIOS), rnd("inv_a_lag", 12).alias("inv_a_lag"))


@query("prj4_indicators", sql_with("derived", "SELECT company, year, neg_cfo, neg_earn FROM derived"))
def _(spark, d):
    return derived(spark, d).select("company", "year", "neg_cfo", "neg_earn")


@query("prj5_log_size", sql_with("derived", f"SELECT company, year, {r('size')} AS size FROM derived"))
def _(spark, d):
    return derived(spark, d).select("company", "year", rnd("size").alias("size"))


@query("prj6_growth_operating_cycle", sql_with("derived", f"SELECT company, year, {r('revenue_growth')} AS revenue_growth, {r('operating_cycle')} AS operating_cycle FROM derived"))
def _(spark, d):
    return derived(spark, d).select("company", "year", *cols_df(["revenue_growth", "operating_cycle"]))


@query("prj7_row_status", sql_with("derived", """
SELECT row_status, count(*) AS n FROM (SELECT CASE WHEN a IS NULL OR a = 0 THEN 'denominator_invalid' WHEN a_lag IS NULL OR a_lag = 0 THEN 'denominator_invalid'
  WHEN rev_lag IS NULL OR rec_lag IS NULL OR cfo_lag IS NULL OR roa_lag IS NULL THEN 'lag_missing' WHEN ppe IS NULL OR rec IS NULL THEN 'data_invalid'
  WHEN cfo_lead IS NULL THEN 'lead_missing' WHEN sales_growth IS NULL THEN 'model_variable_missing'
  WHEN sd_rev IS NULL OR sd_cfo IS NULL THEN 'optional_variable_missing' ELSE 'eligible' END AS row_status FROM derived) GROUP BY row_status"""))
def _(spark, d):
    return derived(spark, d).groupBy(P.row_status().alias("row_status")).agg(F.count("*").alias("n"))


@query("prj8_complete_case_samples", sql_with("all_samples", "SELECT sample, company, year FROM all_samples"))
def _(spark, d):
    return samples(spark, d, list(P.SAMPLES)).select("sample", "company", "year")


OUTCOMES = ["future_cfo", "future_earnings", "future_roa", "current_earnings", "accrual_reversal", "future_cfo_lagged_assets", "future_earnings_lagged_assets"]
from firmlens.catalog.registry import cte  # noqa: E402

cte("outcomes", "derived", """
SELECT *, cfo_lead / nullif(a, 0) AS future_cfo, ni_lead / nullif(a, 0) AS future_earnings, CASE WHEN a_lead > 0 THEN ni_lead / a_lead END AS future_roa,
  ni / nullif(a_lag, 0) AS current_earnings, -(CASE WHEN lead(year) OVER w = year + 1 THEN lead(ta_scaled) OVER w END) AS accrual_reversal,
  CASE WHEN a_lead > 0 THEN cfo_lead / a_lead END AS future_cfo_lead_assets, cfo_lead / nullif(a_lag, 0) AS future_cfo_lagged_assets, ni_lead / nullif(a_lag, 0) AS future_earnings_lagged_assets
FROM derived WINDOW w AS (PARTITION BY company ORDER BY year)""")


@query("prj9_outcomes", sql_with("outcomes", f"SELECT company, year, {cols_sql(OUTCOMES)} FROM outcomes"))
def _(spark, d):
    return P.outcomes(derived(spark, d)).select("company", "year", *cols_df(OUTCOMES))


@query("prj10_precision_weight", sql_with("derived", f"SELECT company, year, {r('1.0 / greatest(sd_cfo * sd_cfo, 0.0001::DOUBLE)', 4)} AS w FROM derived WHERE sd_cfo IS NOT NULL"))
def _(spark, d):
    return derived(spark, d).filter("sd_cfo is not null").select("company", "year", rnd(precision_weight("sd_cfo", 1e-4), 4).alias("w"))


SCORE_SPECS = [("ta_scaled", "absolute_value", "abs(ta_scaled)"), ("roa_curr", "inverse_tail_probability", "1 - roa_curr"), ("size", "identity", "size")]


@query("prj11_score_transforms", sql_with("derived", " UNION ALL ".join(
    f"SELECT company, year, '{s}' AS source_score, '{t}' AS transform, {r(e)} AS score FROM derived WHERE {s} IS NOT NULL" for s, t, e in SCORE_SPECS)))
def _(spark, d):
    from firmlens.operators.compare import transform_score

    df = derived(spark, d)
    rows = F.array(*[
        F.struct(F.lit(s).alias("source_score"), F.lit(t).alias("transform"), transform_score(F.col(s), t).alias("score"))
        for s, t, _e in SCORE_SPECS
    ])
    return df.select("company", "year", F.inline(rows)).filter(F.col("score").isNotNull()).select(
        "company", "year", "source_score", "transform", rnd("score").alias("score"))


@query("prj12_pattern_labels", """
WITH m AS (SELECT p_partkey, p_size, 'M0' || CAST(p_size % 10 AS VARCHAR) AS model_id, p_name || CASE WHEN p_size % 2 = 0 THEN ' (Firm RE + Year)' ELSE ' (Pooled FE)' END AS model_name,
  'Abs(' || CASE p_size % 3 WHEN 0 THEN 'DA_Raw_stacked' WHEN 1 THEN 'z_est' ELSE p_brand END || ')' AS metric, p_retailprice - 1000 AS v FROM part)
SELECT p_partkey, CASE WHEN model_id IN ('M01','M02','M03') THEN 'Jones-family' WHEN model_id IN ('M04','M05','M06') THEN 'Cash-flow/McNichols-family'
  WHEN model_id = 'M07' THEN 'Ball-Shivakumar/asymmetry' WHEN model_id = 'M09' THEN 'No-lookahead/real-time' WHEN model_id = 'M08' THEN 'Secondary volatility'
  WHEN model_id = 'M10' THEN 'Secondary operating-cycle' ELSE model_name END AS family,
  CASE WHEN model_name LIKE '%Firm RE%' THEN 'Firm RE (Random Intercept + Year FE)' ELSE 'Pooled (Industry + Year FE)' END AS variant,
  regexp_replace(model_name, ' \\((Firm RE|Pooled).*$', '') AS base_name,
  CASE p_size % 3 WHEN 0 THEN 'DA_raw' WHEN 1 THEN 'DA_z_estimation' ELSE metric END AS metric_key,
  CASE WHEN v > 0 THEN 'positive' WHEN v < 0 THEN 'negative' WHEN v = 0 THEN 'zero' END AS sign FROM m""")
def _(spark, d):
    size = F.col("p_size")
    m = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("M0"), (size % 10).cast("string")).alias("model_id"),
        F.concat("p_name", F.when(size % 2 == 0, " (Firm RE + Year)").otherwise(" (Pooled FE)")).alias("model_name"),
        F.concat(F.lit("Abs("), F.when(size % 3 == 0, "DA_Raw_stacked").when(size % 3 == 1, "z_est").otherwise(F.col("p_brand")), F.lit(")")).alias("metric"),
        (F.col("p_retailprice") - 1000).alias("v"),
    )
    name = F.col("model_name")
    return m.select(
        "p_partkey", N.model_family(F.col("model_id"), name).alias("family"), N.variant_of(name).alias("variant"),
        N.base_model_name(name).alias("base_name"), N.metric_key(F.col("metric")).alias("metric_key"),
        N.sign_label(F.col("v")).alias("sign"),
    )


@query("prj13_denominator_variants", sql_with("samples", f"""
SELECT sample, company, year, {r('a', 4)} AS den_original, {r('least(greatest(a, p01), p99)', 2)} AS den_winsor_1_99, {r('least(greatest(a, p05), p95)', 2)} AS den_winsor_5_95,
  {r('greatest(a, p01)', 2)} AS den_floor_p01, {r('greatest(a, p05)', 2)} AS den_floor_p05, {r('p50', 2)} AS den_median
FROM samples JOIN (SELECT sample, quantile_cont(a, 0.01) AS p01, quantile_cont(a, 0.05) AS p05, quantile_cont(a, 0.5) AS p50, quantile_cont(a, 0.95) AS p95,
  quantile_cont(a, 0.99) AS p99 FROM samples GROUP BY sample) USING (sample)"""))
def _(spark, d):
    v = prep.denominator_variants(samples(spark, d), ["sample"], "a")
    return v.select("sample", "company", "year", rnd("den_original", 4).alias("den_original"), *cols_df(
        ["den_winsor_1_99", "den_winsor_5_95", "den_floor_p01", "den_floor_p05", "den_median"], 2))


@query("prj14_safe_divide", f"""
SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_tax <> 0 THEN l_discount / l_tax END')} AS ratio FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rnd(safe_div("l_discount", "l_tax")).alias("ratio"))


@query("prj15_model_space_expansion", sql_with("samples", """
SELECT m.model_id, s.space AS target_space, v.variant, m.tier, m.sample_group, CAST(len(string_split(m.required, ',')) AS BIGINT) AS n_required, n.n AS n_obs
FROM (VALUES ('M01','CORE','main_common','inv_a_lag,drev_scaled,ppe_scaled','both'), ('M02','CORE','main_common','inv_a_lag,drev_drec_scaled,ppe_scaled','both'),
 ('M03','CORE','main_common','inv_a_lag,drev_drec_scaled,ppe_scaled,roa_lag','both'), ('M04','CORE','main_common','cfo_lag_scaled,cfo_curr_scaled,cfo_lead_scaled','ex_post'),
 ('M05','CORE','main_common','cfo_lag_scaled,cfo_curr_scaled,cfo_lead_scaled,drev_scaled,ppe_scaled','ex_post'),
 ('M06','CORE','main_common','cfo_lag_scaled,cfo_curr_scaled,cfo_lead_scaled,drev_scaled,ppe_scaled,roa_lag','ex_post'),
 ('M07','CORE','main_common','cfo_curr_scaled,neg_cfo,drev_scaled,ppe_scaled','both'), ('M08','ROBUSTNESS_M08','secondary_volatility','inv_a_lag,drev_drec_scaled,ppe_scaled,roa_lag,size,sd_rev,sd_cfo','ex_post'),
 ('M09','CORE','main_common','cfo_lag_scaled,cfo_curr_scaled,drev_scaled,ppe_scaled,roa_lag,size','real_time'),
 ('M10','ROBUSTNESS_OPERATING_CYCLE','secondary_operating_cycle','inv_a_lag,drev_drec_scaled,ppe_scaled,roa_lag,operating_cycle,sales_growth','both')) AS m(model_id, tier, sample_group, required, spaces)
JOIN (VALUES ('ex_post'), ('real_time')) AS s(space) ON m.spaces IN ('both', s.space)
CROSS JOIN (VALUES ('Pooled (Industry + Year FE)'), ('Firm RE (Random Intercept + Year FE)')) AS v(variant)
JOIN (SELECT sample, count(*) AS n FROM samples GROUP BY sample) n ON n.sample = s.space"""))
def _(spark, d):
    from firmlens.plans.models import model_space

    n = samples(spark, d).groupBy(F.col("sample").alias("target_space")).agg(F.count("*").alias("n_obs"))
    return model_space(spark).join(n, "target_space").select(
        "model_id", "target_space", "variant", "tier", "sample_group", F.size("required").cast("long").alias("n_required"), "n_obs")


# --- joins -------------------------------------------------------------------------------------------

@query("join1_dimension_left_join", sql_with("cleaned", """
SELECT c.company, c.year, m.exchange FROM cleaned c LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS company, n_name AS exchange FROM customer JOIN nation ON c_nationkey = n_nationkey) m USING (company)"""))
def _(spark, d):
    from firmlens.operators.joins import dimension_join

    return dimension_join(cleaned(spark, d), firms(spark, d).select("company", "exchange"), "company").select("company", "year", "exchange")


@query("join1_row_count_check", sql_with("cleaned", """
SELECT (SELECT count(*) FROM cleaned) AS n_before, (SELECT count(*) FROM cleaned LEFT JOIN customer ON company = CAST(c_custkey AS VARCHAR)) AS n_after, CAST(0 AS BIGINT) AS n_duplicate_keys"""))
def _(spark, d):
    from firmlens.operators.joins import dimension_join_report

    return dimension_join_report(cleaned(spark, d), firms(spark, d).select("company", "exchange"), "company")


@query("join2_suffixed_inner_join", sql_with("winsorized", f"""
SELECT x.company, x.year, {r('x.ta_scaled')} AS ta_scaled_ex_post, {r('y.ta_scaled')} AS ta_scaled_real_time
FROM (SELECT * FROM winsorized WHERE sample = 'ex_post') x JOIN (SELECT * FROM winsorized WHERE sample = 'real_time') y ON x.company = y.company AND x.year = y.year"""))
def _(spark, d):
    from firmlens.operators.joins import suffixed_join

    w = winsorized(spark, d).select("sample", "company", "year", "ta_scaled")
    side = lambda s: w.filter(F.col("sample") == s).drop("sample")
    j = suffixed_join(side("ex_post"), side("real_time"), ["company", "year"], "_ex_post", "_real_time")
    return j.select("company", "year", *cols_df(["ta_scaled_ex_post", "ta_scaled_real_time"]))


@query("join4_multi_key_left_join", sql_with("samples", f"""
SELECT s.sample, s.company, s.year, q.n_cell, {r('q.mean_ta')} AS mean_ta FROM samples s
LEFT JOIN (SELECT sample, industry, year, count(*) AS n_cell, avg(ta_scaled) AS mean_ta FROM samples GROUP BY sample, industry, year HAVING count(*) >= 60) q
ON s.sample = q.sample AND s.industry = q.industry AND s.year = q.year"""))
def _(spark, d):
    s = samples(spark, d).select("sample", "company", "year", "industry", "ta_scaled")
    cell = s.groupBy("sample", "industry", "year").agg(F.count("*").alias("n_cell"), F.avg("ta_scaled").alias("mean_ta")).filter("n_cell >= 60")
    return s.join(cell, ["sample", "industry", "year"], "left").select("sample", "company", "year", "n_cell", rnd("mean_ta").alias("mean_ta"))


@query("join5_membership", sql_with("samples", """
SELECT company, year, EXISTS (SELECT 1 FROM samples e WHERE e.sample = 'ex_post' AND e.company = s.company) AS has_ex_post_history
FROM samples s WHERE sample = 'real_time'"""))
def _(spark, d):
    s = samples(spark, d).select("sample", "company", "year")
    rt = s.filter("sample = 'real_time'").drop("sample")
    ep = s.filter("sample = 'ex_post'").select("company")
    yes = rt.join(ep, "company", "left_semi").withColumn("has_ex_post_history", F.lit(True))
    no = rt.join(ep, "company", "left_anti").withColumn("has_ex_post_history", F.lit(False))
    return yes.unionByName(no)


@query("join6_join_coverage", sql_with("samples", """
WITH l AS (SELECT industry, company, year FROM samples WHERE sample = 'real_time'), q AS (SELECT industry, company, year FROM samples WHERE sample = 'ex_post')
SELECT industry, count(l.company) AS left_n, count(q.company) AS right_n, count_if(l.company IS NOT NULL AND q.company IS NOT NULL) AS matched_n,
 count_if(q.company IS NULL) AS left_unmatched_n, count_if(l.company IS NULL) AS right_unmatched_n
FROM l FULL JOIN q USING (industry, company, year) GROUP BY industry"""))
def _(spark, d):
    from firmlens.operators.joins import join_coverage

    s = samples(spark, d).select("sample", "industry", "company", "year")
    side = lambda n: s.filter(F.col("sample") == n).drop("sample")
    return join_coverage(side("real_time"), side("ex_post"), ["company", "year"], ["industry"])


@query("join7_duplicate_keys", """
SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1""")
def _(spark, d):
    from firmlens.operators.joins import duplicate_keys

    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("int").alias("year"))
    return duplicate_keys(o, ["o_custkey", "year"])


@query("join8_planning_grid", sql_with("cleaned", """
SELECT i.industry, y.year, CAST(v.variable AS VARCHAR) AS variable, count(c.company) AS n_rows FROM (SELECT DISTINCT industry FROM cleaned) i CROSS JOIN (SELECT DISTINCT year FROM cleaned) y
CROSS JOIN (VALUES ('ta_scaled'), ('size')) AS v(variable) LEFT JOIN cleaned c ON c.industry = i.industry AND c.year = y.year GROUP BY ALL"""))
def _(spark, d):
    from firmlens.operators.joins import planning_grid

    cells = cleaned(spark, d).groupBy("industry", "year").agg(F.count("*").alias("n_rows"))
    grid = planning_grid(cells.select("industry").distinct(), cells.select("year").distinct(), spark.createDataFrame([("ta_scaled",), ("size",)], "variable string"))
    return grid.join(cells, ["industry", "year"], "left").select("industry", "year", "variable", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


# --- windows over firms -------------------------------------------------------------------------------

@query("win1_contiguous_lag_lead", sql_with("lagged", f"SELECT company, year, {r('a_lag', 4)} AS a_lag, {r('rev_lag', 4)} AS rev_lag, {r('cfo_lead', 4)} AS cfo_lead FROM lagged"))
def _(spark, d):
    return derived(spark, d).select("company", "year", *cols_df(["a_lag", "rev_lag", "cfo_lead"], 4))


@query("win2_rolling_sd", sql_with("derived", f"SELECT company, year, {r('sd_rev')} AS sd_rev, {r('sd_cfo')} AS sd_cfo FROM derived"))
def _(spark, d):
    return derived(spark, d).select("company", "year", *cols_df(["sd_rev", "sd_cfo"]))


@query("win10_panel_tenure", sql_with("cleaned", """
SELECT company, year, min(year) OVER w AS first_year, max(year) OVER w AS last_year, count(*) OVER w AS panel_length, year - min(year) OVER w + 1 AS firm_age
FROM cleaned WINDOW w AS (PARTITION BY company)"""))
def _(spark, d):
    return P.tenure(cleaned(spark, d)).select("company", "year", "first_year", "last_year", "panel_length", "firm_age")


# --- sort, limit and set operations -------------------------------------------------------------------

@query("set1_top_operating_cycle", sql_with("derived", f"""
SELECT company, year, industry, {r('operating_cycle')} AS operating_cycle FROM derived WHERE operating_cycle IS NOT NULL ORDER BY derived.operating_cycle DESC, company, year LIMIT 50"""))
def _(spark, d):
    top = derived(spark, d).filter(~missing("operating_cycle")).orderBy(F.desc("operating_cycle"), "company", "year").limit(50)
    return top.select("company", "year", "industry", rnd("operating_cycle").alias("operating_cycle"))


@query("set2_union_by_name", sql_with("samples", f"""
SELECT company, year, {r('cfo_lead_scaled')} AS cfo_lead_scaled, NULL::DOUBLE AS size FROM samples WHERE sample = 'ex_post'
UNION ALL SELECT company, year, NULL, {r('size')} FROM samples WHERE sample = 'real_time'"""))
def _(spark, d):
    s = samples(spark, d)
    a = s.filter("sample = 'ex_post'").select("company", "year", rnd("cfo_lead_scaled").alias("cfo_lead_scaled"))
    b = s.filter("sample = 'real_time'").select("company", "year", rnd("size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set3_distinct", sql_with("samples", "SELECT DISTINCT sample, industry, year FROM samples"))
def _(spark, d):
    return samples(spark, d).select("sample", "industry", "year").distinct()


@query("set4_set_difference", sql_with("samples", """
(SELECT company, year, 'real_time_only' AS membership FROM samples WHERE sample = 'real_time' EXCEPT SELECT company, year, 'real_time_only' FROM samples WHERE sample = 'ex_post')
UNION ALL (SELECT company, year, 'both' FROM samples WHERE sample = 'real_time' INTERSECT SELECT company, year, 'both' FROM samples WHERE sample = 'ex_post')"""))
def _(spark, d):
    s = samples(spark, d).select("sample", "company", "year")
    rt, ep = (s.filter(F.col("sample") == n).drop("sample") for n in ("real_time", "ex_post"))
    return rt.subtract(ep).withColumn("membership", F.lit("real_time_only")).unionByName(
        rt.intersect(ep).withColumn("membership", F.lit("both")))


# --- preprocessing ------------------------------------------------------------------------------------

W_REPORT = ["ta_scaled", "drev_scaled", "ppe_scaled", "roa_lag", "sales_growth", "operating_cycle"]


@query("pre1_winsorize", sql_with("winsorized", f"SELECT sample, company, year, {cols_sql(W_REPORT)} FROM winsorized"))
def _(spark, d):
    w = prep.winsorize(samples(spark, d), ["sample"], W_REPORT)
    return w.select("sample", "company", "year", *cols_df(W_REPORT))


@query("pre2_cutoff_report", sql_with("samples", f"""
WITH l AS (SELECT * FROM {unpivot_sql("samples", "sample", W_REPORT)}), q AS (SELECT sample, variable, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM l GROUP BY ALL)
SELECT sample, variable, {r('max(lo)')} AS lo, {r('max(hi)')} AS hi, count(*) AS n_obs, count_if(x < lo) AS n_below, count_if(x > hi) AS n_above,
 {r('count_if(x < lo) / count(*)::DOUBLE')} AS share_below, {r('count_if(x > hi) / count(*)::DOUBLE')} AS share_above FROM l JOIN q USING (sample, variable) GROUP BY sample, variable"""))
def _(spark, d):
    rep = prep.cutoff_report(samples(spark, d), ["sample"], W_REPORT)
    return rep.select("sample", "variable", *cols_df(["lo", "hi", "share_below", "share_above"]), "n_obs", "n_below", "n_above")


@query("pre3_before_after", sql_with("samples winsorized", f"""
WITH b AS (SELECT sample, variable, stddev_samp(x) AS sd_before, min(x) AS min_before, max(x) AS max_before FROM {unpivot_sql("samples", "sample", W_REPORT)} GROUP BY ALL),
a AS (SELECT sample, variable, stddev_samp(x) AS sd_after, min(x) AS min_after, max(x) AS max_after FROM {unpivot_sql("winsorized", "sample", W_REPORT)} GROUP BY ALL)
SELECT sample, variable, {cols_sql(['sd_before', 'sd_after', 'min_before', 'min_after', 'max_before', 'max_after'])},
 {r('100 * (1 - sd_after / nullif(sd_before, 0))')} AS sd_reduction_pct, {r('abs(max_before) / abs(nullif(max_after, 0))')} AS max_reduction_ratio FROM a JOIN b USING (sample, variable)"""))
def _(spark, d):
    s = samples(spark, d)
    rep = prep.before_after(s, prep.winsorize(s, ["sample"], W_REPORT), ["sample"], W_REPORT)
    return rep.select("sample", "variable", *cols_df([c for c in rep.columns if c not in ("sample", "variable")]))


Z_VARS = ["drev_scaled", "ppe_scaled", "roa_lag", "size"]


def zscore_sql(src, keys, cols):
    return ", ".join(
        f"CASE WHEN stddev_samp({c}) OVER z > 0 THEN ({c} - avg({c}) OVER z) / stddev_samp({c}) OVER z ELSE 0 END AS {c}" for c in cols)


@query("pre4_zscore", sql_with("winsorized", f"""
SELECT sample, company, year, {cols_sql(Z_VARS)} FROM (SELECT sample, company, year, {zscore_sql("winsorized", "sample", Z_VARS)} FROM winsorized WINDOW z AS (PARTITION BY sample))"""))
def _(spark, d):
    z = prep.zscore(winsorized(spark, d), ["sample"], Z_VARS)
    return z.select("sample", "company", "year", *cols_df(Z_VARS))
