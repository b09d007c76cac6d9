"""Inputs shared by the registered queries, and the SQL text of the same inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.catalog.registry import cte
from firmlens.operators import cv
from firmlens.operators import panel as P
from firmlens.operators import prep
from firmlens.operators.joins import suffixed_join
from firmlens.plans.closed_form import held_out_da
from firmlens.session import materialise
from firmlens.sources.tables import driver_table, firm_dimension, firm_year_panel

BASE_YEAR = 1995
K = 5


def table(spark, d, name):
    return driver_table(spark, d, name)


def firm_years(spark, d):
    return firm_year_panel(spark, d)


def cleaned(spark, d):
    return P.clean_rows(firm_years(spark, d), BASE_YEAR)


_STAGES: dict[tuple, object] = {}


def stage(spark, d, name, build):
    """A stage table: built once per session and data folder, written to the shared folder, then read."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STAGES:
        _STAGES[key] = materialise(build(), name)
    return _STAGES[key]


def derived(spark, d):
    """The derived firm-year panel, the stage table most queries start from."""
    return stage(spark, d, "derived", lambda: P.derive(cleaned(spark, d)))


def samples(spark, d, names=("ex_post", "real_time")):
    return P.stacked_samples(derived(spark, d), list(names))


def winsorized(spark, d):
    """Both main samples winsorized at 1/99, a stage table."""
    return stage(spark, d, "winsorized", lambda: prep.winsorize(samples(spark, d), ["sample"], P.WINSOR_VARS))


def folded(spark, d, scheme):
    """Winsorized rows of both samples with their fold under the row or the grouped scheme."""
    w = winsorized(spark, d)
    if scheme == "row":
        return stage(spark, d, "folded_row", lambda: cv.row_folds(w, K, keys=["sample"]))
    folds = lambda: w.join(cv.grouped_folds(w, K).drop("industry"), "company")
    return stage(spark, d, "folded_grouped", folds)


def da_table(spark, d):
    """Held-out DA under both schemes, a stage table."""
    one = lambda s: held_out_da(folded(spark, d, s), s, ["sample"])
    return stage(spark, d, "da", lambda: one("row").unionByName(one("grouped")))


def da_joined(spark, d):
    """Row and grouped DA side by side per firm-year."""
    da = da_table(spark, d)
    cols = ["nda_mean", "nda_sd_epred", "nda_sd_predict", "da_raw", "da_z_est", "da_z_pred", "tail95", "tail98"]
    side = lambda s: da.filter(F.col("scheme") == s).select("sample", "company", "year", "industry", *cols)
    return stage(spark, d, "da_joined", lambda: suffixed_join(side("row"), side("grouped"), ["sample", "company", "year", "industry"], "_row", "_grouped"))


def firms(spark, d):
    return firm_dimension(spark, d)


cte("firm_years", "", """
SELECT CAST(o_custkey AS VARCHAR) AS company, CAST(year(o_orderdate) AS INTEGER) AS year, max(c_mktsegment) AS industry,
  max(n_regionkey) AS se, sum(o_totalprice) AS a, sum(rev) - sum(cogs) AS ni, sum(rev) AS rev, sum(cfo) AS cfo,
  sum(rec) AS rec, sum(ppe) AS ppe, (sum(rev) - sum(cogs)) / sum(o_totalprice) AS roa, sum(cogs) AS cogs, sum(inv) AS inv
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount)) AS rev, sum(l_quantity * p_retailprice) AS cogs,
        sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS rec,
        sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) AS ppe,
        sum(CASE WHEN l_linestatus = 'O' THEN l_quantity * p_retailprice ELSE 0 END) AS inv,
        sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice ELSE 0 END) AS cfo
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON o_orderkey = k
GROUP BY o_custkey, year(o_orderdate)""")

cte("cleaned", "firm_years", f"""
SELECT company, year, industry, se, a, ni, rev, cfo, nullif(rec, 0) AS rec, nullif(ppe, 0) AS ppe, roa,
  nullif(cogs, 0) AS cogs, inv FROM firm_years WHERE a <> 0 AND year > {BASE_YEAR}""")


def _lag(v, n=1, fn="lag", sign="-", alias=None):
    w = "OVER (PARTITION BY company ORDER BY year)"
    return f"CASE WHEN {fn}(year, {n}) {w} = year {sign} {n} THEN {fn}({v}, {n}) {w} END AS {alias or v + '_' + fn}"


cte("lagged", "cleaned", "SELECT *, " + ", ".join(
    [_lag(v) for v in ("a", "rev", "rec", "cfo", "roa")] + [_lag(v, fn="lead", sign="+") for v in ("cfo", "ni", "a")]
) + " FROM cleaned")

cte("scaled", "lagged", """
SELECT *, (ni - cfo) / d AS ta_scaled, 1.0 / d AS inv_a_lag, (rev - rev_lag) / d AS drev_scaled, (rec - rec_lag) / d AS drec_scaled,
  ((rev - rev_lag) - (rec - rec_lag)) / d AS drev_drec_scaled, ppe / d AS ppe_scaled, roa AS roa_curr, cfo_lag / d AS cfo_lag_scaled,
  cfo / d AS cfo_curr_scaled, cfo_lead / d AS cfo_lead_scaled,
  CASE WHEN cfo / d < 0 THEN 1 WHEN cfo / d >= 0 THEN 0 END AS neg_cfo, CASE WHEN ni / d < 0 THEN 1 WHEN ni / d >= 0 THEN 0 END AS neg_earn,
  CASE WHEN a > 0 THEN ln(a) END AS size, rev / d AS rev_scaled
FROM (SELECT *, nullif(a_lag, 0) AS d FROM lagged)""")

cte("derived", "scaled", """
SELECT *, CASE WHEN ok3 AND count(rev_scaled) OVER w3 = 3 THEN stddev_samp(rev_scaled) OVER w3 END AS sd_rev,
  CASE WHEN ok3 AND count(cfo_curr_scaled) OVER w3 = 3 THEN stddev_samp(cfo_curr_scaled) OVER w3 END AS sd_cfo,
  CASE WHEN rev > 0 AND cogs > 0 THEN rec / rev + inv / cogs END AS operating_cycle,
  CASE WHEN rev_lag > 0 THEN rev / rev_lag - 1 END AS revenue_growth, CASE WHEN rev_lag > 0 THEN rev / rev_lag - 1 END AS sales_growth
FROM (SELECT *, lag(year, 1) OVER w = year - 1 AND lag(year, 2) OVER w = year - 2 AS ok3 FROM scaled WINDOW w AS (PARTITION BY company ORDER BY year))
WINDOW w3 AS (PARTITION BY company ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")


def present_sql(cols):
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


cte("samples", "derived", " UNION ALL ".join(
    f"SELECT '{s}' AS sample, * FROM derived WHERE {present_sql(P.SAMPLES[s])}" for s in ("ex_post", "real_time")))
cte("all_samples", "derived", " UNION ALL ".join(
    f"SELECT '{s}' AS sample, * FROM derived WHERE {present_sql(cols)}" for s, cols in P.SAMPLES.items()))


def winsor_select(src: str, keys: str, cols) -> str:
    cuts = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in cols)
    rep = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END AS {c}" for c in cols)
    return (f"SELECT s.* REPLACE ({rep}) FROM {src} s JOIN (SELECT {keys}, {cuts} FROM {src} GROUP BY {keys}) q USING ({keys})")


cte("winsorized", "samples", winsor_select("samples", "sample", P.WINSOR_VARS))

cte("folds_grouped", "samples", """
SELECT company, industry, CAST((row_number() OVER (PARTITION BY industry ORDER BY md5(concat_ws(':', '42', 'grouped', company)), company) - 1) % 5 + 1 AS INTEGER) AS fold_id
FROM (SELECT company, arg_min(industry, (-n, industry)) AS industry FROM (SELECT company, industry, count(*) AS n FROM samples GROUP BY ALL) GROUP BY company)""")

cte("folds_row", "samples", """
SELECT sample, company, year, industry, CAST(CASE WHEN n = 1 THEN CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 5 + 1 ELSE (pos - 1) % least(n, 5) + 1 END AS INTEGER) AS fold_id
FROM (SELECT sample, company, year, industry, h, row_number() OVER (PARTITION BY sample, company ORDER BY h, year) AS pos, count(*) OVER (PARTITION BY sample, company) AS n
  FROM (SELECT *, md5(concat_ws(':', '42', 'row', company, CAST(year AS VARCHAR))) AS h FROM samples))""")

cte("folded_grouped", "winsorized folds_grouped", "SELECT w.*, f.fold_id FROM winsorized w JOIN folds_grouped f USING (company)")
cte("folded_row", "winsorized folds_row", "SELECT w.*, f.fold_id FROM winsorized w JOIN folds_row f USING (sample, company, year)")


def _da_sql(s):
    return f"""
SELECT '{s}' AS scheme, sample, company, year, industry, fold_id, ta_scaled, CAST(fn AS BIGINT) AS firm_train_rows, nda_mean,
  sd / sqrt(n + fn) AS nda_sd_epred, sd * sqrt(1 + 1 / (n + fn)) AS nda_sd_predict
FROM (SELECT r.*, n, fn, sqrt(greatest((ss - s * s / n) / (n - 1), 0)) AS sd, s / n + CASE WHEN fn > 0 THEN fn / (fn + 1.0) * (fs / fn - s / n) ELSE 0 END AS nda_mean
  FROM folded_{s} r
  JOIN (SELECT sample, industry, fold_id, sum(n) OVER w - n AS n, sum(s) OVER w - s AS s, sum(ss) OVER w - ss AS ss
        FROM (SELECT sample, industry, fold_id, count(*)::DOUBLE AS n, sum(ta_scaled) AS s, sum(ta_scaled * ta_scaled) AS ss FROM folded_{s} GROUP BY ALL)
        WINDOW w AS (PARTITION BY sample, industry)) i USING (sample, industry, fold_id)
  JOIN (SELECT sample, company, fold_id, sum(n) OVER w - n AS fn, sum(s) OVER w - s AS fs
        FROM (SELECT sample, company, fold_id, count(*)::DOUBLE AS n, sum(ta_scaled) AS s FROM folded_{s} GROUP BY ALL)
        WINDOW w AS (PARTITION BY sample, company)) f USING (sample, company, fold_id))"""


cte("da", "folded_row folded_grouped", f"""
SELECT *, CAST(abs(da_z_pred) > 1.959964 AS INTEGER) AS tail95, CAST(abs(da_z_pred) > 2.326348 AS INTEGER) AS tail98 FROM
(SELECT *, round(ta_scaled - nda_mean, 9) AS da_raw, round((ta_scaled - nda_mean) / nullif(nda_sd_epred, 0), 9) AS da_z_est, round((ta_scaled - nda_mean) / nullif(nda_sd_predict, 0), 9) AS da_z_pred
 FROM ({_da_sql("row")} UNION ALL {_da_sql("grouped")}))""")

cte("da_joined", "da", "SELECT sample, company, year, industry, " + ", ".join(
    f"r.{c} AS {c}_row, g.{c} AS {c}_grouped" for c in ("nda_mean", "nda_sd_epred", "nda_sd_predict", "da_raw", "da_z_est", "da_z_pred", "tail95", "tail98")
) + " FROM (SELECT * FROM da WHERE scheme = 'row') r JOIN (SELECT * FROM da WHERE scheme = 'grouped') g USING (sample, company, year, industry)")
