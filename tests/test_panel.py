"""Panel semantics on inline literals: gaps, missing values, duplicates, empty input."""

import math

import pytest
from pyspark.sql import functions as F

from firmlens.functions import naming as N
from firmlens.functions.columns import clamp, finite, join_key, lgamma, parse_flag, safe_div, to_double
from firmlens.operators import panel as P
from firmlens.operators import prep
from firmlens.operators.joins import assert_unique, dimension_join

RAW = "company string, year int, industry string, se int, a double, ni double, rev double, cfo double, rec double, ppe double, roa double, cogs double, inv double"


def firm(c, y, a=100.0, rev=50.0, cfo=5.0, rec=10.0, ppe=20.0, cogs=30.0, inv=4.0, ni=8.0, ind="X"):
    return (c, y, ind, 1, a, ni, rev, cfo, rec, ppe, ni / a if a else None, cogs, inv)


def test_contiguous_lag_and_lead(spark):
    df = spark.createDataFrame([("f", 2016, 10.0), ("f", 2017, 20.0), ("f", 2019, 40.0)], "company string, year int, x double")
    out = df.select("year", P.lag_contiguous("x").alias("lag"), P.lead_contiguous("x").alias("lead")).orderBy("year").collect()
    assert [r.lag for r in out] == [None, 10.0, None]
    assert [r.lead for r in out] == [20.0, None, None]


def test_rolling_sd(spark):
    rows = [("f", 2016, 1.0), ("f", 2017, 2.0), ("f", 2018, 4.0), ("g", 2016, 1.0), ("g", 2018, 2.0), ("g", 2019, 4.0),
            ("h", 2016, 1.0), ("h", 2017, None), ("h", 2018, 4.0), ("i", 2016, 1.0), ("i", 2017, float("nan")), ("i", 2018, 4.0)]
    df = spark.createDataFrame(rows, "company string, year int, x double")
    got = {(r.company, r.year): r.s for r in df.select("company", "year", P.rolling_sd3("x").alias("s")).collect()}
    assert got[("f", 2018)] == pytest.approx(math.sqrt(7 / 3))
    assert all(v is None for k, v in got.items() if k != ("f", 2018))


def test_row_status_order_and_samples(spark):
    rows = [firm("a", y) for y in (2016, 2017, 2018, 2019)] + [firm("b", 2016), firm("b", 2017, rec=0.0), firm("b", 2018)] + [firm("c", 2016, a=0.0), firm("c", 2017)]
    df = P.derive(P.clean_rows(spark.createDataFrame(rows, RAW), 2015))
    st = {(r.company, r.year): r.s for r in df.select("company", "year", P.row_status().alias("s")).collect()}
    assert st[("a", 2016)] == "denominator_invalid"
    assert st[("a", 2017)] == "optional_variable_missing"
    assert st[("a", 2018)] == "optional_variable_missing" or st[("a", 2018)] == "eligible"
    assert st[("a", 2019)] == "lead_missing"
    assert st[("b", 2017)] == "data_invalid"
    assert st[("b", 2018)] == "lag_missing"
    assert ("c", 2016) not in st
    names = P.stacked_samples(df, ["ex_post", "real_time"]).groupBy("sample").count().collect()
    assert {r["sample"]: r["count"] for r in names} == {"ex_post": 2, "real_time": 3}


def test_empty_panel(spark):
    df = P.derive(P.clean_rows(spark.createDataFrame([], RAW), 2015))
    assert P.stacked_samples(df).count() == 0
    assert prep.cutoffs(df, [], ["ta_scaled"]).count() == 0


def test_duplicate_years_break_contiguity(spark):
    df = spark.createDataFrame([("f", 2016, 1.0), ("f", 2017, 2.0), ("f", 2017, 3.0), ("f", 2018, 4.0)], "company string, year int, x double")
    lags = [r.lag for r in df.select("year", "x", P.lag_contiguous("x", 2).alias("lag")).orderBy("year", "x").collect()]
    assert lags[-1] is None  # two rows back is still the previous year


def test_winsorize_keeps_null_and_clamps(spark):
    vals = [None, -100.0, 0.0, 1.0, 2.0, 100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, x double")
    out = [r.x for r in prep.winsorize(df, [], ["x"]).orderBy("id").collect()]
    assert out[0] is None
    assert out[1] == pytest.approx(-96.0) and out[5] == pytest.approx(96.08)
    assert out[2:5] == [0.0, 1.0, 2.0]


def test_zscore_of_constant_is_zero(spark):
    df = spark.createDataFrame([("s", 3.0), ("s", 3.0)], "sample string, x double")
    assert {r.x for r in prep.zscore(df, ["sample"], ["x"]).collect()} == {0.0}


def test_complement_moments_equal_refit(spark):
    rows = [(i % 3 + 1, float(i * i % 17) + 1e6) for i in range(60)]
    df = spark.createDataFrame(rows, "fold_id int, x double")
    got = {r.fold: (r.mean, r.sd) for r in prep.complement_moments(df, [], ["x"]).collect()}
    for k in (1, 2, 3):
        ref = df.filter(F.col("fold_id") != k).agg(F.avg("x"), F.stddev_samp("x")).first()
        assert got[k][0] == pytest.approx(ref[0], rel=1e-12) and got[k][1] == pytest.approx(ref[1], rel=1e-9)


def test_column_helpers(spark):
    df = spark.createDataFrame([(1.0, " a ", "TRUE"), (float("nan"), "", "no"), (float("inf"), None, "?"), (None, "1.5", "1")], "x double, s string, f string")
    got = df.select(finite("x").alias("fin"), join_key("s").alias("k"), to_double("s").alias("n"), parse_flag("f").alias("p"), clamp("x", F.lit(0.0), F.lit(0.5)).alias("c")).collect()
    assert [r.fin for r in got] == [True, False, False, False]
    assert [r.k for r in got] == ["a", None, None, "1.5"]
    assert [r.n for r in got][3] == 1.5 and got[0].n is None
    assert [r.p for r in got] == [True, False, None, True]
    assert got[3].c is None and got[0].c == 0.5
    d = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (float("inf"), 1.0)], "a double, b double")
    assert [r[0] for r in d.select(safe_div("a", "b")).collect()] == [None, 0.25, None]


def test_lgamma(spark):
    xs = [0.5, 1.0, 2.5, 7.0, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, r in zip(xs, df.select(lgamma("x").alias("g")).collect()):
        assert r.g == pytest.approx(math.lgamma(x), abs=1e-11)


@pytest.mark.parametrize("name", ["Mã", "Ma", "Mã CK", "Ticker", "company", "Symbol"])
def test_metadata_key_detection(name):
    assert N.resolve_column([name, "Industry"], N.METADATA_KEYS) == name


def test_metadata_key_missing_lists_columns():
    with pytest.raises(ValueError, match="Industry, Sector"):
        N.resolve_column(["Industry", "Sector"], N.METADATA_KEYS)


def test_unique_dimension(spark):
    dim = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError, match="not unique"):
        dimension_join(spark.createDataFrame([("a",)], "k string"), dim, "k")
    assert assert_unique(dim, ["k", "v"], "dim") is dim


def test_write_and_fingerprint_round_trip(spark, tmp_path):
    from firmlens.sources.sinks import file_manifest, table_fingerprint, write_table
    from firmlens.sources.tables import read_table

    df = spark.createDataFrame([(i, f"v{i}", "s" if i % 2 else "t") for i in range(50)], "id int, v string, target_space string")
    write_table(df, str(tmp_path / "a"), str(tmp_path / "b"), partition_by=["target_space"])
    for p in ("a", "b"):
        back = read_table(spark, str(tmp_path / p))
        assert table_fingerprint(back, df.columns).first() == table_fingerprint(df.repartition(7)).first()
    (tmp_path / "x.txt").write_text("hello")
    got = {r.path.rsplit("/", 1)[1]: (r.file_exists, r.size_bytes, r.md5) for r in file_manifest(spark, [str(tmp_path / "x.txt"), str(tmp_path / "none.txt")], "input").collect()}
    assert got == {"x.txt": (True, 5, "5d41402abc4b2a76b9719d911017c592"), "none.txt": (False, None, None)}
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none.parquet"))


def test_published_table_is_complete_or_absent(spark, tmp_path):
    import glob
    import os

    from firmlens.sources.sinks import publish, published, verify_published

    path = str(tmp_path / "table")
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(50)], "k int, g string")
    with pytest.raises(FileNotFoundError):
        published(spark, path)
    manifest = publish(df, path, partition_by=["g"], rows_per_file=10)
    rows = manifest.collect()
    assert len(rows) >= 6 and {r.n_rows for r in rows} == {50} and {r.role for r in rows} == {"output"} and len({r.md5 for r in rows}) == len(rows)
    assert sorted(map(tuple, published(spark, path, df.schema).select("k", "g").collect())) == sorted(map(tuple, df.collect()))
    assert all(r.in_manifest and r.file_exists and r.size_matches and r.md5_matches for r in verify_published(spark, path).collect())
    hit = sorted(glob.glob(f"{path}/_data/g=a/*.parquet"))
    data = open(hit[0], "rb").read()
    os.remove(os.path.join(os.path.dirname(hit[0]), f".{os.path.basename(hit[0])}.crc"))  # else the local file system refuses the file itself
    open(hit[0], "wb").write(data[:-1] + bytes([data[-1] ^ 1]))
    open(f"{path}/_data/g=a/stranger.parquet", "wb").write(data)
    states = [(r.in_manifest, r.size_matches, r.md5_matches) for r in verify_published(spark, path).collect()]
    assert states.count((True, True, False)) == 1 and states.count((False, False, False)) == 1
    assert publish(df.limit(0), str(tmp_path / "none")).where("n_rows > 0").count() == 0


def test_drift_check_blocks_on_score_totals(spark):
    from firmlens.operators.quality import drift_check

    coefs = [spark.createDataFrame([("x", "A.b", v), ("y", "A.b", 1.0), ("z", "A.b", 1.0), ("w", "A.b", 1.0)], "g string, n string, v double") for v in (1.0, 1.01)]
    totals = tuple(spark.createDataFrame([("x", 0.0), ("y", t), ("z", 0.0)], "g string, total double") for t in (-100.0, -110.0))
    got = {r.g: (r.shift_blocked, r.blocked) for r in drift_check(coefs[0], coefs[1], ["g"], "n", "v", totals=totals).collect()}
    assert got == {"x": (False, True), "y": (True, True), "z": (False, False), "w": (True, True)}
