"""Writing result tables and fingerprinting files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, *paths: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite ``df`` under every path (a result may be published to two roots)."""
    for path in paths:
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def file_manifest(spark: SparkSession, paths: list[str], role: str) -> DataFrame:
    """path, exists, size, mtime, md5 and role of files; absent files stay as rows.

    Only for small artefact files: ``binaryFile`` holds one file per row.
    """
    from firmlens.sources.tables import path_exists

    present = [p for p in paths if path_exists(spark, p)]
    listed = spark.createDataFrame([(p, p in present, role) for p in paths], "path string, file_exists boolean, role string")
    if not present:
        return listed
    stats = spark.read.format("binaryFile").load(present).select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        F.md5("content").alias("md5"),
    )
    return listed.join(stats, "path", "left")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """path (below the table's folder), size_bytes, modified and md5 of every Parquet file of a table, one file a row and a task's work."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    inner = F.element_at(F.split("path", "/_data/"), -1)
    return files.select(inner.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"))


def publish(df: DataFrame, path: str, role: str = "output", partition_by: list[str] | None = None, rows_per_file: int = 1_000_000) -> DataFrame:
    """Write ``df`` under ``path`` and commit it with a manifest: one row per file with size, time, md5 and role, and the table's row count and fingerprint.

    Data go to ``path/_data`` first, then they are listed and read back, and ``path/_manifest`` is written last: a folder without it holds no
    complete table. ``rows_per_file`` keeps files small enough to be digested whole.
    """
    spark = df.sparkSession
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/_data")
    told = table_fingerprint(spark.read.schema(df.schema).parquet(f"{path}/_data"), df.columns)
    manifest = _listed(spark, f"{path}/_data").crossJoin(F.broadcast(told)).withColumn("role", F.lit(role))  # one row of totals
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def published(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of a committed table; without a manifest it is an error."""
    from firmlens.sources.tables import path_exists

    if not path_exists(spark, f"{path}/_manifest/_SUCCESS"):
        raise FileNotFoundError(f"{path} has no manifest: the table was not committed")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/_data")


def verify_published(spark: SparkSession, path: str) -> DataFrame:
    """One row per file that the manifest or the folder knows: ``in_manifest, file_exists, size_matches, md5_matches``."""
    was = spark.read.parquet(f"{path}/_manifest").select("path", F.col("size_bytes").alias("_s"), F.col("md5").alias("_m"))
    now = _listed(spark, f"{path}/_data").select(F.col("path").alias("_p"), "size_bytes", "md5")
    j = was.join(now, F.col("path") == F.col("_p"), "full")
    return j.select(
        F.coalesce("path", "_p").alias("path"), F.col("path").isNotNull().alias("in_manifest"), F.col("_p").isNotNull().alias("file_exists"),
        F.coalesce(F.col("_s") == F.col("size_bytes"), F.lit(False)).alias("size_matches"), F.coalesce(F.col("_m") == F.col("md5"), F.lit(False)).alias("md5_matches"),
    )


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and an order-insensitive content hash in one pass without moving rows.

    Per-row md5 halves are summed as exact decimals, so the result does not depend on partitioning.
    """
    columns = columns or df.columns
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns]))
    part = F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(part).cast("string").alias("fingerprint"))
