"""Connected components as Spark joins: labels only ever shrink, and paths are halved by following labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.session import materialise, scratch


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, comp): ``comp`` is the smallest node reachable from ``node``.

    Nodes without edges are absent. Each round writes its labels to the shared folder, so lineage stays
    short and a lost executor costs one round at most. A node with very many edges is one key of a plain
    equi-join, which adaptive execution splits; the minimum over its neighbours is combined before shuffling. Only the
    last labels are kept.
    """
    with scratch(edges.sparkSession):
        return materialise(_settled(edges), "components", outer=True)


def _settled(edges: DataFrame) -> DataFrame:
    both = materialise(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links"
    )
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        seen = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        )
        lower = labels.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        step = materialise(
            lower.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("above", "comp")).alias("comp")), "labels"
        )
        moved = step.where("was <> comp").limit(1).count()
        labels = step.drop("was")
        if not moved:
            return labels
