"""Weakly connected components of long edge tables, and places in an order of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobath.sources.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node of it) for every node of ``edges`` (``a``, ``b``).

    Labels move to the least neighbour's and then to their label's label, so the rounds follow the
    logarithm of a chain's length.  Every round is staged.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    while True:
        labels = stage(labels, "labels")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        further = hop.select(F.col("node").alias("to"), F.col("to").alias("further"))
        labels_new = stage(hop.join(further, "to").select("node", "was", F.least("to", "further").alias("component")), "labels")
        if labels_new.where("component <> was").isEmpty():
            return labels_new.select("node", "component")
        labels = labels_new.select("node", "component")


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 1, among all rows in the order of the columns ``order``.

    Rows are dealt by ranges of the order and counted there; a range's rows follow those of the ranges
    before it, so no task sees more than its own.  Rows equal in ``order`` lie in one range.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(rows.repartitionByRange(width, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("__range", "n"))).alias("c"))
    before = F.transform("c", lambda x: F.struct(x["__range"].alias("__range"), F.aggregate(F.filter("c", lambda y: y["__range"] < x["__range"]), F.lit(0).cast("long"), lambda total, y: total + y["n"]).alias("__before")))
    offsets = counts.select(F.inline(before))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return placed.withColumn("__own", own).join(F.broadcast(offsets), "__range").withColumn(name, F.col("__own") + F.col("__before")).drop("__range", "__own", "__before")  # a row per range
