"""Connected components of a graph given by its edges, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobath.llm.common import attach, cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node that can be reached, of every node in ``edges`` (``a``, ``b``).

    Each round a node takes the least label among its own and its neighbours', then the label of
    that label, so labels travel distances that double.  A round's labels are written to the shared
    folder.  Nodes with one label, which may be most of them, meet it through ``attach``'s cells.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        # the label of the label: it is the node of a row too, so both kinds of rows meet by key
        asked = hop.select(F.col("to").alias("key"), "node", "was", F.lit(None).cast("long").alias("answer"))
        known = hop.select(F.col("node").alias("key"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("was"), F.col("to").alias("answer"))
        met = attach(asked.union(known), ["key"], ["node"], {"further": (F.min("answer"), F.min)})
        new = cut(met.where("node is not null").select("node", "was", F.least("key", "further").alias("label")), "labels")
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
