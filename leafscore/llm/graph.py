"""Connected components of a link table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscore.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``: the smallest node reachable.

    Each round every node takes the smallest label among its neighbours, then the label of its label, so paths
    shrink at least by half. Labels are pre-aggregated before the exchange and tables are written every round, so a
    node with very many links is split by the skew join and no lineage grows.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        offered = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        met = labels.join(offered, "node").select("node", "label", F.least("label", "offer").alias("next"))
        met = stored(met, "labels")
        root = met.select(F.col("node").alias("root"), F.col("next").alias("root_label"))
        jumped = stored(met.join(root, F.col("next") == F.col("root")).select(
            "node", F.least("next", "root_label").alias("label"), (F.least("next", "root_label") < F.col("label")).alias("moved")), "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")
