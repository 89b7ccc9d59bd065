"""Connected components of a table of links, by rounds of label passing with written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.staging import Stage


def label_components(links: DataFrame, stage: Stage) -> DataFrame:
    """Give every node of ``links`` (a, b) its component's smallest node: (node, label).

    In a round a node takes the smallest label among its neighbours, then its label's label. A
    node that many others link to is pre-aggregated before it is shuffled. Rounds are written, so
    that a lost executor costs no more than one of them; they end when no label changes.
    """
    edges = stage.write(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges"
    )
    labels = stage.write(
        edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels"
    )
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        lower = stage.write(lower, "lower")
        jumped = lower.join(
            lower.select(F.col("node").alias("label"), F.col("label").alias("beyond")), "label", "left"
        ).select("node", "before", F.least("label", F.coalesce("beyond", "label")).alias("label"))
        jumped = stage.write(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> before").isEmpty():
            return labels
