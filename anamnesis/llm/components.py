"""Connected components of a link table, by label propagation with pointer jumping.

Links and labels stay distributed; every round is a written table in the shared folder, and
replaces the one before. Nodes of one component meet in the join on their label: rows of two
narrow columns, in a join that adaptive execution splits where they are many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected links (a, b): label is the smallest node reachable."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(near.join(up, "label").select("node", "old", F.least("label", "further").alias("label")), "cc-labels")
        discard(labels)
        moved = after.filter(F.col("old") != F.col("label")).limit(1).count()
        labels = after.select("node", "label")
        labels.work_path = after.work_path
        if not moved:
            discard(both)
            return labels
