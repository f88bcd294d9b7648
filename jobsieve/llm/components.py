"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """``(id, comp)`` for every id in ``links(a, b)``; ``comp`` is the smallest id of the component.

    Every round each id takes the smallest label around it and then its label's label, so that chains shorten fast. Labels
    are written each round; the driver sees one count.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(edges.select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    while True:
        around = (edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near")))
        taken = stored(labels.join(around, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "labels")
        hop = taken.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        after = stored(taken.join(hop, "comp").select("id", "old", F.col("next").alias("comp")), "labels")
        labels = after.select("id", "comp")
        if not after.where("comp <> old").count():
            return labels
