"""Connected components over a table of links, wholly in Spark.

Labels fall to the smallest id within reach by rounds of hooking and
short-cutting: in each round a node, and the node that its label names, take the
smallest label-of-label among the node's neighbours.  Rounds grow with the
logarithm of the longest chain.  Each round's labels are a table in the shared
folder, so that lost executors cost one round at most and plans stay short.
Nothing is gathered on the driver but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockweave.llm.common import table


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``links``: columns a, b (long).  Returns node, component for every node that has a link."""
    both = table(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), "links")
    # the label of a node: the smallest of itself and its neighbours; far: the label's label
    label = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("f")), "labels")
    for _ in range(most_rounds):
        up = label.select(F.col("node").alias("f"), F.col("f").alias("g"))
        far = table(label.join(up, "f"), "far")  # node, f, g = f of f
        seen = both.join(far.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("m"))
        met = far.join(seen, "node")
        news = met.select("node", F.least("m", "g").alias("f")).union(met.select(F.col("f").alias("node"), F.least("m", "g").alias("f")))
        after = table(news.groupBy("node").agg(F.min("f").alias("f")), "labels")
        changed = after.join(label.select("node", F.col("f").alias("old")), "node").where("f <> old").limit(1).count()
        if not changed:
            return after.select("node", F.col("f").alias("component"))
        label = after
    raise RuntimeError(f"components: {most_rounds} rounds were not enough")
