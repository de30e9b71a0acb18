"""Connected components of a link table, by minimum labels and pointer jumping.

Only DataFrame joins and partial aggregates over the nodes that have links.
Each round's labels are a written table, which the next round's replace; a
round hands each label on to the neighbours and to what pointed at them, so
chains shorten as they are walked.

Defined results: links of a node to itself and repeated links are allowed;
links with a null end are none; an empty table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellgrid.llm.common import cut, forget


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that can be reached, for each node of a link."""
    one = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("near"))
        hooked = cut(labels.join(near, labels["node"] == near["n"], "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = hooked.select(F.col("node").alias("j"), F.col("root").alias("up"))
        new = cut(hooked.join(jump, hooked["root"] == jump["j"], "left").select("node", "old", F.least("root", "up").alias("root")))
        ended = new.where("root <> old").isEmpty()
        forget(hooked, labels)
        labels = new
        if ended:
            forget(both)
            return labels.select("node", "root")
