"""Connected components of a link table, as tables all the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import Workspace


def components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of links (a, b); the root is the least node that can be reached.

    Every round hangs each node under its least neighbour, follows two times two steps up, and draws the links
    between what is left. The least node of a component always stays a root, and links vanish as trees close, so
    rounds are few; each is written to the shared folder. Nothing but emptiness is asked by the driver.
    """
    both = links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = ws.keep(both.distinct(), f"{name}-edges-0")
    label, step = None, 0
    while True:
        up = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        up = ws.keep(up, f"{name}-hang-{step}")
        for _ in range(2):
            over = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            up = up.join(over, "root").select("node", F.col("higher").alias("root"))
        up = ws.keep(up, f"{name}-up-{step}")
        if label is None:
            label = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            label = ws.keep(label.join(over, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), f"{name}-label-{step}")
        a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = edges.join(a, "a").join(b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        step += 1
        edges = ws.keep(left, f"{name}-edges-{step}")
        if edges.isEmpty():
            return label
