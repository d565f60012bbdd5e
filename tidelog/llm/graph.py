"""Connected components of an edge table by contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of edges (a, b) the smallest node that it is connected with.

    Each round every node moves to its smallest neighbour's smallest neighbour, and edges between nodes that met go.  The
    number of edges falls at least by half, so rounds grow with the logarithm of the table.  Minima are combined before
    they are shuffled, and only they are joined back, so a node of any degree is no hot group.
    """
    edges = common.materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = common.materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "near")
        over = near.select(F.col("node").alias("via"), F.col("root").alias("far"))
        step = common.materialise(near.join(over, F.col("root") == F.col("via")).select("node", F.col("far").alias("root")), "step")
        steps.append(step)
        a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        met = edges.join(a, "a").join(b, "b").filter("ra <> rb")
        rest = common.materialise(met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        common.drop(near, edges)
        edges = rest
    if not steps:
        none = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        none._tidelog_path = edges._tidelog_path
        return none
    out = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = out.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    found = common.materialise(out, "components")
    common.drop(edges, *steps)
    return found
