"""Connected components of an edge table by label propagation with shortcuts.

Each round sends every node the smallest label of its neighbours and then jumps
to that label's own label, so long chains shrink by halves.  All steps are joins
and partial aggregations; a star around one node is one aggregated row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node."""
    both = scratch.keep(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges"
    )
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "m").alias("m"))
        # hook: a component's root takes the smallest label any of its members has seen
        root = lower.groupBy("component").agg(F.min("m").alias("low"))
        hooked = lower.join(root, "component").select("node", "component", F.least("m", "low").alias("m"))
        up = hooked.select(F.col("node").alias("r"), F.col("m").alias("rm"))
        jumped = hooked.join(up, F.col("m") == F.col("r"), "left").select(
            "node", F.least("m", F.coalesce("rm", "m")).alias("component"), (F.least("m", F.coalesce("rm", "m")) < F.col("component")).alias("moved")
        )
        new = scratch.keep(jumped, f"{name}-{step}")
        moved = new.where("moved").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "component")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels
