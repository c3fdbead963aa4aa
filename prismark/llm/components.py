"""Connected components of links, by contraction in rounds.

Every round each vertex points to the vertex of lowest priority among itself and its neighbours; priorities are hashes
drawn anew each round, so long chains shrink by a constant factor on average, as stars do. Pointers are followed twice
(to the fourth), links are mapped to where their ends point, and links inside one vertex go. Each round is written to the
shared folder, so lineage stays short. All steps are joins and sums over a vertex's links with partial sums before the
shuffle; nothing about a component is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import remove, written


def components(edges: DataFrame, path: str) -> DataFrame:
    """``id, component_id`` for every id in the links ``a, b`` (long); component_id is the smallest id of its component.

    Links with a null end are left out, loops count for their vertex only, repeated links count once.
    """
    spark = edges.sparkSession
    edges = written(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{path}/links-0")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    labels = written(ids.select("id", F.col("id").alias("at")), f"{path}/labels-0")
    edges, n = edges.where("a <> b"), 0
    while not edges.isEmpty():
        n += 1
        both = edges.union(edges.select("b", "a")).toDF("id", "to")
        order = lambda c, n=n: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("v"))
        points = written(both.groupBy("id").agg(F.min(order("to")).alias("low")).select("id", F.least("low", order("id"))["v"].alias("to")), f"{path}/points-{n}")
        for k in range(2):
            ahead = points.toDF("to", "then")
            points = written(points.join(ahead, "to").select("id", F.col("then").alias("to")), f"{path}/points-{n}-{k}")
        to = lambda c: points.toDF(c, f"{c}_to")
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        edges = written(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), f"{path}/links-{n}")
        labels = written(labels.join(points.toDF("at", "to"), "at", "left").select("id", F.coalesce("to", "at").alias("at")), f"{path}/labels-{n}")
        for name in [f"points-{n}", f"points-{n}-0", f"points-{n}-1", f"labels-{n - 1}", *([f"links-{n - 1}"] if n > 1 else [])]:
            remove(spark, f"{path}/{name}")
    lowest = labels.groupBy("at").agg(F.min("id").alias("component_id"))
    return labels.join(lowest, "at").select("id", "component_id")
