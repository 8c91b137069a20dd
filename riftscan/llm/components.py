"""Connected components of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a long, b long): the smallest node that can be reached.

    Each round every node takes the smallest of itself and its neighbours, then that one's choice, and links are
    drawn anew between the choices. A node with very many links costs one combined minimum and one row to join
    with. Rounds grow with the logarithm of the longest path. A link with a null end, or to itself, joins nothing.
    """
    edges = stored(_between(links.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to"))
        near = stored(near)
        far = near.select(F.col("node").alias("to"), F.col("to").alias("top"))
        choice = stored(near.join(far, "to").select("node", F.col("top").alias("to")))
        if labels is None:
            labels = choice.withColumnRenamed("to", "component")
        else:
            moved = choice.withColumnsRenamed({"node": "component", "to": "_to"})
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        labels = stored(labels)
        a, b = (choice.withColumnsRenamed({"node": x, "to": f"{x}_to"}) for x in ("a", "b"))
        edges = stored(_between(edges.join(a, "a").join(b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if labels is None else labels


def _between(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
