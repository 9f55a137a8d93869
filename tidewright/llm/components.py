"""Connected components of a table of links, by star contraction in joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tidewright.llm.common import map_arrow, materialize


def _root(parent: dict[int, int], x: int) -> int:
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = x = parent[p]
    return x


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (``a``, ``b``) of one task to at most one link for each node, with the same components."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = _root(parent, a), _root(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = np.fromiter(parent, dtype=np.int64, count=len(parent))
    roots = np.fromiter((_root(parent, x) for x in nodes.tolist()), dtype=np.int64, count=len(nodes))
    keep = nodes != roots
    yield pa.record_batch([pa.array(roots[keep]), pa.array(nodes[keep])], names=["a", "b"])


#: A forest of up to so many links (16 bytes each, counted first) is joined in one task; beyond, by rounds of joins.
FEW_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``: bigint): the root is the smallest node reachable.

    Each task first reduces its links to a forest. If few links are left, a task joins them. Else large-star and small-star steps alternate until no link changes:
    every node's neighbours move to the smallest of them, so the number of rounds grows with the logarithm of the
    nodes. Neighbourhoods are never collected; minima are aggregated and joined back. Lineage is cut at every round by a
    table in the shared folder. Links of a node to itself and repeated links do no harm.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    edges = materialize(map_arrow(edges, local_forest, "a bigint, b bigint"), "links")
    few = edges.count() <= FEW_LINKS
    if few:
        edges = materialize(map_arrow(edges.coalesce(1), local_forest, "a bigint, b bigint"), "links")
    state = None
    while not few:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: each node's smaller neighbours, and itself, link to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(low, "b")
            .select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = materialize(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # Now every node links to its root alone.
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
