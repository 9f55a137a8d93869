"""Dense numbers in a global order, in two passes over range partitions and without one task for all rows."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tidewright.operators.storage import cut_lineage

#: Fixed value: ``monotonically_increasing_id`` gives a row's partition above this many bits and its place there below.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column | str], name: str, within: list[str] | None = None, start: int = 0) -> DataFrame:
    """``rows`` with dense numbers ``name`` from ``start`` in the order given; with ``within``, each group has numbers of its own.

    Rows are dealt out by ranges of (``within``, ``order``), sorted there and written with their place. The second pass adds up how
    many rows each partition holds of each group, and a row's number is what lies before its partition plus its place: only these
    counts, one for each partition and group in it, are summed in order. A group may be as large as the whole table.
    """
    keys = [F.col(c) for c in within or []]
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut_lineage(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part, groups = F.shiftright("__at", PLACE_BITS), within or []
    counts = placed.groupBy(*groups, part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    offsets = offsets.withColumnsRenamed({c: f"__of_{c}" for c in groups})
    same = part == F.col("__part")
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    # One row for each partition of the pass before (and for each further group in one): as few as the tasks, not the rows.
    side = F.broadcast(offsets) if not groups else offsets
    number = F.col("__before") + F.col("__at") - F.col("__low") + start
    return placed.join(side, same).select(*rows.columns, number.alias(name))
