"""Gapless ranks over tables of any size: range partitions, ranked inside, plus each partition's offset.

No window without partitioning (or over one huge partition) is involved, so no
task ever holds more than a range of the rows; the driver sees one count per
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.session import cut_lineage

_PART = 33   # monotonically_increasing_id: partition number above 33 bits of position


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """`df` with a 0-based rank in the order of `order` (make it unique for a defined result)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id())
    t = cut_lineage(ranged)      # written once: range bounds are sampled and would move on re-evaluation
    part = F.shiftright("_at", _PART)
    counts = {r[0]: r[1] for r in t.groupBy(part.alias("p")).count().collect()}   # one row per partition
    before, rows = 0, []
    for p in sorted(counts):
        rows.append((p, before))
        before += counts[p]
    offsets = df.sparkSession.createDataFrame(rows, "_p long, _before long")
    return (t.join(F.broadcast(offsets), part == F.col("_p"))
            .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PART) - 1)))
            .drop("_at", "_p", "_before"))


def rank_within(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """`df` with a 0-based rank inside each group of `keys`: the global rank less the group's first."""
    ranked = cut_lineage(global_rank(df, [*keys, *order], "_rank"))
    if not keys:
        return ranked.withColumnRenamed("_rank", name)
    first = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return ranked.alias("a").join(first.alias("b"), same).select(
        *(F.col(f"a.{c}") for c in df.columns), (F.col("a._rank") - F.col("b._first")).alias(name))
