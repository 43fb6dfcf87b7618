"""Table helpers shared by the training-data operators.

Every operator first narrows its input to the columns it reads and renames
them, or carries the caller's row as one struct (`whole_rows`), so extra or
clashing columns never reach a join.  `doc_id` is the key and meant to be unique
per row; a null `doc_id` is a key like any other.  What rows with equal keys get
is said at each operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import cut_lineage


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string); a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): the caller's row as a struct beside its key and its text (null stays null)."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def same_columns(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of `docs` out of `row`, those named in `new` (in any case) replaced; further names are added."""
    own = {c.lower() for c in docs.columns}
    old = [new.get(c.lower(), F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*old, *(v.alias(c) for c, v in new.items() if c not in own))


def connected_components(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable over `edges` (a, b), for ids with an edge.

    Alternating large-star / small-star rounds (Kiveris et al. 2014): every
    round is two aggregations over the edge table, no row leaves the cluster,
    and the round's edges are written as a table, so a lost executor replays
    one round.  Rounds grow with the logarithm of the longest path.  A node of
    very high degree only ever appears as the aggregated minimum of its
    neighbours and as the right side of a join that AQE may split.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u <> v").distinct())

    def star(both: DataFrame, large: bool) -> DataFrame:
        # both: (x, y) neighbours; m(x) = least of x and its neighbours
        least = both.groupBy("x").agg(F.min("y").alias("m0")).select(
            F.col("x").alias("k"), F.least("x", "m0").alias("m"))
        j = both.join(least, both.x == least.k)
        if large:
            out = j.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(
                least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    def signature(t: DataFrame):
        return t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = None
    while True:
        sym = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        big = cut_lineage(star(sym, True))
        down = big.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
        e = cut_lineage(star(down, False))
        now = signature(e)
        if now == before or now[0] == 0:
            break
        before = now
    comp = e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return comp.unionByName(comp.select(F.col("comp").alias("id"), "comp").distinct())


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], rows: str, heavy: int = 100_000) -> DataFrame:
    """`big` left-joined with `small` on `keys` (nulls are equal), whatever share of `big` a key holds.

    `small` has one row per key, with the key's number of rows of `big` in
    column `rows` (not returned).  Keys with at least 1 / heavy of all rows, at
    most `heavy` in number, are broadcast; the others are shuffled, and none of
    them holds more than that share.  `big` must be a table (read twice).
    """
    side = cut_lineage(small)
    total = side.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    side = side.select(*(F.col(k).alias(f"_join_{k}") for k in keys), F.struct(
        *(c for c in side.columns if c not in (*keys, rows))).alias("_join_value"), F.col(rows).alias("_join_rows"))
    same = [F.col(k).eqNullSafe(F.col(f"_join_{k}")) for k in keys]
    often = F.col("_join_rows") * heavy >= F.lit(total)

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.drop("_join_rows"), same, "left").drop(*(f"_join_{k}" for k in keys))

    first = joined(big, F.broadcast(side.filter(often)))
    rest = first.filter(F.col("_join_value").isNull()).drop("_join_value")
    out = first.filter(F.col("_join_value").isNotNull()).unionByName(joined(rest, side.filter(~often)))
    return out.select(*big.columns, "_join_value.*")
