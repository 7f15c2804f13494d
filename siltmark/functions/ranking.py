"""Exact n-th element and ranking without sending a whole table through one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import small


def hash_cutoffs(df: DataFrame, keys: Sequence[str], hashed: str, n: Column) -> DataFrame:
    """Per key the n-th smallest hash, so that ``hash <= cutoff`` picks exactly n distinct hashes.

    ``n`` may use the column ``total``. A four-digit prefix histogram (at most
    65,536 cells per key, partially aggregated before the shuffle) finds the
    prefix that holds the n-th hash; only that prefix, about 1/65,536 of the
    rows, is then ranked. Result: (keys, total, n, cutoff), one row per key.
    """
    keys = list(keys)
    prefixed = df.select(*keys, F.col(hashed).alias("_h"), F.left(F.col(hashed), F.lit(4)).alias("_p"))
    cells = prefixed.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    ranked = (
        cells.withColumn("total", F.sum("_c").over(w))
        .withColumn("_below", F.sum("_c").over(w.orderBy("_p")) - F.col("_c"))
        .withColumn("n", n.cast("bigint"))
    )
    wanted = F.least(F.col("n"), F.col("total"))
    hit = ranked.where((F.col("_below") < wanted) & (wanted <= F.col("_below") + F.col("_c")))
    hit = hit.select(*keys, "_p", "total", "n", (wanted - F.col("_below")).alias("_need"))
    # one row per key: broadcast where the keys are repeats, of which there are at most a hundred
    inside = prefixed.join(F.broadcast(hit) if keys == ["rep"] else small(hit), [*keys, "_p"])
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    return (
        inside.withColumn("_pos", pos)
        .where(F.col("_pos") == F.col("_need"))
        .select(*keys, "total", "n", F.col("_h").alias("cutoff"))
    )


def repeat_cutoffs(
    df: DataFrame, hashed: str, n: Callable[[int], int], key: str = "rep", step: int = 3, enough: int = 1000
) -> dict[int, str]:
    """Per repeat the n(total)-th smallest hash, as ``repeat_ties`` finds it."""
    return {k: cutoff for k, (cutoff, _, _) in repeat_ties(df, hashed, n, key, step, enough).items()}


def repeat_ties(
    df: DataFrame, hashed: str, n: Callable[[int], int], key: str = "rep", step: int = 3, enough: int = 1000
) -> dict[int, tuple[str, int, int]]:
    """Per repeat (the n(total)-th smallest hash, how many rows of it are among the n, how many there are).

    A repeat of which no row is wanted is left out. The prefix that holds the wanted hash
    is made longer, three digits a pass, until at most ``enough`` different hashes share
    it. What reaches the driver is bounded whatever the table and however often a hash
    occurs: 4,096 counts per repeat and pass, then ``enough`` hashes with their counts per
    repeat. Hashes are uniform, so one pass settles millions of rows and two settle billions.
    Hashes are made twice, for the first pass and for what shares its prefix, which is kept.
    """
    # a NULL key has no hash and so no place in the order
    rows = df.select(F.col(key).alias("_k"), F.col(hashed).alias("_h")).where("_h is not null")
    prefix: dict[int, str] = {}
    need: dict[int, int] = {}

    kept: list[DataFrame] = []

    def near(length: int) -> DataFrame:
        if not kept:
            kept.append(rows.where(_starts(prefix, length)).groupBy("_k", "_h").agg(F.count(F.lit(1)).alias("_c")).persist())
        return kept[0].where(_starts(prefix, length))

    try:
        return _narrowed(rows, near, prefix, need, n, step, enough)
    finally:
        for df in kept:
            df.unpersist()


def _narrowed(rows, near, prefix: dict[int, str], need: dict[int, int], n: Callable[[int], int], step: int, enough: int) -> dict[int, tuple[str, int, int]]:
    """The passes of ``repeat_ties``; ``near(length)`` counts the hashes that share the prefix so far."""
    for length in range(step, 33, step):
        p = F.left("_h", F.lit(length)).alias("_p")
        if length == step:
            # equal hashes are not put together before the first pass, which would shuffle the table
            counts = rows.groupBy("_k", p).agg(F.count(F.lit(1)).alias("_c")).withColumn("_d", F.col("_c"))
        else:
            counts = near(length - step).groupBy("_k", p).agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"))
        cells: dict[int, list[tuple[str, int, int]]] = {}
        for r in counts.collect():
            cells.setdefault(r["_k"], []).append((r["_p"], r["_c"], r["_d"]))
        largest = 0
        for k, found in cells.items():
            if length == step:
                total = sum(c for _, c, _ in found)
                need[k] = min(n(total), total)
            left = need[k]
            for p, c, d in sorted(found):
                if left <= c:
                    break
                left -= c
            prefix[k], need[k], largest = p, left, max(largest, d)
        if largest <= enough:
            break
    for k in [k for k in prefix if need[k] <= 0]:
        del prefix[k]  # in place, for near() reads it
    if not prefix:
        return {}
    last: dict[int, list[tuple[str, int]]] = {}
    for r in near(length).collect():
        last.setdefault(r["_k"], []).append((r["_h"], r["_c"]))
    ties = {}
    for k, found in last.items():
        left = need[k]
        for h, c in sorted(found):
            if left <= c:
                break
            left -= c
        ties[k] = (h, left, c)
    return ties


def _starts(prefix: dict[int, str], length: int) -> Column:
    wanted = F.create_map(*[F.lit(v) for item in prefix.items() for v in item])
    return F.left("_h", F.lit(length)) == F.try_element_at(wanted, F.col("_k"))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position in a total order, for tables too large for one sorted partition.

    Rows are range-partitioned and written to the checkpoint folder, which
    freezes the partition each row is in; the rank is then the row's place in
    its partition plus the number of rows in the partitions before it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
    )
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parts.withColumn("_local", local)
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_part", "_local", "_before")
    )
