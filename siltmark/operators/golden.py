"""Comparison of a run with frozen expectations: metrics, package versions, settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx

METRICS = ("accuracy", "macro_f1")


def summary_cells(summary: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Wide summary -> (arm, classifier, metric, mean, std)."""
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std")) for m in metrics]
    )
    return summary.select("arm", F.col("clf").alias("classifier"), F.inline(rows))


def compare_golden(
    produced: DataFrame, baseline: DataFrame, sigma: float = 1.5, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Every (arm, classifier) of either side x metric: OK, MISMATCH, MISSING or NO_BASELINE.

    ``ok`` is NULL where there is nothing to compare with.
    """
    keys = ["arm", "classifier", "metric"]
    names = F.array(*[F.lit(m) for m in metrics])
    pairs = produced.select("arm", "classifier").union(baseline.select("arm", "classifier")).distinct()
    grid = pairs.withColumn("metric", F.explode(names))
    base = baseline.select(*keys, F.col("mean").alias("baseline"), F.col("std").alias("_std"))
    made = produced.select(*keys, F.col("mean").alias("produced"))
    joined = grid.join(base, keys, "left").join(made, keys, "left")
    comparable = F.col("baseline").isNotNull() & F.col("produced").isNotNull()
    delta = F.col("produced") - F.col("baseline")
    band = fx.tolerance("_std", sigma)
    within = F.abs(delta) <= band
    status = (
        F.when(F.col("baseline").isNull(), "NO_BASELINE")
        .when(F.col("produced").isNull(), "MISSING")
        .when(within, "OK")
        .otherwise("MISMATCH")
    )
    ok = F.when(F.col("baseline").isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(within, F.lit(False)))
    return joined.select(
        *keys,
        "baseline",
        "produced",
        F.when(comparable, delta).alias("delta"),
        F.when(comparable, band).alias("tolerance"),
        status.alias("status"),
        ok.alias("ok"),
    )


def verdict(cells: DataFrame) -> DataFrame:
    """One row: counts, the first failing cell by (arm, classifier, metric), PASS only if something was compared."""
    failing = F.col("ok") == F.lit(False)
    key = F.struct("arm", "classifier", "metric")
    label = F.concat_ws("/", "arm", "classifier", "metric")
    out = cells.agg(
        F.count("ok").alias("comparable"),
        F.count_if(failing).alias("failed"),
        F.count_if(F.col("ok").isNull()).alias("skipped"),
        F.min_by(F.when(failing, label), F.when(failing, key)).alias("first_failure"),
        F.min_by(F.when(failing, F.col("delta")), F.when(failing, key)).alias("first_delta"),
    )
    good = (F.col("failed") == 0) & (F.col("comparable") > 0)
    return out.withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))


def version_drift(pins: DataFrame, installed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(package, expected, actual, kind): mismatch, not-installed (listed without version) or missing (not listed)."""
    keys = [*by, "package"]
    found = installed.select(*keys, F.col("version").alias("actual"), F.lit(True).alias("_listed"))
    joined = pins.select(*keys, F.col("version").alias("expected")).join(found, keys, "left")
    kind = (
        F.when(F.col("_listed").isNull(), "missing")
        .when(F.col("actual").isNull(), "not-installed")
        .when(F.col("actual") != F.col("expected"), "mismatch")
    )
    return joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).drop("_listed")


def config_drift(frozen: DataFrame, actual: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fields of two flattened settings (path, value) that differ, are absent or are unknown."""
    keys = [*by, "path"]
    left = frozen.select(*keys, F.col("value").alias("expected"))
    right = actual.select(*keys, F.col("value").alias("got"))
    kind = (
        F.when(F.col("expected").isNull(), "unknown")
        .when(F.col("got").isNull(), "absent")
        .when(F.col("expected") != F.col("got"), "differs")
    )
    return left.join(right, keys, "full_outer").withColumn("kind", kind).where(F.col("kind").isNotNull())


def pending(plan: DataFrame, ledger: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Planned cells with ``state``: reused when the ledger has them, else run (the first ``limit``) or remaining."""
    keys = list(keys)
    done = ledger.select(*keys).distinct().withColumn("_done", F.lit(True))
    joined = plan.join(done, keys, "left")
    if limit is None:
        return joined.withColumn("state", F.when(F.col("_done"), "reused").otherwise("run")).drop("_done")
    # only the few next cells are wanted: a top-k, not a ranking of the whole plan
    first = joined.where(F.col("_done").isNull()).orderBy(*keys).limit(limit).select(*keys, F.lit(True).alias("_now"))
    state = F.when(F.col("_done"), "reused").when(F.col("_now"), "run").otherwise("remaining")
    return joined.join(F.broadcast(first), keys, "left").withColumn("state", state).drop("_done", "_now")


def expand_grid(df: DataFrame, **lists: Sequence) -> DataFrame:
    """Every row with every combination of the listed values once, by nested explodes of literals."""
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in dict.fromkeys(values)])))
    return df


def param_grid(spark, **lists: Sequence) -> DataFrame:
    """The grid alone; an empty list makes an empty grid, which is refused."""
    if not lists or not all(len(v) for v in lists.values()):
        raise ValueError("a grid needs at least one value per parameter")
    return expand_grid(spark.range(1), **lists).drop("id")


#: tasks in which the rows of a key meet; up to 200 a task that sends rows holds none of them back
PARTS = 200


def append_new(rows: DataFrame, ledger: DataFrame, keys: Sequence[str], parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(new, conflicts): rows whose key the ledger lacks, and keys with different payloads in the ledger or in ``rows``.

    Of equal rows one is appended; of a key whose rows differ, none. NULL is a value like any other in a key.
    Both tables are dealt by key once and grouped, in ``parts`` tasks whatever the size that the planner expects.
    Neither is joined, so none is broadcast: of exploded or compressed rows it expects far too little.
    """
    keys = list(keys)
    payload = [c for c in rows.columns if c not in keys]
    digest = lambda of: F.unhex(F.sha2(F.to_json(of).cast("binary"), 256))
    # the marker makes the struct of a payload without columns one of a field
    mine = rows.select(*keys, F.struct(F.lit(True).alias("_there"), *payload).alias("_mine"))
    held = ledger.select(*keys, F.lit(None).cast(mine.schema["_mine"].dataType).alias("_mine"), digest(F.struct(*payload)).alias("_held"))
    both = mine.withColumn("_held", F.lit(None).cast("binary")).unionByName(held)
    ends = [f(c).alias(f"{c}_{n}") for c in ("_mine", "_held") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    per = both.repartition(parts, *keys).groupBy(*keys).agg(*ends)
    per = per.where(F.col("_mine_lo").isNotNull())
    apart = F.col("_mine_lo") != F.col("_mine_hi")
    known = F.col("_held_lo").isNotNull()
    own = digest(F.struct(*[F.col(f"_mine_lo.{c}") for c in payload]))
    other = known & ((F.col("_held_lo") != F.col("_held_hi")) | (F.col("_held_lo") != own))
    columns = [(F.col(c) if c in keys else F.col(f"_mine_lo.{c}")).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    return per.where(~apart & ~known).select(*columns), per.where(apart | F.coalesce(other, F.lit(False))).select(*keys)
