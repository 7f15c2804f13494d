"""Severity index per zone with uncertainty bounds, and the figures derived from it.

Rows are reduced to zone x class counts at once; a zone that holds a third of all
rows costs one partial count per task. Everything later sees one row per zone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BANDS, CLEAN_CLASSES, HAZARD_WEIGHTS
from ..functions import columns as fx

TOP = 500  # the worst (zone, class) cell is mapped to this index


def zone_cells(items: DataFrame) -> DataFrame:
    """(zone, class, n, agreement_sum, agreement_n) from (zone, class[, agreement]) rows."""
    has = "agreement" in items.columns
    agreement = F.col("agreement") if has else F.lit(None).cast("double")
    return items.groupBy("zone", "class").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(agreement).alias("agreement_sum"),
        F.count(agreement).alias("agreement_n"),
    )


def unsupported_classes(items: DataFrame, weights: Mapping[str, float] = HAZARD_WEIGHTS) -> DataFrame:
    known = F.coalesce(F.col("class").isin(*weights), F.lit(False))
    return items.where(~known).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def _per_zone(cells: DataFrame, weights: Mapping[str, float], clean: Sequence[str]) -> DataFrame:
    known = F.coalesce(F.col("class").isin(*weights), F.lit(False))
    refuse = F.raise_error(F.concat(F.lit("unsupported class: "), F.coalesce("class", F.lit("NULL"))))
    counted = cells.withColumn("n", F.when(known, F.col("n")).otherwise(refuse.cast("bigint")))
    per_class = [F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(c) for c in weights]
    out = counted.groupBy("zone").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("class").isin(*clean), F.col("n")).otherwise(0)).alias("clean"),
        F.sum("agreement_sum").alias("_agreement_sum"),
        F.sum("agreement_n").alias("_agreement_n"),
        *per_class,
    )
    return out.withColumn("_worst", _largest([F.col(c) * F.lit(float(w)) for c, w in weights.items()]))


def _largest(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def zone_table_from_cells(
    cells: DataFrame,
    weights: Mapping[str, float] = HAZARD_WEIGHTS,
    clean: Sequence[str] = CLEAN_CLASSES,
    bands: Sequence[tuple[int, str]] = BANDS,
) -> DataFrame:
    zones = _per_zone(cells, weights, clean)
    # largest weighted cell of all zones: a scalar subquery, so no window over the whole table. It names
    # the same columns as the table itself, so that both read one shuffle of the cells
    same = F.struct("_worst", "_agreement_sum", "_agreement_n")
    peak = zones.agg(F.max(same).getField("_worst").alias("peak")).scalar()
    scale = F.when(peak > 0, peak).otherwise(1.0)
    z = fx.bonferroni_z(len(weights))

    def bound(side: int) -> Column:
        return _largest(
            [F.col("total") * fx.wilson(c, "total", z)[side] * F.lit(float(w)) / F.col("_scale") * TOP for c, w in weights.items()]
        )

    dirty_low, dirty_high = fx.wilson("dirty", "total")
    return (
        zones.withColumn("_scale", scale)
        .withColumn("dirty", F.col("total") - F.col("clean"))
        .withColumn("psi", fx.clamp(F.bround(F.col("_worst") / F.col("_scale") * float(TOP)), 0, TOP).cast("bigint"))
        .withColumn("psi_lo", fx.clamp(F.floor(bound(0)), 0, TOP).cast("bigint"))
        .withColumn("psi_hi", fx.clamp(F.ceil(bound(1)), 0, TOP).cast("bigint"))
        .select(
            "zone",
            "total",
            "clean",
            "dirty",
            F.bround(F.col("clean") / F.col("total") * 100, 1).alias("cleanliness"),
            "psi",
            fx.band_of("psi", bands).alias("band"),
            fx.interval_text("psi_lo", "psi_hi").alias("psi_ci"),
            "psi_lo",
            "psi_hi",
            F.round(dirty_low, 3).alias("dirty_rate_lo"),
            F.round(dirty_high, 3).alias("dirty_rate_hi"),
            F.round(F.col("_agreement_sum") / F.nullif(F.col("_agreement_n"), F.lit(0)), 3).alias("vote_agreement"),
            *weights,
        )
    )


def zone_table(
    items: DataFrame,
    weights: Mapping[str, float] = HAZARD_WEIGHTS,
    clean: Sequence[str] = CLEAN_CLASSES,
    bands: Sequence[tuple[int, str]] = BANDS,
) -> DataFrame:
    """Severity table of (zone, class[, agreement]) rows; a class without a weight fails the job."""
    return zone_table_from_cells(zone_cells(items), weights, clean, bands)


def zone_counts(items: DataFrame, classes: Sequence[str]) -> DataFrame:
    return items.groupBy("zone").pivot("class", list(classes)).count().na.fill(0)


def composition(zones: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(zone, class, n, pct): share of every class in its zone, 0 for an empty zone."""
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in classes])
    rows = zones.select("zone", "total", F.inline(pairs))
    pct = F.when(F.col("total") > 0, F.round(F.col("n") / F.col("total") * 100, 1)).otherwise(0.0)
    return rows.select("zone", "class", "n", pct.alias("pct"))


def kpis(zones: DataFrame) -> DataFrame:
    """One row for the city: cleanliness, worst zone (smallest name on a tie), items, zones."""
    worst = F.min_by(F.struct("zone", "psi", "band"), F.struct((-F.col("psi")).alias("p"), "zone"))
    total = F.coalesce(F.sum("total"), F.lit(0))
    return zones.agg(
        F.when(total > 0, F.bround(F.sum("clean") / F.sum("total") * 100, 1)).alias("cleanliness"),
        F.when(total > 0, worst).alias("_w"),
        total.alias("total_items"),
        F.count(F.lit(1)).alias("zone_count"),
    ).select(
        "cleanliness",
        F.col("_w.zone").alias("worst_zone"),
        F.col("_w.psi").alias("worst_psi"),
        F.col("_w.band").alias("worst_band"),
        "total_items",
        "zone_count",
    )


def weighted_agreement(zones: DataFrame) -> DataFrame:
    """Agreement over the zones that have one, weighted by their items."""
    rows = zones.where(F.col("vote_agreement").isNotNull())
    return rows.agg((F.sum(F.col("vote_agreement") * F.col("total")) / F.sum("total")).alias("agreement"))
