"""Mutual information in nats on binned codes, for every repeat in one pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import added_up, by_side, frame


def _xlogx(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c * F.log(c.cast("double"))


def mi_label(binned: DataFrame, label: str = "label") -> DataFrame:
    """(rep, f, mi): information between the codes of each feature and the label.

    MI = (sum c ln c - sum r ln r - sum k ln k) / N + ln N over joint counts c and
    marginals r, k. Only the (feature, code, label) counts are shuffled, after
    partial aggregation; everything later works on those cells.
    """
    cells = (
        binned.select("rep", F.col(label).alias("_y"), F.posexplode("codes").alias("f", "b"))
        .groupBy("rep", "f", "b", "_y")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    joint = cells.groupBy("rep", "f").agg(F.sum(_xlogx("c")).alias("_j"), F.sum("c").alias("_n"))
    rows = cells.groupBy("rep", "f", "b").agg(F.sum("c").alias("c"))
    rows = rows.groupBy("rep", "f").agg(F.sum(_xlogx("c")).alias("_r"))
    cols = cells.groupBy("rep", "f", "_y").agg(F.sum("c").alias("c"))
    cols = cols.groupBy("rep", "f").agg(F.sum(_xlogx("c")).alias("_k"))
    mi = (F.col("_j") - F.col("_r") - F.col("_k")) / F.col("_n") + F.log(F.col("_n").cast("double"))
    return joint.join(rows, ["rep", "f"]).join(cols, ["rep", "f"]).select("rep", "f", F.greatest(mi, F.lit(0.0)).alias("mi"))


TABLE_BYTES = 1 << 28  # joint counts that a task holds at a time


def mi_pairs(binned: DataFrame, bins: int = 16, reps: Sequence[int] | None = None, cuts: dict[int, dict[int, np.ndarray]] | None = None) -> DataFrame:
    """(rep, fi, fj, mi) for fi < fj. The diagonal tables give the marginals of each feature.

    A task counts its rows into dense joint tables and sends the table of a pair once, packed, so a row is never multiplied
    by the number of pairs and no row carries a single count. Features whose tables do not fit in ``TABLE_BYTES`` are
    counted in blocks, a scan each. With ``reps`` the rows are those of ``splits.group_masks``, each there once, and
    ``cuts`` holds each repeat's cuts per feature; without, they are (rep, codes).
    """
    source = "codes" if reps is None else "features"
    rows = binned.select("rep", "codes") if reps is None else binned.select("train", "features")
    width = rows.select(F.size(source).alias("d")).first()
    d = width["d"] if width else 0
    shared = rows.sparkSession.sparkContext.broadcast(cuts)
    repeats = len(reps) if reps is not None else max(binned.select("rep").distinct().count(), 1)
    per = max(1, TABLE_BYTES // (8 * bins * bins * max(d, 1) * repeats))
    sums = None
    for low in range(0, max(d, 1), per):
        high = min(low + per, d)

        def count(state: dict, batch: pa.RecordBatch, low: int = low, high: int = high) -> None:
            for rep, x in by_side(batch, reps, source):
                if reps is not None:
                    own = shared.value[rep]
                    x = np.stack([np.searchsorted(own[f], x[:, f], side="right") for f in range(d)], 1) if len(x) else x
                codes = x.astype(np.int64)
                for fi in range(low, high):
                    offset = np.arange(d - fi) * bins * bins
                    key = offset + codes[:, fi : fi + 1] * bins + codes[:, fi:]
                    hits = np.bincount(key.ravel(), minlength=(d - fi) * bins * bins)
                    state[rep, fi] = state[rep, fi] + hits if (rep, fi) in state else hits

        def spread(state: dict) -> dict:
            return {(rep, fi * d + fi + i): pair for (rep, fi), hits in state.items() for i, pair in enumerate(hits.reshape(d - fi, -1))}

        def finish(rep: int, part: int, total: np.ndarray) -> pa.RecordBatch:
            c = total[total > 0].astype(float)
            fi, fj = divmod(part, d)
            return frame(rep=np.int32(rep), fi=np.int32(fi), fj=np.int32(fj), s=np.array([(c * np.log(c)).sum()]), n=np.array([int(total.sum())]))

        block = added_up(rows, count, "<i8", finish, "rep int, fi int, fj int, s double, n bigint", spread)
        sums = block if sums is None else sums.unionByName(block)
    own = sums.where("fi = fj").select("rep", F.col("fi").alias("f"), F.col("s").alias("own"))
    left = own.select("rep", F.col("f").alias("fi"), F.col("own").alias("own_i"))
    right = own.select("rep", F.col("f").alias("fj"), F.col("own").alias("own_j"))
    mi = (F.col("s") - F.col("own_i") - F.col("own_j")) / F.col("n") + F.log(F.col("n").cast("double"))
    joined = sums.where("fi < fj").join(left, ["rep", "fi"]).join(right, ["rep", "fj"])
    return joined.select("rep", "fi", "fj", F.greatest(mi, F.lit(0.0)).alias("mi"))


def live_features(binned: DataFrame) -> DataFrame:
    """(rep, f) of features whose codes take more than one value."""
    codes = binned.select("rep", F.posexplode("codes").alias("f", "b"))
    return codes.groupBy("rep", "f").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi").select("rep", "f")
