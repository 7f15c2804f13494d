"""Train-only preparation: moments, PCA, min-max windows and quantile bins for all repeats at once.

Fitted parameters are small (repeats x features) tables. They are computed by
distributed aggregates and then applied to rows through a broadcast whose size is
checked against ``MAX_PARAMETERS``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import PACKED, added_up, by_mask, by_rep, by_side, frame, lists, packed, replace_column
from ..functions.joins import MAX_ROWS, small

MAX_PARAMETERS = 50_000_000  # doubles in one broadcast, 400 MB
EDGE_GAP = 1e-8  # quantile edges closer than this are one edge


def train_rows(split: DataFrame) -> DataFrame:
    return split.where(~F.col("is_test"))


def long_features(df: DataFrame, *keys: str, features: str = "features") -> DataFrame:
    """(keys..., f, x), one row per feature value."""
    return df.select(*keys, F.posexplode(features).alias("f", "x")).withColumn("x", F.col("x").cast("double"))


def per_rep_arrays(table: DataFrame, *values: str) -> DataFrame:
    """(rep, f, v...) gathered into one row per repeat with feature-ordered arrays."""
    packed = F.array_sort(F.collect_list(F.struct("f", *values)))
    grouped = table.groupBy("rep").agg(packed.alias("_p"))
    return grouped.select("rep", *[F.col("_p").getField(v).alias(v) for v in values])


# ---- standardise and min-max -------------------------------------------------


def moments_train(split: DataFrame, reps: Sequence[int] | None = None) -> DataFrame:
    """(rep, f, n, mean, std) from train rows only; std is the population one.

    With ``reps`` the rows are those of ``splits.group_masks``, each there once. A task sends three numbers per repeat and
    feature; values are shifted by the first row it sees of a feature, and the shifted sums of tasks are put together pairwise.
    """
    rows = train_rows(split).select("rep", "features") if reps is None else split.select("train", "features")

    def count(state: dict, batch: pa.RecordBatch) -> None:
        for rep, x in by_side(batch, reps):
            if len(x):
                x = x.astype(float)
                mean = x.mean(0)
                own = np.stack([np.full(x.shape[1], float(len(x))), mean, ((x - mean) ** 2).sum(0)])
                state[rep, 0] = together(state[rep, 0], own) if (rep, 0) in state else own

    def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, gap = a[0] + b[0], b[1] - a[1]
        return np.stack([n, a[1] + gap * b[0] / n, a[2] + b[2] + gap**2 * a[0] * b[0] / n])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            count(state, batch)
        yield from packed(state, 0, 1)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for rep, data in zip(batch.column("rep").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = np.frombuffer(data).reshape(3, -1)
                total[rep] = together(total[rep], own) if rep in total else own
        for rep, (n, mean, square) in total.items():
            yield frame(rep=np.int32(rep), f=np.arange(len(n), dtype=np.int32), n=n.astype(np.int64), mean=mean, std=np.sqrt(square / n))

    return rows.mapInArrow(partial, PACKED).repartition("rep").mapInArrow(last, "rep int, f int, n bigint, mean double, std double")


def standardise_train(split: DataFrame) -> DataFrame:
    """Rows with features centred and scaled by train moments; a constant column becomes 0."""
    # fetched once, a row per repeat: each plan that reads the rows would scan them again for the moments
    arrays = small(per_rep_arrays(moments_train(split), "mean", "std"))
    z = F.transform(
        "features",
        lambda x, i: (x.cast("double") - F.col("mean")[i]) / F.when(F.col("std")[i] > 0, F.col("std")[i]).otherwise(1.0),
    )
    return split.join(arrays, "rep").withColumn("features", z).drop("mean", "std")


def ranges_train(split: DataFrame) -> DataFrame:
    return (
        long_features(train_rows(split), "rep").groupBy("rep", "f").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    )


def minmax_fit_train(split: DataFrame, low: float = 0.05, high: float = 1.52) -> DataFrame:
    """Train range mapped onto [low, high]; held-out values may fall outside and are not clipped."""
    arrays = per_rep_arrays(ranges_train(split), "lo", "hi")

    def scaled(x, i):
        span = F.col("hi")[i] - F.col("lo")[i]
        return F.lit(low) + (x.cast("double") - F.col("lo")[i]) * (F.lit(high - low) / F.when(span > 0, span).otherwise(1.0))

    return split.join(F.broadcast(arrays), "rep").withColumn("features", F.transform("features", scaled)).drop("lo", "hi")


# ---- PCA ---------------------------------------------------------------------


def add_list(df: DataFrame, name: str, kind: str, task) -> DataFrame:
    """Rows with the array column ``name`` set by an Arrow batch function; all else passes through."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name]
    ordered = df.select(*[f.name for f in df.schema.fields if f.name != name], *([name] if name in df.columns else []))
    return ordered.mapInArrow(task, ", ".join([*fields, f"`{name}` {kind}"]))


@dataclass(frozen=True)
class PcaModel:
    """Fitted projections, one per repeat, small enough for the driver and a broadcast."""

    k: int
    transform_fit: str
    mean: dict[int, np.ndarray]
    std: dict[int, np.ndarray]
    components: dict[int, np.ndarray]
    explained_pct: dict[int, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Project rows (rep, features) to k components, partition by partition."""
        state = df.sparkSession.sparkContext.broadcast(
            {r: (self.mean[r], self.components[r] / self.std[r]) for r in self.mean}
        )

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.empty((batch.num_rows, self.k))
                for rep, at, x in by_rep(batch):
                    mean, weights = state.value[rep]
                    out[at] = (x - mean) @ weights.T
                yield replace_column(batch, "features", lists(out))

        return add_list(df, "features", "array<double>", project).withColumn("transform_fit", F.lit(self.transform_fit))


def gram_train(rows: DataFrame, centre: DataFrame, reps: Sequence[int] | None = None) -> DataFrame:
    """(rep, i, j, s) for i <= j: sums of products of values shifted by a common centre.

    Each task adds its rows up in one matrix per repeat and sends every row of it once, packed, so the
    shuffle carries features rows per task and repeat whatever the number of rows. The
    shift keeps the sums well conditioned; j = -1 carries the shifted sums, i = -1 the count.
    """
    d = centre.count()
    if d * d > MAX_PARAMETERS:
        raise ValueError(f"{d} features are too many for one Gram matrix per task")
    shift = np.array([r["c"] for r in centre.orderBy("f").collect()], dtype=float)
    shared = rows.sparkSession.sparkContext.broadcast(shift)

    def count(state: dict, batch: pa.RecordBatch) -> None:
        for rep, x in by_side(batch, reps):
            if not len(x):
                continue
            y = x - shared.value
            gram, sums = y.T @ y, np.append(y.sum(0), float(len(y)))
            if (rep, 0) not in state:
                for i in range(d):
                    state[rep, i] = np.zeros(d - i)
                state[rep, d] = np.zeros(d + 1)
            for i in range(d):
                state[rep, i] += gram[i, i:]
            state[rep, d] += sums

    def finish(rep: int, part: int, total: np.ndarray) -> pa.RecordBatch:
        if part < d:
            return frame(rep=np.int32(rep), i=np.int32(part), j=np.arange(part, d, dtype=np.int32), s=total)
        return frame(rep=np.int32(rep), i=np.append(np.arange(d), -1).astype(np.int32), j=np.int32(-1), s=total)

    given = rows.select("rep", "features") if reps is None else rows.select("train", "features")
    return added_up(given, count, "<f8", finish, "rep int, i int, j int, s double")


def _fit(rows: DataFrame, k: int, transform_fit: str, masks: Sequence[int] | None = None) -> PcaModel:
    centre = long_features(rows.select("features")).groupBy("f").agg(F.avg("x").alias("c"))
    centre = centre.cache()
    d = centre.count()
    if k > d:
        raise ValueError(f"{k} components asked of {d} features")
    shift = np.array([r["c"] for r in centre.orderBy("f").collect()], dtype=float)
    gram = gram_train(rows, centre, masks)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, s = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["s"].to_numpy()
        n = s[(i < 0)][0]
        offset = np.zeros(d)
        offset[i[(j < 0) & (i >= 0)]] = s[(j < 0) & (i >= 0)] / n
        cov = np.zeros((d, d))
        inner = j >= 0
        cov[i[inner], j[inner]] = s[inner] / n
        cov = cov + np.triu(cov, 1).T - np.outer(offset, offset)
        std = np.sqrt(np.clip(np.diag(cov), 0, None))
        std = np.where(std > 1e-12, std, 1.0)
        values, vectors = np.linalg.eigh(cov / np.outer(std, std))
        order = np.argsort(values)[::-1][:k]
        comp = vectors[:, order].T
        largest = np.abs(comp).argmax(axis=1)
        comp = comp * np.sign(comp[np.arange(k), largest])[:, None]
        share = 100.0 * values[order].sum() / values.sum()
        return pd.DataFrame(
            {
                "rep": [int(pdf["rep"].iloc[0])],
                "mean": [shift + offset],
                "std": [std],
                "comp": [comp.ravel()],
                "pct": [share],
            }
        )

    schema = "rep int, mean array<double>, std array<double>, comp array<double>, pct double"
    reps = masks or [r["rep"] for r in rows.select("rep").distinct().collect()]
    if len(reps) * d * (k + 2) > MAX_PARAMETERS:
        raise ValueError("projections of all repeats are too large for one broadcast; fit fewer repeats at a time")
    fitted = gram.groupBy("rep").applyInPandas(solve, schema).collect()
    centre.unpersist()
    return PcaModel(
        k,
        transform_fit,
        {r["rep"]: np.array(r["mean"]) for r in fitted},
        {r["rep"]: np.array(r["std"]) for r in fitted},
        {r["rep"]: np.array(r["comp"]).reshape(k, d) for r in fitted},
        {r["rep"]: float(r["pct"]) for r in fitted},
    )


def pca_train(split: DataFrame, k: int, reps: Sequence[int] | None = None) -> PcaModel:
    """Standardise + PCA fitted on the train rows of each repeat; signs fixed by the largest loading.

    With ``reps`` the rows are those of ``splits.group_masks``.
    """
    if reps is not None:
        return _fit(split.select("train", "features"), k, "train_only", list(reps))
    return _fit(train_rows(split).select("rep", "features"), k, "train_only")


def pca_global(df: DataFrame, k: int) -> PcaModel:
    """The same fit over every row. Kept for comparison only: selection refuses its output."""
    return _fit(df.select(F.lit(0).alias("rep"), "features"), k, "all_rows")


def refuse_transductive(df: DataFrame) -> DataFrame:
    """Fail on rows whose preparation has seen the held-out side."""
    if "transform_fit" not in df.columns:
        return df
    bad = F.col("transform_fit") == "all_rows"
    return df.where(F.when(bad, F.raise_error(F.lit("features were fitted on all rows")).cast("boolean")).otherwise(True))


# ---- quantile bins -----------------------------------------------------------


def _bounds(rows: DataFrame, probs: list[float], accuracy: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per feature, values that enclose each wanted quantile and which cells lie between such two; need not be accurate.

    ``m`` bounds make ``2 m + 1`` cells: an odd one is a bound's own value, an even one what lies between two bounds or beyond
    the outer ones. Repeats draw on the same rows, so one sketch serves all: that of every row there is, or of the first repeat.
    """
    slack = 2.0 / accuracy
    around = [[min(max(p + s, 0.0), 1.0) for s in (-slack, slack)] for p in probs]
    at = sorted({q for pair in around for q in pair})
    some = rows.select("rep").limit(1).collect() if "rep" in rows.columns else []
    one = rows.where(F.col("rep") == some[0]["rep"]) if some else rows
    sketch = F.percentile_approx("x", at, accuracy)
    found = {r["f"]: r["b"] for r in long_features(one.select("features")).groupBy("f").agg(sketch.alias("b")).collect()}
    bounds, near = [], []
    for f in range(len(found)):
        b = np.unique(found[f])
        inside = np.zeros(2 * len(b) + 1, bool)
        for pair in around:
            low, high = (int(np.searchsorted(b, found[f][at.index(q)])) for q in pair)
            inside[2 * low + 2 : 2 * high + 1 : 2] = True
        inside[[0, -1]] = True  # another repeat's extremes
        bounds.append(b)
        near.append(inside)
    return bounds, near


def _cells(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.searchsorted(b, x, side="left") + np.searchsorted(b, x, side="right")


PICKED = 1 << 20  # values that a task holds before it puts equal ones together


def _picked(batches: Iterator[pa.RecordBatch], bounds: list[np.ndarray], wanted, reps: Sequence[int] | None) -> Iterator[pa.RecordBatch]:
    """Rows per cell, once a task, and with ``inside`` the different values of the ``wanted(rep, f)`` cells and how often each occurs."""
    total: dict[tuple[int, int], np.ndarray] = {}
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    size = 0

    def values() -> Iterator[pa.RecordBatch]:
        for (rep, f), parts in held.items():
            x, c = np.unique(np.concatenate(parts), return_counts=True)
            yield frame(rep=np.int32(rep), f=np.int32(f), b=_cells(bounds[f], x).astype(np.int32), inside=np.bool_(True), x=x, c=c)

    for batch in batches:
        x, sides = by_mask(batch, reps)
        for f, b in enumerate(bounds if sides else []):
            column = x[:, f].astype(float, copy=False)
            at = _cells(b, column)
            for rep, train in sides:
                own = at[train]
                hits = np.bincount(own, minlength=2 * len(b) + 1)
                total[rep, f] = total[rep, f] + hits if (rep, f) in total else hits
                some = column[train][wanted(rep, f)[own]]
                if len(some):
                    held.setdefault((rep, f), []).append(some)
                    size += len(some)
        if size > PICKED:
            yield from values()
            held, size = {}, 0
    yield from values()
    for (rep, f), hits in total.items():
        at = np.flatnonzero(hits)
        if len(at):
            yield frame(rep=np.int32(rep), f=np.int32(f), b=at.astype(np.int32), inside=np.bool_(False), x=np.float64(0), c=hits[at])


def quantile_edges(train: DataFrame, bins: int, exact: bool = True, accuracy: int = 2000, reps: Sequence[int] | None = None) -> DataFrame:
    """(rep, f, edges): bins + 1 quantiles by linear interpolation, from (rep, features) rows, or from those of ``splits.group_masks``.

    Exact without sorting a feature in one task, in two scans. A sketch proposes narrow cells around the wanted positions; then
    rows per cell are counted and the values of the narrow cells shuffled and ranked, equal values collapsed first. A value
    that is a bound needs no ranking. Where a wanted position turns out to lie in another cell, one more scan fetches that
    cell's values: a poor sketch costs time, never correctness. What passes through the driver is features x (2 bins + 2)
    bounds, and twice as many counts and values per repeat.
    """
    probs = [i / bins for i in range(bins + 1)]
    keys = ["rep", "f", "b"]
    if not exact:
        q = F.percentile_approx("x", probs, accuracy)
        return long_features(train, "rep").groupBy("rep", "f").agg(q.alias("edges"))
    spark = train.sparkSession
    rows = train.select("rep" if reps is None else "train", "features")
    bounds, near = _bounds(rows, probs, accuracy)
    shared = spark.sparkContext.broadcast((bounds, near))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, near = shared.value
        yield from _picked(batches, bounds, lambda rep, f: near[f], reps)

    def summed(task) -> DataFrame:
        found = rows.mapInArrow(task, "rep int, f int, b int, inside boolean, x double, c bigint")
        return found.groupBy(*keys, "inside", "x").agg(F.sum("c").alias("c"))

    cells = summed(scan).persist()
    try:
        counts = cells.where("not inside").select(*keys, "c").toPandas()
        at: dict[tuple[int, int], dict[int, float]] = {}
        total: dict[tuple[int, int], int] = {}
        plan: dict[tuple[int, int, int], tuple[int, list[int]]] = {}
        for (rep, f), part in counts.sort_values("b").groupby(["rep", "f"]):
            b, c = part["b"].to_numpy(), part["c"].to_numpy()
            last, n = c.cumsum(), int(c.sum())
            key = int(rep), int(f)
            at[key], total[key] = {}, n
            for spot in sorted({int(g(p * (n - 1))) for p in probs for g in (np.floor, np.ceil)}):
                i = int(np.searchsorted(last, spot, side="right"))
                if b[i] % 2:
                    at[key][spot] = float(bounds[f][b[i] // 2])
                else:
                    plan.setdefault((*key, int(b[i])), (int(last[i] - c[i]), []))[1].append(spot)
        missed: dict[tuple[int, int], np.ndarray] = {}
        for rep, f, b in plan:
            if not near[f][b]:
                missed.setdefault((rep, f), np.zeros(len(near[f]), bool))[b] = True
        values = cells.where("inside")
        if missed:
            lost = spark.sparkContext.broadcast(missed)

            def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                bounds, near = shared.value
                yield from _picked(batches, bounds, lambda rep, f: lost.value.get((rep, f), np.zeros(len(near[f]), bool)), reps)

            values = values.unionByName(summed(fetch).where("inside"))
        if plan:
            places = pa.table(
                {k: pa.array([p[i] for p in plan], pa.int32()) for i, k in enumerate(keys)}
                | {"below": pa.array([v[0] for v in plan.values()], pa.int64()), "spots": pa.array([v[1] for v in plan.values()], pa.list_(pa.int64()))}
            )
            places = spark.createDataFrame(places)
            values = values.join(F.broadcast(places) if len(plan) <= MAX_ROWS else places, keys)
            values = values.withColumn("last", F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy("x")))
            hit = F.filter("spots", lambda s: (s < F.col("last")) & (s >= F.col("last") - F.col("c")))
            for r in values.select("rep", "f", "x", F.explode(hit).alias("spot")).collect():
                at[r["rep"], r["f"]][r["spot"]] = r["x"]
    finally:
        cells.unpersist()

    def edge(key: tuple[int, int], p: float) -> float:
        pos = p * (total[key] - 1)
        low, high = at[key][int(np.floor(pos))], at[key][int(np.ceil(pos))]
        return low + (high - low) * (pos - np.floor(pos))

    found = sorted(at)
    return spark.createDataFrame(
        pa.table(
            {k: pa.array([key[i] for key in found], pa.int32()) for i, k in enumerate(("rep", "f"))}
            | {"edges": pa.array([[edge(key, p) for p in probs] for key in found], pa.list_(pa.float64()))}
        )
    )


def inner_cuts(edges: DataFrame) -> DataFrame:
    """(rep, f, cuts): edges without the outer two, after dropping edges too close to the one before."""
    kept = F.filter("edges", lambda e, i: (i == 0) | (e - F.col("edges")[i - 1] > EDGE_GAP))
    cuts = F.when(F.size(kept) > 2, F.slice(kept, 2, F.size(kept) - 2)).otherwise(F.array().cast("array<double>"))
    return edges.select("rep", "f", cuts.alias("cuts"))


def train_cuts(train: DataFrame, bins: int, exact: bool = True, reps: Sequence[int] | None = None) -> dict[int, dict[int, np.ndarray]]:
    """Inner cuts by repeat and feature, small enough for the driver and a broadcast."""
    fitted = inner_cuts(quantile_edges(train, bins, exact, reps=reps)).collect()
    if len(fitted) * bins > MAX_PARAMETERS:
        raise ValueError("cuts of all repeats are too large for one broadcast; bin fewer repeats at a time")
    cuts: dict[int, dict[int, np.ndarray]] = {}
    for r in fitted:
        cuts.setdefault(r["rep"], {})[r["f"]] = np.array(r["cuts"], dtype=float)
    return cuts


def quantile_bins(split: DataFrame, bins: int = 16, exact: bool = True) -> DataFrame:
    """Rows with ``codes``: per feature the number of train-fitted inner cuts <= value."""
    split = refuse_transductive(split)
    cuts = train_cuts(train_rows(split), bins, exact)
    shared = split.sparkSession.sparkContext.broadcast(cuts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = None
            for rep, at, x in by_rep(batch):
                own = shared.value[rep]
                out = np.empty((batch.num_rows, x.shape[1]), dtype=np.int32) if out is None else out
                for f in range(x.shape[1]):
                    out[at, f] = np.searchsorted(own[f], x[:, f], side="right")
            if out is not None:
                yield replace_column(batch, "codes", lists(out))

    return add_list(split, "codes", "array<int>", code)


def code_counts(rows: DataFrame, cuts: dict[int, dict[int, np.ndarray]], reps: Sequence[int]) -> DataFrame:
    """(rep, is_test, f, code, n): rows of ``splits.group_masks`` per side and code, under each repeat's cuts per feature.

    The codes of ``quantile_bins`` without a copy of a row per repeat: a task codes its rows and sends each feature's counts once.
    """
    rows = refuse_transductive(rows).select("train", "features")
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    def count(state: dict, batch: pa.RecordBatch) -> None:
        x, sides = by_mask(batch, reps)
        for rep, train in sides:
            for f, own in shared.value.get(rep, {}).items():
                at = 2 * np.searchsorted(own, x[:, f], side="right") + ~train
                hits = np.bincount(at, minlength=2 * len(own) + 2)
                state[rep, f] = state[rep, f] + hits if (rep, f) in state else hits

    def finish(rep: int, f: int, total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return frame(rep=np.int32(rep), is_test=at % 2 == 1, f=np.int32(f), code=(at // 2).astype(np.int32), n=total[at])

    return added_up(rows, count, "<i8", finish, "rep int, is_test boolean, f int, code int, n bigint")
