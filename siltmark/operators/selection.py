"""Selection arms. Each returns (rep, arm, f) rows with exactly k features per repeat.

The data-sized work is in the information tables; an arm then works on at most
features^2 numbers per repeat.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import seeded_hash
from . import features as feat
from . import information as info
from .convex import fit_lasso


class BudgetError(ValueError):
    """The feature budget cannot be met from the candidate pool."""


def check_budget(k: int, n: int) -> None:
    if k < 1:
        raise BudgetError(f"budget must be >= 1, got {k}")
    if k > n:
        raise BudgetError(f"budget {k} exceeds the pool of {n} features")


def _arm(df: DataFrame, arm: str) -> DataFrame:
    return df.select(F.col("rep").cast("int").alias("rep"), F.lit(arm).alias("arm"), F.col("f").cast("int").alias("f"))


def _grid(spark, reps: Sequence[int], n: int) -> DataFrame:
    reps_df = spark.createDataFrame([(int(r),) for r in reps], "rep int")
    return reps_df.select("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("f"))


def top_k(df: DataFrame, score: str, k: int, by: Sequence[str] = ("rep",), item: str = "f") -> DataFrame:
    """The k best rows per key by score; ties go to the lowest item."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(item))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def select_random(spark, reps: Sequence[int], n: int, k: int, seed: int = 42) -> DataFrame:
    check_budget(k, n)
    hashed = _grid(spark, reps, n).withColumn("h", seeded_hash(F.col("rep") + F.lit(seed), F.col("f")))
    first = F.row_number().over(Window.partitionBy("rep").orderBy("h"))
    return _arm(hashed.withColumn("rank", first).where(F.col("rank") <= k), "A_random")


def select_first(spark, reps: Sequence[int], n: int, k: int) -> DataFrame:
    """Components are ordered by variance, so the first k are the k widest."""
    check_budget(k, n)
    return _arm(_grid(spark, reps, n).where(F.col("f") < k), "B_pca")


def select_mi(mi: DataFrame, n: int, k: int) -> DataFrame:
    check_budget(k, n)
    # scores that agree to 12 digits are a tie
    return _arm(top_k(mi.withColumn("score", F.round("mi", 12)), "score", k), "C_mi")


def select_full(spark, reps: Sequence[int], n: int) -> DataFrame:
    return _arm(_grid(spark, reps, n), "Z_full")


# ---- greedy relevance minus redundancy ----------------------------------------


def _tables(mi: DataFrame, pairs: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(rep, fi, fj, mi, live): label information on the diagonal; features^2 / 2 rows per repeat."""
    diag = mi.select("rep", F.col("f").alias("fi"), F.col("f").alias("fj"), "mi")
    if live is None:
        diag = diag.withColumn("live", F.lit(True))
    else:
        alive = live.select("rep", F.col("f").alias("fi"), F.lit(True).alias("live"))
        diag = diag.join(alive, ["rep", "fi"], "left").fillna({"live": False})
    return diag.unionByName(pairs.select("rep", "fi", "fj", "mi", F.lit(True).alias("live")))


def _dense(pdf: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fi, fj = pdf["fi"].to_numpy(), pdf["fj"].to_numpy()
    full = np.zeros((n, n))
    full[fi, fj] = pdf["mi"].to_numpy()
    relevance = np.diag(full).copy()
    redundancy = np.triu(full, 1)
    alive = np.ones(n, dtype=bool)
    own = fi == fj
    alive[fi[own]] = pdf["live"].to_numpy()[own]
    return relevance, redundancy + redundancy.T, alive


def select_mrmr(mi: DataFrame, pairs: DataFrame, live: DataFrame, n: int, k: int) -> DataFrame:
    """Greedy relevance minus mean redundancy to the chosen; constant features are not candidates."""
    check_budget(k, n)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        relevance, redundancy, alive = _dense(pdf, n)
        pool = alive if alive.any() else np.ones(n, dtype=bool)
        if pool.sum() < k:
            raise BudgetError(f"only {pool.sum()} features vary, {k} wanted")
        total, chosen = np.zeros(n), []
        for step in range(k):
            score = relevance - total / max(step, 1)
            score[~pool] = -np.inf
            best = int(score.argmax())
            chosen.append(best)
            pool[best] = False
            total += redundancy[best]
        return pd.DataFrame({"rep": pdf["rep"].iloc[0], "f": sorted(chosen)})

    out = _tables(mi, pairs, live).groupBy("rep").applyInPandas(pick, "rep int, f int")
    return _arm(out, "F_mrmr")


# ---- quadratic objective --------------------------------------------------------


def anneal(linear: np.ndarray, pair: tuple[np.ndarray, np.ndarray], streams: Sequence[np.random.Generator], sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(0/1 vectors, energies) after one annealing of linear_r.x + sum_{i<j} pair_rij x_i x_j for every row r.

    ``pair`` is a factor per row and one symmetric matrix. Rows advance together, each
    with a random stream of its own; a row's temperature falls geometrically from where its largest change is
    accepted half the time to where its smallest is accepted once in a hundred.
    """
    factor, matrix = pair
    rows, n = linear.shape
    reach = np.abs(linear).max(1) + factor * np.abs(matrix).sum(1).max()
    off = np.abs(matrix[np.triu_indices(n, 1)])
    least = np.full(rows, np.inf)
    for sizes in (np.abs(linear), factor[:, None] * off[None, :]):
        least = np.minimum(least, np.where(sizes > 0, sizes, np.inf).min(1, initial=np.inf))
    hot = np.log(2) / np.maximum(reach, 1e-12)
    cold = np.maximum(hot, np.log(100) / np.maximum(np.minimum(least, reach), np.maximum(1e-3 * reach, 1e-12)))
    x = np.array([g.integers(0, 2, n) for g in streams], float)
    pull = factor[:, None] * (x @ matrix) + linear
    for sweep in range(sweeps):
        beta = hot * (cold / hot) ** (sweep / max(sweeps - 1, 1))
        draw = np.array([g.random(n) for g in streams])
        for i in range(n):
            gain = (1.0 - 2.0 * x[:, i]) * pull[:, i]
            change = np.where(draw[:, i] < np.exp(np.minimum(0.0, -beta * gain)), 1.0 - 2.0 * x[:, i], 0.0)
            x[:, i] += change
            pull += (factor * change)[:, None] * matrix[i]
    energy = (x * linear).sum(1) + 0.5 * factor * np.einsum("ri,ij,rj->r", x, matrix, x)
    return x.astype(np.int8), energy


@dataclass(frozen=True)
class QuboResult:
    selection: DataFrame  # rep, arm, f
    trace: DataFrame  # rep, step, alpha, n_selected, nudged


READ = "rep int, place int, read int, alpha double"


def lowest(tables: dict[int, tuple[np.ndarray, np.ndarray]], plan: DataFrame, sweeps: int, seed: int) -> DataFrame:
    """(rep, place, alpha, energy, chosen) with the least energy over the reads of every planned (rep, place, alpha).

    ``plan`` has a row per read (READ): reads are spread over the cluster by place, and those of one repeat that meet in a
    task are annealed together.
    """
    shared = plan.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, place, read, alpha = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "place", "read", "alpha"))
            for r in np.unique(rep).tolist():
                at = np.flatnonzero(rep == r)
                relevance, redundancy = shared.value[r]
                streams = [np.random.default_rng([seed, r, int(place[i]), int(read[i])]) for i in at]
                x, energy = anneal(-alpha[at, None] * relevance, (1.0 - alpha[at], redundancy), streams, sweeps)
                chosen = pa.array([np.flatnonzero(v).tolist() for v in x], pa.list_(pa.int32()))
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(energy), chosen], names=["rep", "place", "read", "alpha", "energy", "chosen"])

    out = plan.repartition("rep", "place").mapInArrow(run, f"{READ}, energy double, chosen array<int>")
    best = F.min(F.struct("energy", "read", "chosen"))
    return out.groupBy("rep", "place", "alpha").agg(best.alias("b")).select("rep", "place", "alpha", "b.energy", "b.chosen")


def select_qubo(
    mi: DataFrame, pairs: DataFrame, n: int, k: int, seed: int = 42, reads: int = 10, sweeps: int = 200, grid: int = 8, levels: int = 4
) -> QuboResult:
    """k features of least -a.relevance + (1-a).redundancy, each pair once, at a weight a whose least energy has k of them.

    More weight on relevance chooses more features. A level tries ``grid`` weights of every repeat at once; the next
    divides the step over which the number passes k. The smallest weight with exactly k is taken. Where no level has one, the set nearest
    to k at its weight is completed or reduced by the features that change its energy least, and the trace says so.
    """
    check_budget(k, n)
    spark = mi.sparkSession
    rows = _tables(mi, pairs).select("rep", "fi", "fj", "mi").toPandas()  # features^2 / 2 numbers per repeat
    if rows["rep"].nunique() * n * n > feat.MAX_PARAMETERS:
        raise ValueError("the information tables of all repeats are too large for one broadcast; select fewer repeats at a time")
    tables = {int(rep): _dense(part.assign(live=True), n)[:2] for rep, part in rows.groupby("rep")}
    steps = {rep: (0.0, 1.0) for rep in tables}
    tried: dict[int, list[tuple[float, list[int]]]] = {rep: [] for rep in tables}
    for level in range(levels):
        plan = [
            (rep, level * grid + j, read, low + (high - low) * (j + 1) / grid)
            for rep, (low, high) in steps.items() for j in range(grid) for read in range(reads)
        ]
        for r in lowest(tables, spark.createDataFrame(plan, READ), sweeps, seed).orderBy("rep", "place").collect():
            tried[r["rep"]].append((r["alpha"], list(r["chosen"])))
        for rep in list(steps):
            ordered = sorted(tried[rep], key=lambda t: t[0])
            over = [i for i, (_, chosen) in enumerate(ordered) if len(chosen) >= k]
            if any(len(chosen) == k for _, chosen in ordered) or not over:
                del steps[rep]
                continue
            steps[rep] = (ordered[over[0] - 1][0] if over[0] else 0.0, ordered[over[0]][0])
        if not steps:
            break
    picks, trace = [], []
    for rep, found in tried.items():
        alpha, chosen = min(found, key=lambda t: (abs(len(t[1]) - k), t[0]))
        nudged = len(chosen) != k
        picks += [(rep, f) for f in resized(set(chosen), k, alpha, *tables[rep])]
        trace += [(rep, step, round(a, 6), len(c), nudged) for step, (a, c) in enumerate(found)]
    return QuboResult(
        _arm(spark.createDataFrame(picks, "rep int, f int"), "D_qubo"),
        spark.createDataFrame(trace, "rep int, step int, alpha double, n_selected int, nudged boolean"),
    )


def resized(chosen: set[int], k: int, alpha: float, relevance: np.ndarray, redundancy: np.ndarray) -> list[int]:
    """The set with features added or taken away one by one, each time the one that leaves the least energy."""
    x = np.zeros(len(relevance))
    x[list(chosen)] = 1
    while int(x.sum()) != k:
        pull = -alpha * relevance + (1 - alpha) * redundancy @ x
        grow = x.sum() < k
        cost = np.where(x == 0, pull, np.inf) if grow else np.where(x == 1, -pull, np.inf)
        x[int(cost.argmin())] = 1.0 if grow else 0.0
    return np.flatnonzero(x).tolist()


# ---- sparse logistic regression -------------------------------------------------


def select_lasso(
    split: DataFrame, n: int, k: int, n_penalties: int = 10, folds: int = 3, seed: int = 42, tol: float = 1e-4, max_passes: int = 200
) -> DataFrame:
    """Features ranked by mean |coefficient| of an L1 softmax model of all train rows, penalty by folds over source groups.

    All repeats, folds and penalties are fitted in the same passes (``convex.fit_lasso``); of equal features the first is taken.
    """
    check_budget(k, n)
    train = feat.refuse_transductive(feat.standardise_train(split))
    models, tried = fit_lasso(train, n_penalties, folds=folds, seed=seed, tol=tol, max_passes=max_passes)
    return _arm(rank_coefficients(models.where(F.col("fold") == folds), tried, k), "E_lasso")


def rank_coefficients(models: DataFrame, tried: DataFrame, k: int) -> DataFrame:
    """(rep, f) of the k largest mean |coefficient| at the penalty with the most right answers, the larger one of equals."""
    best = tried.groupBy("rep").agg(F.max(F.struct("n_right", "penalty"))["penalty"].alias("penalty"))
    size = (F.size("coef") / F.size("classes")).cast("int")
    values = models.join(F.broadcast(best), ["rep", "penalty"]).select("rep", size.alias("size"), F.posexplode("coef").alias("i", "x"))
    values = values.withColumn("f", (F.col("i") % F.col("size")).cast("int")).where("f < size - 1")
    worth = values.groupBy("rep", "f").agg(F.avg(F.abs("x")).alias("w"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("w"), "f"))
    return worth.withColumn("place", place).where(F.col("place") <= k).select("rep", "f")


# ---- dispatch and checks ----------------------------------------------------------


@dataclass
class SelectionContext:
    """What the arms of one experiment share; information tables are built on first use and kept."""

    split: DataFrame
    reps: Sequence[int]
    n: int
    seed: int = 42
    bins: int = 16
    reads: int = 10
    sweeps: int = 200
    exact_bins: bool = True
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def _keep(self, name: str, build) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = build().persist()
        return self._cache[name]

    @property
    def binned(self) -> DataFrame:
        return self._keep(
            "binned",
            lambda: feat.train_rows(feat.quantile_bins(self.split, self.bins, self.exact_bins)).select("rep", "label", "codes"),
        )

    @property
    def mi(self) -> DataFrame:
        return self._keep("mi", lambda: info.mi_label(self.binned))

    @property
    def pairs(self) -> DataFrame:
        return self._keep("pairs", lambda: info.mi_pairs(self.binned, self.bins))

    @property
    def live(self) -> DataFrame:
        return self._keep("live", lambda: info.live_features(self.binned))

    def release(self) -> None:
        for df in self._cache.values():
            df.unpersist()
        self._cache.clear()


def select_features(arm: str, ctx: SelectionContext, k: int) -> DataFrame:
    """(rep, arm, f) rows of one arm; an unknown arm or an impossible budget is refused first."""
    spark = ctx.split.sparkSession
    if arm != "Z_full":
        check_budget(k, ctx.n)
    if arm == "A_random":
        return select_random(spark, ctx.reps, ctx.n, k, ctx.seed)
    if arm == "B_pca":
        return select_first(spark, ctx.reps, ctx.n, k)
    if arm == "C_mi":
        return select_mi(ctx.mi, ctx.n, k)
    if arm == "D_qubo":
        return select_qubo(ctx.mi, ctx.pairs, ctx.n, k, ctx.seed, ctx.reads, ctx.sweeps).selection
    if arm == "E_lasso":
        return select_lasso(ctx.split, ctx.n, k, seed=ctx.seed)
    if arm == "F_mrmr":
        return select_mrmr(ctx.mi, ctx.pairs, ctx.live, ctx.n, k)
    if arm == "Z_full":
        return select_full(spark, ctx.reps, ctx.n)
    raise ValueError(f"unknown arm {arm!r}")


def run_arms(arms: Sequence[str], ctx: SelectionContext, k: int) -> DataFrame:
    """(rep, arm, selected, seconds): all arms, each materialised once so that its time is its own."""
    spark = ctx.split.sparkSession
    rows = []
    for arm in arms:
        start = time.perf_counter()
        picked = select_features(arm, ctx, k).collect()  # arms x repeats x k small integers
        seconds = 0.0 if arm == "Z_full" else time.perf_counter() - start
        by_rep: dict[int, list[int]] = {}
        for r in picked:
            by_rep.setdefault(r["rep"], []).append(r["f"])
        rows += [(rep, arm, sorted(fs), seconds / max(len(by_rep), 1)) for rep, fs in sorted(by_rep.items())]
    return spark.createDataFrame(rows, "rep int, arm string, selected array<int>, seconds double")


def selection_violations(selected: DataFrame, k: int) -> DataFrame:
    """Stored selections that do not have exactly k different features (the full arm is exempt)."""
    rows = selected.where(F.col("arm") != "Z_full")
    size, different = F.size("selected"), F.size(F.array_distinct("selected"))
    return rows.where((size != k) | (different != k)).select("rep", "arm", size.alias("n"), different.alias("n_distinct"))
