"""Prediction metrics from (rep, arm, clf, item_id, y_true, y_pred) rows.

All of them start from one grouped count of (truth, prediction) cells, so a hot
class or repeat is collapsed by partial aggregation before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("rep", "arm", "clf")


def cells(pred: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    return pred.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(pred: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    right = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    return pred.groupBy(*by).agg(right.alias("accuracy"), F.count(F.lit(1)).alias("n_items"))


def label_stats(pred: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """(by, label, tp, support, predicted) for every label seen in truth or prediction."""
    n, tp = F.col("n"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), tp.alias("tp"), n.alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), n.alias("predicted")),
    )
    rows = cells(pred, by).select(*by, F.inline(sides))
    return rows.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _f1() -> Column:
    return _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))


def macro_f1(pred: DataFrame, by: Sequence[str] = KEYS, labels: Sequence[str] | None = None) -> DataFrame:
    """Mean F1 over the labels seen, or over a fixed label list in which an unseen label scores 0."""
    stats = label_stats(pred, by).withColumn("f1", _f1())
    if labels is None:
        return stats.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    inside = F.sum(F.when(F.col("label").isin(*labels), F.col("f1")).otherwise(0.0))
    return stats.groupBy(*by).agg((inside / len(labels)).alias("macro_f1"))


def score(pred: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy and macro-F1 from a single pass over the predictions."""
    stats = label_stats(pred, by).withColumn("f1", _f1())
    return stats.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )


def summarise(results: DataFrame, digits: int = 4) -> DataFrame:
    """Mean and sample deviation over repeats; a single repeat has no deviation (NULL)."""
    return results.groupBy("arm", "clf").agg(
        *[
            F.round(f(m), digits).alias(f"{m}_{name}")
            for m in ("accuracy", "macro_f1")
            for name, f in (("mean", F.avg), ("std", F.stddev_samp))
        ]
    )


def confusion(pred: DataFrame, classes: Sequence[str], by: Sequence[str] = ("clf",)) -> DataFrame:
    """Counts over the full class x class grid; rows with another label are left out."""
    by = list(by)
    names = F.array(*[F.lit(c) for c in classes])
    inside = F.col("y_true").isin(*classes) & F.col("y_pred").isin(*classes)
    # at most classes^2 entries per key; a key whose rows are all left out keeps an empty map
    entry = F.when(inside, F.struct(F.struct("y_true", "y_pred").alias("k"), F.col("n").alias("v")))
    packed = cells(pred, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    grid = packed.withColumn("y_true", F.explode(names)).withColumn("y_pred", F.explode(names))
    found = F.try_element_at("_m", F.struct("y_true", "y_pred"))
    return grid.select(*by, "y_true", "y_pred", F.coalesce(found, F.lit(0)).alias("n"))


def confusion_normalised(pred: DataFrame, classes: Sequence[str], by: Sequence[str] = ("clf",)) -> DataFrame:
    total = F.greatest(F.sum("n").over(Window.partitionBy(*by, "y_true")), F.lit(1))
    return confusion(pred, classes, by).withColumn("share", F.col("n") / total)


def confusion_wide(pred: DataFrame, classes: Sequence[str], by: Sequence[str] = ("clf",)) -> DataFrame:
    """One row per (by, truth) with a count column per predicted class."""
    return confusion(pred, classes, by).groupBy(*by, "y_true").pivot("y_pred", list(classes)).sum("n")


def per_class_metrics(pred: DataFrame, classes: Sequence[str], by: Sequence[str] = ("rep", "clf")) -> DataFrame:
    """Precision, recall, F1 and support of every listed class, 0 where undefined."""
    by = list(by)
    stats = label_stats(pred, by)
    sums = [
        F.sum(F.when(F.col("label") == c, F.col(m)).otherwise(0)).alias(f"_{m}{i}")
        for i, c in enumerate(classes)
        for m in ("tp", "support", "predicted")
    ]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("class"), *[F.col(f"_{m}{i}").alias(m) for m in ("tp", "support", "predicted")])
            for i, c in enumerate(classes)
        ]
    )
    flat = stats.groupBy(*by).agg(*sums).select(*by, F.inline(rows))
    return flat.select(
        *by,
        "class",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _f1().alias("f1"),
        "support",
    )


def per_class_summary(pred: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Mean of the per-class metrics over repeats, 3 decimals."""
    means = [F.round(F.avg(m), 3).alias(m) for m in ("precision", "recall", "f1", "support")]
    return per_class_metrics(pred, classes).groupBy("class", "clf").agg(*means)


def label_parity(a: DataFrame, b: DataFrame, key: str, floor: float = 0.999) -> DataFrame:
    """Share of equal labels between two predictions of the same items, and whether it is enough.

    An item that one side lacks, or without a label there, counts as a disagreement.
    """
    left = a.select(key, F.col("y_pred").cast("string").alias("_a"))
    right = b.select(key, F.col("y_pred").cast("string").alias("_b"))
    joined = left.join(right, key, "full")
    equal = F.avg(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).cast("double"))
    return joined.agg(equal.alias("agreement"), F.count(F.lit(1)).alias("n")).withColumn(
        "ok", F.coalesce(F.col("agreement") >= floor, F.lit(False))
    )


def overlap_matrix(counts: DataFrame) -> DataFrame:
    """All-zero share and shots per pair from (i, j, bits, n) rows, mirrored to both orders.

    Counts below 0, keys other than bit strings and pairs without shots fail the job.
    """
    bits = F.replace("bits", F.lit(" "), F.lit(""))
    ok = bits.rlike("^[01]+$") & (F.col("n") >= 0)
    n = F.when(ok, F.col("n")).otherwise(F.raise_error(F.lit("counts need bit-string keys and values >= 0")).cast("bigint"))
    per = counts.groupBy("i", "j").agg(F.sum(F.when(bits.rlike("^0+$"), n).otherwise(0 * n)).alias("zeros"), F.sum(n).alias("shots"))
    shots = F.when(F.col("shots") > 0, F.col("shots")).otherwise(F.raise_error(F.lit("a pair has no shots")).cast("bigint"))
    half = per.select("i", "j", (F.col("zeros") / shots).alias("k"), "shots")
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return half.select(F.explode(F.array_distinct(both)).alias("p"), "k", "shots").select("p.i", "p.j", "k", "shots")


def kernel_alignment(kernel: DataFrame, labels: DataFrame) -> DataFrame:
    """Alignment of a kernel table (i, j, k) with the same-label target, both doubly centred.

    Works on the kernel's own rows: row, column and grand means are aggregates
    joined back by index, and the same-label means follow from class sizes.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    named = labels.join(sizes, "label").select("row_id", "label", "size")
    rows = kernel.groupBy("i").agg(F.avg("k").alias("row_mean"))
    cols = kernel.groupBy("j").agg(F.avg("k").alias("col_mean"))
    n = F.sum("size")
    totals = sizes.agg(n.alias("n"), (F.sum(F.col("size") * F.col("size")) / (n * n)).alias("target_mean"))
    left = named.select(F.col("row_id").alias("i"), F.col("label").alias("li"), F.col("size").alias("si"))
    right = named.select(F.col("row_id").alias("j"), F.col("label").alias("lj"), F.col("size").alias("sj"))
    count, grand_t = totals.select("n").scalar(), totals.select("target_mean").scalar()
    grand_k = kernel.agg(F.avg("k")).scalar()
    joined = kernel.join(rows, "i").join(cols, "j").join(left, "i").join(right, "j")
    a = F.col("k") - F.col("row_mean") - F.col("col_mean") + grand_k
    same = (F.col("li") == F.col("lj")).cast("double")
    b = same - F.col("si") / count - F.col("sj") / count + grand_t
    sums = joined.select(a.alias("a"), b.alias("b")).agg(
        F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb")
    )
    norm = F.sqrt("aa") * F.sqrt("bb")
    return sums.select(F.when(norm > 1e-14, F.col("ab") / norm).otherwise(0.0).alias("alignment"))


def linear_alignment(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """The same alignment for the linear kernel x.y, without building the n x n kernel.

    With centred features X and centred class indicators Y the three inner products
    are |X'Y|^2, |X'X|^2 and |Y'Y|^2, all of which come from grouped sums.
    """
    from .features import gram_train, long_features

    rows = df.select(F.lit(0).alias("rep"), F.col(features).alias("features"), F.col(label).alias("label"))
    centre = long_features(rows).groupBy("f").agg(F.avg("x").alias("c")).persist()
    gram = gram_train(rows, centre)
    sums = gram.where("j < 0 and i >= 0").select(F.col("i"), F.col("s").alias("m"))
    count = gram.where("i < 0").select("s").scalar()
    xx = (
        gram.where("j >= 0")
        .join(F.broadcast(sums.withColumnRenamed("m", "mi")), "i")
        .join(F.broadcast(sums.select(F.col("i").alias("j"), F.col("m").alias("mj"))), "j")
        .withColumn("v", F.col("s") - F.col("mi") * F.col("mj") / count)
        .agg(F.sum(F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("v") * F.col("v")).alias("xx"))
    )
    per = long_features(rows, "label").join(F.broadcast(centre), "f")
    per = per.groupBy("label", "f").agg(F.sum(F.col("x") - F.col("c")).alias("s"))
    xy = per.agg(F.sum(F.col("s") * F.col("s")).alias("xy"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("m"))
    # |Y'Y|^2 of centred indicators: sum m_a^2 - 2 sum m_a^3 / n + (sum m_a^2 / n)^2
    yy = sizes.agg(
        F.sum("m").alias("n"), F.sum(F.col("m") ** 2).alias("m2"), F.sum(F.col("m") ** 3).alias("m3")
    ).select((F.col("m2") - 2 * F.col("m3") / F.col("n") + (F.col("m2") / F.col("n")) ** 2).alias("yy"))
    norm = F.sqrt("xx") * F.sqrt(yy.scalar())
    return xx.select(F.when(norm > 1e-14, xy.scalar() / norm).otherwise(0.0).alias("alignment"))
