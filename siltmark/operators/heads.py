"""Classifier heads: small kernel models fitted per (repeat, arm), and MLlib models over all rows.

The grouped fits see at most ``max_train`` rows by design of the experiment; held-out
rows, of which there may be any number, are scored partition by partition.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_rep, lists, matrix, replace_column
from ..functions.columns import seeded_hash
from ..functions.joins import small
from .features import MAX_PARAMETERS, add_list, refuse_transductive, train_rows
from .splits import balanced_weights, cap_rows

HEADS = ("rbf_svm", "rbf_svm_tuned", "linear_svm")
# The tuning grid of the tuned head.
GRID_C = (0.1, 1.0, 10.0, 100.0)
GRID_GAMMA = ("scale", 0.01, 0.1, 1.0)
FOLDS = 3

MODEL = (
    "rep int, arm string, clf string, method string, c double, gamma double, classes array<string>, "
    "selected array<int>, support array<double>, coef array<double>, n_train int, fit_seconds double"
)


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """RBF kernel, or the linear one when gamma is 0; the constant 1 carries the intercept."""
    if gamma == 0:
        return a @ b.T + 1.0
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0.0)) + 1.0


def _solve(x: np.ndarray, y: np.ndarray, classes: np.ndarray, c: float, gamma: float) -> np.ndarray:
    """One-against-rest regularised least squares with balanced class weights."""
    counts = np.array([(y == k).sum() for k in classes])
    weight = len(y) / (np.count_nonzero(counts) * counts[np.searchsorted(classes, y)])
    target = np.where(y[:, None] == classes[None, :], 1.0, -1.0)
    return np.linalg.solve(_kernel(x, x, gamma) + np.diag(1.0 / (c * weight)), target)


def _scale_gamma(x: np.ndarray) -> float:
    return 1.0 / max(x.shape[1] * x.var(), 1e-12)


def _tune(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[float, float]:
    best, choice = -1.0, (1.0, _scale_gamma(x))
    for c in GRID_C:
        for g in GRID_GAMMA:
            right = total = 0
            for k in range(FOLDS):
                fit, held = fold != k, fold == k
                if not held.any() or len(np.unique(y[fit])) < 2:
                    continue
                classes = np.unique(y[fit])
                gamma = _scale_gamma(x[fit]) if g == "scale" else float(g)
                coef = _solve(x[fit], y[fit], classes, c, gamma)
                guess = classes[(_kernel(x[held], x[fit], gamma) @ coef).argmax(1)]
                right, total = right + (guess == y[held]).sum(), total + held.sum()
            if total and right / total > best:
                best, choice = right / total, (c, _scale_gamma(x) if g == "scale" else float(g))
    return choice


@dataclass(frozen=True)
class HeadModels:
    """Fitted heads as rows; their number is repeats x arms x heads, their size bounded by the row cap."""

    models: DataFrame

    def predict(self, split: DataFrame) -> DataFrame:
        """(rep, item_id, grp, y_true, arm, clf, y_pred, predict_seconds) for the held-out rows."""
        rows = [r.asDict() for r in self.models.collect()]
        if sum(len(r["support"]) + len(r["coef"]) for r in rows) > MAX_PARAMETERS:
            raise ValueError("models of all repeats are too large for one broadcast; predict fewer repeats at a time")
        held: dict[int, list[dict]] = {}
        for r in rows:
            d = len(r["selected"])
            held.setdefault(r["rep"], []).append(
                {
                    "key": (r["arm"], r["clf"]),
                    "idx": np.array(r["selected"], dtype=int),
                    "support": np.array(r["support"]).reshape(-1, d),
                    "coef": np.array(r["coef"]).reshape(-1, len(r["classes"])),
                    "gamma": r["gamma"],
                    "classes": np.array(r["classes"], dtype=object),
                }
            )
        shared = split.sparkSession.sparkContext.broadcast(held)

        names = ["rep", "item_id", "grp", "y_true", "arm", "clf", "y_pred", "predict_seconds"]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rep, at, x in by_rep(batch):
                    ids = batch.select(names[:4]).take(pa.array(at))
                    for m in shared.value.get(rep, []):
                        start = time.perf_counter()
                        decision = _kernel(x[:, m["idx"]], m["support"], m["gamma"]) @ m["coef"]
                        guess = m["classes"][decision.argmax(1)]
                        spent = (time.perf_counter() - start) / len(at)
                        more = [pa.array([v] * len(at)) for v in m["key"]]
                        more += [pa.array(guess, pa.string()), pa.array(np.full(len(at), spent))]
                        yield pa.RecordBatch.from_arrays([*ids.columns, *more], names=names)

        test = split.where("is_test").select(
            "rep", F.col("row_id").cast("string").alias("item_id"), F.col("grp").cast("string").alias("grp"),
            F.col("label").alias("y_true"), "features",
        )
        schema = "rep int, item_id string, grp string, y_true string, arm string, clf string, y_pred string, predict_seconds double"
        return test.mapInArrow(score, schema)


def fit_heads(
    split: DataFrame,
    selections: DataFrame,
    heads: Sequence[str] = HEADS,
    max_train: int = 400,
    seed: int = 42,
) -> HeadModels:
    """Every head on every (repeat, arm): independent fits, one task group each, on at most ``max_train`` rows."""
    unknown = set(heads) - set(HEADS)
    if unknown:
        raise ValueError(f"unknown heads {sorted(unknown)}")
    rows = cap_rows(train_rows(refuse_transductive(split)), max_train, seed)
    chosen = selections.select("rep", "arm", "selected")
    x = F.transform("selected", lambda i: F.col("features")[i].cast("double"))
    fold = F.pmod(F.conv(F.left(seeded_hash(F.lit(seed), F.col("grp")), F.lit(4)), 16, 10).cast("int"), F.lit(FOLDS))
    units = rows.join(F.broadcast(chosen), "rep").select(
        "rep", "arm", F.explode(F.array(*[F.lit(h) for h in heads])).alias("clf"), "row_id",
        F.col("label").cast("string").alias("label"), "selected", x.alias("x"), fold.alias("fold"),
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        start = time.perf_counter()
        data, y = np.stack(pdf["x"].to_numpy()), pdf["label"].to_numpy().astype(str)
        classes, clf = np.unique(y), pdf["clf"].iloc[0]
        c, gamma = 1.0, _scale_gamma(data)
        if clf == "linear_svm":
            gamma = 0.0
        elif clf == "rbf_svm_tuned":
            c, gamma = _tune(data, y, pdf["fold"].to_numpy())
        coef = _solve(data, y, classes, c, gamma)
        support = data
        if gamma == 0:
            # the linear model needs one weight row per feature and an intercept, not its training rows
            weights, intercept = data.T @ coef, coef.sum(0)
            support = np.vstack([np.eye(data.shape[1]), np.zeros(data.shape[1])])
            coef = np.vstack([weights, intercept - weights.sum(0)])
        return pd.DataFrame(
            {
                "rep": [int(pdf["rep"].iloc[0])], "arm": [pdf["arm"].iloc[0]], "clf": [clf],
                "method": ["linear_ls" if gamma == 0 else "rbf_exact"], "c": [c], "gamma": [gamma],
                "classes": [list(classes)], "selected": [list(pdf["selected"].iloc[0])],
                "support": [support.ravel()], "coef": [coef.ravel()],
                "n_train": [len(y)], "fit_seconds": [time.perf_counter() - start],
            }
        )

    return HeadModels(units.groupBy("rep", "arm", "clf").applyInPandas(fit, MODEL).persist())


# ---- MLlib heads over all train rows ---------------------------------------------


def fourier_features(df: DataFrame, width: int, gamma: float, out: int = 256, seed: int = 42) -> DataFrame:
    """Features replaced by ``out`` seeded random Fourier features of the RBF kernel with this gamma."""

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        weights = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, out))
        shift = rng.uniform(0.0, 2.0 * np.pi, out)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("features"))
            yield replace_column(batch, "features", lists(np.sqrt(2.0 / out) * np.cos(x @ weights + shift)))

    return add_list(df, "features", "array<double>", lift)


def weighted_rows(split: DataFrame) -> DataFrame:
    """Split rows with ``weight``, the balanced weight of their class on the train side (1 for unseen classes)."""
    weights = balanced_weights(train_rows(split)).select("rep", "label", "weight")
    return split.join(small(weights), ["rep", "label"], "left").fillna({"weight": 1.0})


def linear_head(split: DataFrame, rep: int = 0, reg: float = 0.01, max_iter: int = 50, clf: str = "linear_svm", lift=None):
    """(fitted pipeline, predictions) of a class-balanced multinomial model over all train rows of one repeat.

    ``lift`` maps rows to rows with other features. It is applied where they are fitted and scored only: classes are counted before.
    ``gap`` of a prediction is how far the score of its class is behind the highest one, both worked out again from the fitted weights.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexerModel
    from pyspark.ml.functions import array_to_vector

    lift = lift or (lambda df: df)
    rows = refuse_transductive(split).where(F.col("rep") == rep)
    # one count per class gives its weight and its place
    counts = train_rows(rows).groupBy("label", F.col("label").cast("string").alias("text")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    weights = [(r["label"], total / (len(counts) * r["n"])) for r in counts]
    weights = split.sparkSession.createDataFrame(weights, f"label {split.schema['label'].dataType.simpleString()}, weight double")
    rows = rows.join(F.broadcast(weights), "label", "left").fillna({"weight": 1.0})
    named = sorted((-r["n"], r["text"]) for r in counts if r["text"] is not None)
    vector = array_to_vector(F.col("features").cast("array<double>"))
    train = lift(train_rows(rows)).withColumn("vector", vector)
    index = StringIndexerModel.from_labels([text for _, text in named], inputCol="label", outputCol="y", handleInvalid="keep")
    model = LogisticRegression(
        featuresCol="vector", labelCol="y", weightCol="weight", family="multinomial", regParam=reg, maxIter=max_iter
    )
    back = IndexToString(inputCol="prediction", outputCol="y_pred", labels=[*index.labels, "?"])
    fitted = Pipeline(stages=[index, model, back]).fit(train)
    pred = fitted.transform(lift(rows.where("is_test")).withColumn("vector", vector)).select(
        "rep", F.lit(clf).alias("clf"), F.col("row_id").cast("string").alias("item_id"),
        F.col("label").alias("y_true"), "y_pred", _gap(fitted.stages[1], back.getLabels()).alias("gap"),
    )
    return fitted, pred


def _gap(model, names: list[str]) -> Column:
    """The highest score less that of the predicted class, by SQL from the weights; NULL where ``y_pred`` is not the class's name."""
    x = F.col("features").cast("array<double>")
    dot = lambda w: F.aggregate(F.zip_with(F.array(*map(F.lit, w)), x, lambda a, v: a * v), F.lit(0.0), lambda t, v: t + v)
    scores = F.array(*[dot(w) + F.lit(b) for w, b in zip(model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist(), strict=True)])
    at = F.col("prediction").cast("int")
    # both may be infinite, where there is one class only
    gap = F.transform(F.array(scores), lambda s: F.when(F.get(s, at) == F.array_max(s), 0.0).otherwise(F.array_max(s) - F.get(s, at)))[0]
    return F.when(F.get(F.array(*map(F.lit, names)), at) == F.col("y_pred"), gap)


def lowered(fitted) -> bool:
    """Whether the fit left its objective lower than where it began; a single class needs no fit."""
    steps = fitted.stages[1].summary.objectiveHistory
    return steps[-1] < steps[0] if len(steps) > 1 else len(fitted.stages[0].labels) == 1


def rbf_head(split: DataFrame, width: int, gamma: float, rep: int = 0, out: int = 256, seed: int = 42, **fit):
    """RBF head at any size: Fourier features, then the linear head. An approximation, named as such."""
    return linear_head(split, rep, clf="rbf_rff", lift=lambda df: fourier_features(df, width, gamma, out, seed), **fit)


def tuned_head(
    split: DataFrame, rep: int = 0, regs: Sequence[float] = (0.001, 0.01, 0.1), folds: int = FOLDS, seed: int = 42,
    parallelism: int = 4, max_iter: int = 30,
):
    """(best model, its penalty) of the linear head by folds over source groups."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = weighted_rows(train_rows(refuse_transductive(split)).where(F.col("rep") == rep))
    fold = F.pmod(F.conv(F.left(seeded_hash(F.lit(seed), F.col("grp")), F.lit(4)), 16, 10).cast("int"), F.lit(folds))
    rows = rows.select(
        "label", "weight", array_to_vector(F.col("features").cast("array<double>")).alias("vector"), fold.cast("int").alias("fold")
    )
    indexed = StringIndexer(inputCol="label", outputCol="y").fit(rows).transform(rows)
    model = LogisticRegression(featuresCol="vector", labelCol="y", weightCol="weight", family="multinomial", maxIter=max_iter)
    cv = CrossValidator(
        estimator=model, estimatorParamMaps=ParamGridBuilder().addGrid(model.regParam, list(regs)).build(),
        evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"),
        numFolds=folds, foldCol="fold", parallelism=parallelism,
    )
    best = cv.fit(indexed).bestModel
    return best, float(best.getRegParam())


def deploy_head(split: DataFrame, selected: Sequence[int], k_pca: int, path: str, max_train: int = 400, seed: int = 42):
    """Fit scaler -> PCA -> chosen components -> classifier on the capped rows of repeat 0, save it, check it.

    Scaler and PCA see every train row of the repeat; the classifier sees the same
    capped rows as the experiment's heads. Returns (reloaded pipeline, parity row).
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer, VectorSlicer
    from pyspark.ml.functions import array_to_vector

    from .metrics import label_parity

    rows = refuse_transductive(split).where("rep = 0")
    rows = rows.withColumn("vector", array_to_vector(F.col("features").cast("array<double>")))
    train = train_rows(rows)
    stages = []
    for stage in (
        StandardScaler(inputCol="vector", outputCol="scaled", withMean=True),
        PCA(inputCol="scaled", outputCol="pcs", k=k_pca),
        VectorSlicer(inputCol="pcs", outputCol="chosen", indices=list(map(int, selected))),
    ):
        fitted = stage.fit(train) if hasattr(stage, "fit") else stage
        stages.append(fitted)
        train = fitted.transform(train)
    capped = weighted_rows(cap_rows(train, max_train, seed))
    index = StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep").fit(capped)
    head = LogisticRegression(featuresCol="chosen", labelCol="y", weightCol="weight", family="multinomial", regParam=0.01)
    model = head.fit(index.transform(capped))
    stages += [model, IndexToString(inputCol="prediction", outputCol="y_pred", labels=[*index.labels, "?"])]
    pipeline = PipelineModel(stages)
    pipeline.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    test = rows.where("is_test")
    parity = label_parity(pipeline.transform(test), loaded.transform(test), "row_id")
    if not parity.collect()[0]["ok"]:
        raise RuntimeError("the reloaded head does not reproduce the fitted one")
    return loaded, parity
