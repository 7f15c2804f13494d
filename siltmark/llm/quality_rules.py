"""Quality rules whose cutoffs follow the data of each language and source.

Counts per document are joined with thresholds read off mergeable quantile sketches. A threshold
lies in the middle of the first gap of a group's distribution beyond its middle fifth: what is
set apart from the bulk of its group by more than a least width is kept out, wherever the gap
is, and a group without a gap keeps all. So junk is found while it is less than two fifths of a
group, and the place of no cutoff is fixed.

One sketch is kept for each (language, source); the sketches of a language are merged for its
small sources, and all of them for small languages, so no row is read twice for that.
The merged sketches also bound the thresholds of what is in them: a source keeps nothing that
its language as a whole keeps out.

Empty or NULL texts have zero counts and fail the base rule. NULL ``lang`` or ``source`` is
a group of its own. Repeated rows count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, hashes, stored, texts, windows, words

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

#: metric -> (least width of a gap, sides, widest): a threshold is never beyond that of the widest rows named;
#: words are longer in some languages than in most
METRICS = {
    "word_length": (1.0, "both", "lang"),
    "symbol_share": (0.10, "upper", "all"),
    "dup_line_share": (0.40, "upper", "all"),  # a text of three lines may well repeat one
    "repeat_share": (0.40, "upper", "all"),
}
#: quantiles that are looked at from the middle outwards, the last one the extreme
OUTWARDS = (*(0.6 + 0.02 * i for i in range(20)), 0.99, 0.995, 0.998, 0.999, 1.0)
#: a gap is also wider than the middle fifth of its group so many times: in a wide distribution the last values lie far apart
SPREADS = 3.0
MIN_ROWS = 100


def repeated_words(h: np.ndarray, size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more, all occurrences included."""
    w = windows(h, size)
    if len(w) < 2:
        return 0
    _, inverse, count = np.unique(w, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    covered = np.zeros(len(h), bool)
    for k in range(size):
        covered[at + k] = True
    return int(covered.sum())


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    length = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    rows = np.zeros((6, batch.num_rows), np.int64)
    for i, text in enumerate(texts(batch)):
        found = words(text)
        lines = [x for x in text.split(b"\n") if x.strip()]
        rows[:, i] = (
            len(found),
            length[i] - sum(text.count(bytes((c,))) for c in SPACES),
            sum(text.count(bytes((c,))) for c in SYMBOLS),
            len(lines) - len(set(lines)),
            repeated_words(hashes(found)),
            len(lines),
        )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").cast(pa.int64()), batch.column("lang"), batch.column("source"), *map(pa.array, rows)],
        names=["doc_id", "lang", "source", *names],
    )


def text_stats(docs: DataFrame) -> DataFrame:
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string")), _count, STATS)


def _metrics() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
    }


def thresholds(stats: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Lower and upper threshold of each metric for every (lang, source) of ``stats``; infinite where there is no gap.

    Quantiles come from one KLL sketch per group, built on the map side and merged after
    the shuffle. A group under ``min_rows`` takes its language's threshold, a language under it
    that of all. A larger one takes its own, or the other where that is narrower; only the
    word length of a language is its own alone.
    """
    metrics = _metrics()
    groups = stored(
        stats.groupBy("lang", "source").agg(
            F.count("*").alias("rows"), *[F.kll_sketch_agg_double(m.cast("double"), F.lit(400)).alias(name) for name, m in metrics.items()]
        )
    )

    def merged(*by: Column) -> DataFrame:
        return groups.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(n, F.lit(400)).alias(n) for n in metrics])

    lang, whole = merged(F.col("lang")).alias("l"), merged(F.lit(1).alias("one")).alias("w")
    g = groups.withColumn("one", F.lit(1)).alias("g")
    wide = g.join(lang, F.col("g.lang").eqNullSafe(F.col("l.lang"))).join(whole, F.col("g.one") == F.col("w.one"))
    cuts = []
    for name, (width, sides, widest) in METRICS.items():

        def first_gap(side: str, ranks: list[float], beyond: float) -> Column:
            at = F.kll_sketch_get_quantile_double(F.col(f"{side}.{name}"), F.array(*[F.lit(r) for r in ranks]))
            middle = F.kll_sketch_get_quantile_double(F.col(f"{side}.{name}"), F.array(F.lit(0.4), F.lit(0.6)))
            least = F.greatest(F.lit(width), SPREADS * (F.get(middle, F.lit(1)) - F.get(middle, F.lit(0))))
            steps = F.transform(F.sequence(F.lit(0), F.lit(len(ranks) - 2)), lambda i: F.array(F.get(at, i), F.get(at, i + 1)))
            gaps = F.filter(steps, lambda p: F.abs(F.get(p, F.lit(1)) - F.get(p, F.lit(0))) >= least)
            centres = F.transform(gaps, lambda p: (F.get(p, F.lit(0)) + F.get(p, F.lit(1))) / 2)
            return F.coalesce(F.get(centres, F.lit(0)), F.lit(beyond))

        def fences(side: str) -> tuple[Column, Column]:
            low = first_gap(side, [1.0 - r for r in OUTWARDS], float("-inf")) if sides == "both" else F.lit(float("-inf"))
            return low, first_gap(side, list(OUTWARDS), float("inf"))

        own, of_lang, of_all = (fences(side) for side in "glw")
        for i, (end, narrower) in enumerate((("min", F.greatest), ("max", F.least))):
            outer = of_lang[i] if widest == "lang" else narrower(of_lang[i], of_all[i])
            outer = F.when(F.col("l.rows") >= min_rows, outer).otherwise(of_all[i])
            cuts.append(F.when(F.col("g.rows") >= min_rows, narrower(own[i], outer)).otherwise(outer).alias(f"{name}_{end}"))
    return wide.select("g.lang", "g.source", *cuts)


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_rows: int = MIN_ROWS) -> DataFrame:
    """Counts, base rule and verdict for every document."""
    stats = stored(text_stats(docs))
    cut = thresholds(stats, min_rows).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    inside = F.lit(True)
    for name, m in _metrics().items():
        inside = inside & (m <= F.col(f"{name}_max")) & (m >= F.col(f"{name}_min"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    joined = stats.join(cut, stats["lang"].eqNullSafe(cut["_lang"]) & stats["source"].eqNullSafe(cut["_source"]))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"), "lang", "source",
    )
