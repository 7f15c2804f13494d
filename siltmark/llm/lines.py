"""Removal of lines inside three-line windows that repeat anywhere in the corpus.

Every three consecutive lines of a text are a window, so windows overlap. A window whose text
also starts earlier (smaller doc_id, or the same document further up) is repeated, and the
lines that repeated windows cover are removed; overlapping windows merge into longer covered
stretches. Windows are judged on the input, not on what is left. Windows of blank lines only
are no windows, so paragraph breaks stay.

Lines are what line feeds separate, compared exactly. Texts under three lines are left as they
are. A NULL text stays NULL and has no lines; an empty one has one. Rows equal in id and text are
one document, rows of one id with different texts are ordered by the texts' hashes, a NULL id
comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, coverage, hashes, keyed, rewrite_texts, same_document, scratch, signed, stored, text_key, texts, windows

LINES = 3


def _windows(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    docs, hits, places = [], [], []
    for i, text in enumerate(texts(batch)):
        lines = text.split(b"\n")
        found = windows(hashes(lines), size)
        if not len(found):
            continue
        filled = np.cumsum([0, *[bool(x.strip()) for x in lines]])
        at = np.flatnonzero(filled[size:] > filled[:-size])
        docs.append(np.full(len(at), i))
        hits.append(found[at])
        places.append(at)
    owner = pa.array(np.concatenate(docs) if docs else np.empty(0, np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(np.concatenate(hits))) if hits else pa.array([], pa.int64()), batch.column("doc_id").take(owner), batch.column("text_key").take(owner),
         pa.array(np.concatenate(places).astype(np.int32)) if places else pa.array([], pa.int32())],
        names=["window", "doc_id", "text_key", "line"],
    )


def repeated_windows(docs: DataFrame, size: int = LINES) -> DataFrame:
    """(doc_id, text_key, lines): the first lines of the windows that also start earlier, per document."""
    with scratch(docs.sparkSession):
        rows = stored(arrow_map(keyed(docs), lambda b: _windows(b, size), "window long, doc_id long, text_key long, line int"))
        place = F.struct("doc_id", "text_key", "line")
        first = rows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("window", "first")
        later = rows.join(first, "window").where(~place.eqNullSafe(F.col("first")))
        return stored(later.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("starts")), outlives=True)


def _rest(batch: pa.RecordBatch, size: int) -> tuple[list[int], list[int], list[bytes | None]]:
    total, removed, kept = [], [], []
    for text, starts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist(), strict=True):
        lines = [] if text is None else text.split(b"\n")
        total.append(len(lines))
        if not starts:
            removed.append(0)
            kept.append(text)
            continue
        gone = coverage(np.array(starts), size, len(lines))
        removed.append(int(gone.sum()))
        kept.append(b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g))
    return total, removed, kept


def remove_repeated_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): the remaining lines joined by line feeds."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    named, starts = keyed(docs), repeated_windows(docs, size)
    starts = starts.hint("merge")  # of stored tables small ones would be broadcast: one plan at every size
    joined = named.join(starts, same_document(named, starts), "left").select(named["doc_id"], "text", "starts")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, kept = _rest(batch, size)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_lines", "n_removed", "text"],
        )

    return arrow_map(joined, each, "doc_id long, n_lines long, n_removed long, text string")


def without_repeated_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """``docs`` with the remaining lines as text and its other columns as they are."""
    starts = repeated_windows(docs.select(F.col("doc_id").cast("long"), "text"), size)
    return rewrite_texts(docs, starts.hint("merge"), text_key(), lambda batch: _rest(batch, size)[2])
