"""Removal of long word spans that repeat anywhere in the corpus, over a compacted de Bruijn graph.

Edges are windows of ``WINDOW`` consecutive words, nodes what neighbouring windows share. The
graph is split by minimizers: the smallest hash among the ``SEED``-word pieces of a window is
the same wherever the window occurs, so the consecutive windows of a text with one minimizer
form a path that is kept as one row, and equal windows can only lie on paths with one
minimizer. Equal paths met in one batch are one path: the earliest goes on, the others are
decided at once, so a passage that many documents share sends a row per task, not one per
document. Paths are brought together by minimizer in order of their source coordinates
(doc_id, text key, word); where they branch, their edges are compared one by one. An edge seen
at an earlier coordinate is repeated. Repeated runs return to their documents by a join, and
the words they cover are removed.

A minimizer with very many different paths, as a phrase in ever new surroundings has, would
bring them all to one task. Such minimizers are looked for in a sample of the documents, which
decides the way only, not the result: the edges of their paths are grouped by (minimizer, edge)
for the least coordinate, with partial results in every task, and joined with that.

Edges are compared by 64 bits of minimizer and 48 bits of window. Documents with fewer words
than a window keep them all, as do NULL and empty texts (no words). Rows equal in id and text
are one document and keep their first occurrence in each row. Rows of one id with different
texts are ordered by the texts' hashes, a NULL id comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, hashes, mixed, rewrite_texts, same_document, signed, stored, text_key, texts, windows, words

WINDOW = 20
SEED = 6
CHUNK_WORDS = 300_000
EDGE = 6  # bytes of an edge beside its minimizer
SLICE = 1 << 15  # rows whose groups are numbered together
SAMPLE = 16  # one document in so many is looked at for hot minimizers
HOT_PATHS = 1 << 17  # a minimizer with more paths, by the sample, is hot
MOST_HOT = 10_000  # the hottest, what is broadcast
PATHS = "minimizer long, doc_id long, text_key long, start int, windows int, edges binary"
RUNS = "doc_id long, text_key long, start int, windows int"


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Edges as byte strings of ``EDGE`` bytes each; ``sizes`` counts them per row."""
    sizes, flat = sizes * EDGE, flat.view(np.uint8).reshape(-1, 8)[:, :EDGE]
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def _paths(ids: pa.Array, keys: np.ndarray, found: list[np.ndarray], window: int, seed: int) -> pa.RecordBatch | None:
    """Paths of some documents, given as word hashes in order of their coordinates."""
    sizes = np.array([len(h) for h in found])
    h = np.concatenate(found)
    n = len(h) - window + 1
    if n <= 0:
        return None
    owner = np.repeat(np.arange(len(found)), sizes)
    begin = np.cumsum(sizes) - sizes
    valid = owner[:n] == owner[window - 1 :]
    pieces = mixed(windows(h, seed))
    at = np.lib.stride_tricks.sliding_window_view(pieces, window - seed + 1).argmin(1) + np.arange(n)
    edge = windows(h, window) >> np.uint64(64 - 8 * EDGE)
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    heads = np.flatnonzero(first)
    if not len(heads):
        return None
    spots = np.flatnonzero(valid)
    edges = edge[spots]
    cut = np.searchsorted(spots, heads)
    length = np.diff(np.append(cut, len(spots)))
    minimizer = pieces[at[heads]]
    # equal paths of this chunk: the documents come in order, so the first is the earliest
    inside = np.arange(len(spots)) - np.repeat(cut, length)
    digest = np.add.reduceat(mixed(mixed(edges) + inside.astype(np.uint64)), cut) ^ mixed(minimizer + length.astype(np.uint64))
    _, earliest = np.unique(digest, return_index=True)
    later = np.ones(len(heads), bool)
    later[earliest] = False
    doc = owner[heads]
    start = heads - begin[doc]
    spread = mixed(digest + np.arange(len(heads), dtype=np.uint64))  # decided rows go anywhere
    sent = np.where(later, 0, length)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(np.where(later, spread, minimizer))), ids.take(pa.array(doc)), pa.array(keys[doc]), pa.array(start.astype(np.int32)),
         pa.array(length.astype(np.int32)), _binary(edges[~np.repeat(later, length)], sent)],
        names=["minimizer", "doc_id", "text_key", "start", "windows", "edges"],
    )


def paths(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per path; ``edges`` is empty where an equal path comes earlier."""

    def each(batch: pa.RecordBatch):
        ids, keys = batch.column("doc_id"), batch.column("text_key").to_numpy(zero_copy_only=False)
        rank = np.lexsort((keys, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)))
        found = texts(batch)
        held, size, since = [], 0, 0
        for k, i in enumerate(rank):
            held.append(hashes(words(found[i])))
            size += len(held[-1])
            if size >= CHUNK_WORDS or k == len(rank) - 1:
                own = rank[since : k + 1]
                out = _paths(ids.take(pa.array(own)), keys[own], held, window, seed)
                if out is not None:
                    yield out
                held, size, since = [], 0, k + 1

    return arrow_map(docs, each, PATHS, rows=SLICE)


def _repeats(batches):
    """Repeated runs of one partition's paths, which come in order of minimizer and coordinate."""
    last, seen = None, np.empty(0, np.uint64)
    bits = np.uint64(8 * EDGE)
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        minimizer, start, count = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("minimizer", "start", "windows"))
        column = batch.column("edges").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        wide = np.zeros(((offsets[-1] - offsets[0]) // EDGE, 8), np.uint8)
        wide[:, :EDGE] = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, EDGE)
        edges = wide.view(np.uint64).ravel()
        size = np.diff(offsets) // EDGE
        group = np.cumsum(np.append(minimizer[0] != last, minimizer[1:] != minimizer[:-1])).astype(np.uint64)
        row = np.repeat(np.arange(len(size)), size)
        key = np.concatenate([seen, group[row] << bits | edges])
        _, earliest = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[earliest] = False
        again = again[len(seen) :]
        inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        opens = again.copy()
        opens[1:] &= ~again[:-1] | (row[1:] != row[:-1])
        heads = np.flatnonzero(opens)
        runs = np.add.reduceat(again.astype(np.int32), heads) if len(heads) else np.empty(0, np.int32)
        decided = np.flatnonzero(size == 0)
        at = np.concatenate([row[heads], decided])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at)), batch.column("text_key").take(pa.array(at)),
             pa.array(np.concatenate([start[row[heads]] + inside[heads], start[decided]]).astype(np.int32)),
             pa.array(np.concatenate([runs, count[decided]]).astype(np.int32))],
            names=["doc_id", "text_key", "start", "windows"],
        )
        # the last minimizer may go on in the next batch, there as group 0
        same = key[key >> bits == group[-1]]
        last, seen = minimizer[-1], np.unique(same & ((np.uint64(1) << bits) - np.uint64(1)))


def hot_minimizers(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> list[int]:
    """Minimizers of which a sample of the documents promises more than ``HOT_PATHS`` paths."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SAMPLE)) == 0)
    counts = paths(some, window, seed).where(F.length("edges") > 0).groupBy("minimizer").count()
    found = counts.where(F.col("count") * SAMPLE > HOT_PATHS).orderBy(F.desc("count"), "minimizer").limit(MOST_HOT)
    return [r["minimizer"] for r in found.collect()]


def _repeated_edges(hot: DataFrame) -> DataFrame:
    """Repeated runs of paths whose minimizers are hot, a run for each window."""
    piece = lambda i: F.struct((F.col("start") + i).alias("start"), F.substring("edges", i * EDGE + 1, F.lit(EDGE)).alias("edge"))
    one = F.explode(F.transform(F.sequence(F.lit(0), F.col("windows") - 1), piece)).alias("x")
    edges = hot.select("minimizer", "doc_id", "text_key", one).select("minimizer", "doc_id", "text_key", "x.start", "x.edge")
    place = F.struct("doc_id", "text_key", "start")
    first = edges.groupBy("minimizer", "edge").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).select("minimizer", "edge", "first")
    later = edges.join(first, ["minimizer", "edge"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("doc_id", "text_key", "start", F.lit(1).alias("windows"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, start, windows): runs of windows that also start at an earlier coordinate."""
    graph, found = paths(docs, window, seed), hot_minimizers(docs, window, seed)
    edges = None
    if found:
        hot = F.broadcast(docs.sparkSession.createDataFrame([(m,) for m in found], "minimizer long"))
        edges = _repeated_edges(stored(graph.join(hot, "minimizer").where(F.length("edges") > 0)))
        # a decided path has a random number for its minimizer and no edges
        marked = graph.join(hot.withColumn("apart", F.lit(True)), "minimizer", "left")
        graph = marked.where(F.col("apart").isNull() | (F.length("edges") == 0)).drop("apart")
    graph = graph.repartition("minimizer").sortWithinPartitions("minimizer", "doc_id", "text_key", "start")
    runs = graph.mapInArrow(_repeats, RUNS)
    return runs.unionByName(edges) if edges is not None else runs


def identified(docs: DataFrame) -> tuple[Column, DataFrame]:
    """The column that tells rows of one id apart, and one row for each document. It is 0 where ids tell all rows apart."""
    twice = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    key = text_key() if twice else F.lit(0).cast("long")
    named = docs.withColumn("text_key", key)
    return key, named.dropDuplicates(["doc_id", "text_key"]) if twice else named


def covered(docs: DataFrame, window: int, seed: int) -> tuple[Column, DataFrame]:
    """The key column, and (doc_id, text_key, starts, counts): each document's repeated runs."""
    key, single = identified(docs.select(F.col("doc_id").cast("long"), "text"))
    runs = repeated_runs(single, window, seed).groupBy("doc_id", "text_key")
    return key, runs.agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts"))


def _rest(batch: pa.RecordBatch, window: int) -> tuple[list[int], list[int], list[list[bytes]]]:
    total, removed, kept = [], [], []
    for text, starts, counts in zip(texts(batch), batch.column("starts").to_pylist(), batch.column("counts").to_pylist(), strict=True):
        found = words(text)
        total.append(len(found))
        if starts:
            gone = covered_words(np.array(starts), np.array(counts), window, len(found))
            found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
        removed.append(total[-1] - len(found))
        kept.append(found)
    return total, removed, kept


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the remaining words joined by one space."""
    key, runs = covered(docs, window, seed)
    named = docs.select(F.col("doc_id").cast("long"), key.alias("text_key"), "text")
    joined = named.join(runs, same_document(named, runs), "left").select(named["doc_id"], "text", "starts", "counts")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, kept = _rest(batch, window)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([b" ".join(w) for w in kept], pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "text"],
        )

    return arrow_map(joined, each, "doc_id long, n_words long, n_removed long, text string")


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with the remaining words as text where any went, and its other columns as they are."""
    key, runs = covered(docs, window, seed)

    def rewrite(batch: pa.RecordBatch) -> list[bytes | None]:
        _, removed, kept = _rest(batch, window)
        old = batch.column("text").cast(pa.binary()).to_pylist()
        return [b" ".join(w) if r else t for w, r, t in zip(kept, removed, old, strict=True)]

    return rewrite_texts(docs, runs, key, rewrite)


def covered_words(starts: np.ndarray, counts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Mask of the words under runs of ``counts`` windows from ``starts`` on."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + counts + window - 1, n), -1)
    return np.cumsum(step[:n]) > 0
