"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A paragraph is a line, cut further after words chosen by their hash (one in eight), so that
an edit inside a long paragraph changes few digests. Digests are numbered where they repeat
and put into ``CELLS`` cells, three cells each; a cell keeps a count, the XOR of its digests and
the XOR of their checks. The difference of two tables holds just the digests that one text has
and the other lacks, and peeling cells with a single digest recovers them. Where peeling
sticks, both texts are put into tables of ``GROWTH`` times as many cells, until it succeeds.
Likeness is the Jaccard similarity of the two digest sets that the recovered difference gives.

The fingerprint is the table of ``CELLS`` cells as base64, so equal texts have equal ones. Texts
without words have no digests; two of those are alike 1.0, one of them and another text 0.0.
NULL counts as empty.

The next document is the one with the next smaller doc_id, after the smallest the largest;
rows with one id follow in order of their texts' hashes, NULL ids come last.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import hashes, mixed, text_key, words

CELLS = 30
GROWTH = 4
CUT = np.uint64(7)  # a word whose hash has these bits 0 ends a piece
ROWS_PER_BUCKET = 4096
MAX_BUCKETS = 1 << 15
BLOCK_DIGESTS = 60_000
_ODD = np.uint64(0xD6E8FEB86659FD93)


def digests(text: bytes) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs of a text, repeats numbered."""
    found, ends = [], []
    for line in text.split(b"\n"):
        found += line.split()
        ends.append(len(found))
    if not found:
        return np.empty(0, np.uint64)
    h = hashes(found)
    last = h & CUT == 0
    last[np.array(ends)[np.array(ends) > 0] - 1] = True
    starts = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
    size = np.diff(np.append(starts, len(h)))
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(starts, size).astype(np.uint64)
    d = np.sort(mixed(np.add.reduceat(mixed(h + place * _ODD), starts) + size.astype(np.uint64)))
    fresh = np.append(True, d[1:] != d[:-1])
    nth = np.arange(len(d)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return mixed(d + nth.astype(np.uint64) * _ODD)


def _check(keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ _ODD) >> np.uint64(32)


def _cells(owner: np.ndarray, keys: np.ndarray, cells: int) -> np.ndarray:
    """Three cells for each digest, one in each third of its owner's table."""
    third = np.uint64(cells // 3)
    spots = [(mixed(keys + np.uint64(j + 1)) % third).astype(np.int64) + j * (cells // 3) for j in range(3)]
    return np.stack(spots) + owner * cells


class Tables:
    """Tables of several texts, or differences of them, side by side."""

    def __init__(self, number: int, cells: int):
        self.cells = cells
        self.count = np.zeros(number * cells, np.int32)
        self.key = np.zeros(number * cells, np.uint64)
        self.check = np.zeros(number * cells, np.uint64)

    def put(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        at = _cells(owner, keys, self.cells)
        check = _check(keys)
        for spots in at:
            np.add.at(self.count, spots, sign)
            np.bitwise_xor.at(self.key, spots, keys)
            np.bitwise_xor.at(self.check, spots, check)
        return at.ravel()

    def peel(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(digests recovered per owner, whether its table is empty afterwards)."""
        recovered = np.zeros(number, np.int64)
        look = np.flatnonzero(self.count)
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (self.check[look] == _check(self.key[look]))]
            if not len(pure):
                break
            owner, keys = pure // self.cells, self.key[pure]
            order = np.lexsort((keys, owner))
            first = np.append(True, (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
            take = order[first]
            np.add.at(recovered, owner[take], 1)
            look = np.unique(self.put(owner[take], keys[take], -self.count[pure[take]]))
        stuck = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return recovered, ~stuck.reshape(number, self.cells).any(1)

    def text(self, i: int) -> str:
        at = slice(i * self.cells, (i + 1) * self.cells)
        data = self.count[at].astype("<u2").tobytes() + self.key[at].astype("<u8").tobytes() + self.check[at].astype("<u4").tobytes()
        return base64.b64encode(data).decode()


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) if sets else np.empty(0, np.uint64)


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    made = Tables(len(sets), CELLS)
    made.put(*_flat(sets), 1)
    return [made.text(i) for i in range(len(sets))]


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of each pair of digest sets, from the digests that their tables' difference gives back."""
    a, b = (np.array([len(s) for s in x]) for x in (left, right))
    differ = np.zeros(len(left), np.int64)
    open_, cells = np.arange(len(left)), CELLS
    while len(open_):
        tables = Tables(len(open_), cells)
        tables.put(*_flat([left[i] for i in open_]), 1)
        tables.put(*_flat([right[i] for i in open_]), -1)
        found, done = tables.peel(len(open_))
        differ[open_[done]] = found[done]
        open_, cells = open_[~done], cells * GROWTH
    union = (a + b + differ) / 2
    return np.where(union > 0, (union - differ) / np.maximum(union, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the value (NULL: none), by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    array = F.array(*[F.lit(b) for b in bounds])
    heads = F.array(*[F.lit(b) for b in bounds[::step]])
    block = F.size(F.filter(heads, lambda b: b < value))
    inside = F.size(F.filter(F.slice(array, F.greatest(block - 1, F.lit(0)) * step + 1, F.lit(step)), lambda b: b < value))
    return F.when(value.isNull() | (block <= 0), F.lit(0)).otherwise((block - 1) * step + inside)


def in_order(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Documents dealt by ranges of ids, largest first in each; ``edge`` marks copies of the next range's first rows.

    Bounds come from a quantile sketch of the ids, at most ``MAX_BUCKETS``, so the list of each
    range's first id fits the driver and a broadcast.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    ids = docs.select("doc_id")
    buckets = max(1, min(MAX_BUCKETS, -(-ids.count() // rows_per_bucket)))
    bounds: list[int] = []
    if buckets > 1:
        points = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], F.lit(20 * buckets))).first()[0]
        bounds = sorted({p for p in points or []})
    dealt = docs.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    tops = dealt.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect()  # one row per range
    tops = sorted(((r["bucket"], r["doc_id"]) for r in tops), reverse=True)
    turns = [(tops[i][0], top) for i, (_, top) in enumerate(tops[1:] + tops[:1])]
    edges = F.broadcast(spark.createDataFrame(turns, "bucket int, top long"))
    copies = docs.join(edges, docs["doc_id"].eqNullSafe(edges["top"])).select("doc_id", "text", "bucket")
    both = dealt.select("doc_id", "text", "bucket", F.lit(False).alias("edge")).unionByName(copies.select("doc_id", "text", "bucket", F.lit(True).alias("edge")))
    return both.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "edge", F.col("doc_id").desc_nulls_last(), text_key())


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(pairs: list[tuple]) -> pa.RecordBatch:
    """pairs: (doc_id, text, its digests, next text, its digests)."""
    changed = [edited(t, n) for _, t, _, n, _ in pairs]
    own, after, made = [p[2] for p in pairs], [p[4] for p in pairs], [digests(t.encode()) for t in changed]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([p[0] for p in pairs], pa.int64()),
        "n_chars": pa.array([len(p[1]) for p in pairs], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": fingerprints(own),
        "edited_fingerprint": fingerprints(made),
        "near_edited": likeness(own, made),
        "near_next": likeness(own, after),
    })


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    before, bucket = None, None
    for batch in batches:
        for i, text, b, edge in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "edge")), strict=True):
            if edge and (before is None or b != bucket):
                continue
            here = (i, text or "", digests((text or "").encode()))
            if before is not None and b == bucket:
                yield (*before, *here[1:])
            before, bucket = (None if edge else here), b


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for pair in _pairs(batches):
        held.append(pair)
        size += len(pair[2]) + len(pair[4])
        if size >= BLOCK_DIGESTS:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def compare_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document are."""
    return in_order(docs).mapInArrow(_compare, COLUMNS)
