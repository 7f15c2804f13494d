"""Periodic runs of words: stretches that repeat with a fixed period three times or more.

A run is a longest stretch of consecutive words whose smallest period ``q`` (words ``q`` apart
are equal) goes into it at least ``repeats`` times, and that is at least ``least`` words long.
Two suffixes ``q`` apart that start a run agree over its length less ``q``, so no agreement
under ``floor_lcp`` words matters: 16 for 24 words and three repeats.

Suffixes are ranked by prefix doubling; their neighbours in that order are edges, weighed by
the longest common prefix (LCP). Edges are taken by descending LCP and unite suffix classes by
union-find, the smaller ordered position set going into the larger. Positions that become
neighbours in a set, at a distance ``p`` with ``p * (repeats - 1) <= LCP``, seed a run: its
period is ``p``, since a smaller one would put a position between them, and it is
``LCP + p`` words long if the words before the two differ. Each run is seeded once.

Only texts in which some ``floor_lcp`` words occur twice are ranked; a hash of every window
finds them, and equal words, not equal hashes, decide the rest.

A NULL or empty text has no words and no runs, as has any text of fewer than ``least`` words. Each
row is judged by itself: rows may repeat, ids may repeat or be NULL. An empty table gives no
rows. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, hashes, texts, windows, words

LEAST = 24
REPEATS = 3
GROUP_WORDS = 400_000  # texts ranked together; a longer one is ranked alone
OUT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "starts array<long>, lengths array<long>, periods array<long>, collapsed string"
)

Runs = list[tuple[int, int, int]]
#: (doc_id, number of words) -> order in which the text's words are read, or None for as they are
Reading = Callable[[int | None, int], "np.ndarray | None"]


def floor_lcp(least: int, repeats: int) -> int:
    """The least agreement of two suffixes that start a run one period apart, over all periods."""
    return min(max(least, repeats * q) - q for q in range(1, least + 1))


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Order of words in which one text in ten ends periodically, by the checksum of its id; a NULL id never."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _rank(ids: np.ndarray, floor: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of windows of 1, 2, 4, ... words, and the positions whose first ``floor`` words recur, by suffix.

    A rank is the number of suffixes before the window's first; windows that occur once keep theirs.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    _, first, count = np.unique(ids[order], return_index=True, return_counts=True)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first, count)
    levels, width, live = [rank], 1, np.arange(n)
    kept = None
    while True:
        live = live[np.bincount(rank, minlength=n)[rank[live]] > 1]
        if width * 2 > floor and kept is None:
            kept = live  # a superset of those that recur over ``floor`` words
        if not len(live):
            break
        after = live + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((second, rank[live]))
        live, second = live[order], second[order]
        old = rank[live]
        opens = np.ones(len(live), bool)
        opens[1:] = old[1:] != old[:-1]
        group = np.maximum.accumulate(np.where(opens, np.arange(len(live)), 0))
        opens[1:] |= second[1:] != second[:-1]
        at = np.maximum.accumulate(np.where(opens, np.arange(len(live)), 0))
        rank = rank.copy()
        rank[live] = old + (at - group)
        levels.append(rank)
        width *= 2
    kept = live if kept is None else kept
    return levels, kept[np.argsort(rank[kept], kind="stable")]


def _common(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Longest common prefixes of the suffixes at ``left`` and ``right``, pair by pair."""
    n = len(levels[0])
    total = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = left + total, right + total
        inside = (i < n) & (j < n)
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        total += np.where(same, 1 << k, 0)
    return total


def _seeds(suffixes: list[int], lcp: list[int], ids: list[int], repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) by descending-LCP Kruskal over neighbours ``suffixes[t], suffixes[t + 1]``."""
    parent = list(range(len(suffixes)))
    sets: list[list[int] | None] = [[s] for s in suffixes]
    out = []

    def find(t: int) -> int:
        while parent[t] != t:
            parent[t] = parent[parent[t]]
            t = parent[t]
        return t

    def seed(i: int, j: int, agree: int) -> None:
        p = j - i
        if p * (repeats - 1) <= agree and (i == 0 or ids[i - 1] != ids[j - 1]):
            out.append((i, agree + p, p))

    for t in sorted(range(len(lcp)), key=lcp.__getitem__, reverse=True):
        agree, a, b = lcp[t], find(t), find(t + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        parent[b], sets[b] = a, None
        if len(small) * 8 < len(large):
            places = [bisect_left(large, x) for x in small]
            for k, (x, at) in enumerate(zip(small, places, strict=True)):
                # neighbours in the united set: from the larger set, unless one of the smaller lies between
                if at and (not k or small[k - 1] < large[at - 1]):
                    seed(large[at - 1], x, agree)
                if at < len(large) and (k + 1 == len(small) or large[at] < small[k + 1]):
                    seed(x, large[at], agree)
            for x, at in zip(reversed(small), reversed(places), strict=True):
                large.insert(at, x)
        else:
            own = set(small)
            large.extend(small)
            large.sort()  # two ascending stretches: one merge
            for i, j in zip(large, large[1:], strict=False):
                if (i in own) != (j in own):
                    seed(i, j, agree)
    return out


def find_runs(docs: list[np.ndarray], least: int = LEAST, repeats: int = REPEATS) -> list[Runs]:
    """Runs (start, length, period) of each sequence of word ids, by start, then period."""
    out: list[Runs] = [[] for _ in docs]
    sizes = np.array([len(d) for d in docs], np.int64)
    if not sizes.sum():
        return out
    floor = floor_lcp(least, repeats)
    begin = np.cumsum(sizes) - sizes
    wide = int(max(d.max() for d in docs if len(d))) + 1
    # ids of different texts differ, so nothing agrees across texts
    ids = np.concatenate([d.astype(np.int64) + k * wide for k, d in enumerate(docs)])
    levels, suffixes = _rank(ids, floor)
    if len(suffixes) < 2:
        return out
    lcp = _common(levels, suffixes[:-1], suffixes[1:])
    del levels
    held = lcp >= floor
    edges = np.flatnonzero(held)
    # classes that some edge joins, closed up
    used = np.zeros(len(suffixes), bool)
    used[edges] = used[edges + 1] = True
    at = np.cumsum(used) - 1
    weight = np.full(max(int(used.sum()) - 1, 0), -1, np.int64)
    weight[at[edges]] = lcp[edges]
    chains = np.flatnonzero(weight < 0) + 1
    places, plain = suffixes[used].tolist(), ids.tolist()
    bounds = [0, *chains.tolist(), len(places)]
    weight = weight.tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        for start, length, period in _seeds(places[lo:hi], weight[lo : hi - 1], plain, repeats):
            if length >= least and length >= repeats * period:
                k = int(np.searchsorted(begin, start, side="right")) - 1
                out[k].append((start - int(begin[k]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def strongest(runs: Runs) -> tuple[int, int, int] | None:
    """The run that repeats most; of equals the first, then that of the smallest period."""
    best = None
    for run in runs:
        if best is None:
            best = run
            continue
        more = run[1] * best[2] - best[1] * run[2]
        if more > 0 or (more == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def kept_words(runs: Runs, n: int) -> np.ndarray | None:
    """Mask of the words that stay: a run keeps its first period. None where all stay."""
    if not runs:
        return None
    start, length, period = np.array(runs, np.int64).T
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:n]) == 0


def _numbered(found: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))


def _suspects(sizes: list[int], word_hashes: np.ndarray, floor: int) -> np.ndarray:
    """Of texts laid end to end, those in which a window of ``floor`` words may occur twice."""
    if len(word_hashes) < floor:
        return np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    hit = windows(word_hashes, floor)
    inside = owner[: len(hit)] == owner[floor - 1 :]
    owner, hit = owner[: len(hit)][inside], hit[inside]
    # low bits give way to the text's number: a text that only seems to repeat is ranked in vain
    bits = np.uint64(max(int(len(sizes)).bit_length(), 1))
    key = np.sort((hit >> bits) << bits | owner.astype(np.uint64)) if len(hit) else hit
    again = key[1:][key[1:] == key[:-1]]
    return np.unique((again & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))


def periodic_runs(docs: DataFrame, reading: Reading | None = None, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Per row: the number of runs, the strongest, all runs by start and period, and the text without repeats.

    ``reading`` may order a text's words anew before they are judged. ``collapsed`` holds the
    words that no run covers beyond its first period, joined by one space. Without runs
    ``start``, ``length``, ``period`` and ``exponent_milli`` (1000 times length by period, rounded
    down) are NULL and the lists are empty.
    """
    floor = floor_lcp(least, repeats)

    def judged(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        runs: list[Runs] = [[] for _ in held]
        sizes = [len(w) for _, w in held]
        for group in _groups(_suspects(sizes, hashes([w for _, ws in held for w in ws]), floor), sizes):
            for k, found in zip(group, find_runs([_numbered(held[k][1]) for k in group], least, repeats), strict=True):
                runs[k] = found
        columns: list[list] = [[] for _ in range(10)]
        for (doc_id, found), own in zip(held, runs, strict=True):
            stays = kept_words(own, len(found))
            rest = found if stays is None else compress(found, stays.tolist())
            s, n, p = strongest(own) or (None, None, None)
            row = (doc_id, len(own), s, n, p, None if p is None else 1000 * n // p, *([r[i] for r in own] for i in range(3)), b" ".join(rest))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 3
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(columns[-1], pa.binary()).cast(pa.string())],
            names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "starts", "lengths", "periods", "collapsed"],
        )

    def each(batch: pa.RecordBatch):
        held, size = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            found = words(text)
            order = reading(doc_id, len(found)) if reading else None
            held.append((doc_id, found if order is None else list(map(found.__getitem__, order.tolist()))))
            size += len(found)
            if size >= GROUP_WORDS:
                yield judged(held)
                held, size = [], 0
        if held:
            yield judged(held)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), each, OUT)


def _groups(chosen: np.ndarray, sizes: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    size = 0
    for k in chosen.tolist():
        if not out or size + sizes[k] > GROUP_WORDS:
            out.append([])
            size = 0
        out[-1].append(k)
        size += sizes[k]
    return out


def digest(runs: DataFrame) -> DataFrame:
    """``periodic_runs`` with its lists and texts as SHA-256 digests of their lines and words."""
    line = F.transform(
        F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n"))
    )
    listed = F.concat_ws("", line).cast("binary")
    return runs.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

