"""Packing of documents into sequences of at most ``SIZE`` tokens, as few as can be found.

Documents become pieces; only documents longer than a sequence are cut, with a first piece
that holds the remainder. How pieces share sequences depends on their lengths alone, so the
plan is made from the histogram of lengths (``SIZE`` numbers, whatever the corpus): the
configuration linear program is solved by multiplicative weights, each step pricing lengths by
what they still lack and finding the best configuration by knapsack dynamic programming. Every
set of prices also bounds the number of sequences from below. The fractional plan is rounded, and
what that leaves, together with as much of the program's end as helps, goes where it fits best. Each
piece then finds its place from its rank among the pieces of its length: ranks come from counts of
salted buckets, so a length that many share is not one task, nor are the rows of one id.

NULL and empty texts are one piece that holds the end id. Repeated rows are packed as often as
they occur. An empty table gives no rows. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, stored, worker_state
from siltmark.llm.tokens import id_bytes, library_encoder, read_definition

SIZE = 1024
STEP = 0.5  # of a length's need that one configuration covers at a time
ETA = 0.5  # how fast a price falls with the share that is covered
TAILS = (0.98, 0.95, 0.9, 0.8, 0.6, 0.3, 0.0)  # shares of the program that are kept in turn
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    source = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer))  # the vocabulary file
    end = id_bytes([end_id])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = worker_state(f"ids {tokenizer}", lambda: library_encoder(source.value))
        rows: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = memoryview(encoder(text or "") + end)
            n = len(data) // 4
            first = n if n <= size else n % size or size
            begin, piece = 0, 0
            while begin < n:
                stop = first if not begin else begin + size
                for column, value in zip(rows, (doc_id, piece, begin, stop - begin, zlib.crc32(data[4 * begin : 4 * stop])), strict=True):
                    column.append(value)
                begin, piece = stop, piece + 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_configuration(price: np.ndarray, size: int) -> np.ndarray:
    """Counts per length of the most valuable sequence: unbounded knapsack by dynamic programming. price[0] is unused."""
    value = np.zeros(size + 1)
    pick = np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        options = price[1 : room + 1] + value[room - 1 :: -1][:room]
        best = int(options.argmax())
        if options[best] > value[room - 1]:
            value[room], pick[room] = options[best], best + 1
        else:
            value[room] = value[room - 1]
    counts = np.zeros(size + 1, np.int64)
    room = size
    while room > 0:
        if pick[room]:
            counts[pick[room]] += 1
            room -= int(pick[room])
        else:
            room -= 1
    return counts


def program(need: np.ndarray, size: int, step: float = STEP, eta: float = ETA) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(configurations and how often to use each, lower bound on the number of sequences) of the covering program.

    The program asks for the fewest sequences whose configurations cover every length's need. Each
    length has a weight that starts at the volume it brings and falls exponentially with the share of its
    need that is covered, so its price is its length times that factor. The configuration of the highest
    price is found by the knapsack, and used until one of its lengths gains ``step`` of its need or has
    all of it: at most lengths / step + lengths rounds. No configuration costs more than the best, so
    the price of all needs over that of the best configuration bounds any plan from below.
    """
    lengths = np.arange(size + 1)
    start = lengths * (1.0 + lengths / size)  # a long piece fits in fewer places than its volume in short ones
    rest = need.astype(float)
    bound = lower_bound(need, size)
    found: dict[bytes, list] = {}
    while True:
        open_ = rest > 1e-9 * need
        open_[0] = False
        if not open_.any():
            break
        covered = 1.0 - rest / np.maximum(need, 1)
        weight = np.where(need > 0, start * np.exp(-eta * covered), 0.0)
        price = np.where(open_, weight, 0.0)
        counts = best_configuration(price, size)
        bound = max(bound, float(need @ price) / float(counts @ price))
        used = counts > 0
        amount = float((np.minimum(rest[used], step * need[used]) / counts[used]).min())
        rest[used] = np.maximum(rest[used] - amount * counts[used], 0.0)
        found.setdefault(counts.tobytes(), [counts, 0.0])[1] += amount
    return [(counts, amount) for counts, amount in found.values()], bound


def lower_bound(need: np.ndarray, size: int) -> float:
    """No plan has fewer sequences: the volume, and prices under which no configuration costs more than one.

    Such are, for each k, shares of a sequence rounded down to k-ths where (k + 1) times the share is no whole number.
    """
    lengths = np.arange(size + 1)
    best = float(need @ lengths) / size
    for k in range(1, 12):
        price = np.where((k + 1) * lengths % size == 0, lengths / size, (k + 1) * lengths // size / k)
        best = max(best, float(need @ price))
    return best


def fullest(left: np.ndarray, room: int) -> np.ndarray:
    """Counts of what is left that fill ``room`` as far as they can, longest first: bounded subset sums as bits of numbers."""
    lengths = np.flatnonzero(left[: room + 1])
    mask, sums, before = (1 << (room + 1)) - 1, 1, []
    for length in lengths.tolist():
        before.append(sums)
        copies, power = min(int(left[length]), room // length), 1
        while copies:
            take = min(power, copies)
            sums |= sums << (take * length) & mask
            copies, power = copies - take, power * 2
    counts = np.zeros(len(left), np.int64)
    target = sums.bit_length() - 1
    for length, below in zip(reversed(lengths.tolist()), reversed(before), strict=True):
        times = min(int(left[length]), target // length)
        while not below >> (target - times * length) & 1:  # some number of copies leads to a sum of the shorter ones
            times -= 1
        counts[length] = times
        target -= times * length
    return counts


def plan(need: np.ndarray, size: int = SIZE) -> list[tuple[np.ndarray, int]]:
    """Integer plan: (counts per length, number of sequences), covering ``need`` exactly; never more sequences than best fit takes.

    Towards its end the program has few lengths left to combine, so that what it chose last is given up as
    far as that saves sequences, and those pieces go where they fit best.
    """
    need = need.astype(np.int64)
    whole = np.zeros(size + 1, np.int64)
    whole[size] = 1
    rest = need - need[size] * whole
    chosen, bound = program(rest, size)
    best, fewest = None, 0
    for share in (1.0,) + TAILS:
        out, left = rounded_plan(rest, chosen[: round(share * len(chosen))])
        for finish in (best_fit, fill_up):
            made = out + finish(left, size)
            number = sum(n for _, n in made)
            if best is None or number < fewest:
                best, fewest = made, number
        if fewest <= np.ceil(bound - 1e-6):
            break
    return ([(whole, int(need[size]))] if need[size] else []) + best


def rounded_plan(need: np.ndarray, chosen: list[tuple[np.ndarray, float]]) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """(configurations with whole numbers, needs that they leave): rounded down, then up by the largest remainders as far as the needs allow."""
    left, times = need.copy(), [int(amount + 1e-6) for _, amount in chosen]
    for (counts, _), n in zip(chosen, times, strict=True):
        left -= n * counts
    for i in sorted(range(len(chosen)), key=lambda i: times[i] - chosen[i][1]):
        if (left >= chosen[i][0]).all():
            left -= chosen[i][0]
            times[i] += 1
    return [(counts, n) for (counts, _), n in zip(chosen, times, strict=True) if n], left


def fill_up(need: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Sequences that take the longest piece there is and are filled as far as the others can; equal ones at once."""
    left, out = need.copy(), []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        counts = fullest(left, size - longest)
        left[longest] += 1
        counts[longest] += 1
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        out.append((counts, times))
        left -= times * counts
    return out


def best_fit(need: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Lengths from long to short, each into the open sequences with the least room that holds it; equal sequences as one."""
    open_: list[list] = []  # [room, counts, number of such sequences]
    for length in np.flatnonzero(need)[::-1]:
        todo = int(need[length])
        while todo:
            fits = [o for o in open_ if o[0] >= length and o[2]]
            if fits:
                room, counts, number = best = min(fits, key=lambda o: o[0])
            else:
                room, counts, number = size, np.zeros(size + 1, np.int64), todo
                best = None
            each = min(room // int(length), todo)
            times = min(number, todo // each)
            grown = counts.copy()
            grown[length] += each
            if best:
                best[2] -= times
            open_.append([room - each * int(length), grown, times])
            todo -= times * each
    return [(counts, number) for _, counts, number in open_ if number]


def places(chosen: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks: pieces of ``length`` from rank ``first`` on, ``per`` in each sequence from ``sequence`` on, at ``offset``."""
    rows, taken, sequence = [], {}, 0
    for counts, number in chosen:
        offset = 0
        for length in np.flatnonzero(counts)[::-1]:
            length, per = int(length), int(counts[length])
            rows.append((length, taken.get(length, 0), per, sequence, offset))
            taken[length] = taken.get(length, 0) + per * number
            offset += per * length
        sequence += number
    rows.sort()
    names = ("length", "first", "per", "sequence", "offset")
    return {n: np.array(c, np.int64) for n, c in zip(names, zip(*rows, strict=True), strict=True)}


def packed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (a written table of pieces, with a random number as salt) with sequence_id and offset."""
    spark = cut.sparkSession
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    histogram = cut.groupBy("length").count().collect()  # ``size`` rows at most
    if not histogram:
        return spark.createDataFrame([], out)
    need = np.zeros(size + 1, np.int64)
    for r in histogram:
        need[r["length"]] = r["count"]
    shared = spark.sparkContext.broadcast(places(plan(need, size)))  # bounded by the rounds, not by the corpus

    buckets = int(-(-need.max() // BUCKET_ROWS))
    salted = cut.withColumn("bucket", F.pmod("salt", F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["length", "bucket"])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value
        length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
        at = np.searchsorted(p["length"] << 44 | p["first"], length << 44 | rank, side="right") - 1
        seq, slot = np.divmod(rank - p["first"][at], p["per"][at])
        own = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.RecordBatch.from_arrays(
            [*own, pa.array(p["sequence"][at] + seq), pa.array(p["offset"][at] + slot * length)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )

    return arrow_map(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")), each, out)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    cut = pieces(docs, tokenizer, end_id, size).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    return packed(stored(cut), size)
