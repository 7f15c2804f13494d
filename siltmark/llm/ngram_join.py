"""Near-duplicate documents by a grouped prefix join on word shingles.

A document's set is the hashes of its distinct shingles of ``size`` lower-cased words. Two
documents link when 100 * |intersection| >= percent * |union|; classes are what links connect.

1. Shingles are ordered by a count sketch of fixed size, rare first, so passages that many
   documents share come last. A set's prefix is its first |set| - ceil(percent * |set|) + 1
   shingles: linked sets share one of them.
2. Equal sets are one node. Nodes with equal prefix and size are one group, and only groups are
   joined on the shingles of their prefixes.
3. Groups that share a shingle, and the members of a group, are first linked to a few leaders,
   so a family of n near copies takes a few times n comparisons and falls into one class.
4. Then every pair of groups that share a prefix shingle and are not yet in one class is
   filtered by size, expanded to members of different classes, filtered by the overlap that
   the prefixes still allow, and verified on the whole sets. Links inside a class cannot change
   it, so no class is missed.
5. A shingle that ``CROWD`` or more nodes of several classes share would give pairs by the square.
   Its nodes lie in blocks of about ``BLOCK_NODES`` nodes, and pairs of blocks that share such a
   shingle are compared as whole blocks, on all members, by a matrix product. Only links that
   join classes leave a task, so rows grow with the pairs of blocks.

Shingles and sets are told apart by 64-bit hashes. Texts with fewer words than a shingle have
one shingle, the whole sequence; NULL texts and texts without words have none and link with
nothing. Repeated rows and equal sets share a class. A class id is the smallest doc_id in it;
NULL ids are passed over, and stay NULL where a class has no other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, keyed, scratch, stored, text_key, texts, windows, word_hashes
from siltmark.llm.components import components

COUNTERS = 1 << 22  # of the order's sketch: 16 MB, whatever the corpus
BLOCK = 1 << 18
FILTER_BITS = 1 << 24  # of the filter of nodes whose sets are kept: 2 MB
FILTER_BLOCKS = 64
SUMS = 32  # tasks that add up blocks, of which there is a fixed number
LEADERS = 8
CROWD = 64
BLOCK_NODES = 64
BLOCK_TOKENS = 1 << 14


def shingles(text: bytes, size: int) -> np.ndarray:
    h = word_hashes(text.lower())
    return np.unique(windows(h, min(size, len(h)))) if len(h) else h


def smallest_overlap(a, b, percent: int):
    """Least intersection at which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def _summed(df: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Rows (block, compressed data) added up per block (or'ed for bits), on the executors; the result has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), np.uint8)
                old = held.get(block)
                if kind == "bits":
                    held[block] = part if old is None else old | part
                else:
                    held[block] = part.astype(np.uint32) if old is None else old + part
        yield _blocks(held)

    rows = df.repartition(SUMS, "block").mapInArrow(run, "block int, data binary").collect()
    return {r["block"]: np.frombuffer(zlib.decompress(r["data"]), np.uint8 if kind == "bits" else np.uint32) for r in rows}


def _blocks(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    data = pa.array([zlib.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())
    return pa.RecordBatch.from_pydict({"block": pa.array(list(parts), pa.int32()), "data": data})


def count_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents hold a shingle, by the shingle's hash modulo ``COUNTERS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            found = texts(batch)
            for i in range(0, len(found), 256):
                flat = np.concatenate([shingles(t, size) for t in found[i : i + 256]])
                np.add.at(total, (flat % np.uint64(COUNTERS)).astype(np.int64), np.uint32(1))
        # a task's counts stop at 255: enough to tell frequent from rare, and any fixed order is a right one
        yield _blocks(dict(enumerate(np.minimum(total, 255, out=total).astype(np.uint8).reshape(-1, BLOCK))))

    out = np.zeros(COUNTERS, np.uint32).reshape(-1, BLOCK)
    for block, data in _summed(docs.select("text").mapInArrow(run, "block int, data binary"), "counts").items():
        out[block] = data
    return out.ravel()


def _order(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return np.lexsort((tokens, sketch[(tokens % np.uint64(COUNTERS)).astype(np.int64)]))


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def prefixes(docs: DataFrame, size: int, percent: int, order) -> DataFrame:
    """(doc_id, text_key, n, node, grp, prefix) of every row; node names the set, grp its size and prefix."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, node, group, first = [], [], [], []
        for text in texts(batch):
            found = shingles(text, size)
            head = found[_order(found, order.value)[: prefix_size(len(found), percent)]] if len(found) else found
            n.append(len(found))
            node.append(node_of(found))
            group.append(xxhash.xxh3_64_intdigest(head.tobytes(), seed=len(found)) - (1 << 63))
            first.append(head.view(np.int64))
        flat = np.concatenate(first)
        ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(group, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))],
            names=["doc_id", "text_key", "n", "node", "grp", "prefix"],
        )

    return arrow_map(keyed(docs), each, "doc_id long, text_key long, n long, node long, grp long, prefix array<long>")


def _filter_bits(nodes: np.ndarray) -> np.ndarray:
    x = nodes.view(np.uint64)
    return np.concatenate([x % np.uint64(FILTER_BITS), (x >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(FILTER_BITS)]).reshape(2, -1).astype(np.int64)


def node_filters(nodes: DataFrame) -> list[np.ndarray]:
    """For each column of nodes a packed Bloom filter of fixed size over it, all from one pass."""
    count, width = len(nodes.columns), FILTER_BITS // 8 // FILTER_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((count, FILTER_BITS // 8), np.uint8)
        for batch in batches:
            for own, column in zip(bits, batch.columns, strict=True):
                at = _filter_bits(column.to_numpy(zero_copy_only=False)).ravel()
                np.bitwise_or.at(own, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        packed = bits.reshape(-1, width)
        at = np.flatnonzero(packed.any(1))
        yield _blocks({int(i): packed[i] for i in at})

    out = np.zeros((count * FILTER_BLOCKS, width), np.uint8)
    for block, data in _summed(nodes.mapInArrow(run, "block int, data binary"), "bits").items():
        out[block] = data
    return list(out.reshape(count, -1))


def _passes(nodes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which nodes the packed filter lets through."""
    at = _filter_bits(nodes)
    return ((packed[at >> 3] >> (7 - (at & 7))) & 1).all(0)


def chosen(df: DataFrame, passing: np.ndarray, name: str = "node") -> DataFrame:
    """Rows of ``df`` whose node (or other named key) passes a filter of ``node_filters``."""
    wanted = df.sparkSession.sparkContext.broadcast(passing)  # FILTER_BITS bits

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_passes(batch.column(name).to_numpy(zero_copy_only=False), wanted.value)))

    return arrow_map(df, each, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))


def whole_sets(docs: DataFrame, size: int, places: DataFrame) -> DataFrame:
    """(node, tokens) of the documents at the given places (place: hash of id and text key), and a few others.

    Tokens are the upper 48 bits of the shingles' hashes, in order.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(*node_filters(places))  # FILTER_BITS bits

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.filter(pa.array(_passes(batch.column("place").to_numpy(zero_copy_only=False), wanted.value)))
        sets = [shingles(t, size) for t in texts(found)]
        return pa.RecordBatch.from_arrays(
            [pa.array([node_of(x) for x in sets], pa.int64()), pa.array([np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes() for x in sets], pa.binary())],
            names=["node", "tokens"],
        )

    return arrow_map(keyed(docs).select(place_of().alias("place"), "text"), each, "node long, tokens binary")


def place_of() -> Column:
    return F.xxhash64("doc_id", "text_key", F.lit("place"))


def _tokens(data: bytes | pa.Buffer) -> np.ndarray:
    found = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(found), 8), np.uint8)
    out[:, 2:] = found
    return out.view(np.uint64).ravel()


def _both(pairs: DataFrame, facts: DataFrame, *names: str) -> DataFrame:
    """``pairs`` (a, b) with the named facts of both nodes."""
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in names]), side)
    return pairs.select("a", "b", *[f"{n}_{s}" for s in ("a", "b") for n in names])


def _kept(batch: pa.RecordBatch, keep: list[bool]) -> pa.RecordBatch:
    mask = pa.array(keep, pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def likely(pairs: DataFrame, heads: DataFrame, percent: int, order) -> DataFrame:
    """The pairs (a, b) of nodes that their prefixes allow to link; ``heads`` has (node, n, prefix)."""

    def may(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for na, nb, pa_, pb in zip(*(batch.column(c) for c in ("n_a", "n_b", "prefix_a", "prefix_b")), strict=True):
            na, nb = na.as_py(), nb.as_py()
            x, y = (p.values.to_numpy().view(np.uint64) for p in (pa_, pb))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            last = np.array([x[-1], y[-1]])
            # the prefix that ends first holds all of its set up to there; what both may still share lies behind it
            rest = na - len(x) if _order(last, order.value)[0] == 0 else nb - len(y)
            keep.append(shared + rest >= smallest_overlap(na, nb, percent))
        return _kept(batch, keep)

    return arrow_map(_both(pairs, heads, "n", "prefix"), may, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, counted on the whole sets."""

    def do(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for ta, tb in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
            x, y = _tokens(ta.as_buffer()), _tokens(tb.as_buffer())
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        return _kept(batch, keep)

    left, right = (chosen(sets, f).toDF(s, f"tokens_{s}") for s, f in zip("ab", node_filters(pairs.select("a", "b")), strict=True))
    return arrow_map(pairs.join(right, "b").join(left, "a").select("a", "b", "tokens_a", "tokens_b"), do, "a long, b long").distinct()


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _near(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def to_leaders(rows: DataFrame, count: int, percent: int) -> DataFrame:
    """Pairs of nodes with leaders of their buckets that are not in their class, the ``count`` most frequent for each node."""
    pick = [F.min_by(F.struct("node", "n", "comp"), F.xxhash64("node", F.lit(r))) for r in range(count)]
    # leaders are picked where several classes meet (and where the filter errs), so other buckets send two numbers;
    # a join with the open buckets would put all rows of a bucket into one task
    span = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    rows = chosen(rows, *node_filters(span.where("low != high").select("bucket")), "bucket")
    leaders = rows.groupBy("bucket").agg(F.array_distinct(F.array(*pick)).alias("leaders"))
    met = rows.join(leaders, "bucket").select("node", "n", "comp", F.explode("leaders").alias("l"))
    met = met.where((F.col("comp") != F.col("l.comp")) & _near("n", "l.n", percent))
    met = met.groupBy("node", F.col("l.node").alias("leader")).count()
    best = F.slice(F.sort_array(F.collect_list(F.struct("count", "leader")), asc=False), 1, count)
    closest = met.groupBy("node").agg(best.alias("best")).select("node", F.explode("best").alias("x"))
    return closest.select(F.least("node", "x.leader").alias("a"), F.greatest("node", "x.leader").alias("b")).distinct()


def open_buckets(rows: DataFrame, members: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """((bucket, size) of buckets with nodes of several classes, (bucket, node, n, head, comp) of those with a crowd).

    Nodes are all members of the bucket's groups; a group of several is a bucket too.
    """
    inside = members.select("grp", F.col("node").alias("member"), F.col("n").alias("n_member"))
    every = rows.join(inside, "grp", "left").select("bucket", F.coalesce("member", "node").alias("node"), F.coalesce("n_member", "n").alias("n"), "head")
    every = _labelled(every.union(members.select("grp", "node", "n", F.lit(True))), labels)
    sizes = every.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
    sizes = stored(sizes.where("low != high").select("bucket", "size"))
    crowds = stored(every.join(sizes.where(F.col("size") >= CROWD), "bucket").select("bucket", "size", "node", "n", "head", "comp"))
    return sizes, crowds


def open_pairs(rows: DataFrame, members: DataFrame, labels: DataFrame | None, percent: int, sizes: DataFrame) -> DataFrame:
    """Every pair of nodes of different classes whose groups share a prefix shingle without a crowd, or that are of one such group.

    ``rows`` are (bucket, node, n, head, grp) with the group's leader as node, ``members`` (grp, node, n) of groups with several.
    """
    inside = _labelled(members, labels)
    span = inside.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    few = sizes.where(F.col("size") < CROWD).select("bucket")
    units = _labelled(rows.join(few, "bucket"), labels).join(span, "grp", "left")
    units = units.withColumns({"low": F.coalesce("low", "comp"), "high": F.coalesce("high", "comp")})
    x = units.select("bucket", *[F.col(c).alias(f"{c}_x") for c in ("grp", "node", "n", "low", "high", "head")])
    y = units.select("bucket", *[F.col(c).alias(f"{c}_y") for c in ("grp", "node", "n", "low", "high")])
    apart = (F.col("low_x") != F.col("high_x")) | (F.col("low_y") != F.col("high_y")) | (F.col("low_x") != F.col("low_y"))
    # the smaller set looks with the shorter part of its prefix
    ordered = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("grp_x") < F.col("grp_y")))
    met = x.join(y, "bucket").where(F.col("head_x") & ordered & (100 * F.col("n_x") >= percent * F.col("n_y")) & apart)
    met = met.select("grp_x", "node_x", "grp_y", "node_y").distinct()
    own = inside.join(few.withColumnRenamed("bucket", "grp"), "grp").select("grp", "node", "comp")

    def expand(pairs: DataFrame, side: str) -> DataFrame:
        """Members in place of a group; a group of one is its leader."""
        m = inside.select(F.col("grp").alias(f"grp_{side}"), F.col("node").alias("member"))
        return pairs.join(m, f"grp_{side}", "left").withColumn(f"node_{side}", F.coalesce("member", f"node_{side}")).drop("member")

    across = expand(expand(met, "x"), "y").select(F.col("node_x").alias("node"), F.col("node_y").alias("other"))
    across = _labelled(across, labels).withColumnsRenamed({"node": "a", "comp": "comp_a", "other": "node"})
    across = _labelled(across, labels).where("comp != comp_a").select("a", F.col("node").alias("b"))
    left, right = (own.select("grp", F.col("node").alias(s), F.col("comp").alias(f"comp_{s}")) for s in ("a", "b"))
    within = left.join(right, "grp").where("a < b and comp_a != comp_b").select("a", "b")
    return across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_blocks(crowds: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """((node, comp, block) of the nodes of crowds, (x, y) pairs of blocks that may hold links between classes).

    A node's family is the largest crowd it is in. Large classes of a family have blocks of their own,
    so blocks of one class need no comparison with each other.
    """
    nodes = crowds.groupBy("node").agg(F.max(F.struct("size", "bucket"))["bucket"].alias("family"), F.first("n").alias("n"), F.first("comp").alias("comp"))
    nodes = stored(nodes)
    classes_ = nodes.groupBy("family", "comp").agg(F.count("*").alias("nodes"), F.sum("n").alias("tokens"))
    classes_ = classes_.withColumn("own", F.when(F.col("nodes") >= BLOCK_NODES, F.col("comp")))
    parts = F.ceil(F.greatest(F.sum("nodes") / BLOCK_NODES, F.sum("tokens") / BLOCK_TOKENS))
    parts = classes_.groupBy("family", "own").agg(parts.alias("parts")).toDF("fam", "owner", "parts")
    shares = classes_.join(parts, F.col("family").eqNullSafe(F.col("fam")) & F.col("own").eqNullSafe(F.col("owner"))).select("family", "comp", "own", "parts")
    block = F.xxhash64("family", "own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts")))
    placed = stored(nodes.join(shares, ["family", "comp"]).select("node", "n", "comp", block.alias("block")))
    facts = placed.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    at = crowds.select("bucket", "node", "head").join(placed.select("node", "block"), "node").groupBy("bucket", "block").agg(F.max("head").alias("head"))
    at = at.join(facts, "block")
    names = ("block", "head", "low", "high", "least", "most")
    x, y = (at.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in names]) for s in ("x", "y"))
    apart = (F.col("low_x") != F.col("high_x")) | (F.col("low_y") != F.col("high_y")) | (F.col("low_x") != F.col("low_y"))
    sized = (100 * F.col("most_x") >= percent * F.col("least_y")) & (100 * F.col("most_y") >= percent * F.col("least_x"))
    met = x.join(y, "bucket").where((F.col("block_x") <= F.col("block_y")) & (F.col("head_x") | F.col("head_y")) & apart & sized)
    return placed.select("node", "comp", "block"), stored(met.select(F.col("block_x").alias("x"), F.col("block_y").alias("y")).distinct())


def joining_links(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) between nodes (node, comp, tokens) of two blocks, as many as join all classes that links connect."""
    xs, ys = ([(i, c, _tokens(t)) for i, c, t in {r[0]: r for r in side}.values()] for side in (left, right))
    found = [t for _, _, t in xs + ys]
    flat, at = np.unique(np.concatenate(found), return_inverse=True)
    ends = np.cumsum([0, *map(len, found)])
    common = np.zeros((len(xs), len(ys)), np.float32)
    step = 1 << 14
    for first in range(0, len(flat), step):  # a slice of the shingles at a time
        marks = np.zeros((len(found), step), np.float32)
        for i in range(len(found)):
            here = at[ends[i] : ends[i + 1]]
            lo, hi = np.searchsorted(here, (first, first + step))
            marks[i, here[lo:hi] - first] = 1
        common += marks[: len(xs)] @ marks[len(xs) :].T
    common = common.astype(np.int64)
    sizes = np.diff(ends)
    union = sizes[: len(xs), None] + sizes[None, len(xs) :] - common
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(100 * common >= percent * union), strict=True):
        p, q = top(xs[i][1]), top(ys[j][1])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((xs[i][0], ys[j][0]))
    return out


def verified_blocks(pairs: DataFrame, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join classes, from pairs (x, y) of blocks; ``placed`` has (node, comp, block)."""
    inside = placed.join(sets, "node").groupBy("block").agg(F.collect_list(F.struct("node", "comp", "tokens")).alias("nodes"))
    left, right = (inside.select(F.col("block").alias(s), F.col("nodes").alias(f"nodes_{s}")) for s in ("x", "y"))

    def do(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x, y in zip(batch.column("nodes_x"), batch.column("nodes_y"), strict=True):
            out += joining_links(*([(r["node"], r["comp"], r["tokens"]) for r in side.as_py()] for side in (x, y)), percent)
        ends = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends.T)), pa.array(np.maximum(*ends.T))], names=["a", "b"])

    return arrow_map(pairs.join(left, "x").join(right, "y").select("nodes_x", "nodes_y"), do, "a long, b long", rows=8).distinct()


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, n, comp) of every row of ``docs``: size of its set, and a name of its class if the set is not empty."""
    with scratch(docs.sparkSession):
        return stored(_classes(docs, size, percent), outlives=True)


def _classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    order = spark.sparkContext.broadcast(count_sketch(docs, size))  # COUNTERS numbers
    known = stored(prefixes(docs, size, percent, order))

    filled = known.where("n > 0")
    groups = stored(filled.groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("node").alias("node"), F.max("node").alias("last")))
    several = groups.where("node != last").select("grp")
    members = stored(filled.select("grp", "node", "n").distinct().join(several, "grp"))
    head = F.col("at") < F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent)) + 1
    spread = groups.select("grp", "n", F.posexplode("prefix").alias("at", "bucket")).select("bucket", "grp", head.alias("head"))
    common = spread.groupBy("bucket").count().where("count > 1").select("bucket")
    rows = stored(spread.join(common, "bucket").join(groups.select("grp", "node", "n"), "grp").select("bucket", "node", "n", "head", "grp"))

    buckets = rows.select("bucket", "node", "n").union(members.select(F.col("grp").alias("bucket"), "node", "n"))
    sharing = rows.groupBy("grp").count().select("grp", "count")
    heads = groups.join(sharing.union(several.withColumn("count", F.lit(1 << 30))).groupBy("grp").agg(F.max("count").alias("count")), "grp")
    heads = stored(heads.select("grp", "node", "n", "prefix", (5 * F.col("count") >= F.size("prefix")).alias("close")))
    others = members.join(heads.select("grp", "prefix", F.col("node").alias("leader")), "grp").where("node != leader").select("node", "n", "prefix")
    facts = heads.select("node", "n", "prefix").union(others)

    # sets of nodes that share a fifth of their prefix with others; a pair that needs more asks for more
    where = filled.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("node", "x.doc_id", "x.text_key")
    asked = heads.where("close").select("node").union(members.select("node")).distinct()
    sets = [stored(whole_sets(docs, size, where.join(asked, "node").select(place_of().alias("place"))))]
    links, labels = None, None

    def fetch(wanted: DataFrame) -> DataFrame:
        """All sets so far, with those of the wanted nodes."""
        missing = wanted.distinct().join(reduce(DataFrame.union, sets).select("node"), "node", "left_anti")
        if not missing.isEmpty():
            sets.append(stored(whole_sets(docs, size, where.join(missing, "node").select(place_of().alias("place")))))
        return reduce(DataFrame.union, sets)

    def compare(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs)
        near = chosen(facts, *node_filters(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
        pairs = stored(likely(pairs, near, percent, order))
        return stored(verified(pairs, fetch(pairs.select(F.explode(F.array("a", "b")).alias("node"))), percent))

    for leaders in (1, LEADERS):
        found = compare(to_leaders(_labelled(buckets, labels), leaders, percent))
        links = found if links is None else links.union(found)
        labels = components(links)
    sizes, crowds = open_buckets(rows, members, labels)
    links = links.union(compare(open_pairs(rows, members, labels, percent, sizes)))
    placed, block_pairs = open_blocks(crowds, percent)
    if not block_pairs.isEmpty():
        placed = placed.join(block_pairs.select(F.explode(F.array("x", "y")).alias("block")).distinct(), "block")
        links = links.union(stored(verified_blocks(block_pairs, placed, fetch(placed.select("node")), percent)))
    labels = components(links)

    return _labelled(known.select("doc_id", "text_key", "n", "node"), labels).select("doc_id", "text_key", "n", "comp")


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    named = classes(docs, size, percent)
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    # rows without shingles are classes of their own
    linked = named.where("n > 0").join(smallest, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of every class, and all rows without shingles; columns as they are."""
    names = docs.columns
    named = classes(docs, size, percent)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = named.where("n > 0").groupBy("comp").agg(F.min(place).alias("x")).select("x.doc_id", "x.text_key", F.lit(False).alias("empty"))
    bare = named.where("n = 0").select("doc_id", "text_key", F.lit(True).alias("empty")).distinct()
    keep = first.union(bare).toDF("__keep_id", "__keep_key", "__empty")
    left = docs.withColumns({"__llm_id": F.col("doc_id").cast("long"), "__llm_key": text_key()})
    left = left.toDF(*[f"c{i}" for i in range(len(names))], "__llm_id", "__llm_key")
    kept = left.join(keep, left["__llm_id"].eqNullSafe(keep["__keep_id"]) & (left["__llm_key"] == keep["__keep_key"]))
    # equal rows are copies of each other, unless they are empty
    kept = kept.withColumn("__tie", F.when(F.col("__empty"), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return kept.dropDuplicates(["__llm_id", "__llm_key", "__tie"]).select(*left.columns[:-2]).toDF(*names)
