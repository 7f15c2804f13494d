"""Prefix trie of rebuilt conversations, from composable fingerprints of turn sequences.

A conversation's turns are ordered by ``turn`` (NULL first, equal ones by their hashes). Each one is
rebuilt as the first turns of a base conversation and its own turns from there on. A
*node* is a distinct sequence of first turns of rebuilt conversations; those that start with
it are its members, and the member with the smallest id names it.

Every turn becomes an affine map ``x -> a x + b`` modulo 2^64, ``a`` odd, from 128 bits of its role
and text; a sequence of turns is the product of their maps. Products compose and have inverses,
so the fingerprint of any rebuilt prefix follows from three prefix products of stored turns,
``head * own_cut^-1 * own``, and no rebuilt text is ever made. Prefix products come from a range
partitioning by (conversation, turn): each task multiplies its rows, and what reaches over the
end of a partition is carried on from one row per partition, so a conversation that holds a
third of all turns is many tasks.

Equality is verified: all members of a group must have the same parent group and refer to
stored turns of one hash, and stored turns of one hash must have the same role and text. If any
do not, all is done again with other hashes.

The trie falls into chains: the nodes that one conversation names lie one below the other. Sums
over subtrees are sums along a chain, by the same scan, plus the totals of the chains attached
to it; those come by pointer doubling over the chains, in as many rounds as the
logarithm of their nesting. Ids of the conversations that end at a node are hashed as a stream,
packed in sorted order by many tasks first.

NULL role or text is empty. Rows without ``conv_id`` belong to no conversation and are left out. A
row that repeats is a turn that repeats. An empty table gives no rows. Columns beside
``conv_id``, ``turn``, ``role`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, scratch, signed, stored

ROWS = 1 << 16  # of a batch of numbers
PACKED = 512  # ids in one row on their way to a hash
MOST_HEAD = 8
_NUMBERS = "conv_id long, depth long, fa long, fb long, ga long, gb long, ta long, tb long, n_bytes long, ends boolean"
TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_map(role: bytes, text: bytes, seed: int = 0) -> tuple[int, int]:
    """The affine map (a, b) of a turn; a is odd."""
    h = xxhash.xxh3_128_intdigest(len(role).to_bytes(8, "little") + role + text, seed)
    return (h & (1 << 64) - 1) | 1, h >> 64


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverses of odd numbers modulo 2^64: each step of Newton doubles the right bits."""
    x = a * np.uint64(3) ^ np.uint64(2)
    for _ in range(4):
        x = x * (np.uint64(2) - a * x)
    return x


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def _turns(batch: pa.RecordBatch, seed: int, whole: bool) -> pa.RecordBatch:
    role, text = ([x or b"" for x in batch.column(c).cast(pa.binary()).to_pylist()] for c in ("role", "text"))
    maps = np.array([turn_map(r, t, seed) for r, t in zip(role, text, strict=True)], np.uint64).reshape(-1, 2)
    names, columns = ["ta", "tb"], [pa.array(signed(np.ascontiguousarray(maps[:, i]))) for i in (0, 1)]
    if whole:
        return pa.RecordBatch.from_arrays([*columns, pa.array(role, pa.binary()), pa.array(text, pa.binary())], names=[*names, "role", "text"])
    columns += [pa.array([len(t) for t in text], pa.int64())]
    return pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *columns], names=["conv_id", "turn", *names, "n_bytes"])


def _compose(first: tuple[int, int], then: tuple[int, int]) -> tuple[int, int]:
    return first[0] * then[0] % (1 << 64), (first[1] * then[0] + then[1]) % (1 << 64)


class _Running:
    """Products along the rows of each conversation, batch after batch of rows in order."""

    def __init__(self, lanes: list[tuple[str, str]]):
        self.lanes, self.conv, self.count, self.products = lanes, None, 0, [(1, 0)] * len(lanes)

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
        opens = np.append(True, conv[1:] != conv[:-1])
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, len(conv)))
        goes_on = conv[0] == self.conv
        k = np.arange(1, len(conv) + 1) - np.repeat(start, size)
        k[: size[0]] += self.count if goes_on else 0
        out = []
        for lane, (a_name, b_name) in enumerate(self.lanes):
            a, b = _unsigned(batch, a_name), _unsigned(batch, b_name)
            pa_ = np.multiply.accumulate(a)
            pb = pa_ * np.cumsum(b * inverse(pa_), dtype=np.uint64)
            # from the start of each conversation on: what came before is divided out
            before = [np.repeat(np.append(np.uint64(u), p[start[1:] - 1]), size) for u, p in ((1, pa_), (0, pb))]
            qa = pa_ * inverse(before[0])
            qb = pb - before[1] * qa
            if goes_on:
                a0, b0 = (np.uint64(x) for x in self.products[lane])
                qb[: size[0]] += b0 * qa[: size[0]]
                qa[: size[0]] *= a0
            out.append((qa, qb))
            self.products[lane] = int(qa[-1]), int(qb[-1])
        self.conv, self.count = conv[-1], int(k[-1])
        return k, out


def scanned(rows: DataFrame, order: list, lanes: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """``keep`` columns of ``rows``, place ``k`` of each row in its conv_id by ``order``, and products ``a0, b0, a1, b1, ...`` up to it.

    ``rows`` is a written table. Rows equal in the order are told apart by number, so no key is too large for a partition.
    """
    spark = rows.sparkSession
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    names = [x for i in range(len(lanes)) for x in (f"a{i}", f"b{i}")]
    schema = f"{fields}, k long, {', '.join(f'{n} long' for n in names)}, part int, head long, tail boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, running, head, held = TaskContext.get(), _Running(lanes), None, None
        part = context.partitionId() if context else 0

        def made(batch: pa.RecordBatch, k: np.ndarray, products: list, last: bool) -> pa.RecordBatch:
            n = len(k)
            tail = np.zeros(n, bool)
            tail[-1] = last
            numbers = [pa.array(k)] + [pa.array(signed(x)) for lane in products for x in lane]
            own = [batch.column(c) for c in keep]
            flags = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, head, np.int64)), pa.array(tail)]
            return pa.RecordBatch.from_arrays([*own, *numbers, *flags], names=[*keep, "k", *names, "part", "head", "tail"])

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                piece = batch.slice(i, ROWS)
                if held:
                    yield made(*held, False)
                head = piece.column("conv_id")[0].as_py() if head is None else head
                held = (piece, *running(piece))
        if held:
            yield made(*held, True)

    by = ["conv_id", *order]
    dealt = rows.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(*by, "number").sortWithinPartitions(*by, "number")
    parts = stored(dealt.mapInArrow(run, schema))
    # one row per partition: what its last conversation brings to the next one
    tails = parts.where("tail").select("part", "head", "conv_id", "k", *names).orderBy("part").collect()
    carried: dict[int, tuple] = {}
    conv, count, products = None, 0, []
    for t in tails:
        own = [(t[f"a{i}"] % (1 << 64), t[f"b{i}"] % (1 << 64)) for i in range(len(lanes))]
        if t["head"] == conv:
            carried[t["part"]] = (conv, count, products)
        if t["head"] == conv == t["conv_id"]:
            count, products = count + t["k"], [_compose(p, q) for p, q in zip(products, own, strict=True)]
        else:
            conv, count, products = t["conv_id"], t["k"], own
    shared = spark.sparkContext.broadcast(carried)  # an entry per partition at most

    def carry(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "conv_id"))
        k = batch.column("k").to_numpy(zero_copy_only=False).copy()
        numbers = [_unsigned(batch, n).copy() for n in names]
        for part in np.unique(parts).tolist():
            if part not in shared.value:
                continue
            of, count, products = shared.value[part]
            at = np.flatnonzero((parts == part) & (conv == of))
            k[at] += count
            for i, (a0, b0) in enumerate(products):
                a, b = numbers[2 * i], numbers[2 * i + 1]
                b[at] += np.uint64(b0) * a[at]
                a[at] *= np.uint64(a0)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(k), *(pa.array(signed(x)) for x in numbers)], names=[*keep, "k", *names])

    return arrow_map(parts, carry, schema[: schema.index(", part int")], rows=ROWS)


def _rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Fingerprints of rebuilt prefixes and of their parents: head, less the own turns that it replaces, and own turns."""
    pa_, pb, ta, tb, ha, hb, oa, ob = (_unsigned(batch, c) for c in ("a0", "b0", "ta", "tb", "ha", "hb", "oa", "ob"))
    back = inverse(oa)
    fa = ha * back * pa_
    fb = (hb - ob) * back * pa_ + pb
    undo = inverse(ta)
    out = [fa, fb, fa * undo, (fb - tb) * undo, ta, tb]
    return pa.RecordBatch.from_arrays(
        [batch.column("conv_id"), batch.column("depth"), *(pa.array(signed(x)) for x in out), batch.column("n_bytes"), batch.column("ends")],
        names=[f.split(" ")[0] for f in _NUMBERS.split(", ")],
    )


def rebuilt_prefixes(prefixes: DataFrame, base: Column, head: Column, most_head: int) -> DataFrame:
    """A row per prefix of every rebuilt conversation, the empty one included."""
    first = F.struct("k", "a0", "b0", "ta", "tb", "n_bytes")
    facts = prefixes.groupBy("conv_id").agg(F.max("k").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= most_head, first))).alias("firsts"))
    facts = stored(facts.withColumns({"base": base, "h": head.cast("int")}))
    of = facts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("firsts").alias("heads"))
    joined = facts.join(of, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int"))
    cut = (F.col("h") > 0) & (F.col("n") > F.col("h"))

    def product(firsts: str, at: str, there: Column, name: str) -> Column:
        return F.when(there, F.get(firsts, F.col(at) - 1)[name]).otherwise(F.lit(1 if name == "a0" else 0)).cast("long")

    joined = stored(
        joined.select(
            "conv_id", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("long"),
            product("heads", "m", F.col("m") > 0, "a0").alias("ha"), product("heads", "m", F.col("m") > 0, "b0").alias("hb"),
            product("firsts", "h", cut, "a0").alias("oa"), product("firsts", "h", cut, "b0").alias("ob"),
            F.when(F.col("m") > 0, F.slice("heads", 1, F.greatest("m", F.lit(1)))).alias("heads"),
        )
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    root = F.array(F.struct(zero.alias("k"), one.alias("a0"), zero.alias("b0"), one.alias("ta"), zero.alias("tb"), zero.alias("n_bytes")))
    heads = joined.select("conv_id", "long", F.explode(F.concat(root, F.coalesce("heads", F.slice(root, 1, 0)))).alias("x"))
    heads = heads.select(
        "conv_id", F.col("x.k").alias("depth"), *[f"x.{c}" for c in ("a0", "b0", "ta", "tb", "n_bytes")],
        one.alias("ha"), zero.alias("hb"), one.alias("oa"), zero.alias("ob"), (F.col("x.k") == F.col("long")).alias("ends"),
    )
    own = prefixes.where(F.col("k") > head).join(joined.drop("heads"), "conv_id").withColumn("depth", F.col("m") + F.col("k") - F.col("h"))
    own = own.select(*[c for c in heads.columns if c != "ends"], (F.col("depth") == F.col("long")).alias("ends"))
    return arrow_map(heads.unionByName(own), _rebuild, _NUMBERS, rows=ROWS)


def same_turns(conversations: DataFrame, turns: DataFrame, seed: int) -> bool:
    """Whether all stored turns of one hash have the same role and text."""
    again = turns.groupBy("ta", "tb").count().where("count > 1").select("ta", "tb")
    whole = arrow_map(conversations, lambda b: _turns(b, seed, True), "ta long, tb long, role binary, text binary")
    turn = F.struct("role", "text")
    unlike = whole.join(again, ["ta", "tb"], "left_semi").groupBy("ta", "tb").agg(F.min(turn).alias("x"), F.max(turn).alias("y")).where("x != y")
    return unlike.isEmpty()


def _nodes(conversations: DataFrame, base: Column, head: Column, most_head: int) -> tuple[DataFrame, DataFrame]:
    """Verified groups of equal prefixes, and the prefixes at which conversations end."""
    seed = 0
    while True:
        turns = stored(arrow_map(conversations, lambda b, s=seed: _turns(b, s, False), "conv_id long, turn long, ta long, tb long, n_bytes long"))
        prefixes = scanned(turns, ["turn", "ta", "tb"], [("ta", "tb")], ["conv_id", "ta", "tb", "n_bytes"])
        rebuilt = stored(rebuilt_prefixes(prefixes, base, head, most_head))
        same = [f(c).alias(f"{c}_{name}") for c in ("ga", "gb", "ta", "tb", "n_bytes") for name, f in (("min", F.min), ("max", F.max))]
        nodes = stored(rebuilt.groupBy("depth", "fa", "fb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *same))
        mixed = F.lit(False)
        for c in ("ga", "gb", "ta", "tb", "n_bytes"):
            mixed = mixed | (F.col(f"{c}_min") != F.col(f"{c}_max"))
        if nodes.where(mixed).isEmpty() and same_turns(conversations, turns, seed):
            nodes = nodes.select("depth", "fa", "fb", "conv_id", "n_convs", F.col("ga_min").alias("ga"), F.col("gb_min").alias("gb"), F.col("n_bytes_min").alias("n_bytes"))
            return nodes, rebuilt.where("ends").select("conv_id", "depth", "fa", "fb")
        seed += 1


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved): sums over each chain and all below it. ``chains`` has conv_id, above (NULL at the top), leaves, saved."""
    left = stored(chains)
    while not left.where("above IS NOT NULL").isEmpty():
        gain = left.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = left.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        left = stored(
            left.join(gain, "conv_id", "left").join(up, "above", "left").select(
                "conv_id", F.col("next").alias("above"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            )
        )
    return left.drop("above")


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "member")), strict=True)
        rows: list[tuple] = []
        for (conv, depth), group in groupby(keys, lambda x: x[:2]):
            ids = [x[2] for x in group]
            rows += [(conv, depth, ids[i], ",".join(map(str, ids[i : i + PACKED]))) for i in range(0, len(ids), PACKED)]
        yield pa.RecordBatch.from_pydict(
            {n: pa.array([r[i] for r in rows], pa.string() if n == "ids" else pa.int64()) for i, n in enumerate(("conv_id", "depth", "first", "ids"))}
        )


def _stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        rows = [(*k, h) for k, h in done]
        done.clear()
        kinds = (("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string()))
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(kinds)})

    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if (conv, depth) == key:
                digest.update(b",")
            else:
                if key:
                    done.append((key, digest.hexdigest()))
                key, digest = (conv, depth), hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield out()
    if key:
        done.append((key, digest.hexdigest()))
        yield out()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from a written table (conv_id, depth, member): SHA-256 of the members' ids in ascending order."""
    packs = ends.repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    packs = packs.mapInArrow(_packs, "conv_id long, depth long, first long, ids string")
    return packs.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_stream_hash, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, base: Column, head: Column, most_head: int = MOST_HEAD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``base`` and ``head`` are expressions of ``conv_id``: whose first turns a conversation takes, and
    how many, ``most_head`` at most (all that there are if fewer, none if the base has no turns).
    ``saved_tokens`` sums, over a node's subtree, the members but one times the bytes of the last text.
    """
    conversations = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    ).where("conv_id IS NOT NULL")
    with scratch(conversations.sparkSession):
        return stored(_trie(conversations, base, head, most_head), outlives=True)


def _trie(conversations: DataFrame, base: Column, head: Column, most_head: int) -> DataFrame:
    nodes, ending = _nodes(conversations, base, head, most_head)

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("ga"), F.col("fb").alias("gb"), F.col("conv_id").alias("parent_conv_id"))
    linked = stored(nodes.join(parents, ["depth", "ga", "gb"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_bytes"))
    children = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    cells = linked.join(children, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saving"),
    )
    cells = stored(cells.withColumn("leaf", (F.col("n_children") == 0).cast("long")))

    top = F.col("parent_conv_id") != F.col("conv_id")  # NULL at the root
    chains = cells.groupBy("conv_id").agg(
        F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"),
        F.max(F.when(top, F.col("parent_conv_id"))).alias("above"), F.max(F.when(top, F.col("depth") - 1)).alias("at"),
    )
    chains = stored(chains)
    totals = chain_totals(chains.select("conv_id", "above", "leaves", "saved"))
    attached = chains.where("above IS NOT NULL").join(totals.withColumnsRenamed({"leaves": "all_leaves", "saved": "all_saved"}), "conv_id")
    attached = attached.groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("all_leaves").alias("more_leaves"), F.sum("all_saved").alias("more_saved"))
    one = F.lit(1).cast("long")
    worth = cells.join(attached, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", one.alias("one"),
        (F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saving") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
    )
    keep = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "leaves", "saved"]
    sums = scanned(stored(worth), ["depth"], [("one", "leaves"), ("one", "saved")], keep)
    # what a chain holds in all, less what lies above the node on it
    totals = totals.withColumnsRenamed({"leaves": "all_leaves", "saved": "all_saved"})
    sums = sums.join(totals, "conv_id").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("all_leaves") - F.col("b0") + F.col("leaves")).alias("n_leaves"), (F.col("all_saved") - F.col("b1") + F.col("saved")).alias("saved_tokens"),
    )

    named = nodes.select("depth", "fa", "fb", F.col("conv_id").alias("owner"))
    ends = ending.withColumnRenamed("conv_id", "member").join(named, ["depth", "fa", "fb"]).select(F.col("owner").alias("conv_id"), "depth", "member")
    nobody = hashlib.sha256().hexdigest()
    out = sums.join(end_hashes(stored(ends)), ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nobody))).select(*TRIE)
