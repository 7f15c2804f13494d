"""The prefix trie against one that rebuilds every conversation, and its parts against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.llm import conversation_trie as trie
from siltmark.llm.common import stored

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k int, head long"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def _base_and_head():
    conv = F.col("conv_id")
    return conv - conv % 5, F.crc32(conv.cast("string")) % 9


def _brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = trie.turn_map((role or "").encode(), (text or "").encode())
            signed = tuple(x - (1 << 64) if x >> 63 else x for x in key)
            turns[conv].append((turn is not None, turn or 0, signed, (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = sum(saved[x] for x in children[s]) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    out = []
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(s))))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def _got(spark, rows, **more):
    made = trie.prefix_trie(_table(spark, rows), *_base_and_head(), **more)
    assert made.columns == list(trie.TRIE)
    return sorted(map(tuple, made.collect()), key=lambda r: r[:2])


def _mixed_rows():
    rng, rows = random.Random(5), []
    for c in range(-6, 60):
        if c % 10 == 5:
            continue  # some bases are absent
        for t in range(rng.choice([1, 2, 4, 8, 14])):
            few = rng.random() < 0.8
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if few else f"own é {c} {t}"))
    rows += [(70, None, "user", "first"), (70, 3, None, None), (70, 3, "", ""), (70, 1, "user", None), (71, 1, "user", ""), (71, 1, "user", "")]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    return rows


def test_trie_equals_rebuilt(spark):
    rows = _mixed_rows()
    random.Random(1).shuffle(rows)
    want = _brute(rows)
    assert _got(spark, rows) == want
    assert any(r[3] > 5 for r in want) and any(r[4] > 1 and r[1] for r in want)


def test_copies_and_one_long_conversation(spark, monkeypatch):
    """A third of the rows are one conversation, a third are copies; small packs and batches."""
    monkeypatch.setattr(trie, "PACKED", 3)
    monkeypatch.setattr(trie, "ROWS", 17)
    rows = [(3, t, "user", f"word {t % 7} {'x' * (t % 3)}") for t in range(900)]
    rows += [(c, t, "user", f"copied {t}") for c in range(1000, 1300) for t in range(3)]
    rows += [(c, t, "user", f"copied {t}" if t < c % 6 else f"{c}") for c in range(2000, 2100) for t in range(9)]
    assert _got(spark, rows) == _brute(rows)


def test_nested_chains(spark):
    """Each conversation leaves the one before it a turn later, so chains hang from chains."""
    rows = [(5 * c, t, "user", f"common {t}" if t < c else f"{c} {t}") for c in range(1, 24) for t in range(26)]
    assert _got(spark, rows) == _brute(rows)


def test_empty_and_without_ids(spark):
    assert _got(spark, []) == []
    assert _got(spark, [(None, 1, "user", "x")]) == []


def test_long_texts(spark):
    rows = [(c, t, "user", "long " * 300_000 + str(c // 3)) for c in (0, 1, 2, 3) for t in (0, 1)]
    assert _got(spark, rows) == _brute(rows)


def test_equal_hashes_of_unlike_turns_are_noticed(spark, monkeypatch):
    rows = [(c, t, "user", f"{c} {t}") for c in range(4) for t in range(3)]
    real = trie.turn_map
    weak = lambda role, text, seed=0: real(b"", b"", 0) if seed == 0 else real(role, text, seed)
    monkeypatch.setattr(trie, "turn_map", weak)
    table = _table(spark, rows).select("conv_id", "turn", "role", "text")
    turns = [stored(trie.arrow_map(table, lambda b, s=s: trie._turns(b, s, False), "conv_id long, turn long, ta long, tb long, n_bytes long")) for s in (0, 1)]
    assert not trie.same_turns(table, turns[0], 0) and trie.same_turns(table, turns[1], 1)
    got = _got(spark, rows)
    monkeypatch.undo()
    assert got == _brute(rows)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_scan_over_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    conv = np.sort(rng.choice([1, 1, 1, 2, 5, 6, 7, 8, 9, 30], 500))
    rows = [(int(c), int(rng.integers(0, 40)), int(rng.integers(-(1 << 62), 1 << 62)) * 2 + 1, int(rng.integers(-(1 << 63), 1 << 63 - 1))) for c in conv]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        table = stored(spark.createDataFrame(rows, "conv_id long, turn long, a long, b long"))
        got = trie.scanned(table, ["turn", "a"], [("a", "b")], ["conv_id", "a", "b"]).orderBy("conv_id", "k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    state = {}
    for r in got:
        k, a, b = state.get(r.conv_id, (0, 1, 0))
        state[r.conv_id] = k, a, b = (k + 1, a * r.a % (1 << 64), (b * r.a + r.b) % (1 << 64))
        assert (r.k, r.a0 % (1 << 64), r.b0 % (1 << 64)) == (k, a, b)


def test_inverses():
    a = np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2) + np.uint64(1)
    assert (a * trie.inverse(a) == 1).all()
