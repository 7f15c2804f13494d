"""Byte-pair encoding as a deterministic automaton over token arcs.

Compiling goes through the merges in order. The automaton starts as one state with an arc for
each byte. The gadget of merge ``(u, v)`` at rank r splits the state that ``u`` leads to, takes
arc ``v`` away from the part that ``u`` reaches, and adds the arc ``uv`` from wherever ``u`` left
to wherever ``v`` led. So the state after a token is that of its right part as it was at rank r,
and an arc leaves a state only where its left part did at rank r. Both histories are chains of
(token, rank at which it went into a larger one), kept in tables; the transition
``(state, arc)`` is read from them once and then from a bounded table.

A word is encoded by running the automaton over its bytes: from each position the arcs that
spell the next bytes are followed if the state has them. Exactly one path ends at each
position, because a byte string has one encoding. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, worker_state
from siltmark.llm.tokens import ByteEncoder, Memo, byte_alphabet, read_definition, special_ids

NEVER = 1 << 60
TRANSITIONS = 200_000


@dataclass
class Merges:
    """Labels by id (bytes; None for ids that no path emits), merges in order as (left, right, new), special tokens."""

    labels: list[bytes | None]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]

    @staticmethod
    def read(path: str) -> Merges:
        definition = json.loads(read_definition(path))
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = definition["model"]["vocab"]
        special = special_ids(definition)
        labels: list[bytes | None] = [None] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            labels[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            labels[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in definition["model"]["merges"]]
        return Merges(labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], special)


class Automaton:
    def __init__(self, source: Merges):
        size = len(source.labels)
        self.labels = source.labels
        self.rank: dict[int, int] = {}  # merge (u, v) -> rank
        self.after: list[tuple] = [()] * size  # chain that ends a token: state reached by its arc
        self.before: list[tuple] = [()] * size  # chain that begins it: states its arc leaves from
        self.table = Memo(self._has_arc, TRANSITIONS)
        made = {new for _, _, new in source.merges}
        for i, label in enumerate(source.labels):
            if label is not None and len(label) == 1 and i not in made:
                self.after[i] = self.before[i] = ((i, NEVER),)
        arcs = [i for i in range(size) if self.after[i]]
        for r, (u, v, new) in enumerate(source.merges):
            if self.after[new] or not self.after[u] or not self.after[v]:
                raise ValueError(f"merge {r} makes a token twice or before its parts")
            reachable = self._path(u, v)  # else no path spells it: the arc is never added
            self.rank[u << 32 | v] = r
            self.after[new] = (*((t, min(e, r)) for t, e in self.after[v]), (new, NEVER))
            self.before[new] = (*((t, min(e, r)) for t, e in self.before[u]), (new, NEVER))
            if reachable:
                arcs.append(new)
        self._spell(arcs)

    def _path(self, u: int, v: int) -> bool:
        """Whether arc v leaves the state after u, by the merges compiled so far."""
        left, right = self.after[u], self.before[v]
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = left[i], right[j]
            r = self.rank.get(a << 32 | b)
            if r is not None and r < a_end and r <= b_end:  # of equal ranks the left pair merges first
                return False
            if a_end <= b_end:
                i += 1
                if i == len(left):
                    return True
            else:
                j += 1

    def _has_arc(self, key: int) -> bool:
        return self._path(key >> 32, key & 0xFFFFFFFF)

    def _spell(self, arcs: list[int]) -> None:
        """The arcs' labels as one table (node, byte) -> node, and the arc that ends at a node."""
        self.goto: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for arc in arcs:
            node = 0
            for b in self.labels[arc]:
                key = node << 8 | b
                node = self.goto.get(key) or self.goto.setdefault(key, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = arc

    def encode(self, word: bytes) -> list[int]:
        n = len(word)
        state, back = [-1] * (n + 1), [0] * (n + 1)
        goto, ends, table = self.goto.get, self.ends, self.table
        for i in range(n):
            here, node = state[i] << 32, 0
            for j in range(i, n):
                node = goto(node << 8 | word[j])
                if node is None:
                    break
                arc = ends[node]
                if arc >= 0 and (not i or table[here | arc]):
                    state[j + 1], back[j + 1] = arc, i
        path = []
        while n:
            path.append(state[n])
            n = back[n]
        return path[::-1]

    def encoder(self) -> ByteEncoder:
        return ByteEncoder(lambda w: self.encode(w.encode()), {})


def _encoder(merges: Merges) -> ByteEncoder:
    machine = Automaton(merges)
    return ByteEncoder(lambda w: machine.encode(w.encode()), merges.special)


def _encoded(batch: pa.RecordBatch, machine: ByteEncoder) -> list[bytes]:
    return [machine(t or "") for t in batch.column("text").to_pylist()]


def _decoded(ids: list[bytes], labels: list[bytes | None]) -> list[str]:
    label = labels.__getitem__
    return [b"".join(map(label, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in ids]


def _run(docs: DataFrame, tokenizer: str, decoded: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Merges.read(tokenizer))  # bounded by the vocabulary

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _encoded(batch, worker_state(f"bpe {tokenizer}", lambda: _encoder(shared.value)))
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()), "ids": pa.array(found, pa.binary())}
        if decoded:
            columns["decoded"] = pa.array(_decoded(found, shared.value.labels), pa.string())
        return pa.RecordBatch.from_pydict(columns)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, one row per row of ``docs``."""
    return _run(docs, tokenizer, False)


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """What ``encode`` returns with column ``decoded``, made from the ids by the same worker."""
    return _run(docs, tokenizer, True)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (column ids as ``encode`` writes it) with column ``decoded``: the arc labels of its ids, special tokens included."""
    shared = encoded.sparkSession.sparkContext.broadcast(Merges.read(tokenizer).labels)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = _decoded([x or b"" for x in batch.column("ids").to_pylist()], shared.value)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return arrow_map(encoded.select("doc_id", "n_tokens", "ids"), each, "doc_id long, n_tokens long, ids binary, decoded string")
