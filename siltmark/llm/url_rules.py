"""URL verdicts by rules on host and path, looked up in one sorted array of digests.

A rule is (verdict, host, path). It fits a URL whose host is the rule's or a subdomain of it
and whose path starts with the rule's; of several the longest text ``host + path`` wins, then
the longer host. A URL can be hit only by (one of its host's suffixes, a prefix of its path
as long as some rule's path), so those few keys are hashed to 64 bits, searched for in the
sorted array that each worker maps into memory, and confirmed against the stored strings.

A NULL url, or one without ``://``, has an empty host and path; no rule fits it. URLs that no
rule fits get the default verdict, ``allow``. Repeated rows are judged alike.
"""

from __future__ import annotations

import mmap
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
MAX_BYTES = 512 << 20  # of the array that is broadcast; larger lists must be split by host
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, as SQL expressions."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_key(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode("utf-8", "surrogatepass")


@dataclass
class Digests:
    """One blob: n digests (uint64, ascending), n + 1 string offsets (uint64), n verdict bytes, the strings."""

    blob: bytes
    count: int
    path_sizes: tuple[int, ...]

    @staticmethod
    def build(rules) -> Digests:
        by_key = {rule_key(h.lower(), p): v for v, h, p in rules}
        rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in by_key.items())
        offsets = np.cumsum([0, *[len(k) for _, k, _ in rows]]).astype(np.uint64)
        blob = (
            np.array([d for d, _, _ in rows], np.uint64).tobytes() + offsets.tobytes()
            + bytes(v == "allow" for _, _, v in rows) + b"".join(k for _, k, _ in rows)
        )
        if len(blob) > MAX_BYTES:
            raise ValueError(f"the rules take {len(blob)} bytes, more than the {MAX_BYTES} that may be broadcast")
        return Digests(blob, len(rows), tuple(sorted({len(p) for _, _, p in rules})))


class Mapped:
    """The blob as a memory-mapped file of this worker, which has no name any more."""

    def __init__(self, source: Digests):
        n = source.count
        with tempfile.TemporaryFile() as f:
            f.write(source.blob or b"\0")
            f.flush()
            self.view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.digests = np.frombuffer(self.view, np.uint64, n)
        self.offsets = np.frombuffer(self.view, np.uint64, n + 1, 8 * n)
        self.allow = np.frombuffer(self.view, np.uint8, n, 16 * n + 8)
        self.text = 17 * n + 8

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Position of each key, -1 if it is not stored."""
        probe = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        out = np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.digests, probe)
        open_ = np.flatnonzero(at < len(self.digests))
        while len(open_):  # a digest that several strings share has neighbours
            same = open_[self.digests[at[open_]] == probe[open_]]
            for i in same:
                lo, hi = self.text + int(self.offsets[at[i]]), self.text + int(self.offsets[at[i] + 1])
                if self.view[lo:hi] == keys[i]:
                    out[i] = at[i]
            at[same] += 1
            open_ = same[(out[same] < 0) & (at[same] < len(self.digests))]
        return out


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page."""
    digests = Digests.build(rules)
    shared = pages.sparkSession.sparkContext.broadcast(digests)
    opened: list[Mapped] = []
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not opened:
            opened.append(Mapped(shared.value))
        index = opened[0]
        owner, keys, tails = [], [], []
        for i, (h, p) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
            for s in suffixes(h):
                for size in shared.value.path_sizes:
                    if size <= len(p):
                        owner.append(i)
                        keys.append(rule_key(s, p[:size]))
                        tails.append((len(s) + size, len(s), s + p[:size]))
        rule: list[str | None] = [None] * batch.num_rows
        verdict = [default] * batch.num_rows
        best = [(-1, -1)] * batch.num_rows
        at = index.find(keys)
        for j in np.flatnonzero(at >= 0):
            i = owner[j]
            if tails[j][:2] > best[i]:
                best[i], rule[i] = tails[j][:2], tails[j][2]
                verdict[i] = "allow" if index.allow[at[j]] else "block"
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
            names=["page_id", "host", "path", "rule", "verdict"],
        )

    return arrow_map(parts, each, "page_id long, host string, path string, rule string, verdict string")
