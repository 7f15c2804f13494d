"""Token counts of whole texts by a two-tier lookup, without a shuffle of pre-tokens.

A byte-level vocabulary cuts a text before every single space between other characters, so a
text is a row of pieces: a pre-token, with any punctuation up to the next space. The first
tier is a table of the ``FREQUENT`` most frequent pieces and their numbers of tokens. It is
read off frequency summaries (Misra and Gries) that every task keeps over all of its texts and
that are merged in two levels; it travels as one string and one array of 16-bit lengths. What it
lacks goes to the second tier, a cache in each worker: pieces that the cache lacks, too, are
encoded together, and their ids are told apart by the spaces that the first ones hold. The
table decides how fast a piece is counted, never its count.

Texts with runs of white space, special strings or pieces over ``LONGEST`` characters take the
encoder for the stretch in question, as do other kinds of vocabularies (lower-casing ``.json``,
``.model``) for whole texts. A NULL or empty text has no bytes and no tokens. Every row of the table is
counted, whatever its id; an empty table gives no rows. Columns beside ``doc_id`` and ``text``
are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, worker_state
from siltmark.llm.tokens import RankEncoder, library_encoder, read_definition

LIMIT = 1024
FREQUENT = 65_536  # entries of the broadcast table and of every summary
CACHE = 180_000  # entries of a worker's cache; twice as many are held at most
LONGEST = 64  # characters of a piece that is summed up or kept
SEGMENT = 1 << 20  # characters of a text that are cut into pieces at a time
ENTRIES = 256  # of a summary in one row, so that no batch of rows is large
_CUT = re.compile(r"(?<=\S) (?=\S)")
SUMMARY = "slot int, pieces string, counts binary"


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in stretches of about ``size`` characters, cut before single spaces; all but the first start with one."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def pruned(counts: Counter, keep: int) -> Counter:
    """At most ``keep`` entries, all lowered by the largest count left out, as Misra and Gries have it."""
    if len(counts) <= keep:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(values, len(values) - keep - 1)[len(values) - keep - 1])
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def _rows(counts: Counter, slot: int) -> Iterator[pa.RecordBatch]:
    entries = list(counts.items())
    parts = [entries[i : i + ENTRIES] for i in range(0, len(entries), ENTRIES)]
    if parts:
        yield pa.RecordBatch.from_arrays(
            [pa.array([slot] * len(parts), pa.int32()), pa.array([" ".join(k for k, _ in p) for p in parts]),
             pa.array([np.array([n for _, n in p], "<i8").tobytes() for p in parts], pa.binary())],
            names=["slot", "pieces", "counts"],
        )


def _gathered(batch: pa.RecordBatch, counts: Counter) -> None:
    for pieces, numbers in zip(batch.column("pieces").to_pylist(), batch.column("counts").to_pylist(), strict=True):
        for piece, n in zip(pieces.split(" "), np.frombuffer(numbers, "<i8").tolist(), strict=True):
            counts[piece] += n


def frequent_pieces(docs: DataFrame, keep: int = FREQUENT) -> list[str]:
    """At most ``keep`` pieces of all texts, the most frequent first; each task, merger and the driver hold ``keep`` at most."""
    from pyspark import TaskContext

    slots = max(1, int(docs.rdd.getNumPartitions() ** 0.5))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for text in batch.column("text").slice(i, 256).to_pylist():
                    for part in segments(text or ""):
                        counts.update(part.split(" "))
                if len(counts) > 4 * keep:
                    counts = pruned(counts, keep)
        context = TaskContext.get()
        # an empty piece, a blank or a long one has no place in the table
        plain = Counter({k: n for k, n in counts.items() if n > 1 and len(k) <= LONGEST and k and not k[0].isspace() and not k[-1].isspace()})
        yield from _rows(pruned(plain, keep), (context.partitionId() if context else 0) % slots)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            _gathered(batch, counts)
            if len(counts) > 4 * keep:
                counts = pruned(counts, keep)
        yield from _rows(pruned(counts, keep), 0)

    parts = docs.select("text").mapInArrow(summed, SUMMARY)
    parts = parts.repartition(slots, "slot").mapInArrow(merged, SUMMARY)
    whole = parts.repartition(1).mapInArrow(merged, SUMMARY)
    counts: Counter = Counter()
    for row in whole.collect():  # ``keep`` entries
        for piece, n in zip(row["pieces"].split(" "), np.frombuffer(row["counts"], "<i8").tolist(), strict=True):
            counts[piece] = n
    return sorted(counts, key=lambda k: (-counts[k], k))


class _Tier(dict):
    """Lengths by piece; what it lacks is noted and counts 0."""

    def __init__(self, entries):
        super().__init__(entries)
        self.missed: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.missed.append(piece)
        return 0


class PieceCounter:
    """Numbers of tokens by the two tiers; ``packed`` is the broadcast table."""

    def __init__(self, encoder: RankEncoder, packed: tuple[str, np.ndarray]):
        pieces, lengths = packed
        self.encoder = encoder
        self.table = _Tier(zip(pieces.split(" "), lengths.tolist(), strict=True) if len(lengths) else ())
        self.cache: dict[str, int] = {}
        self.old: dict[str, int] = {}
        size = 1 + max([*encoder.library.get_vocab().values()])
        # a token that holds the space before a piece is its first, and no piece has a space inside
        self.leads = np.zeros(size, bool)
        self.leads[[i for k, i in encoder.library.get_vocab().items() if k.startswith("Ġ") and k not in encoder.special]] = True

    def lengths(self, pieces: list[str]) -> list[int]:
        """Numbers of tokens of plain pieces, each with the space before it."""
        if not pieces:
            return []
        leads = np.flatnonzero(self.leads[np.array(self.encoder.ranks(" " + " ".join(pieces)))])
        total = len(self.encoder.ranks(" " + pieces[-1]))
        ends = np.append(leads[1:], leads[-1] + total)
        return (ends - leads).tolist()

    def _missed(self, pieces: list[str]) -> int | None:
        """Tokens of pieces that the table lacks; None if one of them is not plain."""
        cache, old, new, total = self.cache, self.old, [], 0
        fresh = {}
        for piece in pieces:
            n = cache.get(piece)
            if n is None and piece not in fresh:
                if not piece or piece[0].isspace() or piece[-1].isspace():
                    return None
                n = old.get(piece)
                if n is not None:
                    cache[piece] = n
                elif len(piece) > LONGEST:
                    n = len(self.encoder.ids(" " + piece))
                else:
                    fresh[piece] = 0
            if n is None:
                new.append(piece)
            else:
                total += n
        if fresh:
            fresh = dict(zip(fresh, self.lengths(list(fresh)), strict=True))
            total += sum(map(fresh.__getitem__, new))
            if len(cache) + len(fresh) > CACHE:
                self.old, self.cache = cache, {}
            self.cache.update(fresh)
        return total

    def __call__(self, text: str) -> int:
        encoder = self.encoder
        if not text:
            return 0
        if encoder.cut and any(s in text for s in encoder.special):
            return len(encoder.ids(text))
        total = 0
        for k, part in enumerate(segments(text)):
            first, *pieces = part.split(" ")
            table = self.table
            table.missed = []
            found = sum(map(table.__getitem__, pieces))
            # the first piece of a text has no space before it, a later segment starts with one
            lead = (not k and (not first or first[0].isspace() or first[-1].isspace())) or (k and first)
            rest = None if lead else self._missed(table.missed)
            if rest is None:
                total += len(encoder.ids(part))
            else:
                total += found + rest + (len(encoder.ids(first)) if first else 0)
        return total


def token_counter(path: str, definition) -> Callable[[str, object], Callable[[str], int]]:
    """A worker's counter for the vocabulary at ``path``; two tiers where it is byte-level."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=definition)
        return lambda text: len(model.encode(text)) if text else 0
    encoder = library_encoder(definition)
    return encoder if isinstance(encoder, RankEncoder) else lambda text: len(encoder(text)) // 4


def read_vocabulary(path: str):
    if not path.endswith(".model"):
        return read_definition(path)
    with open(path, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: bytes of its UTF-8, tokens, whether more than ``limit``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    context = docs.sparkSession.sparkContext
    definition = read_vocabulary(tokenizer)
    made = token_counter(tokenizer, definition)
    source = context.broadcast(definition)  # the vocabulary file
    table = None
    if isinstance(made, RankEncoder):
        pieces = frequent_pieces(docs, frequent)
        lengths = PieceCounter(made, ("", np.empty(0, np.uint16))).lengths(pieces)
        table = context.broadcast((" ".join(pieces), np.array(lengths, np.uint16)))  # ``frequent`` pieces of ``LONGEST`` characters at most
    state = f"{tokenizer} {uuid.uuid4().hex}"

    def make():
        counter = token_counter(tokenizer, source.value)
        return PieceCounter(counter, table.value) if table else counter

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = worker_state("counts", dict)  # one counter at a time, whatever ran before
        if state not in held:
            held.clear()
            held[state] = make()
        counter = held[state]
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n_bytes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        n_tokens = [counter(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return arrow_map(docs, each, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
