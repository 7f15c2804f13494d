"""What the text operators share: tables, shared-folder copies, words and their hashes.

A *document* is a row with ``doc_id`` and ``text``. Operators read only the columns they
name, so further columns, whatever they are called, do no harm. Where documents are joined
back, their key is ``(doc_id, text_key)``: rows equal in both are one document with several
rows, rows of one id with different texts are different documents, and a NULL id is an
ordinary id that sorts first. A NULL text has no words and no lines.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.session import ensure_checkpoint_dir

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


def stored(df: DataFrame, outlives: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends here, a lost executor costs nothing.

    Inside ``scratch`` the folder goes with the block, or with the block around it if it ``outlives`` this one.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    scopes = _SCRATCH[:-1] if outlives else _SCRATCH
    if scopes:
        scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose ``stored`` tables are removed when it ends. What it returns must be stored to outlive it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _SCRATCH.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def text_key() -> Column:
    """64-bit key of the text beside the id; NULL and empty text differ."""
    return F.xxhash64(F.col("text"), F.col("text").isNull())


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("text_key"), "text")


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8; NULL as empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hash of each token."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def word_hashes(text: bytes, piece: int = 1 << 19) -> np.ndarray:
    """``hashes(words(text))``; of a long text, the words of about ``piece`` bytes are held at a time."""
    parts, at = [], 0
    while at < len(text) or not parts:
        blank = _BLANK.search(text, at + piece)
        end = blank.start() if blank else len(text)
        parts.append(hashes(words(text[at:end])))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    values = (values ^ (values >> np.uint64(30))) * _MIX2
    values = (values ^ (values >> np.uint64(27))) * _MIX
    return values ^ (values >> np.uint64(31))


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive values; empty if there are fewer."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: hash of 2^k values from two hashes of 2^(k-1), overlapping for the rest
    width, cur = 1, values
    while width * 2 <= size:
        cur = mixed(cur[: len(cur) - width] * _MIX + cur[width:])
        width *= 2
    if width < size:
        gap = size - width
        cur = mixed(cur[: len(cur) - gap] * _MIX2 + cur[gap:] + np.uint64(size))
    return cur[:n]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def arrow_map(
    df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str, rows: int = 1024
) -> DataFrame:
    """``mapInArrow`` for functions of one batch of at most ``rows`` rows; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                out = each(batch.slice(i, rows))
                yield from ([out] if isinstance(out, pa.RecordBatch) else out)
        pa.default_memory_pool().release_unused()  # workers stay for other tasks

    return df.mapInArrow(run, schema)


def coverage(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean mask of the n positions covered by [s, s + width) for any start s."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


def rewrite_texts(docs: DataFrame, facts: DataFrame, key: Column, rewrite: Callable[[pa.RecordBatch], list[bytes | None]]) -> DataFrame:
    """``docs`` with new texts, other columns as they are whatever their names; ``n_chars``, if there, follows the text.

    ``facts`` has doc_id, text_key and what ``rewrite`` needs: it gets a batch with column ``text``
    and the facts (NULL where there are none) and returns the new texts.
    """
    names, extra = docs.columns, [c for c in facts.columns if c not in ("doc_id", "text_key")]
    at = names.index("text")
    left = docs.withColumns({"__llm_id": F.col("doc_id").cast("long"), "__llm_key": key})
    left = left.toDF(*[f"c{i}" for i in range(len(names))], "__llm_id", "__llm_key")
    joined = left.join(facts, left["__llm_id"].eqNullSafe(facts["doc_id"]) & (left["__llm_key"] == facts["text_key"]), "left")
    joined = joined.select(*left.columns[:-2], *[facts[c] for c in extra])
    schema = ", ".join(f"c{i} {f.dataType.simpleString() if f.dataType.typeName() != 'void' else 'string'}" for i, f in enumerate(docs.schema.fields))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        named = batch.rename_columns(["text" if i == at else c for i, c in enumerate(batch.schema.names)])
        columns = list(batch.columns[: len(names)])
        columns[at] = pa.array(rewrite(named), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(names)])

    out = arrow_map(joined, each, schema).toDF(*names)
    if "n_chars" in names and not isinstance(docs.schema["n_chars"].dataType, T.StringType):
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def worker_state(name: str, make: Callable):
    """One object per Python worker process, kept from task to task however the code travelled."""
    import sys

    held = sys.__dict__.setdefault("_siltmark_llm", {})
    if name not in held:
        held[name] = make()
    return held[name]
