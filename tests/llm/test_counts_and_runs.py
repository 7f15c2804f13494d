"""Token counts against the library, periodic runs against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltmark.llm import periodic_runs, token_counts, tokens
from siltmark.llm.queries import QUERIES, tokenizer

SCHEMA = "doc_id long, text string, lang string, counts binary, start long, n_runs int"
PHRASE = " ".join(f"p{i}" for i in range(11))
ROWS = [
    (1, "plain words, with  blanks\nand lines. " * 9), (2, ""), (3, None), (None, "no id <|endoftext|> here"), (None, None), (4, "same"), (4, "same"),
    (5, "x" * 300_000), (6, "the " * 30_000), (7, " " * 40_000 + "z"), (8, "Ünï çødé 中文 é İ  end"), (9, (PHRASE + " ") * 5 + "tail " + PHRASE),
    (10, "a b " * 12), (11, "a b " * 11 + "a"), (12, "\n\n a\t"), (13, " ".join(f"w{i % 400}" for i in range(1500))), (50, PHRASE + " end"), (26, "q r s " * 40),
]


def _docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", b"clash", -1, 9) for i, t in rows], SCHEMA)


def _by_row(rows):
    return sorted(tuple((v is not None, v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def _counted(rows, ids):
    return [(i, len((t or "").encode()), n := len(ids(t or "")), n > 1024) for i, t in rows]


@pytest.mark.parametrize("frequent", [1, 3, 65_536])
def test_counts_equal_library(spark, library, frequent):
    got = token_counts.token_counts(_docs(spark), tokenizer("byte_bpe_50k.json"), frequent=frequent)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = _counted(ROWS, lambda t: library.encode(t, add_special_tokens=False).ids)
    assert _by_row(map(tuple, got.collect())) == _by_row(want)
    assert token_counts.token_counts(_docs(spark, []), tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_other_vocabularies(spark, name):
    path = tokenizer(name)
    rows = [(i, t) for i, t in ROWS if len(t or "") < 200_000]
    if name.endswith(".model"):
        import sentencepiece

        ids = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(path)
        ids = lambda t: words.encode(t, add_special_tokens=False).ids
    assert _by_row(map(tuple, token_counts.token_counts(_docs(spark, rows), path).collect())) == _by_row(_counted(rows, ids))


def test_counts_over_the_whole_table(spark, library):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in rows}


def test_counter_at_segment_ends(library, monkeypatch):
    """Short segments and a full cache, so that cuts fall everywhere and entries come and go."""
    monkeypatch.setattr(token_counts, "SEGMENT", 20)
    monkeypatch.setattr(token_counts, "CACHE", 5)
    encoder = token_counts.token_counter("x.json", tokens.read_definition(tokenizer("byte_bpe_50k.json")))
    counter = token_counts.PieceCounter(encoder, ("a the", np.array([1, 1], np.uint16)))

    @settings(max_examples=500, deadline=None)
    @given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "é", "'s", "12", ".", "<|endoftext|>", "中", "\t", "word"]), max_size=60).map("".join))
    def same(text):
        want = library.encode(text, add_special_tokens=False).ids
        assert counter(text) == len(want) and encoder.ids(text) == want

    same()


def test_summary_keeps_what_is_frequent():
    from collections import Counter

    rng, counts, true = random.Random(2), Counter(), Counter()
    for _ in range(200):
        some = [f"k{min(int(rng.paretovariate(1)), 5000)}" for _ in range(200)]
        true.update(some)
        counts = token_counts.pruned(counts + Counter(some), 50)
    total = sum(true.values())
    assert len(counts) <= 50 and all(true[k] - total / 50 <= counts[k] <= true[k] for k in true)


def brute_runs(values, least=24, repeats=3):
    """The definition, period by period."""
    found, n = {}, len(values)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and values[j] == values[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q) and (i, j - i + q) not in found:
                found[i, j - i + q] = q  # periods ascend: the smallest comes first
            i = max(j, i + 1)
    return sorted(((i, m, q) for (i, m), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=90), st.integers(0, 89), st.integers(1, 20)), min_size=1, max_size=4),
    st.sampled_from([(24, 3), (6, 3), (4, 2), (9, 4), (1, 2)]),
)
def test_runs_equal_definition(made, bounds):
    docs = [np.array([d[i] if i < a else d[a + (i - a) % p] for i in range(len(d))], np.int64) if len(d) > a + p else np.array(d, np.int64) for d, a, p in made]
    assert periodic_runs.find_runs(docs, *bounds) == [brute_runs(d.tolist(), *bounds) for d in docs]


def _judged(doc_id, text):
    found = (text or "").encode().split()
    n = len(found)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = [w if i < a else found[a + (i - a) % p] for i, w in enumerate(found)]
    runs = brute_runs(found)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(found) if i not in gone)).hexdigest(),
    )


def test_periodic_runs(spark):
    rows = [(i, t) for i, t in ROWS if i != 6] + [(6, "the " * 900)]
    made = periodic_runs.periodic_runs(_docs(spark, rows), periodic_runs.repeated_tail)
    got = list(map(tuple, periodic_runs.digest(made).collect()))
    assert _by_row(got) == _by_row([_judged(i, t) for i, t in rows])
    by = {r[0]: r for r in got}
    assert by[10][1:6] == (1, 0, 24, 2, 12000) and by[11][1] == 0 and by[9][1:6] == (1, 0, 55, 11, 5000)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if i and t)
    assert periodic_runs.periodic_runs(_docs(spark, [])).count() == 0
    long = periodic_runs.periodic_runs(_docs(spark, [(1, "the " * 300_000), (2, "x" * 2_000_000)])).collect()
    assert sorted((r.n_runs, r.length) for r in long if r.n_runs) == [(1, 300_000)]


def test_periodic_runs_over_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in rows if len(r.text or "") < 20_000}
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(rows)
    assert _by_row(r for r in got if r[0] in short) == _by_row(_judged(i, t) for i, t in short.items())


def test_runs_of_short_groups(monkeypatch):
    """Groups of few words give what one group gives."""
    texts = [np.arange(60) % p for p in (2, 5, 7, 61)] * 3
    whole = periodic_runs.find_runs(texts)
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 70)
    groups = periodic_runs._groups(np.arange(12), [60] * 12)
    assert len(groups) == 12 and [r for g in groups for r in periodic_runs.find_runs([texts[k] for k in g])] == whole
