"""Whole texts to token ids by public vocabularies, one pre-split word at a time.

A text is cut at single spaces, the chunks into words by the vocabulary's own pattern, and
words are looked up in bounded memos, so that a worker encodes a word once. Ids travel as
little-endian unsigned 32-bit integers. Where a cut at a space could change the result
(runs of white space, text that is not in NFC, strings of special tokens) the text takes a
slower way with the same result. NULL and empty texts have no ids.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable

import regex

CHUNKS = 180_000  # entries of each memo; twice as many are held at most
PIECES = 180_000
WORD_CHUNKS = 300_000  # where no memo of words stands beside that of the chunks

# fixed values: pre-split patterns of the two vocabularies
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'[sStTmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL]|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


def id_bytes(ids: Iterable[int]) -> bytes:
    ids = list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


_BEYOND_LATIN = re.compile("[^\0-\u024f]").search


def _young(char: str) -> bool:
    """A letter or number that older Unicode tables lack, or a character that this one lacks."""
    return unicodedata.ucd_3_2_0.category(char) == "Cn" and (unicodedata.category(char)[0] in "LN" or unicodedata.category(char) == "Cn")


class Memo(dict):
    """Results of ``make`` by key; when full, the entries become the old generation and the one before is dropped."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old[key] if key in self.old else self.make(key)
        self[key] = value
        return value


class ByteEncoder:
    """Byte-level vocabulary: words of ``BYTE_PATTERN``, each with the space before it."""

    def __init__(self, word_ids: Callable[[str], Iterable[int]], special: dict[str, int]):
        self.split = regex.compile(BYTE_PATTERN).findall
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = Memo(lambda w: id_bytes(word_ids(w)), PIECES)
        self.chunks = Memo(self._chunk, CHUNKS)

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a space and the chunk; None if the cuts around it may be wrong."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return b"".join(map(self.words.__getitem__, self.split(" " + chunk)))

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and not first[0].isspace() and not first[-1].isspace():
            try:
                return b"".join([*map(self.words.__getitem__, self.split(first)), *map(self.chunks.__getitem__, rest)])
            except TypeError:
                pass
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def __call__(self, text: str) -> bytes:
        if self.cut and any(s in text for s in self.special):
            return b"".join(id_bytes([self.special[p]]) if p in self.special else self._plain(p) for p in self.cut.split(text) if p)
        return self._plain(text) if text else b""


class RankEncoder:
    """Byte-level vocabulary, whole texts at a time, by the ranks of its tokens.

    Merging the pair of lowest rank and merging the pair whose union is the token of lowest id
    are the same if ids ascend with ranks and every token is the encoding of its own label:
    ``usable`` checks both. Very long white space goes to the library.
    """

    def __init__(self, tokenizer, definition: dict):
        import tiktoken

        self.special = special_ids(definition)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte_of[c] for c in k): i for k, i in definition["model"]["vocab"].items() if k not in self.special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.blank = re.compile(r"\s{5000}").search
        self.library = tokenizer

    @staticmethod
    def usable(tokenizer, definition: dict) -> bool:
        model, special, vocab = tokenizer.model, special_ids(definition), definition["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in definition["model"]["merges"])
        made = [vocab[u + v] for u, v in pairs]
        return made == sorted(made) and all([t.id for t in model.tokenize(k)] == [i] for k, i in vocab.items() if k not in special)

    def ids(self, text: str) -> list[int]:
        if self.cut and any(s in text for s in self.special):
            return [i for p in self.cut.split(text) if p for i in ([self.special[p]] if p in self.special else self.ids(p))]
        if len(text) >= 5000 and self.blank(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranks(text)

    def __call__(self, text: str) -> bytes:
        return id_bytes(self.ids(text))


class WordEncoder:
    """Lower-cased vocabulary with word ends: words of ``WORD_PATTERN``, white space dropped."""

    def __init__(self, word_ids: Callable[[str], Iterable[int]], whole_ids: Callable[[str], Iterable[int]], special: dict[str, int]):
        self.split = regex.compile(WORD_PATTERN).findall
        self.whole, self.special = whole_ids, list(special)
        self.words = Memo(lambda w: id_bytes(word_ids(w)), PIECES)
        self.chunks = Memo(self._chunk, CHUNKS)

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of the chunk; None if libraries may disagree on what its characters are."""
        if _BEYOND_LATIN(chunk) and any(map(_young, chunk)):
            return None
        return b"".join(map(self.words.__getitem__, self.split(chunk)))

    def __call__(self, text: str) -> bytes:
        # a dotted capital I becomes a letter and a mark, which may join what follows
        if "İ" in text or any(s in text for s in self.special) or not unicodedata.is_normalized("NFC", text):
            return id_bytes(self.whole(text))
        try:
            return b"".join(map(self.chunks.__getitem__, text.split(" ")))
        except TypeError:
            return id_bytes(self.whole(text))


class WordRankEncoder:
    """Lower-cased vocabulary with word ends, one chunk at a time, by the ranks of its tokens.

    Every word is followed by ``MARK``, and the vocabulary's word end is ``MARK`` too: the first
    merges join it with the last byte of a word, and from there on the merges are the library's
    own. ``marked`` writes the vocabulary so; the rest is as in ``RankEncoder``, with the same
    check. Texts that libraries may lower-case or cut differently go to the library whole.
    """

    MARK = "\0"

    def __init__(self, tokenizer, definition: dict):
        import tiktoken

        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab, _ = self.marked(definition)
        ranks = {bytes(byte_of[c] for c in k): i for k, i in vocab.items()}
        self.ranks = tiktoken.Encoding("words", pat_str=f"[^{self.MARK}]+{self.MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(WORD_PATTERN).findall
        self.special = list(special_ids(definition))
        self.odd = re.compile("[\0\x1c-\x1f\x85\u180eİΣ]").search
        self.chunks = Memo(self._chunk, WORD_CHUNKS)
        self.library = tokenizer

    @classmethod
    def marked(cls, definition: dict) -> tuple[dict[str, int], list[tuple[str, str]]]:
        """The vocabulary without special tokens and its merges, with ``MARK`` as an ordinary last symbol in place of the word end."""
        model, special = definition["model"], special_ids(definition)
        suffix, mark = model["end_of_word_suffix"], byte_alphabet()[ord(cls.MARK)]

        def label(token: str) -> str:
            return token.removesuffix(suffix) + mark if token.endswith(suffix) else token

        vocab = {label(k): i for k, i in model["vocab"].items() if k not in special and mark not in k}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges = [(label(u), label(v)) for u, v in pairs if mark not in u + v]
        ends = sorted((i, k) for k, i in vocab.items() if len(k) == 2 and k[1] == mark)
        return vocab | {mark: max(model["vocab"].values()) + 1}, [(k[0], mark) for _, k in ends] + merges

    @classmethod
    def usable(cls, definition: dict) -> bool:
        from tokenizers import models

        suffix = definition["model"].get("end_of_word_suffix")
        if not suffix:
            return False
        vocab, merges = cls.marked(definition)
        made = [vocab[u + v] for u, v in merges]
        mark = byte_alphabet()[ord(cls.MARK)]
        alphabet = [c for c in byte_alphabet() if c != mark]
        if made != sorted(made) or not all(c in vocab and c + mark in vocab for c in alphabet):
            return False
        model = models.BPE(vocab=vocab, merges=merges)
        return all([t.id for t in model.tokenize(k)] == [i] for k, i in vocab.items())

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of the chunk; None if libraries may see the kind, case or white space of its characters differently."""
        if self.odd(chunk) or (_BEYOND_LATIN(chunk) and any(map(_young, chunk))):
            return None
        low = chunk.lower()
        words = [low] if low.isalpha() and low.isascii() else self.split(low)
        return id_bytes(self.ranks(self.MARK.join(words) + self.MARK)) if words else b""

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or not unicodedata.is_normalized("NFC", text):
            return self._whole(text)
        try:
            return b"".join(map(self.chunks.__getitem__, text.split(" ")))
        except TypeError:
            return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return id_bytes(self.library.encode(text, add_special_tokens=False).ids)


def special_ids(definition: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in definition["added_tokens"] if t["special"]}


def library_encoder(source: str) -> ByteEncoder | RankEncoder | WordEncoder | WordRankEncoder:
    """Encoder over the words' ids of the tokenizers library; ``source`` is the tokenizer's JSON text."""
    from tokenizers import Tokenizer

    tokenizer, definition = Tokenizer.from_str(source), json.loads(source)
    alphabet = dict(enumerate(byte_alphabet()))
    model, normal = tokenizer.model, tokenizer.normalizer

    def ids(word: str) -> list[int]:
        if not (word.isascii() and word.isprintable()) or " " in word:  # else its bytes stand for themselves
            word = word.encode().decode("latin-1").translate(alphabet)
        return [t.id for t in model.tokenize(word)]

    special = special_ids(definition)
    if normal is None:
        return RankEncoder(tokenizer, definition) if RankEncoder.usable(tokenizer, definition) else ByteEncoder(ids, special)
    if WordRankEncoder.usable(definition):
        return WordRankEncoder(tokenizer, definition)
    return WordEncoder(lambda w: ids(w.lower() if w.isascii() else normal.normalize_str(w)), lambda t: tokenizer.encode(t, add_special_tokens=False).ids, special)


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
