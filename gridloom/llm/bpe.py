"""Byte-pair encoding and decoding with batched merge rounds.

Words of many documents lie as symbols in one flat array. In every round the
keys of all neighbouring pairs are looked up by binary search in the sorted
pair keys, every word merges its pair of lowest rank, and words without a
known pair leave the array. Only words that a task has not met are merged; a
bounded memo holds the rest.

Spark deals the documents out; there is no shuffle. The vocabulary (a file of
bounded size) is read once by the driver and broadcast.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, whole

# Bytes of text that a task takes, and of words that it turns into symbols, at a time;
# words it remembers.
CHUNK_BYTES = 250_000
MEMO_WORDS = 400_000
NONE = np.iinfo(np.int64).max

# Letters and digits of Unicode 16 that Python's tables (15.1)
# do not know yet, and the lower-case forms of its new capitals (first, last,
# distance or target).
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_DIGITS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
    (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
NEW_CAPITALS = {
    0x03A3: 0x03C3, 0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF,
    0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


BASIC = 0xFFFF
# Texts within the first plane are cut by a pattern of that plane alone: classes
# with characters beyond it are many times slower at every character outside them.
BEYOND = re.compile("[\U00010000-\U0010ffff]").search
RARE_CAPITALS = re.compile("[" + "".join(map(chr, NEW_CAPITALS)) + "]").search
BASIC_CAPITALS = re.compile("[" + "".join(chr(c) for c in NEW_CAPITALS if c <= BASIC) + "]").search


def _class(kind: str, more, most: int) -> str:
    """The inside of a character class for a Unicode category's first letter, up to
    a code point."""
    ranges, start = [(a, min(b, most)) for a, b in more if a <= most], None
    for code in range(most + 2):
        inside = code <= most and unicodedata.category(chr(code))[0] == kind
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            ranges.append((start, code - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in sorted(ranges))


def word_pattern(most: int = sys.maxunicode) -> str:
    """The pattern of words in texts without a character above ``most``."""
    letter, digit = _class("L", NEW_LETTERS, most), _class("N", NEW_DIGITS, most)
    return f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{SPACES}{letter}{digit}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


@dataclass
class Vocabulary:
    """Tables of a BPE file: sorted pair keys, ranks, symbols and patterns."""

    tokens: list[str]
    specials: dict[str, int]
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    one_at_a_time: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    words: str
    basic_words: str

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        specials = {t["content"]: t["id"] for t in content["added_tokens"]}
        tokens = [""] * (max([*vocabulary.values(), *specials.values()]) + 1)
        for token, number in {**vocabulary, **specials}.items():
            tokens[number] = token
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = left * len(tokens) + right
        order = np.argsort(keys, kind="stable")
        # A merge whose product takes part in an earlier merge must be done
        # occurrence by occurrence; elsewhere all occurrences may go at once.
        first = np.full(len(tokens), len(pairs), np.int64)
        for used in (left, right):
            np.minimum.at(first, used, np.arange(len(pairs)))
        letters = byte_letters()
        return Vocabulary(
            tokens=tokens,
            specials=specials,
            keys=keys[order],
            ranks=order,
            merged=made[order],
            one_at_a_time=(first[made] < np.arange(len(pairs))),
            inner=np.array([vocabulary[c] for c in letters], np.int64),
            final=np.array([vocabulary[c + suffix] for c in letters], np.int64),
            words=word_pattern(),
            basic_words=word_pattern(BASIC),
        )


def merge_rounds(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Token ids (little-endian unsigned 32-bit) of every word."""
    if not words:
        return []
    sizes = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbols = v.inner[raw]
    last = np.cumsum(sizes) - 1
    symbols[last] = v.final[raw[last]]
    word = np.repeat(np.arange(len(words)), sizes)
    done_symbols, done_words = [], []
    while len(symbols):
        rank = np.full(len(symbols), NONE)
        together = np.flatnonzero(word[:-1] == word[1:])
        key = symbols[together] * len(v.tokens) + symbols[together + 1]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        known = v.keys[at] == key
        together, at = together[known], at[known]
        rank[together] = v.ranks[at]
        target = np.zeros(len(symbols), np.int64)
        target[together] = v.merged[at]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
        over = best == NONE
        if over.any():
            done_symbols.append(symbols[over])
            done_words.append(word[over])
        hit = (rank == best) & ~over
        index = np.arange(len(hit))
        # In a run of equal symbols every other pair merges, from the left.
        opens = hit & ~np.r_[False, hit[:-1]]
        begun = np.maximum.accumulate(np.where(opens, index, -1))
        hit &= (index - begun) % 2 == 0
        places = np.flatnonzero(hit)
        alone = v.one_at_a_time[rank[places]]
        if alone.any():
            earlier = np.r_[False, word[places[1:]] == word[places[:-1]]]
            places = places[~(alone & earlier)]
        symbols[places] = target[places]
        keep = ~over
        keep[places + 1] = False
        symbols, word = symbols[keep], word[keep]
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    flat = symbols[order].astype("<u4").tobytes()
    ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
    return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


class Coder:
    """Encodes and decodes texts in one Python worker."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.find, self.find_basic = re.compile(v.words).findall, re.compile(v.basic_words).findall
        self.memo: dict[str, bytes] = {}
        names = "|".join(map(re.escape, sorted(v.specials, key=len, reverse=True)))
        self.special = re.compile(f"({names})") if names else None

    def _segments(self, text: str) -> list[str]:
        """Texts and control strings in turn."""
        if self.special is None or not any(s in text for s in self.v.specials):
            return [text]
        return self.special.split(text)

    def _words(self, text: str) -> list[str]:
        """Lower-case words of a normalised text."""
        if text.isascii():
            return self.find_basic(text.lower())
        beyond = BEYOND(text)
        if (RARE_CAPITALS if beyond else BASIC_CAPITALS)(text):
            text = text.translate(NEW_CAPITALS)
        # Lower case stays within the plane of its capital.
        return (self.find if beyond else self.find_basic)(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        found, fresh = [], set()
        for text in texts:
            parts = []
            for i, part in enumerate(self._segments(text)):
                if i % 2:
                    parts.append(part)
                    continue
                parts.append(self._words(unicodedata.normalize("NFC", part)))
                fresh.update(parts[-1])
            found.append(parts)
        fresh = {w for w in fresh if w not in self.memo}
        if len(self.memo) + len(fresh) > MEMO_WORDS:
            self.memo.clear()
            fresh = {w for parts in found for p in parts if isinstance(p, list) for w in p}
        fresh = list(fresh)
        encoded = [w.encode("utf-8", "replace") for w in fresh]
        for a, b in chunks(encoded, [len(w) for w in encoded], CHUNK_BYTES):
            self.memo.update(zip(fresh[a:b], merge_rounds(encoded[a:b], self.v), strict=True))
        memo = self.memo.__getitem__
        return [
            b"".join(
                b"".join(map(memo, part))
                if isinstance(part, list)
                else self.v.specials[part].to_bytes(4, "little")
                for part in parts
            )
            for parts in found
        ]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, as a file without a decoder prescribes."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[str, Coder] = {}


def _coder(path: str, shipped) -> Coder:
    """One coder for each vocabulary and Python worker, kept between tasks."""
    if path not in _CODERS:
        _CODERS.clear()
        _CODERS[path] = Coder(shipped.value)
    return _CODERS[path]


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """(id, ids binary, decoded string): every whole text through the tokenizer.

    ``ids`` are little-endian unsigned 32-bit integers. Control strings of the
    vocabulary inside a text become their own ids. A null or empty text gives
    no ids and an empty decoded text; null ids and repeated rows pass through
    one by one; other columns are not read. Long texts are taken whole.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(Vocabulary.read(path))

    def work(batches):
        coder = _coder(path, shipped)
        for batch in batches:
            texts = batch.column(1)
            # Only one chunk of a batch is Python strings at a time.
            for a, b in chunks(texts, pc.binary_length(texts).to_pylist(), CHUNK_BYTES):
                ids = coder.encode(texts.slice(a, b - a).to_pylist())
                decoded = [coder.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=["id", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return out.mapInArrow(work, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)
