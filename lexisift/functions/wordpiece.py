"""Word pieces: the longest pieces of a vocabulary from left to right, found in a trie, a batch of texts at a time."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

UNKNOWN, CONTINUES = "[UNK]", "##"
#: Letters beyond which a word is unknown, and different words that a worker remembers.
LONGEST, REMEMBERED = 100, 200_000
#: Blocks of ideographs, each of which is a word of its own (fixed values).
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))

_ASCII = {c: None for c in (*range(32), 127)} | {ord(c): " " for c in "\t\n\r"}
_IDEOGRAPH = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IDEOGRAPHS) + "])")


@cache
def _words() -> re.Pattern:
    """Runs of anything but blanks and punctuation, and single marks: ASCII's and those that Unicode files under punctuation."""
    marks = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "P" or c in "$+<=>^`|~"]
    marks = "".join(map(re.escape, marks))
    return re.compile(f"[{marks}]|[^ {marks}]+")


@cache
def _cleaned(c: str) -> str:
    if c in "\t\n\r" or (c.isspace() and unicodedata.category(c)[0] != "C"):
        return " "
    return "" if c == "�" or unicodedata.category(c)[0] == "C" else c


def normal(text: str, lower: bool = True) -> str:
    """Without control characters, blanks for white space, ideographs apart; without accents and in lower case, if asked."""
    if text.isascii():
        text = text.translate(_ASCII)
        return text.lower() if lower else text
    text = _IDEOGRAPH.sub(r" \1 ", "".join(map(_cleaned, text)))
    if lower:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        text = text.replace("Σ", "σ").lower()  # a letter at a time: no final sigma
    return text


class WordPiece:
    """A vocabulary as two tries, for the beginnings of words and for what continues them."""

    def __init__(self, pieces: Iterable[str], lower: bool = True):
        self.ids = {p: i for i, p in enumerate(pieces)}
        if UNKNOWN not in self.ids:
            raise ValueError(f"the vocabulary has no {UNKNOWN}")
        self.lower, self.unknown, self.known = lower, self.ids[UNKNOWN], {}
        self.begins: dict = {}
        self.continues: dict = {}
        for piece, i in self.ids.items():
            # a piece may begin with the mark of continuation and still begin a word that is spelt so
            for root, letters in ((self.begins, piece), (self.continues, piece[len(CONTINUES) :] if piece.startswith(CONTINUES) else "")):
                node = root
                for c in letters:
                    node = node.setdefault(c, {})
                if letters:
                    node[""] = i

    def word(self, word: str) -> list[int]:
        """The longest piece at each place; a word of which some place has none, or that is too long, is unknown as a whole."""
        if len(word) > LONGEST:
            return [self.unknown]
        out, at, n, trie = [], 0, len(word), self.begins
        while at < n:
            node, found, end, i = trie, -1, at, at
            while i < n and (node := node.get(word[i])) is not None:
                i += 1
                if "" in node:
                    found, end = node[""], i
            if found < 0:
                return [self.unknown]
            out.append(found)
            at, trie = end, self.continues
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for w in _words().findall(normal(text, self.lower)):
            ids = self.known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(self.known) < REMEMBERED:
                    self.known[w] = ids
            out += ids
        return out


def vocabulary(path: str) -> list[str]:
    """The pieces of a vocabulary file: one a line, or of a JSON tokenizer with word ends, whose pieces may begin and continue words.

    Such a tokenizer spells bytes as letters; pieces that are no whole characters are left out.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not text.lstrip().startswith("{"):
        return text.splitlines()
    model = json.loads(text)["model"]
    if model["type"] == "WordPiece":
        return sorted(model["vocab"], key=model["vocab"].get)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    found: dict[str, None] = {}
    for piece in sorted(model["vocab"], key=model["vocab"].get):
        try:
            found.setdefault(bytes(spelt[c] for c in piece.removesuffix("</w>")).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    whole = [p for p in found if p and not p.startswith(CONTINUES)]
    return ["[PAD]", UNKNOWN, "[CLS]", "[SEP]", "[MASK]", *whole, *(CONTINUES + p for p in whole)]


def _encoded(model, keys: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            rows = [own.encode(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = pa.array(np.fromiter((i for r in rows for i in r), np.int32, ends[-1]))
            unknown = pa.array([r.count(own.unknown) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), pa.ListArray.from_arrays(pa.array(ends), flat), unknown], [*keys, "ids", "n_unknown"])

    return run


def word_pieces(texts: DataFrame, pieces: list[str], *keys: str, lower: bool = True) -> DataFrame:
    """``(keys..., ids, n_unknown)`` of ``texts(keys..., text)``: numbers of the pieces of each text, in one pass without a shuffle.

    Null and empty texts have no pieces. The vocabulary is broadcast, the different words of a worker are looked up once.
    """
    rows = texts.select(*keys, "text")
    schema = StructType([rows.schema[k] for k in keys]).add("ids", ArrayType(IntegerType())).add("n_unknown", LongType())
    return rows.mapInArrow(_encoded(texts.sparkSession.sparkContext.broadcast(WordPiece(pieces, lower)), list(keys)), schema)


def digest(ids: Column) -> Column:
    """MD5 of the numbers, joined by commas."""
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").cast("binary"))
