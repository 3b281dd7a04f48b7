"""SentencePiece encoding and decoding by the tokenizers library, rebuilt from the model's protobuf."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import models, normalizers, pre_tokenizers

from lexisift.llm.shared import column_text

#: The marker of a space; piece types and model types of the protobuf (fixed values).
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct runs of each of the two generations that a worker remembers, and the characters of the longest of them: some 100 MB a worker at
#: most; threads of a worker's library.
REMEMBERED, LONGEST, THREADS = 300_000, 64, 2


def wire(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"wire type {kind}")
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, message[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces_removed: bool = True
    escaped: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> Model:
    """Pieces, trainer and normaliser settings of a model file."""
    out = Model()
    for number, value in wire(data):
        if number == 1:
            own = dict(wire(value))
            out.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(wire(value))
            out.kind, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(wire(value))
            out.charsmap = own.get(2, b"")
            out.dummy_prefix, out.extra_spaces_removed, out.escaped = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    return out


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best score first: the pair whose union scores best merges first."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, UNUSED)}  # user-defined pieces are found before, and never merge
    rank = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = [(-s, rank[p], i, p[:i], p[i:]) for p, s in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
    return [x[3:] for x in sorted(found)]


def library_tokenizer(model: Model) -> tokenizers.Tokenizer:
    """The model as a tokenizers pipeline for runs whose spaces are markers already, without a dummy prefix."""
    if model.kind == UNIGRAM:
        best = max(0.0, *(s for _, s, kind in model.pieces if kind == NORMAL))
        scores = [(p, len(p.encode()) * best - 0.1 if kind == USER_DEFINED else s) for p, s, kind in model.pieces]  # ahead of any other cut of their text
        own = tokenizers.Tokenizer(models.Unigram(scores, model.unknown, model.byte_fallback))
    elif model.kind == BPE:
        unknown = model.pieces[model.unknown][0]
        own = tokenizers.Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model type {model.kind} has no counterpart")
    if any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces):
        return own  # pieces reach over spaces: a text is one run
    own.pre_tokenizer = pre_tokenizers.Split(tokenizers.Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    return own


class Codec:
    """Encodes and decodes texts; distinct runs are encoded together, with the library's threads, and remembered."""

    def __init__(self, data: bytes):
        self.model = parse_model(data)
        self.library = library_tokenizer(self.model)
        self.normaliser = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.whole = self.library.pre_tokenizer is None
        # user-defined pieces aren't normalised, the longest first; merges never touch them, a unigram model gives them scores
        self.user = {p: struct.pack("<i", i) for i, (p, _, kind) in enumerate(self.model.pieces) if kind == USER_DEFINED}
        self.split_user = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")").split if self.user else None
        # a line break that no piece holds is a run of its own: bytes never merge
        lines = self.model.byte_fallback and not any("\n" in p for p, _, _ in self.model.pieces)
        self.run = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if lines else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}  # the generation before: its runs come back when they are met again
        self.long: list[str] = []
        self.unlike: dict[str, bytes] = {}  # surfaces of runs whose pieces don't decode to the run itself
        self.surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]

    def normal(self, text: str) -> str:
        if self.normaliser is not None:
            if self.split_user:
                text = "".join(p if p in self.user else self.normaliser.normalize_str(p) for p in self.split_user(text))
            else:
                text = self.normaliser.normalize_str(text)
        if self.model.extra_spaces_removed:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = (" " if self.model.dummy_prefix else "") + text
        return text.replace(" ", MARK) if self.model.escaped else text

    def runs(self, text: str) -> list[str]:
        text = self.normal(text)
        if self.split_user and self.model.kind == BPE:
            return [r for p in self.split_user(text) if p for r in ([p] if p in self.user or self.whole else self.run(p))]
        return ([text] if text else []) if self.whole else self.run(text)

    def _forget(self) -> None:
        """Long runs are known for the texts at hand only, so they are among the new ones each time."""
        for r in self.long:
            del self.known[r]
            self.unlike.pop(r, None)
        self.long = []

    def _learn(self, split: list[list[str]]) -> None:
        """Encodes and decodes the runs that aren't known yet, a large batch at a time, with the library's threads."""
        if len(self.known) > REMEMBERED:
            self.known, self.earlier = {}, self.known
            self.unlike = {r: said for r, said in self.unlike.items() if r in self.earlier}
        if self.model.kind == BPE:
            self.known.update(self.user)
        missing = set().union(*split).difference(self.known)
        back = self.earlier.keys() & missing
        self.known.update((r, self.earlier[r]) for r in back)
        new = list(missing - back)
        self.long = [r for r in new if len(r) > LONGEST]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for r, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = e.ids
                self.known[r] = struct.pack(f"<{len(ids)}i", *ids)
                said = b"".join([self.surface[k] for k in ids])
                if said != r.replace(MARK, " ").encode():
                    self.unlike[r] = said

    def encode(self, texts: list[str]) -> list[bytes]:
        """Identifiers of each text, as 32-bit little-endian numbers."""
        split = [self.runs(t) for t in texts]
        self._learn(split)
        out = [b"".join(map(self.known.__getitem__, runs)) for runs in split]
        self._forget()
        return out

    def _text(self, out: str) -> str:
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out

    def decode(self, ids: bytes) -> str:
        return self._text(b"".join(map(self.surface.__getitem__, memoryview(ids).cast("i"))).decode("utf-8", "replace"))

    def _said(self, runs: list[str]) -> str:
        """What the identifiers of known runs decode to."""
        if not self.unlike or self.unlike.keys().isdisjoint(runs):
            return self._text("".join(runs).replace(MARK, " "))
        return self._text(b"".join([self.unlike[r] if r in self.unlike else r.replace(MARK, " ").encode() for r in runs]).decode("utf-8", "replace"))

    def both(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Identifiers of each text and what they decode to; each distinct run's identifiers are decoded once, when they are learnt."""
        split = [self.runs(t) for t in texts]
        self._learn(split)
        out = [(b"".join(map(self.known.__getitem__, runs)), self._said(runs)) for runs in split]
        self._forget()
        return out


_CODECS: dict[bytes, Codec] = {}


def _codec(data: bytes) -> Codec:
    """The codec of a worker process, whose tasks share what it remembers; its library takes ``THREADS`` threads: a task has a core or two, not the machine."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    key = hashlib.sha256(data).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def _coded(data):
    def run(batches):
        codec = _codec(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = column_text(part, "text")
                found = codec.both(texts)
                ids, back = [i for i, _ in found], [b == t for (_, b), t in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array(back, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return run


def _listed(data):
    def run(batches):
        codec = _codec(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = codec.encode(column_text(part, "text"))
                flat = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
                offsets = [0]
                for i in ids:
                    offsets.append(offsets[-1] + len(i) // 4)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["doc_id", "ids"])

    return run


def model_data(spark, path: str):
    """The model file, read on the driver and broadcast: a vocabulary of fixed size."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` for each ``docs(doc_id, text)`` row by the model file ``path``.

    Null and empty texts have no ids. Repeated rows repeat their result, null ids stay null, other columns are ignored, whatever they are
    called; an empty table has no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_listed(model_data(docs.sparkSession, path)), "doc_id long, ids array<int>")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, round_trip)`` for each ``docs(doc_id, text)`` row: the digest of its identifiers as 32-bit
    little-endian numbers, and whether decoding them gives the text back (a null text counts as empty).

    One pass without a shuffle. No piece of the model has a space marker after another character, so merges never cross the start of a run
    of markers, and a text is the sequence of its runs; a worker encodes each distinct run once while it remembers it. Repeated rows repeat
    their result, other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_coded(model_data(docs.sparkSession, path)), "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")
