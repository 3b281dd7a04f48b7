"""Token counts by byte-pair merging with a heap and a linked list: initial symbols minus merges, no identifiers."""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from lexisift.llm.shared import column_text

#: Distinct runs between white space, of each of two generations, whose counts a worker remembers, and the characters of the longest of them:
#: some 100 MB a worker at most.
REMEMBERED, LONGEST = 300_000, 64
#: Characters that Python takes for white space and the Unicode property doesn't.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself if it is printable Latin-1, else the next character from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """Tokens of a run without white space, computed when first asked for."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.ascii_words = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        # beyond ASCII, letters and their lower case are those of the library's version of Unicode
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.split = pre_tokenizers.Split(Regex(split), "removed", invert=True).pre_tokenize_str
        special = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.suffix = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.bytes = byte_symbols()
        self.known = model["vocab"].keys()
        self.earlier: dict[str, int] = {}  # the generation before: its runs come back when they are met again

    def __missing__(self, run: str) -> int:
        if len(self) >= REMEMBERED:
            self.earlier = dict(self)
            self.clear()
        if run in self.earlier:
            self[run] = self.earlier[run]
            return self[run]
        total, parts = 0, [run]
        if self.special is not None:
            parts = self.special.split(run)
            total = len(parts) - 1
        for part in parts:
            words = self.ascii_words(part.lower()) if part.isascii() else [w for w, _ in self.split(self.normal(part))]
            total += sum(map(self.count, words))
        if len(run) <= LONGEST:
            self[run] = total
        return total

    def count(self, word: str) -> int:
        """Repeatedly merges the adjacent pair of lowest rank, the leftmost of equals."""
        symbols = [self.bytes[b] for b in word.encode()]
        symbols[-1] += self.suffix
        symbols = [s for s in symbols if s in self.known]
        n = len(symbols)
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in ranks]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else n
            if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (new := (symbols[i], symbols[after[i]])) in ranks:
                    heapq.heappush(heap, (ranks[new], i, new))
            if before[i] >= 0 and (new := (symbols[before[i]], symbols[i])) in ranks:
                heapq.heappush(heap, (ranks[new], before[i], new))
            left -= 1
        return left

    def of(self, text: str) -> int:
        runs = _SPACE.split(text) if _SEPARATORS.search(text) else text.split()
        return sum(map(self.__getitem__, runs))


_COUNTERS: dict[bytes, Counter] = {}


def _counter(spec: str) -> Counter:
    """The counter of a worker process, whose tasks share what it remembers."""
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(spec)
    return _COUNTERS[key]


def _counted(spec, limit: int):
    def run(batches):
        counter = _counter(spec.value)
        for batch in batches:
            texts = column_text(batch, "text")
            n = [counter.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("n_bytes")), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each ``docs(doc_id, text)`` row, as the library of the file ``tokenizer`` counts.

    The file is read on the driver and broadcast (a vocabulary of fixed size). One pass without a shuffle; a worker remembers the counts of
    twice ``REMEMBERED`` runs of ``LONGEST`` characters at most. Special strings count one each. Null and empty texts have no tokens; repeated
    rows repeat their count; an empty table has no rows. Other columns are ignored.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return rows.mapInArrow(_counted(spec, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

