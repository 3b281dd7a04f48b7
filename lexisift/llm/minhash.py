"""Near duplicates: many universal hash minima in bands, signature verification, exact confirmation, star components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.components import connected_components
from lexisift.llm.shared import Scope, column_bytes, mapped

#: Minima of a signature.
MINIMA = 120
#: Members, and shingles of members, of a block of a bucket, in the mean; a larger bucket is compared block by block.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 200_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[3]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of a text's shingles of ``size`` words; of fewer words, the whole sequence is one shingle."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mixed(out + h[j : len(h) - n + 1 + j] * _MIX[j % 8])
    return np.unique(out)


def _family(seed: int = 0x5EED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, MINIMA, dtype=np.uint64)


_A, _B = _family()


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the multiply-add family over a set that isn't empty."""
    least = None
    for i in range(0, len(shingles), 512):
        part = (shingles[i : i + 512, None] * _A + _B).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_rows(num: int, den: int, missed: float = 1e-4) -> int:
    """Most rows of a band at which a pair at the threshold shares no band with a chance of ``missed`` at most."""
    s = num / den
    return max((r for r in range(1, 13) if (1 - s**r) ** (MINIMA // r) <= missed), default=1)


def least_agreement(num: int, den: int) -> int:
    """Equal minima under which a pair at the threshold falls with a chance of a millionth at most."""
    s, total = num / den, 0.0
    for k in range(MINIMA + 1):
        total += math.comb(MINIMA, k) * s**k * (1 - s) ** (MINIMA - k)
        if total > 1e-6:
            return k
    return 0


def links(sets: list[np.ndarray], signatures: np.ndarray, num: int, den: int, joined: np.ndarray | None = None, heads: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join the same members as all links ``den * |a & b| >= num * |a | b|`` of a head with any member do; without ``heads`` all are.

    ``joined`` labels members that are known to be joined already. Each head is held once against the members that nothing joins with it
    yet: by equal minima first, then on the full sets. There are fewer edges than members.
    """
    cut, size, n = least_agreement(num, den), np.array([len(x) for x in sets], np.int64), len(sets)
    label = np.arange(n) if joined is None else np.unique(joined, return_inverse=True)[1]
    open_, out = np.ones(n, bool), []  # a head that has met all members needn't be met again
    for p in range(n) if heads is None else np.flatnonzero(heads).tolist():
        open_[p] = False
        left = np.flatnonzero(open_ & (label != label[p]))
        fits = (den * np.minimum(size[left], size[p]) >= num * np.maximum(size[left], size[p])) & ((signatures[left] == signatures[p]).sum(axis=1) >= cut)
        near = left[fits]
        if not len(near):
            continue
        flat = np.concatenate([sets[i] for i in near])
        at = np.minimum(np.searchsorted(sets[p], flat), size[p] - 1)
        shared = np.add.reduceat((sets[p][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[near])[:-1]]))
        for i in near[den * shared >= num * (size[near] + size[p] - shared)].tolist():
            if label[i] != label[p]:
                out.append((p, i))
                label[label == label[i]] = label[p]
    return out


def _signed(size: int, rows: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, d, bands = [], [], []
        for text in column_bytes(batch, "text"):
            s = shingle_set(text, size)
            n.append(len(s))
            d.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
            if len(s):
                m = signature(s)
                bands.append([xxhash.xxh3_64_intdigest(m[b * rows : (b + 1) * rows].tobytes(), seed=b) - 2**63 for b in range(MINIMA // rows)])
            else:
                bands.append([])
        d = np.array(d)
        get = lambda k: batch.column(batch.schema.get_field_index(k))
        yield pa.RecordBatch.from_arrays([get("doc_id").cast(pa.int64()), get("key"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "n", "d1", "d2", "bands"])

    return run


def _setted(size: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(text, size) for text in column_bytes(batch, "text")]
        d = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
        packed = [(s.tobytes(), signature(s).astype(np.uint8).tobytes()) if len(s) else (b"", b"") for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary()), batch.column(batch.schema.get_field_index("large"))], ["rep", "d1", "d2", "members", "minima", "large"])

    return run


def _unit_links(num: int, den: int):
    """Links of each unit; the rows of a unit follow one another, and a unit has two blocks at most."""

    def flush(rows: list[tuple[bytes, bytes, bytes, bytes, bool]], out: list[tuple[bytes, bytes]]) -> None:
        if len(rows) > 1:
            reps, members, minima, joined, heads = zip(*rows, strict=True)
            number: dict[bytes, int] = {}
            joined = [number.setdefault(x, len(number)) for x in joined]
            found = links([np.frombuffer(x, np.uint64) for x in members], np.array([np.frombuffer(x, np.uint8) for x in minima]), num, den, np.array(joined), np.array(heads))
            out += [(reps[i], reps[j]) for i, j in found]

    def run(batches):
        held, rows = None, []
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            columns = [c.to_pylist() for c in batch.columns]
            for unit, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if unit != held:
                    flush(rows, out)
                    held, rows = unit, []
                rows.append(row)
            yield _edge_batch(out)
        out = []
        flush(rows, out)
        yield _edge_batch(out)

    return run


def _edge_batch(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])


def _compared(units: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b)``: links found in the units ``(key, i, j, rep, d1, d2, joined, head)``."""
    loaded = units.join(sets, ["rep", "d1", "d2"]).select("key", "i", "j", "rep", "members", "minima", "joined", "head")
    return loaded.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_unit_links(num, den), "a binary, b binary")


def _every(low, high) -> Column:
    """One row for each number from ``low`` up to but not including ``high``."""
    return F.explode(F.sequence(F.lit(low), high - 1))


def _bucket_groups(members: DataFrame, sets: DataFrame, num: int, den: int, scope: Scope) -> DataFrame:
    """``(node, component)`` of the links in the buckets ``members(key, rep, d1, d2, block, blocks)``.

    First every member of a bucket of several blocks is held against the first block: a row for each, and the first block's rows once for
    each other block. What this joins is known from then on. Only members outside of the largest group of their bucket are then held
    against the other blocks, so a bucket that is one group of near copies costs twice its rows, not their square.
    """
    row = ["key", "i", "j", "rep", "d1", "d2", "joined", "head"]
    plain = members.withColumn("i", F.lit(0)).withColumn("joined", F.col("rep")).withColumn("head", F.col("block") == 0)
    first = plain.where("blocks = 1 or block > 0").withColumn("j", F.col("block")).select(row)
    heads = plain.where("blocks > 1 and block = 0").withColumn("j", _every(1, F.col("blocks"))).select(row)
    edges = scope.written(_compared(first.unionByName(heads), sets, num, den), "links")
    groups = connected_components(edges, scope)

    large = members.where("blocks > 1").select("key", "rep", "d1", "d2", "block", "blocks")
    if large.isEmpty():
        return groups
    # members of one bucket that were joined; the largest group of a bucket by counts of its groups, which are pre-aggregated
    joined = scope.written(large.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("joined", F.coalesce("component", "rep")).drop("component"), "joined")
    sizes = joined.groupBy("key", "joined").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "joined")).alias("m")).select("key", F.col("m.joined").alias("joined"))
    rest = joined.where("block > 0").join(most, ["key", "joined"], "left_anti")
    parts = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    if parts.isEmpty():
        return groups
    rest = rest.join(parts, "key").withColumn("i", F.pmod(F.xxhash64("d2", "rep"), F.col("parts")).cast("int"))
    rest = rest.withColumn("head", F.lit(True)).withColumn("j", _every(1, F.col("blocks"))).select(row)
    others = joined.where("block > 0").join(parts, "key").withColumn("head", F.lit(False)).withColumn("j", F.col("block")).withColumn("i", _every(0, F.col("parts"))).select(row)
    more = scope.written(_compared(rest.unionByName(others), sets.where("large"), num, den), "links")
    return connected_components(more.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))), scope)


def text_key() -> Column:
    """A key of 128 bits of a document row: equal for repeated rows, different for different texts under one id."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary")))


def grouped(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, scope: Scope | None = None) -> DataFrame:
    """``(doc_id, key, n, group, least)`` for each row of ``docs(doc_id, text)``: its ``text_key``, group and the group's smallest id.

    Rows are linked by their keys, not by their ids, so that two texts under one id stay apart and texts without an id link others. An empty
    text is a group of its own. The tables of the result are in ``scope``.
    """
    scope = scope or Scope()
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("key"))
    rows = band_rows(num, den)
    signed = scope.written(mapped(docs, _signed(shingle, rows), "doc_id long, key binary, n long, d1 long, d2 long, bands array<long>"), "signed")
    classes = signed.groupBy("d1", "d2", "n").agg(F.min("key").alias("rep"), F.min("doc_id").alias("least"))
    with Scope() as own:
        bearers = signed.where("n > 0").join(classes.select("d1", "d2", F.col("rep").alias("key")), ["d1", "d2", "key"], "left_semi").dropDuplicates(["key", "d1", "d2"])
        banded = own.written(bearers.select(F.col("key").alias("rep"), "d1", "d2", "n", F.explode("bands").alias("key")), "banded")
        buckets = banded.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("rep", "d1")).alias("x"), F.bit_xor(F.xxhash64("d2", "rep")).alias("y"))
        buckets = buckets.where("m > 1").groupBy("m", "x", "y").agg(F.min("key").alias("key"), F.min("w").alias("w"))
        blocks = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
        members = banded.select("key", "rep", "d1", "d2").join(buckets.select("key", blocks.alias("blocks")), "key")
        members = own.written(members.withColumn("block", F.pmod(F.xxhash64("rep", "d1"), F.col("blocks")).cast("int")), "members")
        # the candidates grow with the corpus: never broadcast
        wanted = members.groupBy(F.col("rep").alias("key")).agg(F.max(F.col("blocks") > 1).alias("large"))
        involved = docs.join(wanted.hint("merge"), "key").dropDuplicates(["key", "text"])
        sets = own.written(mapped(involved, _setted(shingle), "rep binary, d1 long, d2 long, members binary, minima binary, large boolean"), "sets", "large")
        groups = scope.written(_bucket_groups(members, sets, num, den, own), "groups")

    found = groups.withColumnRenamed("node", "rep").join(classes.where("n > 0").select("rep", F.col("least").alias("own")), "rep")
    found = found.join(found.groupBy("component").agg(F.min("own").alias("lowest")), "component").select("rep", "component", "lowest")
    found = classes.join(found, "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("group"), F.coalesce("lowest", "least").alias("least"))
    out = signed.select("doc_id", "key", "n", "d1", "d2").join(found, ["d1", "d2", "n"], "left")
    # an empty text is linked with nothing, though all empty sets have one digest
    empty = F.col("n") == 0
    return out.select("doc_id", "key", "n", F.when(empty, F.col("key")).otherwise(F.col("group")).alias("group"), F.when(empty, F.col("doc_id")).otherwise(F.col("least")).alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, scope: Scope | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``; texts with a Jaccard similarity of ``num / den`` or more are linked.

    1. Each text becomes a set of shingles, a digest of that set and the keys of its bands; equal sets become one class, counted
       before the shuffle, so thousands of copies are one row from here on.
    2. Classes that share a band key are a bucket; buckets of the same members count once.
    3. A bucket is compared within one task, by minima first and then on the full sets; one of several blocks against its first block, and
       then its members outside of its largest group against the other blocks. A task has two blocks at most and yields a spanning forest
       of its links, never its pairs.
    4. Components of these edges are the groups.

    Null text is as empty; empty texts have no shingles and are linked with nothing. Repeated rows are copies of each other and share a
    component; each row follows its own text, if an id has several. A null id gets the component of its text (null if no text of it has an
    id) and is never kept. Empty tables give empty results. Other columns are ignored. A pair at the threshold is missed with a chance of
    1e-4 at most.
    """
    out = grouped(docs, shingle, num, den, scope)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.coalesce(F.col("least") == F.col("doc_id"), F.lit(False)).alias("kept"))
