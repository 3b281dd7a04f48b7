"""Periodic runs, source mixtures and phrase collocations against brute force, with odd rows."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexisift.llm import collocations, mixing, periodic

SCHEMA = "doc_id long, text string, lang string, source string, key string, n long, c long"


def plain_runs(w, power, least):
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            primitive = not any(q % d == 0 and all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q))
            if j > i and size >= max(least, power * q) and primitive:
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_up(rng):
    n, a = rng.choice([0, 1, 5, 20, 60, 120]), rng.choice([1, 2, 3, 50])
    w = [b"%d" % rng.randrange(a) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        s = rng.randrange(n)
        p = rng.randint(1, max(1, (n - s) // 3))
        for i in range(s + p, n):
            w[i] = w[i - p]
        if rng.random() < 0.3:
            w[rng.randrange(n)] = b"x"
    return w


@pytest.mark.parametrize("few", [0, 3, 200])
def test_runs_equal_brute_force(few, monkeypatch):
    monkeypatch.setattr(periodic, "FEW", few)
    rng = random.Random(few)
    for _ in range(150):
        docs = [made_up(rng) for _ in range(rng.randint(1, 6))]
        power, least = rng.choice([2, 3, 4]), rng.choice([2, 6])
        assert periodic.runs_of(docs, power, least) == [plain_runs(d, power, least) for d in docs]


def test_a_very_long_repeat_is_one_run():
    assert periodic.runs_of([[b"a"] * 300_000], 4, 6) == [[(0, 300_000, 1)]]
    w = [b"%d" % (i % 40_000) for i in range(200_000)]
    assert periodic.runs_of([w, []], 4, 6) == [[(0, 200_000, 40_000)], []]


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, "a b a b a b a b c", "en", "s", "k", 1, 1), (1, "a b a b a b a b c", "en", "s", "k", 1, 1), (2, None, None, None, None, None, None), (None, "x\tx\nx x x\x0bx", None, "", "", 0, 0), (3, "", "", "", "", 0, 0), (4, "a b", "", "", "", 0, 0)]
    out = periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out), key=repr)
    assert got == sorted([(1, 9, [(0, 8, 2)], "a b c")] * 2 + [(2, 0, [], ""), (None, 6, [(0, 6, 1)], "x"), (3, 0, [], ""), (4, 2, [], "a b")], key=repr)
    digests = periodic.run_digests(periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA).where("doc_id = 2"))).first()
    assert digests.n_runs == 0 and digests.start is None and digests.exponent_milli is None and digests.runs_sha256 == digests.collapsed_sha256
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planted_words_follow_the_id(spark):
    docs = spark.createDataFrame([(i, " ".join(str(x) for x in range(i % 37)), "", "", "", 0, 0) for i in range(400)] + [(None, "a  b", "", "", "", 0, 0)], SCHEMA)
    for row in docs.select("doc_id", "text", periodic.planted(F.col("text"), F.col("doc_id")).alias("made")).collect():
        h = zlib.crc32(str(row.doc_id).encode())
        w = row.text.split()
        if row.doc_id is None or h % 10 or not w:
            assert row.made.split() == w
            continue
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert row.made.split() == [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = Fraction(3 * sum(sizes.values()), 2)
    out = {s: total * w[s] / sum(w.values()) for s in names}
    while over := [s for s in names if out[s] > 2 * sizes[s]]:
        excess = sum(out[s] - 2 * sizes[s] for s in over)
        for s in over:
            out[s] = Fraction(2 * sizes[s])
        free = [s for s in names if out[s] < 2 * sizes[s]]
        for s in free:
            out[s] += excess * w[s] / sum(w[x] for x in free)
    return out


def mixture_rows(seed):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "é", "z", "aa"][: rng.randint(1, 7)]
    return [(i if rng.random() < 0.9 else None, rng.choice([None, "", "w " * rng.choice([1, 3, 40, 700])]), "", names[0] if rng.random() < 0.4 else rng.choice(names), "", 0, 0) for i in range(rng.choice([1, 60, 200]))]


@pytest.mark.parametrize("seed", range(4))
def test_mixture_meets_its_targets(spark, seed):
    rows = mixture_rows(seed)
    rows += rows[:5] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], len((r[1] or "").split())) for r in rows)
    sizes, taken = Counter({r[3]: 0 for r in rows}), Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    wanted = plain_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"] and r.target == pytest.approx(float(wanted[r.source]), rel=1e-12)
        taken[r.source] += r.taken
    assert all(taken[s] == int(wanted[s]) for s in sizes)
    assert sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_equal_rows_are_dealt_out_in_steps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    rows = [(None, "a b", "", "s", "", 0, 0)] * 23 + [(1, "c " * 30, "", "t", "", 0, 0)]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 24 and sum(r.taken for r in got if r.source == "s") == int(next(r.target for r in got if r.source == "s"))


def test_schedule_is_even_and_whole(spark):
    sources = spark.createDataFrame([("a", False, 256 * 500), ("b", False, 256 * 300 + 1), ("c", True, 256 * 3), ("d", True, 0)], "s string, unnamed boolean, quota long")
    rows = mixing.schedule(sources).orderBy("slot").collect()
    assert len({r.slot for r in rows}) == len(rows) == 500 + 301 + 3
    for name, blocks in (("a", 500), ("b", 301), ("c", 3)):
        assert [r.block for r in rows if r.s == name] == list(range(blocks))
    # every stretch of the schedule has the sources' shares but for a few slots
    for at in range(0, len(rows), 97):
        assert abs(sum(r.s == "a" for r in rows[:at]) - at * 500 / 804) < 8


def test_mixture_takes_each_word_of_a_lap_once(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + 97 * i % 1300), "", "abc"[i % 3], "", 0, 0) for i in range(60)], SCHEMA)
    stream = mixing.streams(docs)
    seen = Counter()
    for r in mixing.mixture(stream).collect():
        assert 0 <= r.first and r.first + r.words <= r["size"] and r.words <= mixing.BLOCK_WORDS
        for x in range(r.first, r.first + r.words):
            seen[r.doc_id, x] += 1
    assert max(seen.values()) <= 2 and sum(seen.values()) == sum(r.quota for r in stream.select("s", "quota").distinct().collect())
    assert mixing.mixed(docs.limit(0)).count() == 0


def plain_collocations(rows, longest, least, inside, top):
    counts, n = {}, Counter()
    for row in rows:
        lang, text = row[2] or "und" if row[2] is not None else "und", row[1] or ""
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts[lang, tuple(w[i : i + m])] = counts.get((lang, tuple(w[i : i + m])), 0) + 1
    candidates = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= least}
    out = {}
    for (lang, p), a in candidates.items():
        if any(x == lang and len(q) > len(p) and 100 * c >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), c in candidates.items()):
            continue
        score, k = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_collocations_equal_brute_force(spark, longest, monkeypatch):
    monkeypatch.setattr(collocations, "PIVOT_ROWS", 40)
    rng = random.Random(longest)
    words = ["The", "the", "of", "New", "York", "City", "à", "b\x00", "x", "y"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "\r"]) for _ in range(rng.choice([0, 3, 60])))
    rows = [(i, text() if i % 9 else None, rng.choice(["en", "de", None, ""]), "", "", 0, 0) for i in range(150)] + [(1, "new york city " * 15, "fr", "", "", 0, 0)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # an empty language is one of its own
    rows = [(*r[:2], r[2] if r[2] != "" else "\x01", *r[3:]) for r in rows]
    wanted = plain_collocations(rows, longest, 10, 50, 20)
    got = [tuple(r) for r in collocations.collocations(docs, longest, 10, 50, 20).collect()]
    assert sorted((r[0] or "\x01", *r[1:]) for r in got) == wanted and len(wanted) > 20
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_partial_counts_add_up(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(40)), "en", "", "", 0, 0) for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wanted = sorted(map(tuple, collocations.collocations(docs).collect()))
    blob = collocations.Counter(b"a b a".split())
    assert blob and wanted == [tuple(r) for r in plain_collocations(rows, 3, 10, 50, 2000)]
    # a partition that would outgrow memory sends parts
    batches = [collocations.pa.RecordBatch.from_pydict({"key": [1] * 3, "lang": ["en"] * 3, "pivot": ["a"] * 3, "shared": [False] * 3, "fragments": ["a b\nb a\t4", "c a\na b", "a b\nd a"]})]
    monkeypatch.setattr(collocations, "HELD", 1)
    counts = Counter()
    for out in collocations._mined(2, 3)(iter(batches)):
        for phrase, c in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
            counts[phrase] += c
    assert counts == {"a b": 3, "b a": 4, "c a": 1, "d a": 1}


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_segments_own_every_word_once(size):
    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bb", "ccc", "d" * 30, " ", "\t", ".", ", ", "\n"]) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))).encode()
        whole = next(collocations.segments(text, 2, 10**6))[0]
        own, grams = [], Counter()
        for words, low, high in collocations.segments(text, 2, size):
            own += words[low:high]
            for i in range(low, high):
                for a in range(max(0, i - 2), i + 1):
                    for b in range(i + 1, min(len(words), a + 3) + 1):
                        if None not in words[a:b]:
                            grams[tuple(words[a:b]), i - a] += 1
        assert own == whole
        assert grams == Counter((tuple(whole[a:b]), i - a) for i in range(len(whole)) for a in range(max(0, i - 2), i + 1) for b in range(i + 1, min(len(whole), a + 3) + 1) if None not in whole[a:b])
