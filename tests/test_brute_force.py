"""The queries that have no SQL, held against plain Python over the same tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.stem import stem
from lexisift.operators import mask, rouge
from lexisift.plans import catalogue, drivers
from lexisift.sources import tables

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W_]+")


def words_of(text):
    return WORD.findall(text.lower())


def sentences_of(text):
    return [s for s in re.sub(r"([.!?]) +", r"\1\n", re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")).split("\n") if s]


@pytest.fixture(scope="module")
def world(spark):
    docs = [(r.source, r.doc_id, r.text or "") for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    sents = {(c, d, i): s for c, d, t in docs for i, s in enumerate(sentences_of(t))}
    refs = defaultdict(dict)
    for i, t in items:
        refs[f"src{i % 20}"][i // 20] = words_of(t)
    query = {c: Counter(min((i, t) for i, t in items if f"src{i % 20}" == c)[1].lower() and words_of(min((i, t) for i, t in items if f"src{i % 20}" == c)[1])) for c in refs}
    ranks = defaultdict(list)
    for (c, d, i), s in sents.items():
        score = sum(query.get(c, {}).get(w, 0) for w in words_of(s))
        if score:
            ranks[c].append((-score, d, i, words_of(s)))
    return {"docs": docs, "sents": sents, "refs": refs, "items": items, "ranks": {c: sorted(v) for c, v in ranks.items()}}


def rows(spark, name):
    return catalogue.queries()[name](spark, DIR).collect()


def cosine(a, b):
    a, b = Counter(a), Counter(b)
    size = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return sum(v * b[w] for w, v in a.items()) / size if size else 0.0


def extract(ranked, budget, words, threshold, block=0, skips=None):
    taken, passed = [], 0
    for row in ranked:
        w = row[3]
        if taken and (skips is None or passed < skips):
            shares = block and any(tuple(w[i : i + block]) in {tuple(t[3][j : j + block]) for t in taken for j in range(len(t[3]) - block + 1)} for i in range(len(w) - block + 1))
            if shares or any(cosine(w, t[3]) >= threshold for t in taken):
                passed += 1
                continue
        taken.append(row)
        if sum(len(t[3]) if words else 1 for t in taken) >= budget:
            break
    return taken


@pytest.mark.parametrize("name,options", [("greedy_word_budget", (250, True, 0.6)), ("greedy_sentence_budget", (10, False, 0.6)), ("ngram_block_greedy", (10, False, 0.6, 3)), ("skip_allowance_greedy", (10, False, 0.4, 0, "spare"))])
def test_extraction(spark, world, name, options):
    want = set()
    for c, ranked in world["ranks"].items():
        ranked = ranked[:90]
        own = list(options)
        if own[-1] == "spare":
            own[-1] = max(0, len(ranked) - options[0])
        want |= {(c, k + 1, d, i) for k, (_, d, i, _) in enumerate(extract(ranked, *own))}
    assert {tuple(r) for r in rows(spark, name)} == want


def rouge_n(system, reference, n):
    a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (system, reference))
    o = (a & b).total()
    return o, round(o / b.total(), 6) if b else 0.0, round(2 * o / (a.total() + b.total()), 6) if a or b else 0.0


def test_extract_evaluate(spark, world):
    got = {r.cid: (r.recall, r.f1) for r in rows(spark, "extract_evaluate")}
    assert got.keys() == world["ranks"].keys() and len(got) == 20
    for c, ranked in world["ranks"].items():
        text = [w for t in extract(ranked[:90], 250, True, 0.6) for w in t[3]][:250]
        each = [rouge_n(text, r, 2) for r in world["refs"][c].values()]
        assert got[c] == pytest.approx((sum(x[1] for x in each) / len(each), sum(x[2] for x in each) / len(each)), abs=2e-6)


def test_graph_orders(spark, world):
    got = {n: defaultdict(list) for n in ("lexrank_rank", "wan_rank", "mmr_rank")}
    for n, out in got.items():
        for r in sorted(rows(spark, n), key=lambda r: r.pos):
            out[r.cid].append(((r.doc_id, r.sent_idx), r.score))
    for c, ranked in world["ranks"].items():
        ranked = ranked[:90]
        size, score = len(ranked), [-r[0] for r in ranked]
        sim = [[cosine(a[3], b[3]) if i != j else 0.0 for j, b in enumerate(ranked)] for i, a in enumerate(ranked)]
        total = sum(score)
        # lexrank: many rounds of the power iteration
        p = start = [s / total for s in score]
        mass = [sum(row) for row in sim]
        for _ in range(200):
            p = [0.85 * sum(p[i] * (sim[i][j] / mass[i] if mass[i] else start[j]) for i in range(size)) + 0.15 * start[j] for j in range(size)]
        own = dict(got["lexrank_rank"][c])
        assert all(abs(own[ranked[i][1:3]] - p[i]) < 2e-6 for i in range(size))
        values = [v for _, v in got["lexrank_rank"][c]]
        assert values == sorted(values, reverse=True)
        # each pick of the others has the best value left; a pick's value is what its rule says
        place = {r[1:3]: i for i, r in enumerate(ranked)}
        for name in ("wan_rank", "mmr_rank"):
            left, now, near = set(range(size)), [s / total for s in score], [0.0] * size
            for k, (key, value) in enumerate(got[name][c]):
                i = place[key]
                worth = {j: now[j] if name == "wan_rank" or not k else 0.7 * score[j] / total - 0.3 * near[j] for j in left}
                assert i in left and abs(worth[i] - value) < 2e-6 and worth[i] >= max(worth.values()) - 1e-9
                left.remove(i)
                for j in left:
                    now[j] -= 10 * (sim[j][i] / mass[j] if mass[j] else 0.0) * score[i] / total
                near = [max(x, sim[j][i]) for j, x in enumerate(near)]
            assert not left


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_rouge_l(spark, world):
    got = {(r.cid, r.doc_id, r.sent_idx, r.ref_idx): (r.lcs, r.f1) for r in rows(spark, "rouge_l")}
    assert len(got) == sum(len(world["refs"][c]) for c, _, _ in world["sents"] if c in world["refs"])
    for key in random.Random(1).sample(sorted(got), 1500):
        a, b = words_of(world["sents"][key[:3]]), world["refs"][key[0]][key[3]]
        n = common(a, b)
        assert got[key] == (n, round(2 * n / (len(a) + len(b)), 6) if a or b else 0.0)


def test_stemmed_rouge(spark, world):
    got = {(r.cid, r.doc_id, r.sent_idx): (r.overlap, r.f1) for r in rows(spark, "stemmed_rouge")}
    assert got.keys() == world["sents"].keys()
    known = {}
    stems = lambda ws: [known[w] if w in known else known.setdefault(w, stem(w)) for w in ws]
    for key, s in world["sents"].items():
        o, _, f = rouge_n(stems(words_of(s)), stems(world["refs"][key[0]][0]), 1)
        assert got[key] == (o, pytest.approx(f, abs=1.1e-6))


def skip_units(w):
    marked = ["@start-token", *w]
    return Counter(w) + Counter((a, b) for i, a in enumerate(marked) for b in marked[i + 1 : i + 6])


def test_system_scores(spark, world):
    got = {r.n: (r.recall, r.f1, r.n_clusters) for r in rows(spark, "system_scores")}
    means = defaultdict(list)
    for c, refs in world["refs"].items():
        text = [stem(w) for r in world["ranks"].get(c, [])[:30] for w in r[3]][:250]
        refs = {k: [stem(w) for w in ws] for k, ws in refs.items()}
        for n in ("1", "2", "su4", "l"):
            each = []
            for ref in refs.values():
                if n in "12":
                    each.append(rouge_n(text, ref, int(n))[1:])
                else:
                    a, b = (skip_units(text).total(), skip_units(ref).total()) if n == "su4" else (len(text), len(ref))
                    o = (skip_units(text) & skip_units(ref)).total() if n == "su4" else common(text, ref)
                    each.append((o / b if b else 0.0, 2 * o / (a + b) if a + b else 0.0))
            means[n].append([sum(x) / len(each) for x in zip(*each, strict=True)])
    assert got.keys() == means.keys()
    for n, values in means.items():
        recall, f1 = (sum(x) / len(values) for x in zip(*values, strict=True))
        assert got[n] == (pytest.approx(recall, abs=2e-6), pytest.approx(f1, abs=2e-6), 20)


def test_intervals_equal_a_plain_bootstrap(spark):
    rng = random.Random(2)
    data = [(f"u{i}", "ab"[i % 2], round(rng.random(), 7), round(rng.random(), 7)) for i in range(60)]
    df = spark.createDataFrame(data, "unit string, n string, recall double, f1 double").repartition(5)
    got = {r.n: r for r in rouge.bootstrap(df, F.col("unit"), ["n"], ["recall", "f1"], replicates=300, confidence=90).collect()}
    drawn = []
    for n in "ab":
        own, means = [r for r in data if r[1] == n], {2: [], 3: []}
        for k in range(1, 301):
            h = [int(hashlib.md5(f"{r[0]}:{k}".encode()).hexdigest()[:8], 16) for r in own]
            w = [sum(x >= t for t in rouge.POISSON) for x in h]
            drawn += w
            for m in means:
                means[m].append(sum(a * r[m] for a, r in zip(w, own, strict=True)) / sum(w))
        for m, name in ((2, "recall"), (3, "f1")):
            low, high = np.quantile(means[m], [0.05, 0.95])
            assert (got[n][name], got[n][name + "_low"], got[n][name + "_high"]) == (pytest.approx(sum(r[m] for r in own) / 30, abs=6e-6), pytest.approx(low, abs=6e-6), pytest.approx(high, abs=6e-6))
            assert got[n][name + "_low"] < got[n][name] < got[n][name + "_high"]
    counts = Counter(drawn)  # a Poisson distribution with mean 1
    assert all(abs(counts[k] / len(drawn) - 0.36788 / (1, 1, 2, 6)[k]) < 0.01 for k in range(4))


def test_system_intervals_lie_around_the_scores(spark):
    scores = {r.n: r for r in rows(spark, "system_scores")}
    for r in rows(spark, "system_intervals"):
        assert r.n_units == scores[r.n].n_clusters and r.recall == pytest.approx(scores[r.n].recall, abs=1e-5) and r.f1_low <= r.f1 <= r.f1_high


def test_tune_topk(spark, world):
    got = {r["var"]: (r.recall, r.f1) for r in rows(spark, "tune_topk")}
    assert sorted(got) == list(range(1, 31))
    for k in (1, 7, 30):
        each = []
        for c, refs in world["refs"].items():
            text = [w for r in world["ranks"].get(c, [])[:k] for w in r[3]]
            own = [rouge_n(text, ref, 2)[1:] for ref in refs.values()]
            each.append([sum(x) / len(own) for x in zip(*own, strict=True)])
        assert got[k] == pytest.approx([sum(x) / len(each) for x in zip(*each, strict=True)], abs=2e-6)


def test_sample_clusters(spark, world):
    got = defaultdict(list)
    for r in sorted(rows(spark, "sample_cluster_build")):
        got[f"src{r.cluster_id}"].append(r.sample_id)
    text = {d: words_of(t) for _, d, t in world["docs"]}
    for c, ranked in world["ranks"].items():
        best = {}
        for score, d, _, _ in ranked:
            best[d] = min(best.get(d, 0), score)
        order = [d for _, d in sorted((s, d) for d, s in best.items())][:11]
        taken, missed = order[:1], 0
        for d in order[1:]:
            if max(cosine(text[d], text[t]) for t in taken) >= 0.6:
                continue
            size = sum(len(text[t]) for t in taken)
            if abs(size + len(text[d]) - 250) <= abs(size - 250):
                taken.append(d)
            else:
                missed += 1
                if missed == 5:
                    break
        assert got[c] == taken


def test_subsummaries(spark):
    talks = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{DIR}/conversations.parquet").where("role = 'assistant'").select("conv_id", "turn", "text").collect()):
        talks[r.conv_id].append(r.text)
    for r in rows(spark, "subsummary_integration"):
        parts, left, out = [p for p in talks[r.conv_id] if p], 60.0, []
        for k, part in enumerate(parts):
            share, seen = left / (len(parts) - k), 0
            for sent in sentences_of(part):
                seen += len(words_of(sent))
                if seen >= share:
                    break
                out.append(sent)
            left -= seen
        assert r.text == (parts[0] if len(parts) == 1 else " ".join(out))


def test_swapped_ranks(spark, world):
    got = defaultdict(list)
    for r in sorted(rows(spark, "swapped_ranks"), key=lambda r: (r.cid, r.pos)):
        got[r.cid].append((-r.score, r.doc_id, r.sent_idx))
    moved = 0
    for c, ranked in world["ranks"].items():
        before = [r[:3] for r in ranked[:30]]
        place = [before.index(x) for x in got[c]]
        assert sorted(place) == list(range(len(before))) and all(place[place[i]] == i for i in range(len(place)))  # pairs that changed places
        moved += sum(i != p for i, p in enumerate(place))
    assert 0.2 < moved / sum(map(len, got.values())) < 0.7


def test_masked_summaries(spark, world):
    got = {r.cid: r for r in rows(spark, "masked_summaries")}
    assert len(got) == len(world["items"])
    for i, text in world["items"]:
        w, r = words_of(text), got[str(i)]
        base = [k for k in range(len(w)) if k % 5 in (0, 4)]
        shown = r.masked.split(" ") if r.masked else []
        assert r.n_revealed == sum(x != "[MASK]" for x in shown) >= int(len(base) + (len(w) - len(base)) * 0.3)
        assert all((a, b) != ("[MASK]", "[MASK]") for a, b in zip(shown, shown[1:], strict=False))
        at = iter(w)
        assert all(x == "[MASK]" or any(x == y for y in at) for x in shown)  # words in their order


def test_random_mask(spark, world):
    got = defaultdict(dict)
    for r in rows(spark, "random_mask_ablation"):
        got[int(r.cid)][r.i] = r.word
    for i, text in world["items"]:
        w = words_of(text)
        own = [got[i][k] for k in range(len(w))]
        assert sum(x != "[MASK]" for x in own) == int(len(w) * 0.3) and all(x in (y, "[MASK]") for x, y in zip(own, w, strict=True))


def test_every_query_without_sql_is_here():
    here = {"lexrank_rank", "wan_rank", "mmr_rank", "rouge_l", "stemmed_rouge", "system_scores", "subsummary_integration", "swapped_ranks", "masked_summaries", "random_mask_ablation"}
    here |= {"wordpiece_ids", "system_intervals"}  # tests/test_wordpiece.py, and here
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == here


def test_sentence_scores(spark, world, tmp_path):
    sents = tables.sentences(tables.documents(spark, DIR))
    refs = tables.references(spark, DIR).where("ref_idx = 0").select("cid", "ref_idx", T.tokens(F.col("text")).alias("words"))
    drivers.sentence_scores(sents, refs, f"{tmp_path}/scores", 10, 20)
    got = {r.sid: r for r in spark.read.json(f"{tmp_path}/scores").collect()}
    want = {f"{c}_{d}_{i}": rouge_n(words_of(s), world["refs"][c][0], 2) for (c, d, i), s in world["sents"].items() if 10 <= d < 20}
    assert got.keys() == want.keys() and all(got[k].rouge_2_f1 == pytest.approx(v[2], abs=1.1e-6) for k, v in want.items())


def test_masking_statistics(spark):
    parse = [("a", [(["x", "y"], [(["B-ARG0", "O"],)], "x y")]), ("b", [])]
    df = spark.createDataFrame(parse, "cid string, open_ie array<struct<words: array<string>, verbs: array<struct<tags: array<string>>>, raw_sentence: string>>")
    out = mask.masked_summaries(df, mask.Masking(ratio=1.0, max_words=1))
    assert {r.cid: (r.masked_seq, r.n_revealed, r.n_base) for r in out.collect()} == {"a": (["x"], 2, 1), "b": ([], 0, 0)}
    stats = mask.statistics(out).first()
    assert (stats.n_summaries, stats.without_base, stats.mean_revealed) == (2, 1, 1.0)
