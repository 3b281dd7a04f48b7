"""Scalar functions, folds and readers against golden rows and plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.stem import stem
from lexisift.operators import mask, rank, rouge, select
from lexisift.plans import catalogue
from lexisift.sources import readers, sinks, tables


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()[0]


def test_stem():
    pairs = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "falling": "fall", "happy": "happi", "agreed": "agre", "sky": "sky", "controlling": "control", "probate": "probat"}
    assert {w: stem(w) for w in pairs} == pairs


@pytest.mark.parametrize("n,bucket", [(99, 85), (100, 100), (101, 100), (201, 190), (250, 250), (399, 385), (400, 400), (401, 400)])
def test_length_token(spark, n, bucket):
    assert _one(spark, T.length_token(F.col("n")), n=n) == f"[unused{bucket}]"


def test_masks(spark):
    assert _one(spark, T.mask_question(F.col("s")), s="What causes rain?") == "[MASK] causes rain."
    assert _one(spark, T.mask_question(F.col("s")), s="Describe rain. Show it") == "[MASK] rain. s[MASK] it".replace("[MASK] rain", "describe rain")
    assert _one(spark, T.mask_question(F.col("s")), s="Describe rain.") == "[MASK] rain."
    assert _one(spark, T.merge_masks(F.col("w")), w=["[MASK]", "[MASK]", "a", "[MASK]", "[MASK]"]) == ["[MASK]", "a", "[MASK]"]
    assert _one(spark, T.join_subqueries(F.col("w")), w=["a b.", "c"]) == "a b [SUBQUERY] c"


def test_small_functions(spark):
    assert _one(spark, T.detokenised(F.col("s")), s="it ' s $ 3 , 000 and 3 . 5 . . .") == "it 's $ 3,000 and 3.5 ..."
    assert _one(spark, T.missing_period(F.col("s")), s="no end") == "no end ."
    assert _one(spark, T.title_text(F.col("a"), F.col("b")), a="Rain.", b="Why?") == "describe Rain. Why?"
    assert _one(spark, T.ngrams(F.col("w"), 3), w=["a", "b"]) == []
    assert _one(spark, T.normal_sentence(F.col("s"), min_words=3), s="  Two  words ") is None
    f = T.pair_features(F.col("a"), F.col("b"), 8)
    assert _one(spark, F.struct(*f.values()), a=["x"], b=["y", "z"])[0] == ["[CLS]", "x", "[SEP]", "y", "z", "[SEP]", "[PAD]", "[PAD]"]


def _pop(a, b, most):
    while a + b > most:
        if a > b:
            a -= 1
        else:
            b -= 1
    return a, b


def test_pair_lengths(spark):
    rows = spark.createDataFrame([(a, b) for a in range(0, 30, 3) for b in range(0, 30, 2)], "a int, b int")
    for most in (11, 12):
        for r in rows.select("a", "b", *[c.alias(k) for c, k in zip(T.pair_lengths(F.col("a"), F.col("b"), most), "xy", strict=True)]).collect():
            assert (r.x, r.y) == _pop(r.a, r.b, most)


def test_confidence_keeps_all_without_a_total(spark):
    rows = spark.createDataFrame([("c", 1, 0.0), ("c", 2, 0.0), ("d", 1, 3.0), ("d", 2, 1.0), ("d", 3, 1.0)], "cid string, rank int, score double")
    kept = rank.confident(rows, 0.6, "cid").groupBy("cid").count().collect()
    assert {r.cid: r["count"] for r in kept} == {"c": 2, "d": 1}


def test_retrieval_filters(spark):
    rows = spark.createDataFrame([("c", i, float(10 - i)) for i in range(10)], "cid string, i int, score double")
    assert rank.retrieved(rows, "cid", "i", filter="topK", var=3).count() == 3
    assert rank.retrieved(rows, "cid", "i", filter="comp", var=0.25, least=4).count() == 4
    with pytest.raises(ValueError):
        rank.retrieved(rows, "cid", filter="x")


def test_greedy_budget_and_redundancy():
    rows = [{"words": w.split()} for w in ("a b c d", "a b c d", "e f g h", "a b x y", "i j k l")]
    assert [r["words"][0] for r in select.greedy_rows(rows, 9, "words", 0.6)] == ["a", "e", "a"]
    assert len(select.greedy_rows(rows, 9, "sentences", 0.6, block=2)) == 3
    assert len(select.greedy_rows(rows, 2, "sentences", 1)) == 2
    assert [r["words"] for r in select.greedy_rows(rows, 4, "sentences", 0.6, skips=0)] == [r["words"] for r in rows[:4]]


def test_orders():
    sim = np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0]], float)
    score = np.array([0.5, 0.4, 0.1])
    assert [i for i, _ in select.wan_order(score, sim)] == [0, 2, 1]
    assert [i for i, _ in select.mmr_order(score, sim, 0.5)] == [0, 2, 1]
    p = select.lexrank_scores(np.ones((4, 4)), np.ones(4))
    assert np.allclose(p, 0.25)
    for f in (select.wan_order, select.mmr_order):
        with pytest.raises(ValueError):
            f(score, sim, -1)


FOUR = ("the dog ate food quickly".split(), [["B-ARG0", "I-ARG0", "B-V", "B-ARG1", "O"]])


def test_reveal():
    words, facts = FOUR
    how = lambda **o: mask.Masking(**o)
    assert mask.reveal([(words, [])], how())[0] == [words]
    # without the verb as a slot it is no part of its fact, and shows from the start
    assert mask.reveal([FOUR], how(ratio=1.0))[0] == [words]
    (one,), n = mask.reveal([FOUR], how(ratio=0.0))  # one slot even so
    assert one in (["the", "dog", "ate", "[MASK]", "quickly"], ["[MASK]", "ate", "food", "quickly"]) and n in (3, 4)
    (verb,), n = mask.reveal([FOUR], how(ratio=0.0, verb_as_slot=True))
    assert verb[-1] == "quickly" and n in (2, 3) and "[MASK]" in verb
    # words outside of facts count, but are left out; a sentence of masks only is empty
    assert mask.reveal([FOUR], how(ratio=1.0, remove_base=True))[0] == [["the", "dog", "food"]]
    assert mask.reveal([(words, [["B-V"] * 5])], how(remove_base=True, ratio=0.0))[0] == [[]]
    inside = (["a", "b"], [["B-ARG0", "B-ARG1"]])
    assert sorted(mask.reveal([inside], how(rand_expose=True, ratio=0.0))[0][0]) == ["a", "b"]  # one from the start, one more at least
    assert mask.reveal([([], [])], how())[0] == [[]] and mask.reveal([], how())[0] == []
    for wrong in (how, lambda **o: mask.Masking(func_ratio=1.5)):
        with pytest.raises(ValueError):
            wrong(ratio=1.5)
    assert how(ratio=0.3).name() == "reveal_0.3" and how(remove_base=True, max_words=9).name() == "reveal_0.0-remove_base-max_words-9"


def test_reveal_reaches_its_goal():
    rng = np.random.default_rng(4)
    for k in range(200):
        summary = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(1, 15))
            facts = [[str(rng.choice(["O", "B-V", "B-ARG0", "B-ARG1", "B-ARG2"])) for _ in range(n)] for _ in range(rng.integers(0, 4))]
            summary.append(([f"w{i}" for i in range(n)], facts))
        for verb in (False, True):
            for func in (1.0, 0.5):
                how = mask.Masking(ratio=float(rng.random()), verb_as_slot=verb, func_ratio=func)
                roles = ("V", "ARG0", "ARG1", "ARG2") if verb else ("ARG0", "ARG1", "ARG2")
                base = [[all(not t[i].endswith(roles) for t in facts) for i in range(len(words))] for words, facts in summary]
                parts, shown = mask.reveal(summary, how, str(k))
                assert (parts, shown) == mask.reveal(summary, how, str(k))
                outside = sum(map(sum, base))
                start = sum(sum(b) if func == 1 or sum(b) < 2 else int(sum(b) * func) for b in base)
                goal = int(start + (sum(map(len, base)) - outside) * how.ratio)
                assert goal <= shown <= sum(map(len, base)) - outside + start
                if func == 1.0:
                    for (words, _), b, part in zip(summary, base, parts, strict=True):
                        assert [w for w, x in zip(words, b, strict=True) if x] == [w for w in part if w in {words[i] for i in range(len(words)) if b[i]}]


def test_rouge(spark):
    sys_ = spark.createDataFrame([("c", ["a", "b", "a"])], "cid string, words array<string>")
    ref = spark.createDataFrame([("c", 0, ["a", "b", "c", "d"])], "cid string, ref_idx int, words array<string>")
    r = rouge.scores(sys_, ref, ["cid"], 1).first()
    assert (r.overlap, r.recall, r.precision) == (2, 0.5, 0.666667)
    same = rouge.scores(ref.select("cid", "words"), ref, ["cid"], 2).first()
    assert same.recall == same.f1 == 1
    assert _one(spark, rouge.common_subsequence(F.col("a"), F.col("b")), a=list("abcbdab"), b=list("bdcaba")) == 4
    grams = _one(spark, rouge.skip_units(F.col("w"), 1), w=["a", "b", "c"])
    assert Counter(grams) == Counter(["a", "b", "c", "@start-token a", "@start-token b", "a b", "a c", "b c"])


def test_sentences_meet_every_reference(spark):
    folder = "/root/testdata/sf0.001"
    refs = {(r.cid, r.ref_idx): r.w for r in tables.references(spark, folder).select("cid", "ref_idx", T.tokens(F.col("text")).alias("w")).collect()}
    sents = {(r.doc_id, r.sent_idx): (r.cid, r.w) for r in tables.sentences(tables.documents(spark, folder)).select("cid", "doc_id", "sent_idx", T.tokens(F.col("sent")).alias("w")).collect()}
    assert len(refs) > len({c for c, _ in refs})

    rows = catalogue.queries()["rouge_l"](spark, folder).collect()
    assert len(rows) == len({(r.doc_id, r.sent_idx, r.ref_idx) for r in rows}) == sum(c == x for c, _ in sents.values() for x, _ in refs)

    def pairs(w):
        w = ["@start-token", *w]
        return Counter(w[1:]) + Counter(f"{a} {b}" for i, a in enumerate(w) for b in w[i + 1 : i + 6])

    units = {k: pairs(w) for k, w in refs.items()}
    want = {}
    for (doc, i), (c, w) in sents.items():
        own = pairs(w)
        for (x, j), u in units.items():
            if x == c:
                n = (own & u).total()
                want[doc, i, j] = (n, 2 * n / max(1, own.total() + u.total()))
    rows = catalogue.queries()["rouge_su4"](spark, folder).collect()
    got = {(r.doc_id, r.sent_idx, r.ref_idx): (r.overlap, r.f1) for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)


def test_readers(spark, tmp_path):
    (tmp_path / "doc").write_text("<HEADLINE> Rain </HEADLINE>\n<TEXT>\n<P>\nRain fell. It stopped.\n</P>\n</TEXT>")
    doc = readers.articles(spark, str(tmp_path / "doc")).first()
    assert doc.paragraphs == ["Rain fell. It stopped."]
    (tmp_path / "topics").write_text("<num> C1 </num>\n<title> Rain </title>\n<narr>\nWhat causes rain?\n</narr>\n\n\nnone\n\n\n<num> C2 </num>")
    assert [tuple(r)[1:] for r in readers.topics(spark, str(tmp_path / "topics")).collect()] == [(0, "C1", "Rain", "What causes rain?")]
    (tmp_path / "src").write_text("one ||||| two\nthree")
    (tmp_path / "tgt").write_text("- Sum\n- Two")
    rows = readers.parallel(spark, str(tmp_path / "src"), str(tmp_path / "tgt")).orderBy("line_no").collect()
    assert rows[0].stories == ["one ", " two"] and rows[1].summary == "Two"
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/x.story").write_text("Body line\n\n@highlight\n\nFirst point")
    (tmp_path / "b/x.story").write_text("Other")
    (tmp_path / "b/y.story").write_text("Only body.")
    s = {r.did: r for r in readers.stories(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert s["x"].article == ["Body line ."] and s["x"].highlights == ["First point ."] and s["y"].highlights == []
    (tmp_path / "rank").write_text("0_4\t0.83\tRain fell.\n0_1\t0.2\tIt stopped.")
    ranks = readers.rank_lists(spark, str(tmp_path / "rank")).orderBy("rank")
    assert [(r.rank, r.sid, r.score) for r in ranks.collect()] == [(1, "0_4", 0.83), (2, "0_1", 0.2)]
    lines = sinks.rank_lines(ranks.withColumn("cid", F.lit("c")), with_rank=True).orderBy("rank").collect()
    assert lines[0].line == "1\t0_4\t0.83\tRain fell."
    sinks.write_ranks(ranks.withColumn("run", F.lit("r")).withColumn("cid", F.lit("c")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="exist"):
        sinks.write_ranks(ranks.withColumn("run", F.lit("r")).withColumn("cid", F.lit("c")), str(tmp_path / "out"))


def test_spare_skips():
    rows = [{"i": i, "words": w.split()} for i, w in enumerate(["a b", "a b", "a b c", "d e", "a b", "f"])]
    taken = lambda budget: [r["i"] for r in select.greedy_rows(rows, budget, "sentences", 0.5, skips="spare")]
    assert taken(3) == [0, 3, 5]
    assert taken(4) == [0, 3, 4, 5]  # two may be passed over, then all is taken
    assert taken(6) == taken(9) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        select.greedy_rows(rows, 3, "words", 0.5, skips="spare")


def test_what_a_normal_sentence_needs_is_made_once(spark):
    options = dict(min_words=2, drop_dialogue=True, quoted_speech=True, stop_words=("the",))
    made = T.normal_sentence(F.col("s"), **options)
    assert str(made._jc).count("lower(s)") <= 1
    sents = ["The  Cat Sat", "the the", "one", "''a b", "'he said so", " \n", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sents)], "i int, s string").select("i", made.alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == ["cat sat", None, None, None, None, None, None]
