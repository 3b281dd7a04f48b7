"""Sentence boundaries: abbreviations, initials, ordinals and starters learned from a small corpus, and the rules one by one."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexisift.functions import punkt
from lexisift.functions.punkt import Punkt
from lexisift.sources import tables


def split(spark, model, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.s for r in df.select("i", model.sentences("text").alias("s")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(4)
    names, verbs = "Meyer Olsen Park Quint Reed Stone".split(), "saw met called helped paid".split()
    nouns = "harbour ferry council engineer letter wall river boat".split()
    texts = []
    for _ in range(300):
        out = []
        for _ in range(8):
            a, b, n = rng.choice(names), rng.choice(names), rng.choice(nouns)
            out.append(rng.choice([f"Dr. {a} {rng.choice(verbs)} Mr. {b} at the {n}.", f"The {n} was near the {rng.choice(nouns)}, etc. and so on.", f"{a} {rng.choice(verbs)} J. {b} on the 3. October at the {n}.", f"However the {n} had the {rng.choice(nouns)}!", f"Was the {n} there?"]))
        texts.append((" ".join(out),))
    texts += [(None,), ("",)]
    return punkt.train(spark.createDataFrame(texts, "text string"))


def test_what_is_learned(learned):
    assert {"dr", "mr", "etc"} <= learned.abbreviation
    assert not learned.abbreviation & {"harbour", "ferry", "council", "engineer", "letter", "wall", "river", "boat"}
    assert {"however", "was"} <= learned.starter and "## october" in learned.collocation
    assert "the" in learned.low and "meyer" not in learned.low


def test_learned_boundaries(spark, learned):
    text = "Dr. Meyer met J. Olsen on the 3. October at the wall. However the wall, etc. was there. The boat had the letter! Was the ferry there? Mr. Park paid."
    assert split(spark, learned, text) == [["Dr. Meyer met J. Olsen on the 3. October at the wall.", "However the wall, etc. was there.", "The boat had the letter!", "Was the ferry there?", "Mr. Park paid."]]


def test_rules(spark):
    m = Punkt(abbreviation=frozenset({"dr", "e.g", "it's"}), head=frozenset({"the"}), low=frozenset({"the", "of"}), starter=frozenset({"however"}), collocation=frozenset({"## january"}), tail=frozenset({"iphone"}))
    cases = {
        "I saw Dr. Smith. He left.": ["I saw Dr. Smith.", "He left."],
        "We met the dr. The end.": ["We met the dr.", "The end."],  # an abbreviation at the end: only lower-cased types begin anew
        "We met the dr. However it is.": ["We met the dr.", "However it is."],
        "So e.g. cats. Dogs too.": ["So e.g. cats.", "Dogs too."],
        "On the 3. January it rained. It was 1999. Then 4. of them came.": ["On the 3. January it rained.", "It was 1999.", "Then 4. of them came."],
        "By J. Smith. And J. Of it.": ["By J. Smith.", "And J.", "Of it."],
        "Wait... what? Wait... The end.": ["Wait... what?", "Wait...", "The end."],
        '"Stop!" he said. ("Yes.") Fine.': ['"Stop!"', "he said.", '("Yes.")', "Fine."],
        "It's it's. the \\ quote' s.": ["It's it's. the \\ quote' s."],
        "a  b\n\ncc. d": ["a b cc.", "d"],
    }
    assert split(spark, m, *cases) == list(cases.values())
    assert split(spark, Punkt(), None, "", "  ", "A bb. C d") == [[], [], [], ["A bb.", "C d"]]


def test_likelihood_equals_its_definition(spark):
    def plain(a, b, ab, n):
        part = lambda k, m, p: (k * math.log(p) if k else 0) + ((m - k) * math.log(1 - p) if m - k else 0)
        p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
        return -2 * (part(ab, a, p) + part(b - ab, n - a, p) - part(ab, a, p1) - part(b - ab, n - a, p2))

    rows = [(10, 20, 5, 1000), (10, 20, 10, 1000), (10, 20, 0, 1000), (20, 20, 20, 50)]
    df = spark.createDataFrame(rows, "a long, b long, ab long, n long")
    got = [r[0] for r in df.select(punkt.log_likelihood("a", "b", "ab", "n")).collect()]
    assert got == pytest.approx([plain(*r) for r in rows])


def test_tables_are_bounded_and_sentences_take_a_model(spark):
    docs = spark.createDataFrame([("c", 1, "Dr. Who came. He left."), ("c", 2, None)], "cid string, doc_id long, text string")
    rows = punkt.model_tables(docs.select("text"), most=1).groupBy("kind").count().collect()
    assert all(r["count"] == 1 for r in rows)
    got = tables.sentences(docs, Punkt(abbreviation=frozenset({"dr"}))).orderBy("sent_idx").collect()
    assert [(r.cid, r.doc_id, r.sent_idx, r.sent) for r in got] == [("c", 1, 0, "Dr. Who came."), ("c", 1, 1, "He left.")]
    assert punkt.train(docs.limit(0).select(F.col("text"))) == Punkt()


def test_words_are_read_and_described_once(spark, monkeypatch):
    docs = spark.createDataFrame([("Dr. Ada\tmet  him. He left!  So",), (None,), ("",), (" \n",)], "text string")
    found = {(r.before, r.word): r.c for r in punkt.word_pairs(docs).collect()}
    assert found == {(None, "Dr."): 1, ("Dr.", "Ada"): 1, ("", "met"): 1, ("", "him."): 1, ("him.", "He"): 1, ("", "left! "): 1, ("left! ", "So"): 1}
    calls = []
    monkeypatch.setattr(punkt, "word_pairs", lambda rows, f=punkt.word_pairs: calls.append(1) or f(rows))
    tables = []
    model = punkt.model_tables(docs, tables=tables)
    plan = model._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and len(tables) == 3
    assert "MapInArrow" not in plan and not re.search(r"\bcore#", plan)  # neither the texts nor what is made of single words comes back
    assert Punkt().boundary("x", "y").count("regexp_replace") <= 6  # 20 when each use of a word's type made it anew


def _many(n):
    """Different words of small letters, in their order."""
    return ["".join(chr(97 + i // 26**k % 26) for k in (3, 2, 1, 0)) for i in range(n)]


def test_a_model_is_whole(spark):
    words = _many(5200)
    docs = spark.createDataFrame([(" ".join(f"stop! {w}" for w in words[i : i + 100]),) for i in range(0, len(words), 100)], "text string")
    rows = punkt.model_tables(docs).collect()
    for kind in ("low", "head", "tail"):
        assert {r.entry for r in rows if r.kind == kind} == set(words)
    assert len(punkt.train(docs).tail) == len(words)


def test_rare_words_decide_boundaries(spark, tmp_path):
    from lexisift.plans import learned

    words = _many(5100)
    texts = [" ".join(f"stop! {w}" for w in words[i : i + 100] * 3) for i in range(0, len(words), 100)] + ["stop! zzzz", "It rained on 3. zzzz came."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = learned.punkt_sentences(spark, str(tmp_path)).where(f"doc_id = {len(texts) - 1}").orderBy("sent_idx").collect()
    assert [(r.sent_idx, r.sent) for r in got] == [(0, "It rained on 3."), (1, "zzzz came.")]  # "zzzz" begins a sentence in lower case elsewhere


@pytest.mark.parametrize("held", [0, 4, 10**6])
def test_sentences_of_a_corpus_equal_those_of_its_model(spark, held):
    rng = random.Random(held)
    words = ["Dr.", "dr.", "etc.", "3.", "1999.", "J.", "j.", "wait...", '("Yes.")', "Stop!", "what?\"", "end.", "end.\u2028", "The", "the", "However", "january", "ox", "—", ".", "\xa0a.", "Ärzte", "it's."]
    texts = [rng.choice([" ", "  ", "\n", "\t "]).join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(150)]
    rows = [(i % 140, t) for i, t in enumerate([*texts, None, "", " \n"])]  # an id twice is two texts
    docs = spark.createDataFrame(rows, "`the id` int, text string").repartition(3)
    model = punkt.train(docs)
    want = docs.select("the id", F.posexplode(model.sentences("text")).alias("sent_idx", "sent"))
    got = punkt.sentences_of(docs, ["the id"], held)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert model.abbreviation and model.head and model.low
