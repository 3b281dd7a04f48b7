"""Word pieces are those of the tokenizers library, on every text of the tables and on odd ones."""

import hashlib
import random
import unicodedata

import pytest
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from lexisift.functions import wordpiece
from lexisift.plans import catalogue, learned

DIR = "/root/testdata/sf0.001"


def library(pieces, lower=True):
    t = Tokenizer(models.WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer, t.pre_tokenizer = normalizers.BertNormalizer(lowercase=lower), pre_tokenizers.BertPreTokenizer()
    return t


@pytest.fixture(scope="module")
def pieces():
    return learned.pieces()


def test_query_equals_the_library(spark, pieces):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_pieces, r.n_unknown, r.ids_md5) for r in catalogue.queries()["wordpiece_ids"](spark, DIR).collect()}
    t, unknown = library(pieces), pieces.index("[UNK]")
    assert got.keys() == texts.keys()
    for (doc_id, _), e in zip(texts.items(), t.encode_batch(list(texts.values())), strict=True):
        assert got[doc_id] == (len(e.ids), e.ids.count(unknown), hashlib.md5(",".join(map(str, e.ids)).encode()).hexdigest())


@pytest.mark.parametrize("table, column", [("pages", "html"), ("benchmark", "text"), ("conversations", "text")])
def test_other_tables(spark, pieces, table, column):
    own, t = wordpiece.WordPiece(pieces), library(pieces)
    texts = [r[0] or "" for r in spark.read.parquet(f"{DIR}/{table}.parquet").select(column).collect()]
    for text, e in zip(texts, t.encode_batch(texts), strict=True):
        assert own.encode(text) == e.ids


@pytest.mark.parametrize("lower", [True, False])
def test_odd_texts(pieces, lower):
    own, t, rng = wordpiece.WordPiece(pieces, lower), library(pieces, lower), random.Random(3)
    odd = ["", " ", "a" * 100, "a" * 101, "##ing ##", "[UNK] [CLS]", "ΑΣ Σ ΟΔΟΣ", "İstanbul ǅ ß ẞ", "é é ñ", "中文 test 中", "a b c​d﻿e\x00f\x07g\x7f", "� 　x", "don't—stop…“q”", "１２ ｶﾞ", "\x85\x1c\x1fa"]
    # letters that have been in Unicode for long: the library's tables are older than Python's
    old = unicodedata.ucd_3_2_0
    assigned = [c for c in map(chr, range(0x10000)) if old.category(c) not in ("Cn", "Cs", "Co") and old.category(c) == unicodedata.category(c)]
    odd += ["".join(rng.choice(rng.choice([assigned, "abcdefg -.,"])) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    wrong = [x for x in odd if own.encode(x) != t.encode(x).ids]
    assert not wrong, [ascii(x) for x in wrong[:5]]


def test_longest_match_and_unknown_words(spark, tmp_path):
    own = wordpiece.WordPiece(["[UNK]", "un", "unable", "##able", "##a", "##b", "a", "##x"])
    assert own.encode("unable unab unablex unc") == [2, 1, 4, 5, 2, 7, 0]
    with pytest.raises(ValueError):
        wordpiece.WordPiece(["a"])
    (tmp_path / "v.txt").write_text("[UNK]\na\n##b\n")
    rows = wordpiece.word_pieces(spark.createDataFrame([(1, "k", "ab a c"), (2, "k", None), (None, "", "")], "doc_id long, ids string, text string"), wordpiece.vocabulary(str(tmp_path / "v.txt")), "doc_id")
    assert sorted((str(r.doc_id), r.ids, r.n_unknown) for r in rows.collect()) == [("1", [1, 2, 1, 0], 1), ("2", [], 0), ("None", [], 0)]
