"""Archives and substrings where time or memory could grow faster than the input."""

import gzip
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lexisift.llm import archives, substrings
from lexisift.llm.shared import Scope

RECORD = archives.warc_record(archives.ArcRecord("http://x/", "0.0.0.0", "20260101000000", "text/html", archives.http_response(b"z" * 700, "text/html", 5)))


def read(data, **steps):
    return sum(1 for _ in archives.parse_warc(archives.unzipped(data, **steps)))


def test_reader_takes_time_in_proportion():
    took = []
    for n in (5_000, 20_000):
        data = gzip.compress(RECORD * n)
        began = time.process_time()
        assert read(data) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


@pytest.mark.parametrize("step, most", [(1 << 16, 1 << 20), (7, 11), (1, 1)])
def test_members_and_pieces(step, most):
    members = gzip.compress(RECORD) * 9
    assert read(members, step=step, most=most) == 9
    assert max(map(len, archives.unzipped(gzip.compress(b"\0" * 3_000_000), step, max(most, 1000)))) <= max(most, 1000)
    assert b"".join(archives.unzipped(RECORD * 3, step, most)) == RECORD * 3


def test_cut_members_raise():
    members = gzip.compress(RECORD) * 3
    for cut in (1, 5, 9, 100, len(members) - 5):
        with pytest.raises(ValueError):
            read(members[:-cut])
    whole = zlib.compressobj(wbits=31)
    between = whole.compress(RECORD) + whole.flush(zlib.Z_SYNC_FLUSH)  # ends after a record, but not the member
    with pytest.raises(ValueError):
        read(between)
    with pytest.raises(ValueError):
        read(gzip.compress(RECORD[:-200]))


def test_archives_go_with_their_scope(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    with Scope() as scope:
        out = archives.archived(pages, scope=scope)
        assert out.count() == 1
        path = spark._jvm.org.apache.hadoop.fs.Path(out._lexisift_path)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert system.exists(path)
    assert not system.exists(path)


@pytest.mark.parametrize("doc_id", [7, None])
def test_many_equal_rows(spark, doc_id):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(600))
    docs = spark.range(3000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    began = time.time()
    got = substrings.substring_dedup(docs).groupBy("n_words", "n_removed").count().collect()
    assert [tuple(r) for r in got] == [(600, 600, 3000)]
    assert time.time() - began < 90  # quadratic, it took this for 1,600 rows


def test_long_text_that_repeats_itself(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_WORDS", 1_000)
    monkeypatch.setattr(substrings, "TASK_WORDS", 10_000)
    docs = spark.createDataFrame([(1, "a " * 200_000 + "b c d"), (2, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.substring_dedup(docs).collect())
    assert got == [(1, 200_003, 200_000), (2, 3, 0)]
