import os
import tempfile

import pytest

from docsift.sources.corpus import read_corpus_csv


def test_csv_ingest_latin1(spark):
    d = tempfile.mkdtemp(prefix="docsift-csv-")
    p = os.path.join(d, "in.csv")
    with open(p, "wb") as f:
        f.write('Title,ABSTRACT\nA,"multi\nline ""q"" é"\nB,NA\nC,   \nD,x\n'.encode("latin-1"))
    from docsift.operators.corpus import clean_corpus
    df = clean_corpus(read_corpus_csv(spark, p))
    rows = sorted((r.title, r.abstract) for r in df.collect())
    assert rows == [("A", 'multi\nline "q" é'), ("D", "x")]


def test_missing_columns(spark):
    d = tempfile.mkdtemp(prefix="docsift-csv-")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write("name,text\na,b\n")
    with pytest.raises(ValueError):
        read_corpus_csv(spark, p)


def test_missing_file(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_corpus_csv(spark, "/nonexistent/docsift.csv").count()


def test_stream_word_counts_match_batch(spark):
    import os
    import tempfile
    from docsift.streaming.ingest import start_word_counts
    from docsift.plans import queries as Q
    out = tempfile.mkdtemp(prefix="docsift-stream-")
    src = "/root/testdata/sf0.001"
    # stream only the documents file: point the source at a folder with it
    folder = tempfile.mkdtemp(prefix="docsift-src-")
    os.symlink(os.path.join(src, "documents.parquet"), os.path.join(folder, "documents.parquet"))
    q1, q2 = start_word_counts(spark, folder, os.path.join(out, "rows"), name="t_wc")
    q1.processAllAvailable()
    q2.processAllAvailable()
    tot = spark.sql("SELECT * FROM t_wc_totals").first()
    q1.stop()
    q2.stop()
    batch = [r for r in Q.q_word_counts(spark, src).collect() if r.Title == "__TOTAL__"][0]
    assert (tot.Words_Before, tot.Words_After) == (batch.Words_Before, batch.Words_After)
    assert spark.read.parquet(os.path.join(out, "rows")).count() == tot.n_docs


def test_row_key_contiguous_in_scan_order(spark):
    from docsift.sources.corpus import with_doc_id
    df = spark.range(0, 1000, numPartitions=7).withColumnRenamed("id", "v")
    got = with_doc_id(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000))
    assert all(r.doc_id == r.v for r in got)
