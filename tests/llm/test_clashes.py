"""Clashing column names, null and equal ids: what operators that return whole rows do with them."""
from docsift.llm.decontam import decontaminate
from docsift.llm.line_dedup import line_dedup
from docsift.llm.ngram_join import keep_one
from docsift.llm.pii import pseudonymise
from docsift.llm.quality_rules import keep_good

NAMES = ["_d", "_gone", "_bad", "_spans", "_gaps", "_found", "_new", "_drop", "row", "key", "gone", "of", "spans", "bad",
         "found", "new", "gaps", "t", "comp", "a.b"]
SAME = "one two three four five six seven eight nine ten eleven"
OTHER = "quite another text that nobody else has and that shares no words with them"


def frame(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(d, t, *NAMES) for d, t in rows], schema)


def check(df, out, extra=()):
    assert out.columns == df.columns + list(extra)
    rows = out.collect()
    assert all([r[c] for c in NAMES] == NAMES for r in rows)
    return sorted(((r.doc_id, r.text) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_clashing_columns_and_ids(spark):
    bench = spark.createDataFrame([(1, SAME)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(None, SAME), (1, SAME), (1, OTHER), (2, None), (2, ""), (3, OTHER + " 129.38.82.176"), (4, SAME), (4, SAME)]
    df = frame(spark, rows)
    plain = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    # the null id is the least, of id 1 only the linked text goes
    assert check(df, keep_one(df)) == [r for r in plain if r[1] != SAME or r[0] is None][:2] + [
        r for r in plain if r[0] == 2]
    assert check(df, decontaminate(df, bench)) == [r for r in plain if r[1] != SAME]
    assert check(df, decontaminate(df, bench, action="span")) == sorted(
        [(d, " " * 10 if t == SAME else t) for d, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    long_ = [(None, " ".join(f"w{i}" for i in range(60))), (1, " ".join(f"v{i}" for i in range(60))), (1, "short"), (2, None)]
    assert check(df, keep_good(frame(spark, long_), labels)) == long_[:2]
    kinds = [f"n_{k}" for k in ("email", "ip", "iban", "date", "ssn", "phone", "card")]
    new = check(df, pseudonymise(df, "k"), kinds)
    assert [r for r in new if r[0] != 3] == [r for r in plain if r[0] != 3] and new[-3][1] != plain[-3][1]
    apart = [(None, SAME + "\n" + OTHER), (5, SAME.upper()), (6, None), (7, "")]
    assert check(df, line_dedup(frame(spark, apart))) == [(None, SAME + "\n" + OTHER), (5, ""), (6, None), (7, "")]
