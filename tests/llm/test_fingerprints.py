"""Multiset fingerprints: equality, order, insertion and deletion, edited texts."""

import hashlib

from pyspark.sql import functions as F

from cases import frame
from shelfprice.llm import fingerprints, queries
from shelfprice.llm.common import table


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}


def edited(texts):
    out = []
    for i, own in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(own) // 2
        out.append(own[:len(own) - half] + after[:half])
    return out


def test_query_equals_brute_force(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    rows = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, folder).collect()}
    texts = [r["text"] or "" for r in docs]
    changed = edited(texts)
    assert len(rows) == len(docs)
    for r, own, new in zip(docs, texts, changed, strict=True):
        got = rows[r["doc_id"]]
        assert got["n_chars"] == len(own)
        assert got["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got["near_edited"] <= 1 and 0 <= got["near_next"] <= 1
        if own == new:
            assert got["fingerprint"] == got["edited_fingerprint"] and got["near_edited"] == 1
    by_text = {}
    for r, own in zip(docs, texts, strict=True):
        by_text.setdefault(own, set()).add(rows[r["doc_id"]]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert len({min(x) for x in by_text.values()}) == len(by_text)
    nearer = [rows[r["doc_id"]]["near_edited"] > rows[r["doc_id"]]["near_next"] for r in docs]
    assert sum(nearer) > 0.9 * len(nearer)


def test_edited_fingerprint_is_that_of_the_edited_text(spark):
    texts = ["One line. Two.\nNext line.", "Short.", "", "Again one line.\n\nAnd more of it, much more."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["edited_fingerprint"] for r in fingerprints.edited_pairs(df).collect()}
    assert got == prints(spark, edited(texts))


def test_order_does_not_matter_but_number_does(spark):
    p = prints(spark, ["a\nb\nc", "c\na\nb", "a\nb", "a\nb\nc\nc", "", None, "a\nb\n\nc"])
    assert p[0] == p[1] and p[4] == p[5]
    assert len({p[k] for k in (0, 2, 3, 4, 6)}) == 5


def test_insert_and_delete(spark):
    texts = ["First one. Second.", "Third line.", "First one. Second.\nThird line."]
    df = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    lanes = {r["doc_id"]: r["lanes"] for r in df.collect()}
    row = spark.createDataFrame([(lanes[0], lanes[1], lanes[2])], f"a {df.schema['lanes'].dataType.simpleString()}, "
                                f"b {df.schema['lanes'].dataType.simpleString()}, c {df.schema['lanes'].dataType.simpleString()}")
    got = row.select(
        (fingerprints.as_text(fingerprints.added(F.col("a"), F.col("b"))) == fingerprints.as_text(F.col("c"))).alias("in_"),
        (fingerprints.as_text(fingerprints.removed(F.col("c"), F.col("b"))) == fingerprints.as_text(F.col("a"))).alias("out"),
    ).first()
    assert got["in_"] and got["out"]


def test_awkward_rows(spark):
    got = fingerprints.edited_pairs(frame(spark)).collect()
    assert len(got) == frame(spark).count()
    assert all(r["fingerprint"] and r["edited_sha256"] for r in got)


def test_single_and_no_row(spark):
    one = fingerprints.edited_pairs(frame(spark, [(5, "abcd", "en", "a", 4)])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.edited_pairs(frame(spark, [])).count() == 0
