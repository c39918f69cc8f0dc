"""The pipeline: each stage on what the one before kept."""

import corpus_pipeline
from cases import documents, frame
from shelfprice.llm import mixing, near_dedup, pseudonyms, quality_rules, queries
from shelfprice.operators.staging import stage


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, apply in corpus_pipeline.STAGES:
        before, docs = docs, stage(apply(spark, docs, folder))
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "quality_rules":
            verdicts = quality_rules.quality(before).where("kept").collect()
            assert ids == {r["doc_id"] for r in verdicts}
        if name == "near_dedup":
            assert ids == {r["class_id"] for r in near_dedup.near_duplicates(before).collect()} and len(ids) == kept[name]
        if name == "pseudonyms":
            assert kept[name] == before.count()
            want = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(before, queries.PSEUDONYM_KEY).collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
        if name == "mixing":
            assert kept[name] == sum(r["copies"] for r in mixing.mix(before).collect())
    assert kept["quality_rules"] < len(documents(folder))
    assert len(corpus_pipeline.STAGES) == 5


def test_awkward_documents(spark, tmp_path):
    frame(spark, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[-1] == "offset"
    frame(spark, [], clashes=False).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
