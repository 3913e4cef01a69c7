"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from leafgrid.llm import decontamination, toxicity
from leafgrid.llm.common import table

DATA = "/root/testdata/sf0.01"


def test_stages_decide_and_keep_columns(spark):
    docs = table(spark, DATA, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, seen[-1], DATA)
        if name != "packing":
            assert made.columns == docs.columns
        seen.append(made.cache())
    _, calm, single, clean, masked, packed = seen
    labels = table(spark, DATA, "labels")
    toxic = labels.where("toxic = 1").join(docs, "doc_id").count()
    assert calm.join(labels.where("toxic = 1"), "doc_id").count() < 0.3 * toxic  # some labelled texts were overwritten by junk
    assert calm.join(labels.where("toxic = 0"), "doc_id").count() > 0.97 * labels.where("toxic = 0").join(docs, "doc_id").count()
    assert single.select("text").distinct().count() == single.count() < calm.count()
    assert decontamination.matches(clean, table(spark, DATA, "benchmark")).count() == 0 < single.count() - clean.count()
    assert masked.count() == clean.count() and masked.where("n_chars <> length(text)").count() == 0
    assert masked.where("text rlike 'token = \"[0-9a-f]{40}'").count() == 0 < clean.where("text rlike 'token = \"[0-9a-f]{40}'").count()
    assert packed.select("doc_id").distinct().count() == masked.count()
    assert isinstance(toxicity.train_on(docs, labels), toxicity.Grammar)


def test_stages_take_awkward_rows(spark):
    """Null ids and texts, repeats, an empty text and a clashing column pass every stage; an empty table stays empty."""
    small = "/root/testdata/sf0.001"
    rows = [(None, "no id here at all", "keep"), (None, None, "keep"), (1, None, "keep"), (2, "", "keep"), (2, "", "keep"), (3, "one two three", "keep"), (4, "one two three", "keep"), (5, "x" * 100_000, "keep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string").repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0
        made = stage(spark, docs, small).cache()
        if name == "packing":
            continue
        assert made.columns == docs.columns and {r["kept_id"] for r in made.collect()} == {"keep"}
        docs = made
    assert {(r["doc_id"], r["text"]) for r in docs.collect()} >= {(1, None), (2, ""), (3, "one two three"), (5, "x" * 100_000)}
    assert made.where("piece = 0").count() == docs.count()
