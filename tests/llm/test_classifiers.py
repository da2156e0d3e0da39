from pyspark.sql import functions as F

from conftest import SMALL
from modelsift.llm import quality_model, toxicity
from modelsift.llm.common import held_out, table
from odd_rows import no_documents, odd_documents  # noqa: F401

LARGER = "/root/testdata/sf0.1"


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    return rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_held_out_accuracy(spark):
    documents, labels = table(spark, LARGER, "documents").select("doc_id", "text"), table(spark, LARGER, "labels")
    scored = quality_model.quality_scores(documents, quality_model.fitted(documents, labels))
    assert accuracy(scored, labels, "quality") > 0.97
    scored = toxicity.toxicity_scores(documents, toxicity.fitted(documents, labels))
    assert accuracy(scored, labels, "toxic") > 0.93


def test_learning_leaves_held_out_labels_alone(spark):
    documents, labels = table(spark, SMALL, "documents").select("doc_id", "text"), table(spark, SMALL, "labels")
    hidden = F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    a = toxicity.toxicity_scores(documents, toxicity.fitted(documents, labels))
    b = toxicity.toxicity_scores(documents, toxicity.fitted(documents, labels.withColumn("toxic", hidden)))
    assert a.exceptAll(b).count() == 0


def test_odd_rows(spark, odd_documents, no_documents):
    labels = table(spark, SMALL, "labels")
    for module, score in ((quality_model, quality_model.quality_scores), (toxicity, toxicity.toxicity_scores)):
        model = module.fitted(table(spark, SMALL, "documents").select("doc_id", "text"), labels)
        rows = score(odd_documents, model).collect()
        assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
        by_id = {r.doc_id: r.score for r in rows}
        assert by_id[1] == by_id[2] == by_id[None] and by_id[4] == by_id[5]
        assert score(no_documents, model).count() == 0
        unlabelled = module.fitted(odd_documents.select("doc_id", "text"), labels.filter("false"))
        assert score(odd_documents, unlabelled).select("score").distinct().count() == 1
