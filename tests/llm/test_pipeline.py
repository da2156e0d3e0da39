import re

import corpus_pipeline
from conftest import SMALL
from modelsift.llm import packing, toxicity
from modelsift.llm.common import prepare, table
from modelsift.session import written
from odd_rows import no_documents, odd_documents  # noqa: F401


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    columns, seen = docs.columns, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(prepare(spark), docs, SMALL), f"test-{name}")
        seen[name] = docs
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    assert all(seen[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])

    model = toxicity.fitted(seen["documents"].select("doc_id", "text"), table(spark, SMALL, "labels"))
    scores = toxicity.toxicity_scores(seen["documents"], model)
    assert sorted(ids["toxicity"]) == sorted(r.doc_id for r in scores.filter("predicted = 0").collect())

    sets = {}
    for r in seen["toxicity"].collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text))
        sets[r.doc_id] = set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) > 4 else {tuple(w)}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    label = {i: i for i in sets}
    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if label[a] != label[b] and link(a, b):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert sorted(ids["near_duplicates"]) == sorted(set(label.values()))

    assert sorted(ids["personal_data"]) == sorted(ids["near_duplicates"])
    assert seen["personal_data"].filter("text rlike '@mail[0-9]+[.]example'").count() == 0
    mixed = ids["mixture"]
    assert set(mixed) <= set(ids["personal_data"]) and max(mixed.count(i) for i in set(mixed)) <= 2
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in seen["mixture"].collect())
    placed = seen["packing"].collect()
    assert sum(r.length for r in placed) == words
    assert {r.capacity for r in placed} <= set(packing.CAPACITIES)


def test_rows_that_repeat_an_id(spark):
    """Copies of one row under one id leave one; other texts of that id stay."""
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six")]
    rows += [(3, "some thing else"), (3, "and another text"), (None, "some thing else"), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert found == [(0, "some thing else"), (1, rows[0][1]), (3, "and another text"), (3, "some thing else"), (4, ""), (5, "")]


def test_stages_on_an_empty_table_and_odd_rows(spark, odd_documents, no_documents):
    for docs in (no_documents, odd_documents):
        columns, odd = docs.columns, docs is odd_documents
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(prepare(spark), docs, SMALL), f"test-{name}")
            assert docs.columns == columns or name == "packing"
            assert odd or docs.isEmpty()
        assert not odd or docs.filter("doc_id = 9").agg({"length": "sum"}).first()[0] % 30_000 == 0
