import random
from collections import Counter

from modelsift.llm import mixing


def test_copies_follow_each_rows_own_times(spark):
    """Rows without an id and rows that repeat one, in sources taken less than once, once and twice."""
    rng = random.Random(5)
    rows = []
    for source, n in (("a", 200), ("b", 10), ("c", 90), (None, 20)):
        for _ in range(n):
            doc_id = rng.choice([None, 1, 2, len(rows) + 10, len(rows) + 10])
            rows.append((doc_id, " ".join([f"w{len(rows)}"] * rng.randint(1, 30)), source))
    rows += [(None, None, "a"), (7, None, None), (8, "same text", "b"), (8, "same text", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = mixing.mixed_documents(docs).collect()
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source, r.size] += r.times
    copies = mixing.mixed_copies(docs).collect()
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in copies)
    assert got == +want
    assert {r.times for r in plan if r.size} == {0, 1, 2} and {r.times for r in plan if r.doc_id is None} >= {0, 1}

    per_row = Counter((r.doc_id, r.text, r.source) for r in copies)
    assert set(per_row) <= set(rows) and max(n / rows.count(k) for k, n in per_row.items()) <= mixing.EPOCHS
    words = Counter()
    for r in copies:
        words[r.source] += len(r.text.split())
    for r in plan:
        assert abs(words[r.source] - r.target) <= 30


def test_no_text_is_shuffled(spark):
    """The texts go from the reader to the result; only rows at a split cut are grouped."""
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 9 + 1), "ab"[i % 2]) for i in range(60)], "doc_id bigint, text string, source string")
    plan = mixing.mixed_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_rows_alike_at_the_cut(spark):
    """One row repeated: the cut goes through the middle of equal rows, and the number of copies is exact."""
    rows = [(1, "a b c", "x")] * 7 + [(2, "a b", "y")] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = Counter()
    for r in mixing.mixed_documents(docs).collect():
        want[r.doc_id] += r.times
    assert Counter(r.doc_id for r in mixing.mixed_copies(docs).collect()) == +want
    assert 40 < want[2] < 80 or 7 < want[1] < 14


def test_odd_copies(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string, times int, size string")
    assert mixing.mixed_copies(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", None, 3, "s"), (None, None, "q", None, None), (2, " ", "q", 1, "t")], empty.schema)
    copies = mixing.mixed_copies(clash)
    assert copies.columns == clash.columns and {r.doc_id for r in copies.collect()} <= {1}
