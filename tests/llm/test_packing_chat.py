import json
import random
from itertools import product


from hypothesis import given
from hypothesis import strategies as st

from modelsift.llm import packing, tool_calls
from odd_rows import no_documents, odd_documents  # noqa: F401


@given(st.lists(st.integers(1, 100), max_size=60))
def test_bins_hold_their_pieces(lengths):
    sizes = (10, 30, 100)
    bins, offsets, capacity = packing.packed(lengths, sizes)
    contents = {}
    for i, b in enumerate(bins):
        contents.setdefault(b, []).append((offsets[i], lengths[i], capacity[i]))
    for pieces in contents.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))]
        used = sum(p[1] for p in pieces)
        assert {p[2] for p in pieces} == {min(c for c in sizes if c >= used)}


def test_packing_fills_well():
    lengths = [(i * 37) % 400 + 20 for i in range(1000)]
    bins, _, capacity = packing.packed(lengths)
    total = sum({b: c for b, c in zip(bins, capacity, strict=True)}.values())
    assert sum(lengths) / total > 0.95


def least_cost(lengths, sizes):
    """The least total cost of all ways to share out the pieces, by trying them all."""
    best = float("inf")
    for where in product(range(len(lengths)), repeat=len(lengths)):
        used = {}
        for b, n in zip(where, lengths, strict=True):
            used[b] = used.get(b, 0) + n
        if max(used.values()) <= max(sizes):
            best = min(best, sum(packing.cost(min(c for c in sizes if c >= u)) for u in used.values()))
    return best


def test_small_cases_against_all_packings():
    rng = random.Random(11)
    ratios = []
    for _ in range(150):
        lengths = [rng.randint(1, 4096) for _ in range(rng.randint(1, 5))]
        bins, _, capacity = packing.packed(lengths)
        got = sum(packing.cost(c) for c in {b: c for b, c in zip(bins, capacity, strict=True)}.values())
        ratios.append(got / least_cost(lengths, packing.CAPACITIES))
    assert min(ratios) >= 1 - 1e-12 and max(ratios) <= 1.5
    assert sum(r < 1 + 1e-9 for r in ratios) >= 100 and sum(ratios) / len(ratios) <= 1.05


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 3), st.integers(0, 2)), max_size=40))
def test_no_bin_holds_two_copies_of_a_document(pieces):
    copies = [(d, c) if d else None for _, d, c in pieces]
    bins, _, _ = packing.packed([n for n, _, _ in pieces], (20, 40, 100), copies)
    held = {}
    for b, owner in zip(bins, copies, strict=True):
        if owner:
            assert held.setdefault((b, owner[0]), owner[1]) == owner[1]


def test_copies_are_numbered_and_kept_apart(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(1, 900))) for i in range(300)]
    rows = rows * 2 + [(5, "another text of that id"), (None, "a b"), (None, "a b"), (None, "c d e")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, copy int, text_key int")
    placed = packing.best_fit(docs)
    got = placed.collect()
    assert sorted((r.doc_id, r.copy) for r in got if r.doc_id is not None) == sorted(
        [(i, c) for i in range(300) for c in (0, 1)] + [(5, 2)])
    in_bin = {}
    for r in got:
        if r.doc_id is not None:
            assert in_bin.setdefault((r.bin, r.doc_id), r.copy) == r.copy
    texts = packing.packed_texts(docs, placed).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in texts) == sorted(((i if i else -1), t) for i, t in rows)


def test_packing_odd_rows(spark, odd_documents, no_documents):
    placed = packing.best_fit(odd_documents)
    rows = placed.collect()
    long_one = sorted((r for r in rows if r.doc_id == 9), key=lambda r: r.piece)
    assert sum(r.length for r in long_one) == 30_000 and [r.start for r in long_one] == [4096 * i for i in range(8)]
    assert all((r.bin is None) == (r.length == 0) for r in rows) and len(rows) == odd_documents.count() + 7
    texts = {(r.doc_id, r.piece): r.text for r in packing.packed_texts(odd_documents.filter("doc_id in (1, 9)"), placed.filter("doc_id in (1, 9)")).collect()}
    whole = odd_documents.filter("doc_id = 9").first().text
    assert " ".join(texts[9, i] for i in range(8)) == whole
    assert packing.best_fit(no_documents).count() == 0


CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"
MESSAGES = "conv_id bigint, turn bigint, role string, content string"


def linked(spark, calls, results, messages=()):
    return tool_calls.linked_chat(
        spark.createDataFrame(list(messages), MESSAGES),
        spark.createDataFrame(calls, CALLS),
        spark.createDataFrame(results, RESULTS),
    )


def test_linking_order_and_validation(spark):
    calls = [
        (1, 5, "a", "lookup", '{"query": "x", "limit": 3}', []),
        (1, 2, "b", "lookup", '{"limit": "3", "zz": {"b": 1, "a": 2}}', ["a"]),  # needs a result that comes later
        (1, 7, "b", "lookup", '{"query": "y"}', []),
        (1, 8, "c", "other", "{}", None),
        (2, 0, "a", "translate", "not json", []),
        (None, 0, None, None, None, None),
    ]
    results = [(1, 1, "a", "ra"), (1, 3, "b", "rb"), (2, 1, "zz", "lost")]
    rows = linked(spark, calls, results, [(1, 0, "system", 'say "hi"')]).collect()
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(7))
    at = {(r.kind, r.call_id, r.status): r.position for r in one}
    assert at["call", "a", "linked"] < at["result", "a", "linked"] < at["call", "b", "linked"] < at["result", "b", "linked"]
    by = {(r.conv_id, r.kind, r.call_id, r.status): r for r in rows}
    assert by[1, "call", "a", "linked"].errors == ""
    assert by[1, "call", "b", "linked"].errors == "type limit,missing query,unknown zz" or set(
        by[1, "call", "b", "linked"].errors.split(",")
    ) == {"type limit", "missing query", "unknown zz"}
    assert by[1, "call", "b", "linked"].json == '{"limit":"3","zz":{"a":2,"b":1}}'
    assert by[1, "call", "c", "unanswered"].errors == "unknown tool"
    assert by[2, "call", "a", "unanswered"].errors == "not an object"
    assert by[2, "result", "zz", "orphan"].json == '{"content":"lost"}'
    assert json.loads(by[1, "message", None, "message"].json) == {"content": 'say "hi"'}


def test_cycles_end_and_are_marked(spark):
    calls = [(1, 0, "a", "lookup", "{}", ["b"]), (1, 1, "b", "lookup", "{}", ["a"])]
    rows = linked(spark, calls, [(1, 2, "a", "x"), (1, 3, "b", "y")]).collect()
    assert len(rows) == 4 and "cyclic" in {r.status for r in rows}


def test_empty_log(spark):
    assert linked(spark, [], []).count() == 0


def by_hand(calls, results):
    """Places and cycle members of one log by plain recursion: {event: (turn, steps)}, {events on a cycle}."""
    first = {}
    for conv, turn, cid, name, arguments, after in calls:
        if cid is not None:
            first[conv, cid] = min(first.get((conv, cid), (turn, name, arguments, after)), (turn, name, arguments, after))
    last = {}
    for conv, turn, cid, _ in results:
        last[conv, cid] = max(last.get((conv, cid), turn), turn)
    turns = {("call", *k): v[0] for k, v in first.items()} | {("result", *k): t for k, t in last.items() if k in first}
    needs = {e: [] for e in turns}
    for (conv, cid), v in first.items():
        needs["call", conv, cid] = [("result", conv, i) for i in v[3] or [] if ("result", conv, i) in turns]
        if ("result", conv, cid) in turns:
            needs["result", conv, cid] = [("call", conv, cid)]
    reach = {}
    for e in turns:
        seen, todo = set(), list(needs[e])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += needs[n]
        reach[e] = seen
    cyclic = {e for e in turns if e in reach[e]}
    done = {}

    def place(e):
        if e not in done:
            open_needs = [n for n in needs[e] if not (n in reach[e] and e in reach[n])]
            done[e] = max([(turns[e], 0)] + [(t, h + 1) for t, h in map(place, open_needs)])
        return done[e]

    return {e: place(e) for e in turns}, cyclic


def test_order_and_cycles_against_plain_recursion(spark):
    rng = random.Random(7)
    calls, results = [], []
    for conv in range(60):
        n = rng.randint(1, 9)
        for i in range(n):
            after = [str(rng.randrange(n)) for _ in range(rng.choice((0, 1, 1, 2)))]
            if conv % 2:  # no cycles: only lower identifiers are needed
                after = [a for a in after if int(a) < i]
            calls.append((conv, rng.randint(0, 6), str(i), "lookup", "{}", after))
            if rng.random() < 0.9:
                results.append((conv, rng.randint(0, 8), str(i), "x"))
    places, cyclic = by_hand(calls, results)
    assert cyclic and any(e not in cyclic for e in places)
    rows = linked(spark, calls, results).collect()
    assert len(rows) == len(calls) + len(results)
    assert {(r.kind, r.conv_id, r.call_id) for r in rows if r.status == "cyclic"} == cyclic
    for conv in range(60):
        got = [(r.kind, conv, r.call_id) for r in sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position)]
        assert got == sorted(got, key=lambda e: (places[e], e[0] == "result", e[2]))


def chain(conv, n, closed):
    """n calls, each of which needs the next one's result, written in the order that is most wrong."""
    after = lambda i: [str(i + 1)] if i + 1 < n else ["0"] if closed else []
    calls = [(conv, i, str(i), "lookup", "{}", after(i)) for i in range(n)]
    return calls, [(conv, 0, str(i), "r") for i in range(n)]


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    rounds = []
    doubled = tool_calls._doubled
    monkeypatch.setattr(tool_calls, "_doubled", lambda *a: rounds.append(1) or doubled(*a))
    calls, results = chain(1, 500, closed=False)
    rows = linked(spark, calls, results).collect()
    assert len(rounds) <= 11 and not [r for r in rows if r.status == "cyclic"]
    at = {(r.kind, int(r.call_id)): r.position for r in rows}
    assert all(at["call", i] < at["result", i] for i in range(500))
    assert all(at["result", i + 1] < at["call", i] for i in range(499))

    rounds.clear()
    calls, results = chain(1, 500, closed=True)
    calls.append((1, 0, "behind", "lookup", "{}", ["7"]))
    rows = linked(spark, calls, results + [(1, 0, "behind", "r")]).collect()
    assert len(rounds) <= 40
    assert sorted(r.call_id for r in rows if r.status != "cyclic") == ["behind", "behind"] and len(rows) == 1002
    at = {(r.kind, r.call_id): r.position for r in rows}
    assert at["result", "7"] < at["call", "behind"] < at["result", "behind"]


def test_odd_events(spark):
    """Null turns come first, equal rows stay, nulls and empty texts are told apart, further columns do no harm."""
    same = (1, 3, "a", "lookup", '{"query": "x"}', None)
    calls = [same, same, (1, None, "b", "lookup", None, ["a", None]), (None, None, "", None, "", None), (None, None, None, None, "", None)]
    results = [(1, None, "a", None), (1, None, "a", ""), (1, 4, None, "x" * 300_000), (None, 0, "", "")]
    frames = [spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)]
    frames = [f.selectExpr("*", "1 as first", "2 as status", "3 as k", "4 as position", "5 as json") for f in frames]
    rows = tool_calls.linked_chat(spark.createDataFrame([(1, None, None, None)] * 2, MESSAGES), *frames).collect()
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(8)) and [r.kind for r in one[:2]] == ["message", "message"]
    assert [(r.kind, r.status) for r in one[2:4]] == [("call", "linked")] * 2  # equal rows
    assert {r.json for r in one[4:6]} == {"{}", '{"content":""}'} and {r.call_id for r in one[4:6]} == {"a"}
    assert (one[6].call_id, one[6].status, one[6].errors) == ("b", "unanswered", "not an object")
    assert one[7].status == "orphan" and len(one[7].json) > 300_000
    assert sorted((r.kind, r.call_id, r.status) for r in rows if r.conv_id is None and r.call_id is not None) == [
        ("call", "", "linked"), ("result", "", "linked")]
