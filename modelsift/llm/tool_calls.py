"""Chat formatting with linked tool calls.

Calls and results are joined by (conversation, identifier). Every event has a place (turn, step): a result must
come after its call, and a call after the results that it names in `after`. An event that would stand before
what it needs is moved right behind it, so its place is the greatest (turn of x, length of the walk) over all walks of
needs from any x to it. Walks are doubled in length each round, so the rounds grow with the logarithm of the longest run
of moved events; they end once no place changes. Where places still change after as many steps as a conversation has
events, there are cycles of needs: events on a cycle get status `cyclic`, the needs inside a cycle are dropped, and
the rest is ordered as before; an event behind a cycle keeps its status and stands behind what it needs. Arguments are
checked against the schema of the tool and written as canonical JSON: no blanks, keys sorted at every depth.

The walks of one length are distinct pairs of events: as many as there are needs in chains, trees and layers; where events
need several of their predecessors and stand in the wrong order, more, at worst the square of that run.

calls(conv_id, turn, call_id, name, arguments, after array of call ids), results(conv_id, turn, call_id, content),
other messages(conv_id, turn, role, content); further columns are not looked at. Of several calls with one identifier the
first (turn, name, arguments) is linked, the others stay as events with status `duplicate`; equal rows share their place
and their status. Results without a call are `orphan`, calls without a result `unanswered`; of several results of a
call the latest is the one that others need. Null identifiers link with nothing; null or unreadable arguments are
invalid. Null turns come first, null conversations are one of their own. Texts are kept whole. Positions come from one
sort of all events, so a conversation of any size is no task of its own. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm.common import OWN, ranked, table, word_count
from modelsift.session import written

# Argument -> (type, required). Types as schema_of_variant names them.
Schemas = dict[str, dict[str, tuple[str, bool]]]
SCHEMAS: Schemas = {
    "lookup": {"query": ("STRING", True), "limit": ("BIGINT", False)},
    "summarize": {"text": ("STRING", True), "words": ("BIGINT", True)},
    "translate": {"text": ("STRING", True), "target": ("STRING", True)},
}

KINDS = ("message", "call", "result")  # in this order at equal places
FIRST_TURN = -(1 << 63)  # stands for a null turn where places are compared


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, comma-joined; empty when they are valid."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    by_tool = F.lit("unknown tool")
    for tool, fields in schemas.items():
        found = []
        for field, (kind, required) in fields.items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            there = F.array_contains(keys, field)
            found.append(F.when(there & (F.schema_of_variant(value) != kind), F.lit(f"type {field}")))
            if required:
                found.append(F.when(~there, F.lit(f"missing {field}")))
        extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in fields])))
        unknown = F.transform(extra, lambda k: F.concat(F.lit("unknown "), k))
        wrong = F.array_join(F.concat(F.array_compact(F.array(*found)), unknown), ",")
        by_tool = F.when(name == tool, wrong).otherwise(by_tool)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object | keys.isNull(), F.lit("not an object")).otherwise(by_tool)


def canonical(arguments: Column) -> Column:
    return F.to_json(F.try_parse_json(arguments))


def _told_apart(*parts: Column) -> Column:
    """One text of several values; nulls differ from empty texts and keep their place."""
    return F.to_json(F.struct(*[p.cast("string").alias(f"c{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"})


def _events(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """All events, with a node of their own, the node that links to them and the nodes that they need."""
    messages = messages.select("conv_id", "turn", "role", "content")
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    results = results.select("conv_id", "turn", "call_id", "content")
    c, conv = _told_apart, F.col("conv_id")
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments")).alias("first"))
    first = first.filter("call_id is not null").select(
        F.col("conv_id").alias("fc"), F.col("call_id").alias("fi"), "first"
    )
    same = lambda df: F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("call_id") == F.col("fi"))
    answered = results.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("answers")).select(
        F.col("conv_id").alias("ac"), F.col("call_id").alias("ai"), "answers"
    )
    call = (
        calls.join(first, same(calls), "left")
        .join(answered, F.col("conv_id").eqNullSafe(F.col("ac")) & (F.col("call_id") == F.col("ai")), "left")
        .withColumn("is_first", F.struct("turn", "name", "arguments").eqNullSafe(F.col("first")))
    )
    wrong = argument_errors(F.col("name"), F.col("arguments"), schemas)
    status = (
        F.when(F.col("first").isNotNull() & ~F.col("is_first"), "duplicate")
        .when(F.col("answers").isNull(), "unanswered")
        .otherwise("linked")
    )
    node = F.when(F.col("first").isNotNull() & F.col("is_first"), c(conv, F.lit("call"), F.col("call_id")))
    needs = F.transform(F.coalesce("after", F.array().cast("array<string>")), lambda i: c(conv, F.lit("result"), i))
    call = call.select(
        "conv_id", "turn", F.lit(1).alias("kind"), "call_id", "name", canonical(F.col("arguments")).alias("json"),
        status.alias("status"), wrong.alias("errors"), node.alias("node"), needs.alias("needs"),
    )
    result = results.join(first, same(results), "left").select(
        "conv_id",
        "turn",
        F.lit(2).alias("kind"),
        "call_id",
        F.col("first.name").alias("name"),
        F.to_json(F.struct("content")).alias("json"),
        F.when(F.col("first").isNull(), "orphan").otherwise("linked").alias("status"),
        F.lit("").alias("errors"),
        F.when(F.col("first").isNotNull(), c(conv, F.lit("result"), F.col("call_id"))).alias("node"),
        F.when(F.col("first").isNotNull(), F.array(c(conv, F.lit("call"), F.col("call_id"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("needs"),
    )
    message = messages.select(
        "conv_id",
        "turn",
        F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("call_id"),
        F.col("role").alias("name"),
        F.to_json(F.struct("content")).alias("json"),
        F.lit("message").alias("status"),
        F.lit("").alias("errors"),
        F.lit(None).cast("string").alias("node"),
        F.array().cast("array<string>").alias("needs"),
    )
    return message.unionByName(call).unionByName(result)


def _doubled(walks: DataFrame, name: str) -> DataFrame:
    """walks(a, b) from a to b, all of one length, as walks of twice that length."""
    on = walks.select(F.col("a").alias("m"), F.col("b").alias("e"))
    return written(walks.join(on, F.col("b") == F.col("m")).select("a", F.col("e").alias("b")).distinct(), name)


def _raised(places: DataFrame, needs: DataFrame, longest: int) -> tuple[DataFrame, DataFrame | None]:
    """(places with every event behind what it needs, None); with cycles (any places, walks of at least longest steps)."""
    walks, step = needs, 1
    while True:
        to = walks.join(places, F.col("a") == F.col("k")).groupBy("b").agg(
            F.max(F.struct("t", (F.col("h") + step).alias("h"))).alias("to")
        )
        higher = F.coalesce(F.col("to") > F.struct("t", "h"), F.lit(False))
        places = places.join(to, F.col("k") == F.col("b"), "left").select(
            "k",
            F.when(higher, F.col("to.t")).otherwise(F.col("t")).alias("t"),
            F.when(higher, F.col("to.h")).otherwise(F.col("h")).alias("h"),
            higher.alias("up"),
        )
        places = written(places, "chat-places")
        if places.filter("up").isEmpty():
            return places, None
        if step >= longest:
            return places, walks
        walks, step = _doubled(walks, "chat-walks"), 2 * step


def _inside_cycles(needs: DataFrame, longest: int) -> DataFrame:
    """The needs whose two events lie on a common cycle.

    Every event learns the least hash that reaches it and the least that it reaches; needs between events that differ in
    one of these lie on no cycle and are dropped, until none is. Then each group of linked events reaches all of itself.
    """
    while True:
        ends = needs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        label = F.struct(F.xxhash64("k"), F.col("k"))
        least = written(ends.select("k", label.alias("up"), label.alias("down"), F.lit(True).alias("new")), "chat-least")
        walks, step = needs, 1
        while not least.filter("new").isEmpty() and step < 2 * longest:
            now = least.select("k", "up", "down")
            up = walks.join(now, F.col("a") == F.col("k")).groupBy(F.col("b").alias("uk")).agg(F.min("up").alias("u"))
            down = walks.join(now, F.col("b") == F.col("k")).groupBy(F.col("a").alias("dk")).agg(F.min("down").alias("d"))
            least = now.join(up, F.col("k") == F.col("uk"), "left").join(down, F.col("k") == F.col("dk"), "left").select(
                "k",
                F.least("up", "u").alias("up"),
                F.least("down", "d").alias("down"),
                (F.coalesce(F.col("u") < F.col("up"), F.lit(False)) | F.coalesce(F.col("d") < F.col("down"), F.lit(False))).alias("new"),
            )
            least = written(least, "chat-least")
            walks, step = _doubled(walks, "chat-walks"), 2 * step
        of = lambda c: least.select(F.col("k").alias(c + "k"), F.struct("up", "down").alias(c + "l"))  # noqa: B023,E731
        marked = needs.join(of("a"), F.col("a") == F.col("ak")).join(of("b"), F.col("b") == F.col("bk"))
        marked = written(marked.select("a", "b", (F.col("al") == F.col("bl")).alias("same")), "chat-cycles")
        needs = marked.filter("same").select("a", "b")
        if marked.filter("not same").isEmpty():
            return needs


def _places(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events as written, (k, t, h, cyclic) of the events that have a need or are needed)."""
    key = F.sha2(_told_apart(*[F.col(x) for x in ("conv_id", "turn", "kind", "call_id", "name", "json", "node")]), 256)
    events = written(events.withColumn(OWN + "key", key), "chat-events")
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN))
    needs = events.select(F.col(OWN + "key").alias("b"), F.explode("needs").alias("need")).distinct()
    of_node = events.filter("node is not null").groupBy("node").agg(F.max(F.struct(turn, F.col(OWN + "key").alias("a"))).alias("n"))
    needs = written(needs.join(of_node, F.col("need") == F.col("node")).select("n.a", "b").distinct(), "chat-needs")
    linked = needs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    start = events.select(F.col(OWN + "key").alias("k"), turn.alias("t")).distinct().join(linked, "k", "left_semi")
    start = written(start.withColumn("h", F.lit(0).cast("long")), "chat-start")
    longest = events.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    places, walks = _raised(start, needs, longest)
    never = F.lit(False).alias("cyclic")
    if walks is None:
        return events, places.select("k", "t", "h", never)
    # A walk that long holds a cycle, so what lies on a cycle both begins such a walk and ends one.
    core = written(walks.select(F.col("a").alias("k")).intersect(walks.select(F.col("b").alias("k"))), "chat-core")
    inner = needs.join(core, F.col("a") == F.col("k"), "left_semi").join(core, F.col("b") == F.col("k"), "left_semi")
    inside = written(_inside_cycles(written(inner, "chat-inner"), longest), "chat-inside")
    places, _ = _raised(start, written(needs.join(inside, ["a", "b"], "left_anti"), "chat-needs"), longest)
    on_cycle = inside.select(F.explode(F.array("a", "b")).alias("ck")).distinct()
    places = places.join(on_cycle, F.col("k") == F.col("ck"), "left")
    return events, places.select("k", "t", "h", F.col("ck").isNotNull().alias("cyclic"))


def linked_chat(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: Schemas = SCHEMAS) -> DataFrame:
    """(conv_id, position, kind, call_id, name, status, errors, json) of every event, in a valid order."""
    events, places = _places(_events(messages, calls, results, schemas))
    events = events.join(places, F.col(OWN + "key") == F.col("k"), "left")
    own_turn = F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN))
    events = events.withColumn("t", F.coalesce("t", own_turn)).withColumn("h", F.coalesce("h", F.lit(0)))
    order = [
        F.asc_nulls_first("conv_id"),
        F.asc("t"),
        F.asc("h"),
        F.asc("kind"),
        F.asc_nulls_first("call_id"),
        F.asc(OWN + "key"),
    ]
    rows = ranked(events.drop("needs", "node"), order, "chat-order")
    first = rows.groupBy(F.col("conv_id").alias("fc")).agg(F.min(OWN + "position").alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("fc")))
    cyclic = F.coalesce("cyclic", F.lit(False))
    return rows.select(
        "conv_id",
        (F.col(OWN + "position") - F.col("first")).alias("position"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1).alias("kind"),
        "call_id",
        "name",
        F.when(cyclic, "cyclic").otherwise(F.col("status")).alias("status"),
        "errors",
        "json",
    )


def as_tool_log(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sample conversations seen as a tool log: each user turn calls a tool (which one follows the ids), the
    assistant turn after it is the result; a call needs the result of the user turn before. The log is written with
    results before their calls in every third conversation, and some arguments break the schema."""
    turn, conv = F.col("turn"), F.col("conv_id")
    at = F.when((conv % 3 == 0) & (F.col("role") == "assistant"), turn - 2).otherwise(turn)
    call_id = lambda t: F.concat(F.lit("call_"), conv.cast("string"), F.lit("_"), t.cast("string"))
    pick = F.pmod(conv + F.floor(turn / 2), F.lit(3))
    text, n = F.coalesce("text", F.lit("")), word_count(F.col("text"))
    names = list(SCHEMAS)
    name = F.when(pick == 0, names[0]).when(pick == 1, names[1]).otherwise(names[2])
    arguments = (
        F.when(pick == 0, F.to_json(F.struct(text.alias("query"), (n % 10).alias("limit"))))
        .when((pick == 1) & (n % 5 == 0), F.to_json(F.struct(n.cast("string").alias("words"), text.alias("text"))))
        .when(pick == 1, F.to_json(F.struct(n.alias("words"), text.alias("text"))))
        .when(n % 4 == 0, F.to_json(F.struct(text.alias("text"))))
        .otherwise(F.to_json(F.struct(text.alias("text"), F.lit("en").alias("target"))))
    )
    before = F.when(turn >= 2, F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>"))
    users = conversations.filter("role = 'user'")
    calls = users.select("conv_id", "turn", call_id(turn).alias("call_id"), name.alias("name"), arguments.alias("arguments"), before.alias("after"))
    answers = conversations.filter("role = 'assistant'")
    results = answers.select("conv_id", at.alias("turn"), call_id(turn - 1).alias("call_id"), text.alias("content"))
    rest = conversations.filter("role is null or role not in ('user', 'assistant')")
    return rest.select("conv_id", "turn", "role", text.alias("content")), calls, results


def op7_tool_chat(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return linked_chat(*as_tool_log(conversations))
