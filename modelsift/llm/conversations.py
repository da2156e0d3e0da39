"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation's messages, in order, are to become (system? (user assistant)+)?. A node of the lattice is (messages
passed, state of that pattern); edges are the edits: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an
empty message 5. Blank messages and repeats must be deleted; a truncated message that stays adds 5. One heap grows
from the start, one from the ends. Each node is settled with its least cost and, of equal ones, its least audit
(the edits' initials). Both heaps go on until no path through them can be as cheap as the best one found, so every
cheapest path has been seen where the two sides meet, and the least concatenated audit of those is taken. Audits
of one node and cost are never prefixes of each other, as a longer one has more insertions, so comparing parts
compares wholes.

The search needs one letter a message (role and fault). Above SEGMENT messages the lattice is cut: each
segment is searched from and to every state, and neighbouring results are joined in pairs, so that long
conversations cost time in proportion to their length (but for joining audits). Only the letters are searched;
texts pass through. A conversation's messages are read by one task, which holds that conversation: its repaired
text is a single value.

Messages are ordered by turn (null first), then by role and text, so ties give the same result in every run. Null
roles and texts are one space, so such messages are blank or of a role that fits nowhere; a null id is a conversation
of its own; an empty role fits nowhere either. Rows that repeat are repeats and go. Columns besides conv_id, turn,
role and text are ignored. An empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm.common import OWN, table

SEGMENT = 256
OUTPUT_ROWS = 500
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# States of the pattern: nothing yet, after system, after user, after assistant. State -> role's initial -> next state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES = range(len(NEXT))
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
GONE = "-"  # the letter of a message that must be deleted; a capital is a truncated one

Label = tuple[int, str]  # (cost, audit)


def forward_edges(letters: str, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """(messages passed, state, cost, initial) after each edit at a node."""
    if i < len(letters):
        c = letters[i]
        yield i + 1, q, DELETE, "D"
        if c != GONE:
            extra = TRUNCATED if c.isupper() else 0
            if (to := NEXT[q].get(c.lower())) is not None:
                yield i + 1, to, KEEP + extra, "K"
            for role in NAMES:
                if (to := NEXT[q].get(role)) is not None:
                    yield i + 1, to, REROLE + extra, "R"
    for role in NAMES:
        if (to := NEXT[q].get(role)) is not None:
            yield i, to, INSERT, "I"


def backward_edges(letters: str, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """The same edges into a node: (messages passed, state, cost, initial) before the edit."""
    for j in (i - 1, i):
        if j >= 0:
            for p in STATES:
                for k, to, cost, initial in forward_edges(letters, j, p):
                    if k == i and to == q:
                        yield j, p, cost, initial


def cheapest(letters: str, start: int = 0, ends: tuple[int, ...] = ENDS) -> Label | None:
    """Least cost and, of those, least audit from state start to one of the states ends; None if there is no way."""
    n = len(letters)
    # Heaps of (cost, place, audit, state): of one cost, nodes come in the order in which edits of cost 0 run.
    ahead: list = [(0, 0, "", start)]
    back: list = [(0, -n, "", q) for q in ends]
    heapq.heapify(back)
    done_ahead: dict[tuple[int, int], Label] = {}
    done_back: dict[tuple[int, int], Label] = {}
    best: Label | None = None

    def crossing(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = (cost, audit)

    while ahead and back and (best is None or ahead[0][0] + back[0][0] <= best[0]):
        if ahead[0][0] <= back[0][0]:
            cost, i, audit, q = heapq.heappop(ahead)
            if (i, q) in done_ahead:
                continue
            done_ahead[i, q] = (cost, audit)
            if (met := done_back.get((i, q))) is not None:
                crossing(cost + met[0], audit + met[1])
            for j, to, more, initial in forward_edges(letters, i, q):
                if (met := done_back.get((j, to))) is not None:
                    crossing(cost + more + met[0], audit + initial + met[1])
                if (j, to) not in done_ahead:
                    heapq.heappush(ahead, (cost + more, j, audit + initial, to))
        else:
            cost, i, audit, q = heapq.heappop(back)
            i = -i
            if (i, q) in done_back:
                continue
            done_back[i, q] = (cost, audit)
            if (met := done_ahead.get((i, q))) is not None:
                crossing(cost + met[0], met[1] + audit)
            for j, before, more, initial in backward_edges(letters, i, q):
                if (met := done_ahead.get((j, before))) is not None:
                    crossing(cost + more + met[0], met[1] + initial + audit)
                if (j, before) not in done_back:
                    heapq.heappush(back, (cost + more, -j, initial + audit, before))
    return best


remembered = lru_cache(1 << 16)(cheapest)


def joined(left: list[list[Label | None]], right: list[list[Label | None]]) -> list[list[Label | None]]:
    """Results of two neighbouring segments, state by state, as those of both together."""

    def through(a: int, b: int) -> Label | None:
        ways = ((x, y) for q in STATES if (x := left[a][q]) is not None and (y := right[q][b]) is not None)
        return min(((x[0] + y[0], x[1] + y[1]) for x, y in ways), default=None)

    return [[through(a, b) for b in STATES] for a in STATES]


def edits(letters: str, segment: int = SEGMENT) -> Label:
    """(cost, audit) of the cheapest repair, of equally cheap ones the least in ASCII order."""
    if len(letters) <= segment:
        return remembered(letters) if len(letters) <= 32 else cheapest(letters)
    level = [
        [[cheapest(letters[at : at + segment], a, (b,)) for b in STATES] for a in STATES]
        for at in range(0, len(letters), segment)
    ]
    while len(level) > 1:
        pairs = [joined(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[2 * len(pairs) :]
    return min(level[0][0][b] for b in ENDS if level[0][0][b] is not None)


def repaired_messages(audit: str, messages: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The messages (role, text) after the edits."""
    out: list[tuple[str, str]] = []
    at = 0
    for edit in audit:
        role = text = ""
        if edit != "I":
            role, text = messages[at]
            at += 1
        if edit == "D":
            continue
        if edit in "IR":
            # After a user comes an assistant; at any other place only a user fits.
            role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        out.append((role, text))
    return out


RESULT = pa.schema(
    [
        *[(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        ("audit", pa.string()),
        ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
    ]
)


class Conversation:
    """The messages of one conversation while they arrive, and its repair."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.messages: list[tuple[str, str]] = []
        self.seen: set[tuple[str, str]] = set()
        self.turns: list[int] = []
        self.letters: list[str] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)  # distinct, as they arrive in order
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        stripped = text.rstrip(BLANKS)
        message = (role, text)
        fault = None
        if not stripped:
            fault, letter = "blank", GONE
        elif message in self.seen:
            fault, letter = "duplicate", GONE
        elif stripped[-1] not in ".!?":
            fault, letter = "truncated", letter.upper()
        if fault:
            self.counts[fault] += 1
        self.seen.add(message)
        self.messages.append(message)
        self.letters.append(letter)

    def result(self) -> dict:
        cost, audit = edits("".join(self.letters))
        initials = [role[:1] for role, _ in self.messages]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        gaps = self.turns[-1] - self.turns[0] + 1 - len(self.turns) if self.turns else 0
        kept = [{"role": r, "text": t} for r, t in repaired_messages(audit, self.messages)]
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "illegal": illegal, "cost": cost, "audit": audit, "messages": kept}


def repairer(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Conversations from sorted rows; one of them is held at a time, and a few results."""
    schema = pa.schema([("conv_id", id_type), *RESULT])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Conversation | None = None
        results: list[dict] = []
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "held"))
            for conv_id, turn, role, text, held in zip(*columns, strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        results.append(current.result())
                    current = Conversation(conv_id)
                if held:
                    current.add(turn, role, text)
            if len(results) >= OUTPUT_ROWS:
                yield pa.RecordBatch.from_pylist(results, schema)
                results = []
        if current is not None:
            results.append(current.result())
        if results:
            yield pa.RecordBatch.from_pylist(results, schema)

    return repair


def repaired(messages: DataFrame, held: Column | None = None) -> DataFrame:
    """One row per conversation of messages(conv_id, turn, role, text): gaps, the counts of faults, illegal, cost, audit
    and messages, the repaired ones as an array of (role, text).

    held: false for rows that only tell that a conversation exists.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = messages.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        space("role").alias("role"),
        space("text").alias("text"),
        (F.lit(True) if held is None else held).alias("held"),
    )
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    rows = rows.repartition("conv_id").sortWithinPartitions(*order)
    id_type = rows.schema["conv_id"].dataType
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return rows.mapInArrow(
        repairer(to_arrow_type(id_type)),
        f"conv_id {id_type.simpleString()}, {fields}, messages array<struct<role:string,text:string>>",
    )


def damaged(messages: DataFrame) -> DataFrame:
    """messages with faults of known kinds by crc32 of 'conv_id:turn' modulo 20, and __ms_held.

    0 drops the row (not held, so that its conversation is still known), 1 empties its text, 2 takes out the marks that end
    sentences, 3 repeats it, 4 makes its role user. Nulls are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return messages.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        text.alias("text"),
        (kind != 0).alias(OWN + "held"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias(OWN + "copy"),
    ).drop(OWN + "copy")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = damaged(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    text = F.array_join(lines, "\n")
    return repaired(rows, F.col(OWN + "held")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(text.cast("binary"), 256).alias("repaired_sha256"),
    )
