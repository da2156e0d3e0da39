import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from modelsift.llm import conversations
from modelsift.llm.conversations import cheapest, edits, joined, repaired

from conftest import SMALL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, messages string, extra bigint"


def every_way(letters, most_inserts=3):
    """(cost, audit) of the cheapest repair by trying all edits, without the pattern's states."""
    best = None
    options = []
    for c in letters:
        extra = 5 if c.isupper() else 0
        ways = [("D", "", 2)]
        if c != "-":
            ways += [("K", c.lower(), extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        options.append(ways)
    runs = [p for n in range(most_inserts + 1) for p in itertools.product("ua", repeat=n)]
    for chosen in itertools.product(*options):
        for where in itertools.product(runs, repeat=len(letters) + 1):
            inserts = sum(map(len, where))
            if inserts > most_inserts:
                continue
            cost = 5 * inserts + sum(w[2] for w in chosen)
            if best and cost > best[0]:
                continue
            roles, audit = "".join(where[0]), "I" * len(where[0])
            for w, after in zip(chosen, where[1:], strict=True):
                roles += w[1] + "".join(after)
                audit += w[0] + "I" * len(after)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def table_of_states(letters):
    """(cost, audit) by a plain table over messages and states, for longer conversations."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        for _ in range(4):
            for (q, c), to in step.items():
                if c != "s" and q in best:
                    way = (best[q][0] + 5, best[q][1] + "I")
                    best[to] = min(best.get(to, way), way)
        return best

    best = inserted({0: (0, "")})
    for c in letters:
        new = {}

        def offer(q, way):
            new[q] = min(new.get(q, way), way)  # noqa: B023

        for q, (cost, audit) in best.items():
            offer(q, (cost + 2, audit + "D"))
            if c == "-":
                continue
            extra = 5 if c.isupper() else 0
            if (q, c.lower()) in step:
                offer(step[q, c.lower()], (cost + extra, audit + "K"))
            for role in "ua":
                if (q, role) in step:
                    offer(step[q, role], (cost + 1 + extra, audit + "R"))
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


@pytest.mark.parametrize("letters", ["", *("".join(p) for n in (1, 2) for p in itertools.product("sua-SUAx", repeat=n))])
def test_short_ones_against_every_way(letters):
    assert edits(letters) == every_way(letters) == table_of_states(letters)


@settings(max_examples=40, deadline=None)
@given(st.text("suaUA-x", min_size=3, max_size=4))
def test_against_every_way(letters):
    assert cheapest(letters) == every_way(letters, 2)


@settings(max_examples=300, deadline=None)
@given(st.text("suuuaaaUASX-x", max_size=40), st.integers(1, 9))
def test_against_a_table_and_in_segments(letters, segment):
    expected = table_of_states(letters)
    assert cheapest(letters) == expected
    assert edits(letters, segment) == expected


def test_a_long_conversation():
    rng = random.Random(1)
    letters = "".join(rng.choice("uauauaus-UAx") for _ in range(3000))
    assert edits(letters) == table_of_states(letters)


def test_joining_keeps_missing_ways_missing():
    none = [[None] * 4 for _ in range(4)]
    assert joined(none, none) == none


def expected_rows(rows):
    """Brute force: the contract over (conv_id, turn, role, text) rows."""
    of = defaultdict(list)
    space = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        of[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, held in of.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen, letters = [], set(), ""
        for _, role, text in held:
            last = re.sub("[\x20\x09-\x0d]", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            initial = role[:1] if role[:1] in tuple("sua") else "x"
            letters += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = table_of_states(letters)
        result, left = [], list(held)
        for edit in audit:
            row = left.pop(0) if edit != "I" else None
            if edit == "D":
                continue
            role = row[1] if edit == "K" else None
            if role is None:
                role = "assistant" if result and result[-1].startswith("user:") else "user"
            result.append(f"{role}:{row[2] if row else ''}")
        turns = [t for t, _, _ in held if t is not None]
        initials = [r[1][:1] for r in held]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            faults.count("blank"),
            faults.count("duplicate"),
            faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(result).encode()).hexdigest(),
        )
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in conversations.op13_conversation_repair(spark, SMALL).collect()}
    assert got == expected_rows(rows)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = [
        (None, None, None, None),
        (None, 3, "user", "Hi."),
        (1, None, "user", None),
        (1, 5, "assistant", " \t\n"),
        (1, 5, "assistant", "One."),
        (1, 5, "assistant", "One."),
        (1, 2, "", "No role!"),
        (1, 2, "tool", "done"),
        (2, 7, "system", ""),
        (3, 1, "user", "x" * 300_000 + "."),
        (3, 2, "assistant", "yes é?"),
    ]
    rows += [(4, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", "", f"c{t}."])) for t in range(900)]
    for conv in range(10, 60):
        rows += [(conv, rng.randint(0, 9), rng.choice(["user", "assistant", "system"]), f"{rng.random()}.") for _ in range(rng.randint(1, 9))]
    rows += [(conv, 0, "user", "Lost?") for conv in range(100, 200)]  # some are dropped, and nothing is left
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def test_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in conversations.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == expected_rows([tuple(r)[:4] for r in odd.collect()])
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in got.values())


def test_texts_and_empty_table(spark, odd):
    row = repaired(odd.filter("conv_id = 3")).first()
    assert [(m.role, len(m.text)) for m in row.messages] == [("user", 300_001), ("assistant", 6)]
    assert (row.cost, row.audit) == (0, "KK")
    assert repaired(odd.limit(0)).count() == 0
