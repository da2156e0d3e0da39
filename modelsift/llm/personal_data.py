"""Personal data: base rules, and a skip-chain conditional random field that makes their labels consistent.

The base rules find emails, IP addresses, cards and phone numbers by pattern and check. The field then labels
every token that holds a digit or an @ as one of the four kinds or as none. Potentials of a token come from its
shape, those between neighbours from how kinds follow each other, and tokens of a document that are the same or end
in the same seven digits hang on a common hidden node, so they share their evidence however far apart they are
(and n copies need n links). Loopy sum-product messages give the marginals; tokens of base spans are observed. A
token with a marginal of MARGINAL or more for a kind whose form it has becomes a span of that kind where no base
span is: a card that a rule lost because it stands beside another, a phone number repeated without its prefix.

The weights are learned in numpy on at most SAMPLE_DOCS documents, picked by a hash of the id, labelled by the base
rules; matches that the rules drop are left out. Without any span in the sample only the base rules apply.

Whole texts are read, in time and memory linear in their length: per token its
features and marginals, per link one message each way; pair tables exist for BATCH_LINKS links at a time. Null and empty texts have no spans. Rows are handled one by
one, so ties and repeated rows agree; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm.common import hash_sample, table

SAMPLE_DOCS = 20_000
MARGINAL = 0.9
ROUNDS = 10
DAMPING = 0.3
BATCH_TEXTS, BATCH_CHARS = 256, 4_000_000  # texts handled at once; a longer one is a batch of its own
BATCH_TOKENS = 50_000  # tokens of one graph; a document with more is a graph of its own
BATCH_LINKS = 65_536  # links whose messages are computed at once

# The kinds in the order of reports, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
MARKS = re.compile(r"[0-9@]+")
TOKEN_REST = re.compile(r"\S*")
EDGE = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz@+("

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def emails(text: str) -> list[tuple[int, int, bool]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), True))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def addresses(text: str) -> list[tuple[int, int, bool]]:
    found = []
    for m in NUMBERS.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            found.append((start, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)))
            start = end + 1
    return found


def cards(text: str) -> list[tuple[int, int, bool]]:
    found = []
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        found.append((m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)))
    return found


def phones(text: str) -> list[tuple[int, int, bool]]:
    return [(m.start(), m.end(), 8 <= len(_digits(m.group())) <= 15) for m in PHONE.finditer(text)]


def matches(text: str) -> list[list[tuple[int, int, bool]]]:
    """Per kind: every match of its pattern and whether it passes the kind's check."""
    if not MARKS.search(text):
        return [[], [], [], []]
    return [emails(text), addresses(text), cards(text), phones(text)]


@dataclass
class Token:
    start: int
    end: int
    text: str
    touches: bool  # one space or nothing stands between it and the token before
    label: int  # 0: none, else kind + 1; -1: part of a dropped match


def tokens(text: str, found: list[list[tuple[int, int, bool]]]) -> list[Token]:
    """Tokens with a digit or an @, without the punctuation around them, and the base rules' label."""
    out: list[Token] = []
    last = 0
    for m in MARKS.finditer(text):
        if m.start() < last:
            continue
        start = m.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        stop = TOKEN_REST.match(text, m.end()).end()
        a, b = start, stop
        while a < m.start() and text[a] not in EDGE:
            a += 1
        while b > m.end() and text[b - 1] not in EDGE and text[b - 1] != ")":
            b -= 1
        touches = bool(out) and start - last == 1
        out.append(Token(a, b, text[a:b], touches, 0))
        last = stop
    spans = sorted((s, e, k + 1 if ok else -1) for k, ms in enumerate(found) for s, e, ok in ms)
    passed = [x for x in spans if x[2] > 0]
    dropped = [x for x in spans if x[2] < 0 and x[1] - x[0] >= 7]
    for group in (dropped, passed):
        i = 0
        for token in out:
            while i < len(group) and group[i][1] <= token.start:
                i += 1
            j = i
            while j < len(group) and group[j][0] < token.end:
                token.label = group[j][2]
                j += 1
    return out


FEATURES = 40


def features(token: Token, before: Token | None, after: Token | None) -> list[int]:
    """Places of the binary features that hold: the token's shape and its neighbours'."""
    s = token.text
    n = sum(map(len, DIGITS.findall(s)))
    on = [0, 1 + int(np.searchsorted([1, 2, 4, 7, 8, 11, 13, 16, 20], n, "right"))]
    letters = any(c.isalpha() for c in s)
    dots = s.count(".")
    on += [11 + min(dots, 4)]
    if letters:
        on.append(16)
    if "@" in s:
        on.append(17 if DOMAIN.search(s, s.index("@")) else 18)
    if s.startswith("+"):
        on.append(19)
    if "(" in s and ")" in s:
        on.append(20)
    if "-" in s and not letters:
        on.append(21)
    if not letters and 13 <= n <= 19:
        on.append(22 if luhn(_digits(s)) else 23)
    if dots == 3 and not letters:
        parts = s.split(".")
        fits = all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
        on.append(24 if fits else 25)
    if any(c in s for c in "=\"'_/:"):
        on.append(26)
    if n == len(s):
        on.append(27)
    for other, first in ((before, 28), (after, 33)):
        if other is None:
            on.append(first)
            continue
        t = other.text
        if t.startswith("+"):
            on.append(first + 1)
        if "(" in t:
            on.append(first + 2)
        if "-" in t and not any(c.isalpha() for c in t):
            on.append(first + 3)
    return on


def shared_keys(token: Token) -> list[str]:
    """Tokens of a document with a key in common support each other."""
    digits = _digits(token.text)
    keys = ["=" + token.text.lower().strip("()+")]
    if len(digits) >= 7 and not any(c.isalpha() for c in token.text):
        keys.append("~" + digits[-7:])
    return keys


@dataclass
class Graph:
    """Nodes of several documents: tokens first, then hidden ones; links as (from, to, kind of link)."""

    x: np.ndarray
    label: np.ndarray
    hidden: int
    links: np.ndarray


def graph(documents: list[list[Token]]) -> Graph:
    n = sum(map(len, documents))
    x, label = np.zeros((n, FEATURES), np.uint8), np.zeros(n, np.int64)
    links: list[tuple[int, int, int]] = []
    at, hidden = 0, 0
    for doc in documents:
        sharing: dict[str, list[int]] = {}
        for i, token in enumerate(doc):
            before = doc[i - 1] if i and token.touches else None
            after = doc[i + 1] if i + 1 < len(doc) and doc[i + 1].touches else None
            x[at + i, features(token, before, after)] = 1
            label[at + i] = token.label
            if before is not None:
                links.append((at + i - 1, at + i, 0))
            for key in shared_keys(token):
                sharing.setdefault(key, []).append(at + i)
        for members in sharing.values():
            if len(members) > 1:
                links += [(m, n + hidden, 1) for m in members]
                hidden += 1
        at += len(doc)
    return Graph(x, label, hidden, np.array(links, np.int64).reshape(-1, 3))


@dataclass
class Weights:
    unary: np.ndarray  # features, labels
    chain: np.ndarray  # label, next label
    skip: np.ndarray


def learned(graphs: list[Graph]) -> Weights | None:
    """Token weights by regularised softmax descent; link weights from how labels go together."""
    x = np.concatenate([g.x for g in graphs]) if graphs else np.zeros((0, FEATURES))
    y = np.concatenate([g.label for g in graphs]) if graphs else np.zeros(0, np.int64)
    known = y >= 0
    if not (y[known] > 0).any():
        return None
    k = len(KINDS) + 1
    xs, ys = x[known].astype(np.float64), y[known]
    w, target = np.zeros((FEATURES, k)), np.eye(k)[ys]
    speed = np.full((FEATURES, k), 1e-6)
    for _ in range(300):
        z = xs @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = xs.T @ (p - target) / len(ys) + 1e-4 * w
        speed += g * g
        w -= 0.3 * g / np.sqrt(speed)
    together = np.full((k, k), 0.5)
    agree, differ = 1.0, 1.0
    for g in graphs:
        for a, b, kind in g.links[g.links[:, 2] == 0]:
            if g.label[a] >= 0 and g.label[b] >= 0:
                together[g.label[a], g.label[b]] += 1
        groups: dict[int, list[int]] = {}
        for a, b, kind in g.links[g.links[:, 2] == 1]:
            groups.setdefault(b, []).append(g.label[a])
        for labels in groups.values():
            seen = [v for v in labels if v >= 0]
            agree += sum(a == b for a, b in zip(seen, seen[1:], strict=False))
            differ += sum(a != b for a, b in zip(seen, seen[1:], strict=False))
    share = together / together.sum()
    chain = np.clip(np.log(share / share.sum(1, keepdims=True) / share.sum(0, keepdims=True)), -2, 2)
    skip = np.eye(k) * float(np.clip(np.log(agree / differ), 0.5, 3.0))
    return Weights(w, chain, skip)


def _logsum(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(z - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(g: Graph, weights: Weights) -> np.ndarray:
    """Loopy sum-product; observed tokens keep their label."""
    k = len(KINDS) + 1
    unary = np.zeros((len(g.label) + g.hidden, k))
    for at in range(0, len(g.label), BATCH_LINKS):
        rows = g.x[at : at + BATCH_LINKS]
        unary[at : at + len(rows)] = rows.astype(np.float64) @ weights.unary
    seen = np.flatnonzero(g.label > 0)
    unary[seen] = -30
    unary[seen, g.label[seen]] = 0
    m = len(g.links)
    belief = unary
    if m:
        src = np.concatenate([g.links[:, 0], g.links[:, 1]])
        dst = np.concatenate([g.links[:, 1], g.links[:, 0]])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        pairs = np.stack([weights.chain, weights.skip, weights.chain.T, weights.skip.T])
        which = np.concatenate([g.links[:, 2], g.links[:, 2] + 2])
        message = np.zeros((2 * m, k))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, message)
            new = np.empty_like(message)
            for at in range(0, 2 * m, BATCH_LINKS):
                part = slice(at, at + BATCH_LINKS)
                out = _logsum((belief[src[part]] - message[back[part]])[:, :, None] + pairs[which[part]], 1)
                new[part] = out - _logsum(out, 1)[:, None]
            message = DAMPING * message + (1 - DAMPING) * new
        belief = unary.copy()
        np.add.at(belief, dst, message)
    belief = belief[: len(g.label)]
    return np.exp(belief - _logsum(belief, 1)[:, None]) if len(belief) else belief


def _has_form(kind: int, text: str) -> bool:
    n = len(_digits(text))
    if kind == 0:
        return 0 < text.find("@") < len(text) - 1
    if kind == 1:
        return text.count(".") == 3 and n >= 4 and not any(c.isalpha() for c in text)
    return (13 <= n <= 19 if kind == 2 else 7 <= n <= 15) and not any(c.isalpha() for c in text)


def added_spans(text: str, doc: list[Token], p: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of tokens that the field labels; neighbouring phone tokens are one span."""
    pieces: list[Span] = []
    for token, row in zip(doc, p, strict=True):
        kind = int(row.argmax()) - 1
        if kind < 0 or row[kind + 1] < MARGINAL or token.label > 0:
            continue
        joins = kind == 3 and token.touches and pieces and pieces[-1][0] == 3 and token.start - pieces[-1][2] <= 2
        if joins:
            pieces[-1] = (3, pieces[-1][1], token.end)
        else:
            pieces.append((kind, token.start, token.end))
    taken = sorted((s, e) for _, s, e in base)
    out, i = [], 0
    for kind, start, end in pieces:
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        free = i == len(taken) or taken[i][0] >= end
        if free and _has_form(kind, text[start:end]):
            out.append((kind, start, end))
    return out


def spans_of(texts: list[str], weights: Weights | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind and start."""
    found = [matches(t) for t in texts]
    base = [[(k, s, e) for k, ms in enumerate(f) for s, e, ok in ms if ok] for f in found]
    if weights is None:
        return [(b, b) for b in base]
    docs = [tokens(t, f) if MARKS.search(t) else [] for t, f in zip(texts, found, strict=True)]
    out = []
    for first, last in _graphs([len(d) for d in docs]):
        p, at = marginals(graph(docs[first:last]), weights), 0
        for text, doc, b in zip(texts[first:last], docs[first:last], base[first:last], strict=True):
            extra = added_spans(text, doc, p[at : at + len(doc)], b) if doc else []
            out.append((b, sorted(b + extra) if extra else b))
            at += len(doc)
    return out


def _graphs(tokens_of: list[int]):
    """(first, last + 1) of the documents of one graph. Documents share no links, so the cut changes no result."""
    first, n = 0, 0
    for i, more in enumerate(tokens_of):
        if n and n + more > BATCH_TOKENS:
            yield first, i
            first, n = i, 0
        n += more
    if first < len(tokens_of):
        yield first, len(tokens_of)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _batches(texts: pa.Array):
    batch, chars = [], 0
    for value in texts:
        text = value.as_py() or ""
        if batch and (len(batch) == BATCH_TEXTS or chars + len(text) > BATCH_CHARS):
            yield batch
            batch, chars = [], 0
        batch.append(text)
        chars += len(text)
    if batch:
        yield batch


FINDINGS = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>"


def finder(weights: Weights | None):
    def find(texts: pa.Array) -> pa.Array:
        counts: list[list[int]] = [[], [], [], []]
        digests, spans = [], []
        for batch in _batches(texts):
            for base, all_spans in spans_of(batch, weights):
                kinds = [k for k, _, _ in base]
                for k in range(len(KINDS)):
                    counts[k].append(kinds.count(k))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_spans))
        arrays = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.StructArray.from_arrays(arrays, names=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return find


def redactor(weights: Weights | None):
    def redact(texts: pa.Array) -> pa.Array:
        out = []
        for batch in _batches(texts):
            for text, (_, spans) in zip(batch, spans_of(batch, weights), strict=True):
                parts, at = [], 0
                for k, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
                    if e <= at:
                        continue
                    parts += [text[at : max(s, at)], f"[{KINDS[k].upper()}]"] if s >= at else []
                    at = e
                out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return redact


def described(texts: pa.Array) -> pa.Array:
    """Of each text the graph of its tokens as flat lists, to learn from."""
    rows = {"x": [], "label": [], "a": [], "b": [], "kind": [], "hidden": []}
    for batch in _batches(texts):
        for text in batch:
            g = graph([tokens(text, matches(text))])
            rows["x"].append(np.packbits(g.x.astype(bool), axis=1).tobytes())
            rows["label"].append(g.label)
            for i, c in enumerate(("a", "b", "kind")):
                rows[c].append(g.links[:, i])
            rows["hidden"].append(g.hidden)
    lists = pa.list_(pa.int64())
    return pa.StructArray.from_arrays(
        [pa.array(v, pa.binary() if c == "x" else pa.int64() if c == "hidden" else lists) for c, v in rows.items()],
        names=list(rows),
    )


GRAPH = "struct<x:binary,label:array<bigint>,a:array<bigint>,b:array<bigint>,kind:array<bigint>,hidden:bigint>"


def fitted(docs: DataFrame) -> Weights | None:
    ids = hash_sample(docs.select("doc_id").filter("doc_id is not null"), "doc_id", SAMPLE_DOCS).distinct()
    describe = F.arrow_udf(described, GRAPH)
    sample = docs.join(F.broadcast(ids), "doc_id").filter(F.col("text").rlike("[0-9@]"))
    rows = sample.select("doc_id", describe("text").alias("g")).toArrow().sort_by("doc_id")
    graphs = []
    for g in rows["g"].to_pylist():
        x = np.unpackbits(np.frombuffer(g["x"], np.uint8)).reshape(-1, FEATURES) if g["x"] else np.zeros((0, FEATURES))
        links = np.array([g["a"], g["b"], g["kind"]], np.int64).T.reshape(-1, 3)
        graphs.append(Graph(x, np.array(g["label"], np.int64), g["hidden"], links))
    return learned(graphs)


def personal_data(docs: DataFrame, weights: Weights | None) -> DataFrame:
    """docs(doc_id, text, ...) as (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); counts are of base spans."""
    find = F.arrow_udf(finder(weights), FINDINGS)
    return docs.select("doc_id", find(F.coalesce("text", F.lit(""))).alias("f")).select("doc_id", "f.*")


def redacted(docs: DataFrame, weights: Weights | None) -> DataFrame:
    """docs with every span of the texts replaced by its kind."""
    redact = F.arrow_udf(redactor(weights), "string")
    marked = F.col("text").rlike("[0-9@]")
    return docs.withColumn("text", F.when(marked, redact("text")).otherwise(F.col("text")))


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return personal_data(docs, fitted(docs))
