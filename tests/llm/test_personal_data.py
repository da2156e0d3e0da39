import hashlib
import random
import re
from itertools import product

import numpy as np

from modelsift.llm import personal_data as P
from odd_rows import no_documents, odd_documents  # noqa: F401

# Plain regular expressions, as the rules are stated.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS
        for m in re.finditer(pattern, text)
        if passes(kind, m.group())
    ]


def test_base_rules_against_plain_patterns():
    rng = random.Random(3)
    parts = ["a.b+c", "@", "@@", ".", "x.org", "mail-1.example.com", " ", "-", "+", "(", ")", "255", "256", "1", "0", "é",
             "4111111111111111", "4111 1111 1111 1111", "8.8.8.8", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824", "00300", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        base = P.spans_of([text], None)[0][0]
        assert [(P.KINDS[k], s, e) for k, s, e in base] == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 50_000, "+1(" * 50_000):
        P.spans_of([text], None)


def learned_weights():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    makers = [
        card,
        lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com",
        lambda: rng.choice(["2.0.", "4.0.", "3", "version 12", "1999"]),
    ]
    texts = [" ".join([word(), rng.choice(makers)(), word(), word(), rng.choice(makers)(), word()]) for _ in range(600)]
    graphs = [P.graph([P.tokens(t, P.matches(t))]) for t in texts]
    return P.learned(graphs), card()


def test_the_field_adds_what_rules_lose_and_keeps_the_base():
    weights, card = learned_weights()
    twice = f"abc {card} {card} def"  # one chain of 32 digits: the rule drops it
    repeat = "call +1 (743) 555-3824 soon or (743) 555-3824 later"
    clean = "Licensed under CC BY-NC 4.0. See version 3. In 1999 there were 12 of them."
    (b1, s1), (b2, s2), (b3, s3) = P.spans_of([twice, repeat, clean], weights)
    assert b1 == [] and [(k, twice[s:e]) for k, s, e in s1] == [(2, card), (2, card)]
    assert [repeat[s:e] for _, s, e in b2] == ["+1 (743) 555-3824"]
    assert [repeat[s:e] for k, s, e in s2 if k == 3] == ["+1 (743) 555-3824", "(743) 555-3824"]
    assert b3 == s3 == []


def exact(g, weights):
    """Marginals by summing over all labellings."""
    k, n = len(P.KINDS) + 1, len(g.label) + g.hidden
    total = np.zeros((n, k))
    unary = g.x.astype(float) @ weights.unary
    for labels in product(range(k), repeat=n):
        if any(v > 0 and labels[i] != v for i, v in enumerate(g.label)):
            continue
        z = sum(unary[i, labels[i]] for i in range(len(g.label)) if g.label[i] <= 0)
        z += sum((weights.chain, weights.skip)[kind][labels[a], labels[b]] for a, b, kind in g.links)
        total[list(range(n)), labels] += np.exp(z)
    return (total / total.sum(1, keepdims=True))[: len(g.label)]


def test_messages_are_exact_on_trees(monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 80)
    monkeypatch.setattr(P, "BATCH_LINKS", 3)
    rng = np.random.default_rng(4)
    k = len(P.KINDS) + 1
    trees = ([(0, 1, 0), (1, 2, 0)], [(0, 4, 1), (1, 4, 1), (2, 4, 1)], [(0, 1, 0), (1, 4, 1), (3, 4, 1), (2, 3, 0)])
    for links in trees:
        n = 4
        g = P.Graph(rng.integers(0, 2, (n, P.FEATURES)).astype(np.uint8), np.array([0, -1, 2, 0]), 1, np.array(links))
        weights = P.Weights(rng.normal(size=(P.FEATURES, k)) / 4, rng.normal(size=(k, k)), np.eye(k) * 1.5)
        assert np.allclose(P.marginals(g, weights), exact(g, weights), atol=1e-6)


def test_a_number_of_doubtful_form_follows_its_copy_far_away():
    """Without + the rules see no phone, and most numbers of that form are none; a copy elsewhere with + decides."""
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    number = lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"
    texts = []
    for i in range(600):
        n = number()
        texts.append(f"call +{digits(1)}-{n} or +{digits(1)}-{n} now" if i % 2 else f"part {number()} of {digits(3)}")
    weights = P.learned([P.graph([P.tokens(t, P.matches(t))]) for t in texts])
    apart = P.Weights(weights.unary, weights.chain, weights.skip * 0)
    alone = "part 743-555-3824 and nothing else"
    both = "call +1-743-555-3824 " + "and some more words " * 50 + "ask at 743-555-3824 or 743-555-3824"
    added = lambda text, w: [text[s:e] for x in [P.spans_of([text], w)[0]] for _, s, e in set(x[1]) - set(x[0])]
    assert added(alone, weights) == []
    assert added(both, weights) == ["743-555-3824"] * 2
    assert added(both, apart) == []


def test_batches_and_long_numeric_texts(monkeypatch):
    weights, card = learned_weights()
    rng = random.Random(8)
    texts = [f"{card} {card}", "", "call +1 (743) 555-3824 or (743) 555-3824"] + [
        " ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    whole = P.spans_of(texts, weights)
    monkeypatch.setattr(P, "BATCH_TOKENS", 25)
    monkeypatch.setattr(P, "BATCH_LINKS", 7)
    assert P.spans_of(texts, weights) == whole == [P.spans_of([t], weights)[0] for t in texts]
    monkeypatch.undo()
    table = "\n".join(" ".join(str(rng.randrange(10**7)) for _ in range(10)) for _ in range(10_000))
    base, found = P.spans_of([table + f"\n{card} {card}"], weights)[0]
    assert set(base) <= set(found) and sum(k == 2 for k, _, _ in found) >= 2


def test_query_form_on_odd_rows(spark, odd_documents, no_documents):
    rows = {r.doc_id: r for r in P.personal_data(odd_documents, None).collect()}
    r = rows[10]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    text = odd_documents.filter("doc_id = 10").first().text
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text))
    assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert rows[4].spans == "" and rows[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert P.personal_data(no_documents, None).count() == 0
    assert P.fitted(no_documents.select("doc_id", "text")) is None
    clean = P.redacted(odd_documents, None)
    assert clean.columns == odd_documents.columns
    assert clean.filter("doc_id = 10").first().text == "mail [EMAIL] or [PHONE] é [IP], [CARD]"
    assert clean.filter("doc_id = 4").first().text is None
