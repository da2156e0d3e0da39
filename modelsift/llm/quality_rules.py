"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of characters other than the space and the controls 9 to 13; a null or empty text has none
and fails the base rules (fewer than 20 words). Every text is measured whole, whatever its length: repeated
8-word windows are found by sorting the windows' hashes, not by comparing them with each other. Rows do not
depend on each other, so ties and repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm.common import OWN, SPACE, table, words

WINDOW = 8

# Frequent function words of the languages at hand (English, German, French, Spanish).
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this at from or an a not "
    "der die das und ist von zu den mit sich des auf im dem nicht ein eine als auch es "
    "le la les de et un une du en que qui dans est pour sur pas au ne se "
    "el los las y que se del con una su por para lo al como"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails when the metric is below `low` or above `high`."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


# The threshold table. Ratios are per word, per line or per word character.
RULES = (
    Rule("symbols", "symbols_per_word", high=0.25),
    Rule("shouting", "marks_per_word", high=0.5),
    Rule("capitals", "capitals_per_char", high=0.4),
    Rule("word_length", "chars_per_word", low=2.0, high=20.0),
    Rule("repeated_lines", "dup_lines_per_line", high=0.4),
    Rule("stop_words", "stop_words_per_word", low=0.005),
    Rule("echoes", "echoes_per_word", high=0.2),
)


def _let(value: Column, body) -> Column:
    """body(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_hashes(hashes: Column) -> Column:
    """Hash of each 8-word window, from the words' hashes."""

    def at(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        )

    return F.when(F.size(hashes) >= WINDOW, _let(hashes, at)).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: sort (hash, place), keep runs, add the places' own shares."""

    def places(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"].eqNullSafe(F.get(pairs, j)["h"])
        kept = F.filter(pairs, lambda p, i: ((i > 0) & same(i, i - 1)) | same(i, i + 1))
        return F.sort_array(F.transform(kept, lambda p: p["i"]))

    def share(at: Column) -> Column:
        each = F.transform(
            at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))).cast("long")
        )
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(pairs, places), share)


def _count(items: Column, keep) -> Column:
    return F.size(F.filter(items, keep))


def measures(docs: DataFrame) -> DataFrame:
    """docs with __ms_ columns of counts; texts are split once."""
    o = OWN
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumns(
        {
            o + "words": words(F.col("text")),
            o + "lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            o + "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
            o + "symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            o + "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            o + "marks": F.regexp_count(text, F.lit(r"[!?]")).cast("long"),
            o + "stop_words": F.regexp_count(
                text, F.lit(r"(?i)(?<![^\x20\x09-\x0D])(?:" + "|".join(sorted(set(STOP_WORDS))) + r")(?![\p{L}])")
            ).cast("long"),
            o + "echoes": F.regexp_count(
                text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))")
            ).cast("long"),
        }
    )
    hashed = split.withColumns(
        {
            o + "n_words": F.size(o + "words").cast("long"),
            o + "n_lines": F.size(o + "lines").cast("long"),
            o + "dup_lines": (F.size(o + "lines") - F.size(F.array_distinct(o + "lines"))).cast("long"),
            o + "windows": _window_hashes(F.transform(o + "words", lambda w: F.xxhash64(w))),
        }
    )
    repeats = F.size(F.array_distinct(o + "windows")) < F.size(o + "windows")
    return hashed.withColumn(
        o + "repeat_words", F.when(repeats, _covered(F.col(o + "windows"))).otherwise(F.lit(0).cast("long"))
    ).drop(o + "words", o + "lines", o + "windows")


def _metrics() -> dict[str, Column]:
    c = lambda n: F.col(OWN + n)
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    return {
        "symbols_per_word": per("symbols", "n_words"),
        "marks_per_word": per("marks", "n_words"),
        "capitals_per_char": per("capitals", "word_chars"),
        "chars_per_word": per("word_chars", "n_words"),
        "dup_lines_per_line": per("dup_lines", "n_lines"),
        "stop_words_per_word": per("stop_words", "n_words"),
        "echoes_per_word": per("echoes", "n_words"),
    }


def compiled(rules=RULES) -> Column:
    """Names of the rules that a text fails, as one expression."""
    metrics = _metrics()
    failed = []
    for rule in rules:
        m = metrics[rule.metric]
        out = F.lit(False)
        if rule.low is not None:
            out = out | (m < rule.low)
        if rule.high is not None:
            out = out | (m > rule.high)
        failed.append(F.when(out, F.lit(rule.name)))
    return F.array_compact(F.array(*failed))


def quality_verdicts(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with the base counts, base_failed, failed_rules and kept."""
    o = OWN
    measured = measures(docs).withColumn(o + "failed", compiled(rules))
    base = (F.col(o + "n_words") < 20) | (F.col(o + "repeat_words") * 100 > F.col(o + "n_words") * 30)
    return measured.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(o + "n_words").alias("n_words"),
        F.col(o + "word_chars").alias("word_chars"),
        F.col(o + "symbols").alias("n_symbols"),
        F.col(o + "dup_lines").alias("n_dup_lines"),
        F.col(o + "repeat_words").alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & (F.size(o + "failed") == 0)).alias("kept"),
        F.array_join(o + "failed", ",").alias("failed_rules"),
    )


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    ratio = {
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "marks_per_word": "marks / greatest(n_words, 1)",
        "capitals_per_char": "capitals / greatest(word_chars, 1)",
        "chars_per_word": "word_chars / greatest(n_words, 1)",
        "dup_lines_per_line": "n_dup_lines / greatest(n_lines, 1)",
        "stop_words_per_word": "stop_words / greatest(n_words, 1)",
        "echoes_per_word": "echoes / greatest(n_words, 1)",
    }
    failed = []
    for r in RULES:
        tests = [f"{ratio[r.metric]} {sign} {v}" for sign, v in (("<", r.low), (">", r.high)) if v is not None]
        failed.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
gap AS (SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS g FROM twice),
cover AS (SELECT r, sum(g)::BIGINT AS n FROM gap GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '\\p{{Lu}}')) AS capitals, len(regexp_extract_all(t, '[!?]')) AS marks,
         len(list_filter(w, lambda x: lower(regexp_extract(x, '^[A-Za-z]+(\\P{{L}}|$)')) <> ''
             AND list_contains([{stop}], lower(regexp_extract(x, '^[A-Za-z]+'))))) AS stop_words,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS echoes
  FROM d LEFT JOIN cover USING (r)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         array_to_string(list_filter([{", ".join(failed)}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM f
"""


SQL = _sql()
