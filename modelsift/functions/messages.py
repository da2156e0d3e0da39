"""Classification of errors and the sentences shown to readers."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelsift.functions.text import strip
from modelsift.functions.values import BYTES_PER_MB, fixed2

# Error categories in the order they are tried, with the texts that mark them.
ERROR_MARKS = {
    "AUTHENTICATION": ["401", "unauthorized", "authentication"],
    "AUTHORIZATION": ["403", "forbidden", "readwrite", "permission", "not authorized"],
    "THROTTLING": ["429", "throttl", "too many requests"],
    "TIMEOUT": ["timeout", "timed out"],
    "NOT_FOUND": ["not found", "doesn't exist", "does not exist"],
}
OTHER_ERROR = "ANALYSIS_ERROR"
RETRYABLE_CATEGORIES = ["THROTTLING", "TIMEOUT"]
RETRYABLE_MARKS = ["500", "502", "503", "504"]

# Fallback reasons that mean there is none.
NO_FALLBACK = ["none", "n/a", "no fallback"]

# Sentences.
CONFIRM_USE = (
    "Confirm the column is used by reports, measures, relationships, external XMLA clients, and exports "
    "before changing it."
)
ADVICE_DATETIME = (
    "If business precision permits, reduce DateTime precision or split Date and Time usage to reduce cardinality."
)
ADVICE_TEXT = (
    "Review long/high-cardinality text in fact tables; consider removal, normalization, or a surrogate key "
    "where semantically valid."
)
ADVICE_OTHER = (
    "Review granularity, data type, unused values, and whether aggregation can satisfy the reporting requirement."
)
STORAGE_FINDING = (
    "The column is a material contributor to model memory. This is a prioritization signal, not proof that "
    "the column is unnecessary."
)
UNUSED_FINDING = "The object was not observed in the selected usage evidence scope."
UNUSED_ACTION = (
    "Validate external tools, thin reports in other workspaces, Analyze in Excel, paginated reports, "
    "subscriptions, APIs, and future-use requirements before removal."
)
UNUSED_IN_REPORTS = "No references found in downstream reports available in PBIR format."
FALLBACK_ACTION = (
    "Resolve the reported fallback condition and validate query behavior and CU before/after the change."
)
NOTE_REFRESH_EMPTY = "Refresh history: no records were returned for the selected history window."
NOTE_REFRESH_NOT_RUN = "Refresh history: not requested by this analysis profile."
NOTE_USAGE_NOT_RUN = (
    "Object usage: not run in the standard profile; use the deep profile to collect usage evidence."
)
NOTE_USAGE_EMPTY = "Object usage: analysis completed and returned no observations."
NOTE_DIRECT_LAKE_NA = "Direct Lake checks: not applicable because this semantic model uses Import storage."
NOTE_DIRECT_LAKE_EMPTY = "Direct Lake checks: completed with no fallback observations."
NOTE_ACCESS_EMPTY = "Item access snapshot: completed and returned no explicit access records."
NOTE_DEFAULT = "All requested evidence sources returned data or an explicit status."


def _mentions(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def error_category(message: Column) -> Column:
    text = F.lower(message)
    category = F.lit(OTHER_ERROR)
    for name, marks in reversed(ERROR_MARKS.items()):
        category = F.when(_mentions(text, marks), F.lit(name)).otherwise(category)
    return category


def is_retryable(message: Column) -> Column:
    return F.coalesce(
        error_category(message).isin(RETRYABLE_CATEGORIES) | _mentions(F.lower(message), RETRYABLE_MARKS),
        F.lit(False),
    )


def is_fallback(reason: Column) -> Column:
    """A reason is present and is not one of the texts that mean 'none'. Blanks-only text counts."""
    return F.coalesce((reason != "") & ~F.lower(strip(reason)).isin(NO_FALLBACK), F.lit(False))


def is_direct_lake(storage_mode: Column) -> Column:
    return F.lower(F.replace(storage_mode, F.lit(" "), F.lit(""))).contains("directlake")


def storage_advice(data_type: Column) -> Column:
    kind = F.lower(F.coalesce(data_type, F.lit("")))
    advice = (
        F.when(kind.contains("date") & kind.contains("time"), F.lit(ADVICE_DATETIME))
        .when(kind.contains("string") | kind.contains("text"), F.lit(ADVICE_TEXT))
        .otherwise(F.lit(ADVICE_OTHER))
    )
    return F.concat_ws(" ", F.lit(CONFIRM_USE), advice)


def storage_evidence(size: Column, pct: Column, cardinality: Column) -> Column:
    """Absent parts are left out."""
    return F.concat(
        F.lit("Column size="),
        fixed2(F.coalesce(size, F.lit(0)) / F.lit(float(BYTES_PER_MB))),
        F.lit(" MB"),
        F.when(pct.isNotNull(), F.concat(F.lit("; model share="), fixed2(pct), F.lit("%"))).otherwise(F.lit("")),
        F.when(cardinality.isNotNull(), F.concat(F.lit("; cardinality="), F.format_number(cardinality, 0))).otherwise(
            F.lit("")
        ),
    )


def usage_evidence(monitored: bool, days: int) -> str:
    return f"No references in {days} days of Workspace Monitoring queries." if monitored else UNUSED_IN_REPORTS


def opportunity_title(domain: Column) -> Column:
    return F.concat(domain, F.lit(" optimization"))


def opportunity_summary(count: Column, source: Column, domain: Column) -> Column:
    return F.concat(
        count.cast("string"), F.lit(" finding(s) from "), source, F.lit(" require review in "), domain, F.lit(".")
    )


def availability_note(refresh, refresh_rows, usage, usage_rows, direct_lake, direct_lake_rows, access, access_rows):
    """Notes on empty or absent evidence, in a fixed order, or one default sentence."""
    done_empty = lambda status, rows: (status == "SUCCEEDED") & (rows == 0)
    notes = F.concat_ws(
        " ",
        F.when(done_empty(refresh, refresh_rows), NOTE_REFRESH_EMPTY).when(refresh == "NOT_RUN", NOTE_REFRESH_NOT_RUN),
        F.when(usage == "NOT_RUN", NOTE_USAGE_NOT_RUN).when(done_empty(usage, usage_rows), NOTE_USAGE_EMPTY),
        F.when(direct_lake == "NOT_APPLICABLE", NOTE_DIRECT_LAKE_NA).when(
            done_empty(direct_lake, direct_lake_rows), NOTE_DIRECT_LAKE_EMPTY
        ),
        F.when(done_empty(access, access_rows), NOTE_ACCESS_EMPTY),
    )
    return F.when(notes == "", F.lit(NOTE_DEFAULT)).otherwise(notes)
