"""Text, id and JSON expressions."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters treated as blank at the ends of a text.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
GUID_PATTERN = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
LIST_SEPARATORS = r"[,;\s]+"


def strip(col) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def blank_to_null(col) -> Column:
    """'' counts as absent; blanks-only text does not."""
    return F.nullif(col, F.lit(""))


def stable_id(*parts) -> Column:
    """SHA-256 of the parts joined by '|'; a null part counts as ''.

    Plain concat_ws would skip null parts and shift the others.
    """
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def canonical_name(text: str) -> str:
    """Column heading -> lower-case name with single underscores."""
    return "_".join(re.findall(r"[a-z0-9]+", text.lower()))


def canonical_text(col: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip(col)), "[^a-z0-9]+", "_"), F.lit("_"))


def guids_in(*cols: Column) -> Column:
    """All GUIDs inside the given texts, lower-case, as an array."""
    found = F.regexp_extract_all(F.concat_ws(" ", *cols), F.lit(f"({GUID_PATTERN})"), F.lit(1))
    return F.transform(found, F.lower)


def normalized_guid(col: Column) -> Column:
    """Any accepted GUID spelling -> lower-case hyphenated form, null when it is not a GUID."""
    bare = F.replace(F.replace(F.lower(col), F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    digits = F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit(""))
    hyphenated = F.concat_ws(
        "-",
        F.substring(digits, 1, 8),
        F.substring(digits, 9, 4),
        F.substring(digits, 13, 4),
        F.substring(digits, 17, 4),
        F.substring(digits, 21, 12),
    )
    return F.when(digits.rlike("^[0-9a-f]{32}\\z"), hyphenated)


def list_items(col: Column) -> Column:
    return F.filter(F.split(col, LIST_SEPARATORS), lambda x: x != "")


def guid_list(col: Column) -> Column:
    """Separated GUID text -> distinct GUIDs in order; an invalid entry becomes a null element."""
    return F.array_distinct(F.transform(list_items(col), normalized_guid))


def upn_list(col: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(list_items(col), F.lower)))


def normalized_requester(col: Column) -> Column:
    return blank_to_null(F.lower(strip(col)))


def error_text(kind: Column, message: Column) -> Column:
    return F.concat(kind, F.lit(": "), message)


def iso_text(col: Column, zoned: bool) -> Column:
    """ISO text of a timestamp; microseconds only when present."""
    micros = F.date_format(col, "SSSSSS")
    return F.concat(
        F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00" if zoned else ""),
    )


def json_text(df: DataFrame, name: str) -> Column:
    """A struct column as one JSON object: sorted keys, nulls kept, timestamps in ISO form."""
    fields = []
    for field in sorted(df.schema[name].dataType.fields, key=lambda f: f.name):
        col = F.col(name).getField(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = iso_text(col, isinstance(field.dataType, T.TimestampType))
        fields.append(col.alias(field.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
