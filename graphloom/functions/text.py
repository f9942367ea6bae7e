"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str methods see it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind; null stays null."""
    return F.regexp_replace(text, EDGES, "")


def norm_key(text: Column) -> Column:
    """Text key: lower case, white space collapsed and stripped; null is empty."""
    return strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "))


def tokens(text: Column) -> Column:
    """Lower-cased white-space tokens, duplicates kept; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda t: t != "")


def content_id(prefix: str, *parts: Column) -> Column:
    """Content-addressed id: ``prefix-`` and the MD5 of the parts joined by ``|``."""
    return F.concat(F.lit(prefix + "-"), F.md5(F.concat_ws("|", *parts).cast("binary")))


def present(text: Column) -> Column:
    """Null for empty text, so that coalesce skips it."""
    return F.when(text != "", text)


def first_present(*texts: Column) -> Column:
    return F.coalesce(*[present(t) for t in texts])


def float_or(value: Column, default: float) -> Column:
    """A number, or ``default`` where the cast fails or the value is null."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def chunk(node_id: Column, text: Column) -> Column:
    """Context chunk ``[id] text``; null where there is no text."""
    return F.when(strip(text) != "", F.concat(F.lit("["), node_id, F.lit("] "), strip(text)))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def ordered_distinct(items: Column) -> Column:
    """Strings of ``items`` without later repeats."""
    return F.array_distinct(F.transform(items, lambda x: x.cast("string")))


#: A NaN outside of strings: what follows it is balanced.
BARE_NAN = r'\bNaN\b(?=(?:[^"\\]|\\.|"(?:[^"\\]|\\.)*")*$)'


def nan_to_null(column: Column, kind: T.DataType) -> Column:
    """Null for every NaN in a number, and in the numbers of arrays, maps and structs."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: nan_to_null(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, x: nan_to_null(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[nan_to_null(column[f.name], f.dataType).alias(f.name) for f in kind]))
    return column


def json_nan_to_null(record: Column) -> Column:
    """JSON text whose bare NaN are null; text without any stays as it is."""
    return F.when(F.contains(record, F.lit("NaN")), F.regexp_replace(record, BARE_NAN, "null")).otherwise(record)


def prettified(path: str) -> str:
    """A label from the last segment of a path: words capitalised unless all caps or with a digit."""
    last = str(path).rstrip("/").split("/")[-1]
    words = last.replace("-", " ").replace("_", " ").split()
    return " ".join(w if w.isupper() or any(c.isdigit() for c in w) else w.capitalize() for w in words)
