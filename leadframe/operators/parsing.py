"""Strict load of delimited lines, with every other line set apart and diagnosed.

The loader knows only what a good line is. Lines are kept under their offset, the good ones are loaded with types, their
offsets are subtracted from all offsets by an anti-join, and what remains is given the first reason that applies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A field's rule: the whole of the trimmed value must match ``pattern``; then ``convert`` makes the column."""

    column: str
    index: int
    pattern: str | None = None
    type: str = "string"
    extract: int = 0


@dataclass(frozen=True)
class LineFormat:
    """Separator, number of fields, and the fields to load."""

    separator: str
    fields: tuple[Check, ...]
    width: int

    @property
    def field(self) -> str:
        s = self.separator
        return f'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{s}]*+)'

    @property
    def line(self) -> str:
        return f"(?s)\\A{self.field}(?:{self.separator}{self.field})*+\\z"


#: Header entries of the two export logs. Channels 1 to 512; samples positive, with an optional clock; a positive rate.
_CHANNELS = r"\A0*+((?:[1-9]|[1-9][0-9]|[1-4][0-9]{2}|50[0-9]|51[0-2]))\z"
_SAMPLES = r"\A([0-9]*[1-9][0-9]*)(?: [0-9]{2}:[0-5][0-9]:[0-5][0-9])?\z"
_RATE = r"\A((?=[0-9.]*[1-9])[0-9]+(?:\.[0-9]+)?) ?(?:Hz|points/second)?\z"


def header_log(separator: str) -> LineFormat:
    """The six-field header entries of an export log."""
    return LineFormat(
        separator,
        (
            Check("record_name", 0),
            Check("channels", 1, _CHANNELS, "int", 1),
            Check("samples", 2, _SAMPLES, "decimal(38,0)", 1),
            Check("rate", 3, _RATE, "double", 1),
            Check("start", 4),
            Check("note", 5),
        ),
        6,
    )


def _sound(fmt: LineFormat, text: Column) -> Column:
    return text.rlike(fmt.line)


def _fields(fmt: LineFormat, text: Column) -> Column:
    """Fields of a soundly quoted line, still as written. A leading separator makes every match non-empty."""
    return F.regexp_extract_all(F.concat(F.lit(fmt.separator), text), F.lit(f"(?s){fmt.separator}({fmt.field})"), F.lit(1))


def _plain(field: Column) -> Column:
    """A field's content: enclosure taken off, doubled quotes single, surrounding blanks gone."""
    unquoted = F.when(field.startswith('"'), F.replace(F.regexp_extract(field, r'(?s)\A"(.*)"\z', 1), F.lit('""'), F.lit('"'))).otherwise(field)
    return F.regexp_replace(unquoted, r"\A[ \t]+|[ \t]+\z", "")


def _with_fields(lines: DataFrame, fmt: LineFormat, offset: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return lines.select(F.col(offset), t.alias("_t")).withColumn("_f", F.when(_sound(fmt, F.col("_t")), _fields(fmt, F.col("_t"))))


def _values_ok(fmt: LineFormat) -> Column:
    ok = F.lit(True)
    for c in fmt.fields:
        if c.pattern:
            ok = ok & _plain(F.get(F.col("_f"), F.lit(c.index))).rlike(c.pattern)
    return ok


def strict_load(lines: DataFrame, fmt: LineFormat, offset: str = "raw_id", text: str = "raw_text") -> DataFrame:
    """The conforming lines with typed columns, under their offset; all others are absent.

    A number that its type cannot hold does not stop the load: it is null, and ``<column>_text`` has its digits.
    """
    good = _with_fields(lines, fmt, offset, text).filter((F.size("_f") == fmt.width) & _values_ok(fmt))
    cols = []
    for c in fmt.fields:
        v = _plain(F.get(F.col("_f"), F.lit(c.index)))
        if c.pattern:
            v = F.regexp_extract(v, c.pattern, c.extract)
        cols.append((v.try_cast(c.type) if c.type != "string" else v).alias(c.column))
        if c.type.startswith("decimal"):
            cols.append(F.regexp_replace(v, r"^0+(?=.)", "").alias(f"{c.column}_text"))
    return good.select(offset, *cols).dropDuplicates([offset])


def rejected(lines: DataFrame, fmt: LineFormat, offset: str = "raw_id", text: str = "raw_text") -> DataFrame:
    """Offsets that the strict load left out, with ``reason``: quoting, columns or value, the first that applies.

    A null line counts as an empty one. A line delivered again under its offset counts once.
    """
    loaded = strict_load(lines, fmt, offset, text).select(offset)
    rest = lines.select(offset, text).join(loaded, offset, "left_anti")
    reason = (
        F.when(F.col("_f").isNull(), "quoting").when(F.size("_f") != fmt.width, "columns").when(~_values_ok(fmt), "value")
    )
    return _with_fields(rest, fmt, offset, text).select(offset, reason.alias("reason")).distinct()
