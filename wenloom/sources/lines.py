"""Delimited lines with quoting: valid rows, and the rest with the reason for failure.

A schema gives one anchored pattern for whole rows. Lines that it doesn't match
pass through a pattern for the quoting of all fields, one for the number of
fields, and growing patterns of the first fields, of which the first that fails
names the broken field. All of it is JVM-side and needs no shuffle.

Blanks, tabs and line ends around a line are dropped first. A field that begins
with ``"`` must end with ``"``; inside, ``""`` is one quote and a tab is content;
elsewhere a quote is content.

Defined cases: null, empty and blank lines fail with ``columns``; lines that come
twice are two lines; lines of any length and with any number of tabs or quotes
are read whole (patterns are possessive, so they don't recurse); columns other
than the line's are passed on untouched; an empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_PLAIN = r'[^"\t][^\t]*+'
_END = r"(?=\t|\z)"
#: A field whose quoting is right, whatever its value.
FIELD = rf"(?:{_QUOTED}{_END}|{_PLAIN}{_END}|{_END})"


@dataclass(frozen=True)
class LineField:
    """A field: ``value`` is the pattern of a valid value when it isn't quoted, ``inner`` when it is."""

    name: str
    type: str
    value: str
    inner: str

    @property
    def pattern(self) -> str:
        return rf"(?:{self.inner}{_END}|{self.value}{_END})"


def text_field(name: str) -> LineField:
    """Text that isn't blank."""
    return LineField(name, "string", r'(?!")(?=[^\S\t]*+[^\s])[^\t]++', rf'(?="\s*+(?:[^"\s]|"")){_QUOTED}')


def digit_field(name: str) -> LineField:
    """A whole number from 0 to 9 in ASCII digits, blanks around it, leading zeros allowed."""
    return LineField(name, "int", r"[^\S\t]*+0*[0-9][^\S\t]*+", r'"\s*+0*[0-9]\s*+"')


#: A headline and its class.
HEADLINE = (text_field("text"), digit_field("label_id"))


def stripped(line: Column) -> Column:
    """Without blanks, tabs and line ends at both ends; null as empty."""
    return F.regexp_replace(F.coalesce(line, F.lit("")), r"(?U)\A\s++|(?<!\s)\s++\z", "")


def row_pattern(schema: tuple[LineField, ...]) -> str:
    return r"(?U)\A" + r"\t".join(f.pattern for f in schema) + r"\z"


def prefix_patterns(schema: tuple[LineField, ...]) -> list[str]:
    """Growing patterns: the first fields are valid."""
    return [r"(?U)\A" + r"\t".join(f.pattern for f in schema[: i + 1]) for i in range(len(schema))]


def _prepared(df: DataFrame, schema: tuple[LineField, ...], line: str) -> DataFrame:
    return df.withColumn("__line", stripped(F.col(line))).withColumn("__valid", F.col("__line").rlike(row_pattern(schema)))


def failures(df: DataFrame, schema: tuple[LineField, ...] = HEADLINE, line: str = "raw_line") -> DataFrame:
    """The failing lines with ``reason`` and ``broken_field`` (null if all named fields are fine)."""
    bad = _prepared(df, schema, line).where("not __valid")
    text = F.col("__line")
    reason = (
        F.when(~text.rlike(rf"\A{FIELD}(?:\t{FIELD})*+\z"), "quoting")
        .when(~text.rlike(rf"\A{FIELD}" + rf"\t{FIELD}" * (len(schema) - 1) + r"\z"), "columns")
        .otherwise("value")
    )
    broken = F.coalesce(*[F.when(~text.rlike(p), f.name) for f, p in zip(schema, prefix_patterns(schema))])
    return bad.withColumn("reason", reason).withColumn("broken_field", broken).drop("__line", "__valid")


def loaded(df: DataFrame, schema: tuple[LineField, ...] = HEADLINE, line: str = "raw_line") -> DataFrame:
    """The valid lines, with the schema's fields as columns (they replace columns of the same name)."""
    good = _prepared(df, schema, line).where("__valid")
    cut = rf"\A({FIELD})" + rf"\t({FIELD})" * (len(schema) - 1) + r"\z"
    for i, f in enumerate(schema, 1):
        raw = F.regexp_extract("__line", cut, i)
        inner = F.replace(raw.substr(F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
        value = F.when(raw.startswith('"'), inner).otherwise(raw)
        if f.type != "string":
            value = F.regexp_replace(value, r"(?U)\s", "").cast(f.type)
        good = good.withColumn(f"__{f.name}", value)
    names = {f.name for f in schema}
    kept = [c for c in df.columns if c not in names]
    return good.select(*kept, *[F.col(f"__{f.name}").alias(f.name) for f in schema])
