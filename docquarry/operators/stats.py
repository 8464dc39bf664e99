"""Counters, value counts, nested reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, value: str, *, key: str) -> DataFrame:
    """How often each value occurs, and the first key that has it."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))


def first_of_each(df: DataFrame, value: str, *, key: str) -> DataFrame:
    """Per distinct value, the smallest key."""
    return df.groupBy(value).agg(F.min(key).alias(key))


def totals(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Counters per group, per leading part of the group, and over all (rollup); level says how many keys are summed over."""
    return df.rollup(*by).agg(F.grouping_id().cast("long").alias("level"), *[m.alias(n) for n, m in measures.items()])


def ratio(part: Column, whole: Column, scale: int = 4) -> Column:
    """part over whole as a decimal; null where whole is 0."""
    return F.when(whole != 0, (part.cast("decimal(18,6)") / whole.cast("decimal(18,6)")).cast(f"decimal(18,{scale})"))


def json_report(fields: dict[str, Column]) -> Column:
    """One JSON object with the fields in the order given."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def xml_report(fields: dict[str, Column], root: str = "report") -> Column:
    """One XML element; control characters that XML forbids become \\xHH."""
    def clean(c: Column) -> Column:
        return F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "?")

    return F.to_xml(F.struct(*[clean(c).alias(n) for n, c in fields.items()]), {"rowTag": root})


def text_report(df: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """(report): one text, a line per row of a summary table, in order of the columns. For tables of some hundred rows: all lines meet in one value."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("r"))
    return rows.select(F.array_join(F.transform("r", lambda x: F.format_string(line, *[x[c] for c in columns])), "\n").alias("report"))
