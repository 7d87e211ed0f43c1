"""Result pages: HTML sections (S6) and text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.functions.names import let, strip


def plain_text(c: Column) -> Column:
    """Without tags, trimmed."""
    return strip(F.regexp_replace(c, "<[^>]+>", ""))


def extract_html_rows(
    df: DataFrame, html: str, *, section: str, title: str, row: str, cell: str, fields: dict[str, str] | None = None, skip: str | None = None
) -> DataFrame:
    """Rows of the sections of a page with the section's title and fields.

    ``section`` is the marker that starts a section, the others are patterns with one group.
    Sections without a title, and those whose title contains ``skip``, are left out.
    """
    keep = [c for c in df.columns if c != html]
    parts = F.slice(F.split(F.col(html), section), 2, 2**31 - 1)
    d = df.select(*keep, F.posexplode(parts).alias("section_no", "_s"))
    d = d.filter(F.regexp_like("_s", F.lit(f"(?s){title}")))
    d = d.withColumn("title", plain_text(F.regexp_extract("_s", f"(?s){title}", 1)))
    if skip:
        d = d.filter(~F.contains(F.upper("title"), F.lit(skip.upper())))
    named = [F.nullif(strip(F.regexp_extract("_s", f"(?s){p}", 1)), F.lit("")).alias(n) for n, p in (fields or {}).items()]
    d = d.select(*keep, "section_no", "title", *named, F.posexplode(F.regexp_extract_all("_s", F.lit(f"(?s){row}"), F.lit(1))).alias("row_no", "_r"))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(f"(?s){cell}"), F.lit(1)), plain_text)
    return d.select(*keep, "section_no", "title", *(fields or {}), "row_no", cells.alias("cells"))


def text_block_records(df: DataFrame, key: str, text: str, start: str, width: int = 7) -> DataFrame:
    """Records of a text (S7): a line that matches ``start`` opens one, the next ``width`` filled lines are its fields.

    One pass inside the row: the places of the opening lines, then a slice of the lines from each to the next. Nothing is shuffled, so texts with
    equal keys stay apart.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    opens = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(F.regexp_like(x, F.lit(start)), i)), lambda i: i.isNotNull())
    until = lambda ls, at, j: F.least(F.lit(width + 1), F.coalesce(F.get(at, j + 1), F.size(ls)) - F.get(at, j))
    cut = lambda ls: let(opens(ls), lambda at: F.transform(at, lambda p, j: F.slice(ls, p + 1, until(ls, at, j))))
    d = df.select(key, F.posexplode(let(lines, cut)).alias("_n", "_r"))
    return d.select(key, (F.col("_n") + 1).cast("bigint").alias("record_no"), *[F.get("_r", F.lit(i)).alias("start" if i == 0 else f"f{i}") for i in range(width + 1)])


def typed_record(df: DataFrame) -> DataFrame:
    """Typed fields of result records: rank line, "no / country", handler, dog, time or status, penalties, speed."""
    number = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), p, 1), F.lit("")).try_cast("double")
    status = F.coalesce(F.col("f4"), F.lit(""))
    out = F.contains(status, F.lit("DISQ")) | (status == "NP")
    who = r"^[A-Z]?(\d+)\s*/\s*(.+)$"
    d = df.filter(F.col("f3").isNotNull() & F.regexp_like("f1", F.lit(who)))
    return d.select(
        *[c for c in df.columns if c not in ("start", *[f"f{i}" for i in range(1, 8)])],
        F.nullif(F.regexp_extract("start", r"^(\d+)º$", 1), F.lit("")).cast("int").alias("rank"),
        F.regexp_extract("f1", who, 1).cast("bigint").alias("start_no"), strip(F.regexp_extract("f1", who, 2)).alias("country"),
        F.col("f2").alias("handler"), F.col("f3").alias("dog"), F.when(~out, number("f4", r"^([\d.]+)\s*s$")).alias("time"),
        F.when(~out, number("f5", r"^([\d.]+)\s*TP$")).alias("total_faults"), F.when(~out, number("f6", r"^([\d.]+)\s*m/s$")).alias("speed"),
        out.alias("eliminated"))
