"""Small functions on columns: names, codes, dates, formats, tags, keys and tolerance tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_code(code: Column) -> Column:
    """The first six digits of a code; null for fewer."""
    digits = F.regexp_replace(code, "[^0-9]", "")
    return F.when(F.length(digits) >= 6, F.substring(digits, 1, 6))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def iso_day(day: Column) -> Column:
    """Empty where there is no day."""
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def compact_day(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def safe_name(name: Column) -> Column:
    """A name fit for a file: other characters than letters, digits, underscore, dot and hyphen become underscores, none of
    which, nor dots, stay at the ends; ``unnamed`` for what is empty then."""
    clean = F.btrim(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_.-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unnamed"))


def day_in_name(name: Column) -> Column:
    """The first eight digits in a row, as a date; null if there are none or they are no date."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"(\d{8})", 1), F.lit("")), "yyyyMMdd")


def truthy(x: Column) -> Column:
    """Whether a text says yes: true, 1 or yes in any case, between blanks; false for null."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def finite(x: Column) -> Column:
    """A number, or null for text that is none, NaN and infinity."""
    v = x.cast("string").try_cast("double")
    return F.when((v - v) == 0, v)


def percent(x: Column, digits: int = 1, missing: str = "—", signed: bool = False) -> Column:
    v = finite(x)
    return F.when(v.isNull(), missing).otherwise(F.format_string(f"%{'+' if signed else ''}.{digits}f%%", v * 100))


def price(x: Column) -> Column:
    v = finite(x)
    return F.when(v.isNull(), "—").otherwise(F.format_string("%.4f", v))


def yes_or_blank(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), "yes").otherwise("")


def parse_percent(x: Column) -> Column:
    """A number written with or without a percent sign; null for blanks, dashes and what is no number."""
    text = F.trim(x.cast("string"))
    return F.when(~text.isin("", "—", "-", "nan", "None"), F.regexp_replace(text, "%$", "").try_cast("double"))


def whole(x: Column) -> Column:
    """A whole number, cut toward zero; null for what is no number."""
    return finite(F.trim(x.cast("string"))).cast("long")


def business_day(day: Column, back: int) -> Column:
    """The day so many working days before; weekends count as the Monday after."""
    weekday = F.weekday(day)
    start = F.when(weekday >= 5, F.date_add(day, 7 - weekday)).otherwise(day)
    weeks, rest = divmod(back, 5)
    return F.date_sub(start, F.lit(7 * weeks) + F.when(F.weekday(start) < rest, rest + 2).otherwise(rest))


def window_start(day: Column, lookback: int, spare: int = 30) -> Column:
    return F.date_sub(day, lookback + spare)


def digest(parts: list[Column], length: int) -> Column:
    """The first hexadecimal digits of the SHA-256 of parts joined by bars; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def markdown_cell(x: Column) -> Column:
    """Text that stays in its cell: line ends become breaks, bars an entity."""
    return F.replace(F.regexp_replace(x.cast("string"), r"\r\n|\r|\n", "<br>"), F.lit("|"), F.lit("&#124;"))


def code_with_name(code: Column, name: Column) -> Column:
    """The code, and its name after a blank if it has one."""
    return F.concat_ws(" ", F.trim(code), F.nullif(F.trim(name), F.lit("")))


def display_names(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` (code, name) with label: the name, or the code without one; where an earlier row has the name, with
    the code after it."""
    base = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("code"))
    taken = F.row_number().over(Window.partitionBy(base).orderBy(order)) > 1
    return rows.withColumn("label", F.when(taken, F.concat(base, F.lit("("), F.col("code"), F.lit(")"))).otherwise(base))


def close_to(a: Column, b: Column, absolute: float = 1e-4, relative: float = 0.0) -> Column:
    """Whether two numbers differ by no more than a tolerance; false with a null."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(absolute), F.abs(b) * relative), F.lit(False))


def window_list(text: str) -> list[int]:
    """Whole numbers between commas, sorted, once each. An error if there are none."""
    out = sorted({int(x) for x in text.split(",") if x.strip()})
    if not out:
        raise ValueError("no windows")
    return out


def windows(text: Column) -> Column:
    """As ``window_list``, for a column; null if there are none."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.array_sort(F.array_distinct(parts)))
