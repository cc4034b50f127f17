"""Column functions on report text: years, amounts, growth rates, titles, keywords and number formats.

Patterns are in Java's syntax; white space is that of Unicode, written as a
class, which is faster than the flag that makes all classes follow Unicode.
Text that holds no value gives null.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Iterable
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the rules look for.
WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same, as characters.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
DASH = "[-–]"
TRAILING_YEAR = rf"{DASH}{WS}*(20[0-9]{{2}}){WS}*$"
YEAR_RANGE = rf"(20[0-9]{{2}}){WS}*{DASH}{WS}*(20[0-9]{{2}})"
YEAR_AFTER_BY = rf"(?i)\bby{WS}+(20[0-9]{{2}})\b"
STATED_GROWTH = rf"(?i)cagr of{WS}+([0-9.]+)%"
AMOUNT = rf"usd{WS}+([0-9.]+{WS}+(?:billion|million|thousand))"
#: In the order in which they are tried; a point stands for all but a line feed.
START_AMOUNT = [rf"(?:valued at|worth){WS}+{AMOUNT}", rf"(?d)in{WS}+20[0-9]{{2}}.*?{AMOUNT}"]
END_AMOUNT = [rf"reach{WS}+{AMOUNT}{WS}+by{WS}+20[0-9]{{2}}"]
UNITS = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
STOP_TOKENS = ["a", "an", "and", "for", "in", "of", "the", "to", "with", "global", "industry", "analysis", "report", "reports", "market", "markets"]


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), "^ | $", "")


def first_filled(*cs: Column) -> Column:
    """The first that is not empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def year(c: Column, pattern: str, n: int = 1) -> Column:
    return group(c, pattern, n).cast("int")


def trailing_year(c: Column) -> Column:
    return year(c, TRAILING_YEAR)


def range_start(c: Column) -> Column:
    return year(c, YEAR_RANGE)


def range_end(c: Column) -> Column:
    return year(c, YEAR_RANGE, 2)


def year_after_by(c: Column) -> Column:
    return year(c, YEAR_AFTER_BY)


def stated_growth(c: Column) -> Column:
    """Percent; null for what is no number, such as ``2.4.``."""
    return group(c, STATED_GROWTH).try_cast("double")


def amount_match(lowered: Column, patterns: list[str]) -> Column:
    """Number and unit as the first of the patterns that matches finds them in a lower-cased text. Where there is no unit of money, nothing is looked for."""
    return F.when(F.contains(lowered, F.lit("usd")), F.coalesce(*(group(lowered, p) for p in patterns)))


def matched_amount(match: Column) -> Column:
    """The amount of a match, in single units. A match is a number, white space and a unit, so that no pattern is needed to take it apart."""
    scale = F.when(match.endswith("thousand"), F.lit(UNITS["thousand"])).when(match.endswith("million"), F.lit(UNITS["million"])).when(match.endswith("billion"), F.lit(UNITS["billion"]))
    return F.btrim(match, F.lit(SPACES + "abcdefghijklmnopqrstuvwxyz")).try_cast("double") * scale


def amount(c: Column, patterns: list[str]) -> Column:
    """The amount of the first pattern that matches, in single units."""
    return matched_amount(amount_match(F.lower(c), patterns))


def start_amount(c: Column) -> Column:
    return amount(c, START_AMOUNT)


def end_amount(c: Column) -> Column:
    return amount(c, END_AMOUNT)


def implied_growth(start: Column, end: Column, periods: Column) -> Column:
    """Percent a year that leads from start to end; null unless both are positive, the periods are known and the result is finite."""
    growth = (F.pow(F.try_divide(end, start), F.lit(1.0) / F.greatest(periods, F.lit(1))) - 1) * 100
    return F.when(periods.isNotNull() & (start > 0) & (end > 0) & (F.abs(growth) < float("inf")), growth)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """Whether the text, lower-cased, holds one of the words anywhere."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


def normalized_title(c: Column, fold: Callable[[Column], Column] | None = None) -> Column:
    """A title without bracketed parts, year ranges and stop tokens, in lower-case ASCII letters and digits.

    ``fold`` turns text into ASCII first; without it other characters count as gaps.
    """
    text = F.lower(strip(fold(c) if fold else c))
    text = F.regexp_replace(text, r"\([^)]*\)", " ")
    text = F.regexp_replace(text, rf"\b20[0-9]{{2}}\s*{DASH}\s*20[0-9]{{2}}\b", " ")
    tokens = F.split(F.regexp_replace(text, r"[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(tokens, lambda x: (x != "") & ~x.isin(STOP_TOKENS)), " ")


def singular_token(x: Column) -> Column:
    """A token without its plural ending, by ordered rules; up to three characters stay."""
    long, size = F.length(x) > 4, F.length(x)
    ends = lambda *endings: functools.reduce(Column.__or__, (x.endswith(y) for y in endings))
    cut = lambda n: F.substring(x, F.lit(1), size - n)
    return (
        F.when(size <= 3, x)
        .when(long & x.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(long & ends("sses", "shes", "ches", "xes", "zes", "oes"), cut(2))
        .when(x.endswith("s") & ~ends("ss", "us", "is"), cut(1))
        .otherwise(x)
    )


def singular_title(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), singular_token), " ")


def slug_title(url: Column) -> Column:
    """The last part of a url's path, hyphens as spaces."""
    path = F.rtrim(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit("/"))
    return squeeze(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lit(" ")))


def fixed(c: Column, decimals: int) -> Column:
    """A double with so many decimals; ties of its exact binary value go to the even digit."""
    return F.call_function("format_number", c, F.lit("0." + "0" * decimals))


def long_date(c: Column) -> Column:
    """Such as April 10, 2026."""
    return F.date_format(c, "MMMM dd, yyyy")


def iso_timestamp(c: Column) -> Column:
    """Null if it can't be read."""
    return F.try_to_timestamp(F.nullif(strip(c), F.lit("")))


def local_day_start(day: Column, zone: str) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp_ntz").cast("timestamp"), zone)


def local_today(zone: str, now: dt.datetime | None = None) -> dt.date:
    """The calendar day that it is in a time zone."""
    return (now or dt.datetime.now(dt.UTC)).astimezone(ZoneInfo(zone)).date()
