"""Identifiers, record status and text dates in their normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed from ids, dates and status texts.
BLANKS = " \t\n\r\x0b\x0c\u00a0"


def trimmed(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def norm_id(c: Column | str) -> Column:
    """Positive whole number in plain decimal digits, or null.

    Accepts padding, leading zeros, a plus sign, a zero fraction and an exponent. Ids of any length are
    kept exactly, since the plain spelling never goes through a floating number.
    """
    s = trimmed(c)
    plain = F.regexp_extract(s, r"^\+?0*([1-9][0-9]*)(?:\.0*)?$", 1)
    wide = F.when(s.rlike(r"^\+?[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]{1,2}$"), s).try_cast("decimal(38,9)")
    whole = F.when((wide > 0) & (wide == F.floor(wide)), F.floor(wide).cast("string"))
    return F.when(plain != "", plain).otherwise(whole)


def id_order(c: Column | str) -> list[Column]:
    """Sort keys that put ids in normal form into numeric order, whatever their length."""
    c = F.col(c) if isinstance(c, str) else c
    return [F.length(c), c]


def is_deleted(c: Column | str) -> Column:
    """True where the trimmed status begins with d in any case; null is live."""
    return F.coalesce(F.lower(trimmed(c)).startswith("d"), F.lit(False))


def sql_norm_id(c: str) -> str:
    """The same normal form as DuckDB SQL."""
    s = f"trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160))"
    dec = f"try_cast({s} as decimal(38,9))"
    return (
        f"(case when regexp_matches({s}, '^\\+?0*[1-9][0-9]*(\\.0*)?$') then regexp_extract({s}, '^\\+?0*([1-9][0-9]*)', 1) "
        f"when regexp_matches({s}, '^\\+?[0-9]+(\\.[0-9]*)?[eE][+-]?[0-9]+$') and {dec} > 0 and {dec} = floor({dec}) "
        f"then cast(cast({dec} as hugeint) as varchar) end)"
    )


def sql_deleted(c: str) -> str:
    return f"coalesce(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) like 'd%', false)"


#: Month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Texts that mean "still running" besides null and blank.
OPEN_WORDS = "^(c|cur|curr|current|currently|present|now|ongoing|open|to date|today|active)$"
#: Last year that a closed end may have.
LAST_YEAR = 2100


def _bind(value: Column, body) -> Column:
    """body(x) with x = `value`, evaluated once; keeps generated code small where x is used often."""
    return F.transform(F.array(value), body)[0]


def _parts(s: Column) -> Column:
    """y, m and d of a lower-case trimmed text date; m or d null where not given, y null if unreadable."""
    names = "|".join(MONTHS)
    pick = lambda p, g: F.nullif(F.regexp_extract(s, p, g), F.lit("")).try_cast("int")
    ymd = r"^([0-9]{4})[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2})(?:[ t][0-9:.]+z?)?)?$"
    packed = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
    named = rf"^(?:([0-9]{{1,2}})[ -])?({names})[a-z]*\.?,?[ -]([0-9]{{4}})$"
    only = r"^([0-9]{4})(?:\.0*)?$"
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(s, named, 2)), F.lit(0)).cast("int")
    return F.struct(
        F.coalesce(pick(only, 1), pick(ymd, 1), pick(packed, 1), pick(named, 3)).alias("y"),
        F.coalesce(pick(ymd, 2), pick(packed, 2), month).alias("m"),
        F.coalesce(pick(ymd, 3), pick(packed, 3), pick(named, 1)).alias("d"),
    )


def text_date(c: Column | str, last: bool = False) -> Column:
    """Day of a text date; one given to the month or year becomes its first or, with `last`, its last day.

    Null for anything that isn't a calendar day, month or year, impossible days included. "1987.0" is a year.
    """
    clamp = lambda x, lo, hi: F.greatest(F.least(F.coalesce(x, F.lit(lo)), F.lit(hi)), F.lit(lo))

    def day(p: Column) -> Column:
        first = F.make_date(clamp(p["y"], 1, 9999), F.when(p["m"].isNull(), 12 if last else 1).otherwise(clamp(p["m"], 1, 12)), F.lit(1))
        ok = p["y"].isNotNull() & (p["y"] >= 1) & (p["m"].isNull() | p["m"].between(1, 12))
        exact = F.when(p["d"].between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, clamp(p["d"], 1, 31) - 1))
        return F.when(ok & p["d"].isNull(), F.last_day(first) if last else first).when(ok, exact)

    return _bind(F.lower(trimmed(c)), lambda s: _bind(_parts(s), day))


def is_open_end(c: Column | str) -> Column:
    """True for null, blank, words for "current" and dates after LAST_YEAR."""
    s = F.lower(trimmed(c))
    late = text_date(c, last=True) > F.make_date(F.lit(LAST_YEAR), F.lit(12), F.lit(31))
    return F.coalesce(s == "", F.lit(True)) | s.rlike(OPEN_WORDS) | F.coalesce(late, F.lit(False))
