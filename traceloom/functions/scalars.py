"""Scalar functions as column expressions. All are null-safe and none throws on bad text under ANSI mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths of padded order numbers, texts of flags, layouts of dates and times.
SALES_WIDTH, PRODUCTION_WIDTH = 10, 12
TRUE_TEXTS = ("1", "true", "yes", "y", "是")
FALSE_TEXTS = ("0", "false", "no", "n", "否")
TIME_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMddHHmmss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm")
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd")
COMPANY_PREFIX = "XNC"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """As trimmed text; null for a blank."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def norm_order(c: Column | str) -> Column:
    """Leading zeros off a number of ASCII digits; other text only trimmed."""
    trimmed = F.trim(col(c).cast("string"))
    return F.when(trimmed.rlike("^[0-9]+$"), F.regexp_replace(trimmed, "^0+(?=.)", "")).otherwise(trimmed)


def station_order(c: Column | str) -> Column:
    """As ``norm_order``, but null unless it is a number."""
    trimmed = F.trim(col(c).cast("string"))
    return F.when(trimmed.rlike("^[0-9]+$"), F.regexp_replace(trimmed, "^0+(?=.)", ""))


def bare_order(c: Column | str) -> Column:
    """Leading zeros off any trimmed text, number or not; zeros alone are 0."""
    trimmed = F.trim(col(c).cast("string"))
    return F.regexp_replace(trimmed, "^0+(?=.)", "")


def order_key(c: Column | str) -> Column:
    """As ``norm_order``, with the empty text for null."""
    return F.coalesce(norm_order(c), F.lit(""))


def order_candidates(value: str, width: int) -> list[str]:
    """The spellings of an order number: as given, without zeros, padded. They become literals, so the filter reaches the scan."""
    value = value.strip()
    if not (value.isascii() and value.isdigit()):
        return [value]
    bare = value.lstrip("0") or "0"
    return list(dict.fromkeys([value, bare, bare.rjust(width, "0")]))


def split_values(value: str) -> list[str]:
    """Different values of a list with ASCII or full-width commas."""
    return list(dict.fromkeys(v.strip() for v in value.replace("，", ",").split(",") if v.strip()))


def parse_date(c: Column | str) -> Column:
    """A DATE from ISO, compact or slashed text, or from the date part of a time; null if there's no such day."""
    value = text(c)
    by = lambda layout: F.try_to_timestamp(value, F.lit(layout))
    # the usual shapes take one call; a call that fails is dear
    found = F.when(value.rlike("^[0-9]{8}$"), by("yyyyMMdd")).when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), by("yyyy-MM-dd"))
    return found.when(value.isNotNull(), F.coalesce(*[by(layout) for layout in (*DATE_LAYOUTS, *TIME_LAYOUTS)])).cast("date")


def parse_time(c: Column | str) -> Column:
    value = text(c)
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(layout)) for layout in (*TIME_LAYOUTS, *DATE_LAYOUTS)])


def utc_time(c: Column | str) -> Column:
    """The UTC time of ISO text with or without an offset, of times without seconds, and of days; null for other text. Times without an offset are UTC."""
    value = text(c)
    zoned = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})$")
    plain = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?$")
    whole = F.regexp_replace(F.regexp_replace(value, "^(.{10})$", "$1 00:00"), "^(.{10}[T ][0-9]{2}:[0-9]{2})(?!:)", "$1:00")
    return F.when(plain, F.concat(whole, F.lit("Z"))).when(zoned, whole).try_cast("timestamp")


def months_before(time: Column, months: int) -> Column:
    """The same time of day so many calendar months before; a day that the month lacks becomes its last one."""
    return time - F.make_interval(months=F.lit(months))


def iso_date(c: Column | str) -> Column:
    """``YYYY-MM-DD`` for eight digits; other text as it is."""
    value = col(c).cast("string")
    return F.when(value.rlike("^[0-9]{8}$"), F.regexp_replace(value, "^(.{4})(.{2})(.{2})$", "$1-$2-$3")).otherwise(value)


def optional_number(c: Column | str) -> Column:
    """A finite double from text with or without thousands separators, else null."""
    value = F.regexp_replace(text(c), ",", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def number(c: Column | str) -> Column:
    """As ``optional_number``, with 0 for null."""
    return F.coalesce(optional_number(c), F.lit(0.0))


def optional_flag(c: Column | str) -> Column:
    """True, false, or null where the text is neither."""
    value = F.lower(text(c))
    return F.when(value.isin(*TRUE_TEXTS), F.lit(True)).when(value.isin(*FALSE_TEXTS), F.lit(False))


def flag_value(value: str | None) -> bool | None:
    """The same for a parameter."""
    value = (value or "").strip().lower()
    return True if value in TRUE_TEXTS else False if value in FALSE_TEXTS else None


def first_text(*columns: Column | str) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*[text(c) for c in columns])


def first_value(*columns: Column | str) -> Column:
    """The first that isn't null, as text: it wins even if it is blank or can't be parsed."""
    return F.coalesce(*[col(c).cast("string") for c in columns])


def present_any(*columns: Column | str) -> Column:
    """Any of the columns is there and not empty."""
    return any_of([~missing(c) for c in columns])


def equals_any(columns: list[Column | str], value) -> Column:
    return any_of([F.coalesce(col(c) == F.lit(value), F.lit(False)) for c in columns])


def missing(c: Column | str) -> Column:
    """Null or the empty text; blanks count as present."""
    return F.coalesce(col(c).cast("string"), F.lit("")) == ""


def blank(c: Column | str) -> Column:
    """Null, empty or only blanks."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) == ""


def not_in(c: Column | str, values) -> Column:
    """True as well where the column is null."""
    return F.coalesce(~col(c).isin(*values), F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def exact(c: str, values: str, width: int | None = None) -> Column:
    """The column is one of the listed values, with the spellings of order numbers if ``width`` is given; an empty list matches all."""
    wanted = split_values(values)
    if width:
        wanted = list(dict.fromkeys(x for v in wanted for x in order_candidates(v, width)))
    return F.col(c).isin(*wanted) if wanted else F.lit(True)


def exact_any(columns: list[str], values: str) -> Column:
    """Any of the columns is one of the listed values; an empty list matches none."""
    wanted = split_values(values)
    return any_of([F.col(c).isin(*wanted) for c in columns]) if wanted else F.lit(False)


def keyword_in(columns: list[str], keyword: str) -> Column:
    """Any of the columns contains the keyword, whatever its case."""
    return any_of([F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(keyword.lower()) for c in columns])


def in_days(day: Column, first: str | None, last: str | None) -> Column:
    """A DATE from ``first`` to ``last``, both included and either absent."""
    return all_of(([day >= F.lit(first).cast("date")] if first else []) + ([day <= F.lit(last).cast("date")] if last else []))


def in_compact_days(c: Column | str, first: str | None, last: str | None) -> Column:
    """Days as compact text, from ``first`` to ``last``, both included, either absent, with or without dashes."""
    day = col(c)
    return all_of(([day >= F.lit(first.replace("-", ""))] if first else []) + ([day <= F.lit(last.replace("-", ""))] if last else []))


def in_any_days(columns: list[Column | str], first: str | None, last: str | None) -> Column:
    """Any of the columns, in whatever layout, is a day in the range."""
    return any_of([F.coalesce(in_days(parse_date(c), first, last), F.lit(False)) for c in columns])


def clamped(first: str, last: str, year: int) -> tuple[str, str]:
    """A range of days, given as ISO or compact texts or left open, cut to one calendar year."""
    iso = lambda x: f"{x[:4]}-{x[4:6]}-{x[6:]}" if len(x) == 8 and x.isdigit() else x[:10]
    return max(iso(first.strip()) or f"{year}-01-01", f"{year}-01-01"), min(iso(last.strip()) or f"{year}-12-31", f"{year}-12-31")


def canonical(columns: list[str]) -> Column:
    """The columns as one JSON text, by name, nulls included: equal texts are equal rows."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def business_key(*columns: Column | str) -> Column:
    """SHA-256 of the JSON array of the columns' texts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.trim(col(c).cast("string")), F.lit("")) for c in columns])), 256)


def change_key(*columns: Column | str) -> Column:
    """SHA-256 of the columns' texts, joined by the unit separator."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]), 256)


def row_key(*columns: str) -> Column:
    """``full_row:`` and the SHA-256 of the JSON list of (name, value)."""
    pairs = [F.array(F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.concat(F.lit("full_row:"), F.sha2(F.to_json(F.array(*pairs)), 256))


def after(columns: list[str], place: list) -> Column:
    """The tuple of columns comes after ``place`` in order."""
    return F.struct(*[F.col(c) for c in columns]) > F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, place, strict=True)])


def up_to(columns: list[str], place: list) -> Column:
    return F.struct(*[F.col(c) for c in columns]) <= F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, place, strict=True)])


def rolling_start(end: Column, months: int = 3, floor: str = "2026-01-01") -> Column:
    """The first day of the month that begins ``months`` calendar months ending with ``end``'s, not before ``floor``."""
    return F.greatest(F.add_months(F.trunc(end, "MM"), 1 - months), F.lit(floor).cast("date"))


def whole_month(first: Column, last: Column) -> Column:
    return (first == F.trunc(first, "MM").cast("date")) & (last == F.last_day(first))


def company_flag(detail_order: Column, stored_order: Column) -> Column:
    """Whether the service order has the company's prefix; a detail's order goes before the stored one."""
    order = F.upper(F.coalesce(text(detail_order), text(stored_order)))
    return F.coalesce(order.startswith(COMPANY_PREFIX), F.lit(False))


def relation(a: Column, b: Column) -> Column:
    return F.when(blank(a) | blank(b), F.lit("missing")).when(F.trim(a) == F.trim(b), F.lit("same")).otherwise(F.lit("different"))


def safe_cell(c: Column | str) -> Column:
    """Text for a spreadsheet: a leading apostrophe before what might be read as a formula."""
    value = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(value.rlike(r"^([=+@]|-\D)"), F.concat(F.lit("'"), value)).otherwise(value)


def flat_cell(c: Column | str) -> Column:
    """Text for a tab-separated line: tabs and line ends become blanks."""
    return F.translate(F.coalesce(col(c).cast("string"), F.lit("")), "\t\r\n", "   ")
