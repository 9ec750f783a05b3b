"""One filter for all views, compiled to one predicate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.functions.scalars import all_of, any_of, exact, exact_any, flag_value, in_days, keyword_in, missing, split_values
from traceloom.plans.views import View


@dataclass(frozen=True)
class Filter:
    """``values``: lists, by the names that the view knows. Dates are inclusive. Flags are texts; unknown ones don't filter, but in ``strict_flags`` count as false.

    ``days``: ranges of days of other date columns, by name.
    """

    values: dict[str, str] = field(default_factory=dict)
    first_day: str | None = None
    last_day: str | None = None
    date_column: str | None = None
    keyword: str = ""
    flags: dict[str, str] = field(default_factory=dict)
    strict_flags: dict[str, str] = field(default_factory=dict)
    days: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    missing: tuple[str, ...] = ()
    present: tuple[str, ...] = ()

    def is_bounded(self) -> bool:
        """Whether any condition is set."""
        return bool(any(v.strip() for v in self.values.values()) or self.first_day or self.last_day or self.keyword or self.missing or self.present or any(flag_value(v) is not None for v in self.flags.values()) or any(v.strip() for v in self.strict_flags.values()) or any(x for ends in self.days.values() for x in ends))


def predicate(view: View, wanted: Filter) -> Column:
    """All conditions of the filter; names that the view doesn't know are errors. Literals only, so it is pushed to the scan."""
    plain, orders = dict(view.exact), {name: (columns, width) for name, columns, width in view.orders}
    found = []
    for name, value in wanted.values.items():
        if not value.strip():
            continue
        if name in plain:
            found.append(exact(plain[name][0], value) if len(plain[name]) == 1 else exact_any(list(plain[name]), value))
        elif name in orders:
            columns, width = orders[name]
            found.append(any_of([exact(c, value, width) for c in columns]))
        else:
            raise ValueError(f"{view.name} has no filter {name!r}")
    if wanted.first_day or wanted.last_day:
        if not (day := wanted.date_column or view.date):
            raise ValueError(f"{view.name} has no date")
        found.append(in_days(F.col(day), wanted.first_day, wanted.last_day))
    if wanted.keyword:
        found.append(keyword_in(list(view.search), wanted.keyword))
    found += [F.col(c) == F.lit(flag) for c, v in wanted.flags.items() if (flag := flag_value(v)) is not None]
    found += [F.col(c) == F.lit(flag_value(v) is True) for c, v in wanted.strict_flags.items() if v.strip()]
    found += [in_days(F.col(c), first, last) for c, (first, last) in wanted.days.items() if first or last]
    found += [missing(c) for c in wanted.missing] + [~missing(c) for c in wanted.present]
    return all_of(found)


def lookup_predicate(view: View, wanted: Filter) -> Column:
    """As ``predicate``, but no condition matches nothing."""
    return predicate(view, wanted) if wanted.is_bounded() else F.lit(False)


def bounded_predicate(view: View, wanted: Filter) -> Column:
    """As ``predicate``; refuses to read a view whole that needs a filter."""
    if view.needs_filter and not wanted.is_bounded():
        raise ValueError(f"{view.name} needs a filter")
    return predicate(view, wanted)


def member_of(c: str, keys) -> Column:
    """For lists from a caller: one of the values, or none if there are none."""
    wanted = split_values(keys) if isinstance(keys, str) else list(dict.fromkeys(keys))
    return F.col(c).isin(*wanted) if wanted else F.lit(False)
