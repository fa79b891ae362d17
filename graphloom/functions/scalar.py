"""Scalar functions with the semantics of the query language's host: half-even
rounding, double-valued floor and ceiling, whole-number division, null as the
empty string in concatenation, padding that never cuts, zero-based indexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import GraphQueryError

_SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# text

def length(s: Column) -> Column:
    return F.length(s)


def contains(s: Column, part, comparison: str = "ordinal") -> Column:
    _ordinal(comparison)
    return F.contains(s, _c(part))


def starts_with(s: Column, part, comparison: str = "ordinal") -> Column:
    _ordinal(comparison)
    return F.startswith(s, _c(part))


def ends_with(s: Column, part, comparison: str = "ordinal") -> Column:
    _ordinal(comparison)
    return F.endswith(s, _c(part))


def _ordinal(comparison: str) -> None:
    if comparison != "ordinal":
        raise GraphQueryError(f"string comparison {comparison!r} is not supported; only 'ordinal' is")


def to_lower(s: Column) -> Column:
    return F.lower(s)


def to_upper(s: Column) -> Column:
    return F.upper(s)


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, "^" + _SPACE, "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, _SPACE + "$", "")


def trim(s: Column) -> Column:
    return trim_end(trim_start(s))


def replace(s: Column, old, new) -> Column:
    return F.replace(s, _c(old), _c(new))


def substring(s: Column, start, count=None) -> Column:
    begin = _c(start) + 1
    return F.substr(s, begin) if count is None else F.substr(s, begin, _c(count))


def index_of(s: Column, part: str) -> Column:
    """-1 if absent, 0 for an empty part."""
    return F.locate(part, s) - 1


def last_index_of(s: Column, part: str) -> Column:
    """-1 if absent, the length for an empty part."""
    back = F.instr(F.reverse(s), part[::-1])
    found = F.when(back == 0, -1).otherwise(F.length(s) - back + 1 - len(part))
    return F.when(s.isNotNull(), found if part else F.length(s))


def pad_left(s: Column, width: int, char: str = " ") -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, char))


def pad_right(s: Column, width: int, char: str = " ") -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, char))


def compare_to(a: Column, b) -> Column:
    b = _c(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def to_string(x: Column) -> Column:
    return x.cast("string")


def is_null_or_empty(s: Column) -> Column:
    return s.isNull() | (s == "")


def is_null_or_white_space(s: Column) -> Column:
    return s.isNull() | (trim(s) == "")


def concat(*parts) -> Column:
    return F.concat(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])


def join(separator: str, *parts) -> Column:
    """Of several values, or of one array: null elements stand as empty text."""
    values = parts[0] if len(parts) == 1 else F.array(*[_c(p).cast("string") for p in parts])
    return F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit(""))), separator)


# numbers

def abs_(x: Column) -> Column:
    return F.abs(x)


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceiling(x: Column) -> Column:
    return F.ceil(x).cast("double")


def round_(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits).cast("double")


def min_(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def max_(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def sqrt(x: Column) -> Column:
    return F.sqrt(x)


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def exp(x: Column) -> Column:
    return F.exp(x)


def power(x, y) -> Column:
    return F.pow(_c(x), _c(y))


def sin(x: Column) -> Column:
    return F.sin(x)


def cos(x: Column) -> Column:
    return F.cos(x)


def tan(x: Column) -> Column:
    return F.tan(x)


def asin(x: Column) -> Column:
    return F.asin(x)


def acos(x: Column) -> Column:
    return F.acos(x)


def atan(x: Column) -> Column:
    return F.atan(x)


def atan2(y: Column, x) -> Column:
    return F.atan2(y, _c(x))


def log(x: Column) -> Column:
    return F.ln(x)


def log10(x: Column) -> Column:
    return F.log10(x)


def div(a, b) -> Column:
    """Whole-number division that truncates toward zero."""
    return F.call_function("div", _c(a), _c(b))


def divide(a, b) -> Column:
    """Floating division: by zero gives an infinity or NaN, not an error."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    inf = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, F.when(a.isNotNull(), inf)).otherwise(F.try_divide(a, b))


def convert(x: Column, kind: str) -> Column:
    return x.cast(kind)


def try_convert(x: Column, kind: str) -> Column:
    return x.try_cast(kind)


# time

def now() -> Column:
    return F.current_timestamp()


def today() -> Column:
    return F.current_date()


def year(t: Column) -> Column:
    return F.year(t)


def month(t: Column) -> Column:
    return F.month(t)


def day(t: Column) -> Column:
    return F.dayofmonth(t)


def hour(t: Column) -> Column:
    return F.hour(t)


def minute(t: Column) -> Column:
    return F.minute(t)


def second(t: Column) -> Column:
    return F.second(t)


def millisecond(t: Column) -> Column:
    return (F.extract(F.lit("SECOND"), t) * 1000).cast("int") % 1000


def day_of_week(t: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(t) - 1


def day_of_year(t: Column) -> Column:
    return F.dayofyear(t)


def date(t: Column) -> Column:
    return F.to_date(t)


def time_of_day(t: Column) -> Column:
    """Microseconds since midnight."""
    micros = F.extract(F.lit("SECOND"), t) * 1_000_000
    return (F.hour(t).cast("long") * 3600 + F.minute(t) * 60) * 1_000_000 + micros.cast("long")


def add_years(t: Column, n) -> Column:
    return t + F.make_ym_interval(_c(n), F.lit(0))


def add_months(t: Column, n) -> Column:
    return t + F.make_ym_interval(F.lit(0), _c(n))


def _add(t: Column, n, seconds: float) -> Column:
    micros = (_c(n).cast("double") * seconds * 1_000_000).cast("long")
    whole = micros - F.pmod(micros, F.lit(1_000_000))
    secs = ((whole / 1_000_000).cast("long").cast("decimal(18,6)") + (F.pmod(micros, F.lit(1_000_000)) / 1_000_000).cast("decimal(18,6)")).cast("decimal(18,6)")
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def add_days(t: Column, n) -> Column:
    return _add(t, n, 86400)


def add_hours(t: Column, n) -> Column:
    return _add(t, n, 3600)


def add_minutes(t: Column, n) -> Column:
    return _add(t, n, 60)


def add_seconds(t: Column, n) -> Column:
    return _add(t, n, 1)


def add_milliseconds(t: Column, n) -> Column:
    return _add(t, n, 0.001)


def to_universal_time(t: Column, zone: str) -> Column:
    return F.to_utc_timestamp(t, zone)


def to_local_time(t: Column, zone: str) -> Column:
    return F.from_utc_timestamp(t, zone)


_UNITS = {"days": 86_400_000_000, "hours": 3_600_000_000, "minutes": 60_000_000, "seconds": 1_000_000, "milliseconds": 1_000}
_CARRY = {"days": None, "hours": 24, "minutes": 60, "seconds": 60, "milliseconds": 1000}


def span_part(micros: Column, unit: str) -> Column:
    """A duration's component (``days`` ... ``milliseconds``) of microseconds, truncated toward zero."""
    whole = (micros - micros % _UNITS[unit]) / _UNITS[unit]
    out = whole.cast("long")
    return (out % _CARRY[unit] if _CARRY[unit] else out).cast("int")


def span_total(micros: Column, unit: str) -> Column:
    return micros.cast("double") / _UNITS[unit]


def time_part(micros: Column, unit: str) -> Column:
    """A time of day's ``hours``, ``minutes``, ``seconds`` or ``milliseconds``."""
    return span_part(micros, unit)


# collections

def any_of(values: Column, test=None) -> Column:
    return F.size(values) > 0 if test is None else F.coalesce(F.exists(values, test), F.lit(False))


def all_of(values: Column, test) -> Column:
    return F.forall(values, lambda x: F.coalesce(test(x), F.lit(False)))


def count_of(values: Column, test=None) -> Column:
    """The number of elements, null ones among them; -1 never: a null collection counts null."""
    return F.when(values.isNotNull(), F.size(values if test is None else F.filter(values, test)))


def sum_of(values: Column, kind: str = "double") -> Column:
    """The sum in the given type: ``long`` or a decimal keeps all digits."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: (a + F.coalesce(x.cast(kind), F.lit(0).cast(kind))).cast(kind))


def average_of(values: Column) -> Column:
    some = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, sum_of(some) / F.size(some))


def min_of(values: Column) -> Column:
    return F.array_min(values)


def max_of(values: Column) -> Column:
    return F.array_max(values)


def member(values: Column, x) -> Column:
    """Null-aware membership: an array that holds a null contains null."""
    return F.exists(values, lambda v: v.eqNullSafe(_c(x)))


def select_of(values: Column, f) -> Column:
    return F.transform(values, f)


# dynamic entities

def get_property(props: Column, name: str, kind: str = "string") -> Column:
    return props[name].try_cast(kind)


def has_property(props: Column, name: str) -> Column:
    return F.map_contains_key(props, name)


def property_names(props: Column) -> Column:
    return F.array_sort(F.map_keys(props))


def has_label(labels: Column, name: str) -> Column:
    return F.array_contains(labels, name)


def has_any_label(labels: Column, *names: str) -> Column:
    return F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))


def has_all_labels(labels: Column, *names: str) -> Column:
    return F.size(F.array_intersect(labels, F.array(*[F.lit(n) for n in set(names)]))) == len(set(names))
