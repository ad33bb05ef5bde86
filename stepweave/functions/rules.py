"""Declarative checks compiled to Columns, so that Catalyst can push them down."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave.functions.text import col

_COMPARE = {"eq": operator.eq, "ne": operator.ne, "le": operator.le, "lt": operator.lt, "ge": operator.ge, "gt": operator.gt}
#: Flags of regular expressions, as Java writes them.
_FLAGS = {"I": "i", "IGNORECASE": "i", "S": "s", "DOTALL": "s", "M": "m", "MULTILINE": "m", "X": "x", "VERBOSE": "x", "U": "U", "UNICODE": "U"}


def rule(value: Column | str, method: str, ref) -> Column:
    """re[.FLAG...], eq ne le lt ge gt, approx:T, range.{t,e}{t,e}, str_list_eq, str_set_eq, spreadsheet_range; null is no match."""
    value = col(value)
    name, *rest = method.split(".")
    if name == "re":
        flags = "".join(sorted({_FLAGS[f] for f in rest}))
        found = value.cast("string").rlike((f"(?{flags})" if flags else "") + ref)
    elif method in _COMPARE:
        found = _COMPARE[method](value, F.lit(ref))
    elif method.startswith("approx:"):
        found = F.abs(value.try_cast("double") - F.lit(float(ref))) <= F.lit(float(method.partition(":")[2]))
    elif name == "range":
        low, high = ({"t": operator.lt, "e": operator.le}[x] for x in rest[0])
        found = low(F.lit(ref[0]), value) & high(value, F.lit(ref[1]))
    elif method in ("str_list_eq", "str_set_eq"):
        own = F.split(F.regexp_replace(value, r"^[\"']+|[\"']+$", ""), ",")
        want = F.array(*[F.lit(x) for x in ref]).cast("array<string>")
        if method == "str_set_eq":
            own, want = F.array_sort(F.array_distinct(own)), F.array_sort(F.array_distinct(want))
        found = own == want
    elif method == "spreadsheet_range":
        found = range_covers(value, ref[0]) & range_within(value, ref[1])
    else:
        raise ValueError(f"no rule {method}")
    return F.coalesce(found, F.lit(False))


def _corners(text: Column) -> tuple[Column, Column, Column, Column]:
    """First column, first row, last column, last row of a range such as B2:D9."""
    from stepweave.functions.text import cell_column, cell_row

    a, b = F.split_part(text, F.lit(":"), F.lit(1)), F.regexp_extract(text, r"([A-Za-z]+\d+)$", 1)
    return cell_column(a), cell_row(a), cell_column(b), cell_row(b)


def range_within(value: Column | str, outer: str) -> Column:
    """Whether every range of the text (divided by blanks) is inside one range of `outer`."""
    inside = lambda x: _any([_holds(_corners(F.lit(o)), _corners(x)) for o in outer.split()])
    return F.forall(F.split(col(value), " "), inside)


def range_covers(value: Column | str, inner: str) -> Column:
    """Whether every range of `inner` is inside one range of the text."""
    parts = F.split(col(value), " ")
    found = F.lit(True)
    for i in inner.split():
        found = found & F.exists(parts, _outside_of(i))
    return found


def _outside_of(inner: str):
    return lambda x: _holds(_corners(x), _corners(F.lit(inner)))


def _holds(outer, inner) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def _any(found: list[Column]) -> Column:
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def all_rules(rules: dict[str, dict]) -> Column:
    """Each named column meets its rule."""
    out = F.lit(True)
    for name, r in rules.items():
        out = out & rule(name, r["method"], r["ref"])
    return out


def record(pattern: dict) -> Column:
    """All keys of the pattern are columns with these values."""
    out = F.lit(True)
    for name, value in pattern.items():
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def conditional_format(value: Column | str, method: str, *refs) -> Column:
    """equal, notEqual, greaterThan, lessThan, greaterThanOrEqual, lessThanOrEqual, between, notBetween; other types don't match."""
    value = col(value).try_cast("double")
    a, b = F.lit(float(refs[0])), F.lit(float(refs[-1]))
    low, high = F.least(a, b), F.greatest(a, b)
    found = {
        "equal": lambda: value == a, "notEqual": lambda: value != a, "greaterThan": lambda: value > a, "lessThan": lambda: value < a,
        "greaterThanOrEqual": lambda: value >= a, "lessThanOrEqual": lambda: value <= a, "between": lambda: value.between(low, high), "notBetween": lambda: ~value.between(low, high),
    }[method]()
    return F.coalesce(found, F.lit(False))


def config_filter(rules: dict[str, list], exclude: bool = False, arrays: tuple[str, ...] = ()) -> Column:
    """Each key's value is among the accepted ones (an array shares one); exclude turns each key around. Nulls never pass."""
    out = F.lit(True)
    for name, accepted in rules.items():
        values = [v for v in accepted if v is not None]
        met = F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])) if name in arrays else F.col(name).isin(values)
        met = F.coalesce(met, F.lit(False))
        out = out & (~met if exclude else met)
    return out


def conjunction(metric: Column | str, conj: str) -> Column:
    """Over a group. and: 0 if one is 0, else the mean. or: 1 if one is 1, else the largest. A missing metric counts as 0."""
    m = F.coalesce(col(metric), F.lit(0.0))
    if conj == "and":
        return F.when(F.bool_or(m == 0), 0.0).otherwise(F.avg(m))
    return F.when(F.bool_or(m == 1), 1.0).otherwise(F.max(m))


def rescaled(score: Column | str, base: float, margin: float = 0.01) -> Column:
    """(score - base) / (1 - base) if the score is above base + margin, else 0."""
    return F.when(col(score) > base + margin, (col(score) - base) / (1 - base)).otherwise(0.0)


def list_equal_one_way(a: Column | str, b: Column | str, same=None) -> Column:
    """Equal lengths, and each element of a has an equal one in b: repeats can hide a difference."""
    same = same or (lambda x, y: x == y)
    return (F.size(col(a)) == F.size(col(b))) & F.forall(col(a), lambda x: F.exists(col(b), lambda y: same(x, y)))


def same_set(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array_distinct(col(a))) == F.array_sort(F.array_distinct(col(b)))


def same_items(a: Column | str, b: Column | str) -> Column:
    """In any order; counts matter."""
    return F.array_sort(col(a)) == F.array_sort(col(b))


def subset(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_except(col(a), col(b))) == 0
