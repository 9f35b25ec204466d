"""Predicates over variables: a small algebra with two-valued logic.

A comparison with null is false, and ``not`` complements, so ``not (x > 1)`` selects nulls. As a
*filter* the positive conjuncts are compiled bare, which Spark pushes into the scan; below ``not`` and
as a *mask* every atom is coalesced to false. Both select the same rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from ..errors import UnknownVariableError, ValidationError

OPERATORS: dict[str, Callable] = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
}
SYMBOLS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "neq": "!="}


@dataclass(frozen=True)
class Predicate:
    def __and__(self, other: "Predicate") -> "Predicate":
        return all_of(self, other)

    def __or__(self, other: "Predicate") -> "Predicate":
        return any_of(self, other)

    def __invert__(self) -> "Predicate":
        return negate(self)


@dataclass(frozen=True)
class Always(Predicate):
    pass


@dataclass(frozen=True)
class Compare(Predicate):
    variable: str
    op: str
    value: float


@dataclass(frozen=True)
class Between(Predicate):
    """[low, high), or [low, high] with ``inclusive``."""

    variable: str
    low: float
    high: float
    inclusive: bool = False


@dataclass(frozen=True)
class In(Predicate):
    variable: str
    values: tuple[float, ...]


@dataclass(frozen=True)
class IsNull(Predicate):
    variable: str


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


def _flat(kind: type, parts: tuple[Predicate, ...]) -> list[Predicate]:
    return [x for p in parts for x in (p.parts if isinstance(p, kind) else (p,))]


def all_of(*parts: Predicate) -> Predicate:
    """Conjunction; nested ones are flattened, ``always`` is neutral."""
    flat = [p for p in _flat(And, parts) if not isinstance(p, Always)]
    return Always() if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))


def any_of(*parts: Predicate) -> Predicate:
    """Disjunction; nested ones are flattened, none means ``always``."""
    flat = _flat(Or, parts)
    return Always() if not flat else flat[0] if len(flat) == 1 else Or(tuple(flat))


def negate(part: Predicate) -> Predicate:
    return part.part if isinstance(part, Not) else Not(part)


def walk(p: Predicate) -> Iterator[Predicate]:
    yield p
    for child in getattr(p, "parts", ()) or ((p.part,) if isinstance(p, Not) else ()):
        yield from walk(child)


def variables(p: Predicate) -> list[str]:
    return sorted({x.variable for x in walk(p) if hasattr(x, "variable")})


def complexity(p: Predicate) -> int:
    """The number of atoms; ``always`` is none."""
    return sum(hasattr(x, "variable") for x in walk(p))


def require_known(p: Predicate, known) -> None:
    missing = [v for v in variables(p) if v not in known]
    if missing:
        raise UnknownVariableError(f"unknown variables: {', '.join(missing)}")


def _atom(p: Predicate, column: Callable[[str], Column]) -> Column:
    c = column(p.variable)
    if isinstance(p, Compare):
        return OPERATORS[p.op](c, F.lit(p.value))
    if isinstance(p, In):
        return c.isin(*p.values) if p.values else F.lit(False)
    if isinstance(p, IsNull):
        return c.isNull()
    sides = [c >= F.lit(p.low)] if not math.isinf(p.low) else [c.isNotNull()] if p.low < 0 else [F.lit(False)]
    if not math.isinf(p.high):
        sides.append(c <= F.lit(p.high) if p.inclusive else c < F.lit(p.high))
    elif p.high < 0:
        sides.append(F.lit(False))
    return reduce(lambda a, b: a & b, sides)


def as_mask(p: Predicate, column: Callable[[str], Column] = F.col) -> Column:
    """A Boolean column that is never null."""
    if isinstance(p, Always):
        return F.lit(True)
    if isinstance(p, And):
        return reduce(lambda a, b: a & b, (as_mask(x, column) for x in p.parts))
    if isinstance(p, Or):
        return reduce(lambda a, b: a | b, (as_mask(x, column) for x in p.parts))
    if isinstance(p, Not):
        return ~as_mask(p.part, column)
    return F.coalesce(_atom(p, column), F.lit(False))


def as_filter(p: Predicate, column: Callable[[str], Column] = F.col) -> Column:
    """A condition for ``filter``: the same rows as the mask, with conjuncts that scans accept."""
    if isinstance(p, And):
        return reduce(lambda a, b: a & b, (as_filter(x, column) for x in p.parts))
    if isinstance(p, Or):
        return reduce(lambda a, b: a | b, (as_filter(x, column) for x in p.parts))
    return _atom(p, column) if hasattr(p, "variable") else as_mask(p, column)


def evaluate(p: Predicate, row: Mapping[str, float | None]) -> bool:
    """One row at a time; for tests and tools, not for data."""
    if isinstance(p, Always):
        return True
    if isinstance(p, And):
        return all(evaluate(x, row) for x in p.parts)
    if isinstance(p, Or):
        return any(evaluate(x, row) for x in p.parts)
    if isinstance(p, Not):
        return not evaluate(p.part, row)
    value = row.get(p.variable)
    if isinstance(p, IsNull):
        return value is None
    if value is None:
        return False
    if isinstance(p, Compare):
        return OPERATORS[p.op](value, p.value)
    if isinstance(p, In):
        return value in p.values
    return value >= p.low and (value <= p.high if p.inclusive else value < p.high)


def number(value: float) -> str:
    """At most four decimals, none that are zero."""
    return f"{value:.4f}".rstrip("0").rstrip(".") if math.isfinite(value) else ("∞" if value > 0 else "-∞")


#: Words of the descriptions (Spanish by default).
WORDS = {"and": "Y", "or": "O", "not": "NO", "null": "sin valor", "in": "∈", "always": "siempre"}


def describe(p: Predicate, labels: Mapping[str, str] | None = None, words: Mapping[str, str] = WORDS) -> str:
    name = lambda v: (labels or {}).get(v, v)
    if isinstance(p, Always):
        return words["always"]
    if isinstance(p, (And, Or)):
        join = f" {words['and' if isinstance(p, And) else 'or']} "
        return join.join(f"({describe(x, labels, words)})" if isinstance(x, (And, Or)) else describe(x, labels, words) for x in p.parts)
    if isinstance(p, Not):
        return f"{words['not']} ({describe(p.part, labels, words)})"
    if isinstance(p, IsNull):
        return f"{name(p.variable)} {words['null']}"
    if isinstance(p, In):
        return f"{name(p.variable)} {words['in']} {{{', '.join(map(number, p.values))}}}"
    if isinstance(p, Compare):
        return f"{name(p.variable)} {SYMBOLS[p.op]} {number(p.value)}"
    return f"{number(p.low)} <= {name(p.variable)} {'<=' if p.inclusive else '<'} {number(p.high)}"


#: Stand-ins for infinite bounds in JSON (fixed values).
_INFINITE = {math.inf: "__Infinity__", -math.inf: "__-Infinity__"}
_BACK = {v: k for k, v in _INFINITE.items()}
#: Operators as they are stored (fixed values).
STORED = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "==", "neq": "!="}
_OPERATOR = {v: k for k, v in STORED.items()}


def to_json(p: Predicate) -> str:
    def plain(x: Predicate) -> dict:
        bound = lambda v: _INFINITE.get(v, v)
        if isinstance(x, Always):
            return {"type": "always"}
        if isinstance(x, Compare):
            return {"type": "compare", "variable": x.variable, "op": STORED[x.op], "value": x.value}
        if isinstance(x, Between):
            return {"type": "between", "variable": x.variable, "min": bound(x.low), "max": bound(x.high), "inclusiveMax": x.inclusive}
        if isinstance(x, In):
            return {"type": "in", "variable": x.variable, "values": list(x.values)}
        if isinstance(x, IsNull):
            return {"type": "isNull", "variable": x.variable}
        if isinstance(x, Not):
            return {"type": "not", "operand": plain(x.part)}
        return {"type": "and" if isinstance(x, And) else "or", "operands": [plain(y) for y in x.parts]}

    return json.dumps(plain(p), ensure_ascii=False)


def from_json(text: str) -> Predicate:
    """Parse and validate: comparison values are finite, bounds may be infinite, nothing is NaN."""

    def finite(v) -> float:
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
            raise ValidationError(f"not a finite number: {v!r}")
        return float(v)

    def build(x) -> Predicate:
        if not isinstance(x, dict):
            raise ValidationError("a predicate is an object")
        kind = x.get("type")
        if kind == "always":
            return Always()
        if kind in ("and", "or"):
            parts = x.get("operands")
            if not isinstance(parts, list):
                raise ValidationError(f"{kind} needs operands")
            return (all_of if kind == "and" else any_of)(*map(build, parts))
        if kind == "not":
            return negate(build(x.get("operand")))
        variable = x.get("variable")
        if not isinstance(variable, str) or not variable:
            raise ValidationError("a variable is missing")
        if kind == "compare":
            if x.get("op") not in _OPERATOR:
                raise ValidationError(f"unknown operator {x.get('op')!r}")
            return Compare(variable, _OPERATOR[x["op"]], finite(x.get("value")))
        if kind == "between":
            low, high = (_BACK[v] if isinstance(v, str) and v in _BACK else finite(v) for v in (x.get("min"), x.get("max")))
            return Between(variable, low, high, bool(x.get("inclusiveMax", False)))
        if kind == "in":
            if not isinstance(x.get("values"), list):
                raise ValidationError("in needs values")
            return In(variable, tuple(map(finite, x["values"])))
        if kind == "isNull":
            return IsNull(variable)
        raise ValidationError(f"unknown type {kind!r}")

    try:
        return build(json.loads(text))
    except json.JSONDecodeError as error:
        raise ValidationError(f"not JSON: {error}") from error
