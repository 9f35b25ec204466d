"""Look-ahead protection: what a predicate may mention, decided before any plan is built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..errors import LookaheadError, UnknownVariableError
from ..model import Variable
from .predicates import Predicate, variables


@dataclass(frozen=True)
class Finding:
    variable: str
    reason: str  # outcome, meta, unknown


class Registry(dict[str, Variable]):
    """Variables by key; what is known about each."""

    @classmethod
    def of(cls, *items: Variable) -> "Registry":
        return cls({v.key: v for v in items})

    def predictors(self) -> list[str]:
        return sorted(k for k, v in self.items() if v.causality == "predictor")

    def listed(self, causality: str | None = None, produced_by: str | None = None) -> list[Variable]:
        return [v for _, v in sorted(self.items()) if causality in (None, v.causality) and produced_by in (None, v.produced_by)]

    def column(self, key: str) -> Column:
        """The column that holds a variable, as a double (NaN is null)."""
        if key not in self:
            raise UnknownVariableError(f"unknown variable {key}")
        return F.nanvl(F.col(self[key].column).cast("double"), F.lit(None).cast("double"))


def inspect(p: Predicate, registry: Mapping[str, Variable]) -> list[Finding]:
    out = []
    for key in variables(p):
        kind = registry[key].causality if key in registry else "unknown"
        if kind != "predictor":
            out.append(Finding(key, kind))
    return out


def require_safe(p: Predicate, registry: Mapping[str, Variable], purpose: str = "hypothesis") -> Predicate:
    """Refuse outcomes, meta variables and unknown ones, unless the purpose is a diagnostic."""
    found = inspect(p, registry)
    if found and purpose != "diagnostic":
        raise LookaheadError("; ".join(f"{f.variable} is {f.reason}" for f in found))
    return p
