"""Named DataFrame operators, each with a description and an optional SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Operator:
    name: str
    description: str
    run: Run
    oracle: str | None = None


class Registry:
    """Operators by name; a name can be taken once."""

    def __init__(self) -> None:
        self._operators: dict[str, Operator] = {}

    def register(self, oracle: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
        def add(run: Run) -> Run:
            key = name or run.__name__
            if key in self._operators:
                raise ValueError(f"operator {key!r} is registered already")
            self._operators[key] = Operator(key, (run.__doc__ or "").strip(), run, oracle)
            return run

        return add

    def include(self, other: Registry) -> None:
        for operator in other._operators.values():
            if operator.name in self._operators:
                raise ValueError(f"operator {operator.name!r} is registered already")
            self._operators[operator.name] = operator

    def names(self) -> list[str]:
        return sorted(self._operators)

    def get(self, name: str) -> Operator:
        if name not in self._operators:
            raise KeyError(f"no operator named {name!r}")
        return self._operators[name]

    def run(self, name: str, spark: SparkSession, folder: str) -> DataFrame:
        return self.get(name).run(spark, folder)

    def queries(self) -> dict[str, Run]:
        return {name: o.run for name, o in self._operators.items()}

    def oracles(self) -> dict[str, str]:
        return {name: o.oracle for name, o in self._operators.items() if o.oracle}
