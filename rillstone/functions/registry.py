"""Extensions by name: scalars, aggregates, stages (one row in, any number out) and hooks on reading and writing.

What is registered is a plain function of Columns or DataFrames, so an extension runs wherever Spark runs the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

Scalar = Callable[..., Column]
Stage = Callable[..., DataFrame]


class Registry:
    """Extensions of one context."""

    def __init__(self):
        self.scalars: dict[str, Scalar] = {}
        self.aggregates: dict[str, Scalar] = {}
        self.stages: dict[str, Stage] = {}
        self.hooks: dict[str, list[tuple[int, Stage]]] = {"read": [], "write": []}

    def _add(self, kind: dict, name: str, made: Callable) -> Callable:
        if name.lower() in kind:
            raise ValueError(f"{name} is registered already")
        kind[name.lower()] = made
        return made

    def scalar(self, name: str) -> Callable[[Scalar], Scalar]:
        """Decorator: a function of Columns that gives a Column."""
        return lambda made: self._add(self.scalars, name, made)

    def aggregate(self, name: str) -> Callable[[Scalar], Scalar]:
        """Decorator: a function of Columns that gives an aggregate Column (also of a pandas aggregate)."""
        return lambda made: self._add(self.aggregates, name, made)

    def stage(self, name: str) -> Callable[[Stage], Stage]:
        """Decorator: a function of a DataFrame, and further arguments, that gives a DataFrame."""
        return lambda made: self._add(self.stages, name, made)

    def hook(self, when: str, order: int = 0) -> Callable[[Stage], Stage]:
        """Decorator: what every DataFrame goes through when it is read or written, lower orders first."""

        def add(made: Stage) -> Stage:
            self.hooks[when].append((order, made))
            return made

        return add

    def call(self, name: str, *args: Column) -> Column:
        """A registered scalar or aggregate."""
        for kind in (self.scalars, self.aggregates):
            if name.lower() in kind:
                return kind[name.lower()](*args)
        raise ValueError(f"no function {name}")

    def apply(self, rows: DataFrame, name: str, *args, **options) -> DataFrame:
        """A registered stage."""
        if name.lower() not in self.stages:
            raise ValueError(f"no stage {name}")
        return self.stages[name.lower()](rows, *args, **options)

    def passed(self, when: str, rows: DataFrame) -> DataFrame:
        """The rows after all hooks of reading or writing."""
        for _, made in sorted(self.hooks[when], key=lambda h: h[0]):
            rows = made(rows)
        return rows
