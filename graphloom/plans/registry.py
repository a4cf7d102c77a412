"""How query modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from ..scratch import ship
from .fixtures import oracle, view


class Tables:
    """The tables and views of one folder, as attributes."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}
        ship(spark)

    def __getattr__(self, name: str):
        return view(self.spark, self.sf_dir, name, self._made)


class Registry:
    def __init__(self):
        self.found: dict[str, tuple[Callable, str | None]] = {}

    def query(self, sql: str | None = None):
        """Registers a function of Tables under its name, with the DuckDB SQL for the same rows."""

        def add(f):
            self.found[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), oracle(sql) if sql else None)
            return f

        return add
