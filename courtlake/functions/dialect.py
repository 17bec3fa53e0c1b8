"""The few places where Spark SQL and the oracle's SQL spell one thing differently."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def r(self, x: str, n: int) -> str:
        """Round half to even at the n-th decimal of the scaled double, as numpy does."""
        return f"(rint(({x}) * 1e{n}) / 1e{n})" if self.spark else f"round_even({x}, {n})"

    def days(self, a: str, b: str) -> str:
        """Days from a to b."""
        return f"datediff({b}, {a})" if self.spark else f"date_diff('day', {a}, {b})"

    def spine(self, lo: str, hi: str) -> str:
        """One row per day from lo to hi, in a select list."""
        if self.spark:
            return f"explode(sequence({lo}, {hi}, interval 1 day))"
        return f"CAST(unnest(generate_series(CAST({lo} AS TIMESTAMP), CAST({hi} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)"

    def last(self, x: str) -> str:
        return f"last({x}, true)" if self.spark else f"last_value({x} IGNORE NULLS)"

    def first(self, x: str) -> str:
        return f"first({x}, true)" if self.spark else f"first_value({x} IGNORE NULLS)"

    def try_int(self, x: str) -> str:
        return f"try_cast({x} AS BIGINT)"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def texts(self, x: str, order: str) -> str:
        """Distinct values of a group as one comma-separated text."""
        return f"array_join(sort_array(collect_set({x})), ',')" if self.spark else f"array_to_string(list_sort(list(DISTINCT {x})), ',')"

    def numbers(self, lo: str, hi: str) -> str:
        """One row per whole number from lo to hi, in a select list."""
        return f"explode(sequence({lo}, {hi}))" if self.spark else f"unnest(generate_series({lo}, {hi}))"


SPARK, ORACLE = Dialect(True), Dialect(False)
