"""Small differences between Spark SQL and DuckDB, so that one expression text can be written for both."""

from __future__ import annotations


class Spark:
    name = "spark"

    def strip(self, x: str, pattern: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '')"

    def upper(self, x: str) -> str:
        """Upper case; a sharp s counts as two letters."""
        return f"upper({x})"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} rlike r'{pattern}')"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"


class Duck(Spark):
    name = "duckdb"

    def upper(self, x: str) -> str:
        return f"upper(replace({x}, 'ß', 'ss'))"

    def strip(self, x: str, pattern: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '', 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"


SPARK, DUCK = Spark(), Duck()


def num(value: float) -> str:
    """A double literal in both."""
    return f"{float(value)!r}e0"
