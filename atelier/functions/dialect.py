"""SQL fragments for both Spark and DuckDB: scalar functions are SQL text over a column
expression, so they stay inside code generation and one definition serves both engines.

Patterns keep to what both regular expression dialects share: no look-around and no
back-references; letters are matched in any case with (?i).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    duck: bool = False

    def lit(self, s: str) -> str:
        if self.duck:
            return "'" + s.replace("'", "''") + "'"
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def match(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})" if self.duck else f"({x} RLIKE {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)}{", 'g'" if self.duck else ''})"

    def ext(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def int(self, x: str) -> str:
        """An integer, or NULL where the text is none."""
        return f"TRY_CAST(nullif({x}, '') AS INT)"

    def squeeze(self, x: str) -> str:
        return f"trim({self.sub(x, '[ \\t\\r\\n]+', ' ')})"

    def capital(self, x: str) -> str:
        return f"concat(upper(substr({x}, 1, 1)), substr({x}, 2))"

    def case(self, x: str, rules: list[tuple[str, str]], other: str = "''") -> str:
        """The value of the first pattern that matches."""
        return "CASE " + " ".join(f"WHEN {self.match(x, p)} THEN {self.lit(v)}" for p, v in rules) + f" ELSE {other} END"

    def table(self, x: str, pairs: dict[str, str], other: str) -> str:
        """The value of an equal key. On Spark a CASE makes x again for each key, a map once."""
        if not self.duck:
            both = ", ".join(f"{self.lit(a)}" for pair in pairs.items() for a in pair)
            return f"coalesce(try_element_at(map({both}), {x}), {other})"
        return f"CASE {x} " + " ".join(f"WHEN {self.lit(k)} THEN {self.lit(v)}" for k, v in pairs.items()) + f" ELSE {other} END"

    def first(self, x: str, pattern: str) -> str:
        """The part of x before the first match."""
        return f"split({x}, {self.lit(pattern)})[0]" if not self.duck else f"regexp_split_to_array({x}, {self.lit(pattern)})[1]"

    def last(self, x: str, pattern: str) -> str:
        return f"element_at(split({x}, {self.lit(pattern)}), -1)" if not self.duck else f"regexp_split_to_array({x}, {self.lit(pattern)})[-1]"

    def pick(self, values: list[str], index: str) -> str:
        """One of the values, by an index that wraps."""
        each = ", ".join(map(self.lit, values))
        n = len(values)
        if self.duck:
            return f"([{each}])[CAST({index} % {n} AS INT) + 1]"
        return f"element_at(array({each}), CAST({index} % {n} AS INT) + 1)"


SPARK, DUCK = Dialect(), Dialect(True)


def column(build, *columns: str) -> Column:
    """The Spark column of a fragment over named columns."""
    return F.expr(build(SPARK, *columns))
