"""Scalar expressions in the SQL of Spark and of DuckDB, from one description."""

from __future__ import annotations


class Dialect:
    """Builds SQL text; `duck` tells which engine is to read it."""

    def __init__(self, duck: bool) -> None:
        self.duck = duck

    def lit(self, text: str) -> str:
        """A string literal, quotes and backslashes as they are."""
        return "'" + (text.replace("'", "''") if self.duck else text.replace("\\", "\\\\").replace("'", "\\'")) + "'"

    def all(self, s: str, pattern: str, group: int = 0) -> str:
        """All matches, as an array."""
        return f"regexp_extract_all({s}, {self.lit(pattern)}, {group})"

    def count(self, s: str, pattern: str) -> str:
        """Matches, as a long."""
        return f"cast(len({self.all(s, pattern)}) AS bigint)" if self.duck else f"cast(regexp_count({s}, {self.lit(pattern)}) AS bigint)"

    def has(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.lit(pattern)})" if self.duck else f"({s} RLIKE {self.lit(pattern)})"

    def first(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def replace(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, '{by}', 'g')" if self.duck else f"regexp_replace({s}, {self.lit(pattern)}, '{by}')"

    def size(self, a: str) -> str:
        return f"cast(len({a}) AS bigint)" if self.duck else f"cast(size({a}) AS bigint)"

    def map(self, a: str, x: str, body: str) -> str:
        return f"list_transform({a}, lambda {x}: {body})" if self.duck else f"transform({a}, {x} -> {body})"

    def filter(self, a: str, x: str, body: str) -> str:
        return f"list_filter({a}, lambda {x}: {body})" if self.duck else f"filter({a}, {x} -> {body})"

    def mapi(self, a: str, x: str, i: str, body: str) -> str:
        """`map` with the element's number, from 0."""
        return f"list_transform({a}, lambda {x}, _{i}: list_transform([_{i} - 1], lambda {i}: {body})[1])" if self.duck else f"transform({a}, ({x}, {i}) -> {body})"

    def flat(self, a: str) -> str:
        return f"flatten({a})"

    def at(self, a: str, i: str) -> str:
        """The element of number i, from 0; null beyond the ends."""
        return f"CASE WHEN {i} >= 0 THEN {a}[{i} + 1] END" if self.duck else f"get({a}, {i})"

    def any(self, a: str, x: str, body: str) -> str:
        return f"(len(list_filter({a}, lambda {x}: {body})) > 0)" if self.duck else f"exists({a}, {x} -> {body})"

    def overlap(self, a: str, b: str) -> str:
        return f"list_has_any({a}, {b})" if self.duck else f"arrays_overlap({a}, {b})"

    def contains(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})" if self.duck else f"array_contains({a}, {x})"

    def concat(self, *arrays: str) -> str:
        out = arrays[0]
        for p in arrays[1:]:
            out = f"list_concat({out}, {p})" if self.duck else f"concat({out}, {p})"
        return out

    def slice(self, a: str, start: str, end: str) -> str:
        """Elements `start` to `end` - 1, numbered from 0."""
        return f"{a}[greatest({start}, 0) + 1:{end}]" if self.duck else f"slice({a}, cast(greatest({start}, 0) + 1 AS int), cast(greatest({end} - greatest({start}, 0), 0) AS int))"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {sep})" if self.duck else f"array_join({a}, {sep})"

    def once(self, arrays: list[str], body: str) -> str:
        """`body`, whose lambdas name some array columns: a second mention keeps Spark from computing them anew for every element."""
        return body if self.duck else f"IF({' + '.join(f'size({a})' for a in arrays)} < -9, NULL, {body})"

    def words(self, s: str) -> str:
        return self.all(s, r"\w+")

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})" if self.duck else f"array_distinct({a})"

    def lines(self, s: str) -> str:
        return f"string_split({s}, chr(10))" if self.duck else f"split({s}, chr(10))"

    def chars(self, s: str, c: str) -> str:
        """Occurrences of a string, as a long."""
        return f"cast((length({s}) - length(replace({s}, '{c}', ''))) / {len(c)} AS bigint)"

    def ratio(self, a: str, b: str) -> str:
        """a / max(b, 1) of integers, as one division of doubles."""
        return f"(cast({a} AS double) / cast(greatest({b}, 1) AS double))"

    def among(self, x: str, names: list[str]) -> str:
        return f"{x} IN ({', '.join(chr(39) + n + chr(39) for n in names)})"


SPARK, DUCK = Dialect(False), Dialect(True)
