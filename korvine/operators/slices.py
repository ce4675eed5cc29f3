"""Slices of a function's lines, as expressions over its array of lines (line numbers from 1)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.dialect import SPARK


def window(criteria: str, lines: str, back: int, ahead: int) -> Column:
    """The lines from `back` before to `ahead` after a criterion, ascending, once each."""
    return F.expr(SPARK.once([criteria, lines], f"filter(sequence(1, size({lines})), i -> exists({criteria}, c -> i BETWEEN c - {back} AND c + {ahead}))"))


def extracted(kept: str, lines: str) -> Column:
    """The texts of some lines, without blank and missing ones."""
    return F.expr(SPARK.once([kept, lines], f"filter(transform({kept}, i -> get({lines}, i - 1)), t -> t RLIKE '\\\\S')"))


def dedented(kept: str, lines: str) -> Column:
    """`extracted`, without the indentation that all of it shares; joined."""
    text = f"filter(transform({kept}, i -> get({lines}, i - 1)), t -> t RLIKE '\\\\S')"
    least = f"array_min(transform({text}, t -> length(t) - length(regexp_replace(t, '^\\\\s+', ''))))"
    return F.expr(f"array_join(transform(arrays_zip({text} AS t, array_repeat({least}, size({text})) AS m), x -> substring(x.t, x.m + 1)), '\\n')".replace(" AS t,", ",").replace(" AS m)", ")").replace("x.t", "x.`0`").replace("x.m", "x.`1`"))


def centered(kept: str, criteria: str, lines: str, most: int) -> Column:
    """struct(start, tokens): at most `most` tokens around the middle of the first criterion's line."""
    split = lambda t: f"filter(split({t}, '\\\\s+'), x -> x <> '')"
    full = f"filter({kept}, i -> get({lines}, i - 1) RLIKE '\\\\S')"
    every = f"flatten(transform({full}, i -> {split(f'get({lines}, i - 1)')}))"
    first = f"array_min({criteria})"
    before = f"size(flatten(transform(filter({full}, i -> i < {first}), i -> {split(f'get({lines}, i - 1)')})))"
    target = f"({before} + size({split(f'get({lines}, {first} - 1)')}) div 2)"
    n = f"size({every})"
    start = f"CASE WHEN {n} <= {most} THEN 0 WHEN least({n}, greatest(0, {target} - {most // 2}) + {most}) = {n} THEN greatest(0, {n} - {most}) ELSE greatest(0, {target} - {most // 2}) END"
    return F.expr(f"named_struct('start', {start}, 'tokens', slice({every}, cast({start} + 1 AS int), {most}))")
