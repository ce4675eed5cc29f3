"""Sequences of ids: lookup in a bounded vocabulary, truncation, padding, masks, decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def lookup(table: dict[str, int], unknown: int = 1) -> Column:
    """An Arrow function from arrays of tokens to arrays of ids; `table` is a vocabulary of a capped size."""

    @F.pandas_udf("array<bigint>")
    def ids(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: [table.get(x, unknown) for x in t])

    return ids


def names_of(names: dict[int, str], skip: tuple[int, ...] = (0, 2, 3)) -> Column:
    """An Arrow function from ids to tokens, without the ids to skip."""

    @F.pandas_udf("array<string>")
    def tokens(ids: pd.Series) -> pd.Series:
        return ids.map(lambda t: [names.get(x, "<UNK>") for x in t if x not in skip])

    return tokens


def truncated(ids: str, n: int, how: str = "tail") -> Column:
    """tail keeps the first n ids, head the last n, center both ends."""
    if how == "tail":
        cut = f"slice({ids}, 1, {n})"
    elif how == "head":
        cut = f"slice({ids}, -{n}, {n})"
    elif how == "center":
        cut = f"concat(slice({ids}, 1, {n // 2 + n % 2}), slice({ids}, -{n // 2}, {n // 2}))"
    else:
        raise ValueError(f"unknown truncation {how!r}")
    return F.expr(f"IF(size({ids}) <= {n}, {ids}, {cut})")


def _pad(ids: str, n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), F.lit(n) - F.size(ids))


def padded(ids: str, n: int, side: str = "right") -> Column:
    if side not in ("left", "right"):
        raise ValueError(f"unknown side {side!r}")
    return F.concat(F.col(ids), _pad(ids, n)) if side == "right" else F.concat(_pad(ids, n), F.col(ids))


def mask(ids: str, n: int, side: str = "right") -> Column:
    ones = F.transform(ids, lambda x: F.lit(1).cast("long"))
    return F.concat(ones, _pad(ids, n)) if side == "right" else F.concat(_pad(ids, n), ones)
