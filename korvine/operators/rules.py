"""Rule scanner: pattern hits, counting features, pointer findings and a risk score, as column expressions."""

from __future__ import annotations

from ..functions.dialect import Dialect

# Categories, their patterns and dangerous functions, weights.
PATTERNS = [
    ("buffer_overflow", r"strcpy\s*\([^,]+,[^)]+\)"),
    ("buffer_overflow", r"strcat\s*\([^,]+,[^)]+\)"),
    ("buffer_overflow", r"gets\s*\([^)]+\)"),
    ("format_string", r'printf\s*\([^"]+\)'),
    ("null_pointer", r"\*\s*\w+\s*(?:=|==)\s*NULL"),
    ("use_after_free", r"free\s*\([^)]+\)"),
    ("integer_overflow", r"atoi\s*\([^)]+\)"),
]
CATEGORIES = ["buffer_overflow", "format_string", "null_pointer", "use_after_free", "integer_overflow"]
FUNCTIONS = {
    "buffer_overflow": ["strcpy", "strcat", "gets", "sprintf", "memcpy"],
    "format_string": ["printf", "fprintf", "sprintf", "snprintf"],
    "null_pointer": [],
    "use_after_free": [],
    "integer_overflow": ["atoi", "atol", "strtol"],
}
SEVERITY = {"buffer_overflow": "high", "use_after_free": "high", "format_string": "medium", "null_pointer": "medium", "integer_overflow": "high"}
SEVERITY_WEIGHT = {"high": 3, "medium": 2, "low": 1}
CALL = r"\b(\w+)\s*\("
POINTER = r"\b(\w+)\s*\*\s*(\w+)"
ALLOC = r"\b(malloc|calloc|realloc)\s*\([^)]*\)"
ALLOC_ASSIGN = r"(\w+)\s*=\s*(?:malloc|calloc|realloc)\s*\("
FREE = r"\bfree\s*\(\s*(\w+)\s*\)"
NULL_CHECK = r"if\s*\([^)]*(?:==|!=)\s*NULL[^)]*\)"
ARRAY = r"\b(\w+)\s*\[\s*([^\]]+)\s*\]"
# Tenths, so that the score is exact until its one division.
WEIGHTS = {"buffer_overflow_count": 50, "use_after_free_count": 50, "format_string_count": 40, "null_pointer_count": 30, "integer_overflow_count": 30, "dangerous_function_count": 20, "malloc_count": 5, "free_count": 5, "pointer_count": 3, "array_access_count": 2, "null_check_count": -5}


def dangerous() -> list[str]:
    return sorted({f for names in FUNCTIONS.values() for f in names})


def counts(d: Dialect, code: str = "code") -> dict[str, str]:
    """The v1 features of a text."""
    out = {f"{c}_count": " + ".join(d.count(code, p) for k, p in PATTERNS if k == c) for c in CATEGORIES}
    out["dangerous_function_count"] = d.size(d.filter(d.all(code, CALL, 1), "f", d.among("f", dangerous())))
    out |= {"pointer_count": d.count(code, POINTER), "malloc_count": d.count(code, ALLOC), "free_count": d.count(code, FREE), "null_check_count": d.count(code, NULL_CHECK), "array_access_count": d.count(code, ARRAY)}
    blank = f"NOT {d.has(code, chr(92) + 'S')}"
    return {k: f"CASE WHEN {blank} THEN cast(0 AS bigint) ELSE {v} END" for k, v in out.items()}


def raw_risk() -> str:
    """Tenths of the raw risk, from the counts' columns."""
    return "greatest(" + " + ".join(f"{w} * {c}" for c, w in WEIGHTS.items()) + ", 0)"


def risk_thousandths(raw: str, d: Dialect) -> str:
    """1 - 1 / (1 + raw), in thousandths, rounded half up, in integers."""
    over, under = f"(2000 * {raw} + 100 + {raw})", f"(2 * (100 + {raw}))"
    return f"({over} // {under})" if d.duck else f"({over} div {under})"


def level(thousandths: str) -> str:
    return f"CASE WHEN {thousandths} >= 700 THEN 'high' WHEN {thousandths} >= 400 THEN 'medium' WHEN {thousandths} > 0 THEN 'low' ELSE 'none' END"
