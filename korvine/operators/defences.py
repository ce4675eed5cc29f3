"""Missing-defence features by regex: what is checked somewhere, and what is used without a check."""

from __future__ import annotations

from ..functions.dialect import Dialect
from .rules import dangerous

# Fixed values.
NULL_CHECK = r"\b(\w+)\s*(?:==|!=)\s*NULL\b|\bNULL\s*(?:==|!=)\s*(\w+)\b|!\s*(\w+)\s*[)\s]|if\s*\(\s*(\w+)\s*\)"
BOUNDS_CHECK = r"\b(\w+)\s*(?:<|<=|>|>=)\s*(?:\w+|[0-9]+)|(?:\w+|[0-9]+)\s*(?:<|<=|>|>=)\s*(\w+)"
CONDITION_LINE = r"^\s*(?:if|while|for|switch)\s*\("
ALLOC_ASSIGN = r"(\w+)\s*=\s*(?:malloc|calloc|realloc)\s*\("
FREE = r"\bfree\s*\(\s*(\w+)\s*\)"
ARRAY = r"\b(\w+)\s*\[\s*([^\]]+)\s*\]"
DEREF = r"\*\s*(\w+)|(\w+)\s*->\s*\w+|(\w+)\s*\[\s*[^]]+\]"
ANY_CALL = r"(?:(\w+)\s*=\s*)?(\w+)\s*\([^)]*\)\s*;"
CHECKABLE = ["malloc", "calloc", "realloc", "fopen", "fgets", "fread", "fwrite", "read", "write", "recv", "send", "socket", "connect", "bind", "listen", "accept", "pthread_create", "pthread_mutex_lock"]
CHECK_LINE = "if|while|==|!=|<|>|!"
NO_VARIABLES = ["if", "while", "for", "return", "int", "char", "void", "sizeof", "NULL", "true", "false"]
NO_ARGUMENTS = ["sizeof", "NULL", "true", "false"]
NO_ARRAYS = ["sizeof", "typeof", "if", "while", "for", "switch"]
CHECK_LINES = 10
NAMES = [
    "loc", "stmt_count", "dangerous_call_count", "dangerous_call_without_check_count", "dangerous_call_without_check_ratio", "pointer_deref_count", "pointer_deref_without_null_check_count",
    "pointer_deref_without_null_check_ratio", "array_access_count", "array_access_without_bounds_check_count", "array_access_without_bounds_check_ratio", "malloc_count", "malloc_without_free_count",
    "malloc_without_free_ratio", "free_count", "free_without_null_check_count", "free_without_null_check_ratio", "unchecked_return_value_count", "unchecked_return_value_ratio", "null_check_count",
    "bounds_check_count", "defense_ratio", "dangerous_call_density", "pointer_deref_density", "array_access_density", "null_check_density",
]
IDENTIFIER = r"^[A-Za-z_]\w*$"


def _checked(d: Dialect, lines: str, pattern: str, groups: int) -> str:
    """The names that a pattern finds in any of some lines, each line by itself."""
    found = d.flat(d.map(lines, "l", d.concat(*[d.all("l", pattern, g) for g in range(1, groups + 1)])))
    return d.distinct(d.filter(found, "v", f"{d.has('v', IDENTIFIER)} AND NOT {d.among('v', NO_VARIABLES)}"))


def calls_by_line(d: Dialect, lines: str) -> str:
    """Structs (line from 0, var, call) of the calls that are statements."""
    make = "{'line': i, 'var': v, 'call': c}" if d.duck else "named_struct('line', i, 'var', v, 'call', c)"
    one = f"list_transform(list_zip({d.all('l', ANY_CALL, 1)}, {d.all('l', ANY_CALL, 2)}), lambda z: {{'line': i, 'var': z[1], 'call': z[2]}})" if d.duck else f"zip_with({d.all('l', ANY_CALL, 1)}, {d.all('l', ANY_CALL, 2)}, (v, c) -> {make})"
    return d.filter(d.flat(d.mapi(lines, "l", "i", one)), "x", d.among("x.call", CHECKABLE))


def unchecked(d: Dialect, calls: str, tests: str) -> str:
    """Calls whose variable, if there is one, no comparison in the next lines names. tests: the words of each line with a comparison."""
    near = d.slice(tests, "x.line + 1", f"x.line + {1 + CHECK_LINES}")
    return d.once([calls, tests], d.filter(calls, "x", f"coalesce(x.var, '') = '' OR NOT {d.any(near, 'w', d.contains('w', 'x.var'))}"))


def tests_by_line(d: Dialect, lines: str) -> str:
    none = "CAST([] AS VARCHAR[])" if d.duck else "cast(array() AS array<string>)"
    return d.map(lines, "l", f"CASE WHEN {d.has('l', CHECK_LINE)} THEN {d.words('l')} ELSE {none} END")


def features(d: Dialect, s: str = "code") -> list[dict[str, str]]:
    """The 26 features of NAMES, in steps; a blank text has zeros."""
    names = lambda x: d.filter(d.all(x, r"\b([a-zA-Z_]\w*)\b", 1), "v", f"NOT {d.among('v', NO_ARGUMENTS)}")
    number = f"{d.has('v', IDENTIFIER)}"
    zero = {
        "_blank": f"NOT {d.has(s, chr(92) + 'S')}", "_lines": d.lines(s), "_calls": d.all(s, rf"\b(?:{'|'.join(dangerous())})\s*\(([^)]*)\)", 1), "_arrays": d.all(s, ARRAY, 1), "_indices": d.all(s, ARRAY, 2),
        "_derefs": d.map(f"list_zip({d.all(s, DEREF, 1)}, {d.all(s, DEREF, 2)}, {d.all(s, DEREF, 3)})" if d.duck else f"arrays_zip({d.all(s, DEREF, 1)} , {d.all(s, DEREF, 2)}, {d.all(s, DEREF, 3)})", "x", "concat(x[1], x[2], x[3])" if d.duck else "concat(x.`0`, x.`1`, x.`2`)"),
        "_allocs": d.distinct(d.filter(d.all(s, ALLOC_ASSIGN, 1), "v", number)), "_frees": d.filter(d.all(s, FREE, 1), "v", number),
    }
    one = {
        "_nullv": _checked(d, "_lines", NULL_CHECK, 4), "_boundsv": _checked(d, d.filter("_lines", "y", d.has("y", "if|while|for")), BOUNDS_CHECK, 2),
        "_tests": tests_by_line(d, "_lines"), "_returns": calls_by_line(d, "_lines"),
        "_used": d.filter("_derefs", "x", "x <> ''"),
        "_index": d.filter(f"list_transform(list_zip(_arrays, _indices), lambda z: {{'a': z[1], 'x': z[2]}})" if d.duck else "zip_with(_arrays, _indices, (a, x) -> named_struct('a', a, 'x', x))", "z", f"NOT {d.among('z.a', NO_ARRAYS)}"),
    }
    two = {"_checked": d.concat("_nullv", "_boundsv")}
    word = lambda x: d.filter(d.all(x, r"\b([a-zA-Z_]\w*)\b", 1), "v", f"NOT {d.among('v', NO_ARGUMENTS)}")
    three = {
        "loc": d.size(d.filter("_lines", "l", f"{d.has('l', chr(92) + 'S')} AND NOT {d.has('l', '^' + chr(92) + 's*//')}")), "stmt_count": f"{d.chars(s, ';')} + {d.chars(s, '{')}",
        "dangerous_call_count": d.size("_calls"), "dangerous_call_without_check_count": d.once(["_checked"], d.size(d.filter("_calls", "c", f"NOT {d.overlap(names('c'), '_checked')}"))),
        "pointer_deref_count": d.size("_derefs"), "pointer_deref_without_null_check_count": d.once(["_nullv"], d.size(d.filter("_used", "v", f"NOT {d.contains('_nullv', 'v')}"))),
        "array_access_count": d.size("_index"), "array_access_without_bounds_check_count": d.size(d.filter("_index", "z", f"{d.size(word('z.x'))} > 0 AND NOT {d.overlap(word('z.x'), '_boundsv')}")),
        "malloc_count": d.size("_allocs"), "malloc_without_free_count": d.once(["_frees"], d.size(d.filter("_allocs", "v", f"NOT {d.contains('_frees', 'v')}"))),
        "free_count": d.size("_frees"), "free_without_null_check_count": d.once(["_nullv"], d.size(d.filter("_frees", "v", f"NOT {d.contains('_nullv', 'v')}"))),
        "_n_returns": d.size("_returns"), "unchecked_return_value_count": d.size(unchecked(d, "_returns", "_tests")), "null_check_count": d.size("_nullv"), "bounds_check_count": d.size("_boundsv"),
    }
    four = {
        "dangerous_call_without_check_ratio": d.ratio("dangerous_call_without_check_count", "dangerous_call_count"), "pointer_deref_without_null_check_ratio": d.ratio("pointer_deref_without_null_check_count", "pointer_deref_count"),
        "array_access_without_bounds_check_ratio": d.ratio("array_access_without_bounds_check_count", "array_access_count"), "malloc_without_free_ratio": d.ratio("malloc_without_free_count", "malloc_count"),
        "free_without_null_check_ratio": d.ratio("free_without_null_check_count", "free_count"), "unchecked_return_value_ratio": d.ratio("unchecked_return_value_count", "_n_returns"),
        "defense_ratio": d.ratio("null_check_count + bounds_check_count", "dangerous_call_count + pointer_deref_count + array_access_count + malloc_count"), "dangerous_call_density": d.ratio("dangerous_call_count", "loc"),
        "pointer_deref_density": d.ratio("pointer_deref_count", "loc"), "array_access_density": d.ratio("array_access_count", "loc"), "null_check_density": d.ratio("null_check_count", "loc"),
    }
    five = {f"v_{n}": f"CASE WHEN _blank THEN 0 ELSE {n} END" for n in NAMES}
    return [zero, one, two, three, four, five]
