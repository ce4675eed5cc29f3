"""Serving-time counting features, critical patterns, comment stripping and language detection."""

from __future__ import annotations

from ..functions.dialect import Dialect

# Fixed values.
DANGEROUS = ["strcpy", "strcat", "gets", "sprintf", "memcpy", "memmove", "scanf", "fscanf", "sscanf", "vsprintf", "vprintf"]
SINKS = DANGEROUS
SOURCES = ["read", "fread", "fgets", "gets", "getchar", "scanf", "fscanf", "sscanf", "getenv", "recv", "recvfrom", "recvmsg", "fgetc"]
SAFE = ["strncpy", "strncat", "snprintf", "fgets", "vsnprintf"]
CPP = [r"\bclass\s+\w+", r"\btemplate\s*<", r"\bnamespace\s+\w+", r"\bpublic\s*:", r"\bprivate\s*:", r"\bprotected\s*:", r"\bvirtual\s+", r"\b(std|boost)::", r"\bnew\s+\w+", r"\bdelete\s+", r"\bcout\b", r"\bcin\b", r"\bconst_cast\b", r"\bstatic_cast\b", r"\bdynamic_cast\b", r"\breinterpret_cast\b", r"\bnullptr\b", r"\bauto\s+\w+\s*=", r"::\w+", r"\busing\s+namespace\b", r"\boverride\b", r"\bfinal\b"]


def features(d: Dialect, s: str = "code") -> list[dict[str, str]]:
    """26 counts and ratios, in steps that build on each other."""
    lost = lambda a, b: f"greatest(cast(0 AS bigint), {a} - {b})"
    one = {
        "loc": f"cast(length({s}) - length(replace({s}, chr(10), '')) + 1 AS bigint)", "stmt_count": d.chars(s, ";"),
        "dangerous_call_count": " + ".join(d.count(s, rf"\b{f}\s*\(") for f in DANGEROUS), "_ifs": d.count(s, r"\bif\s*\("), "ptr_deref_count": f"{d.chars(s, '->')} + {d.chars(s, '*')}",
        "null_check_count": f"{d.count(s, r'\bNULL\b')} + {d.count(s, r'!=\s*NULL')}", "array_access_count": d.chars(s, "["), "bounds_check_count": f"{d.count(s, r'<\s*\w+')} + {d.count(s, r'>\s*0')}",
        "malloc_count": f"{d.count(s, r'\bmalloc\s*\(')} + {d.count(s, r'\bcalloc\s*\(')}", "free_count": d.count(s, r"\bfree\s*\("), "_calls": d.count(s, r"\b\w+\s*\("),
    }
    two = {
        "dangerous_call_without_check_count": lost("dangerous_call_count", "_ifs"), "ptr_deref_without_null_check_count": lost("ptr_deref_count", "null_check_count"),
        "array_access_without_bounds_check_count": lost("array_access_count", "bounds_check_count"), "malloc_without_free_count": lost("malloc_count", "free_count"),
        "free_without_null_check_count": lost("free_count", "null_check_count"), "unchecked_return_value_count": lost("_calls", "_ifs"),
    }
    three = {
        "dangerous_call_ratio": d.ratio("dangerous_call_count", "stmt_count"), "ptr_deref_ratio": d.ratio("ptr_deref_without_null_check_count", "ptr_deref_count"), "array_access_ratio": d.ratio("array_access_without_bounds_check_count", "array_access_count"),
        "malloc_without_free_ratio": d.ratio("malloc_without_free_count", "malloc_count"), "free_without_null_check_ratio": d.ratio("free_without_null_check_count", "free_count"), "unchecked_return_ratio": d.ratio("unchecked_return_value_count", "_calls"),
        "defense_ratio": d.ratio("null_check_count + bounds_check_count", "dangerous_call_count + ptr_deref_count + array_access_count"), "dangerous_density": d.ratio("dangerous_call_count", "loc"), "pointer_density": d.ratio("ptr_deref_count", "loc"),
        "array_density": d.ratio("array_access_count", "loc"), "null_check_density": d.ratio("null_check_count", "loc"),
    }
    # a count of dangerous calls without any statement has ratio 0
    three["dangerous_call_ratio"] = f"CASE WHEN stmt_count = 0 THEN cast(0 AS double) ELSE {three['dangerous_call_ratio']} END"
    return [one, two, three]


# The critical patterns, what they add (hundredths) and their labels.
FORMATS = ["printf", "sprintf", "fprintf", "vprintf", "vsprintf"]
COPIES = {"strcpy": "strncpy", "strcat": "strncat"}
GETS = r"\bgets\s*\("
LENGTHS = r"\bsizeof\s*\(|\bstrlen\s*\("
CAST_ALLOC = r"(\w+)\s*=\s*(\(?\s*\w+\s*\*?\s*\)?)\s*malloc\s*\("
NULL_TESTS = r"\s*(==\s*NULL|!=\s*NULL|!|==\s*0|!=\s*0)"
FREE = r"\bfree\s*\(\s*(\w+)\s*\)"
CLEANUP = r"^\s*;\s*\n\s*return\s+NULL\s*;"
BOOSTS = {"gets": 15, "format": 12, "copy": 10, "malloc": 8, "double_free": 15, "use_after_free": 15}
LABELS = {
    "gets": "gets() - buffer overflow risk",
    "format": "{}(user_input) - format string vulnerability",
    "copy": "{}() without bounds check",
    "malloc": "malloc() without NULL check for '{}'",
    "double_free": "double free on '{}'",
    "returned": "use after free - returning freed '{}'",
    "accessed": "use after free - accessing freed '{}'",
}


def format_call(name: str) -> str:
    return rf"""\b{name}\s*\(\s*([^",\)]+)\s*\)"""


def critical(s: str = "code") -> list[dict[str, str]]:
    """The six checks, as array expressions of Spark: what follows a match comes with it by lookahead."""
    d = Dialect(False)
    q = lambda text: d.lit(text)
    follow = lambda pattern, group: f"regexp_extract_all({s}, {q(pattern + r'(?=([\s\S]{0,200}))')}, {group})"
    label = lambda name, by: "concat(" + ", ".join(q(x) for x in LABELS[name].split("{}")[:1]) + f", {by}, " + q(LABELS[name].split("{}")[1]) + ")"
    formats = ", ".join(f"IF({d.has(s, format_call(f))}, {q(LABELS['format'].format(f))}, NULL)" for f in FORMATS)
    copies = ", ".join(f"IF({d.has(s, rf'\b{f}\s*\(')} AND NOT {d.has(s, rf'\b{safe}\s*\(')} AND NOT {d.has(s, LENGTHS)}, {q(LABELS['copy'].format(f))}, NULL)" for f, safe in COPIES.items())
    named = lambda before, after: f"concat({q(before)}, x.v, {q(after)})"
    reassigned = named(r"\b", r"\s*=")
    previous = "(i - array_position(reverse(slice(_fv, 1, i)), v))"
    double = f"array_position(slice(_fv, 1, i), v) > 0 AND NOT exists(slice(_fp, cast({previous} + 2 AS int), cast(i - {previous} AS int)), p -> p RLIKE concat({q(chr(92) + 'b')}, v, {q(chr(92) + 's*=')}))"
    first = "substring(x.a, 1, 100)"
    quiet = f"{first} RLIKE {named('', r'\s*=\s*NULL\b')} OR substring(x.a, 1, 50) RLIKE {q(CLEANUP)} OR {first} RLIKE {reassigned}"
    returned, accessed = f"x.a RLIKE {named(r'\breturn\s+', r'\b')}", f"x.a RLIKE {named(r'\b', r'\s*(\[|->)')}"
    none = "cast(NULL AS string)"
    one = {
        "_gets": d.has(s, GETS), "_formats": f"array_compact(array({formats}))", "_copies": f"array_compact(array({copies}))",
        "_mallocs": f"zip_with({follow(CAST_ALLOC, 1)}, {follow(CAST_ALLOC, 3)}, (v, a) -> named_struct('v', v, 'a', a))",
        "_frees": f"zip_with({follow(FREE, 1)}, {follow(FREE, 2)}, (v, a) -> named_struct('v', v, 'a', a))",
        "_fv": d.all(s, FREE, 1), "_fp": f"split({s}, {q(FREE)}, -1)",
    }
    two = {
        "_malloc": f"get(filter(_mallocs, x -> NOT x.a RLIKE {named(r'\bif\s*\(\s*', NULL_TESTS)}), 0).v",
        "_double": d.once(["_fv", "_fp"], f"get(filter(transform(_fv, (v, i) -> IF({double}, v, {none})), v -> v IS NOT NULL), 0)"),
        "_after": f"get(filter(transform(_frees, x -> CASE WHEN {quiet} THEN {none} WHEN {returned} THEN {label('returned', 'x.v')} WHEN {accessed} THEN {label('accessed', 'x.v')} END), y -> y IS NOT NULL), 0)",
    }
    three = {
        "boost_hundredths": f"cast({BOOSTS['gets']} * cast(_gets AS int) + {BOOSTS['format']} * size(_formats) + {BOOSTS['copy']} * size(_copies) + {BOOSTS['malloc']} * cast(_malloc IS NOT NULL AS int) + {BOOSTS['double_free']} * cast(_double IS NOT NULL AS int) + {BOOSTS['use_after_free']} * cast(_after IS NOT NULL AS int) AS bigint)",
        "patterns": f"array_join(concat(array_compact(array(IF(_gets, {q(LABELS['gets'])}, NULL))), _formats, _copies, array_compact(array({label('malloc', '_malloc')}, {label('double_free', '_double')}, _after))), '; ')",
    }
    return [one, two, three]


def stripped(d: Dialect, s: str = "code") -> str:
    """Without comments; strings are not looked at, as in serving."""
    return d.replace(d.replace(s, r"/\*(?:[^*]|\*+[^*/])*\*+/", ""), r"//[^\n]*", "")


CPP_PROJECTS = ["qemu", "chrome", "chromium", "firefox", "webkit", "llvm", "clang", "gcc", "boost"]
C_HEADERS = r"#include\s*<(stdio|stdlib|string|math|ctype|time|assert)\.h>"


def language(d: Dialect, s: str = "code", project: str = "project") -> str:
    """By the project's name, the patterns of C++, and headers that C does not have."""
    by_project = d.has(f"lower(coalesce({project}, ''))", "|".join(CPP_PROJECTS))
    by_header = f"{d.has(s, r'#include\s*<\w+>')} AND NOT {d.has(s, C_HEADERS)}"
    return f"CASE WHEN {by_project} OR ({by_header}) OR {' OR '.join(d.has(s, p) for p in CPP)} THEN 'cpp' ELSE 'c' END"
