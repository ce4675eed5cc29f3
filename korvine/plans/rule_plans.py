"""Queries over rules, counting features and pointer findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.dialect import DUCK, SPARK, Dialect
from ..operators import defences, heuristics, rules
from ..sources import corpus

QUERIES, ORACLES = {}, {}


def _query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def _exprs(columns: dict[str, str]) -> list:
    return [F.expr(e).alias(c) for c, e in columns.items()]


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.synthetic(spark, sf_dir).select("id", "project", "target", *_exprs(rules.counts(SPARK)))


_COUNTED = f"WITH {corpus.CTE}, counted AS (SELECT id, project, target, {_select(rules.counts(DUCK))} FROM functions)"
_RISK = f"{_COUNTED}, raw AS (SELECT *, {rules.raw_risk()} AS raw_tenths FROM counted), risk AS (SELECT *, {rules.risk_thousandths('raw_tenths', DUCK)} AS risk FROM raw), scored AS (SELECT *, {rules.level('risk')} AS risk_level FROM risk)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = counted(spark, sf_dir).withColumn("raw_tenths", F.expr(rules.raw_risk()))
    return raw.withColumn("risk", F.expr(rules.risk_thousandths("raw_tenths", SPARK))).withColumn("risk_level", F.expr(rules.level("risk")))


_query("r3_vuln_features", f"{_COUNTED} SELECT * FROM counted")(counted)
_query("r6_risk_score", f"{_RISK} SELECT id, raw_tenths, risk, risk_level FROM scored")(lambda s, d: scored(s, d).select("id", "raw_tenths", "risk", "risk_level"))


@_query("r7_risk_levels", f"{_RISK} SELECT risk_level, count(*) AS n, sum(raw_tenths)::BIGINT AS raw_tenths, max(risk)::BIGINT AS max_risk, count(*) FILTER (target) AS n_target FROM scored GROUP BY risk_level")
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scored(spark, sf_dir).groupBy("risk_level")
    return g.agg(F.count("*").alias("n"), F.sum("raw_tenths").alias("raw_tenths"), F.max("risk").cast("long").alias("max_risk"), F.count_if("target").alias("n_target"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, line (from 1), text."""
    return corpus.synthetic(spark, sf_dir).select("id", F.posexplode(F.split("code", "\n")).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("long"))


LINES = f"WITH {corpus.CTE}, ls AS (SELECT id, string_split(code, chr(10)) AS l FROM functions), lines AS (SELECT id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM ls)"


def _hit_rows(d: Dialect) -> str:
    parts = [f"SELECT id, line, '{c}' AS category, {k} AS pattern, {d.first('text', p)} AS hit FROM lines WHERE {d.has('text', p)}" for k, (c, p) in enumerate(rules.PATTERNS)]
    return " UNION ALL ".join(parts)


@_query("r1_detect", f"{LINES} SELECT * FROM ({_hit_rows(DUCK)})")
def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit at most for each pattern and line: the patterns are literals in one array, exploded once per line."""
    hits = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("pattern"), F.regexp_extract("text", p, 0).alias("hit")) for k, (c, p) in enumerate(rules.PATTERNS)])
    return lines(spark, sf_dir).select("id", "line", F.inline(F.filter(hits, lambda h: h["hit"] != "")))


@_query("r2_vuln_types", f"{LINES}, hits AS ({_hit_rows(DUCK)}) SELECT id, count(DISTINCT category) AS n_types, min(category) AS first_type, array_to_string(list_sort(list_distinct(list(category))), ',') AS types FROM hits GROUP BY id")
def vuln_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category holds if some line has one of its patterns: no rows of lines, no shuffle."""
    of = lambda c: F.exists("l", lambda x: x.rlike("|".join(p for k, p in rules.PATTERNS if k == c)))
    held = F.sort_array(F.array_compact(F.array(*[F.when(of(c), F.lit(c)) for c in rules.CATEGORIES if any(k == c for k, _ in rules.PATTERNS)])))
    d = corpus.synthetic(spark, sf_dir).select("id", F.split("code", "\n").alias("l")).select("id", held.alias("t")).where(F.size("t") > 0)
    return d.select("id", F.size("t").cast("long").alias("n_types"), F.element_at("t", 1).alias("first_type"), F.array_join("t", ",").alias("types"))


_CATEGORY = "CASE call " + " ".join(f"WHEN '{f}' THEN '{next(c for c in rules.CATEGORIES if f in rules.FUNCTIONS[c])}'" for f in rules.dangerous()) + " END"


@_query("r4_dangerous_calls", f"{LINES}, calls AS (SELECT id, line, unnest(regexp_extract_all(text, '{rules.CALL}', 1)) AS call FROM lines) SELECT id, line, call, {_CATEGORY} AS category FROM calls WHERE {DUCK.among('call', rules.dangerous())}")
def dangerous_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls joined with the dictionary of dangerous functions, a dimension of fixed size."""
    rows = [(f, c, k) for k, c in enumerate(rules.CATEGORIES) for f in rules.FUNCTIONS[c]]
    dictionary = spark.createDataFrame(rows, "call string, category string, k int").groupBy("call").agg(F.min_by("category", "k").alias("category"))
    calls = lines(spark, sf_dir).select("id", "line", F.explode(F.regexp_extract_all("text", F.lit(rules.CALL), F.lit(1))).alias("call"))
    return calls.join(F.broadcast(dictionary), "call").select("id", "line", "call", "category")


_ALLOCS = f"allocs AS (SELECT id, line, unnest(regexp_extract_all(text, '{rules.ALLOC_ASSIGN}', 1)) AS var FROM lines), frees AS (SELECT id, line, unnest(regexp_extract_all(text, '{rules.FREE}', 1)) AS var FROM lines)"


def _found(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    return lines(spark, sf_dir).select("id", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("var"))


@_query(
    "r5_pointer_usage",
    f"{LINES}, {_ALLOCS}, c AS (SELECT id, {_select({'n_pointers': DUCK.count('code', rules.POINTER), 'n_arrays': DUCK.count('code', rules.ARRAY), 'n_null_checks': DUCK.count('code', rules.NULL_CHECK), 'n_allocs': DUCK.count('code', rules.ALLOC_ASSIGN), 'n_frees': DUCK.count('code', rules.FREE)})} FROM functions) "
    "SELECT *, n_allocs > 0 AND n_frees = 0 AS memory_leak, n_frees > n_allocs AS double_free FROM c",
)
def pointer_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {"n_pointers": SPARK.count("code", rules.POINTER), "n_arrays": SPARK.count("code", rules.ARRAY), "n_null_checks": SPARK.count("code", rules.NULL_CHECK), "n_allocs": SPARK.count("code", rules.ALLOC_ASSIGN), "n_frees": SPARK.count("code", rules.FREE)}
    return corpus.synthetic(spark, sf_dir).select("id", *_exprs(c)).withColumns({"memory_leak": F.expr("n_allocs > 0 AND n_frees = 0"), "double_free": F.expr("n_frees > n_allocs")})


def _by_line(pattern: str, group: int = 1) -> str:
    """Structs (v, line from 0) of all matches in the lines `l`."""
    return f"flatten(transform(l, (t, i) -> transform({SPARK.all('t', pattern, group)}, v -> named_struct('v', v, 'line', i))))"


def line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, l: the lines of each function as an array, so that looking around within a function needs no shuffle."""
    return corpus.synthetic(spark, sf_dir).select("id", "project", F.split("code", "\n").alias("l"))


@_query(
    "r5_pointer_lists",
    f"{LINES}, {_ALLOCS}, decls AS (SELECT id, line, unnest(regexp_extract_all(text, '{rules.POINTER}', 2)) AS var FROM lines), arrays AS (SELECT id, line, unnest(regexp_extract_all(text, '{rules.ARRAY}', 1)) AS var FROM lines), every AS (SELECT 'alloc' AS what, id, line, var FROM allocs UNION ALL SELECT 'free', id, line, var FROM frees UNION ALL SELECT 'array', id, line, var FROM arrays UNION ALL SELECT 'declaration', id, line, var FROM decls) SELECT what, id, line, var FROM every",
)
def pointer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what, id, line, var: the lists of pointer declarations, allocations, frees and array accesses."""
    kinds = {"declaration": (rules.POINTER, 2), "alloc": (rules.ALLOC_ASSIGN, 1), "free": (rules.FREE, 1), "array": (rules.ARRAY, 1)}
    every = "concat(" + ", ".join(f"transform({_by_line(p, g)}, x -> named_struct('what', '{k}', 'line', cast(x.line + 1 AS bigint), 'var', x.v))" for k, (p, g) in kinds.items()) + ")"
    return line_arrays(spark, sf_dir).select("id", F.expr(f"inline({every})")).select("what", "id", "line", "var")


@_query(
    "r5_pointer_stats",
    f"WITH {corpus.CTE}, c AS (SELECT id, len(regexp_extract_all(code, '{rules.ALLOC_ASSIGN}')) AS n_allocs, len(regexp_extract_all(code, '{rules.FREE}')) AS n_frees FROM functions) SELECT id, n_allocs, n_frees, CASE WHEN n_allocs > 0 THEN (100 * n_frees // n_allocs) END AS alloc_free_percent, CASE WHEN n_allocs > 0 AND n_frees = 0 THEN 'potential_memory_leak' WHEN n_frees > n_allocs THEN 'potential_double_free' END AS issue FROM c",
)
def pointer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {"n_allocs": SPARK.count("code", rules.ALLOC_ASSIGN), "n_frees": SPARK.count("code", rules.FREE)}
    issue = F.when((F.col("n_allocs") > 0) & (F.col("n_frees") == 0), "potential_memory_leak").when(F.col("n_frees") > F.col("n_allocs"), "potential_double_free")
    d = corpus.synthetic(spark, sf_dir).select("id", *_exprs(c))
    return d.withColumns({"alloc_free_percent": F.expr("CASE WHEN n_allocs > 0 THEN 100 * n_frees div n_allocs END"), "issue": issue})


@_query("r5c_use_after_free", f"{LINES}, {_ALLOCS} SELECT f.id, f.var, f.line AS freed, min(u.line) AS used FROM (SELECT DISTINCT * FROM frees) f JOIN lines u ON f.id = u.id AND u.line > f.line AND regexp_matches(u.text, '\\b' || f.var || '\\s*->|\\*\\s*' || f.var) GROUP BY ALL".replace("\\\\", "\\"))
def use_after_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line after a free that dereferences what was freed; without a word boundary after `*var`, as in the reference."""
    used = "concat('\\\\b', x.v, '\\\\s*->|\\\\*\\\\s*', x.v)"
    first = f"array_position(transform(slice(l, x.line + 2, size(l)), t -> t RLIKE {used}), true)"
    found = f"filter(transform(array_distinct({_by_line(rules.FREE)}), x -> named_struct('var', x.v, 'freed', cast(x.line + 1 AS bigint), 'k', {first})), y -> y.k > 0)"
    return line_arrays(spark, sf_dir).select("id", F.expr(f"inline({found})")).select("id", "var", "freed", (F.col("freed") + F.col("k")).alias("used"))


_CHECKS = r"if\s*\([^)]*(?:==|!=)\s*NULL|if\s*\(\s*!\s*\w+"


@_query("r5d_missing_null_check", f"{LINES}, {_ALLOCS}, checks AS (SELECT id, line FROM lines WHERE {DUCK.has('text', _CHECKS)}) SELECT id, var, line FROM allocs a WHERE NOT EXISTS (SELECT 1 FROM checks c WHERE c.id = a.id AND c.line BETWEEN a.line + 1 AND a.line + 3)")
def missing_null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No check in the next three lines."""
    found = f"filter({_by_line(rules.ALLOC_ASSIGN)}, x -> NOT exists(slice(l, x.line + 2, 3), t -> {SPARK.has('t', _CHECKS)}))"
    return line_arrays(spark, sf_dir).select("id", F.expr(f"inline({found})")).select("id", F.col("v").alias("var"), (F.col("line") + 1).cast("long").alias("line"))


@_query("r9_dictionary", " UNION ALL ".join(f"SELECT '{c}' AS category, '{rules.SEVERITY[c]}' AS severity, {rules.SEVERITY_WEIGHT[rules.SEVERITY[c]]} AS weight, {len(rules.FUNCTIONS[c])} AS n_functions, {sum(k == c for k, _ in rules.PATTERNS)} AS n_patterns" for c in rules.CATEGORIES))
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, rules.SEVERITY[c], rules.SEVERITY_WEIGHT[rules.SEVERITY[c]], len(rules.FUNCTIONS[c]), sum(k == c for k, _ in rules.PATTERNS)) for c in rules.CATEGORIES]
    return spark.createDataFrame(rows, "category string, severity string, weight int, n_functions int, n_patterns int")


def _features(name: str, of) -> None:
    """A query of one function's features that needs no shuffle."""
    first, *rest = of(DUCK)
    sql, last = f"WITH {corpus.CTE}, f0 AS (SELECT id, code, {_select(first)} FROM functions)", "f0"
    for k, step in enumerate(rest, 1):
        sql += f", f{k} AS (SELECT *, {_select(step)} FROM f{k - 1})"
        last = f"f{k}"
    drop = [c for step in of(DUCK) for c in step if c.startswith("_")] + ["code"]
    ORACLES[name] = f"{sql} SELECT * EXCLUDE ({', '.join(drop)}) FROM {last}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = corpus.synthetic(spark, sf_dir).select("id", "code")
        for step in of(SPARK):
            df = df.select("*", *_exprs(step))
        return df.drop(*drop)

    QUERIES[name] = run


_features("i1_heuristic_features", heuristics.features)
_features("i4_strip_comments", lambda d: [{"stripped": heuristics.stripped(d)}])


def _v_sql() -> str:
    first, *rest = defences.features(DUCK)
    sql, last = f"WITH {corpus.CTE}, f0 AS (SELECT id, code, {_select(first)} FROM functions)", "f0"
    for k, step in enumerate(rest, 1):
        sql += f", f{k} AS (SELECT *, {_select(step)} FROM f{k - 1})"
        last = f"f{k}"
    return f"{sql}, v AS (SELECT id, {', '.join(f'v_{n} AS {n}' for n in defences.NAMES)} FROM {last})"


def with_defences(df: DataFrame, *keep: str) -> DataFrame:
    """Some columns and the 26 missing-defence features of `code`."""
    for step in defences.features(SPARK):
        df = df.select("*", *_exprs(step))
    return df.select(*keep, *[F.col(f"v_{n}").alias(n) for n in defences.NAMES])


def missing_defences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and the 26 missing-defence features."""
    return with_defences(corpus.synthetic(spark, sf_dir).select("id", "code"), "id")


_query("v_missing_defence_features", f"{_v_sql()} SELECT * FROM v")(missing_defences)


@_query("x6_language", rf"WITH {corpus.CTE} SELECT id, CASE WHEN regexp_matches(lower(project), '{'|'.join(heuristics.CPP_PROJECTS)}') OR len(regexp_extract_all(code, '{'|'.join(heuristics.CPP)}')) > 0 OR (regexp_matches(code, '#include\s*<\w+>') AND NOT regexp_matches(code, '{heuristics.C_HEADERS}')) THEN 'cpp' ELSE 'c' END AS language FROM functions")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.synthetic(spark, sf_dir).select("id", F.expr(heuristics.language(SPARK)).alias("language"))


def _follow_sql(name: str, pattern: str) -> str:
    """Rows (id, k, v, upto, after) of a pattern's matches: what lies before each match of the same text is counted by pieces."""
    q = DUCK.lit(pattern)
    return f"""{name}_m AS (SELECT id, code, string_split_regex(code, {q}) AS p, regexp_extract_all(code, {q}, 0) AS m, regexp_extract_all(code, {q}, 1) AS v FROM functions),
{name}_k AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM {name}_m),
{name} AS (SELECT id, code, p, v AS vs, k, v[k] AS v, (list_sum(list_transform(p[1:k], lambda x: length(x))) + list_sum(list_transform(m[1:k], lambda x: length(x))))::BIGINT AS upto FROM {name}_k)"""


def _i3_sql() -> str:
    h, has = heuristics, DUCK.has
    text = lambda name, by: "'" + h.LABELS[name].replace("'", "''").replace("{}", f"' || {by} || '") + "'"
    formats = " UNION ALL ".join(f"SELECT id, {2 * k} AS o, '{h.LABELS['format'].format(f)}' AS label, {h.BOOSTS['format']} AS boost FROM functions WHERE {has('code', h.format_call(f))}" for k, f in enumerate(h.FORMATS, 1))
    copies = " UNION ALL ".join(f"SELECT id, {20 + k}, '{h.LABELS['copy'].format(f)}', {h.BOOSTS['copy']} FROM functions WHERE contains_call(code, '{f}') AND NOT contains_call(code, '{safe}') AND NOT contains_call(code, 'sizeof') AND NOT contains_call(code, 'strlen')" for k, (f, safe) in enumerate(h.COPIES.items()))
    import re

    copies = re.sub(r"contains_call\(code, '(\w+)'\)", lambda m: has("code", rf"\b{m[1]}\s*\("), copies)
    return rf"""WITH {corpus.CTE}, {_follow_sql("mallocs", h.CAST_ALLOC)}, {_follow_sql("frees", h.FREE)},
bad_malloc AS (SELECT id, min_by(v, k) AS v FROM mallocs WHERE NOT regexp_matches(substr(code, upto + 1, 200), '\bif\s*\(\s*' || v || {DUCK.lit(h.NULL_TESTS)}) GROUP BY id),
again AS (SELECT b.id, b.k, b.v, max(a.k) AS j, any_value(b.p) AS p FROM frees a JOIN frees b ON a.id = b.id AND a.v = b.v AND a.k < b.k GROUP BY ALL),
twice AS (SELECT id, min_by(v, k) AS v FROM again WHERE len(list_filter(p[j + 1:k], lambda x: regexp_matches(x, '\b' || v || '\s*='))) = 0 GROUP BY id),
fa AS (SELECT *, substr(code, upto + 1, 200) AS a, substr(code, upto + 1, 100) AS b, substr(code, upto + 1, 50) AS c FROM frees),
fb AS (SELECT id, k, CASE WHEN regexp_matches(a, '\breturn\s+' || v || '\b') THEN {text("returned", "v")} WHEN regexp_matches(a, '\b' || v || '\s*(\[|->)') THEN {text("accessed", "v")} END AS label
  FROM fa WHERE NOT regexp_matches(b, v || '\s*=\s*NULL\b') AND NOT regexp_matches(c, {DUCK.lit(h.CLEANUP)}) AND NOT regexp_matches(b, '\b' || v || '\s*=')),
used AS (SELECT id, min_by(label, k) AS label FROM fb WHERE label IS NOT NULL GROUP BY id),
every AS (SELECT id, 0 AS o, '{h.LABELS["gets"]}' AS label, {h.BOOSTS["gets"]} AS boost FROM functions WHERE {has("code", h.GETS)} UNION ALL {formats} UNION ALL {copies}
  UNION ALL SELECT id, 30, {text("malloc", "v")}, {h.BOOSTS["malloc"]} FROM bad_malloc UNION ALL SELECT id, 31, {text("double_free", "v")}, {h.BOOSTS["double_free"]} FROM twice UNION ALL SELECT id, 32, label, {h.BOOSTS["use_after_free"]} FROM used),
boosts AS (SELECT id, sum(boost)::BIGINT AS boost_hundredths, string_agg(label, '; ' ORDER BY o) AS patterns FROM every GROUP BY id),
critical AS (SELECT f.id, coalesce(boost_hundredths, 0) AS boost_hundredths, coalesce(patterns, '') AS patterns FROM functions f LEFT JOIN boosts b ON f.id = b.id)"""


I3 = _i3_sql()


@_query("i3_critical_patterns", f"{I3} SELECT * FROM critical")
def critical_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = corpus.synthetic(spark, sf_dir).select("id", "code")
    for step in heuristics.critical():
        df = df.select("*", *_exprs(step))
    return df.select("id", "boost_hundredths", "patterns")


@_query(
    "v7_unchecked_returns",
    f"""{LINES}, found AS (SELECT id, line, unnest(list_zip(regexp_extract_all(text, {DUCK.lit(defences.ANY_CALL)}, 1), regexp_extract_all(text, {DUCK.lit(defences.ANY_CALL)}, 2))) AS z FROM lines), calls AS (SELECT id, line, nullif(z[1], '') AS var, z[2] AS call FROM found WHERE {DUCK.among('z[2]', defences.CHECKABLE)}),
tests AS (SELECT id, line, text FROM lines WHERE text LIKE '%if%' OR text LIKE '%while%' OR text LIKE '%==%' OR text LIKE '%<%' OR text LIKE '%>%' OR text LIKE '%!%')
SELECT id, line, var, call FROM calls c WHERE NOT EXISTS (SELECT 1 FROM tests t WHERE t.id = c.id AND regexp_matches(t.text, '\\b' || c.var || '\\b') AND t.line BETWEEN c.line + 1 AND c.line + {defences.CHECK_LINES})""".replace("\\\\", "\\"),
)
def unchecked_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as statements whose result no comparison names in the next ten lines; one without a variable is never checked."""
    d = line_arrays(spark, sf_dir).select("id", F.expr(defences.calls_by_line(SPARK, "l")).alias("calls"), F.expr(defences.tests_by_line(SPARK, "l")).alias("tests"))
    d = d.select("id", F.expr(f"inline({defences.unchecked(SPARK, 'calls', 'tests')})"))
    return d.select("id", (F.col("line") + 1).cast("long").alias("line"), F.nullif("var", F.lit("")).alias("var"), "call")


_GUARD = r"NULL|!= 0|<.*(?:\[|[lL][eE][nN])|(?:\[|[lL][eE][nN]).*<"


@_query(
    "g16_unguarded_calls",
    f"{LINES}, sinks AS (SELECT id, line, unnest(regexp_extract_all(text, '{rules.CALL}', 1)) AS call FROM lines), guards AS (SELECT id, line FROM lines WHERE text LIKE '%NULL%' OR text LIKE '%!= 0%' OR (text LIKE '%<%' AND (text LIKE '%[%' OR lower(text) LIKE '%len%'))) SELECT id, line, call FROM sinks s WHERE {DUCK.among('call', heuristics.SINKS)} AND NOT EXISTS (SELECT 1 FROM guards g WHERE g.id = s.id AND g.line BETWEEN s.line - 5 AND s.line - 1)",
)
def unguarded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangerous calls without a guard in the five lines before. The condition blocks of the control flow are `graph_risk`'s."""
    found = f"filter({_by_line(rules.CALL)}, x -> {SPARK.among('x.v', heuristics.SINKS)} AND NOT exists(slice(l, greatest(x.line - 4, 1), least(x.line, 5)), t -> {SPARK.has('t', _GUARD)}))"
    return line_arrays(spark, sf_dir).select("id", F.expr(f"inline({found})")).select("id", (F.col("line") + 1).cast("long").alias("line"), F.col("v").alias("call"))


def _args_sql(names: list[str]) -> str:
    return rf"unnest(regexp_extract_all(array_to_string(regexp_extract_all(text, '\b(?:{'|'.join(names)})\s*\(([^)]*)\)', 1), ' '), '[A-Za-z_]\w*'))"


@_query(
    "g15_tainted_sinks",
    rf"{LINES}, seeds AS (SELECT id, {_args_sql(heuristics.SOURCES)} AS var FROM lines UNION SELECT id, unnest(regexp_extract_all(regexp_extract(text, '^\w+ \w+\(([^)]*)\)', 1), '(\w+)\s*(?:,|$)', 1)) AS var FROM lines), sinks AS (SELECT DISTINCT id, line, {_args_sql(heuristics.SINKS)} AS var FROM lines) SELECT id, line, var FROM sinks s WHERE EXISTS (SELECT 1 FROM seeds t WHERE s.id = t.id AND s.var = t.var)",
)
def tainted_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of sinks that are parameters or arguments of an input function (equal names carry taint on, so the closure is its seeds)."""
    args = lambda names: rf"\b(?:{'|'.join(names)})\s*\(([^)]*)\)"
    name = r"[A-Za-z_]\w*"
    d = line_arrays(spark, sf_dir)
    params = f"flatten(transform(l, t -> {SPARK.all(SPARK.first('t', r'^\w+ \w+\(([^)]*)\)', 1), r'(\w+)\s*(?:,|$)', 1)}))"
    seeds = f"flatten(transform(l, t -> flatten(transform({SPARK.all('t', args(heuristics.SOURCES), 1)}, y -> {SPARK.all('y', name)}))))"
    sinks = f"flatten(transform(l, (t, i) -> transform(array_distinct(flatten(transform({SPARK.all('t', args(heuristics.SINKS), 1)}, y -> {SPARK.all('y', name)}))), v -> named_struct('line', cast(i + 1 AS bigint), 'var', v))))"
    d = d.select("id", F.expr(f"concat({params}, {seeds})").alias("tainted"), F.expr(sinks).alias("sinks"))
    return d.select("id", F.expr("inline(filter(sinks, x -> array_contains(tainted, x.var)))"))


@_query(
    "g12_window_slices",
    rf"{LINES}, crit AS (SELECT id, line FROM lines WHERE {DUCK.has('text', 'strcpy|malloc')}), w AS (SELECT DISTINCT c.id, l.line, l.text FROM crit c JOIN lines l ON c.id = l.id AND l.line BETWEEN c.line - 2 AND c.line + 2), k AS (SELECT id, line, text FROM w WHERE regexp_matches(text, '\S')) SELECT id, count(*) AS n_lines, min(line) AS first_line, max(line) AS last_line, string_agg(text, chr(10) ORDER BY line) AS slice FROM k GROUP BY id",
)
def window_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within two of a criterion line, once each, without blank ones."""
    kept = F.expr("filter(transform(l, (t, i) -> named_struct('line', cast(i + 1 AS bigint), 'text', t, 'near', exists(slice(l, greatest(i - 1, 1), least(i, 2) + 3), y -> y RLIKE 'strcpy|malloc'))), x -> x.near AND x.text RLIKE '\\\\S')")
    d = line_arrays(spark, sf_dir).select("id", kept.alias("k")).where(F.size("k") > 0)
    return d.select("id", F.size("k").cast("long").alias("n_lines"), F.expr("k[0].line").alias("first_line"), F.expr("k[size(k) - 1].line").alias("last_line"), F.expr("array_join(transform(k, x -> x.text), '\\n')").alias("slice"))
