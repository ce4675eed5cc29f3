"""Queries that profile a corpus: statistics, length and feature reports, padding, slice statistics, filters, windows and joins by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.dialect import DUCK, SPARK
from ..operators import defences, heuristics, places, rules, slices, tokens
from ..sources import corpus
from . import rule_plans, token_plans
from .rule_plans import LINES, _exprs, _select, line_arrays

QUERIES, ORACLES = {}, {}


def _query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_LEN = "length(code)"


@_query("a1_profile", f"WITH {corpus.CTE} SELECT coalesce(split, 'all') AS split, count(*) AS n, count(*) FILTER (target) AS n_vulnerable, min({_LEN})::BIGINT AS min_length, max({_LEN})::BIGINT AS max_length, sum({_LEN})::BIGINT AS sum_length, quantile_cont({_LEN}, 0.5)::DOUBLE AS median_length, quantile_cont({_LEN}, 0.9)::DOUBLE AS p90_length, count(DISTINCT project) AS n_projects FROM functions GROUP BY ROLLUP (split)")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: a report per split and overall."""
    n = F.length("code")
    g = corpus.synthetic(spark, sf_dir).rollup("split")
    out = g.agg(F.count("*").alias("n"), F.count_if("target").alias("n_vulnerable"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), F.sum(n).alias("sum_length"), F.percentile(n, 0.5).alias("median_length"), F.percentile(n, 0.9).alias("p90_length"), F.countDistinct("project").alias("n_projects"))
    return out.withColumn("split", F.coalesce("split", F.lit("all")))


_VULNERABLE = r"strcpy\s*\(|q\[n\]|free\s*\("


@_query(
    "a1_statistics",
    f"WITH {corpus.CTE}, a AS (SELECT *, length(func) AS n, len(list_filter(string_split(code, chr(10)), lambda l: target AND regexp_matches(l, {DUCK.lit(_VULNERABLE)}))) AS vl, len(string_split(code, chr(10))) AS ln FROM functions) SELECT count(*) AS total, count(*) FILTER (target) AS n_vulnerable, round((count(*) FILTER (target))::DOUBLE / count(*), 4) AS vulnerable_ratio, count(func) AS n_texts, min(n)::BIGINT AS min_length, max(n)::BIGINT AS max_length, round(avg(n), 2) AS mean_length, median(n)::DOUBLE AS median_length, round(stddev_samp(n), 2) AS std_length, sum(vl)::BIGINT AS vul_lines, count(*) FILTER (vl > 0) AS n_with_vul_lines, max(vl)::BIGINT AS max_vul_lines, round(avg(vl) FILTER (vl > 0), 2) AS mean_vul_lines, round(avg(ln), 2) AS mean_lines, count(DISTINCT project) AS n_projects FROM a",
)
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: one pass over the table; lengths of null texts do not count."""
    marked = F.filter(F.split("code", "\n"), lambda x: F.col("target") & x.rlike(_VULNERABLE))
    a = corpus.synthetic(spark, sf_dir).select("target", "project", F.length("func").alias("n"), F.size(marked).alias("vl"), F.size(F.split("code", "\n")).alias("ln"))
    some = F.when(F.col("vl") > 0, F.col("vl"))
    return a.agg(
        F.count("*").alias("total"), F.count_if("target").alias("n_vulnerable"), F.round(F.count_if("target") / F.count("*"), 4).alias("vulnerable_ratio"), F.count("n").alias("n_texts"),
        F.min("n").cast("long").alias("min_length"), F.max("n").cast("long").alias("max_length"), F.round(F.avg("n"), 2).alias("mean_length"), F.percentile("n", 0.5).alias("median_length"), F.round(F.stddev_samp("n"), 2).alias("std_length"),
        F.sum("vl").alias("vul_lines"), F.count(some).alias("n_with_vul_lines"), F.max("vl").cast("long").alias("max_vul_lines"), F.round(F.avg(some), 2).alias("mean_vul_lines"), F.round(F.avg("ln"), 2).alias("mean_lines"), F.countDistinct("project").alias("n_projects"),
    )


@_query("a1_projects", f"WITH {corpus.CTE} SELECT project, count(*) AS n, count(*) FILTER (target) AS n_vulnerable FROM functions GROUP BY project")
def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.synthetic(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"), F.count_if("target").alias("n_vulnerable"))


@_query("a3_distribution", f"WITH {corpus.CTE}, c AS (SELECT split, count(*) FILTER (target) AS vulnerable, count(*) FILTER (NOT target) AS safe FROM functions GROUP BY split) SELECT *, CASE WHEN safe > 0 THEN vulnerable::DOUBLE / safe::DOUBLE ELSE 0 END AS ratio FROM c")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and their ratio."""
    c = corpus.synthetic(spark, sf_dir).groupBy("split").agg(F.count_if("target").alias("vulnerable"), F.count_if(~F.col("target")).alias("safe"))
    return c.withColumn("ratio", F.expr("CASE WHEN safe > 0 THEN cast(vulnerable AS double) / cast(safe AS double) ELSE 0D END"))


# ---- slices ------------------------------------------------------------------------------------------------------------------

_CRITERION = "strcpy|malloc"
_K = 2


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, l, crit (lines with a criterion, from 1), kept (lines within two of one)."""
    d = line_arrays(spark, sf_dir).withColumn("crit", F.expr(f"filter(transform(l, (t, i) -> IF(t RLIKE '{_CRITERION}', i + 1, 0)), x -> x > 0)"))
    return d.withColumn("kept", slices.window("crit", "l", _K, _K))


_CRIT_SQL = f"{LINES}, crit AS (SELECT id, line FROM lines WHERE {DUCK.has('text', _CRITERION)})"


@_query("x2_extracted_lines", f"{_CRIT_SQL}, w AS (SELECT DISTINCT c.id, l.line, l.text FROM crit c JOIN lines l ON c.id = l.id AND l.line BETWEEN c.line - {_K} AND c.line + {_K}) SELECT id, string_agg(text, chr(10) ORDER BY line) AS code, count(*) AS n FROM w WHERE regexp_matches(text, '\\S') GROUP BY id")
def extracted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sliced(spark, sf_dir).withColumn("s", slices.extracted("kept", "l")).where(F.size("s") > 0)
    return d.select("id", F.array_join("s", "\n").alias("code"), F.size("s").cast("long").alias("n"))


@_query("x3_dedented", f"{_CRIT_SQL}, w AS (SELECT DISTINCT c.id, l.line, l.text FROM crit c JOIN lines l ON c.id = l.id AND l.line BETWEEN c.line - {_K} AND c.line + {_K}), k AS (SELECT *, min(length(text) - length(ltrim(text, ' ' || chr(9)))) OVER (PARTITION BY id) AS m FROM w WHERE regexp_matches(text, '\\S')) SELECT id, string_agg(substr(text, m + 1), chr(10) ORDER BY line) AS code FROM k GROUP BY id")
def dedented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines go, and the indentation that all lines share."""
    return sliced(spark, sf_dir).where(F.size("crit") > 0).select("id", slices.dedented("kept", "l").alias("code"))


_MOST = 12


@_query(
    "x4_centered",
    f"{_CRIT_SQL}, w AS (SELECT DISTINCT c.id, l.line, l.text FROM crit c JOIN lines l ON c.id = l.id AND l.line BETWEEN c.line - {_K} AND c.line + {_K}), k AS (SELECT id, line, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM w WHERE regexp_matches(text, '\\S')), f AS (SELECT id, min(line) AS first FROM crit GROUP BY id), r AS (SELECT k.*, coalesce(sum(len(t)) OVER (PARTITION BY k.id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (sum(len(t)) OVER (PARTITION BY k.id))::BIGINT AS n, first FROM k JOIN f ON k.id = f.id), g AS (SELECT id, any_value(n) AS n, flatten(list(t ORDER BY line)) AS every, max(CASE WHEN line = first THEN before + len(t) // 2 END) AS target FROM r GROUP BY id), s AS (SELECT *, CASE WHEN n <= {_MOST} THEN 0 WHEN least(n, greatest(0, target - {_MOST // 2}) + {_MOST}) = n THEN greatest(0, n - {_MOST}) ELSE greatest(0, target - {_MOST // 2}) END AS start FROM g) SELECT id, start::BIGINT AS start, array_to_string(every[start + 1:start + {_MOST}], ' ') AS code FROM s",
)
def centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most so many tokens around the middle of the first criterion line."""
    d = sliced(spark, sf_dir).where(F.size("crit") > 0)
    return d.select("id", F.inline(F.array(slices.centered("kept", "crit", "l", _MOST)))).select("id", F.col("start").cast("long").alias("start"), F.array_join("tokens", " ").alias("code"))


@_query("g12_forward_windows", f"{_CRIT_SQL}, w AS (SELECT DISTINCT c.id, l.line FROM crit c JOIN lines l ON c.id = l.id AND l.line BETWEEN c.line AND c.line + 3) SELECT id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS kept FROM w GROUP BY id")
def forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sliced(spark, sf_dir).where(F.size("crit") > 0).withColumn("w", slices.window("crit", "l", 0, 3))
    return d.select("id", F.size("w").cast("long").alias("n"), F.array_join(F.col("w").cast("array<string>"), ",").alias("kept"))


@_query("u1_both_windows", f"{_CRIT_SQL}, w AS (SELECT c.id, l.line FROM crit c JOIN lines l ON c.id = l.id AND l.line BETWEEN c.line - 2 AND c.line UNION SELECT c.id, l.line FROM crit c JOIN lines l ON c.id = l.id AND l.line BETWEEN c.line AND c.line + 3) SELECT id, count(*) AS n, min(line) AS first_line, max(line) AS last_line FROM w GROUP BY id")
def both_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of a window behind and a window ahead."""
    d = sliced(spark, sf_dir).where(F.size("crit") > 0).withColumn("w", F.array_union(slices.window("crit", "l", 2, 0), slices.window("crit", "l", 0, 3)))
    return d.select("id", F.size("w").cast("long").alias("n"), F.array_min("w").cast("long").alias("first_line"), F.array_max("w").cast("long").alias("last_line"))


@_query("f4_valid_criteria", f"WITH {corpus.CTE}, c AS (SELECT id, len(string_split(code, chr(10))) AS n, [id % 9 - 2, id % 23, 400] AS want FROM functions), v AS (SELECT *, list_filter(want, lambda x: x >= 1 AND x <= n) AS ok FROM c) SELECT id, array_to_string(CASE WHEN len(ok) > 0 THEN ok WHEN want[1] >= 1 THEN [want[1]] ELSE [1] END, ',') AS criteria FROM v")
def valid_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines of the text, else the first line asked for if it can be one, else line 1."""
    d = corpus.synthetic(spark, sf_dir).select("id", F.size(F.split("code", "\n")).alias("n"), F.expr("array(id % 9 - 2, id % 23, 400L)").alias("want"))
    d = d.withColumn("ok", F.expr("filter(want, x -> x >= 1 AND x <= n)"))
    return d.select("id", F.expr("array_join(transform(CASE WHEN size(ok) > 0 THEN ok WHEN want[0] >= 1 THEN array(want[0]) ELSE array(1L) END, x -> cast(x AS string)), ',')").alias("criteria"))


# Slices of three kinds for each function; sizes are lines.
_SLICES_SQL = f"{_CRIT_SQL}, every AS (SELECT c.id, c.line, 'backward' AS kind, least(c.line, 7) AS n FROM crit c UNION ALL SELECT id, line, 'forward', 4 FROM crit WHERE line % 2 = 0 UNION ALL SELECT id, 1, 'window', len(l) FROM ls WHERE id NOT IN (SELECT id FROM crit))"


def _slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = "IF(size(crit) = 0, array(named_struct('kind', 'window', 'n', cast(size(l) AS bigint))), concat(transform(crit, c -> named_struct('kind', 'backward', 'n', cast(least(c, 7) AS bigint))), transform(filter(crit, c -> c % 2 = 0), c -> named_struct('kind', 'forward', 'n', 4L))))"
    return sliced(spark, sf_dir).select("id", F.inline(F.expr(every)))


_HEALTH = {"window_rate": ("window_count", "total_slices", 30, 10, 10), "one_slice_rate": ("one_slice", "total_samples", 30, 15, 15), "truncated_rate": ("truncated", "total_slices", 10, None, 5)}


def _pct(d, a: str, b: str) -> str:
    """Hundredths of a percent, rounded half up, of integers."""
    return f"((20000 * {a} + greatest({b}, 1)) // (2 * greatest({b}, 1)))" if d.duck else f"((20000 * {a} + greatest({b}, 1)) div (2 * greatest({b}, 1)))"


def _health(d) -> dict[str, str]:
    rates = {n: _pct(d, a, b) for n, (a, b, *_) in _HEALTH.items()}
    over = lambda n, t: f"CASE WHEN 100 * {_HEALTH[n][0]} > {t} * greatest({_HEALTH[n][1]}, 1) THEN 1 ELSE 0 END"
    issues = " + ".join(over(n, mid if mid is not None else high) for n, (_, _, high, mid, _) in _HEALTH.items())
    recs = f"2 * {over('window_rate', 10)} + 2 * {over('one_slice_rate', 15)} + {over('truncated_rate', 5)}"
    return rates | {"n_issues": issues, "status": f"CASE {issues} WHEN 0 THEN 'GOOD' WHEN 1 THEN 'WARNING' ELSE 'NEEDS_ATTENTION' END", "n_recommendations": f"greatest({recs}, 1)"}


@_query(
    "a4_slice_statistics",
    f"{_SLICES_SQL}, s AS (SELECT id, count(*) AS k, count(*) FILTER (kind = 'backward') AS b, count(*) FILTER (kind = 'forward') AS f, count(*) FILTER (kind = 'window') AS w, count(*) FILTER (n = 0) AS e, count(*) FILTER (100 * n >= 95 * 16) AS t FROM every GROUP BY id), a AS (SELECT count(*) AS total_samples, sum(k)::BIGINT AS total_slices, sum(b)::BIGINT AS backward_count, sum(f)::BIGINT AS forward_count, sum(w)::BIGINT AS window_count, count(*) FILTER (k <= 1) AS one_slice, sum(t)::BIGINT AS truncated, sum(e)::BIGINT AS empty, sum(greatest(k - 2, 0))::BIGINT AS dropped FROM s) SELECT *, {_select(_health(DUCK))} FROM a",
)
def slice_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: kinds of slices, samples with one, truncated and dropped ones (16 lines and two slices at most here), rates and health."""
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    s = _slice_rows(spark, sf_dir).groupBy("id").agg(F.count("*").alias("k"), n("kind = 'backward'", "b"), n("kind = 'forward'", "f"), n("kind = 'window'", "w"), n("n = 0", "e"), n("100 * n >= 95 * 16", "t"))
    a = s.agg(F.count("*").alias("total_samples"), F.sum("k").alias("total_slices"), F.sum("b").alias("backward_count"), F.sum("f").alias("forward_count"), F.sum("w").alias("window_count"), n("k <= 1", "one_slice"), F.sum("t").alias("truncated"), F.sum("e").alias("empty"), F.sum(F.greatest(F.col("k") - 2, F.lit(0))).alias("dropped"))
    return a.select("*", *_exprs(_health(SPARK)))


# ---- token and sequence reports ------------------------------------------------------------------------------------------------


@_query("a9_token_counts", f"{token_plans.NORMAL} SELECT id, count(*) AS token_count, count(DISTINCT symbol) AS unique_tokens, count(DISTINCT symbol) FILTER (symbol LIKE 'VAR!_%' ESCAPE '!') AS n_vars, count(*) + 2 AS seq_length FROM normal GROUP BY id")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = token_plans.normalized(spark, sf_dir).where(F.size("symbols") > 0).withColumn("u", F.array_distinct("symbols"))
    return d.select("id", F.size("symbols").cast("long").alias("token_count"), F.size("u").cast("long").alias("unique_tokens"), F.size(F.filter("u", lambda s: s.startswith("VAR_"))).cast("long").alias("n_vars"), (F.size("symbols") + 2).cast("long").alias("seq_length"))


_CAP = 128
_LENGTHS = f"{token_plans.NORMAL}, k AS (SELECT split, id, count(*) + 2 AS n FROM normal GROUP BY split, id)"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_plans.normalized(spark, sf_dir).where(F.size("symbols") > 0).select("id", "split", (F.size("symbols") + 2).cast("long").alias("n"))


@_query("a10_encoded_stats", f"{_LENGTHS} SELECT split, count(*) AS n, min(least(n, {_CAP})) AS min_length, max(least(n, {_CAP})) AS max_length, sum(least(n, {_CAP}))::DOUBLE / count(*)::DOUBLE AS mean_length, median(least(n, {_CAP}))::DOUBLE AS median_length, count(*) FILTER (n >= {_CAP}) AS n_truncated, (count(*) FILTER (n >= {_CAP}))::DOUBLE / count(*)::DOUBLE AS truncated_ratio FROM k GROUP BY split")
def encoded_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.least("n", F.lit(_CAP))
    g = _lengths(spark, sf_dir).groupBy("split").agg(F.count("*").alias("c"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(n).alias("s"), F.percentile(n, 0.5).alias("median_length"), F.count_if(F.col("n") >= _CAP).alias("n_truncated"))
    return g.select("split", F.col("c").alias("n"), "min_length", "max_length", F.expr("cast(s AS double) / cast(c AS double)").alias("mean_length"), "median_length", "n_truncated", F.expr("cast(n_truncated AS double) / cast(c AS double)").alias("truncated_ratio"))


_PCT = (0.5, 0.9, 0.95, 0.99)


@_query("a11_length_profile", f"{_LENGTHS}, m AS (SELECT split, least(n, {_CAP}) AS n, n > {_CAP} AS cut FROM k) SELECT split, min(n) AS min_length, max(n) AS max_length, {', '.join(f'quantile_cont(n, {q})::DOUBLE AS p{round(100 * q)}' for q in _PCT)}, count(*) FILTER (cut) AS n_truncated, ({_CAP} * count(*) - sum(n))::DOUBLE / ({_CAP} * count(*))::DOUBLE AS pad_fraction FROM m GROUP BY split")
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.least("n", F.lit(_CAP))
    g = _lengths(spark, sf_dir).groupBy("split").agg(F.min(n).alias("min_length"), F.max(n).alias("max_length"), *[F.percentile(n, q).alias(f"p{round(100 * q)}") for q in _PCT], F.count_if(F.col("n") > _CAP).alias("n_truncated"), F.count("*").alias("c"), F.sum(n).alias("s"))
    return g.select("split", "min_length", "max_length", *[f"p{round(100 * q)}" for q in _PCT], "n_truncated", F.expr(f"cast({_CAP} * c - s AS double) / cast({_CAP} * c AS double)").alias("pad_fraction"))


@_query("a12_length_histogram", f"{_LENGTHS} SELECT split, least(least(n, {_CAP}) // {_CAP // 8}, 7) AS bin, count(*) AS n FROM k GROUP BY ALL")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight bins, the last closed on both sides."""
    return _lengths(spark, sf_dir).groupBy("split", F.expr(f"least(least(n, {_CAP}) div {_CAP // 8}, 7L)").alias("bin")).agg(F.count("*").alias("n"))


@_query("a12_padding_report", f"{token_plans._IDS}, c AS (SELECT id, i[1:{_CAP}] AS i FROM whole), e AS (SELECT id, list_concat(i, list_transform(range(0, {_CAP} - len(i)), lambda x: 0)) AS ids, list_concat(list_transform(i, lambda x: 1), list_transform(range(0, {_CAP} - len(i)), lambda x: 0)) AS mask FROM c), p AS (SELECT unnest(ids) AS t, unnest(mask) AS m FROM e) SELECT count(*) AS slots, count(*) FILTER (t = 0) AS pads, count(*) FILTER (t = 1) AS unknown, count(*) FILTER (t = 0 AND m = 1) AS masked_pads, count(*) FILTER (t <> 0 AND m = 0) AS unmasked, (count(*) FILTER (t = 0))::DOUBLE / count(*)::DOUBLE AS pad_ratio FROM p")
def padding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts within each array, summed: no row per slot."""
    from ..operators import vectors

    d = token_plans.ids_of(spark, sf_dir).withColumn("c", vectors.truncated("ids", _CAP)).select(vectors.padded("c", _CAP).alias("i"), vectors.mask("c", _CAP).alias("m"))
    n = lambda e: F.expr(f"sum(size(filter(arrays_zip(i, m), x -> {e})))")
    g = d.agg(n("true").alias("slots"), n("x.i = 0").alias("pads"), n("x.i = 1").alias("unknown"), n("x.i = 0 AND x.m = 1").alias("masked_pads"), n("x.i <> 0 AND x.m = 0").alias("unmasked"))
    return g.withColumn("pad_ratio", F.expr("cast(pads AS double) / cast(slots AS double)"))


@_query("a12_top_tokens", f"{token_plans.NORMAL} SELECT symbol AS token, count(*) AS freq FROM normal GROUP BY symbol ORDER BY freq DESC, token LIMIT 20")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent symbols."""
    return token_plans.counted(token_plans.normalized(spark, sf_dir)).orderBy(F.desc("freq"), "token").limit(20)


@_query("a12_slice_counts", f"{token_plans.NORMAL}, c AS (SELECT id, greatest(1, least(6, (count(*) + 29) // 30)) AS k FROM normal GROUP BY id) SELECT k::BIGINT AS slices, count(*) AS n FROM c GROUP BY k")
def slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = token_plans.normalized(spark, sf_dir).where(F.size("symbols") > 0).select(F.expr("cast(greatest(1, least(6, ceil(size(symbols) / 30))) AS bigint)").alias("slices"))
    return d.groupBy("slices").agg(F.count("*").alias("n"))


@_query("a14_overview", f"{_LENGTHS}, o AS (SELECT f.split, count(*) AS n, {_CAP} AS seq_length, count(*) FILTER (target) AS label_1, count(*) FILTER (NOT target) AS label_0 FROM functions f JOIN k ON f.id = k.id GROUP BY f.split) SELECT *, n * seq_length AS slots FROM o")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes and label counts of the encoded splits."""
    d = token_plans.normalized(spark, sf_dir).where(F.size("symbols") > 0).select("id", "split").join(corpus.synthetic(spark, sf_dir).select("id", "target"), "id")
    g = d.groupBy("split").agg(F.count("*").alias("n"), F.lit(_CAP).alias("seq_length"), F.count_if("target").alias("label_1"), F.count_if(~F.col("target")).alias("label_0"))
    return g.withColumn("slots", F.col("n") * F.col("seq_length"))


# ---- features --------------------------------------------------------------------------------------------------------------------

_LONG = f"{rule_plans._v_sql()}, w AS (SELECT id, {', '.join(f'{n}::DOUBLE AS {n}' for n in defences.NAMES)} FROM v), long AS (UNPIVOT w ON {', '.join(defences.NAMES)} INTO NAME feature VALUE x)"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, feature, x."""
    d = rule_plans.missing_defences(spark, sf_dir)
    return d.select("id", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in defences.NAMES])))


@_query("a13_feature_report", f"{_LONG} SELECT feature, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, min(x) AS min, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, max(x) AS max, count(*) FILTER (x <> 0) AS num_nonzero, count(*) FILTER (x = 0) AS num_zero FROM long GROUP BY feature")
def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _long(spark, sf_dir).groupBy("feature")
    return g.agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_pop("x"), 5).alias("std"), F.min("x").alias("min"), F.percentile("x", 0.25).alias("p25"), F.percentile("x", 0.5).alias("median"), F.percentile("x", 0.75).alias("p75"), F.max("x").alias("max"), F.count_if(F.col("x") != 0).alias("num_nonzero"), F.count_if(F.col("x") == 0).alias("num_zero"))


def _stats(rows: DataFrame, x: str) -> DataFrame:
    """feature, mean, std (1 where it is 0): 26 rows."""
    s = rows.groupBy("feature").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    return s.withColumn("std", F.when(F.col("std") < 1e-12, 1.0).otherwise(F.col("std")))


@_query("i2_z_scores", f"{_LONG}, s AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std FROM long GROUP BY feature) SELECT id, l.feature, round((x - mean) / CASE WHEN std < 1e-12 THEN 1 ELSE std END, 5) + 0.0 AS z FROM long l JOIN s ON l.feature = s.feature")
def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2 for all 26 features: their statistics, a table of 26 rows, are broadcast."""
    rows = _long(spark, sf_dir)
    return rows.join(F.broadcast(_stats(rows, "x")), "feature").select("id", "feature", (F.round((F.col("x") - F.col("mean")) / F.col("std"), 5) + F.lit(0.0)).alias("z"))


_T19 = "greatest(-10.0, least(10.0, sign(y) * ln(1 + abs(y))))"


@_query("a19_transformed", f"{_LONG}, n AS (SELECT id, feature, CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END AS y FROM long), t AS (SELECT id, feature, {_T19} AS x FROM n), s AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std FROM t GROUP BY feature) SELECT id, t.feature, round(greatest(-5.0, least(5.0, (x - mean) / CASE WHEN std < 1e-12 THEN 1 ELSE std END)), 5) + 0.0 AS z FROM t JOIN s ON t.feature = s.feature")
def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-a-number and infinity to 0, signed log, clipped, z-scored, clipped."""
    clean = F.when(F.isnan("x") | (F.abs("x") == F.lit(float("inf"))), 0.0).otherwise(F.col("x"))
    t = _long(spark, sf_dir).withColumn("y", clean).select("id", "feature", F.expr("greatest(-10D, least(10D, sign(y) * ln(1 + abs(y))))").alias("x"))
    z = (F.col("x") - F.col("mean")) / F.col("std")
    return t.join(F.broadcast(_stats(t, "x")), "feature").select("id", "feature", (F.round(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)), 5) + F.lit(0.0)).alias("z"))


_REL = ["loc", "dangerous_call_count", "pointer_deref_count", "array_access_count", "malloc_count", "null_check_count"]


def _steps_sql(source: str, text: str) -> str:
    first, *rest = defences.features(DUCK, text)
    sql, last = f"r0 AS (SELECT *, {_select(first)} FROM {source})", "r0"
    for k, step in enumerate(rest, 1):
        sql += f", r{k} AS (SELECT *, {_select(step)} FROM r{k - 1})"
        last = f"r{k}"
    return sql + f", rel AS (SELECT id, {', '.join(f'v_{n} AS {n}' for n in defences.NAMES)} FROM {last})"


@_query("v10_relative_features", f"{rule_plans._v_sql()}, rls AS (SELECT id, string_split(code, chr(10)) AS l FROM functions), rli AS (SELECT id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM rls), rc AS (SELECT id, line FROM rli WHERE {DUCK.has('text', _CRITERION)}), rw AS (SELECT DISTINCT c.id, l.line, l.text FROM rc c JOIN rli l ON c.id = l.id AND l.line BETWEEN c.line - {_K} AND c.line + {_K}), sl AS (SELECT id, string_agg(text, chr(10) ORDER BY line) AS part FROM rw WHERE regexp_matches(text, '\\S') GROUP BY id), {_steps_sql('sl', 'part')} SELECT v.id, {', '.join(f'rel.{n}::DOUBLE / greatest(v.{n}, 1)::DOUBLE AS {n}_rel_ratio' for n in _REL)} FROM v JOIN rel ON v.id = rel.id")
def relative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice's features over its function's, side by side in one row."""
    d = sliced(spark, sf_dir).withColumn("s", slices.extracted("kept", "l")).where(F.size("s") > 0).select("id", F.array_join("l", "\n").alias("code"), F.array_join("s", "\n").alias("part"))
    whole, part = d.select("id", "part", "code"), None
    for step in defences.features(SPARK):
        whole = whole.select("*", *_exprs(step))
    whole = whole.select("id", F.col("part").alias("code"), *[F.col(f"v_{n}").alias(f"w_{n}") for n in _REL])
    for step in defences.features(SPARK):
        whole = whole.select("*", *_exprs(step))
    return whole.select("id", *[(F.col(f"v_{n}").cast("double") / F.greatest(f"w_{n}", F.lit(1)).cast("double")).alias(f"{n}_rel_ratio") for n in _REL])


_V12 = {"window": "CASE WHEN loc < 20 THEN 10 WHEN loc < 60 THEN 15 ELSE 25 END", "max_depth": "CASE WHEN loc < 20 THEN 3 WHEN loc < 60 THEN 5 ELSE 8 END", "fold": "(id * 7919) % 5", "difficulty": "1 - (dangerous_call_without_check_ratio + pointer_deref_without_null_check_ratio + array_access_without_bounds_check_ratio) / 3"}


@_query("v12_sample_plan", f"{rule_plans._v_sql()} SELECT id, {_select({k: e for k, e in _V12.items() if k != 'difficulty'})}, round({_V12['difficulty']}, 6) AS difficulty, round(ln(1 + loc), 6) AS log_loc FROM v")
def sample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice settings by size, difficulty, out-of-fold numbers."""
    d = rule_plans.missing_defences(spark, sf_dir)
    return d.select("id", *_exprs({k: e for k, e in _V12.items() if k != "difficulty"}), F.expr(f"round({_V12['difficulty']}, 6)").alias("difficulty"), F.round(F.log1p("loc"), 6).alias("log_loc"))


@_query("v12_criterion_distance", f"{_CRIT_SQL} SELECT l.id, l.line, least(min(abs(l.line - c.line)), 20)::DOUBLE / 20::DOUBLE AS distance FROM lines l JOIN crit c ON l.id = c.id GROUP BY l.id, l.line")
def criterion_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sliced(spark, sf_dir).where(F.size("crit") > 0)
    each = F.expr("transform(l, (t, i) -> named_struct('line', cast(i + 1 AS bigint), 'd', array_min(transform(crit, c -> abs(c - i - 1)))))")
    return d.select("id", F.inline(each)).select("id", "line", F.expr("cast(least(d, 20) AS double) / 20D").alias("distance"))


# ---- summary records, filters, seeds ----------------------------------------------------------------------------------------------


@_query(
    "r8_summary",
    f"{rule_plans._RISK}, sl AS (SELECT id, string_split(code, chr(10)) AS l FROM functions), lines AS (SELECT id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM sl), hits AS ({rule_plans._hit_rows(DUCK)}), h AS (SELECT id, count(*) AS n_hits, array_to_string(list_sort(list_distinct(list(category))), ',') AS types FROM hits GROUP BY id), dc AS (SELECT id, count(*) AS n_calls FROM (SELECT id, unnest(regexp_extract_all(text, '{rules.CALL}', 1)) AS call FROM lines) WHERE {DUCK.among('call', rules.dangerous())} GROUP BY id) SELECT s.id, risk, risk_level, coalesce(n_hits, 0) AS n_hits, coalesce(types, '') AS types, coalesce(n_calls, 0) AS n_dangerous_calls, malloc_count, free_count FROM scored s LEFT JOIN h ON s.id = h.id LEFT JOIN dc ON s.id = dc.id",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for a function, all of it from its own row."""
    hits = " + ".join(f"size(filter(l, t -> {SPARK.has('t', p)}))" for _, p in rules.PATTERNS)
    of = lambda c: F.exists("l", lambda x: x.rlike("|".join(p for k, p in rules.PATTERNS if k == c)))
    types = F.sort_array(F.array_compact(F.array(*[F.when(of(c), F.lit(c)) for c in rules.CATEGORIES])))
    calls = F.expr(f"size(filter(flatten(transform(l, t -> {SPARK.all('t', rules.CALL, 1)})), f -> {SPARK.among('f', rules.dangerous())}))")
    d = corpus.synthetic(spark, sf_dir).select("id", "project", "target", F.split("code", "\n").alias("l"), *_exprs(rules.counts(SPARK)))
    d = d.withColumn("raw_tenths", F.expr(rules.raw_risk())).withColumn("risk", F.expr(rules.risk_thousandths("raw_tenths", SPARK)))
    return d.select("id", "risk", F.expr(rules.level("risk")).alias("risk_level"), F.expr(f"cast({hits} AS bigint)").alias("n_hits"), F.array_join(types, ",").alias("types"), calls.cast("long").alias("n_dangerous_calls"), "malloc_count", "free_count")


@_query("r9_lookups", " UNION ALL ".join(f"SELECT '{f}' AS call, true AS is_dangerous, '{','.join(c for c in rules.CATEGORIES if f in rules.FUNCTIONS[c])}' AS types" for f in rules.dangerous()) + " UNION ALL SELECT 'strlen', false, ''")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """is_dangerous and the types of a function name."""
    names = spark.createDataFrame([(f,) for f in [*rules.dangerous(), "strlen"]], "call string")
    table = spark.createDataFrame([(f, c, k) for k, c in enumerate(rules.CATEGORIES) for f in rules.FUNCTIONS[c]], "call string, category string, k int")
    held = table.groupBy("call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "category"))), lambda x: x["category"]), ",").alias("types"))
    return names.join(F.broadcast(held), "call", "left").select("call", F.col("types").isNotNull().alias("is_dangerous"), F.coalesce("types", F.lit("")).alias("types"))


@_query("f1_label_sample", f"WITH {corpus.CTE} SELECT id, project FROM functions WHERE target ORDER BY id LIMIT 10")
def label_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, K8: the first rows of a label."""
    return corpus.synthetic(spark, sf_dir).where("target").select("id", "project").orderBy("id").limit(10)


_SEEDS = {1: rf"\b(?:{'|'.join(heuristics.SINKS)})\s*\(", 2: r"\b(?:malloc|calloc|realloc|free)\s*\(", 3: r"[=(,;{}!&|<>+]\s*\*\s*[A-Za-z_]\w*|[A-Za-z_]\w*\s*\["}


@_query("k5_seed_lines", f"{LINES}, s AS ({' UNION ALL '.join(f'SELECT id, line, {k} AS priority FROM lines WHERE {DUCK.has(chr(116) + chr(101) + chr(120) + chr(116), p)}' for k, p in _SEEDS.items())}), d AS (SELECT id, line, min(priority) AS priority FROM s GROUP BY ALL) SELECT id, line, priority, row_number() OVER (PARTITION BY id ORDER BY priority, line) AS place FROM d QUALIFY place <= 6")
def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G18 by pattern, K5, K7, W7: lines by their best priority, up to six; ordered within the row's array."""
    prio = "CASE " + " ".join(f"WHEN {SPARK.has('t', p)} THEN {k}" for k, p in _SEEDS.items()) + " END"
    seeds = F.expr(f"slice(array_sort(filter(transform(l, (t, i) -> named_struct('priority', {prio}, 'line', cast(i + 1 AS bigint))), x -> x.priority IS NOT NULL)), 1, 6)")
    return line_arrays(spark, sf_dir).select("id", F.posexplode(seeds).alias("k", "x")).select("id", "x.line", "x.priority", (F.col("k") + 1).cast("long").alias("place"))


@_query("w5_statement_offsets", f"{LINES}, t AS (SELECT id, line, len(regexp_extract_all(text, '\\S+')) AS n FROM lines) SELECT id, line, n, coalesce(sum(n) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t")
def statement_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running offset of each line's tokens."""
    d = rule_plans.lines(spark, sf_dir).select("id", "line", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n"))
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))


# ---- the joins of definitions and uses ---------------------------------------------------------------------------------------------

_SEQ = lambda: token_plans.tokens.SERVING.replace("'", "''")
_ACCESS = f"""WITH {corpus.CTE}, sa AS (SELECT id, {heuristics.stripped(DUCK)} AS clean FROM functions), sl AS (SELECT id, unnest(range(1, len(string_split(clean, chr(10))) + 1)) AS line, unnest(string_split(clean, chr(10))) AS text FROM sa),
st AS (SELECT id, line, unnest(range(1, len(regexp_extract_all(text, '{_SEQ()}')) + 1)) AS k, unnest(regexp_extract_all(text, '{_SEQ()}')) AS token FROM sl), so AS (SELECT id, line, token, row_number() OVER (PARTITION BY id ORDER BY line, k) - 1 AS pos FROM st),
sn AS (SELECT *, lead(token) OVER (PARTITION BY id ORDER BY pos) AS next, lag(token) OVER (PARTITION BY id ORDER BY pos) AS before FROM so),
access AS (SELECT id, line, pos, token AS var, next = '=' AS is_def, before = '&' AS is_address, before = '*' AS is_deref FROM sn WHERE regexp_matches(token, '^[a-z]') AND NOT {DUCK.among('token', tokens.SERVING_KEYWORDS + tokens.SERVING_STDLIB)} AND coalesce(next, '') <> '(')"""


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, line, pos, var, is_def, is_address, is_deref of every name, from serving tokens with lines."""
    d = corpus.synthetic(spark, sf_dir).select("id", places.serving_lines(F.expr(heuristics.stripped(SPARK))).alias("t"))
    each = F.expr("transform(t, (x, i) -> named_struct('line', cast(x.line AS bigint), 'pos', cast(i AS bigint), 'var', x.token, 'next', get(t, i + 1).token, 'before', get(t, i - 1).token))")
    d = d.select("id", F.inline(each)).where(F.col("var").rlike("^[a-z]") & ~F.col("var").isin(tokens.SERVING_KEYWORDS + tokens.SERVING_STDLIB) & (F.coalesce("next", F.lit("")) != "("))
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    return d.select("id", "line", "pos", "var", is_("next", "=").alias("is_def"), is_("before", "&").alias("is_address"), is_("before", "*").alias("is_deref"))


@_query("j4_asof_definitions", f"{_ACCESS} SELECT u.id, u.var, u.pos AS use_pos, max(d.pos) AS def_pos FROM access u JOIN access d ON u.id = d.id AND u.var = d.var AND coalesce(d.is_def, false) AND d.line < u.line WHERE NOT coalesce(u.is_def, false) GROUP BY ALL")
def asof_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each use with the latest definition on a line before: a running maximum in a RANGE frame, no self-join."""
    w = Window.partitionBy("id", "var").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    d = accesses(spark, sf_dir).withColumn("def_pos", F.max(F.when(F.col("is_def"), F.col("pos"))).over(w))
    return d.where(~F.col("is_def") & F.col("def_pos").isNotNull()).select("id", "var", F.col("pos").alias("use_pos"), "def_pos")


@_query("j5_pointer_flow", f"{_ACCESS} SELECT a.id, a.var AS address_of, d.var AS dereferenced, count(*) AS n FROM access a JOIN access d ON a.id = d.id AND coalesce(a.is_address, false) AND coalesce(d.is_deref, false) AND d.line >= a.line GROUP BY ALL")
def pointer_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address taken meets every dereference from its line on, within a function."""
    a = accesses(spark, sf_dir)
    x = a.where("is_address").select("id", F.col("line").alias("la"), F.col("var").alias("address_of"))
    y = a.where("is_deref").select("id", F.col("line").alias("ld"), F.col("var").alias("dereferenced"))
    return x.join(y, "id").where("ld >= la").groupBy("id", "address_of", "dereferenced").agg(F.count("*").alias("n"))


@_query("j6_reaching_pairs", f"{_ACCESS} SELECT u.id, u.var, count(*) AS n_pairs FROM access u JOIN access d ON u.id = d.id AND u.var = d.var AND coalesce(d.is_def, false) AND d.line <= u.line WHERE NOT coalesce(u.is_def, false) GROUP BY ALL")
def reaching_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a definition and a use not before it: a running count of definitions instead of the pairs."""
    w = Window.partitionBy("id", "var").orderBy("line").rangeBetween(Window.unboundedPreceding, 0)
    d = accesses(spark, sf_dir).withColumn("n", F.count(F.when(F.col("is_def"), 1)).over(w)).where("NOT is_def AND n > 0")
    return d.groupBy("id", "var").agg(F.sum("n").alias("n_pairs"))


_BLOCK = r"^\s*(?:if|while|for|switch|do)\b.*\{\s*$"


@_query("j7_lines_in_blocks", f"{LINES}, op AS (SELECT id, line AS s, length(text) - length(ltrim(text, ' ')) AS depth FROM lines WHERE {DUCK.has('text', _BLOCK)}), cl AS (SELECT id, line AS e, length(text) - length(ltrim(text, ' ')) AS depth FROM lines WHERE regexp_matches(text, '^\\s*\\}}')), bl AS (SELECT o.id, s, min(e) AS e FROM op o JOIN cl c ON o.id = c.id AND o.depth = c.depth AND c.e > o.s GROUP BY ALL) SELECT l.id, l.line, count(*) AS n_blocks, max(s) AS innermost, arg_min(s, e - s) AS smallest FROM lines l JOIN bl b ON l.id = b.id AND l.line BETWEEN b.s AND b.e GROUP BY ALL")
def lines_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which braced blocks a line lies in, and the smallest of them, by interval predicates within the row."""
    d = line_arrays(spark, sf_dir)
    depth = "length(t) - length(ltrim(t))"
    opens = f"filter(transform(l, (t, i) -> named_struct('s', i + 1, 'depth', {depth}, 'ok', {SPARK.has('t', _BLOCK)})), x -> x.ok)"
    closes = f"filter(transform(l, (t, i) -> named_struct('e', i + 1, 'depth', {depth}, 'ok', t RLIKE '^[ \\\\t]*[}}]')), x -> x.ok)"
    d = d.withColumn("o", F.expr(opens)).withColumn("c", F.expr(closes))
    blocks = SPARK.once(["o", "c"], "filter(transform(o, x -> named_struct('s', x.s, 'e', array_min(transform(filter(c, y -> y.depth = x.depth AND y.e > x.s), y -> y.e)))), b -> b.e IS NOT NULL)")
    d = d.select("id", "l", F.expr(blocks).alias("b")).where(F.size("b") > 0)
    d = d.select("id", "b", F.explode(F.expr("sequence(1, size(l))")).alias("line")).withColumn("in", F.expr("filter(b, x -> line BETWEEN x.s AND x.e)")).where(F.size("in") > 0)
    return d.select("id", F.col("line").cast("long").alias("line"), F.size("in").cast("long").alias("n_blocks"), F.expr("cast(array_max(transform(in, x -> x.s)) AS bigint)").alias("innermost"), F.expr("cast(array_sort(transform(in, x -> named_struct('d', x.e - x.s, 's', x.s)))[0].s AS bigint)").alias("smallest"))


@_query("u4_concatenated_splits", f"WITH {corpus.CTE} SELECT split, count(*) AS n FROM functions GROUP BY split")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: the splits read one by one and put together again."""
    d = corpus.synthetic(spark, sf_dir).select("id", "split")
    out = d.where("split = 'train'")
    for s in ("validation", "test"):
        out = out.unionByName(d.where(F.col("split") == s))
    return out.groupBy("split").agg(F.count("*").alias("n"))
