"""Queries over tokens, normalized code, vocabulary and encoded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.dialect import DUCK, SPARK
from ..operators import heuristics, places, tokens, vectors
from ..sources import corpus

QUERIES, ORACLES = {}, {}
MIN_FREQ, MAX_VOCAB = 2, 30_000


def _query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# ---- whole tokens ---------------------------------------------------------------------------------------------------


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split, tokens: the texts of each function's tokens without comments, in order."""
    found = F.filter(F.regexp_extract_all("code", F.lit(f"({tokens.TOKEN})"), F.lit(1)), lambda t: ~t.rlike("^(//|/[*])"))
    return corpus.synthetic(spark, sf_dir).select("id", "split", "code", found.alias("tokens"))


_T = tokens.TOKEN.replace("'", "''")
TOKENS = f"WITH RECURSIVE {corpus.CTE}, ta AS (SELECT id, split, list_filter(regexp_extract_all(code, '{_T}'), lambda x: NOT regexp_matches(x, '^(//|/[*])')) AS t FROM functions), tb AS (SELECT id, split, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM ta), tokens AS (SELECT *, {tokens.kind(DUCK, 'token')} AS kind FROM tb)"


@_query("t2_tokens", f"{TOKENS} SELECT id, pos, token, kind FROM tokens")
def all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and kinds."""
    t = token_arrays(spark, sf_dir).select("id", F.posexplode("tokens").alias("pos", "token"))
    return t.select("id", F.col("pos").cast("long").alias("pos"), "token", F.expr(tokens.kind(SPARK, "token")).alias("kind"))


@_query(
    "t2_token_places",
    f"WITH {corpus.CTE}, a AS (SELECT id, code, string_split_regex(code, '{_T}') AS p, regexp_extract_all(code, '{_T}') AS t FROM functions), b AS (SELECT id, code, unnest(range(1, len(t) + 1)) AS k, unnest(t) AS text, unnest(p[:len(t)]) AS before FROM a), c AS (SELECT id, code, k, text, sum(length(before) + length(text)) OVER (PARTITION BY id ORDER BY k) - length(text) AS start FROM b), d AS (SELECT *, substr(code, 1, start::BIGINT) AS upto FROM c) SELECT id, text, (1 + length(upto) - length(replace(upto, chr(10), '')))::BIGINT AS line, (length(upto) - coalesce(length(regexp_extract(upto, '^((?:[^\\n]*\\n)*)', 1)), 0))::BIGINT AS col, start::BIGINT AS start, (start + length(text))::BIGINT AS \"end\" FROM d WHERE NOT regexp_matches(text, '^(//|/[*])')",
)
def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 with places: one Arrow pass, no shuffle."""
    d = corpus.synthetic(spark, sf_dir).select("id", F.explode(places.c_tokens("code")).alias("t"))
    return d.select("id", "t.text", *[F.col(f"t.{c}").cast("long").alias(c) for c in ("line", "col", "start", "end")])


@_query("t4_identifiers", f"{TOKENS} SELECT id, string_agg(token, ' ' ORDER BY pos) AS identifiers, count(*) AS n FROM tokens WHERE kind = 'identifier' GROUP BY id")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: tokens of one kind."""
    kept = F.filter("tokens", lambda t: t.rlike("^[a-zA-Z_]") & ~t.isin(tokens.KEYWORDS + tokens.TYPES))
    d = token_arrays(spark, sf_dir).select("id", kept.alias("k")).where(F.size("k") > 0)
    return d.select("id", F.array_join("k", " ").alias("identifiers"), F.size("k").cast("long").alias("n"))


_KINDS = ["keyword", "identifier", "type", "operator", "literal_num", "literal_str", "literal_char", "punct", "preproc"]


@_query(
    "t5_token_stats",
    f"{TOKENS}, s AS (SELECT id, count(*) AS n, count(DISTINCT token) AS n_unique, sum(length(token))::BIGINT AS chars, {', '.join(f'count(*) FILTER (kind = {chr(39)}{k}{chr(39)}) AS n_{k}' for k in _KINDS)} FROM tokens GROUP BY id) SELECT *, chars::DOUBLE / n::DOUBLE AS mean_length, n_literal_num + n_literal_str + n_literal_char AS literals FROM s",
)
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5, per function and without a shuffle: counts over its own array."""
    d = token_arrays(spark, sf_dir).where(F.size("tokens") > 0).withColumn("kinds", F.expr(f"transform(tokens, t -> {tokens.kind(SPARK, 't')})"))
    d = d.select("id", F.size("tokens").cast("long").alias("n"), F.size(F.array_distinct("tokens")).cast("long").alias("n_unique"), F.expr("aggregate(tokens, 0L, (a, t) -> a + length(t))").alias("chars"), *[F.expr(f"cast(size(filter(kinds, k -> k = '{k}')) AS bigint)").alias(f"n_{k}") for k in _KINDS])
    return d.withColumns({"mean_length": F.expr("cast(chars AS double) / cast(n AS double)"), "literals": F.expr("n_literal_num + n_literal_str + n_literal_char")})


@_query("t6_legacy_types", f"{TOKENS} SELECT CASE kind {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in tokens.LEGACY.items())} END AS type, count(*) AS n FROM tokens GROUP BY 1")
def legacy_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older interface's eight type names."""
    names = F.create_map(*[F.lit(x) for pair in tokens.LEGACY.items() for x in pair])
    return all_tokens(spark, sf_dir).groupBy(F.element_at(names, F.col("kind")).alias("type")).agg(F.count("*").alias("n"))


# ---- serving tokens and symbols -------------------------------------------------------------------------------------


def serving_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split, clean, tokens: comments stripped, literals by class."""
    d = corpus.synthetic(spark, sf_dir).select("id", "split", F.expr(heuristics.stripped(SPARK)).alias("clean"))
    return d.withColumn("tokens", F.transform(F.regexp_extract_all("clean", F.lit(f"({tokens.SERVING})"), F.lit(1)), _serving))


def _serving(t: Column) -> Column:
    return F.when(t.startswith('"'), "STR").when(t.startswith("'"), "CHAR").when(t.rlike("^[.]?[0-9]"), "NUM").otherwise(t)


_S = tokens.SERVING.replace("'", "''")
SERVING = f"WITH RECURSIVE {corpus.CTE}, sa AS (SELECT id, split, {heuristics.stripped(DUCK)} AS clean FROM functions), sb AS (SELECT id, split, unnest(range(0, len(regexp_extract_all(clean, '{_S}')))) AS pos, unnest(regexp_extract_all(clean, '{_S}')) AS raw FROM sa), serving AS (SELECT id, split, pos, {tokens.serving('raw', DUCK)} AS token FROM sb)"


@_query("t7_serving_tokens", f"{SERVING} SELECT id, string_agg(token, ' ' ORDER BY pos) AS tokens, count(*) AS n FROM serving GROUP BY id")
def serving_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = serving_arrays(spark, sf_dir).where(F.size("tokens") > 0)
    return d.select("id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n"))


@_query(
    "t7_serving_lines",
    f"WITH {corpus.CTE}, sa AS (SELECT id, {heuristics.stripped(DUCK)} AS clean FROM functions), sl AS (SELECT id, unnest(range(1, len(string_split(clean, chr(10))) + 1)) AS line, unnest(string_split(clean, chr(10))) AS text FROM sa), st AS (SELECT id, line, unnest(regexp_extract_all(text, '{_S}')) AS raw FROM sl) SELECT id, line, count(*) AS n, count(*) FILTER (regexp_matches(raw, '^[.]?[0-9]')) AS n_num FROM st GROUP BY id, line",
)
def tokens_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = serving_arrays(spark, sf_dir).select("id", F.explode(places.serving_lines("clean")).alias("t")).select("id", F.col("t.line").cast("long").alias("line"), "t.token")
    return d.groupBy("id", "line").agg(F.count("*").alias("n"), F.count_if(F.col("token") == "NUM").alias("n_num"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split, symbols: names numbered by first appearance, in one Arrow pass over each text."""
    d = corpus.synthetic(spark, sf_dir).select("id", "split", F.expr(heuristics.stripped(SPARK)).alias("clean"))
    return d.select("id", "split", places.serving_symbols("clean").alias("symbols"))


_NORMAL = f"""na AS (SELECT *, lead(token) OVER (PARTITION BY id ORDER BY pos) = '(' AS is_call, {DUCK.among('token', tokens.SERVING_KEYWORDS + tokens.SERVING_STDLIB + ['NUM', 'STR', 'CHAR'])} AS known FROM serving),
nb AS (SELECT *, CASE WHEN known OR NOT regexp_matches(token, '^[a-zA-Z_]') THEN NULL WHEN coalesce(is_call, false) THEN 'FUNC' ELSE 'VAR' END AS name_kind FROM na),
nc AS (SELECT *, min(pos) OVER (PARTITION BY id, name_kind, token) AS first FROM nb), nd AS (SELECT *, dense_rank() OVER (PARTITION BY id, name_kind ORDER BY first) AS rank FROM nc),
normal AS (SELECT id, split, pos, token, CASE WHEN name_kind IS NULL THEN token ELSE name_kind || '_' || cast(rank - 1 AS string) END AS symbol FROM nd)"""
NORMAL = f"{SERVING}, {_NORMAL}"


@_query("n2_normalized_code", f"{NORMAL} SELECT id, string_agg(symbol, ' ' ORDER BY pos) AS code, count(*) AS n FROM normal GROUP BY id")
def normalized_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = normalized(spark, sf_dir).where(F.size("symbols") > 0)
    return d.select("id", F.array_join("symbols", " ").alias("code"), F.size("symbols").cast("long").alias("n"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split, tokens, symbols of the typed normalizer."""
    d = corpus.synthetic(spark, sf_dir).select("id", "split", places.typed_symbols("code").alias("p"))
    return d.select("id", "split", F.transform("p", lambda x: x["token"]).alias("tokens"), F.transform("p", lambda x: x["symbol"]).alias("symbols"))


_TYPED = f"""{TOKENS}, ya AS (SELECT id, split, pos, token, lag(token) OVER w AS before, lead(token) OVER w AS next FROM tokens WINDOW w AS (PARTITION BY id ORDER BY pos)),
yb AS (SELECT *, CASE WHEN token LIKE '"%' THEN 'STR' WHEN starts_with(token, chr(39)) THEN 'CHAR' WHEN regexp_matches(token, '^0[xX]') THEN 'NUM' WHEN regexp_matches(token, '^[.]?[0-9]') AND (contains(token, '.') OR regexp_matches(token, '[fFlL]$')) THEN 'FLOAT' WHEN regexp_matches(token, '^[0-9]') THEN 'NUM' END AS literal,
  CASE WHEN NOT regexp_matches(token, '^[a-zA-Z_]') OR {DUCK.among('token', tokens.TYPED_KEYWORDS + tokens.TYPED_TYPES + tokens.TYPED_STDLIB)} THEN NULL WHEN next = '(' AND (before IS NULL OR before NOT IN ('.', '->')) THEN 'FUNC' ELSE 'VAR' END AS name_kind FROM ya),
yc AS (SELECT *, min(pos) OVER (PARTITION BY id, name_kind, token) AS first FROM yb), yd AS (SELECT *, dense_rank() OVER (PARTITION BY id, name_kind ORDER BY first) AS rank FROM yc),
typed AS (SELECT id, split, pos, token, coalesce(literal, CASE WHEN name_kind IS NOT NULL THEN name_kind || '_' || cast(rank - 1 AS string) END, token) AS symbol FROM yd)"""


@_query("n1_typed_code", f"{_TYPED} SELECT id, string_agg(symbol, ' ' ORDER BY pos) AS code, count(DISTINCT symbol) FILTER (symbol LIKE 'VAR!_%' ESCAPE '!') AS n_vars, count(DISTINCT symbol) FILTER (symbol LIKE 'FUNC!_%' ESCAPE '!') AS n_funcs FROM typed GROUP BY id")
def typed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = typed(spark, sf_dir).where(F.size("symbols") > 0)
    n = lambda p: F.size(F.array_distinct(F.filter("symbols", lambda s: s.startswith(p)))).cast("long")
    return d.select("id", F.array_join("symbols", " ").alias("code"), n("VAR_").alias("n_vars"), n("FUNC_").alias("n_funcs"))


@_query("n4_reverse_map", f"{_TYPED} SELECT DISTINCT id, symbol, token AS name FROM typed WHERE regexp_matches(symbol, '^(VAR|FUNC)_[0-9]+$')")
def reverse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which name each symbol of a function stands for."""
    pairs = F.array_distinct(F.filter(F.arrays_zip("symbols", "tokens"), lambda x: x["symbols"].rlike("^(VAR|FUNC)_[0-9]+$")))
    return typed(spark, sf_dir).select("id", F.inline(pairs)).select("id", F.col("symbols").alias("symbol"), F.col("tokens").alias("name"))


@_query("n4_continued_maps", f"{_TYPED}, q AS (SELECT id, split, count(DISTINCT symbol) FILTER (symbol LIKE 'VAR!_%' ESCAPE '!') AS vars, count(DISTINCT symbol) FILTER (symbol LIKE 'FUNC!_%' ESCAPE '!') AS funcs FROM typed GROUP BY id, split) SELECT split, max(vars) AS next_var, max(funcs) AS next_func FROM q GROUP BY split")
def continued_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters at which maps that go on would continue."""
    n = lambda p: F.size(F.array_distinct(F.filter("symbols", lambda s: s.startswith(p)))).cast("long")
    return typed(spark, sf_dir).where(F.size("symbols") > 0).groupBy("split").agg(F.max(n("VAR_")).alias("next_var"), F.max(n("FUNC_")).alias("next_func"))


# The "dataset's" normalized code: symbols of the serving normalizer, shifted by ten, over the same tokens.
_SHIFT = "CASE WHEN regexp_matches(symbol, '^(VAR|FUNC)_') THEN regexp_extract(symbol, '^(VAR|FUNC)_', 1) || '_' || (regexp_extract(symbol, '_([0-9]+)$', 1)::INT + 10 + id % 3)::VARCHAR ELSE symbol END"


def _shifted() -> Column:
    return F.expr("transform(symbols, s -> IF(s RLIKE '^(VAR|FUNC)_[0-9]+$', concat(regexp_extract(s, '^(VAR|FUNC)_', 1), '_', cast(cast(regexp_extract(s, '_([0-9]+)$', 1) AS int) + 10 + id % 3 AS string)), s))")


@_query(
    "n5_aligned",
    f"{_TYPED}, ds AS (SELECT id, pos, symbol, {_SHIFT} AS theirs FROM typed), mp AS (SELECT id, symbol, max_by(theirs, pos) AS theirs FROM ds WHERE split_part(symbol, '_', 1) IN ('VAR', 'FUNC') AND split_part(symbol, '_', 1) = split_part(theirs, '_', 1) AND contains(symbol, '_') GROUP BY id, symbol) SELECT d.id, string_agg(coalesce(m.theirs, d.symbol), ' ' ORDER BY pos) AS code FROM ds d LEFT JOIN mp m ON d.id = m.id AND d.symbol = m.symbol GROUP BY d.id",
)
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our symbols renamed to the dataset's by position, the last pairing counting; streams of unequal length stay."""
    d = typed(spark, sf_dir).where(F.size("symbols") > 0).withColumn("theirs", _shifted())
    d = d.withColumn("pairs", F.expr("filter(reverse(arrays_zip(symbols, theirs)), x -> (x.symbols LIKE 'VAR\\\\_%' AND x.theirs LIKE 'VAR\\\\_%') OR (x.symbols LIKE 'FUNC\\\\_%' AND x.theirs LIKE 'FUNC\\\\_%'))"))
    d = d.withColumn("ours", F.expr("transform(pairs, x -> x.symbols)"))
    renamed = SPARK.once(["pairs", "ours"], "transform(symbols, s -> IF(array_contains(ours, s), pairs[cast(array_position(ours, s) AS int) - 1].theirs, s))")
    return d.select("id", F.expr(f"array_join(IF(size(symbols) = size(theirs), {renamed}, symbols), ' ')").alias("code"))


@_query(
    "n6_learned_maps",
    f"{_TYPED}, ds AS (SELECT id, pos, token, {_SHIFT} AS theirs FROM typed), mp AS (SELECT id, regexp_extract(theirs, '^(VAR|FUNC)_', 1) AS kind, token AS name, min_by(theirs, pos) AS symbol FROM ds WHERE regexp_matches(theirs, '^(VAR|FUNC)_') GROUP BY ALL) SELECT id, kind, name, symbol, max(regexp_extract(symbol, '_([0-9]+)$', 1)::BIGINT) OVER (PARTITION BY id, kind) + 1 AS counter FROM mp",
)
def learned_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps learnt by zipping names with the dataset's symbols; the first pairing of a name counts."""
    return corpus.dealt(spark, sf_dir).select("id", F.inline(places.learned_maps("code", F.expr("10 + id % 3"))))


# ---- vocabulary ------------------------------------------------------------------------------------------------------

_VOCAB = f"{NORMAL}, vc AS (SELECT symbol, count(*) AS freq FROM normal WHERE split = 'train' GROUP BY symbol HAVING count(*) >= {MIN_FREQ}), vocab AS (SELECT symbol AS token, freq, row_number() OVER (ORDER BY freq DESC, symbol) + 3 AS token_id FROM vc QUALIFY token_id < {MAX_VOCAB})"


def counted(symbols: DataFrame) -> DataFrame:
    """token, freq of arrays `symbols`."""
    return symbols.select(F.explode("symbols").alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The `most` tokens of highest (freq, then token). A histogram of frequencies gives the least frequency that can be among them,
    so that only about `most` rows are ordered at all."""
    by_freq = counts.groupBy("freq").agg(F.count("*").alias("n"))  # as many rows as there are different frequencies
    cut = by_freq.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)))
    least = cut.where(F.coalesce("above", F.lit(0)) < most).agg(F.min("freq").alias("least"))
    return counts.join(F.broadcast(least), F.col("freq") >= F.col("least")).drop("least").orderBy(F.desc("freq"), "token").limit(most)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, freq, token_id: the most frequent symbols; ids follow the specials. The cap, a feature, bounds the final window."""
    c = counted(normalized(spark, sf_dir).where("split = 'train'")).where(F.col("freq") >= MIN_FREQ)
    top = most_frequent(c, MAX_VOCAB - len(tokens.SPECIALS))
    return top.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("freq"), "token")).cast("long") + 3)


_query("a5_vocabulary", f"{_VOCAB} SELECT * FROM vocab")(vocabulary)


@_query("a6_vocabulary_stats", f"{_VOCAB} SELECT count(*) AS n_tokens, sum(freq)::BIGINT AS total, max(freq) AS max_freq, min(freq) AS min_freq, (SELECT string_agg(token, ' ' ORDER BY token_id) FROM vocab WHERE token_id < 14) AS most_common FROM vocab")
def vocabulary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir)
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("token_id") < 14, F.struct("token_id", "token")))), lambda x: x["token"]), " ")
    return v.agg(F.count("*").alias("n_tokens"), F.sum("freq").alias("total"), F.max("freq").alias("max_freq"), F.min("freq").alias("min_freq"), top.alias("most_common"))


@_query("a6_merged_vocabulary", f"{NORMAL}, c AS (SELECT split, symbol, count(*) AS freq FROM normal GROUP BY ALL), k AS (SELECT * FROM c WHERE freq >= {MIN_FREQ}) SELECT symbol AS token, sum(freq)::BIGINT AS freq, count(*) AS n_vocabularies FROM k GROUP BY symbol")
def merged_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabularies of the splits merged, frequencies summed."""
    per = normalized(spark, sf_dir).select("split", F.explode("symbols").alias("token")).groupBy("split", "token").agg(F.count("*").alias("freq")).where(F.col("freq") >= MIN_FREQ)
    return per.groupBy("token").agg(F.sum("freq").alias("freq"), F.count("*").alias("n_vocabularies"))


@_query("a6_oov_rate", f"{_VOCAB} SELECT n.split, count(*) AS n, count(*) FILTER (v.token IS NULL) AS n_missing, count(*) FILTER (v.token IS NULL)::DOUBLE / count(*)::DOUBLE AS oov_rate FROM normal n LEFT JOIN vocab v ON n.symbol = v.token GROUP BY n.split")
def oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by token come first, so that the join has a row for each token of a split."""
    per = normalized(spark, sf_dir).select("split", F.explode("symbols").alias("token")).groupBy("split", "token").agg(F.count("*").alias("c"))
    j = per.join(vocabulary(spark, sf_dir).select("token", "token_id"), "token", "left")
    g = j.groupBy("split").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("token_id").isNull(), F.col("c"))), F.lit(0)).alias("n_missing"))
    return g.withColumn("oov_rate", F.expr("cast(n_missing AS double) / cast(n AS double)"))


@_query("a15_prune_stats", f"{NORMAL}, c AS (SELECT symbol, count(*) AS freq FROM normal WHERE split = 'train' GROUP BY symbol) SELECT count(*) AS n_before, count(*) FILTER (freq >= {MIN_FREQ}) AS n_after, count(*) FILTER (freq < {MIN_FREQ}) AS n_removed, max_by(symbol, freq) AS most_frequent FROM c")
def prune_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counted(normalized(spark, sf_dir).where("split = 'train'"))
    return c.agg(F.count("*").alias("n_before"), F.count_if(F.col("freq") >= MIN_FREQ).alias("n_after"), F.count_if(F.col("freq") < MIN_FREQ).alias("n_removed"), F.max_by("token", "freq").alias("most_frequent"))


# ---- encoded sequences ---------------------------------------------------------------------------------------------------

MAX_LENGTH = 512
_IDS = f"{_VOCAB}, ids AS (SELECT n.id, list(coalesce(v.token_id, 1) ORDER BY n.pos) AS t, count(*) FILTER (v.token_id IS NULL) AS n_unk FROM normal n LEFT JOIN vocab v ON n.symbol = v.token GROUP BY n.id), whole AS (SELECT id, n_unk, list_concat(list_concat([2], t), [3]) AS i FROM ids)"


def _cut_sql(how: str, n: int) -> str:
    return {"tail": f"i[1:{n}]", "head": f"i[greatest(len(i) - {n}, 0) + 1:]", "center": f"CASE WHEN len(i) <= {n} THEN i ELSE list_concat(i[1:{n // 2 + n % 2}], i[len(i) - {n // 2} + 1:]) END"}[how]


def ids_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split, ids (with begin and end), n_unk: each function's array is looked up in one Arrow pass.

    The vocabulary, MAX_VOCAB rows at most, goes to the workers as a dictionary; nothing is shuffled by function.
    """
    table = {r.token: r.token_id for r in vocabulary(spark, sf_dir).select("token", "token_id").collect()}
    look = vectors.lookup(table)
    d = normalized(spark, sf_dir).where(F.size("symbols") > 0).select("id", "split", look("symbols").alias("t"))
    whole = F.concat(F.array(F.lit(2).cast("long")), "t", F.array(F.lit(3).cast("long")))
    return d.select("id", "split", whole.alias("ids"), F.size(F.filter("t", lambda x: x == 1)).cast("long").alias("n_unk"))


def _encoded(name: str, how: str, side: str, n: int) -> None:
    pad = f"list_transform(range(0, {n} - len(c)), lambda x: 0)"
    out, mask = ("list_concat(c, pad)", "list_concat(list_transform(c, lambda x: 1), pad)") if side == "right" else ("list_concat(pad, c)", "list_concat(pad, list_transform(c, lambda x: 1))")

    @_query(name, f"{_IDS}, cut AS (SELECT *, {_cut_sql(how, n)} AS c FROM whole), padded AS (SELECT *, {pad} AS pad FROM cut) SELECT id, n_unk, len(i) > {n} AS truncated, len(c)::BIGINT AS length, array_to_string({out}, ' ') AS input_ids, array_to_string({mask}, ' ') AS attention_mask FROM padded")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = ids_of(spark, sf_dir).withColumn("c", vectors.truncated("ids", n, how))
        text = lambda a: F.array_join(a.cast("array<string>"), " ")
        return d.select("id", "n_unk", (F.size("ids") > n).alias("truncated"), F.size("c").cast("long").alias("length"), text(vectors.padded("c", n, side)).alias("input_ids"), text(vectors.mask("c", n, side)).alias("attention_mask"))


_encoded("e1_encoded", "tail", "right", MAX_LENGTH)
_encoded("e2_truncated_head", "head", "right", 48)
_encoded("e2_truncated_center", "center", "right", 49)
_encoded("e3_padded_left", "tail", "left", 64)


@_query("e4_decoded", f"{_IDS}, ex AS (SELECT id, unnest(range(1, len(i) + 1)) AS pos, unnest(i) AS token_id FROM whole) SELECT e.id, string_agg(CASE WHEN e.token_id = 1 THEN '<UNK>' ELSE v.token END, ' ' ORDER BY e.pos) AS tokens FROM ex e LEFT JOIN vocab v ON e.token_id = v.token_id WHERE e.token_id NOT IN (0, 2, 3) GROUP BY e.id")
def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids back to tokens, begin, end and padding left out, unknown and out of range as <UNK>."""
    names = {r.token_id: r.token for r in vocabulary(spark, sf_dir).select("token", "token_id").collect()}  # MAX_VOCAB rows at most
    return ids_of(spark, sf_dir).select("id", F.array_join(vectors.names_of(names)("ids"), " ").alias("tokens"))


_EVEN, _SLICES = 32, 6


@_query(
    "e6_packed_slices",
    f"{_VOCAB}, ids AS (SELECT n.id, list(coalesce(v.token_id, 1) ORDER BY n.pos) AS t FROM normal n LEFT JOIN vocab v ON n.symbol = v.token GROUP BY n.id), ex AS (SELECT id, t, unnest(range(0, least({_SLICES}, (len(t) + {_EVEN - 3}) // {_EVEN - 2})::BIGINT)) AS slice FROM ids) SELECT id, slice, (len(t[slice * {_EVEN - 2} + 1:(slice + 1) * {_EVEN - 2}]) + 2)::BIGINT AS length, array_to_string(list_concat(list_concat([2], t[slice * {_EVEN - 2} + 1:(slice + 1) * {_EVEN - 2}]), [3]), ' ') AS ids, greatest(1, least({_SLICES}, (len(t) + {_EVEN - 3}) // {_EVEN - 2}))::BIGINT AS slice_count FROM ex",
)
def packed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pieces of a function as slices with begin and end, up to a number of slices."""
    d = ids_of(spark, sf_dir).withColumn("t", F.expr("slice(ids, 2, size(ids) - 2)"))
    n = f"least({_SLICES}, cast(ceil(size(t) / {_EVEN - 2}) AS int))"
    pieces = F.expr(f"transform(sequence(0, greatest({n}, 1) - 1), s -> slice(t, s * {_EVEN - 2} + 1, {_EVEN - 2}))")
    d = d.select("id", F.posexplode(pieces).alias("slice", "p"), F.expr(f"cast(greatest(1, {n}) AS bigint)").alias("slice_count"))
    whole = F.concat(F.array(F.lit(2).cast("long")), "p", F.array(F.lit(3).cast("long")))
    return d.select("id", F.col("slice").cast("long").alias("slice"), F.size(whole).cast("long").alias("length"), F.array_join(whole.cast("array<string>"), " ").alias("ids"), "slice_count")


@_query(
    "e12_slice_masks",
    f"{_VOCAB}, c AS (SELECT id, least({_SLICES}, (count(*) + {_EVEN - 3}) // {_EVEN - 2}) AS k, count(*) AS n FROM normal GROUP BY id) SELECT id, array_to_string(list_transform(range(0, {_SLICES}), lambda x: CASE WHEN x < k THEN 1 ELSE 0 END), '') AS slice_mask, least(n + 2, {MAX_LENGTH})::BIGINT AS length FROM c",
)
def slice_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks made again from slice counts, lengths clamped."""
    d = normalized(spark, sf_dir).where(F.size("symbols") > 0).select("id", F.size("symbols").alias("n"))
    k = f"least({_SLICES}, cast(ceil(n / {_EVEN - 2}) AS int))"
    return d.select("id", F.expr(f"array_join(transform(sequence(0, {_SLICES - 1}), x -> IF(x < {k}, '1', '0')), '')").alias("slice_mask"), F.expr(f"cast(greatest(1, least(n + 2, {MAX_LENGTH})) AS bigint)").alias("length"))


@_query(
    "e13_augmented",
    f"{NORMAL}, v AS (SELECT n.*, c FROM normal n JOIN functions f ON n.id = f.id, (SELECT unnest([0, 1, 2]) AS c) WHERE f.target AND n.split = 'train'), d AS (SELECT id, c, pos, symbol, c = 1 AND (id * 31 + pos * 17) % 100 < 7 AS dropped, CASE WHEN c = 2 AND regexp_matches(symbol, '^VAR_') THEN 'VAR_' || (regexp_extract(symbol, '_([0-9]+)$', 1)::INT + 1 + id % 5)::VARCHAR ELSE symbol END AS s FROM v) SELECT id, c::BIGINT AS copy, string_agg(s, ' ' ORDER BY pos) AS code FROM d WHERE NOT dropped GROUP BY id, c",
)
def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vulnerable rows three times: as they are, with a keyed token dropout, with names numbered anew."""
    target = corpus.synthetic(spark, sf_dir).where("target AND split = 'train'").select("id")
    d = normalized(spark, sf_dir).where((F.col("split") == "train") & (F.size("symbols") > 0)).join(target, "id", "left_semi")
    drop = "filter(symbols, (s, i) -> (id * 31 + i * 17) % 100 >= 7)"
    names = "transform(symbols, s -> IF(s LIKE 'VAR\\\\_%', concat('VAR_', cast(cast(regexp_extract(s, '_([0-9]+)$', 1) AS int) + 1 + id % 5 AS string)), s))"
    return d.select("id", F.posexplode(F.expr(f"array(symbols, {drop}, {names})")).alias("copy", "s")).where(F.size("s") > 0).select("id", F.col("copy").cast("long").alias("copy"), F.array_join("s", " ").alias("code"))
