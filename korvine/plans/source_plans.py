"""Queries that write and read back: shards by split, JSON lines, chunks, vocabularies, vectors, files scanned for findings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.dialect import DUCK
from ..operators import rules
from ..sources import corpus
from . import rule_plans, token_plans

QUERIES, ORACLES = {}, {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{corpus.scratch(spark)}/{name}-{uuid.uuid4().hex}"


@_query("s1_shards", f"WITH {corpus.CTE} SELECT split, count(*) AS n, sum(id)::BIGINT AS ids FROM functions GROUP BY split")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards named after splits, read back split by split with the columns asked for."""
    path = _folder(spark, "shards")
    corpus.write_shards(corpus.synthetic(spark, sf_dir).select("id", "func", "target", "project", "split"), path)
    out = corpus.read_functions(spark, path, "train", ["id", "split"])
    for s in ("val", "test"):
        out = out.unionByName(corpus.read_functions(spark, path, s, ["id", "split"]))
    return out.groupBy("split").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@_query("s3_chunks", f"WITH {corpus.CTE}, r AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 64 AS chunk FROM functions) SELECT chunk, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM r GROUP BY chunk")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: rows in blocks of exactly 64, the last one partial. Ranks are counts of ranges of ids plus a rank within the range."""
    d = corpus.synthetic(spark, sf_dir).select("id").withColumn("range", F.expr("id div 4096"))
    sums = d.groupBy("range").agg(F.count("*").alias("c"))
    before = sums.select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("before"))  # a row for each 4096 ids
    r = d.withColumn("local", F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1).join(before, "range")
    return r.groupBy(F.expr("(before + local) div 64").alias("chunk")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@_query("s4_typed_records", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS func, p_partkey % 3 = 0 AS target, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS project, CASE WHEN p_partkey % 2 = 0 THEN [p_size, 2]::INT[] ELSE []::INT[] END AS label FROM part")
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose rows (text numbers, missing values, JSON lists) with the types and defaults of a function table."""
    loose = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("cast(p_partkey AS string) AS id", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS func", "CASE WHEN p_partkey % 3 = 0 THEN '1' WHEN p_partkey % 7 = 0 THEN NULL ELSE '0' END AS target", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS project", "CASE WHEN p_partkey % 2 = 0 THEN concat('[', p_size, ', 2]') WHEN p_partkey % 11 = 0 THEN 'not json' END AS label")
    return corpus.coerced(loose).select("id", "func", "target", "project", F.coalesce(F.from_json("label", "array<int>"), F.array().cast("array<int>")).alias("label"))


@_query("s6_json_lines", f"WITH {corpus.CTE} SELECT split, count(*) AS n, count(*) FILTER (target) AS n_target, sum(length(coalesce(func, '')))::BIGINT AS chars FROM functions GROUP BY split")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written and read, filtered by split."""
    path = _folder(spark, "jsonl")
    corpus.write_jsonl(corpus.synthetic(spark, sf_dir), path, ["id", "func", "target", "project"])
    back = corpus.read_jsonl(spark, path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.count_if("target").alias("n_target"), F.sum(F.length(F.coalesce("func", F.lit("")))).alias("chars"))


@_query("s8_chunk_files", f"WITH {corpus.CTE}, c AS (SELECT split, count(*) AS n, sum(id)::BIGINT AS ids FROM functions GROUP BY split) SELECT 'parquet' AS format, * FROM c UNION ALL SELECT 'csv', * FROM c")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet and CSV chunks in a folder for each split."""
    d, out = corpus.synthetic(spark, sf_dir).select("id", "target", "project", "split"), []
    for kind in ("parquet", "csv"):
        path = _folder(spark, kind)
        corpus.write_chunks(d, path, kind)
        back = corpus.read_chunks(spark, path, kind, "id long, target boolean, project string, split string")
        out.append(back.groupBy("split").agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(kind).alias("format"), "split", "n", "ids"))
    return out[0].unionByName(out[1])


@_query("s13_export_stats", f"{token_plans.NORMAL}, k AS (SELECT f.id, f.split, f.target, count(*) AS n FROM normal n JOIN functions f ON n.id = f.id GROUP BY ALL) SELECT split, count(*) AS samples, count(*) FILTER (target) AS vulnerable, sum(n)::BIGINT AS tokens, max(n) AS max_tokens FROM k GROUP BY split")
def export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions exported with their tokens as JSON lines, and the statistics of what was written."""
    t = token_plans.normalized(spark, sf_dir).where(F.size("symbols") > 0).join(corpus.synthetic(spark, sf_dir).select("id", "target"), "id")
    path = _folder(spark, "export")
    corpus.write_jsonl(t.withColumnRenamed("symbols", "tokens"), path, ["id", "target", "tokens"])
    back = corpus.read_jsonl(spark, path, schema="id long, target boolean, tokens array<string>, split string")
    return back.groupBy("split").agg(F.count("*").alias("samples"), F.count_if("target").alias("vulnerable"), F.sum(F.size("tokens")).alias("tokens"), F.max(F.size("tokens")).cast("long").alias("max_tokens"))


@_query("s15_saved_vocabulary", f"{token_plans._VOCAB} SELECT token, token_id, freq FROM vocab")
def saved_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary saved as a table and loaded."""
    path = _folder(spark, "vocabulary")
    token_plans.vocabulary(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path).select("token", "token_id", "freq")


@_query("s16_saved_vectors", f"{token_plans._IDS} SELECT id, len(i)::BIGINT AS length, 512 AS max_length FROM whole")
def saved_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors saved as Parquet; their settings travel in the column's metadata."""
    path = _folder(spark, "vectors")
    d = token_plans.ids_of(spark, sf_dir).select("id", "ids")
    d.withMetadata("ids", {"config": {"max_length": token_plans.MAX_LENGTH}}).write.parquet(path)
    back = spark.read.parquet(path)
    most = back.schema["ids"].metadata["config"]["max_length"]
    return back.select("id", F.size("ids").cast("long").alias("length"), F.lit(most).alias("max_length"))


_YAML = "\n".join(["memory:", "  description: memory handling", "  severity: high", "  dangerous_functions:", "    - strcpy", "    - gets", "  patterns:", "    - 'strcpy\\s*\\('", "    - '(unclosed'", "formats:", "  description: format strings", "  severity: medium", "  dangerous_functions: [printf]", "  patterns:", "    - 'printf\\s*\\('"])


@_query("s18_pattern_tables", f"WITH {corpus.CTE}, p AS (SELECT * FROM (VALUES ('memory', 'high', 'strcpy\\s*\\('), ('formats', 'medium', 'printf\\s*\\(')) t(category, severity, regex)) SELECT category, severity, count(*) AS n_functions, sum(len(regexp_extract_all(code, regex)))::BIGINT AS n_hits FROM functions, p WHERE regexp_matches(code, regex) GROUP BY ALL")
def pattern_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories, functions and patterns from YAML as tables; patterns that do not compile are left out."""
    patterns, _ = corpus.read_patterns(spark, _YAML)
    d = corpus.synthetic(spark, sf_dir).select("id", "code").crossJoin(F.broadcast(patterns))  # as many patterns as the file has
    d = d.withColumn("n", F.expr("regexp_count(code, regex)")).where("n > 0")
    return d.groupBy("category", "severity").agg(F.count("*").alias("n_functions"), F.sum("n").alias("n_hits"))


@_query("s21_annotations", f"{rule_plans.LINES}, h AS (SELECT * FROM ({rule_plans._hit_rows(DUCK)})) SELECT '::' || CASE category {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {chr(39)}{dict(high=chr(101) + chr(114) + chr(114) + chr(111) + chr(114)).get(s, chr(119) + chr(97) + chr(114) + chr(110) + chr(105) + chr(110) + chr(103))}{chr(39)}' for c, s in rules.SEVERITY.items())} END || ' file=fn_' || id || '.c,line=' || line || '::' || category AS annotation FROM h")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as annotations of files."""
    level = F.create_map(*[F.lit(x) for c, s in rules.SEVERITY.items() for x in (c, "error" if s == "high" else "warning")])
    h = rule_plans.detect(spark, sf_dir)
    return h.select(F.concat(F.lit("::"), F.element_at(level, F.col("category")), F.lit(" file=fn_"), "id", F.lit(".c,line="), "line", F.lit("::"), "category").alias("annotation"))


_VUL = {0: "concat('{\"line_no\": [', id % 7 + 1, ', ', id % 5 + 9, '], \"code\": [\"a\", \"b\"]}')", 1: "concat('[', id % 7 + 1, ', ', id % 5 + 9, ']')", 2: "concat('{\"', id % 7 + 1, '\": \"x;\", \"', id % 5 + 9, '\": \"y[3];\"}')"}


@_query("x5_vulnerable_lines", f"WITH {corpus.CTE} SELECT id, CASE WHEN id % 4 = 3 THEN []::INT[] ELSE [id % 7 + 1, id % 5 + 9]::INT[] END AS lines FROM functions")
def vulnerable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers from JSON objects, lists and maps, and none."""
    d = corpus.synthetic(spark, sf_dir).select("id", F.expr("CASE " + " ".join(f"WHEN id % 4 = {k} THEN {e}" for k, e in _VUL.items()) + " END").alias("vul_lines"))
    return d.select("id", corpus.vulnerable_lines("vul_lines").alias("lines"))
