"""Function tables: readers, ingest coercions, and a synthetic corpus of C functions made of relational rows.

A function table has id, func, target, project, split. Both engines make the synthetic corpus by the same expressions.
"""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPLITS = {"train": "train-*", "validation": "validation-*", "test": "test-*"}
ALIASES = {"val": "validation", "valid": "validation"}

_NL = "chr(10)"
_Q = "chr(39)"


def _code(*lines: str) -> str:
    """SQL for lines of fixed text; quotes within become chr(39)."""
    return f" || {_NL} || ".join("'" + x.replace("'", f"' || {_Q} || '") + "'" for x in lines)


_LINES = [
    ("p_partkey % 41 = 0", _code("#include <vector>")),
    ("p_partkey % 39 = 0", _code("#include <stdio.h>", "#define LIMIT 10")),
    ("", "'int fn_' || cast(p_partkey AS string) || '(char *src, int n) {'"),
    ("", "'    char buf[' || cast(p_size AS string) || '];'"),
    ("p_partkey % 3 = 0", _code("    if (src == NULL) {", "        return -1;", "    }")),
    ("p_partkey % 2 = 0", _code("    strcpy(buf, src);")),
    ("p_partkey % 2 = 1", _code("    strncpy(buf, src, sizeof(buf));")),
    ("p_size % 5 = 0", _code("    char *q = malloc(n);", "    q[n] = 0;")),
    ("p_size % 7 = 0", _code("    char *copy = (char *)malloc(n);")),
    ("p_size % 21 = 0", _code("    if (copy == NULL) return 1;")),
    ("p_partkey % 14 = 0", _code("    struct node *head = calloc(1, n);", "    if (!head) return 0;")),
    ("p_partkey % 28 = 0", _code("    if (*head == NULL) head->next = head->data[n];")),
    ("p_partkey % 17 = 0", _code("    fread(buf, 1, n, fp); fgets(line, n, fp);", "    strcat(buf, line); strcpy(line, buf);")),
    ("p_partkey % 19 = 0", _code("    gets(buf);")),
    ("p_size % 10 = 0", _code("    free(q);")),
    ("p_size % 10 = 0 AND p_partkey % 7 = 0", _code("    q->len = 0;")),
    ("p_size % 15 = 0", _code("    free(q);")),
    ("p_partkey % 21 = 0", _code("    free(p);", "    p = realloc(p, 4);", "    free(p);", "    p = NULL;")),
    ("p_partkey % 22 = 0", _code("    free(node);", "    log_msg(1);", "    free(node);")),
    ("p_partkey % 34 = 0", _code("    free(out);", "    return out;")),
    ("p_partkey % 4 = 0", _code("    for (int i = 0; i < n; i++) {", "        buf[i] = src[i]; // copy", "    }")),
    ("p_partkey % 11 = 0", _code("    while (n > 0) {", "        n = n - 1;", "        if (n == 7) break;", "    }")),
    ("p_partkey % 26 = 0", _code("    do {", "        n--;", "    } while (n > 0);")),
    ("p_partkey % 25 = 0", _code("    switch (n) {", "    case 1:", "        n = 2;", "        break;", "    default:", "        n = 3;", "    }")),
    ("p_partkey % 27 = 0", _code("    if (n < 0) {", "        goto out;", "    } else {", "        n = 1;", "    }", "out:", "    n = 0;")),
    ("p_partkey % 23 = 0", _code("    std::string name; auto k = new Foo();")),
    ("p_partkey % 6 = 0", _code("    printf(src);")),
    ("p_partkey % 18 = 0", _code("    vprintf(fmt); sprintf(buf, fmt);")),
    ("p_partkey % 9 = 0", _code("    /* a block", "       comment */")),
    ("p_partkey % 10 = 0", _code("    float f = 1.5; long h = 0x1F; log_msg(\"value\", 'c');")),
    ("p_partkey % 43 = 0", _code("    size_t len = strlen(src); uint8_t b = 10L; float g = 2.0f; obj.call(len); p->call(&g, *src);")),
    ("p_partkey % 13 = 0", _code("    int x = atoi(src); char *e = getenv(src); strcat(buf, e);")),
    ("p_partkey % 16 = 0", _code("    fp = fopen(src, \"r\");", "    if (fp != NULL) n = 1;")),
    ("p_partkey % 33 = 0", "chr(9)"),
    ("p_partkey % 211 = 0", f"repeat('    n = n + 1;' || {_NL}, 120)"),
    ("p_partkey = 77", _code("    abort();")),
    ("", _code("    return n;")),
    ("", "'}'"),
]
_TEXT = " || ".join(f"CASE WHEN {c} THEN {t} || {_NL} ELSE '' END" if c else f"{t}" + ("" if t == "'}'" else f" || {_NL}") for c, t in _LINES)
FUNC = f"CASE WHEN p_partkey % 97 = 0 THEN '' WHEN p_partkey % 89 = 0 THEN NULL ELSE {_TEXT} END"
SPLIT = "CASE WHEN p_partkey % 10 = 8 THEN 'validation' WHEN p_partkey % 10 = 9 THEN 'test' ELSE 'train' END"
COLUMNS = {"id": "p_partkey", "func": FUNC, "target": "(p_partkey * 7) % 10 < 4", "project": "CASE WHEN p_partkey % 31 = 0 THEN 'Chromium' WHEN p_partkey % 37 = 0 THEN 'qemu-kvm' ELSE p_brand END", "split": SPLIT, "code": f"coalesce({FUNC}, '')"}
SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM part"
#: For oracles: `WITH {CTE}, ...`.
CTE = f"functions AS ({SQL})"


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic corpus; `code` is func with null as empty."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()])


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`synthetic`, dealt over all cores: a few bytes of keys make a text that takes a millisecond to parse, and a small file is one task."""
    return synthetic(spark, sf_dir).repartition(max(4 * spark.sparkContext.defaultParallelism, 32))


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; a temporary one only where everything runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='korvine-')}"


def read_functions(spark: SparkSession, folder: str, split: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet shards (files or folders) named after splits, or everything of the folder; only `columns` are read."""
    split = ALIASES.get(split, split)
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    df = spark.read.parquet(f"{folder}/{SPLITS[split] if split else '*'}")
    df = df.withColumn("split", F.regexp_extract("_metadata.file_path", "/(train|validation|test)-[^/]*(?:/[^/]*)?$", 1))
    return df.select(*columns) if columns else df


def write_shards(df: DataFrame, folder: str) -> None:
    """A shard for each split, named as `read_functions` expects."""
    for s in SPLITS:
        df.where(F.col("split") == s).drop("split").write.parquet(f"{folder}/{s}-00000.parquet")


def read_any(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The first of these that is there: sharded Parquet, JSON lines, one Parquet file; `valid` also under the name `val`."""
    names = [split, *(["val"] if split in ("valid", "validation") else [])]
    for name in names:
        for read, path in ((spark.read.parquet, f"{folder}/{name}-*.parquet"), (spark.read.json, f"{folder}/{name}.jsonl"), (lambda p: spark.read.option("multiLine", True).json(p), f"{folder}/{name}.json"), (spark.read.parquet, f"{folder}/{name}.parquet")):
            try:
                return read(path)
            except AnalysisException:
                continue
    raise FileNotFoundError(f"no table of split {split!r} in {folder}")


def read_patterns(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(category, severity, regex; category, call) of a YAML file of patterns; patterns that do not compile are left out."""
    import re

    import yaml

    patterns, calls = [], []
    for category, entry in (yaml.safe_load(text) or {}).items():
        for regex in entry.get("patterns", []):
            try:
                re.compile(regex)
            except re.error:
                continue
            patterns.append((category, entry.get("severity", "medium"), regex))
        calls += [(category, f) for f in entry.get("dangerous_functions", [])]
    return spark.createDataFrame(patterns, "category string, severity string, regex string"), spark.createDataFrame(calls, "category string, call string")


def read_jsonl(spark: SparkSession, path: str, split: str | None = None, schema: str = "id long, func string, target boolean, project string, split string") -> DataFrame:
    """JSON lines; blank lines are skipped."""
    df = spark.read.schema(schema).json(path)
    return df.where(F.col("split") == ALIASES.get(split, split)) if split else df


def coerced(df: DataFrame) -> DataFrame:
    """Rows with the types and defaults of a function table; columns that are missing get their defaults."""
    kinds = {"id": ("long", "0"), "func": ("string", "''"), "func_clean": ("string", "''"), "normalized_func": ("string", "''"), "target": ("boolean", "false"), "project": ("string", "''"), "commit_id": ("string", "''")}
    return df.select(*[F.expr(f"coalesce(try_cast({c} AS {t}), {d})" if c in df.columns else f"cast({d} AS {t})").alias(c) for c, (t, d) in kinds.items()], *[c for c in df.columns if c not in kinds])


def vulnerable_lines(encoded: str = "vul_lines") -> Column:
    """Line numbers from JSON text: an object with line_no, a list of numbers, or an object keyed by numbers."""
    s = F.col(encoded)
    numbers = F.regexp_extract_all(F.coalesce(F.when(s.contains("line_no"), F.regexp_extract(s, r'"?line_no"?\s*:\s*\[([^\]]*)\]', 1)).when(s.rlike(r"^\s*\["), s).otherwise(F.array_join(F.regexp_extract_all(s, F.lit(r'[{,]\s*"?(\d+)"?\s*:'), F.lit(1)), ",")), F.lit("")), F.lit(r"(\d+)"), F.lit(1))
    return F.transform(numbers, lambda x: x.cast("int"))


def write_jsonl(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One JSON object a line, in a folder for each split."""
    names = columns or [c for c in df.columns if c != "split"]
    df.select("split", F.to_json(F.struct(*names)).alias("value")).write.partitionBy("split").text(path)


def write_chunks(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet or CSV, in a folder for each split."""
    df.write.partitionBy("split").format(kind).option("header", "true").save(path)


def read_chunks(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).format(kind).option("header", "true").load(path)
