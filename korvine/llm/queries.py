"""The operators of this subpackage applied to whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, jaccard, language_id, line_dedup, mixing, packing, pii, quality, secret_scan, warc

#: Batches in which op2's documents arrive: two earlier snapshots and a new batch.
BATCHES = 3


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return exact_dedup.dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)), BATCHES).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(language_id.sample(_read(spark, sf_dir, "documents")))
    found = language_id.identify(language_id.page_evidence(_read(spark, sf_dir, "pages")), model, html=True)
    return found.withColumnRenamed("id", "page_id").withColumn("accepted", F.col("probability") >= language_id.LEAST_POSTERIOR)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(pii.sample(docs)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.rewritten(_read(spark, sf_dir, "documents"))
    kept = (F.col("n_lost") == 0) | F.col("_row.text").rlike(line_dedup.NOT_SPACE)
    return rows.select("_row.doc_id", "n_lines", "n_lost", "n_near", kept.alias("kept"), F.sha2("_row.text", 256).alias("text_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(spark, warc.write(_read(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_secret_scan, op2_exact_dedup, op3_mixing, op4_language_id, op5_pii, op6_packing, op7_line_dedup, op8_quality, op9_jaccard, op10_warc)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


# ---- DuckDB -----------------------------------------------------------------------------------------------------------

_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"


def _op1_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    spans = []
    for k, r in enumerate(secret_scan.RULES):
        spans.append(
            f"""list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(p{k}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0),
              'k': {k}, 'n': length(m{k}[i]), 'g': length(g{k}[i]), 'kind': '{r.kind}'}}), lambda x: x.g >= {r.least}) AS s{k}"""
        )
    parts = ", ".join(f"string_split_regex(t, {q(r.regex)}) AS p{k}, regexp_extract_all(t, {q(r.regex)}, 0) AS m{k}, regexp_extract_all(t, {q(r.regex)}, {r.group}) AS g{k}" for k, r in enumerate(secret_scan.RULES))
    text = lambda ks: "array_to_string(list_transform(list_sort(" + "list_concat(" * (len(ks) - 1) + f"s{ks[0]}" + "".join(f", s{k})" for k in ks[1:]) + "), lambda x: x.kind || ':' || x.s || ':' || (x.s + x.n)), ',')"
    base = [k for k, r in enumerate(secret_scan.RULES) if r.base]
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), e AS (SELECT doc_id, {parts} FROM d),
f AS (SELECT doc_id, {", ".join(spans)} FROM e)
SELECT doc_id, len(s0)::BIGINT AS n_assign, len(s1)::BIGINT AS n_access, len(s2)::BIGINT AS n_hex, sha256({text(base)}) AS base_sha256, {text(list(range(len(secret_scan.RULES))))} AS spans FROM f"""


_OP2 = rf"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS rn, count(*) OVER (PARTITION BY h) AS c, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS k FROM d)
SELECT doc_id, k AS keep_id, c AS group_size, rn = 1 AS kept, h AS text_sha256 FROM r"""

_OP3 = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
  ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, ss / w AS ratio, sum(ss) OVER () AS total, sum(w) OVER () AS weights,
  coalesce(sum(3 * ss) OVER (ORDER BY ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  coalesce(sum(w) OVER (ORDER BY ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w),
f AS (SELECT (total - capped)::BIGINT AS rest, (weights - gone)::BIGINT AS wr FROM o WHERE (total - capped) * w <= 3 * ss * (weights - gone) ORDER BY ratio, source LIMIT 1),
t AS (SELECT source, ss, CASE WHEN rest * w > 3 * ss * wr THEN (3 * ss)::DOUBLE ELSE (rest * w)::DOUBLE / wr::DOUBLE END AS target FROM w, f),
b AS (SELECT *, CASE WHEN ss > 0 THEN round(target)::BIGINT // ss ELSE 0 END AS copies FROM t),
c AS (SELECT *, round(target)::BIGINT - copies * ss AS lft FROM b),
g AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g)
SELECT d.doc_id, d.size, c.ss AS source_size, c.target,
  (c.copies * d.size + CASE WHEN u.upto <= c.lft THEN d.size WHEN u.upto - u.n <= c.lft THEN d.size * (c.lft - u.upto + u.n) // u.n ELSE 0 END)::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.h = u.h"""


def _op8_sql() -> str:
    metrics = list(quality.METRICS)
    b = lambda v: f"CASE WHEN {v} < 64 THEN {v} ELSE greatest(length(bin({v})) - 6, 0) * 64 + ({v} >> greatest(length(bin({v})) - 6, 0)::INT) END"
    top = lambda x: f"CASE WHEN {x} < 64 THEN {x} ELSE (({x} % 64 + 1) << ({x} // 64)::INT) - 1 END"
    hi = lambda m, least: f"max(CASE WHEN metric = '{m}' THEN q2 + {quality.SPREADS} * greatest(q3 - q2, {least}) END)::BIGINT AS hi_{m}"
    lo = lambda m, least: f"max(CASE WHEN metric = '{m}' THEN q2 - {quality.SPREADS} * greatest(q2 - q1, {least}) END)::BIGINT AS lo_{m}"
    cols = ", ".join([hi(m, v) for m, v in quality.METRICS.items()] + [lo(m, quality.METRICS[m]) for m in quality.TWO_SIDED])

    def level(name: str, keys: str) -> str:
        part = f"PARTITION BY {keys}, metric" if keys else "PARTITION BY metric"
        group = f"{keys}, " if keys else ""
        at = lambda q: f"min(CASE WHEN upto * 4 >= total * {q} THEN bucket END)"
        return f"""{name}_m AS (SELECT {group}metric, bucket, sum(n) AS n FROM sk GROUP BY {group}metric, bucket),
{name}_c AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS total FROM {name}_m),
{name}_q AS (SELECT {group}metric, max(total) AS n_docs, {at(1)} AS b1, {at(2)} AS b2, {at(3)} AS b3 FROM {name}_c GROUP BY {group}metric),
{name} AS (SELECT {group}max(n_docs) AS n_docs, {cols} FROM (SELECT {group}metric, n_docs, {top("b1")} AS q1, {top("b2")} AS q2, {top("b3")} AS q3 FROM {name}_q){f" GROUP BY {keys}" if keys else ""})"""

    names = quality.fence_names()
    pick = ", ".join(f"CASE WHEN g.n_docs >= {quality.LEAST_GROUP} THEN g.{x} WHEN m.n_docs >= {quality.LEAST_GROUP} THEN m.{x} ELSE e.{x} END AS {x}" for x in names)
    verdict = " AND ".join([f"{m} <= hi_{m}" for m in metrics] + [f"{m} >= lo_{m}" for m in quality.TWO_SIDED])
    union = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {b(m)} AS bucket FROM f WHERE NOT base_failed" for m in metrics)
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
x AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM a WHERE len(w) >= 3),
y AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM x),
z AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM y WHERE c > 1),
r AS (SELECT rid, sum(CASE WHEN p IS NULL THEN 3 ELSE least(3, i - p) END)::BIGINT AS n_repeat_words FROM z GROUP BY rid),
c AS (SELECT a.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM a LEFT JOIN r ON a.rid = r.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10000 * n_symbols // greatest(word_chars, 1) AS m_symbols, 10000 * n_dup_lines // greatest(n_lines, 1) AS m_lines,
  10000 * n_repeat_words // greatest(n_words, 1) AS m_repeats, 100 * word_chars // greatest(n_words, 1) AS m_length FROM c),
sk AS (SELECT lang, source, metric, bucket, count(*) AS n FROM ({union}) GROUP BY ALL),
{level("g", "lang, source")}, {level("m", "lang")}, {level("e", "")},
th AS (SELECT g.lang, g.source, {pick} FROM g JOIN m ON g.lang = m.lang, e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({verdict}, true) AS kept, {", ".join(metrics)}, {", ".join(names)}
FROM f LEFT JOIN th ON f.lang = th.lang AND f.source = th.source"""


_OP9 = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.rid JOIN n y ON p.b = y.rid WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, CASE WHEN any_value(n.n) IS NULL THEN d.doc_id ELSE min(o.doc_id) END AS component_id
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN r ON d.rid = r.a LEFT JOIN d o ON r.b = o.rid GROUP BY d.rid, d.doc_id"""

_OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, list_transform(range(0, 8), lambda i: ('0x' || substr(x, (5 * i + 1)::INT, 5))::BIGINT) AS v FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((n >> b) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM q"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _op1_sql(), "op2_exact_dedup": _OP2, "op3_mixing": _OP3, "op8_quality": _op8_sql(), "op9_jaccard": _OP9, "op10_warc": _OP10}
