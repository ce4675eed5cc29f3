"""Quality rules with thresholds learnt from mergeable quantile sketches per language and source. SQL functions only.

A sketch is a histogram over integer buckets of growing width (values below 64 exactly, above that to within 1/32).
Sketches add up: those of a language are the sums of those of its sources. Counts in buckets do not depend on the order
of merging, so reruns agree. A group's fence lies `SPREADS` upper quartile distances above its median; a group with
fewer than `LEAST_GROUP` documents uses its language's fence, and a language with fewer uses that of all documents.

Nulls: a null text has no words and fails the base rule; null lang and source count as empty strings. Repeated rows are
judged alike, each for itself. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import NOT_SPACE, materialize, words_of

LEAST_GROUP = 100
SPREADS = 6
#: Metrics in integers: share of symbols and of repeated lines and words in 1/10000, 1/100 characters a word. With the
#: least quartile distance that counts, so that a uniform group does not reject what differs slightly.
METRICS = {"m_symbols": 100, "m_lines": 700, "m_repeats": 700, "m_length": 40}
#: Metrics that also have a lower fence.
TWO_SIDED = ("m_length",)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the metrics of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("t"))
    d = d.withColumn("w", words_of("t")).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_SPACE)))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    # a hash for each window of three words
    d = d.withColumn("h", F.expr("CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"))
    d = d.withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h"))
    # windows beside an equal one, once all are in order; only texts with a repeated window get so far
    d = d.withColumn("o", F.expr("CASE WHEN repeats THEN sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))) END"))
    d = d.withColumn("p", F.expr("CASE WHEN repeats THEN sort_array(transform(filter(o, (x, i) -> (i > 0 AND o[i - 1].x = x.x) OR (i < size(o) - 1 AND o[i + 1].x = x.x)), x -> x.i)) END"))
    d = d.withColumn("n_repeat_words", F.expr("CASE WHEN repeats THEN cast(3 + aggregate(transform(p, (x, i) -> CASE WHEN i = 0 THEN 0 ELSE least(3, x - p[i - 1]) END), 0, (a, x) -> a + x) AS bigint) ELSE 0L END"))
    d = d.select(
        "doc_id", "lang", "source", "n_words",
        F.expr("aggregate(w, 0L, (a, x) -> a + length(x))").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    share = lambda a, b: F.expr(f"10000 * {a} div greatest({b}, 1L)")
    return d.select(
        "*", share("n_symbols", "word_chars").alias("m_symbols"), share("n_dup_lines", "n_lines").alias("m_lines"),
        share("n_repeat_words", "n_words").alias("m_repeats"), F.expr("100 * word_chars div greatest(n_words, 1L)").alias("m_length"),
    )


def bucket(v: str) -> Column:
    """The bucket of an integer v >= 0: exact below 64, else its six leading bits and their place."""
    e = f"cast(greatest(length(bin({v})) - 6, 0) AS int)"
    return F.expr(f"CASE WHEN {v} < 64 THEN {v} ELSE {e} * 64 + shiftright({v}, {e}) END")


def top(b: str) -> Column:
    """The largest value of a bucket."""
    return F.expr(f"CASE WHEN {b} < 64 THEN {b} ELSE shiftleft({b} % 64 + 1, cast({b} div 64 AS int)) - 1 END")


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, bucket, n: the sketches of all metrics in one pass, added up before the shuffle."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(m).alias("bucket")) for m in METRICS]))
    return rows.select(*keys, one.alias("x")).groupBy(*keys, "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_docs, and for each metric its upper (and lower) fence, from sketches merged over all other keys."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    c = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    q = c.groupBy(*keys, "metric").agg(F.max("total").alias("n_docs"), at(1).alias("b1"), at(2).alias("b2"), at(3).alias("b3"))
    q = q.select(*keys, "metric", "n_docs", top("b1").alias("q1"), top("b2").alias("q2"), top("b3").alias("q3"))
    out = []
    for m, least in METRICS.items():
        mine = lambda c: F.max(F.when(F.col("metric") == m, c))  # noqa: E731, B023
        out.append(mine(F.col("q2") + SPREADS * F.greatest(F.col("q3") - F.col("q2"), F.lit(least))).alias(f"hi_{m}"))
        if m in TWO_SIDED:
            out.append(mine(F.col("q2") - SPREADS * F.greatest(F.col("q2") - F.col("q1"), F.lit(least))).alias(f"lo_{m}"))
    return q.groupBy(*keys).agg(F.max("n_docs").alias("n_docs"), *out)


def fence_names() -> list[str]:
    return [f"hi_{m}" for m in METRICS] + [f"lo_{m}" for m in TWO_SIDED]


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source and the fences that hold for them, of every group of `rows` (features)."""
    sketches = materialize(sketch(rows.where(~F.col("base_failed")), ["lang", "source"]))
    names = fence_names()
    small = fences(sketches, ["lang", "source"])
    mid = fences(sketches, ["lang"]).select("lang", F.col("n_docs").alias("mid_docs"), *[F.col(x).alias(f"mid_{x}") for x in names])
    every = fences(sketches.withColumn("one", F.lit(1)), ["one"]).select("one", *[F.col(x).alias(f"all_{x}") for x in names])
    joined = small.join(mid, "lang").withColumn("one", F.lit(1)).join(every, "one")
    pick = lambda x: F.when(F.col("n_docs") >= LEAST_GROUP, F.col(x)).when(F.col("mid_docs") >= LEAST_GROUP, F.col(f"mid_{x}")).otherwise(F.col(f"all_{x}"))
    return materialize(joined.select("lang", "source", *[pick(x).alias(x) for x in names]))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang, source): counts, fences, base_failed, kept."""
    rows = materialize(features(docs))
    joined = rows.join(thresholds(rows), ["lang", "source"], "left")
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & (F.col(m) <= F.col(f"hi_{m}"))
    for m in TWO_SIDED:
        inside = inside & (F.col(m) >= F.col(f"lo_{m}"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *METRICS, *fence_names())
