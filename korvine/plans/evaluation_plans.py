"""Queries over scores: metrics, thresholds, calibration, decisions, localization, class weights and losses.

The score of a function stands in for a neural model's probability: an integer in thousandths, made of the row. Sums are of
integers and every ratio is one division, so that engines agree to the last bit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.dialect import DUCK, SPARK
from ..operators import heuristics
from ..sources import corpus
from . import rule_plans
from .rule_plans import _exprs

QUERIES, ORACLES = {}, {}


def _query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


SCORE = "(id * 37 + CASE WHEN target THEN 350 ELSE 0 END) % 1000"
#: Three members of an ensemble, and the rows that calibration is fitted on.
MEMBERS = [SCORE, "(id * 53 + CASE WHEN target THEN 400 ELSE 0 END) % 1000", "(id * 71 + CASE WHEN target THEN 300 ELSE 0 END) % 1000"]
THRESHOLD = 650
_SCORED = f"WITH {corpus.CTE}, scored AS (SELECT id, split, target, {SCORE} AS score FROM functions)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.synthetic(spark, sf_dir).select("id", "split", "target", F.expr(SCORE).alias("score"))


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, score, p, q: how many of each class have a score; what thresholds meet is this table and no rows."""
    return rows.groupBy(*keys, "score").agg(F.count_if("target").alias("p"), F.count_if(~F.col("target")).alias("q"))


# ---- metrics and thresholds ------------------------------------------------------------------------------------------


def confusion(spark: SparkSession, rows: DataFrame, low: int, high: int, step: int) -> DataFrame:
    """t (thousandths), tp, fp, fn, tn at thresholds low, low + step, ... below `high`."""
    t = spark.range(low, high, step).withColumnRenamed("id", "t")
    above = F.col("score") >= F.col("t")
    of = lambda c, n: F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))
    return histogram(rows).crossJoin(F.broadcast(t)).groupBy("t").agg(of(above, "p").alias("tp"), of(above, "q").alias("fp"), of(~above, "p").alias("fn"), of(~above, "q").alias("tn"))


def _confusion_sql(low: int, high: int, step: int, where: str = "true") -> str:
    return f"{_SCORED}, th AS (SELECT unnest(range({low}, {high}, {step})) AS t), cm AS (SELECT t, count(*) FILTER (target AND score >= t) AS tp, count(*) FILTER (NOT target AND score >= t) AS fp, count(*) FILTER (target AND score < t) AS fn, count(*) FILTER (NOT target AND score < t) AS tn FROM th, scored WHERE {where} GROUP BY t)"


#: Metrics as ratios of counts: F-beta is (1 + b^2) tp / ((1 + b^2) tp + b^2 fn + fp).
METRICS = {"f1": ("2 * tp", "2 * tp + fp + fn"), "prec": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "accuracy": ("tp + tn", "tp + tn + fp + fn"), "f05": ("5 * tp", "5 * tp + fn + 4 * fp"), "f15": ("13 * tp", "13 * tp + 9 * fn + 4 * fp")}


def _metrics(d, *names: str) -> dict[str, str]:
    return {n: d.ratio(*METRICS[n]) for n in names}


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


@_query("m1_threshold_sweep", f"{_confusion_sql(100, 900, 10)} SELECT t, tp, fp, fn, tn, {_list(_metrics(DUCK, 'f1', 'prec', 'recall', 'accuracy'))} FROM cm")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(spark, scored(spark, sf_dir), 100, 900, 10).select("t", "tp", "fp", "fn", "tn", *_exprs(_metrics(SPARK, "f1", "prec", "recall", "accuracy")))


def best(rows: DataFrame, value: str, otherwise: int = 500, highest: bool = False) -> Column:
    """Aggregate: (value, threshold) of the greatest value above 0, the lowest threshold among equals."""
    order = F.col("t") if highest else -F.col("t")
    return F.max(F.when(F.expr(value) > 0, F.struct(F.expr(value).alias("v"), order.alias("o"))))


@_query(
    "m1_best_thresholds",
    f"{_confusion_sql(100, 900, 10)}, mv AS (SELECT t, unnest([{{'metric': 'f1', 'v': {DUCK.ratio(*METRICS['f1'])}}}, {{'metric': 'precision', 'v': {DUCK.ratio(*METRICS['prec'])}}}, {{'metric': 'recall', 'v': {DUCK.ratio(*METRICS['recall'])}}}, {{'metric': 'balanced', 'v': -abs({DUCK.ratio(*METRICS['prec'])} - {DUCK.ratio(*METRICS['recall'])})}}]) AS m FROM cm), r AS (SELECT m.metric AS metric, m.v AS v, t, row_number() OVER (PARTITION BY m.metric ORDER BY m.v DESC, t) AS rn FROM mv) SELECT metric, CASE WHEN v > 0 THEN t ELSE 500 END AS threshold, CASE WHEN v > 0 THEN v ELSE 0 END AS value FROM r WHERE rn = 1",
)
def best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the lowest threshold of the best value; a balance of 0 at most never beats the start, 0.5."""
    prec, recall = SPARK.ratio(*METRICS["prec"]), SPARK.ratio(*METRICS["recall"])
    values = {"f1": SPARK.ratio(*METRICS["f1"]), "precision": prec, "recall": recall, "balanced": f"-abs({prec} - {recall})"}
    c = confusion(spark, scored(spark, sf_dir), 100, 900, 10)
    c = c.select("t", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.expr(e).alias("v")) for n, e in values.items()])))
    b = c.groupBy("metric").agg(best(c, "v").alias("b"))
    return b.select("metric", F.coalesce(-F.col("b.o"), F.lit(500)).alias("threshold"), F.coalesce("b.v", F.lit(0.0)).alias("value"))


#: objective: (value, constraint, objective to fall back on).
OBJECTIVES = {
    "f1": ("f1", "true", None), "f0.5": ("f05", "true", None), "precision_constrained": ("f1", "10 * tp >= 6 * (tp + fp) AND tp + fp > 0", "f1"),
    "recall_constrained": ("f1", "10 * tp >= 8 * (tp + fn) AND tp + fn > 0", "f1"), "f0.5_recall_constrained": ("f05", "10 * tp >= 8 * (tp + fn) AND tp + fn > 0", "f0.5"),
}


def _m2_sql() -> str:
    values = ", ".join(f"{{'objective': '{n}', 'v': CASE WHEN {c} THEN {DUCK.ratio(*METRICS[m])} ELSE 0 END}}" for n, (m, c, _) in OBJECTIVES.items())
    strict = f"SELECT 'recall_constrained_strict' AS objective, t AS threshold, {DUCK.ratio(*METRICS['f1'])} AS value FROM cm WHERE {OBJECTIVES['recall_constrained'][1]} ORDER BY t DESC LIMIT 1"
    back = " ".join(f"WHEN '{n}' THEN '{b}'" for n, (_, _, b) in OBJECTIVES.items() if b)
    return f"""{_confusion_sql(100, 901, 5)}, mv AS (SELECT t, unnest([{values}]) AS m FROM cm), r AS (SELECT m.objective AS objective, m.v AS v, t, row_number() OVER (PARTITION BY m.objective ORDER BY m.v DESC, t) AS rn FROM mv),
b AS (SELECT objective, CASE WHEN v > 0 THEN t ELSE 500 END AS threshold, CASE WHEN v > 0 THEN v ELSE 0 END AS value FROM r WHERE rn = 1),
s AS ({strict}), st AS (SELECT * FROM s UNION ALL SELECT 'recall_constrained_strict', threshold, value FROM b WHERE objective = 'f1' AND NOT EXISTS (SELECT 1 FROM s))
SELECT b.objective, CASE WHEN b.value = 0 AND o.objective IS NOT NULL THEN o.threshold ELSE b.threshold END AS threshold, CASE WHEN b.value = 0 AND o.objective IS NOT NULL THEN o.value ELSE b.value END AS value
FROM b LEFT JOIN b o ON o.objective = CASE b.objective {back} END UNION ALL SELECT * FROM st"""


@_query("m2_constrained_thresholds", _m2_sql())
def constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: sweeps with floors of precision or recall, each with what it falls back on; one aggregate over the thresholds."""
    c = confusion(spark, scored(spark, sf_dir), 100, 901, 5)
    aggs = [best(c, f"CASE WHEN {where} THEN {SPARK.ratio(*METRICS[m])} ELSE 0 END").alias(n) for n, (m, where, _) in OBJECTIVES.items()]
    strict = F.max(F.when(F.expr(OBJECTIVES["recall_constrained"][1]), F.struct("t", F.expr(SPARK.ratio(*METRICS["f1"])).alias("v"))))
    one = c.agg(*aggs, strict.alias("strict"))
    found = lambda n: F.struct(F.coalesce(-F.col(f"`{n}`.o"), F.lit(500)).alias("threshold"), F.coalesce(F.col(f"`{n}`.v"), F.lit(0.0)).alias("value"))
    rows = []
    for n, (_, _, back) in OBJECTIVES.items():
        x = F.when(F.col(f"`{n}`").isNull(), found(back)).otherwise(found(n)) if back else found(n)
        rows.append(F.struct(F.lit(n).alias("objective"), x.alias("x")))
    rows.append(F.struct(F.lit("recall_constrained_strict").alias("objective"), F.coalesce(F.when(F.col("strict").isNotNull(), F.struct(F.col("strict.t").alias("threshold"), F.col("strict.v").alias("value"))), found("f1")).alias("x")))
    return one.select(F.inline(F.array(*rows))).select("objective", "x.threshold", "x.value")


_F15 = "CASE WHEN 100 * tp >= 78 * (tp + fp) AND tp + fp > 0 THEN {} ELSE 0 END"


@_query(
    "m3_fbeta_threshold",
    f"{_confusion_sql(200, 800, 10)}, a AS (SELECT t, {_F15.format(DUCK.ratio(*METRICS['f15']))} AS v, {DUCK.ratio(*METRICS['f1'])} AS f1 FROM cm), b AS (SELECT t, v FROM a ORDER BY v DESC, t LIMIT 1), c AS (SELECT t, f1 FROM a WHERE t >= 250 AND t < 750 ORDER BY f1 DESC, t LIMIT 1) SELECT CASE WHEN b.v > 0 THEN b.t ELSE c.t END AS threshold, CASE WHEN b.v > 0 THEN b.v ELSE c.f1 END AS value, b.v > 0 AS constrained FROM b, c",
)
def fbeta_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: F-1.5 among thresholds of enough precision, else the best F1 of the middle range."""
    c = confusion(spark, scored(spark, sf_dir), 200, 800, 10)
    f1 = F.struct(F.expr(SPARK.ratio(*METRICS["f1"])).alias("v"), (-F.col("t")).alias("o"))
    one = c.agg(best(c, _F15.format(SPARK.ratio(*METRICS["f15"]))).alias("b"), F.max(F.when((F.col("t") >= 250) & (F.col("t") < 750), f1)).alias("c"))
    pick = F.coalesce("b", "c")
    return one.select((-pick["o"]).alias("threshold"), pick["v"].alias("value"), F.col("b").isNotNull().alias("constrained"))


@_query(
    "m5_evaluation",
    f"{_SCORED}, b AS (SELECT split, count(*) AS n, count(*) FILTER (target AND score >= 500) AS tp5, count(*) FILTER (NOT target AND score >= 500) AS fp5, count(*) FILTER (target AND score < 500) AS fn5, count(*) FILTER (NOT target AND score < 500) AS tn5, count(*) FILTER (target AND score >= {THRESHOLD}) AS tp, count(*) FILTER (NOT target AND score >= {THRESHOLD}) AS fp, count(*) FILTER (target AND score < {THRESHOLD}) AS fn, count(*) FILTER (NOT target AND score < {THRESHOLD}) AS tn FROM scored GROUP BY split) SELECT *, {DUCK.ratio('2 * tp5', '2 * tp5 + fp5 + fn5')} AS f1_half, {_list(_metrics(DUCK, 'f1', 'prec', 'recall', 'accuracy'))} FROM b",
)
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M11e: both confusion matrices and the metrics of each split."""
    n = lambda c: F.count_if(F.expr(c))
    g = scored(spark, sf_dir).groupBy("split").agg(
        F.count("*").alias("n"), *[n(f"{'' if c[0] == 't' and c[1] == 'p' or c == 'fn' else 'NOT '}target AND score {'>=' if c[1] == 'p' else '<'} {t}").alias(c + s) for t, s in ((500, "5"), (THRESHOLD, "")) for c in ("tp", "fp", "fn", "tn")]
    )
    return g.select("*", F.expr(SPARK.ratio("2 * tp5", "2 * tp5 + fp5 + fn5")).alias("f1_half"), *_exprs(_metrics(SPARK, "f1", "prec", "recall", "accuracy")))


@_query("a21_roc_auc", f"{_SCORED}, r AS (SELECT target, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS c FROM scored), a AS (SELECT sum(CASE WHEN target THEN 2 * lo + c - 1 ELSE 0 END)::BIGINT AS ranks, count(*) FILTER (target) AS p, count(*) FILTER (NOT target) AS q FROM r) SELECT p, q, CASE WHEN p * q = 0 THEN 0.5 ELSE (ranks - p * (p + 1))::DOUBLE / (2 * p * q)::DOUBLE END AS auc FROM a")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank statistic with average ranks of ties; 0.5 where one class is missing."""
    h = cumulative(histogram(scored(spark, sf_dir))).withColumns({"c": F.expr("p + q"), "lo": F.expr("before_p + before_q + 1")})
    a = h.agg(F.coalesce(F.sum(F.expr("p * (2 * lo + c - 1)")), F.lit(0)).alias("ranks"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("q"), F.lit(0)).alias("q"))
    return a.select("p", "q", F.expr("CASE WHEN p * q = 0 THEN 0.5D ELSE cast(ranks - p * (p + 1) AS double) / cast(2 * p * q AS double) END").alias("auc"))


#: Ranges of scores, for running sums over a histogram of any size.
RANGES = 256


def cumulative(hist: DataFrame) -> DataFrame:
    """Adds before_p and before_q, the sums of all smaller scores, of a histogram (score from 0 to 1000, p, q).

    Running sums within ranges of scores, each a task's work, and over the RANGES sums of ranges: no window over all rows.
    """
    h = hist.withColumn("range", F.floor(F.col("score") * RANGES / 1000).cast("int"))
    sums = h.groupBy("range").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    sums = sums.select("range", F.coalesce(F.sum("sp").over(w), F.lit(0)).alias("bp"), F.coalesce(F.sum("sq").over(w), F.lit(0)).alias("bq"))
    inside = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    own = h.select("*", F.coalesce(F.sum("p").over(inside), F.lit(0)).alias("ip"), F.coalesce(F.sum("q").over(inside), F.lit(0)).alias("iq"))
    return own.join(F.broadcast(sums), "range").select("score", "p", "q", F.expr("bp + ip").alias("before_p"), F.expr("bq + iq").alias("before_q"))


@_query("m13_roc_points", f"{_SCORED}, h AS (SELECT score, count(*) FILTER (target) AS p, count(*) FILTER (NOT target) AS q FROM scored GROUP BY score), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(q) OVER (ORDER BY score DESC)::BIGINT AS fp, sum(p) OVER ()::BIGINT AS np, sum(q) OVER ()::BIGINT AS nq FROM h) SELECT score, tp, fp, {DUCK.ratio('tp', 'np')} AS tpr, {DUCK.ratio('fp', 'nq')} AS fpr, {DUCK.ratio('tp', 'tp + fp')} AS prec FROM c")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the ROC and the precision-recall curve."""
    h = histogram(scored(spark, sf_dir))
    t = h.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    c = cumulative(h).crossJoin(F.broadcast(t)).withColumns({"tp": F.expr("np - before_p"), "fp": F.expr("nq - before_q")})
    return c.select("score", "tp", "fp", F.expr(SPARK.ratio("tp", "np")).alias("tpr"), F.expr(SPARK.ratio("fp", "nq")).alias("fpr"), F.expr(SPARK.ratio("tp", "tp + fp")).alias("prec"))


@_query("a22_ensemble", f"WITH {corpus.CTE}, m AS (SELECT id, target, {' + '.join(f'({x})' for x in MEMBERS)} AS total FROM functions) SELECT id, total::DOUBLE / 3.0::DOUBLE AS mean_score, total >= {3 * THRESHOLD} AS vulnerable FROM m")
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = " + ".join(f"({x})" for x in MEMBERS)
    d = corpus.synthetic(spark, sf_dir).select("id", F.expr(total).alias("total"))
    return d.select("id", F.expr("cast(total AS double) / 3D").alias("mean_score"), (F.col("total") >= 3 * THRESHOLD).alias("vulnerable"))


@_query("m4_calibrated", None)
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: isotonic regression fitted on the validation rows, applied to the test rows, clipped to 0 and 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    d = VectorAssembler(inputCols=["score"], outputCol="features").transform(scored(spark, sf_dir).withColumn("label", F.col("target").cast("double")))
    # the histogram has the same fit, and a row for each score at most
    held = d.where("split = 'validation'").groupBy("score").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(weightCol="weight").fit(VectorAssembler(inputCols=["score"], outputCol="features").transform(held))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))
    return model.transform(d.where("split = 'test'")).select("id", "target", "score", p.alias("probability"))


@_query("m12_gate", f"{_SCORED}, c AS (SELECT count(*) FILTER (target AND score >= {THRESHOLD}) AS tp, count(*) FILTER (NOT target AND score >= {THRESHOLD}) AS fp, count(*) FILTER (target AND score < {THRESHOLD}) AS fn, count(*) FILTER (target) AS p, count(*) FILTER (NOT target) AS q FROM scored WHERE split = 'test'), r AS (SELECT target, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS k FROM scored WHERE split = 'test'), a AS (SELECT sum(CASE WHEN target THEN 2 * lo + k - 1 ELSE 0 END)::BIGINT AS ranks FROM r) SELECT 100 * 2 * tp >= 74 * (2 * tp + fp + fn) AS f1_passes, 100 * (ranks - p * (p + 1)) >= 87 * 2 * p * q AS auc_passes FROM c, a")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of 0.74 and AUC of 0.87 at least, as an assertion query."""
    rows = scored(spark, sf_dir).where("split = 'test'")
    c = rows.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in {"tp": f"target AND score >= {THRESHOLD}", "fp": f"NOT target AND score >= {THRESHOLD}", "fn": f"target AND score < {THRESHOLD}"}.items()])
    a = cumulative(histogram(rows)).agg(F.sum(F.expr("p * (2 * (before_p + before_q + 1) + p + q - 1)")).alias("ranks"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return c.crossJoin(F.broadcast(a)).select(F.expr("100 * 2 * tp >= 74 * (2 * tp + fp + fn)").alias("f1_passes"), F.expr("100 * (ranks - p * (p + 1)) >= 87 * 2 * p * q").alias("auc_passes"))


# ---- class weights, losses, early stopping -----------------------------------------------------------------------------


@_query(
    "a17_class_weights",
    f"WITH {corpus.CTE}, c AS (SELECT target, count(*) AS n FROM functions GROUP BY target), t AS (SELECT sum(n)::BIGINT AS total, count(*) AS k, sum(1.0::DOUBLE / n) AS inv, sum(sqrt(1.0::DOUBLE / n)) AS root FROM c) SELECT target, n, total::DOUBLE / (k * n)::DOUBLE AS balanced, round((1.0::DOUBLE / n) / inv * k, 9) AS inverse, round(sqrt(1.0::DOUBLE / n) / root * k, 9) AS sqrt_inverse FROM c, t",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.synthetic(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(F.expr("1D / n")).alias("inv"), F.sum(F.expr("sqrt(1D / n)")).alias("root"))
    weights = {"balanced": "cast(total AS double) / cast(k * n AS double)", "inverse": "round((1D / n) / inv * k, 9)", "sqrt_inverse": "round(sqrt(1D / n) / root * k, 9)"}
    return c.crossJoin(F.broadcast(t)).select("target", "n", *_exprs(weights))


@_query("a17_sample_weights", f"WITH {corpus.CTE}, c AS (SELECT target, count(*) AS n FROM functions GROUP BY target), t AS (SELECT sum(n)::BIGINT AS total, count(*) AS k FROM c) SELECT f.id, total::DOUBLE / (k * n)::DOUBLE AS weight FROM functions f JOIN c ON f.target = c.target, t")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's weight by its class, a table of a row for each class."""
    w = class_weights(spark, sf_dir).select("target", F.col("balanced").alias("weight"))
    return corpus.synthetic(spark, sf_dir).select("id", "target").join(F.broadcast(w), "target").select("id", "weight")


_SCHEMES = {"pos_weight": "neg / nullif(pos, 0)", "precision_focused_0": "1.15", "precision_focused_1": "0.85 * neg / nullif(pos, 0)", "boosted": "1.12 * neg / nullif(pos, 0)", "focal_alpha": "1.4 * neg / nullif(pos + neg, 0)"}


@_query("m11a_weight_schemes", f"WITH {corpus.CTE}, c AS (SELECT (count(*) FILTER (target))::DOUBLE AS pos, (count(*) FILTER (NOT target))::DOUBLE AS neg FROM functions) " + " UNION ALL ".join(f"SELECT '{n}' AS scheme, round(({e})::DOUBLE, 9) AS weight FROM c" for n, e in _SCHEMES.items()))
def weight_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.synthetic(spark, sf_dir).agg(F.count_if("target").cast("double").alias("pos"), F.count_if(~F.col("target")).cast("double").alias("neg"))
    return c.select(F.inline(F.array(*[F.struct(F.lit(n).alias("scheme"), F.expr(f"round(cast({e} AS double), 9)").alias("weight")) for n, e in _SCHEMES.items()])))


_P = "greatest(0.001, least(0.999, score / 1000.0))"
#: Losses of a row, p its probability of the positive class and y its label.
_LOSSES = {
    "focal_2": "CASE WHEN y = 1 THEN 0.25 * pow(1 - p, 2) * -ln(p) ELSE 0.75 * pow(p, 2) * -ln(1 - p) END",
    "smoothed_ce": "-((0.9 * y + 0.05) * ln(p) + (1 - (0.9 * y + 0.05)) * ln(1 - p))",
    "weighted_bce": "-(1.12 * (0.9 * y + 0.05) * ln(p) + (1 - (0.9 * y + 0.05)) * ln(1 - p))",
}


@_query("m11b_losses", f"{_SCORED}, a AS (SELECT split, {_P}::DOUBLE AS p, target::INT AS y FROM scored) SELECT split, {', '.join(f'round(avg({e}), 6) AS {n}' for n, e in _LOSSES.items())} FROM a GROUP BY split")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = scored(spark, sf_dir).select("split", F.expr(f"cast({_P} AS double)").alias("p"), F.col("target").cast("int").alias("y"))
    return a.groupBy("split").agg(*[F.expr(f"round(avg({e}), 6)").alias(n) for n, e in _LOSSES.items()])


_EPOCHS, _PATIENCE = 30, 4
_HISTORY = "(600 + (e * 97) % 83 + least(e, 12) * 4)"


@_query(
    "m11c_early_stopping",
    f"WITH h AS (SELECT e, {_HISTORY} AS f1 FROM (SELECT unnest(range(1, {_EPOCHS + 1})) AS e)), m AS (SELECT *, max(f1) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h), g AS (SELECT *, max(CASE WHEN before IS NULL OR f1 > before + 1 THEN e END) OVER (ORDER BY e) AS last_gain FROM m), s AS (SELECT min(e) AS stop FROM g WHERE e - last_gain >= {_PATIENCE}) SELECT e AS epoch, f1, last_gain AS best_epoch, e - last_gain AS waited FROM g, s WHERE e <= coalesce(stop, {_EPOCHS})",
)
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11c over a table of metrics, a row for each epoch: a running best, epochs waited, rows until patience is out."""
    w = Window.orderBy("e")  # a history has as many rows as epochs
    h = spark.range(1, _EPOCHS + 1).select(F.col("id").alias("e"), F.expr(_HISTORY.replace("e * 97", "id * 97").replace("least(e,", "least(id,")).alias("f1"))
    h = h.withColumn("before", F.max("f1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    h = h.withColumn("last_gain", F.max(F.when(F.col("before").isNull() | (F.col("f1") > F.col("before") + 1), F.col("e"))).over(w))
    h = h.withColumn("waited", F.col("e") - F.col("last_gain"))
    stop = h.where(F.col("waited") >= _PATIENCE).agg(F.min("e").alias("stop"))
    return h.crossJoin(F.broadcast(stop)).where(F.col("e") <= F.coalesce("stop", F.lit(_EPOCHS))).select(F.col("e").alias("epoch"), "f1", F.col("last_gain").alias("best_epoch"), "waited")


# ---- splits and batches --------------------------------------------------------------------------------------------------


_BATCH = 32


@_query("e7_stratified_split", f"WITH {corpus.CTE}, r AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY (id * 7919) % 100003, id) AS rn, count(*) OVER (PARTITION BY target) AS n FROM functions) SELECT id, target, CASE WHEN rn <= 8 * n // 10 THEN 'train' ELSE 'test' END AS part FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly floor(0.8 n) of each label, by a key that mixes ids: a histogram of keys shows where the share runs out, and only the
    rows of that one key are put in order. No label is a task's work."""
    d = corpus.synthetic(spark, sf_dir).select("id", "target", F.expr("(id * 7919) % 100003").alias("key")).withColumn("coarse", F.expr("key div 317"))
    by_key = d.groupBy("target", "coarse", "key").agg(F.count("*").alias("c"))
    by_coarse = by_key.groupBy("target", "coarse").agg(F.sum("c").alias("c"))  # 316 rows for each label
    w = Window.partitionBy("target")
    by_coarse = by_coarse.select("target", "coarse", (F.sum("c").over(w.orderBy("coarse")) - F.col("c")).alias("before"), F.expr("8 * sum(c) OVER (PARTITION BY target) div 10").alias("quota"))
    keys = by_key.join(F.broadcast(by_coarse), ["target", "coarse"])
    keys = keys.withColumn("before", F.col("before") + F.sum("c").over(Window.partitionBy("target", "coarse").orderBy("key")) - F.col("c"))
    edge = keys.where("before < quota AND before + c > quota").select("target", F.col("key").alias("edge"), F.expr("quota - before").alias("rest"))
    whole = keys.where("before < quota AND before + c <= quota").groupBy("target").agg(F.max("key").alias("last"))
    j = d.join(F.broadcast(whole), "target", "left").join(F.broadcast(edge), "target", "left")
    on_edge = j.where("key <=> edge").withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy("id")))
    out = j.where("NOT key <=> edge").select("id", "target", F.expr("CASE WHEN key <= last THEN 'train' ELSE 'test' END").alias("part"))
    return out.unionByName(on_edge.select("id", "target", F.expr("CASE WHEN rn <= rest THEN 'train' ELSE 'test' END").alias("part")))


@_query(
    "e9_balanced_batches",
    f"WITH {corpus.CTE}, r AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY (id * 7919) % 100003, id) - 1 AS rn FROM functions), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM functions GROUP BY target)) SELECT (rn // {_BATCH // 2})::BIGINT AS batch, count(*) AS n, count(*) FILTER (target) AS n_positive, min(id) AS first_id FROM r, m WHERE rn < {_BATCH // 2} * (least // {_BATCH // 2}) GROUP BY 1",
)
def balanced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole batches with as many rows of each class, until the smallest class runs out. Ranks come from counts by key and a window within a key's range."""
    d = corpus.synthetic(spark, sf_dir).select("id", "target", F.expr("(id * 7919) % 100003").alias("key")).withColumn("coarse", F.expr("key div 317"))
    sums = d.groupBy("target", "coarse").agg(F.count("*").alias("c"))  # 316 rows for each label
    least = d.groupBy("target").agg(F.count("*").alias("c")).agg(F.min("c").alias("least"))
    before = sums.select("target", "coarse", (F.sum("c").over(Window.partitionBy("target").orderBy("coarse")) - F.col("c")).alias("before"))
    local = F.row_number().over(Window.partitionBy("target", "coarse").orderBy("key", "id")) - 1
    r = d.withColumn("local", local).join(F.broadcast(before), ["target", "coarse"]).crossJoin(F.broadcast(least)).withColumn("rn", F.col("before") + F.col("local"))
    r = r.where(f"rn < {_BATCH // 2} * (least div {_BATCH // 2})").withColumn("batch", F.expr(f"rn div {_BATCH // 2}"))
    return r.groupBy("batch").agg(F.count("*").alias("n"), F.count_if("target").alias("n_positive"), F.min("id").alias("first_id"))


_MODEL_MEMORY = {"small": 0.5, "base": 1.0, "large": 2.5}


@_query("e11_batch_sizes", "WITH c AS (SELECT unnest([128, 256, 512]) AS seq, unnest([true, false, true]) AS mixed), m AS (SELECT unnest(['small', 'base', 'large']) AS model, unnest([0.5, 1.0, 2.5])::DOUBLE AS gb) SELECT seq::BIGINT AS seq, mixed, model, greatest(1, least(128, floor(round(12.8::DOUBLE / (gb * (seq / 512.0::DOUBLE) * CASE WHEN mixed THEN 0.6 ELSE 1.0 END), 6))))::BIGINT AS batch_size FROM c, m")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest batch that fits in memory."""
    rows = [(s, mixed, m, gb) for s, mixed in ((128, True), (256, False), (512, True)) for m, gb in _MODEL_MEMORY.items()]
    d = spark.createDataFrame(rows, "seq long, mixed boolean, model string, gb double")
    return d.select("seq", "mixed", "model", F.expr("cast(greatest(1, least(128, floor(round(12.8D / (gb * (seq / 512D) * IF(mixed, 0.6D, 1D)), 6)))) AS bigint)").alias("batch_size"))


# ---- decisions -------------------------------------------------------------------------------------------------------------

# What G17 counts by pattern.
_NULL_TESTS, _BOUND_TESTS = r"!=\s*NULL|==\s*NULL|!\s*\w+", r"<\s*\w+\s*(?:;|\))|sizeof|strlen|len"
_DEREFS, _SUBSCRIPTS = r"[=(,;{}!&|<>+]\s*\*\s*[A-Za-z_]\w*", r"[A-Za-z_]\w*\s*\["


def _risk(d) -> dict[str, str]:
    lost = lambda a, b: f"greatest({d.count('code', a)} - {d.count('code', b)}, 0)"
    return {"nulls": lost(_DEREFS, _NULL_TESTS), "bounds": lost(_SUBSCRIPTS, _BOUND_TESTS)}


def _analysis_sql() -> str:
    body = lambda name: rule_plans.ORACLES[name][len(rule_plans.LINES) + 2 :]  # noqa: E731  what follows the common tables
    counts = ", ".join(f"{e} AS {c}" for c, e in _risk(DUCK).items())
    return f"""{rule_plans.I3}, ls AS (SELECT id, string_split(code, chr(10)) AS l FROM functions), lines AS (SELECT id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM ls),
un AS (SELECT id, count(*) AS unguarded FROM (WITH {body('g16_unguarded_calls')}) GROUP BY id), ta AS (SELECT id, count(*) AS tainted FROM (WITH {body('g15_tainted_sinks')}) GROUP BY id), co AS (SELECT id, {counts} FROM functions),
analysis AS (SELECT f.id, f.target, coalesce(unguarded, 0) AS unguarded, coalesce(tainted, 0) AS tainted, nulls, bounds, least(100, 30 * coalesce(tainted, 0) + 20 * coalesce(unguarded, 0) + 10 * nulls + 10 * bounds) AS risk FROM functions f LEFT JOIN un ON f.id = un.id LEFT JOIN ta ON f.id = ta.id JOIN co ON f.id = co.id)"""


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, target, code, unguarded, tainted, nulls, bounds, risk (hundredths), without a shuffle but for what the calls themselves need."""
    un = rule_plans.unguarded_calls(spark, sf_dir).groupBy("id").agg(F.count("*").alias("unguarded"))
    ta = rule_plans.tainted_sinks(spark, sf_dir).groupBy("id").agg(F.count("*").alias("tainted"))
    d = corpus.synthetic(spark, sf_dir).select("id", "target", "code", *_exprs(_risk(SPARK))).join(un, "id", "left").join(ta, "id", "left").fillna(0, ["unguarded", "tainted"])
    return d.withColumn("risk", F.expr("least(100, 30 * tainted + 20 * unguarded + 10 * nulls + 10 * bounds)"))


_query("g17_risk", f"{_analysis_sql()} SELECT id, unguarded, tainted, nulls, bounds, risk FROM analysis")(lambda s, d: analysis(s, d).select("id", "unguarded", "tainted", "nulls", "bounds", "risk"))

_M6 = f"greatest(0, least(100000, CASE WHEN score >= {THRESHOLD} AND score < 700 THEN CASE WHEN risk < 10 THEN score * 85 WHEN tainted > 0 THEN least(100000, score * 105) ELSE score * 100 END WHEN score >= 400 AND score < {THRESHOLD} THEN CASE WHEN tainted > 0 OR unguarded > 0 THEN score * 115 ELSE score * 100 END WHEN score < 300 AND unguarded > 1 THEN score * 120 ELSE score * 100 END))"
_CONFIDENCE = "CASE WHEN final > 80000 OR final < 20000 THEN 'high' WHEN final > 60000 OR final < 40000 THEN 'medium' ELSE 'low' END"


@_query("m6_postprocessed", f"{_analysis_sql()}, s AS (SELECT *, {SCORE} AS score FROM analysis) SELECT id, score, risk, {_M6} AS adjusted FROM s")
def postprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, in hundred-thousandths."""
    return analysis(spark, sf_dir).withColumn("score", F.expr(SCORE)).select("id", "score", "risk", F.expr(_M6).alias("adjusted"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, code, score, adjusted, boost_hundredths, patterns, final."""
    d = analysis(spark, sf_dir).withColumn("score", F.expr(SCORE)).withColumn("adjusted", F.expr(_M6))
    for step in heuristics.critical():
        d = d.select("*", *_exprs(step))
    return d.withColumn("final", F.expr("least(100000, adjusted + 1000 * boost_hundredths)"))


_DECIDED = f"{_analysis_sql()}, s AS (SELECT *, {SCORE} AS score FROM analysis), p AS (SELECT *, {_M6} AS adjusted FROM s), decided AS (SELECT p.*, boost_hundredths, patterns, least(100000, adjusted + 1000 * boost_hundredths) AS final FROM p JOIN critical c ON p.id = c.id)"


@_query("m7_decisions", f"{_DECIDED} SELECT id, score, final, final >= {100 * THRESHOLD} AS vulnerable, {_CONFIDENCE} AS confidence, patterns FROM decided")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the score after graph evidence and the boost of critical patterns, capped; verdict and confidence."""
    return decided(spark, sf_dir).select("id", "score", "final", F.expr(f"final >= {100 * THRESHOLD}").alias("vulnerable"), F.expr(_CONFIDENCE).alias("confidence"), "patterns")


# Token importance: attention weights stand in as integers made of the token's number.
_GLOBAL, _LEVEL, _SEQ, _TOKEN = "((pos * 13 + id) % 7)", "((pos // 32 * 5 + id) % 3)", "((pos // 32 * 3 + id) % 4)", "((pos * 17 + id) % 5)"
_IMPORTANCE = f"(2 * {_GLOBAL} + ({_LEVEL} + {_SEQ}) * {_TOKEN})"


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: id, code, t: tokens with line and importance (quarters of an integer weight: half global, half slice level times token)."""
    from ..operators import places

    d = corpus.synthetic(spark, sf_dir).select("id", "target", "code", F.expr(heuristics.stripped(SPARK)).alias("clean")).withColumn("t", places.serving_lines("clean"))
    weight = _IMPORTANCE.replace("//", "div").replace("pos", "i")
    return d.select("id", "target", "code", F.expr(f"transform(t, (x, i) -> named_struct('line', cast(x.line AS bigint), 'token', x.token, 'w', cast({weight} AS bigint), 'pos', i))").alias("t"))


def _importance_sql() -> str:
    from . import token_plans

    s = tokens_pattern()
    return f"WITH {corpus.CTE}, sa AS (SELECT id, target, code, {heuristics.stripped(DUCK)} AS clean FROM functions), sl AS (SELECT id, unnest(range(1, len(string_split(clean, chr(10))) + 1)) AS line, unnest(string_split(clean, chr(10))) AS text FROM sa), st AS (SELECT id, line, unnest(range(1, len(regexp_extract_all(text, '{s}')) + 1)) AS k, unnest(regexp_extract_all(text, '{s}')) AS raw FROM sl), so AS (SELECT id, line, {token_plans.tokens.serving('raw', DUCK)} AS token, row_number() OVER (PARTITION BY id ORDER BY line, k) - 1 AS pos FROM st), imp AS (SELECT *, {_IMPORTANCE} AS w FROM so)"


def tokens_pattern() -> str:
    from ..operators import tokens

    return tokens.SERVING.replace("'", "''")


@_query("m8_token_importance", f"{_importance_sql()} SELECT id, pos, token, {DUCK.ratio('w', '(sum(w) OVER (PARTITION BY id))::BIGINT')} AS importance FROM imp")
def token_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = importance(spark, sf_dir).withColumn("total", F.expr("aggregate(t, 0L, (a, x) -> a + x.w)"))
    d = d.select("id", "total", F.inline("t"))
    return d.select("id", F.col("pos").cast("long").alias("pos"), "token", F.expr(SPARK.ratio("w", "total")).alias("importance"))


def _line_scores(d: DataFrame) -> DataFrame:
    """Adds lines (line, w, and the first ten tokens with more than a thousandth of the total) and top, the function's greatest w."""
    from ..operators import places

    d = d.where("id IS NOT NULL").withColumn("lines", places.scored_lines(F.expr(heuristics.stripped(SPARK)), "id"))
    return d.withColumn("top", F.expr("array_max(transform(lines, x -> x.w))")).where("top > 0")


@_query("a20_line_scores", f"{_importance_sql()}, tot AS (SELECT id, sum(w) AS total FROM imp GROUP BY id), ln AS (SELECT i.id, line, sum(w)::BIGINT AS w, array_to_string((list(token ORDER BY pos) FILTER (1000 * w > total))[1:10], ' ') AS tokens FROM imp i JOIN tot t ON i.id = t.id GROUP BY i.id, line) SELECT id, line, w, {DUCK.ratio('w', 'max(w) OVER (PARTITION BY id)')} AS normalized, coalesce(tokens, '') AS tokens FROM ln QUALIFY max(w) OVER (PARTITION BY id) > 0")
def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _line_scores(corpus.dealt(spark, sf_dir).select("id", "code")).select("id", "top", F.inline("lines"))
    return d.select("id", "line", "w", F.expr(SPARK.ratio("w", "top")).alias("normalized"), "tokens")


@_query(
    "m9_highlights",
    f"{_importance_sql()}, g AS (SELECT id, {SCORE} AS score FROM functions WHERE {SCORE} >= {THRESHOLD + 50}), ln AS (SELECT i.id, line, sum(w)::BIGINT AS w FROM imp i JOIN g ON i.id = g.id GROUP BY i.id, line), n AS (SELECT id, line, w, max(w) OVER (PARTITION BY id) AS top, row_number() OVER (PARTITION BY id ORDER BY w DESC, line) AS place FROM ln) SELECT n.id, line, place, w, trim(string_split(f.code, chr(10))[line])[1:100] AS snippet FROM n JOIN functions f ON n.id = f.id WHERE top > 0 AND place <= 5 AND (10 * w >= 3 * top OR place = 1)",
)
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9, K6: for scores well above the threshold, the five lines of most weight with at least 0.3 of the greatest."""
    d = corpus.dealt(spark, sf_dir).where(f"{SCORE} >= {THRESHOLD + 50}").select("id", "code")
    ordered = F.expr("slice(array_sort(transform(lines, x -> named_struct('neg', -x.w, 'line', x.line))), 1, 5)")
    d = _line_scores(d).select("id", "top", F.split("code", "\n").alias("l"), ordered.alias("o"))
    d = d.select("id", "top", "l", F.posexplode("o").alias("k", "x")).where("10 * -x.neg >= 3 * top OR k = 0")
    return d.select("id", "x.line", (F.col("k") + 1).cast("long").alias("place"), (-F.col("x.neg")).alias("w"), F.expr("substring(trim(get(l, cast(x.line - 1 AS int))), 1, 100)").alias("snippet"))


@_query(
    "m10b_slice_attention",
    f"{_SCORED}, s AS (SELECT id, unnest(range(0, 6)) AS slice, score FROM scored), x AS (SELECT id, slice, ((score * 7 + slice * 131) % 400)::DOUBLE / 100.0::DOUBLE AS logit, slice < score % 7 AS valid FROM s), e AS (SELECT *, CASE WHEN valid THEN exp(logit - max(CASE WHEN valid THEN logit END) OVER (PARTITION BY id)) ELSE 0 END AS p, count(*) FILTER (valid) OVER (PARTITION BY id) AS n FROM x) SELECT id, slice, round(CASE WHEN n = 0 THEN 1.0::DOUBLE / 6 ELSE p / sum(p) OVER (PARTITION BY id) END, 6) AS weight FROM e",
)
def slice_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A masked softmax over the slices of a function, uniform where everything is masked; within the row's array."""
    x = "transform(sequence(0, 5), s -> named_struct('logit', cast((score * 7 + s * 131) % 400 AS double) / 100D, 'valid', s < score % 7))"
    d = scored(spark, sf_dir).select("id", F.expr(x).alias("x")).withColumn("m", F.expr("array_max(transform(filter(x, y -> y.valid), y -> y.logit))"))
    d = d.withColumn("p", F.expr("transform(x, y -> IF(y.valid, exp(y.logit - m), 0D))")).withColumn("total", F.expr("aggregate(p, 0D, (a, y) -> a + y)"))
    d = d.select("id", "total", F.posexplode("p").alias("slice", "p"))
    return d.select("id", F.col("slice").cast("long").alias("slice"), F.expr("round(IF(total = 0, 1D / 6, p / total), 6)").alias("weight"))


def _train(spark: SparkSession, sf_dir: str):
    """The 26 features as a vector, z-scored, with label and split; counted once and written, as scaler, fit and scores each read them."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from ..operators import defences

    d = corpus.dealt(spark, sf_dir).select("id", "code", "split", F.col("target").cast("double").alias("label"))
    path = f"{corpus.scratch(spark)}/korvine-features-{uuid.uuid4().hex}"
    d = rule_plans.with_defences(d, "id", "split", "label")
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    d = VectorAssembler(inputCols=defences.NAMES, outputCol="raw").transform(d)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(d.where("split = 'train'"))
    return scaler.transform(d)


@_query("m10a_feature_model", None)
def feature_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10a, M11d: a logistic regression over the 26 features in place of the neural model; its scores on all rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    d = _train(spark, sf_dir)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(d.where("split = 'train'"))
    return model.transform(d).select("id", "split", "label", F.round(vector_to_array("probability")[1], 4).alias("probability"))


@_query("m10c_token_noise", f"WITH {corpus.CTE}, t AS (SELECT id, unnest(range(0, 40)) AS pos FROM functions), i AS (SELECT id, pos, (id * 7 + pos * 11) % 90 AS token_id FROM t), r AS (SELECT *, (id * 131 + pos * 71) % 100 AS u FROM i) SELECT id, string_agg(CASE WHEN token_id > 3 AND u < 7 THEN 0 WHEN token_id > 3 AND u < 12 THEN 1 ELSE token_id END::VARCHAR, ' ' ORDER BY pos) AS ids FROM r GROUP BY id")
def token_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed token dropout to <PAD> and masking to <UNK>, specials left alone."""
    ids = "transform(sequence(0L, 39L), p -> named_struct('t', (id * 7 + p * 11) % 90, 'u', (id * 131 + p * 71) % 100))"
    d = corpus.synthetic(spark, sf_dir).select("id", F.expr(ids).alias("x"))
    return d.select("id", F.expr("array_join(transform(x, y -> cast(CASE WHEN y.t > 3 AND y.u < 7 THEN 0 WHEN y.t > 3 AND y.u < 12 THEN 1 ELSE y.t END AS string)), ' ')").alias("ids"))
