"""Language ID by Bayesian evidence fusion.

posterior(language) ~ host prior x P(declared language | language) x P(address suffix | language) x text likelihood.
The text likelihood is a naive Bayes model over hashed byte trigrams of the whole text, tempered so that a long text
does not drown the rest. Host priors are smoothed hierarchically (host, then its domain, then all), and these and the two
conditionals come from grouped aggregations over all rows, in which each row with letters votes for its most likely language by
text. A row's own vote is taken out of the counts that judge it.

The trigram model is fitted on a bounded sample of labelled rows (SAMPLE rows, the least by hash of the id). Every label of the
sample can be an answer. Everything else uses all rows.

Nulls: a null text is empty; null declared language, host and suffix give no evidence. A text without letters has no
language (null, probability 0). Ties go to the first language by name. Repeated rows are judged alike. Columns of any name stay.
Empty tables: no rows; without labelled rows no language.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, mix64, ship, small_batches

SAMPLE = 4000
BUCKETS = 1 << 16
#: Languages up to which the model has BUCKETS buckets; with more it has fewer, so that its size is bounded.
FULL = 64
#: Trigrams beyond these count less: the log likelihood of a text is its mean times at most so many.
MOST_TRIGRAMS = 200
#: Documents that a domain's, or all hosts', prior counts for; the same for a conditional's uniform part.
PRIOR_ROWS, CONDITIONAL_ROWS = 20.0, 2.0
LEAST_POSTERIOR = 0.7
_CHUNK = 1 << 20

# Letters in lower case, digits as one class, all other ASCII as a space; bytes of longer characters stay.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[128:] = np.arange(128, 256)
_CLASS[48:58] = 48
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_ENDS = b"  "


@dataclass(frozen=True)
class Model:
    """Log probabilities of trigram buckets, by language."""

    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages, float32

    def buckets(self, code: np.ndarray) -> np.ndarray:
        return code & (len(self.weights) - 1)


def n_buckets(languages: int) -> int:
    return BUCKETS >> max(0, math.ceil(math.log2(max(languages, 1) / FULL))) if languages > FULL else BUCKETS


def trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, whether it holds a letter) of each byte trigram."""
    b = _CLASS[np.frombuffer(data, np.uint8)].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(16)
    letter = (b > 48) & (b != 32)
    return code.astype(np.int64), letter[:-2] | letter[1:-1] | letter[2:]


def fit(rows: DataFrame) -> Model:
    """The trigram model from labelled `rows` (lang, text), a bounded sample: a histogram for each language comes back."""
    labelled = rows.where("lang IS NOT NULL")
    names = tuple(sorted(r[0] for r in labelled.select("lang").distinct().collect()))  # as many as the sample has rows at most
    size = n_buckets(len(names))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf.lang, pdf.text, strict=True):
                code, letter = trigrams(_ENDS + (text or "").encode() + _ENDS)
                held = total.setdefault(lang, np.zeros(size, np.int64))
                held += np.bincount(code[letter] & (size - 1), minlength=size)
        yield pd.DataFrame({"lang": list(total), "counts": [x.astype("<u4").tobytes() for x in total.values()]})

    counts = np.zeros((len(names), size))
    if names:
        for r in labelled.select("lang", "text").coalesce(4).mapInPandas(count, "lang string, counts binary").collect():
            counts[names.index(r.lang)] += np.frombuffer(r.counts, "<u4")
    p = counts + 0.1
    p /= p.sum(1, keepdims=True) if len(names) else 1
    return Model(names, np.log(p).T.astype(np.float32).copy())


def sample(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """At most `rows` labelled rows (lang, text) of `docs` (doc_id, lang, text), the least by hash of doc_id.

    A histogram of the hash's first 12 bits tells how far to go, so that only about as many ids are put in order.
    """
    key = F.md5(F.col("doc_id").cast("string"))
    ids = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", key.alias("key"), F.substring(key, 1, 3).alias("head"))
    held = ids.groupBy("head").count()  # 4096 rows at most
    upto = held.withColumn("before", F.sum("count").over(Window.orderBy("head")) - F.col("count"))
    last = upto.where(F.col("before") < rows).agg(F.max("head")).first()[0] or ""
    ids = ids.where(F.col("head") <= last).orderBy("key", "doc_id").limit(rows).select("doc_id")
    return materialize(docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("lang", "text"))  # bounded by `rows`


def score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tempered log likelihoods, texts x languages; trigrams with a letter) of whole texts."""
    ll, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        data = _ENDS + text.encode() + _ENDS
        for lo in range(0, len(data) - 2, _CHUNK):  # a very long text goes in parts that overlap by two bytes
            code, letter = trigrams(data[lo : lo + _CHUNK + 2])
            code = model.buckets(code[letter])
            n[i] += len(code)
            if len(code):
                ll[i] += model.weights[code].sum(0)
    return ll * (np.minimum(n, MOST_TRIGRAMS) / np.maximum(n, 1))[:, None], n


# ---- evidence -------------------------------------------------------------------------------------------------------


_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def visible(page: str) -> str:
    """The text of an HTML page."""
    return html_lib.unescape(_DROP.sub(" ", page))


def page_evidence(pages: DataFrame) -> DataFrame:
    """id, text (html), declared, suffix, host, domain of `pages` (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    none = lambda c: F.when(c != "", c)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    return pages.select(
        F.col("page_id").alias("id"), F.col("html").alias("text"), none(declared).alias("declared"), none(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"),
        none(host).alias("host"), none(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """The same of `docs` (doc_id, text, lang, source): a source is the host; its name without digits the domain."""
    return docs.select(
        F.col("doc_id").alias("id"), "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"),
        F.col("source").alias("host"), F.regexp_replace("source", "[0-9]+$", "").alias("domain"),
    )


def votes(rows: DataFrame, model: Model, html: bool) -> DataFrame:
    """id, declared, suffix, host, domain, n, ll of rows of evidence; the text is read here and goes no further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ll, n = score(model, [visible(t or "") if html else t or "" for t in pdf.text])
            yield pdf.drop(columns="text").assign(n=n, ll=list(ll))

    r = rows.select(F.col("id").cast("string").alias("id"), "declared", "suffix", "host", "domain", "text")  # pandas would make longs with nulls doubles
    out = r.mapInPandas(run, "id string, declared string, suffix string, host string, domain string, n long, ll array<double>")
    return out.withColumn("id", F.col("id").cast("long"))


def tally(narrow: DataFrame, languages: int) -> DataFrame:
    """declared, suffix, host, domain, votes (by language): how many rows with letters vote for each."""
    v = narrow.where("n > 0").select("declared", "suffix", "host", "domain", F.expr("cast(array_position(ll, array_max(ll)) - 1 AS int)").alias("vote"))
    counted = v.groupBy("declared", "suffix", "host", "domain", "vote").agg(F.count("*").cast("double").alias("c"))
    votes_of = F.expr(f"aggregate(collect_list(struct(vote, c)), array_repeat(0D, {languages}), (a, x) -> transform(a, (y, i) -> IF(i = x.vote, y + x.c, y)))")
    return counted.groupBy("declared", "suffix", "host", "domain").agg(votes_of.alias("votes"))


def _summed(tallied: DataFrame, key: str | None, name: str, languages: int) -> DataFrame:
    """key, the votes of all rows with it: one value for each language."""
    t = tallied if key is None else tallied.where(F.col(key).isNotNull())
    sums = [F.sum(F.col("votes")[k]).alias(f"v{k}") for k in range(languages)]
    g = t.groupBy(key).agg(*sums) if key else t.agg(*sums)
    return g.select(*([key] if key else []), F.array(*[F.coalesce(F.col(f"v{k}"), F.lit(0.0)) for k in range(languages)]).alias(name))


@dataclass(frozen=True)
class Fusion:
    """What holds for all rows: votes by language, and how many values declared languages and suffixes have."""

    total: tuple[float, ...]
    n_declared: int
    n_suffix: int


def evidence(narrow: DataFrame, model: Model) -> tuple[DataFrame, Fusion]:
    """(declared, suffix, host, domain and the votes h, d, l, s of their host, domain, declared language and suffix; what holds for all)."""
    n = len(model.languages)
    t = materialize(tally(narrow, n))
    total = _summed(t, None, "total", n).first()[0]  # a number for each language
    values = t.agg(F.countDistinct("declared"), F.countDistinct("suffix")).first()
    combos = narrow.select("declared", "suffix", "host", "domain").distinct()
    j = combos.join(_summed(t, "host", "h", n), "host", "left").join(_summed(t, "domain", "d", n), "domain", "left").join(_summed(t, "declared", "l", n), "declared", "left").join(_summed(t, "suffix", "s", n), "suffix", "left")
    return materialize(j.select("declared", "suffix", "host", "domain", "h", "d", "l", "s")), Fusion(tuple(total), max(values[0], 1), max(values[1], 1))


def _matrix(column: list, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x languages, whether a row has votes)."""
    held = np.array([x is not None for x in column], bool)
    out = np.zeros((rows, k))
    if held.any():
        out[held] = np.array([x for x in column if x is not None], float)
    return out, held


def posterior(ll: np.ndarray, n: np.ndarray, votes_: dict[str, list], given: dict[str, np.ndarray], fusion: Fusion) -> np.ndarray:
    """Probabilities of each language: rows x languages. votes_: lists of votes (h, d, l, s) of each row, None where its key is null;
    given: whether a row has a declared language (l) and a suffix (s). A row that votes is left out of all counts."""
    rows, k = ll.shape
    own = np.zeros((rows, k))
    cast = n > 0
    own[np.flatnonzero(cast), ll[cast].argmax(1)] = 1
    total = np.array(fusion.total) - own
    prior = (total + 1.0) / (total.sum(1, keepdims=True) + k)
    for c in ("d", "h"):
        v, held = _matrix(votes_[c], rows, k)
        v = np.where(held[:, None], np.maximum(v - own, 0), 0)
        shrunk = (v + PRIOR_ROWS * prior) / (v.sum(1, keepdims=True) + PRIOR_ROWS)
        prior = np.where(held[:, None], shrunk, prior)
    lp = ll + np.log(prior)
    for c, values in (("l", fusion.n_declared), ("s", fusion.n_suffix)):
        v, held = _matrix(votes_[c], rows, k)
        v = np.where(held[:, None], np.maximum(v - own, 0), 0)
        # P(value | language): its votes with this value, out of all its votes; the uniform part sums to one over the values
        p = np.log((v + CONDITIONAL_ROWS / (values + 1)) / (total + CONDITIONAL_ROWS))
        lp += np.where(given[c][:, None], p, 0)
    lp -= lp.max(1, keepdims=True)
    p = np.exp(lp)
    return p / p.sum(1, keepdims=True)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null, which then count as values."""
    marked = right.select(*[F.coalesce(F.col(k), F.lit("\0")).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.coalesce(left[k], F.lit("\0")) == marked[f"_{k}"] for k in keys]
    return left.join(marked, on, "left").drop(*[f"_{k}" for k in keys])


KEYS = ["declared", "suffix", "host", "domain"]


def identify(rows: DataFrame, model: Model, html: bool = False) -> DataFrame:
    """id, declared, suffix, host, domain, n, lang, probability of rows of evidence."""
    small_batches(rows.sparkSession)
    narrow = materialize(votes(rows, model, html))
    if not model.languages:
        return narrow.drop("ll").withColumn("lang", F.lit(None).cast("string")).withColumn("probability", F.lit(0.0))
    ev, fusion = evidence(narrow, model)
    names = np.array(model.languages, object)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            ll, n = np.stack(pdf.ll.to_list()), pdf.n.to_numpy()
            p = posterior(ll, n, {c: list(pdf[c]) for c in "hdls"}, {"l": pdf.declared.notna().to_numpy(), "s": pdf.suffix.notna().to_numpy()}, fusion)
            best = p.argmax(1)
            yield pdf[["id", "declared", "suffix", "host", "domain", "n"]].assign(lang=np.where(n > 0, names[best], None), probability=np.where(n > 0, p[np.arange(len(p)), best], 0.0))

    j = _joined(narrow.withColumn("id", F.col("id").cast("string")), ev, KEYS)
    out = j.mapInPandas(decide, "id string, declared string, suffix string, host string, domain string, n long, lang string, probability double")
    return out.withColumn("id", F.col("id").cast("long"))


def accepted_documents(docs: DataFrame, model: Model, least: float = LEAST_POSTERIOR) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source, ...), all columns, whose language is clear.

    The text is scored twice, so that texts need not be written or shuffled: once for the votes, once to decide.
    """
    names = docs.columns
    if not model.languages:  # without a labelled row no language is clear
        return docs.where(F.lit(False))
    small_batches(docs.sparkSession)
    ev, fusion = evidence(materialize(votes(document_evidence(docs), model, False)), model)
    # the rows keep their columns in a struct, so that no name clashes
    keyed = docs.select(F.struct(*names).alias("_row"), F.col("text").alias("text"), F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.regexp_replace("source", "[0-9]+$", "").alias("domain"))
    joined = _joined(keyed, ev, KEYS).select("_row", "text", "declared", "h", "d", "l", "s")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ll, n = score(model, [t or "" for t in batch.column("text").to_pylist()])
            declared = np.array([x is not None for x in batch.column("declared").to_pylist()], bool)
            p = posterior(ll, n, {c: batch.column(c).to_pylist() for c in "hdls"}, {"l": declared, "s": np.zeros(len(n), bool)}, fusion)
            ok = pa.array((n > 0) & (p.max(1) >= least))
            rows = batch.column("_row").filter(ok)
            yield pa.RecordBatch.from_arrays(rows.flatten(), names)

    return joined.mapInArrow(keep, docs.schema)


ship(__name__)
