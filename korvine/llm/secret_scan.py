"""Secret scans over a trigram inverted index. SQL functions only.

From each rule's regex a Boolean query over trigrams is derived: every match contains the trigrams that the query asks
for. The index has the postings (trigram, text) of all trigrams that some query names, over case-folded texts; a rule's
candidates are the texts whose postings satisfy its query. Candidates are verified with the regex itself. A rule
without mandatory trigrams (a run of hexadecimal digits, say) scans every text.

A text is known by its 64-bit hash in the index; texts of equal hash share postings, which only adds candidates.
Nulls: a null text is empty and has no spans; a null doc_id stays null. Repeated rows give repeated results. Empty
table: no rows. Offsets are code points, with the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame, functions as F

from .common import hash_map, marked, materialize, salted_join


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to find, and how many characters of which group a match must have."""

    kind: str
    regex: str
    least: int = 1
    group: int = 0
    base: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{either_case('api')}_?{either_case('key')}"
#: The kinds of the contract come first, in its order.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", "(AKIA[A-Z0-9]+)", 20, 0, True),
    Rule("hex", "([0-9a-f]+)", 24, 0, True),
    Rule("github", "(gh[pousr]_[A-Za-z0-9]+)", 40),
    Rule("slack", "(xox[abprs]-[A-Za-z0-9-]+)", 15),
    Rule("live_key", "([sr]k_live_[0-9A-Za-z]+)", 24),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 36),
    Rule("private_key", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 27),
)

#: Rows of one text from which on their join with the text's rules is dealt over several tasks.
HOT = 256

# ---- trigram queries: True (no information), a trigram, ("and", ...) or ("or", ...) ------------------------------------

_MOST_EXACT = 32


def _both(op: str, items: list) -> object:
    """The conjunction or disjunction of some queries, simplified."""
    if op == "or" and any(x is True for x in items):
        return True
    flat = {y for x in items if x is not True for y in (x[1:] if isinstance(x, tuple) and x[0] == op else (x,))}
    if op == "or":  # what asks for more than another alternative adds nothing
        asked = {x: {x} if isinstance(x, str) else set(x[1:]) for x in flat}
        flat = {x for x in flat if not any(asked[y] < asked[x] for y in flat)}
    flat = sorted(flat, key=repr)
    return True if not flat else flat[0] if len(flat) == 1 else (op, *flat)


def _of_strings(strings: set[str]) -> object:
    """What a text that has one of these strings must hold."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(parsed: object) -> tuple[set[str] | None, object]:
    """(all strings that a parsed regex matches, case-folded, or None if too many; its query)."""
    run, query = {""}, []

    def flush() -> None:
        query.append(_of_strings(run))

    for op, arg in parsed:
        if op is C.LITERAL:
            strings, q = {chr(arg).lower()}, True
        elif op is C.IN and all(x[0] is C.LITERAL for x in arg) and len({chr(x[1]).lower() for x in arg}) <= 8:
            strings, q = {chr(x[1]).lower() for x in arg}, True
        elif op is C.SUBPATTERN:
            strings, q = _walk(arg[3])
        elif op is C.BRANCH:
            both = [_walk(x) for x in arg[1]]
            strings = set().union(*(b[0] for b in both)) if all(b[0] is not None for b in both) else None
            q = _both("or", [b[1] if b[0] is None else _of_strings(b[0]) for b in both])
        elif op is C.MAX_REPEAT:
            low, high, inner = arg
            strings, q = _walk(inner)
            if strings is not None and (low, high) == (0, 1):
                strings, q = strings | {""}, True
            elif strings is not None and low == high == 1:
                pass
            else:  # at least once, or perhaps not at all
                q = True if low == 0 else q if strings is None else _of_strings(strings)
                strings = None
        elif op is C.AT:
            continue
        else:
            strings, q = None, True
        if strings is not None and len(run) * len(strings) <= _MOST_EXACT:
            run = {a + b for a in run for b in strings}
            continue
        flush()
        run = {""}
        if strings is not None and len(strings) <= _MOST_EXACT:
            run = strings
        else:
            query.append(q if strings is None else _of_strings(strings))
    if not query:
        return run, True
    flush()
    return None, _both("and", query)


def trigram_query(regex: str) -> object:
    strings, query = _walk(_parser.parse(regex))
    return _of_strings(strings) if strings is not None else query


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(x) for x in query[1:]))


def satisfied(query: object, postings: Column) -> Column:
    """Whether a text with these trigrams is a candidate."""
    if isinstance(query, str):
        return F.array_contains(postings, query)
    parts = [satisfied(x, postings) for x in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


# ---- index, candidates, verification ------------------------------------------------------------------------------------


def postings(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index: (trigram, key) of each wanted trigram in each text of `texts` (key, text)."""
    low = texts.select("key", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in wanted]))
    return low.select(F.explode(found).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key, rules, copies: the numbers of the rules whose query a text's postings satisfy, and how many rows have the text."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.regex)) is not True}
    held = index.groupBy("key").agg(F.collect_set("trigram").alias("held"), F.count("*").alias("postings"))
    numbers = F.array_compact(F.array(*[F.when(satisfied(q, F.col("held")), F.lit(k)) for k, q in queries.items()]))
    return held.select("key", numbers.alias("rules"), F.expr("postings div size(held)").alias("copies")).where(F.size("rules") > 0)


def spans_of(rule: Rule, text: str = "text") -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e>>: their places follow from what lies between them."""
    re, t = F.lit(rule.regex), F.col(text)
    between = F.split(t, rule.regex, -1)
    whole, part = F.regexp_extract_all(t, re, F.lit(0)), F.regexp_extract_all(t, re, F.lit(rule.group))
    lengths = F.zip_with(F.zip_with(between, whole, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))), part, lambda x, g: F.struct(x["b"].alias("b"), x["m"].alias("m"), F.length(g).alias("g")))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<s:int,e:int>>)").alias("out"))
    step = lambda a, x: F.struct(
        (a["at"] + x["b"] + F.coalesce(x["m"], F.lit(0))).alias("at"),
        F.when(x["g"] >= rule.least, F.array_append(a["out"], F.struct((a["at"] + x["b"]).alias("s"), (a["at"] + x["b"] + x["m"]).alias("e")))).otherwise(a["out"]).alias("out"),
    )
    return F.aggregate(lengths, zero, step, lambda a: a["out"])


NONE = "cast(array() AS array<struct<s:int,e:int>>)"


def joined(spans: list[tuple[int, str, str]]) -> Column:
    """kind:start:end of some span columns (number, kind, column), by start, then number; comma-joined."""
    every = F.concat(*[F.expr(f"transform({c}, x -> struct(x.s AS s, {k} AS k, x.e AS e, '{kind}' AS kind))") for k, kind, c in spans])
    return F.array_join(F.transform(F.sort_array(every), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_<kind> of each rule, spans_<kind>, base (joined), spans (joined)."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("text"))
    wanted = sorted(set().union(*(trigrams(trigram_query(r.regex)) for r in rules)))
    found = materialize(candidates(postings(d, wanted), rules))
    # only candidates meet their rules; a map of fixed size lets all other texts stay where they are
    split = marked(d.withColumn("h", F.col("key")), hash_map(found.select(F.col("key").alias("h")))).drop("h")
    hot = found.where(f"copies > {HOT}").select(F.xxhash64("key").alias("h"))
    some = salted_join(split.where("in_map").drop("in_map"), found.select("key", "rules"), "key", hot, "left")
    d = some.select("doc_id", "text", "rules").unionByName(split.where("NOT in_map").select("doc_id", "text", F.expr("cast(NULL AS array<int>)").alias("rules")))
    for k, r in enumerate(rules):
        if trigram_query(r.regex) is True:  # only so that texts without any match skip the extraction
            may = F.col("text").rlike(r.regex.replace("+)", f"{{{r.least},}})") if r.regex.endswith("+)") and r.group == 0 else r.regex)
        else:
            may = F.coalesce(F.array_contains("rules", k), F.lit(False))
        d = d.withColumn(f"spans_{r.kind}", F.when(may, spans_of(r)).otherwise(F.expr(NONE)))
    numbered = [(k, r.kind, f"spans_{r.kind}") for k, r in enumerate(rules)]
    return d.select(
        "doc_id", *[F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules], *[f"spans_{r.kind}" for r in rules],
        joined([x for x, r in zip(numbered, rules, strict=True) if r.base]).alias("base"), joined(numbered).alias("spans"),
    )
