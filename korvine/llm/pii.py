"""Personal data: exact patterns, and a skip-chain conditional random field that carries their labels on.

The patterns give the base spans. The nodes of the field are the tokens of a document that overlap a base span, hold a
digit or an at sign, or are like a base token in other letters, separators or but for a character. Neighbours are joined by chain
edges; equal and similar tokens, however far apart, share potentials: each has a skip edge to every occurrence of its keys in a base
span, and the others of a key, if more than two, are joined through a hub, a node without a token of its own. Potentials of skip
edges grow with the length of what is shared, so that short tokens say little and none is left out. Loopy belief propagation
(sum-product, damped) then gives each node a label; nodes of base spans are clamped. Tokens outside the base spans with a label of
enough belief become added spans.

Weights are fitted (`fit`) by maximum pseudo-likelihood with a normal prior around WEIGHTS, on a bounded sample of documents
(SAMPLE, the least by hash of the id) labelled by their base spans: each token given its neighbours' labels and those of its other
occurrences. Every second token, by its number, is shown without its own form and equal tokens, as a mention in a form that no pattern knows.

Nulls: a null text is empty and has no spans; a null doc_id stays null. Repeated rows give repeated results. Empty table:
no rows, and WEIGHTS. Offsets are code points, with the end exclusive. A document is one task's work, whatever its length; edges are
linear in the tokens (those to clamped nodes are counts by label, the others lead to hubs).
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import ship, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Log potentials, as the prior has them: what no evidence counts for, hints of a token's form, agreement along edges; clamped base spans.
WEIGHTS = {"none": 3.0, "at_sign": 1.5, "address": 1.5, "long_number": 1.0, "phone_form": 2.0, "digits": 0.3, "chain": 0.6, "skip": 4.5, "similar": 3.5, "clamp": 30.0}
BELIEF, ROUNDS, DAMPING = 0.6, 200, 0.3
#: Documents that weights are fitted on, at most; standard deviation of the prior around WEIGHTS.
SAMPLE, PRIOR_SD = 2000, 1.0
FITTED = ("none", "at_sign", "address", "long_number", "phone_form", "digits", "chain", "skip", "similar")
#: Characters that a key must have for the whole potential.
WHOLE_KEY = 8

#: The patterns of the contract.
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_PHONE_FORM = re.compile(r"\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.][0-9]{4}")
_SEPARATED = re.compile(r"[0-9][0-9.,:/_-]*")
_IP_FORM = re.compile(r"[0-9]{1,3}([.,:_-][0-9]{1,3}){3}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign to the left and right, so that long runs without one cost nothing."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL_RIGHT.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in DOTTED.finditer(text):  # runs of numbers and dots, in which matches are every four numbers from the left: linear
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x) <= 3 or len(x.lstrip("0")) <= 3 for x in four) and all(int(x.lstrip("0") or 0) <= 255 for x in four):
                out.append(("ip", at, end))
            at = end + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- the field ---------------------------------------------------------------------------------------------------------


def _bare(token: str) -> str:
    return token.strip("\"'()[]{}<>,.;:!?").lower()


def keys_of(token: str) -> list[tuple[str, bool, float]]:
    """(key, whether equal keys mean equal tokens, share of the whole potential): the token without case and outer marks, its digits,
    the last of them, its local part."""
    bare = _bare(token)
    digits = "".join(c for c in bare if c in "0123456789")
    out = {}
    for key, text, equal in ((f"t:{bare}", bare, True), (f"d:{digits}", digits, False), (f"l:{digits[-7:]}" if len(digits) >= 7 else "", digits[-7:], False), (f"t:{bare.partition('@')[0]}" if "@" in bare else "", bare.partition("@")[0], False)):
        if text and key and key not in out:
            out[key] = (key, equal, min(1.0, len(text) / WHOLE_KEY))
    return list(out.values())


def near_keys(token: str) -> list[str]:
    """Keys that tokens of eight characters or more share if deleting one character at most from each makes them equal."""
    bare = _bare(token)
    if not 8 <= len(bare) <= 64:
        return []
    return [f"n:{bare}", *{f"n:{bare[:i]}{bare[i + 1 :]}" for i in range(len(bare))}]


def form(token: str) -> np.ndarray:
    """Which hints of form a token has, for each label: labels x FITTED."""
    f = np.zeros((len(LABELS), len(FITTED)))
    f[0, 0] = 1
    bare = _bare(token)
    number = "".join(c for c in bare if c in "0123456789")
    if "@" in bare.strip("@"):
        f[1, 1] = 1
    # in other separators, but with what the kind asks of its digits
    if _IP_FORM.fullmatch(bare) and all(int(x) <= 255 for x in re.findall("[0-9]+", bare)):
        f[2, 2] = 1
    if 13 <= len(number) <= 19 and _SEPARATED.fullmatch(bare) and luhn(number):
        f[3, 3] = 1
    if _PHONE_FORM.fullmatch(bare):
        f[4, 4] = 1
    elif number:
        f[1:, 5] = 1
    return f


def beliefs(u: np.ndarray, edges: np.ndarray, weight: np.ndarray, same_none: np.ndarray) -> np.ndarray:
    """Marginals by loopy sum-product. Edge potentials: `weight` where labels agree (0 for none unless `same_none`)."""
    n, k = u.shape
    if not len(edges):
        b = u
    else:
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        m = len(edges)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        w, sn = np.concatenate([weight, weight]), np.concatenate([same_none, same_none])
        gain = np.exp(w)[:, None] * np.ones((1, k)) - 1.0
        gain[:, 0] = np.where(sn, np.exp(w) - 1.0, 0.0)
        msg = np.zeros((2 * m, k))
        for _ in range(ROUNDS):
            total = u.copy()
            np.add.at(total, dst, msg)
            out = total[src] - msg[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(out.sum(1, keepdims=True) + gain * out)
            new -= new.max(1, keepdims=True)
            step = np.abs(new - msg).max()
            msg = DAMPING * msg + (1 - DAMPING) * new
            if step < 1e-4:
                break
        b = u.copy()
        np.add.at(b, dst, msg)
    b = np.exp(b - b.max(1, keepdims=True))
    return b / b.sum(1, keepdims=True)


def _nodes(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, str, int]]:
    """(start, end, number of the token, token, label of a base span) of the tokens that take part."""
    covered = sorted((s, e, KINDS.index(k) + 1) for k, s, e in base)
    wanted = {key for _, s, e in base for t in TOKEN.findall(text[s:e]) for key, _, _ in keys_of(t)}
    near = {key for _, s, e in base for t in TOKEN.findall(text[s:e]) for key in near_keys(t)}
    nodes = []
    j, reach, held = 0, 0, 0  # of the base spans that begin before a token's end: the furthest end and its label
    for number, m in enumerate(TOKEN.finditer(text)):
        s, e = m.span()
        while j < len(covered) and covered[j][0] < e:
            if covered[j][1] > reach:
                _, reach, held = covered[j]
            j += 1
        label = held if reach > s else 0
        token = m[0]
        if label or any(c in token for c in "0123456789@") or (wanted and any(key in wanted for key, _, _ in keys_of(token))) or (near and any(key in near for key in near_keys(token))):
            nodes.append((s, e, number, token, label))
    return nodes


def _clamped(nodes: list) -> tuple[dict, dict]:
    """(votes of base tokens by key: (similar, equal) x labels; labels of base tokens by near key)."""
    votes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((2, len(LABELS))))
    near: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LABELS)))
    for _, _, _, token, label in nodes:
        if label:
            for key, equal, _ in keys_of(token):
                votes[key][int(equal), label] += 1
            for key in near_keys(token):
                near[key][label] += 1
    return votes, near


def _shared(token: str, label: int, votes: dict, near: dict) -> tuple[np.ndarray, np.ndarray]:
    """(equal, similar): how much base tokens, but for the token itself, share with it, by label; similar: by its best key."""
    equal_, similar_ = np.zeros(len(LABELS)), np.zeros(len(LABELS))
    for key, equal, share in keys_of(token):
        if key in votes:
            similar, same = votes[key]
            if label:  # without itself
                similar, same = similar.copy(), same.copy()
                (same if equal else similar)[label] -= 1
            if equal:
                equal_ += share * same
                similar_ = np.maximum(similar_, share * similar)
            else:
                similar_ = np.maximum(similar_, share * (similar + same))
    own = set(near_keys(token)) if near else ()
    for key in own:
        if key in near:
            n = near[key].copy()
            if label:
                n[label] -= 1
            similar_ = np.maximum(similar_, n > 0)
    return equal_, similar_


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float] | None = None) -> list[tuple[str, int, int]]:
    """What the field labels outside the base spans."""
    weights = weights or WEIGHTS
    nodes = _nodes(text, base)
    if all(x[4] for x in nodes):
        return []
    w = np.array([weights[f] for f in FITTED])
    votes, near = _clamped(nodes)
    u = np.zeros((len(nodes), len(LABELS)))
    edges, weight, same_none = [], [], []
    others: dict[str, list[tuple[int, bool, float]]] = defaultdict(list)
    for i, (_, _, number, token, label) in enumerate(nodes):
        if label:
            u[i, label] = WEIGHTS["clamp"]
        else:
            equal, similar = _shared(token, 0, votes, near)
            u[i] = form(token) @ w + weights["skip"] * equal + weights["similar"] * np.where(equal > 0, 0, similar)
            for key, same, share in keys_of(token):
                others[key].append((i, same, share))
        if i and nodes[i - 1][2] == number - 1:
            edges.append((i - 1, i))
            weight.append(weights["chain"])
            same_none.append(False)
    hubs = 0
    for held in others.values():
        if len(held) == 2:
            (i, x, share), (j, y, _) = held
            edges.append((i, j))
            weight.append(share * weights["skip" if x and y else "similar"])
            same_none.append(True)
        elif len(held) > 2:
            for i, same, share in held:
                edges.append((len(nodes) + hubs, i))
                weight.append(share * weights["skip" if same else "similar"])
                same_none.append(True)
            hubs += 1
    u = np.concatenate([u, np.zeros((hubs, len(LABELS)))])
    b = beliefs(u, np.array(edges).reshape(-1, 2), np.array(weight), np.array(same_none, bool))
    out = []
    for i, (s, _, _, token, label) in enumerate(nodes):
        k = int(b[i].argmax())
        bare = token.strip("\"'()[]{}<>,.;:!?")
        if not label and k and b[i, k] >= BELIEF and bare:
            at = s + token.index(bare)
            out.append((KINDS[k - 1], at, at + len(bare)))
    return out


def find(text: str, weights: dict[str, float] | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, each by kind as listed, then start."""
    if not any(c in text for c in "0123456789@"):
        return [], []
    base = base_spans(text)
    more = added_spans(text, base, weights)
    order = lambda x: (KINDS.index(x[0]), x[1])
    return base, sorted(base + more, key=order)


# ---- weights --------------------------------------------------------------------------------------------------------------


def instances(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(labels, features: rows x labels x FITTED) of the tokens of a text, each given the labels of all others."""
    base = base_spans(text) if any(c in text for c in "0123456789@") else []
    nodes = _nodes(text, base) if base else []
    votes, near = _clamped(nodes)
    f = np.zeros((len(nodes), len(LABELS), len(FITTED)))
    y = np.array([x[4] for x in nodes], np.int64)
    for i, (_, _, number, token, label) in enumerate(nodes):
        equal, similar = _shared(token, label, votes, near)
        f[i] = form(token)
        if i % 2:  # as a mention in another form would be: it has no form that tells, and no equal token
            f[i, :, 1:], equal = 0, np.zeros(len(LABELS))
        f[i, :, FITTED.index("skip")], f[i, :, FITTED.index("similar")] = np.minimum(equal, 3), np.minimum(np.where(equal > 0, 0, similar), 3)
        for j in (i - 1, i + 1):
            if 0 <= j < len(nodes) and nodes[j][2] - number == j - i and nodes[j][4]:
                f[i, nodes[j][4], FITTED.index("chain")] += 1
    return y, f


def sample(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """At most `rows` texts of `docs` (doc_id, text) that can have a base span, the least by hash of the id."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = docs.where(F.col("text").rlike("[@0-9]")).select("text", key.alias("key"), F.substring(key, 1, 3).alias("head"))
    held = d.groupBy("head").count()  # 4096 rows at most
    upto = held.withColumn("before", F.sum("count").over(Window.orderBy("head")) - F.col("count"))
    last = upto.where(F.col("before") < rows).agg(F.max("head")).first()[0] or ""
    return d.where(F.col("head") <= last).orderBy("key", F.md5("text")).limit(rows).select("text")


def fit(texts: DataFrame, steps: int = 60) -> dict[str, float]:
    """Weights from a bounded sample of `texts` (text): Newton steps on the pseudo-likelihood; what repeats is counted before it comes here."""
    shape = (len(LABELS), len(FITTED))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, bytes], int] = defaultdict(int)
        for pdf in batches:
            for text in pdf.text:
                y, f = instances(text or "")
                for k, x in zip(y.tolist(), np.round(f, 1), strict=True):
                    held[k, x.astype("<f4").tobytes()] += 1
        yield pd.DataFrame({"label": [k for k, _ in held], "x": [x for _, x in held], "n": list(held.values())})

    got = texts.mapInPandas(count, "label int, x binary, n long").groupBy("label", "x").agg(F.sum("n").alias("n")).collect()  # kinds of tokens
    if not got:
        return dict(WEIGHTS)
    y = np.array([r.label for r in got])
    x = np.stack([np.frombuffer(bytes(r.x), "<f4").reshape(shape) for r in got]).astype(float)
    n = np.array([r.n for r in got], float)
    n *= min(1.0, 2000 / n.sum())  # tokens of one text are no independent cases
    mean = np.array([WEIGHTS[f] for f in FITTED])
    w = mean.copy()
    for _ in range(steps):
        s = x @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        expected = (p[:, :, None] * x).sum(1)
        grad = (n[:, None] * (x[np.arange(len(y)), y] - expected)).sum(0) - (w - mean) / PRIOR_SD**2
        second = np.einsum("r,rk,rki,rkj->ij", n, p, x, x) - np.einsum("r,ri,rj->ij", n, expected, expected) + np.eye(len(w)) / PRIOR_SD**2
        step = np.linalg.solve(second, grad)
        w += step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    edges = {"chain", "skip", "similar"}
    return WEIGHTS | {f: float(max(v, 0.0) if f in edges else v) for f, v in zip(FITTED, np.round(w, 6), strict=True)}


def scan(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_<kind> of the base spans, base_sha256, spans (kind:start:end, joined), n_spans (of all)."""
    schema = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = defaultdict(list)
            for text in pdf.text:
                base, every = find(text or "", weights)
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(x[0] == k for x in base))
                rows["base_sha256"].append(hashlib.sha256(join(base).encode()).hexdigest())
                rows["spans"].append(join(every))
                rows["n_spans"].append(len(every))
            if len(pdf):
                yield pd.DataFrame({"doc_id": pdf.doc_id, **rows})

    small_batches(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)  # pandas would make longs with nulls doubles
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


ship(__name__)
