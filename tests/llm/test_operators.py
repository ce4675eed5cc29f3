"""The operators on small tables: brute force, round trips, odd rows."""

import re

import numpy as np
import pytest

from korvine.llm import exact_dedup, jaccard, language_id, line_dedup, mixing, packing, pii, quality, queries, secret_scan, warc

from ..compare import mismatch

SF = "/root/testdata/sf0.001"
ODD = [(1, "", "en", "a"), (2, None, None, None), (None, "one two three four five six", "en", "a"), (4, "x" * 5000 + " " + "word " * 3000, "en", "b"), (5, "same line of more than thirty characters\nsame line of more than thirty characters", "de", "b"), (5, "same line of more than thirty characters\nsame line of more than thirty characters", "de", "b"), (7, "same line of more than thirty charakters\nother", "de", None)]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert mismatch(spark, queries.queries()[name], queries.oracle_sql()[name], SF) == ""


def test_odd_rows_and_empty_tables(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    from korvine.llm.language_id import document_evidence, fit, identify, sample

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for rows in (ODD, []):
        d = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit(1)).withColumn("n", F.lit(2)).withColumn("key", F.lit("k"))
        n = len(rows)
        assert secret_scan.scan(d).count() == n
        out = exact_dedup.dedup(d, F.pmod(F.xxhash64("doc_id"), F.lit(2)), 2).collect()
        assert len(out) == n and sum(r.kept for r in out) == (5 if rows else 0)
        assert mixing.mix(d).count() == n and pii.scan(d).count() == n and quality.judge(d).count() == n
        assert identify(document_evidence(d), fit(sample(d))).count() == n
        r = line_dedup.rewritten(d)
        assert r.count() == n
        found = {x._row.doc_id: x.n_lost for x in r.collect()}
        assert not rows or (found[5], found[7]) == (1, 1)
        assert jaccard.classes(d).count() == n
        assert packing.pack_documents(d, path).select("doc_id", "piece").count() >= n
        pages = d.select(F.col("doc_id").alias("page_id"), F.lit("http://x.example/").alias("url"), F.col("text").alias("html"))
        back = warc.read(spark, warc.write(pages)).collect()
        assert len(back) == n


@pytest.mark.parametrize("rows", [512, 12])
def test_jaccard_components(spark, monkeypatch, rows):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", rows)
    rng = np.random.default_rng(3)
    base = [[f"w{rng.integers(10**6)}" for _ in range(120)] for _ in range(5)]
    docs = []
    for k in range(120):
        w = list(base[k % 5])
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(len(w))] = f"z{rng.integers(10**6)}"
        docs.append((k, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in docs]
    low = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(len(docs)):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and low[j] < low[i]:
                    low[i], changed = low[j], True
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(docs))] == low


def test_words_of_no_kin_are_not_linked(spark):
    """Words that polynomial hashes modulo 2^64 cannot tell apart, and ids that collide under one seed."""
    from pyspark.sql import functions as F

    low, high = "a", "b"
    for _ in range(10):
        low, high = low + high, high + low
    docs = spark.createDataFrame([(1, low), (2, high), (3, "x" * 8 + " " + "x" * 9), (4, "x" * 9 + " " + "x" * 8), (5, low)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert F is not None


def test_equal_ids_of_different_sets_are_told_apart(spark, monkeypatch):
    whole = jaccard.set_id

    def colliding(s, seed=0):
        a, b = whole(s, seed)
        return (7 if seed == 0 else a), b

    monkeypatch.setattr(jaccard, "set_id", colliding)
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, "one two three")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_near_lines(spark):
    from pyspark.sql import functions as F

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = np.random.default_rng(5)
    lines = []
    for _ in range(40):
        s = "".join(rng.choice(list("abcdefé ")) for _ in range(rng.integers(8, 60)))
        lines.append(s)
        for edits in (1, 2, 3):
            t = list(s)
            for _ in range(edits):
                at = int(rng.integers(1, len(t) - 1))
                kind = rng.integers(3)
                t[at : at + (kind != 1)] = [] if kind == 2 else ["z"]
            lines.append("".join(t))
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(lines)], SCHEMA)
    got = {r.doc_id for r in line_dedup.rewritten(docs).where("n_lost > 0").select("_row.doc_id").collect()}
    tau = lambda n: min(line_dedup.TAU, n // line_dedup.CHARS_PER_EDIT)
    want = {j for j in range(len(lines)) if any(distance(lines[i], lines[j]) <= tau(min(len(lines[i]), len(lines[j]))) for i in range(j))}
    assert got == want and F is not None


def test_bit_parallel_distance(spark):
    """The banded distance against the whole table of distances, for texts of any kind and bands of several widths."""
    import random

    rng = random.Random(1)

    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    pairs = []
    for _ in range(1500):
        s = [rng.choice("abé ") for _ in range(rng.randrange(3, 40))]
        t = list(s)
        for _ in range(rng.randrange(5)):
            at, kind = rng.randrange(max(len(t), 1)), rng.randrange(3)
            t[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice("abcé😀")]
        pairs.append(("".join(s), "".join(t)))
    for tau in (1, 2, 3):
        d = spark.createDataFrame(pairs, "s string, t string").where(f"abs(length(s) - length(t)) <= {tau} AND least(length(s), length(t)) >= {tau}")
        for r in d.select("s", "t", line_dedup.edit_distance("s", "t", tau).alias("d")).collect():
            want = whole(r.s, r.t)
            assert r.d == want if want <= tau else r.d > tau, (tau, r.s, r.t)


def test_short_lines_and_names_of_columns(spark):
    """Equal lines of any length go; columns named like the operator's own stay."""
    rows = [(1, "Yes.\nfirst"), (2, "Yes.\nsecond\n---"), (3, "no\n\n\n"), (4, "no"), (None, "Yes."), (6, "---\n x ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["lost", "n_lost", "_k", "_key", "_id", "_near", "_lines", "n_lines", "n_near", "h", "line_h"]
    for c in names:
        d = d.withColumn(c, d.doc_id)
    out = line_dedup.survivors(line_dedup.rewritten(d))
    assert out.columns == d.columns
    assert {(r.doc_id, r.text, r.lost) for r in out.collect()} == {(1, "Yes.\nfirst", 1), (2, "second\n---", 2), (3, "no\n\n\n", 3), (6, " x ", 6)}


def test_packing_round_trip(spark):
    lengths = np.random.default_rng(1).integers(1, 1024, 3000)
    which, offset = packing.pack(lengths)
    for b in np.unique(which):
        order = np.argsort(offset[which == b])
        ends = (offset[which == b] + lengths[which == b])[order]
        assert offset[which == b][order].tolist() == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert len(np.unique(which)) <= 1.01 * np.ceil(lengths.sum() / 1024) + 1


def test_packing_against_the_fewest_bins():
    """Small sets against the true optimum; bins of hundreds of tiny pieces; no step is left at the end."""
    from functools import lru_cache

    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = rng.integers(1, 11, rng.integers(1, 10))

        @lru_cache(None)
        def fewest(rest, room):
            if not rest:
                return 0
            best = 99
            for i in range(len(rest)):
                if i and rest[i] == rest[i - 1]:
                    continue
                left = rest[:i] + rest[i + 1 :]
                best = min(best, fewest(left, room - rest[i]) if rest[i] <= room else 1 + fewest(left, 12 - rest[i]))
            return best

        which, _ = packing.pack(lengths, 12)
        assert len(set(which.tolist())) <= 1 + fewest(tuple(sorted(lengths.tolist(), reverse=True)), 0)
    lengths = np.array([1] * 500 + [700] * 3 + [900, 1000, 333])
    bins = packing.local_search([list(range(500)), *[[k] for k in range(500, 506)]], lengths, 1024)
    assert sorted(k for b in bins for k in b) == list(range(506)) and len(bins) <= 6
    fills = sorted(int(lengths[b].sum()) for b in bins)
    assert all(x <= 1024 for x in fills)


def test_repeated_rows_are_dealt_over_groups(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(None, None)] * 300 + [(1, "one two three")] * 100, "doc_id long, text string")
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), group_pieces=50)
    rows = out.collect()
    assert len(rows) == 400
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by) >= 8
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(n for _, n in held) <= 1024


def test_tokens_are_those_of_the_vocabulary_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = packing.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("", "Ünï <|endoftext|> don't  \n\n x1 2", "日本語 text\t\ttabs " * 5):
        assert list(enc.encode_to_numpy(text, disallowed_special=())) == t.encode(text, add_special_tokens=False).ids


def test_special_tokens_are_those_of_the_vocabulary_file(spark):
    """Ids of the operator, against the other library as the file configures it."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["", "Uni <|endoftext|> don't", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>\n\n b", "<|endoftext", "<|endoftext|> 日本語 " * 700, "plain text"]
    wanted = []
    for k, text in enumerate(texts):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [packing.END_ID], "<u4")
        wanted += [(str(k), p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(packing.cut(len(ids), packing.CAPACITY))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, packing.pieces(docs, ranks).collect())) == sorted(wanted)


def test_fuse_filter_misses_no_key():
    keys = np.random.default_rng(2).integers(0, 2**63, 20_000, dtype=np.uint64)
    f = exact_dedup.build_filter(keys)
    others = np.random.default_rng(9).integers(0, 2**63, 20_000, dtype=np.uint64)
    assert exact_dedup.probe_filter(keys, *f).all() and exact_dedup.probe_filter(others, *f).mean() < 0.01


def test_magic_inside_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u", inner * 3), (2, "u", "x"), (3, "u", inner * 3), (4, "u", None)]
    back = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()}
    n = len(inner) * 3
    assert back == {1: ("response", None, n), 2: ("response", None, 1), 3: ("revisit", 1, n), 4: ("response", None, 0)}


def _files(spark, path):
    return {name: data for name, data in spark.sparkContext.binaryFiles(f"{path}/part-*").collect() if data}


def test_headers_of_any_length(spark):
    """A url of 100 KB takes no record away, and a file whose records do not reach its end is an error."""
    long = "http://x.example/" + "a" * 100_000
    pages = [(1, long, "first"), (2, "u", "second"), (3, long + "b", "third"), (4, "u", "fourth")]
    path = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1))
    back = {r.page_id: (r.uri, r.payload_bytes) for r in warc.read(spark, path).collect()}
    assert back == {i: (url, len(html)) for i, url, html in pages}
    (data,) = _files(spark, path).values()
    third = data.index(b"WARC/1.1", data.index(b"second"))
    for bad in (data[: third + 20], b"x" + data):
        folder = f"{path}-cut-{len(bad)}"
        spark.createDataFrame([(bytearray(bad).decode(),)], "value string").coalesce(1).write.option("lineSep", "\n").text(folder)
        with pytest.raises(ValueError, match="end at byte|begin with a record"):
            warc.read(spark, folder).collect()


@pytest.mark.parametrize("size", ["400", "3k", "1m"])
def test_ranges_of_any_size(spark, size):
    """Records over many byte ranges, separators and magic inside payloads, ranges without a record's begin: all come back."""
    rng = np.random.default_rng(5)
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = []
    for k in range(60):
        html = "".join(rng.choice(["é text ", "\r\n\r\n", inner, "x" * 700, "\r\n", "WARC/1."], rng.integers(0, 9)))
        pages.append((k, f"http://x.example/{k}", html if k % 9 else None))
    pages += [(100 + k, "u", pages[k][2]) for k in range(5)]
    path = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), file_records=40)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        back = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.offset, r.file) for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.set(key, before)
    import base64
    import hashlib

    first = {}
    for k, _, html in pages:
        first.setdefault(html or "", k)
    assert len(back) == len(pages)
    data = {name.split("/")[-1]: d for name, d in _files(spark, path).items()}
    for k, _, html in pages:
        h = (html or "").encode()
        n, digest, kind, refers, offset, file = back[k]
        assert (n, digest) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        assert (kind, refers) == (("response", None) if first[html or ""] == k else ("revisit", first[html or ""]))
        assert f"<urn:page:{k}>".encode() in data[file.split("/")[-1]][offset : offset + 200]


_EMAIL, _IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_CARD, _PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def test_base_spans_are_the_contracts():
    """Base spans against the four expressions as they are written, on texts of the characters that matter; in linear time."""
    import random
    import time

    rng = random.Random(3)
    for n in range(6000):
        text = "".join(rng.choice("0123456789" * 2 + ". -+()@ab%_\n") for _ in range(rng.randrange(40)))
        want = [("email", *m.span()) for m in re.finditer(_EMAIL, text)]
        want += [("ip", *m.span()) for m in re.finditer(_IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(_CARD, text):
            d = re.sub("[^0-9]", "", m[0])
            if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in re.finditer(_PHONE, text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(text) == want, text
    began = time.time()
    for text in ("7" * 1_000_000, "1." * 500_000, "1.2 " * 250_000, "@" * 100_000, "a" * 500_000 + "@", "+1 " * 100_000):
        pii.base_spans(text)
    assert time.time() - began < 20


def test_beliefs_by_enumeration():
    """Marginals against the sum over all labellings: exact on trees, close on small graphs with a loop."""
    from itertools import product

    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    for edges, tolerance in (([(0, 1), (1, 2), (1, 3)], 1e-5), ([(0, 1), (2, 3)], 1e-5), ([(0, 1), (1, 2), (0, 2)], 0.06), ([(0, 1), (1, 2), (2, 3), (3, 0)], 0.06)):
        n = 1 + max(max(e) for e in edges)
        u, w, same = rng.normal(size=(n, k)), rng.uniform(0.2, 1.2, len(edges)), rng.integers(0, 2, len(edges)).astype(bool)
        total = np.zeros((n, k))
        for y in product(range(k), repeat=n):
            score = sum(u[i, y[i]] for i in range(n)) + sum(w[j] for j, (a, b) in enumerate(edges) if y[a] == y[b] and (y[a] or same[j]))
            for i in range(n):
                total[i, y[i]] += np.exp(score)
        want = total / total.sum(1, keepdims=True)
        got = pii.beliefs(u, np.array(edges), w, same)
        assert np.abs(got - want).max() < tolerance


def test_field_carries_labels_on():
    text = "card 4984250489669609 here and again 4984-2504-8966-9609, mail hsr.29@mail5.example.com then HSR.29@MAIL5.example.com"
    base, every = pii.find(text)
    assert {k for k, _, _ in base} == {"card", "email"} and set(base) <= set(every)
    assert pii.find("number 12 and 2020 in 1999") == ([], [])


def test_scan_counts_every_span(spark):
    """Null and empty texts, a null id, repeated rows and a column of a clashing name have a row each, with its own counts."""
    card = "card 4984250489669609 here and again 4984-2504-8966-9609, there 4984.2504.8966.9609"
    texts = [(1, card), (1, card), (2, None), (3, ""), (None, "mail a.b@c.example and 10.0.0.1 or 10.0.0.256"), (4, "no 12 of 2020")]
    got = pii.scan(spark.createDataFrame([(*r, "x") for r in texts], "doc_id long, text string, n_spans string")).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == [(0, 1, 1, 0, 0), (1, 0, 0, 2, 0), (1, 0, 0, 2, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0)]
    for r in got:
        every = pii.find(dict(texts)[r.doc_id] or "")[1]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in every) and r.n_spans == len(every)
    assert sorted(r.n_spans for r in got if r.doc_id == 1) == [3, 3]


def test_every_repeated_mention_is_found():
    """One base span reaches all other mentions of it, however many there are, wherever it stands."""
    mail, card = "anna.berg@mail5.example.com", "4984250489669609"
    for base, kind, mention in ((card, "card", "4984.2504.8966.9609"), (mail, "email", "anna.berg")):
        for n in (2, 10, 100):
            for before in (0, n // 2, n):
                text = f"see {mention} there, " * before + f"this {base} is it, " + f"see {mention} there, " * (n - before)
                clamped, every = pii.find(text)
                assert [text[s:e] for _, s, e in clamped] == [base]
                assert [(k, text[s:e]) for k, s, e in every if (k, s, e) not in clamped] == [(kind, mention)] * n, (kind, n, before)
    assert pii.find("see 4984.2504.8966.9609 there, " * 100)[1] == []
    # several base spans count as several edges, and other tokens stay
    text = f"{mail} and anna.berg or 12 of 2020 and {mail} then"
    assert [text[s:e] for _, s, e in pii.find(text)[1]] == [mail, "anna.berg", mail]


def test_fitted_field_finds_reformatted_mentions(spark):
    """Weights fitted on documents with base spans; then planted mentions in other forms: recall and precision of the added spans."""
    rng = np.random.default_rng(12)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def filler():
        return " ".join(rng.choice(["the", "of", "in 2019 they", "room 12 was", "item", "and", "page 7 of", "order 88213 came", "see", "about 1500 words"], 12))

    train = []
    for k in range(300):
        entity = [f"{rng.choice(['anna', 'otto', 'mira'])}.{digits(3)}@mail{k % 9}.example.com", card(), f"+{digits(11)}", f"10.{k % 256}.3.{k % 200}"][k % 4]
        train.append((k, f"{filler()} contact {entity} {filler()} {entity if k % 3 else ''} {filler()}"))
    weights = pii.fit(pii.sample(spark.createDataFrame(train, "doc_id long, text string")))
    assert weights != pii.WEIGHTS and weights["skip"] > 1 and weights["similar"] > 1
    hit = planted = added = 0
    for k in range(200):
        kind = k % 4
        if kind == 0:
            name = f"lena.{digits(4)}"
            entity, other = f"{name}@mail.example.com", name
        elif kind == 1:
            c = card()
            entity, other = c, ".".join(c[i : i + 4] for i in range(0, 16, 4))
        elif kind == 2:
            d = digits(10)
            entity, other = f"+4{d}", f"({d[:3]})-{d[3:6]}-{d[6:]}"
        else:
            entity = f"10.{rng.integers(100, 250)}.{rng.integers(100, 250)}.{rng.integers(100, 250)}"
            other = entity.replace(".", "_")
        text = f"{filler()} {entity} {filler()} {other} {filler()}"
        base, every = pii.find(text, weights)
        more = [text[s:e] for x, s, e in every if (x, s, e) not in base]
        planted += 1
        added += len(more)
        hit += other in more or other.strip("()") in more
    assert hit / planted >= 0.9 and hit / max(added, 1) >= 0.9, (hit, planted, added)


def test_held_out_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(d.where("doc_id % 2 = 0").select("lang", "text"))
    rows = language_id.identify(language_id.document_evidence(d.where("doc_id % 2 = 1").withColumn("truth", d.lang).select("doc_id", "text", "source").selectExpr("*", "cast(null AS string) AS lang")), model)
    truth = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = [(truth[r.id], r.lang) for r in rows.collect()]
    assert np.mean([a == b for a, b in got]) > 0.98


def test_pipeline_keeps_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_copies_are_removed_by_row(spark):
    """Rows without doc_id, repeated rows and other texts under a doc_id, against brute force over the rows."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    base = [[f"w{rng.integers(10**6)}" for _ in range(80)] for _ in range(4)]

    def text(k, edits=0):
        w = list(base[k])
        for _ in range(edits):
            w[rng.integers(len(w))] = f"z{rng.integers(10**6)}"
        return " ".join(w)

    rows = [(None, text(0)), (None, text(0, 1)), (None, text(0)), (5, text(1)), (5, text(1)), (5, text(1)), (3, text(2, 1)), (8, text(2)), (8, text(3)), (9, text(3, 1)), (9, text(0, 2)), (7, ""), (7, ""), (None, None), (4, "too short")]
    rows += [(20 + k, text(k % 4, 1)) for k in range(8)] + [(40, " ".join(f"own{k}" for k in range(50)))]
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(len((t or "").split()) - 4)} for _, t in rows]
    low, changed = list(range(len(rows))), True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and low[j] < low[i]:
                    low[i], changed = low[j], True
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()), key=str)
    wordless = [rows[i] for i in range(len(rows)) if not sets[i]]
    groups = [[rows[i] for i in range(len(rows)) if low[i] == c and sets[i]] for c in set(low)]
    groups = [g for g in groups if g]
    assert len(got) == len(groups) + len(wordless)
    for g in groups:
        least = min((k is None, k or 0) for k, _ in g)
        assert sum(x in got for x in {x for x in g if (x[0] is None, x[0] or 0) == least}) == 1
    assert [x for x in got if x in wordless] == sorted(wordless, key=str)
    assert corpus_pipeline.near_copies(spark, docs.limit(0), SF).count() == 0


def test_split_groups_keep_every_pair(spark):
    """Hot pivots and buckets of any size: each pair of sets of a bucket is compared in some group, and groups are small."""
    from collections import Counter, defaultdict
    from itertools import combinations

    rows = [(t, s, 0 if t < 4 else t) for t in range(8) for s in range(100 if t == 1 else 9)]
    df = spark.createDataFrame(rows, "token long, sid long, pivot long")
    members, wanted = defaultdict(list), Counter()
    for r in jaccard._grouped(df, 10).collect():
        members[r.part, r.group].append((r.sid, r.side, r.token))
    for held in members.values():
        assert len(held) < 50 and len({t for *_, t in held}) == 1
        wanted.update((held[0][2], *sorted((a[0], b[0]))) for a, b in combinations(held, 2) if a[1] < 0 or a[1] != b[1])
    assert wanted == Counter((t, a, b) for t in range(8) for a, b in combinations(sorted(s for u, s, _ in rows if u == t), 2))


def test_split_pivots_pass_pairs_on_once(spark):
    """Of all parts of a hot pivot one passes a pair on, and every pair is passed on."""
    from itertools import combinations

    from pyspark.sql import functions as F

    # most pairs share all of 60 tokens; some sets share one token only with the others
    rows = [(t * 7919, s, -1) for t in range(60) for s in range(40)] + [(1_000_003, s, -1) for s in range(35, 60)]
    df = spark.createDataFrame(rows, "token long, sid long, pivot long").withColumns({"n": F.lit(5).cast("long"), "label": F.col("sid"), "low": F.lit(0.0), "high": F.lit(1.0), "sketch": F.lit(bytearray(jaccard.sketch(np.arange(5, dtype=np.uint64))))})
    g = jaccard._grouped(df, 100)
    assert g.select("part").distinct().count() > 10
    got = jaccard._meetings(g, 0.25, 75).collect()
    wanted = {p for group in (range(40), range(35, 60)) for p in combinations(group, 2)}
    assert {(r.a, r.b) for r in got} == wanted and len(got) == len(wanted)
    x = np.array([[1, 5, 9, jaccard._NONE], [2, 6, jaccard._NONE, jaccard._NONE]])
    y = np.array([[5, 9, jaccard._NONE, jaccard._NONE], [3, 7, jaccard._NONE, jaccard._NONE]])
    assert jaccard.here(x, y, np.array([4, 4]), np.array([1, 0])).tolist() == [True, True]
    assert jaccard.here(x, y, np.array([4, 4]), np.array([2, 0])).tolist() == [False, True]


def test_filters_decide_who_is_a_copy(spark, monkeypatch):
    """Copies in different batches are found through the filters; without what they let pass only those of a batch are."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"text {k % 5}") for k in range(40)] + [(None, "text 1"), (77, None), (78, " \t"), (79, "own")], "doc_id long, text string")
    whole = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs, F.pmod(F.coalesce("doc_id", F.lit(0)) / 5, F.lit(3)).cast("int"), 3).collect()}
    assert {x for x in whole if x[0] in (0, 1, 5, 77, 78, 79, None)} == {(0, 0, 8, True), (1, 1, 9, True), (5, 0, 8, False), (None, 1, 9, False), (77, 78, 2, False), (78, 78, 2, True), (79, 79, 1, True)}
    none = exact_dedup.screen
    monkeypatch.setattr(exact_dedup, "screen", lambda incoming, built: none(incoming, built).where(F.lit(False)))
    blind = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs, F.pmod(F.coalesce("doc_id", F.lit(0)) / 5, F.lit(3)).cast("int"), 3).collect()}
    assert blind != whole and max(x[2] for x in blind) < 9


def test_equal_digests_of_different_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_digest", lambda norm: F.unhex(F.sha2(F.substring(norm, 1, 2), 256)))
    docs = spark.createDataFrame([(1, "aab"), (2, "aac"), (3, "aa b"), (4, "zz"), (5, "aac"), (6, "aad")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup(docs, F.pmod("doc_id", F.lit(2)), 2).collect()}
    assert got == {(1, 3, 2), (3, 3, 2), (2, 2, 2), (5, 2, 2), (4, 4, 1), (6, 6, 1)}


def test_sources_of_any_name(spark):
    """A null source is not the source named by a null character, and columns of any name stay."""
    rows = [(1, "a b c", None), (2, "a b", "\0"), (3, "d e f", ""), (4, "g", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.size, r.source_size) for r in mixing.mix(d).collect()}
    assert got == {1: (3, 3), 2: (2, 2), 3: (3, 3), 4: (1, 1)} and mixing.mix(d).count() == 4
    for c in ("_h", "_n", "_k", "_times", "_pass", "k", "threshold", "rest"):
        d = d.withColumn(c, d.doc_id)
    assert mixing.mixed(d).columns == d.columns and mixing.mixed(d).count() > 0


def test_fusion_by_hand(spark):
    """Posteriors of pages against a plain computation of priors, conditionals and votes, with each row left out of its own counts."""
    import math

    words = {"en": "the house and the water with other things", "de": "der hund und die katze nicht immer gross", "fr": "les enfants sont dans la maison avec nous"}
    rng = np.random.default_rng(6)
    labelled = [(k, x, " ".join(rng.permutation(words[x].split()))) for k, x in enumerate(list(words) * 40)]
    model = language_id.fit(spark.createDataFrame(labelled, "doc_id long, lang string, text string"))
    assert model.languages == ("de", "en", "fr")
    pages = []
    for k in range(60):
        x = list(words)[k % 3]
        text = " ".join(rng.permutation(words[x].split())[: 1 + k % 6])
        host = ["a.example.de", "b.example.de", "www.site.com", "x.org"][int(rng.integers(4))]
        declared = [f' lang="{x}"', "", ' lang="en"'][k % 3] if k % 4 else ""
        pages.append((k, f"http://{host}/p{k}" if k % 10 else None, f"<html{declared}><body>{text}</body></html>" if k % 13 else "12 34"))
    got = {r.id: (r.lang, r.probability) for r in language_id.identify(language_id.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string")), model, html=True).collect()}
    rows = {}
    for k, url, html in pages:
        host = url.split("/")[2] if url else None
        ll, n = language_id.score(model, [language_id.visible(html)])
        m = re.search('lang="([a-z]+)"', html)
        rows[k] = (ll[0], int(n[0]), m and m[1], host and host.split(".")[-1], host, host and ".".join(host.split(".")[-2:]))
    n_declared = max(1, len({r[2] for r in rows.values() if r[1] and r[2]}))
    n_suffix = max(1, len({r[3] for r in rows.values() if r[1] and r[3]}))
    for k, (ll, n, declared, suffix, host, domain) in rows.items():
        if not n:
            assert got[k] == (None, 0.0)
            continue
        count = lambda i, v: [sum(1 for j, r in rows.items() if j != k and r[1] and (i is None or r[i] == v) and int(np.argmax(r[0])) == x) for x in range(3)]  # noqa: E731, B023
        total = count(None, None)
        p = [(c + 1) / (sum(total) + 3) for c in total]
        for i, v in ((5, domain), (4, host)):
            if v is not None:
                c = count(i, v)
                p = [(c[x] + 20 * p[x]) / (sum(c) + 20) for x in range(3)]
        lp = [ll[x] + math.log(p[x]) for x in range(3)]
        for i, v, values in ((2, declared, n_declared), (3, suffix, n_suffix)):
            if v is not None:
                c = count(i, v)
                lp = [lp[x] + math.log((c[x] + 2 / (values + 1)) / (total[x] + 2)) for x in range(3)]
        e = [math.exp(x - max(lp)) for x in lp]
        assert got[k][0] == model.languages[int(np.argmax(lp))] and abs(got[k][1] - max(e) / sum(e)) < 1e-6


def test_any_number_of_languages(spark):
    word = lambda k: "abcdefghij"[k // 10] * 3 + "klmnopqrst"[k % 10] * 3
    rows = [(k, f"l{k % 70}", f"{word(k % 70)} " * 30) for k in range(280)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(model.languages) == 70 and model.weights.shape == (language_id.BUCKETS // 2, 70)
    d = spark.createDataFrame([(1, f"{word(69)} " * 20, None, None)], SCHEMA)
    assert language_id.identify(language_id.document_evidence(d), model).first().lang == "l69"
    for c in ("_row", "declared", "host", "h", "_prior", "l"):
        d = d.withColumn(c, d.doc_id)
    assert language_id.accepted_documents(d.drop("_row").withColumn("lang", d.text.substr(0, 0)), model).columns == d.drop("_row").columns
