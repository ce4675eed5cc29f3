"""Line dedup by a segment-partition edit join. SQL functions only.

Equal lines collapse first. Of lines of length m, near means within tau(m) = min(TAU, m div CHARS_PER_EDIT) edits, m being the
shorter one's. A line is split into tau(m) + 1 segments: a line within that many edits keeps one of them whole, at a place at most as
far away. Each line enters an index by (length, number of segment, segment), and probes it, for each length from its own down to TAU
less, with its substrings near a segment's place (the multi-match-aware choice: as many as can be needed and no more). Lines that
meet are verified by a banded bit-parallel edit distance: a column of the band is a word of 2 TAU + 1 bits (vertical steps up and
down), and one pass of shifts and sums over the other line's characters moves it along the diagonal.

A line with a word goes where an equal line came earlier, in its document or in one with a smaller id, and also if any earlier line
is near it; however short it is, an equal one goes. A document that loses all its lines goes altogether.

Nulls: a null text is empty, has one empty line and stays; a null doc_id comes last. Rows of the same doc_id and text
count as one document. Columns of any name stay. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import NOT_SPACE, hash_map, marked, materialize, salted_join

TAU = 2
#: The white space of the contracts, for trimming: cheaper than a pattern, which decodes each line.
SPACES = " \t\n\x0b\x0c\r"
#: A line has an edit for each so many characters, up to TAU.
CHARS_PER_EDIT = 16
#: Occurrences of a line from which on its places are dealt over several tasks.
HOT = 1024


#: The bits of an index key that count. Keys that are equal by chance only add candidates, which are verified; beside the zeros that
#: begin a row of a shuffle, zeros of the first bytes take no room.
KEY_BITS = -1 << 24


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the row), line_no, line of every line that may go."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("key", F.xxhash64("doc_id", "t"))
    d = d.select("doc_id", "key", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    return d.where(F.ltrim(F.col("line"), F.lit(SPACES)) != "")


#: Letters whose counts go into a line's signature, modulo 4 and in Gray code: two bits each.
LETTERS = "abcdefghijklmnopqrstuvwxyz é"


def _hashed(lines: DataFrame) -> DataFrame:
    """Adds h and h2: 128 bits that tell lines apart."""
    return lines.withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def signature(line: str) -> Column:
    """An edit changes the counts of two letters by one at most, and in Gray code a count's step modulo 4 changes one bit:
    the signatures of lines within tau edits differ in 2 * tau bits at most."""
    n = lambda c: f"((length({line}) - length(replace({line}, '{c}', ''))) & 3)"
    return F.expr("|".join(f"shiftleft(cast({n(c)} ^ ({n(c)} >> 1) AS bigint), {2 * i})" for i, c in enumerate(LETTERS)))


def classes(lines: DataFrame) -> DataFrame:
    """h, h2, n, first (the earliest place, in order) of the distinct lines."""
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), F.col("line_no").alias("line_no"))
    return lines.select("h", "h2", place.alias("p")).groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("p").alias("first"))


def _tau(length: str, tau: int) -> str:
    return f"least({tau}, {length} div {CHARS_PER_EDIT})"


def _rows(lines: DataFrame, tau: int, own: bool, others: bool) -> DataFrame:
    """k, h: the index entries of lines (own), and what they look for besides (others).

    Segment i of a line of length m that has t + 1 of them, the last ones one longer, is looked for s further on. No shift leaves the
    line: a segment has a character at least, and there are as many segments after it as it can be moved on beyond delta.
    """
    wanted: dict[int, list[tuple[int, int, int]]] = {t: [] for t in range(1, tau + 1)}
    for t, out in wanted.items():
        for delta in range(t + 1):
            for i in range(t + 1):
                for shift in range(max(-i, delta - (t - i)), min(i, delta + (t - i)) + 1):
                    if (own and (delta, shift) == (0, 0)) or (others and (delta, shift) != (0, 0)):
                        out.append((delta, i, shift))
    k = tau + 1

    def key(delta: int, i: int, shift: int) -> str:
        at = f"{i} * short{delta} + greatest(0, more{delta} - {k - i}) + {1 + shift}"
        return f"(xxhash64(l - {delta}, {i}, substring(line, {at}, short{delta} + IF(more{delta} >= {k - i}, 1, 0))) & {KEY_BITS}L)"

    # lines long enough have the entries of tau, each an expression of its own; a line near or below has those of its lengths
    every = ", ".join(f"named_struct('t', {t}, 'd', {delta}, 'i', {i}, 's', {shift})" for t, out in wanted.items() for delta, i, shift in out)
    m, short = "(l - x.d)", "((l - x.d) div (x.t + 1))"
    n_short = f"(x.t + 1 - {m} % (x.t + 1))"
    at, n = f"int(1 + x.i * {short} + greatest(0, x.i - {n_short}) + x.s)", f"int({short} + IF(x.i >= {n_short}, 1, 0))"
    rest = f"transform(filter(array({every}), x -> x.t = {_tau(m, tau)}), x -> xxhash64({m}, x.i, substring(line, {at}, {n})) & {KEY_BITS}L)"
    deltas = sorted({delta for delta, _, _ in wanted[tau]})
    parts = [F.expr(f"int((l - {x}) div {k}) AS short{x}") for x in deltas] + [F.expr(f"int((l - {x}) % {k}) AS more{x}") for x in deltas]
    d = lines.select("line", "h", F.length("line").alias("l")).select("line", "h", "l", *parts)
    return d.select(F.explode(F.expr(f"CASE WHEN l >= {CHARS_PER_EDIT * tau + tau} THEN array({', '.join(key(*x) for x in wanted[tau])}) ELSE {rest} END")).alias("k"), "h")


def edit_distance(s: str, t: str, tau: int) -> Column:
    """The edit distance of two columns of texts if it is `tau` at most, else more than `tau`: banded and bit-parallel.

    Texts of `tau` characters at least, whose lengths differ by `tau` at most. Bit b of a column j's word is row j - tau + b; vp and vn
    tell where the distance steps up and down from the row before. d follows the lowest diagonal of the band down to the last row,
    and that row from there on.
    """
    w = 2 * tau + 1
    mask = (1 << w) - 1
    bits = " | ".join(f"IF(get(a, j + {b - tau}) = c, {1 << b}, 0)" for b in range(w))
    xs = f"transform(array(split({s}, '')), a -> transform(split({t}, ''), (c, j) -> {bits}))[0]"
    zero = f"named_struct('vp', {mask & ~((1 << tau) - 1)}, 'vn', 0, 'd', {tau}, 'j', 1)"
    diagonal = "(((x & z.vp) + z.vp) ^ z.vp | x | z.vn) & " + str(mask)
    row = f"(length({s}) - z.j + {tau})"
    step = (
        f"named_struct('vp', (y & z.vp) | ({mask} & ~(shiftright(y, 1) | hp)), 'vn', shiftright(y, 1) & hp, "
        f"'d', z.d + IF(z.j <= length({s}) - {tau}, 1 - (shiftright(y, {w - 1}) & 1), (shiftright(hp, {row}) & 1) - (shiftright(y & z.vp, {row}) & 1)), 'j', z.j + 1)"
    )
    return F.expr(f"aggregate({xs}, {zero}, (z, x) -> transform(array({diagonal}), y -> transform(array(z.vn | ({mask} & ~(y | z.vp))), hp -> {step})[0])[0], z -> z.d)")


def meetings(lines: DataFrame, tau: int) -> tuple[DataFrame, DataFrame]:
    """(k, h of what finds another line in the index; k, h of the entries found): as many rows as there are entries at most.

    Of each bucket the join needs the least and the greatest hash only: who differs from one of them has found another
    line. All entries of a bucket with several lines are found so, and a bucket's only line is its least one.
    """
    entries = _rows(lines, tau, True, False).repartition("k")  # shuffled once, read by the aggregate and by both joins
    index = entries.groupBy("k").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    seek = _rows(lines, tau, False, True).join(index.hint("shuffle_hash"), "k").where("h <> low OR h <> high")
    own = entries.join(index.hint("shuffle_hash"), "k").where("h <> low OR h <> high")
    columns = ["k", "h", "low", "high", "own"]
    found = materialize(seek.withColumn("own", F.lit(False)).select(*columns).union(own.withColumn("own", F.lit(True)).select(*columns)).distinct())
    hit = found.where("own").select("k", "h").union(found.select("k", "low")).union(found.select("k", "high")).distinct()
    return found.select("k", "h").distinct(), materialize(hit)


def _once(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The distinct lines: those that the map of repeated lines leaves out, and of the others one each."""
    m = marked(lines, hash_map(found.where(F.col("n") > 1)))
    often = materialize(m.where("in_map").drop("in_map").dropDuplicates(["h", "h2"]))
    return m.where("NOT in_map").drop("in_map").unionByName(often)


def near(lines: DataFrame, found: DataFrame, tau: int = TAU) -> DataFrame:
    """h, h2, g, g2: links between distinct lines (line, h, h2) within `tau` edits, or fewer for short ones. `found`: their classes."""
    long = materialize(_once(lines.where(F.length("line") >= CHARS_PER_EDIT).select("h", "h2", "line"), found), "lz4")  # read three times
    found, hit = meetings(long, tau)
    some = found.select("h").union(hit.select("h")).distinct()
    texts = materialize(marked(long, hash_map(some)).where("in_map").drop("in_map").join(some, "h", "left_semi").dropDuplicates(["h", "h2"]).withColumn("sig", signature("line")))
    sigs = texts.select("h", "sig")
    left, right = found.join(sigs, "h"), hit.join(sigs, "h").select("k", F.col("h").alias("g"), F.col("sig").alias("sig2"))
    # a bucket's lines meet within the join, which passes on only those that the signatures let be near
    met = left.join(right, (left.k == right.k) & (left.h != right.g) & (F.bit_count(left.sig.bitwiseXOR(right.sig2)) <= 2 * tau))
    met = materialize(met.select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b")).distinct())
    both = met.join(texts.select(F.col("h").alias("a"), "h2", F.col("line").alias("s")), "a").join(texts.select(F.col("h").alias("b"), F.col("h2").alias("g2"), F.col("line").alias("t")), "b")
    short = F.expr(_tau("least(length(s), length(t))", tau))
    both = both.where(F.abs(F.length("s") - F.length("t")) <= short).where(edit_distance("s", "t", tau) <= short)
    return both.select(F.col("a").alias("h"), "h2", F.col("b").alias("g"), "g2")


def decisions(docs: DataFrame, tau: int = TAU) -> tuple[DataFrame, DataFrame]:
    """(places of lines: doc_id, key, line_no, h, h2; classes that lose an occurrence, with n_earlier near lines)."""
    lines = _hashed(lines_of(docs))
    places = materialize(lines.drop("line"))
    found = materialize(classes(places))
    links = materialize(near(lines, found, tau))
    place = found.select("h", "h2", "first")
    l = links.join(place, ["h", "h2"]).join(place.select(F.col("h").alias("g"), F.col("h2").alias("g2"), F.col("first").alias("other")), ["g", "g2"])
    after = F.col("first") > F.col("other")
    later = l.select(F.when(after, F.col("h")).otherwise(F.col("g")).alias("h"), F.when(after, F.col("h2")).otherwise(F.col("g2")).alias("h2")).groupBy("h", "h2").agg(F.count("*").alias("n_earlier"))
    judged = found.join(later, ["h", "h2"], "left").withColumn("n_earlier", F.coalesce("n_earlier", F.lit(0)))
    return places, judged.where("n > 1 OR n_earlier > 0")


def drops(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """doc_id, key, lost (the numbers of the lines that a document loses) and n_near (how many of them are near ones only)."""
    lines, judged = decisions(docs, tau)
    first = (F.coalesce("doc_id", F.lit(0)) == F.coalesce("first.doc_id", F.lit(0))) & (F.col("key") == F.col("first.key")) & (F.col("line_no") == F.col("first.line_no"))
    judged = materialize(judged.withColumnsRenamed({"h": "line_h", "h2": "own_h2"}))
    hot = judged.where(f"n > {HOT}").select(F.xxhash64("line_h").alias("h"))
    lost = salted_join(lines.withColumnRenamed("h", "line_h"), judged, "line_h", hot).where("h2 = own_h2").where(~first | (F.col("n_earlier") > 0))
    return lost.groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("lost"), F.count(F.when(first, 1)).alias("n_near"))


def rewritten(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """_row (struct of all columns of `docs`, text being what stays of it), n_lines, n_lost, n_near of every row."""
    lost = materialize(drops(docs, tau)).select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("key").alias("_key"), "lost", F.col("n_near").alias("_near"))
    names = docs.columns
    d = docs.select(F.struct(*names).alias("_row"), F.coalesce("doc_id", F.lit(0)).alias("_d"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_k"))
    j = d.join(lost.hint("shuffle_hash"), (d._k == lost._key) & (d._d == lost._id), "left")
    j = j.withColumn("_lines", F.split(F.coalesce("_row.text", F.lit("")), "\n"))
    stays = F.expr("CASE WHEN lost IS NULL THEN _row.text ELSE array_join(filter(_lines, (x, i) -> NOT array_contains(lost, i)), '\\n') END")
    row = F.struct(*[stays.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names])
    return j.select(row.alias("_row"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_lost"), F.coalesce("_near", F.lit(0)).alias("n_near"))


def survivors(rows: DataFrame) -> DataFrame:
    """The columns of `docs` of those `rewritten` rows that still have a line with a word, or lost none."""
    return rows.where((F.col("n_lost") == 0) | F.col("_row.text").rlike(NOT_SPACE)).select("_row.*")
