"""Best-fit packing with swap-based local search.

Documents become token ids with an end id; only those longer than a sequence are cut, with the short piece first. Full
pieces are sequences of their own. The others are dealt into groups of about GROUP_PIECES, by their number in the written table of
pieces, so that repeated rows do not meet in one group. In a group they are placed best-fit, largest first, and then a local search
works on the underfull bins: it moves a piece, exchanges one for one or two for one, whenever that increases the sum of squared
fills, until there are as few bins as the tokens need or no step is left; emptied bins go.

Nulls: a null text is empty and consists of the end id alone. Repeated rows are packed one by one. Empty table: no rows.
"""

from __future__ import annotations

import base64
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialize, ship, small_batches

CAPACITY = 1024
END_ID = 2
GROUP_PIECES = 50_000
#: Fixed value: the vocabulary's special token, an id of its own wherever it stands in a text.
SPECIAL = {"<|endoftext|>": 50256}
PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"
_ENCODINGS: dict[str, object] = {}


def encoding(path: str) -> object:
    """The byte-level BPE at `path` (ranks in base64), once a process."""
    if path not in _ENCODINGS:
        import tiktoken

        # Fixed value: how this vocabulary splits texts.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODINGS[path]


def ids_of(enc: object, text: str) -> np.ndarray:
    """The ids of a text, without an end id."""
    return enc.encode_to_numpy(text, allowed_special="all")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(k, capacity) for k in range(first, n, capacity)]


def pieces(docs: DataFrame, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document of `docs` (doc_id, text)."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks)
        for pdf in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                t = np.append(ids_of(enc, text or ""), END_ID).astype("<u4")
                for k, (s, n) in enumerate(cut(len(t), capacity)):
                    ids.append(doc)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(t[s : s + n].tobytes()))
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="object"), "piece": np.array(piece, "int32"), "start": np.array(start, "int64"), "length": np.array(length, "int64"), "ids_crc32": np.array(crc, "int64")})

    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas would make longs with nulls doubles
    return d.mapInPandas(tokens, PIECE)


# ---- one group ------------------------------------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the numbers of the pieces of each bin. Bins are found by the room they have left."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that some bin has, ascending
    bins: list[list[int]] = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        room -= n
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(b)
    return bins


def _offers(members: list[int], lengths: np.ndarray) -> dict[int, tuple[int, ...]]:
    """What a bin can give: a piece or two, one choice for each size. Fewer than 46 different sizes fit in a bin of 1024."""
    by_size: dict[int, list[int]] = {}
    for k in members:
        by_size.setdefault(int(lengths[k]), []).append(k)
    out: dict[int, tuple[int, ...]] = {n: (held[0],) for n, held in by_size.items()}
    distinct = sorted(by_size)
    for i, n in enumerate(distinct):
        if len(by_size[n]) > 1:
            out.setdefault(2 * n, tuple(by_size[n][:2]))
        for m in distinct[i + 1 :]:
            out.setdefault(n + m, (by_size[n][0], by_size[m][0]))
    return out


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins, each increasing the sum of squared fills.

    From the emptiest bin on, each gives a piece or two to whichever other bin gains most by it, taking back nothing or a smaller
    piece. It ends when there are as few bins as their total needs, or when no bin has such a step. The sum is a whole number and
    only grows, so there is an end.
    """
    fill = np.array([int(lengths[b].sum()) if b else 0 for b in bins], np.int64)
    done = [b for b, f in zip(bins, fill, strict=True) if f == capacity]
    held = [list(b) for b, f in zip(bins, fill, strict=True) if 0 < f < capacity]
    fill = fill[(fill > 0) & (fill < capacity)]
    n, needed, alive = len(held), math.ceil(int(fill.sum()) / capacity), len(held)
    none = 4 * capacity  # no piece
    sizes = np.full((n, 2 + max((len({int(lengths[k]) for k in b}) for b in held), default=0)), none, np.int64)

    def note(b: int) -> None:
        nonlocal sizes
        own = sorted({int(lengths[k]) for k in held[b]})
        if len(own) + 1 > sizes.shape[1]:
            sizes = np.concatenate([sizes, np.full((n, len(own) + 1 - sizes.shape[1]), none, np.int64)], 1)
        sizes[b] = none
        if held[b]:
            sizes[b, 0] = 0
            sizes[b, 1 : len(own) + 1] = own

    for b in range(n):
        note(b)
    changed = True
    while changed and alive > needed:
        changed = False
        for donor in np.argsort(fill, kind="stable").tolist():
            while held[donor] and fill[donor] < capacity and alive > needed:
                offers = _offers(held[donor], lengths)
                room, lead = capacity - fill, fill - fill[donor]
                room[donor] = 0
                best, step = 0, None
                every = np.array(sorted(offers), np.int64)
                for lo in range(0, len(every), 64):
                    more = every[lo : lo + 64, None, None] - sizes[None]  # what a bin would gain
                    gain = np.where((more >= 1) & (more <= room[None, :, None]), more * (more + lead[None, :, None]), 0)
                    at = int(gain.argmax())
                    if gain.flat[at] > best:
                        best = int(gain.flat[at])
                        s, b, x = np.unravel_index(at, gain.shape)
                        step = int(every[lo + s]), int(b), int(sizes[b, x])
                if step is None:
                    break
                size, b, back = step
                take = offers[size]
                give = next(((k,) for k in held[b] if lengths[k] == back), ()) if back else ()
                for k in take:
                    held[donor].remove(k)
                for k in give:
                    held[b].remove(k)
                held[b].extend(take)
                held[donor].extend(give)
                fill[b] += size - back
                fill[donor] -= size - back
                alive -= not held[donor]
                note(b)
                note(donor)
                changed = True
    return done + [b for b in held if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces of these lengths."""
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
        at = 0
        for k in members:
            which[k], offset[k] = b, at
            at += int(lengths[k])
    return which, offset


# ---- Spark ----------------------------------------------------------------------------------------------------------


def pack_documents(docs: DataFrame, ranks: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(docs.sparkSession)
    p = materialize(pieces(docs, ranks, capacity).withColumn("rid", F.monotonically_increasing_id()))
    groups = max(1, math.ceil(p.where(F.col("length") < capacity).count() / group_pieces))
    full = p.where(F.col("length") == capacity).drop("rid")
    # any number above those of the groups' bins, of which a group has fewer than 2^31
    full = full.select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ignore_index=True)
        which, offset = pack(pdf.length.to_numpy(), capacity)
        return pdf.assign(sequence_id=which + (pdf.g.iloc[0] << 31), offset=offset).drop(columns="g")

    rest = p.where(F.col("length") < capacity).withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(groups))).drop("rid")
    placed = rest.groupBy("g").applyInPandas(place, f"{PIECE}, sequence_id long, offset long")
    return full.unionByName(placed).withColumn("doc_id", F.col("doc_id").cast("long"))


ship(__name__)
