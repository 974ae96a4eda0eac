"""Removal of repeated passages by maximal repeats of an enhanced suffix array.

A string of LENGTH bytes is tied to an anchor: the smallest hashed SEED bytes inside it. Equal strings have equal
anchors, so only anchors that occur twice matter, and around them only the bytes of the strings that are tied to them,
their context. Equal contexts are one class, of which all but the first occurrence are repeats as a whole. Classes of
one anchor that differ are compared by their texts: a suffix array over them with common prefix lengths is scanned
with a stack for intervals of LENGTH or more; intervals whose left neighbours differ are the maximal repeats, and all
their occurrences but the first are marked.

Documents are known by id and a hash of their text, so repeated rows are one document and share its result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm.common import grouped, map_batches, query, table, written
from pagetables.llm.vectors import mixed

LENGTH, SEED = 100, 32
#: Bytes that are ranked as one number at first.
PACK = 7
#: Contexts that one call compares, about; an anchor with more classes than MOST is compared by hashes of its strings.
CALL_ROWS, MOST = 8192, 16384
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n, modulo 2 ** 64."""
    if len(_powers[name]) <= n:
        _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]), dtype=np.uint64)
    return _powers[name][:n + 1]


class Hashes:
    """Hashes of any stretch of bytes in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _power("up", _BASE, n)[:n], dtype=np.uint64)])
        self.down = _power("down", _UNBASE, n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def anchors(hashes: Hashes, n: int, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): each anchor and the range of starts of the strings that are tied to it."""
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    starts = np.arange(n - seed + 1)
    own = hashes.of(starts, starts + seed)
    low, at, width, want = own, starts, 1, length - seed + 1
    while width < want:  # the first smallest of windows of doubling width
        step = min(width, want - width)
        left = low[:-step] <= low[step:]
        at = np.where(left, at[:-step], at[step:])
        low = np.where(left, low[:-step], low[step:])
        width += step
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    place = at[first]
    return own[place], place, first, last


def contexts(hashes: Hashes, place, first, last, length: int = LENGTH) -> np.ndarray:
    """A hash of each anchor's context and of the anchor's place in it."""
    around = hashes.of(first, last + length)
    return mixed(around + ((place - first) * 256 + (last - place)).astype(np.uint64))


def suffixes(data: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by the ranks of ever longer prefixes, and common prefix lengths of neighbours.

    Lengths from `least` (PACK or more) to `most` are right, shorter ones may come out as less. `data` are bytes + 1 and
    numbers over 256 that occur once. The first ranks are those of PACK symbols in one number; a number over 256 ends a run,
    comes before all bytes, and makes the run unlike all others.
    """
    n = len(data)
    ends = np.append(data > 256, np.ones(PACK, bool))
    symbols = np.append(data, np.zeros(PACK, np.int64))
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(PACK):
        ended |= ends[i:i + n]
        key = key << 9 | np.where(ended, 0, symbols[i:i + n])
    first = np.argsort(key, kind="stable")
    new = np.append(True, (key[first[1:]] != key[first[:-1]]) | ended[first[1:]])[:n]
    rank, width = np.empty(n, np.int64), PACK
    rank[first] = np.cumsum(new)
    levels = [(1, np.where(data > 256, 0, data)), (width, rank)]

    def behind(by: int) -> np.ndarray:
        return np.concatenate([rank[by:], np.zeros(min(by, n), np.int64)])

    while width < most:
        top = int(rank.max()) + 1
        if top < 1 << 21:  # three ranks fit into one number
            key, width = rank << 42 | behind(width) << 21 | behind(2 * width), 3 * width
        else:
            key, width = rank * top + behind(width), 2 * width
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        levels.append((width, rank))
    order = np.argsort(rank, kind="stable")
    common = np.zeros(max(n - 1, 0), np.int64)
    live, a, b = np.arange(n - 1), order[:-1], order[1:]
    for width, rank in reversed(levels):
        if width == max(w for w, _ in levels if w <= least):  # pairs that share less do not matter
            near = rank[order[:-1]] == rank[order[1:]]
            live, a, b = live[near[live]], a[near[live]], b[near[live]]
        padded = np.concatenate([rank, np.zeros(1, np.int64)])
        same = np.ones(len(a), bool)
        for _ in range(2 if width > 1 else PACK - 1):
            here = padded[np.minimum(a, n)]
            same &= (here == padded[np.minimum(b, n)]) & (here > 0)
            step = same * width
            common[live] += step
            a, b = a + step, b + step
    return order, common


def repeats(data: np.ndarray, place: np.ndarray, length: int = LENGTH, most: int = 2 * LENGTH - SEED):
    """(start, size) of the occurrences of maximal repeats of `length` or more, but the first, which `place` orders.

    `data` holds bytes + 1 and, between texts, numbers over 256 that occur once.
    """
    order, common = suffixes(data, most, length)
    left = np.concatenate([[0], data[:-1]])[order]
    turns = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]).tolist()  # equal at both ends: one left neighbour all through
    left, inside = left.tolist(), common >= length
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, sizes = [], []
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):  # order[low..high] share `length` or more
        stack: list[tuple[int, int]] = []  # (common length, first place) of the open intervals
        lengths = common[low:high].tolist()
        for i in range(low, high + 1):
            now = lengths[i - low] if i < high else 0
            begin = i
            while stack and stack[-1][0] > now:
                size, begin = stack.pop()
                if turns[i] > turns[begin] or left[begin] > 256:  # cannot be extended to the left
                    group = order[begin:i + 1]
                    late = group[place[group] > place[group].min()]
                    starts.append(late)
                    sizes.append(np.full(len(late), size))
            if now and (not stack or stack[-1][0] < now):
                stack.append((now, begin))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(sizes)


KEY = ["did", "dg"]


def keyed(docs: DataFrame) -> DataFrame:
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", did.alias("did"), F.hash(text).alias("dg"), text.alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """The rows with their text compressed, as they are moved between machines."""
    def fn(columns):
        yield {**{c: columns[c] for c in ("doc_id", *KEY)}, "bytes": [zlib.compress(t.encode(), 1) for t in columns["text"]]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, fn, f"doc_id {kind}, did long, dg int, bytes binary")


def _anchor_rows(columns):
    out = {c: [] for c in ("h", "c", "did", "dg", "at", "lo", "hi")}
    for did, dg, text in zip(columns["did"], columns["dg"], columns["text"]):
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) < LENGTH:
            continue
        hashes = Hashes(data)
        h, place, first, last = anchors(hashes, len(data))
        c = contexts(hashes, place, first, last)
        for name, values in (("h", h.view(np.int64)), ("c", c.view(np.int64)), ("at", place), ("lo", first), ("hi", last)):
            out[name].append(values)
        out["did"].append(np.full(len(h), did))
        out["dg"].append(np.full(len(h), dg))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def anchor_rows(docs: DataFrame) -> DataFrame:
    def fn(columns):
        got = _anchor_rows(columns)
        yield {"h": got["h"], "c": got["c"], "did": got["did"], "dg": got["dg"].astype(np.int32),
               "at": got["at"] << 16 | (got["at"] - got["lo"]) << 8 | (got["hi"] - got["at"] + LENGTH)}

    return map_batches(docs, fn, "h long, c long, did long, dg int, at long")


def first_start(at: str = "at") -> Column:
    return F.shiftright(at, 16) - F.shiftright(at, 8).bitwiseAND(F.lit(255).cast("long"))


def span_size(at: str = "at") -> Column:
    """Bytes from the first start to the end of the last string of an anchor."""
    return F.shiftright(at, 8).bitwiseAND(F.lit(255).cast("long")) + F.col(at).bitwiseAND(F.lit(255).cast("long"))


def marks(docs: DataFrame) -> DataFrame:
    """(did, dg, start, size): stretches of bytes that occur earlier, together all repeated strings of LENGTH."""
    rows = written(anchor_rows(docs))
    twice = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    rows = written(rows.join(twice, "h"))
    classes = written(rows.groupBy("h", "c").agg(F.min(F.struct(*KEY, "at")).alias("head"), F.count(F.lit(1)).alias("n")))
    again = rows.join(classes.filter("n > 1").select("h", "c", "head"), ["h", "c"]).filter(F.struct(*KEY, "at") > F.col("head"))
    whole = again.select(*KEY, first_start().alias("start"), span_size().alias("size"))
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    heads = classes.join(several, "h").select("h", "k", "head.*")
    spots = heads.select(*KEY, F.struct("h", "k", first_start().alias("lo"), span_size().alias("size")).alias("spot"))
    spots = spots.groupBy(*KEY).agg(F.collect_list("spot").alias("spots"))  # no more than a text has anchors
    cut = written(map_batches(packed(docs).join(spots, KEY), _cut, "h long, k long, did long, dg int, lo int, bytes binary"))
    few, many = cut.filter(F.col("k") <= MOST), cut.filter(F.col("k") > MOST)
    calls = max(1, few.count() // CALL_ROWS)
    pieces = few.withColumn("call", F.pmod(F.xxhash64("h"), F.lit(calls)))
    maximal = grouped(pieces, ["call"], _maximal, "did long, dg int, start long, size long")
    strings = map_batches(many, _strings, "w long, did long, dg int, start long")
    earliest = strings.groupBy("w").agg(F.min(F.struct(*KEY, "start")).alias("head"))
    late = strings.join(earliest, "w").filter(F.struct(*KEY, "start") > F.col("head"))
    return whole.union(maximal).union(late.select(*KEY, "start", F.lit(LENGTH).cast("long")))


def _cut(columns):
    out = {c: [] for c in ("h", "k", "did", "dg", "lo", "bytes")}
    for did, dg, data, spots in zip(columns["did"], columns["dg"], columns["bytes"], columns["spots"]):
        data = zlib.decompress(data)
        for spot in spots:
            for name, value in (("h", spot["h"]), ("k", spot["k"]), ("did", did), ("dg", dg), ("lo", spot["lo"]),
                                ("bytes", data[spot["lo"]:spot["lo"] + spot["size"]])):
                out[name].append(value)
    yield out


def _ranked(columns, starts: np.ndarray) -> np.ndarray:
    """Numbers in the order of (document, start)."""
    keys = list(zip(columns["did"], columns["dg"]))
    rank = {k: i for i, k in enumerate(sorted(set(keys)))}
    return np.array([rank[k] for k in keys], np.int64) << 40 | starts


def _maximal(columns) -> dict:
    """The stretches of each document that maximal repeats mark, overlapping ones as one."""
    lo = np.array(columns["lo"], np.int64)
    sizes = np.array([len(b) for b in columns["bytes"]], np.int64)
    owner = np.repeat(np.arange(len(lo)), sizes + 1)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    data = np.empty(len(owner), np.int64)
    within = np.arange(len(owner)) - begins[owner]
    last = within == sizes[owner]
    data[~last] = np.frombuffer(b"".join(columns["bytes"]), np.uint8).astype(np.int64) + 1
    data[last] = 257 + np.arange(len(lo))
    base = _ranked(columns, lo)
    found, length = repeats(data, base[owner] + within)
    places = base[owner[found]] + within[found]  # document and start in one number
    order = np.argsort(places, kind="stable")
    places, ends = places[order], (places + length)[order]
    if not len(places):
        return {"did": [], "dg": [], "start": [], "size": []}
    reach = np.maximum.accumulate(ends)
    heads = np.flatnonzero(np.concatenate([[True], places[1:] > reach[:-1]]))
    tails = np.concatenate([reach[heads[1:] - 1], reach[-1:]])
    who = owner[found][order][heads]
    pick = lambda c: [columns[c][i] for i in who.tolist()]
    return {"did": pick("did"), "dg": pick("dg"), "start": places[heads] & ((1 << 40) - 1), "size": tails - places[heads]}


def _strings(columns):
    out = {c: [] for c in ("w", "did", "dg", "start")}
    for did, dg, lo, data in zip(columns["did"], columns["dg"], columns["lo"], columns["bytes"]):
        n = len(data) - LENGTH + 1
        starts = np.arange(n)
        w = Hashes(np.frombuffer(data, np.uint8)).of(starts, starts + LENGTH)
        out["w"] += w.view(np.int64).tolist()
        out["did"] += [did] * n
        out["dg"] += [dg] * n
        out["start"] += (starts + lo).tolist()
    yield out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of spans (start, size)."""
    out: list[list[int]] = []
    for start, size in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + size)
        else:
            out.append([start, start + size])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs` (doc_id, text).

    A null text counts as empty; texts under LENGTH bytes stay whole; rows with the same id and text are one document
    and have the same result; other columns are ignored; an empty table gives no rows.
    """
    own = keyed(docs)
    spans = marks(own.select("doc_id", *KEY, "text")).groupBy(*KEY).agg(F.collect_set(F.struct("start", "size")).alias("spans"))

    def fn(columns):
        out = {c: [] for c in ("doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for doc_id, data, found in zip(columns["doc_id"], columns["bytes"], columns["spans"]):
            data = zlib.decompress(data)
            runs = merged([(s["start"], s["size"]) for s in found or []])
            parts, at = [], 0
            for a, b in runs:
                parts.append(data[at:a])
                at = b
            kept = b"".join([*parts, data[at:]])
            for name, value in zip(out, (doc_id, kept, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())):
                out[name].append(value)
        yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        packed(own).join(spans, KEY, "left"), fn,
        f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


@query("op4_repeats")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
