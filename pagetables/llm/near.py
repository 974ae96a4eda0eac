"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text is its set of five-word runs. TREES x DEPTH minima of hashed sets make its signature; each tree orders texts by
their DEPTH minima, so texts with a common prefix are one node of the tree's trie. Matching starts at the whole
prefixes and shortens them, tree after tree and level after level, until two sets of the wanted similarity share a node
of some tree with the target recall; in a node, texts that agree further down are joined first. Sets of joined groups
are then compared exactly.

Groups are cut into blocks: a task holds the texts of two blocks, and each pair of texts meets in one task. No pairs
are sent anywhere: a task returns the links it counted per text and a spanning forest of them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm.common import block_pairs, components, grouped, map_batches, merged, query, table, written
from pagetables.llm.vectors import mixed, run_hashes, word_hashes

SIZE, SIMILARITY = 5, 0.8
TREES, DEPTH = 16, 4
RECALL = 0.99998
#: The part of the missed share that may be due to signatures that agree in too few places.
UNLIKE = 1 / 1000
BLOCK = 512
#: Rows that one call of a grouped function gets, about; small groups share calls.
CALL_ROWS = 4096


def prefix_lengths(similarity: float = SIMILARITY, recall: float = RECALL) -> list[int]:
    """The prefix to match in each tree: all start at DEPTH and are shortened one by one until the recall is reached."""
    lengths = [DEPTH] * TREES
    steps = [(tree, depth) for depth in range(DEPTH - 1, 0, -1) for tree in range(TREES)]
    while math.prod(1 - similarity ** d for d in lengths) > 1 - recall:
        if not steps:
            raise ValueError(f"{TREES} trees cannot find pairs of similarity {similarity} with a recall of {recall}")
        tree, depth = steps.pop(0)
        lengths[tree] = depth
    return lengths


def least_agreement(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The most places in which two signatures can be asked to agree, while similar sets rarely have fewer."""
    n, missed = TREES * DEPTH, 0.0
    for places in range(n):
        missed += math.comb(n, places) * similarity ** places * (1 - similarity) ** (n - places)
        if missed > (1 - recall) * UNLIKE:
            return places
    return n


def shingles(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of words of each text, with repeats, and where each text's runs start; shorter texts are one run."""
    words, starts = word_hashes(texts)
    runs = run_hashes(words, size)
    parts, sizes = [], []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        part = runs[a:b - size + 1] if b - a >= size else run_hashes(words[a:b], b - a) if b > a else runs[:0]
        parts.append(part)
        sizes.append(len(part))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def signatures(texts: list[str]) -> list[bytes | None]:
    """TREES x DEPTH minima as bytes; none for a text without words."""
    flat, starts = shingles(texts)
    full = np.flatnonzero(np.diff(starts))
    out: list[bytes | None] = [None] * len(texts)
    if len(full):
        minima = np.empty((len(full), TREES * DEPTH), dtype=">u4")
        heads = starts[:-1][full]
        factors = mixed(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
        for k in range(TREES * DEPTH):
            turned = (flat * factors[k] + factors[-1 - k]) >> np.uint64(32)
            minima[:, k] = np.minimum.reduceat(turned.astype(np.uint32), heads)
        for row, i in zip(minima, full.tolist()):
            out[i] = row.tobytes()
    return out


def alike(minima: np.ndarray, tree: int, depth: int, least: int) -> list[int]:
    """A row of the same group for each row; rows that agree in `least` of their minima are one group."""
    n = len(minima)
    label = np.arange(n)
    own = minima[:, tree * DEPTH:(tree + 1) * DEPTH]
    order = np.lexsort(own.T[::-1])
    close = (minima[order[1:]] == minima[order[:-1]]).sum(axis=1) >= least
    for level in range(DEPTH, depth - 1, -1):  # neighbours in the sorted trie that share the whole prefix, then shorter ones
        near = close & (own[order[1:], :level] == own[order[:-1], :level]).all(axis=1)
        run = np.concatenate([[0], np.cumsum(~near)])
        heads = order[np.searchsorted(run, np.arange(run[-1] + 1))]
        label[order] = heads[run]
        if run[-1] == 0:
            return label.tolist()
    for i in range(n):  # what the neighbours left apart
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        found = others[(minima[others] == minima[i]).sum(axis=1) >= least]
        if len(found):
            label[np.isin(label, label[found])] = label[i]
    return label.tolist()


def groups(linked: np.ndarray) -> list[int]:
    """The first row of each row's connected group in a symmetric matrix of links."""
    n = len(linked)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i] = i
            edge = np.array([i])
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(axis=0) & (label < 0))
                label[edge] = i
    return label.tolist()


def verified(sets: list[np.ndarray], own: np.ndarray, a: int, b: int, similarity: float) -> tuple[np.ndarray, list[int]]:
    """Links of each set among the pairs that belong to blocks (a, b), and roots of the linked groups.

    Exact: shared members are counted for all pairs at once, frequent members by a product of 0/1 matrices and rare
    ones pair by pair.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owners = np.repeat(np.arange(n), sizes)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), dtype=np.int64)
    heavy = np.flatnonzero(counts > 16)
    column = np.full(len(values), -1)
    column[heavy] = np.arange(len(heavy))
    mine = column[inverse]
    for start in range(0, len(heavy), 4096):
        pick = (mine >= start) & (mine < start + 4096)
        ones = np.zeros((n, min(4096, len(heavy) - start)), dtype=np.float32)
        ones[owners[pick], mine[pick] - start] = 1
        shared += np.rint(ones @ ones.T).astype(np.int64)
    light = (counts[inverse] > 1) & (mine < 0)
    order = np.argsort(inverse[light], kind="stable")
    who, what = owners[light][order], inverse[light][order]
    for step in range(1, 16):
        if len(what) <= step:
            break
        same = what[step:] == what[:-step]
        pairs = who[:-step][same] * n + who[step:][same]
        got = np.bincount(pairs, minlength=n * n).reshape(n, n) if len(pairs) else 0
        shared += got + (got.T if len(pairs) else 0)
    union = sizes[:, None] + sizes[None, :] - shared
    linked = (shared >= similarity * union - 1e-9) & (shared > 0)
    np.fill_diagonal(linked, False)
    if a != b:
        linked &= own[:, None] != own[None, :]
    return linked.sum(axis=1), groups(linked)


def _calls(df: DataFrame, keys: list[str]) -> DataFrame:
    """Small groups share a call: `call` numbers them so that a call gets about CALL_ROWS rows."""
    calls = max(1, df.count() // CALL_ROWS)
    return df.withColumn("call", F.pmod(F.xxhash64(*keys), F.lit(calls)))


def _runs(columns: dict, keys: list[str]) -> list[list[int]]:
    by: dict = {}
    for i, key in enumerate(zip(*(columns[k] for k in keys))):
        by.setdefault(key, []).append(i)
    return list(by.values())


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row of `docs` (doc_id, text).

    class_id is the smallest doc_id of the documents that links join, directly or over others (null if none has an
    id); equal texts are always in one class. n_links counts the other texts of this similarity or more, each text once
    however many copies it has; n_copies counts the rows with this text. A null text is a class of its own; a text
    without words is linked to equal texts only. Repeated rows count as copies; other columns are ignored; an empty
    table gives no rows.
    """
    return classes(docs, similarity, recall).drop("digest", "root")


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of `join` with the digest of their text and the number of their class; both are null for a null text."""
    def sign(columns):
        yield {"doc_id": columns["doc_id"], "digest": columns["digest"], "sign": signatures([t or "" for t in columns["text"]])}

    source = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(map_batches(source, sign, f"doc_id {kind}, digest binary, sign binary"))
    texts = written(
        rows.filter(F.col("digest").isNotNull()).groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.max("sign").alias("sign"))
        .withColumn("tid", F.monotonically_increasing_id())
    )
    likely = components(candidates(texts.select("tid", "sign"), similarity, recall))
    members = texts.select("tid", "digest", "first_id").join(merged(likely), texts["tid"] == likely["id"]).select("tid", "digest", "first_id", "root")
    links = written(verify(source, members, similarity))
    counts = links.groupBy("tid").agg(F.sum("links").alias("n_links"))
    roots = components(links.filter("tid <> other").select(F.col("tid").alias("a"), F.col("other").alias("b")))
    classed = (
        texts.select("tid", "digest", "first_id", "n_copies").join(merged(roots), texts["tid"] == roots["id"], "left")
        .withColumn("root", F.coalesce("root", "tid")).drop("id")
    )
    first = classed.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classed = classed.join(merged(first), "root").join(merged(counts), "tid", "left").select("digest", "root", "class_id", "n_copies", "n_links")
    return rows.select("doc_id", "digest").join(merged(classed), "digest", "left").select(
        "doc_id", "digest", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, all columns, one of each class: of the smallest doc_id, then the smallest digest of a text.

    Different texts under one doc_id, or without one, are judged each on their own. Of repeated rows one stays, any of
    those with this id and text. A null text is a class of its own for each doc_id. An empty table gives no rows.
    """
    found = classes(docs, similarity).filter(F.col("root").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept_digest"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.unhex(F.md5("text")).alias("digest"))
    kept = rows.join(merged(first), (F.col("digest") == F.col("kept_digest")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))).select(*rows.columns)
    return kept.union(rows.filter(F.col("digest").isNull())).dropDuplicates(["doc_id", "digest"]).select("row.*")


def candidates(texts: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Edges (a, b) that join texts (tid, sign) of one node whose signatures agree enough; a forest for each task."""
    lengths, least = prefix_lengths(similarity, recall), least_agreement(similarity, recall)
    trees = texts.filter(F.col("sign").isNotNull()).select("tid", "sign", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    size = F.element_at(F.array(*[F.lit(4 * d) for d in lengths]), F.col("tree") + 1)
    prefix = F.col("sign").substr(F.col("tree") * (4 * DEPTH) + 1, size)
    nodes = trees.select("tid", "tree", F.xxhash64("tree", prefix).alias("node"))
    full = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    placed = _calls(block_pairs(nodes.join(merged(full), "node"), ["node"], "tid", BLOCK), ["node", "block_a", "block_b"])
    placed = placed.select("call", "tid", "tree", "node", "block_a", "block_b").join(merged(texts), "tid")

    def fn(columns):
        minima = np.frombuffer(b"".join(columns["sign"]), dtype=">u4").reshape(-1, TREES * DEPTH).astype(np.uint32)
        a, b = [], []
        for run in _runs(columns, ["node", "block_a", "block_b"]):
            ids = [columns["tid"][i] for i in run]
            if len(run) == 2:
                near = (minima[run[0]] == minima[run[1]]).sum() >= least
                pairs = [(0, 1)] if near else []
            else:
                tree = columns["tree"][run[0]]
                pairs = [(r, i) for i, r in enumerate(alike(minima[run], tree, lengths[tree], least)) if r != i]
            a += [ids[r] for r, _ in pairs]
            b += [ids[i] for _, i in pairs]
        return {"a": a, "b": b}

    return grouped(placed, ["call"], fn, "a long, b long").distinct()


def verify(source: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(tid, other, links): links that a task counted for a text, and a text of the same linked group (or itself)."""
    def hashed(columns):
        flat, starts = shingles(columns["text"])
        sets = [np.unique(flat[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        yield {"tid": columns["tid"], "root": columns["root"], "members": [s.tobytes() for s in sets]}

    named = members.select(F.col("digest").alias("own"), "first_id", "tid", "root")
    one = source.join(merged(named), (source["digest"] == named["own"]) & source["doc_id"].eqNullSafe(named["first_id"]))
    sets = map_batches(one.select("tid", "root", "text"), hashed, "tid long, root long, members binary")
    pairs = block_pairs(members.select("tid", "root"), ["root"], "tid", BLOCK)
    placed = _calls(pairs, ["root", "block_a", "block_b"]).join(merged(sets.drop("root")), "tid")

    def fn(columns):
        out: dict[str, list] = {"tid": [], "other": [], "links": []}
        for run in _runs(columns, ["root", "block_a", "block_b"]):
            run = list({columns["tid"][i]: i for i in run}.values())  # repeated rows of one document
            ids = [columns["tid"][i] for i in run]
            values = [np.frombuffer(columns["members"][i], dtype=np.uint64) for i in run]
            own = np.array([columns["own"][i] for i in run])
            counts, roots = verified(values, own, columns["block_a"][run[0]], columns["block_b"][run[0]], similarity)
            out["tid"] += ids
            out["other"] += [ids[r] for r in roots]
            out["links"] += counts.tolist()
        return out

    return grouped(placed, ["call"], fn, "tid long, other long, links long")


@query("op9_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
