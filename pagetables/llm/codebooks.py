"""Vector codes by Lloyd rounds over cover trees.

Vectors are cut into parts; each part has a codebook of its own. Every task turns its rows into chunks and builds one
cover tree for each chunk and part, once. A node knows its centre, its radius and the range of its rows, whose sums
come from cumulative sums. In a round only those entries stay with a node that the triangle inequality leaves open;
a node with one entry left gives its whole range to it, other nodes pass the open entries on to their children, and the
rows of open leaves are compared exactly. Tasks return sums and counts per entry, a table bounded by the codebooks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm.common import in_blocks, out_schema, query, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components beyond this are set to it, so that all sums of a task fit 64 bits.
LIMIT = 1 << 28
#: Bytes of vectors in a chunk, rows that are not split further, and the radius of children to that of their node.
CHUNK_BYTES, LEAF, SHRINK = 2 << 20, 16, 0.7
SALTS = 32


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows whose vector is there and has finite components only."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select("vec_id", "label", "embedding")


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """Rows of `width` integers: floor(scale * x) of each component, zeros behind shorter vectors."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[owner, place] = np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype(np.int64)
    return out


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for i in range(points.shape[1]):
        out += (points[:, i, None] - entries[None, :, i]) ** 2
    return out


class CoverTree:
    """Rows in tree order; nodes (centre, start, end, first child, children) level by level, and their radii."""

    def __init__(self, order: np.ndarray, points: np.ndarray, nodes: np.ndarray, radii: np.ndarray):
        self.order, self.points, self.nodes, self.radii = order, points, nodes, radii

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK) -> CoverTree:
        def far(members, centre):
            return np.sqrt(((rows[members] - rows[centre]) ** 2).sum(axis=1).astype(np.float64))

        order = np.arange(len(rows))
        nodes, radii = [], []
        level = [(0, len(rows), far(order, 0))] if len(rows) else []  # a node's first row is its centre
        while level:
            below = []
            first = len(nodes) + len(level)
            for start, end, dist in level:
                radius = float(dist.max())
                children = 0
                if end - start > leaf and radius > 0:
                    rest, cover, at = order[start:end].copy(), radius * shrink, start
                    while len(rest):
                        near = dist <= cover
                        own, rest = rest[near], rest[~near]
                        order[at:at + len(own)] = own
                        below.append((at, at + len(own), dist[near]))
                        at, children = at + len(own), children + 1
                        if len(rest):
                            dist = far(rest, rest[0])
                nodes.append((start, start, end, first + len(below) - children, children))
                radii.append(radius)
            level = below
        return cls(order.astype(np.int32), rows[order].astype(np.int32), np.array(nodes, np.int32).reshape(-1, 5), np.array(radii, np.float64))

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest entry of each row in tree order, the lower one of equals, and how many rows were compared one by one."""
        points = self.points.astype(np.int64)
        codes = np.zeros(len(points), np.int64)
        at = np.zeros(min(1, len(self.nodes)), np.int64)
        open_ = np.ones((len(at), len(entries)), bool)
        compared = 0
        while len(at):
            centre, start, end, child, children = self.nodes[at].astype(np.int64).T
            far = np.where(open_, np.sqrt(distances(points[centre], entries).astype(np.float64)), np.inf)
            best = far.min(axis=1)
            reach = best + 2 * self.radii[at]
            open_ &= far <= (reach + 1e-9 * reach + 1e-6)[:, None]
            whole = open_.sum(axis=1) == 1
            codes[ranges(start[whole], end[whole])] = np.repeat(open_[whole].argmax(axis=1), (end - start)[whole])
            leaves = ~whole & (children == 0)
            if leaves.any():
                rows = ranges(start[leaves], end[leaves])
                left = np.repeat(open_[leaves], (end - start)[leaves], axis=0)
                exact = np.where(left, distances(points[rows], entries), np.iinfo(np.int64).max)
                codes[rows] = exact.argmin(axis=1)
                compared += len(rows)
            inner = ~whole & (children > 0)
            at, open_ = ranges(child[inner], (child + children)[inner]), np.repeat(open_[inner], children[inner], axis=0)
        return codes, compared

    def totals(self, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and component sums of each entry, from cumulative sums at the ends of runs of equal codes."""
        sums = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0, dtype=np.int64)])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
        if not len(codes):
            cuts = np.zeros(1, np.int64)
        n, out = np.zeros(entries, np.int64), np.zeros((entries, self.points.shape[1]), np.int64)
        np.add.at(n, codes[cuts[:-1]], np.diff(cuts))
        np.add.at(out, codes[cuts[:-1]], sums[cuts[1:]] - sums[cuts[:-1]])
        return n, out

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.order.tobytes(), self.points.tobytes(), self.nodes.tobytes(), self.radii.tobytes()

    @classmethod
    def unpacked(cls, size: int, order: bytes, points: bytes, nodes: bytes, radii: bytes) -> CoverTree:
        return cls(
            np.frombuffer(order, np.int32), np.frombuffer(points, np.int32).reshape(-1, size),
            np.frombuffer(nodes, np.int32).reshape(-1, 5), np.frombuffer(radii, np.float64),
        )


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def trees(vectors: DataFrame, width: int, parts: int = PARTS, chunk: int = CHUNK_BYTES) -> DataFrame:
    """One row for each chunk: vec_ids, labels, and the packed cover tree of every part."""
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    schema = f"vec_ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees array<struct<a:binary,b:binary,c:binary,d:binary>>"
    out = out_schema(vectors.sparkSession, schema)
    size = width // parts

    def fn(rows: pa.RecordBatch):
        whole = integers(rows.column("embedding"), width)
        packed = [CoverTree.build(whole[:, p * size:(p + 1) * size]).packed() for p in range(parts)]
        yield pa.RecordBatch.from_arrays([
            pa.array([rows.column("vec_id").to_pylist()], out.field(0).type), pa.array([rows.column("label").to_pylist()], out.field(1).type),
            pa.array([[dict(zip("abcd", p)) for p in packed]], out.field(2).type),
        ], schema=out)

    return in_blocks(vectors, fn, schema, chunk)


def _forest(row: dict, size: int) -> list[CoverTree]:
    return [CoverTree.unpacked(size, t["a"], t["b"], t["c"], t["d"]) for t in row["trees"]]


def improved(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floors of the means; entries without rows stay."""
    parts, entries, size = books.shape

    def run(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for p, tree in enumerate(_forest(row, size)):
                    got = tree.totals(tree.assign(books[p])[0], entries)
                    n[p] += got[0]
                    sums[p] += got[1]
        p, e = np.nonzero(n)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64())]
        columns += [pa.array(sums[p, e, i], pa.int64()) for i in range(size)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{i}" for i in range(size))])

    schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(size))
    rows = forest.select("trees").mapInArrow(run, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    )
    new = books.copy()
    for row in rows.collect():  # parts x entries rows at most
        new[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(size)]
    return new


def encoded(forest: DataFrame, books: np.ndarray, kinds: list[str]) -> DataFrame:
    """vec_id, label, code, error of every row of the chunks."""
    parts, _, size = books.shape
    schema = f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long"
    out = out_schema(forest.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.zeros((len(row["vec_ids"]), parts), np.uint8)
                error = np.zeros(len(row["vec_ids"]), np.int64)
                for p, tree in enumerate(_forest(row, size)):
                    found, _ = tree.assign(books[p])
                    codes[tree.order, p] = found
                    error[tree.order] += ((tree.points - books[p][found]) ** 2).sum(axis=1) if len(found) else 0
                columns = (row["vec_ids"], row["labels"], [c.tobytes().hex() for c in codes], error)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return forest.mapInArrow(run, schema)


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK_BYTES,
) -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, code, error) of `vectors` (vec_id, embedding, label), written, and the codebooks.

    Rows whose vector is null or holds null or non-finite components go. Vectors shorter than the longest one, and a
    length that `parts` does not divide, are filled up with zeros; integer components are held within +-LIMIT. Rows of
    equal vec_id are ordered by vector when the first entries are chosen, a null vec_id is the largest; fewer rows
    than entries give fewer entries. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    kept = usable(vectors)
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).collect()[0]["n"] or 0
    width = max(1, -(-longest // parts)) * parts
    heads = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    first = integers(pa.array([r["embedding"] for r in heads], pa.list_(pa.float64())), width)
    books = first.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    forest = written(trees(kept, width, parts, chunk))
    for _ in range(rounds):
        books = improved(forest, books)
    return written(encoded(forest, books, [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")])), books


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the rows that `compress` keeps."""
    codes, books = compress(vectors)
    name = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    # one label may hold a third of the rows: its rows are dealt over salts
    sums = sums.withColumnRenamed("label", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = codes.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sums, salted["label"].eqNullSafe(sums["of"]) & (salted["own"] == sums["salt"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def twin(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same codes in SQL: every round compares all rows with all entries."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
),
pieces AS MATERIALIZED (
  SELECT rid, p, list_slice(v, CAST(p * (len(v) // {parts}) + 1 AS BIGINT), CAST((p + 1) * (len(v) // {parts}) AS BIGINT)) AS x
  FROM kept, range({parts}) AS t(p)
),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM pieces WHERE rid <= {entries})"""]
    near = """
near{i} AS MATERIALIZED (
  SELECT rid, p, min(CAST(d AS HUGEINT) * 1000 + e) % 1000 AS e, min(d) AS d FROM (
    SELECT a.rid, a.p, b.e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM pieces a JOIN book{i} b ON a.p = b.p) GROUP BY rid, p
)"""
    for i in range(rounds):
        steps.append(near.format(i=i))
        steps.append(f"""
mean{i} AS MATERIALIZED (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM (
    SELECT p, e, j, sum(y) AS s, count(*) AS n FROM (
      SELECT b.p, b.e, unnest(a.x) AS y, generate_subscripts(a.x, 1) AS j FROM pieces a JOIN near{i} b ON a.rid = b.rid AND a.p = b.p
    ) GROUP BY p, e, j) GROUP BY p, e
),
book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m ON b.p = m.p AND b.e = m.e)""")
    steps.append(near.format(i=rounds))
    return f"""WITH {','.join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY rid),
named AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, n.codebooks_sha256
FROM kept k JOIN coded c ON k.rid = c.rid CROSS JOIN named n"""


@query("op13_vector_codes", twin())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "embeddings"))
