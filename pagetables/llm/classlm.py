"""Language model scores of texts by word classes.

The probability of a word is that of its class after the class of the word before, times that of the word in its class.
Classes come from exchange clustering: a word moves to the class that raises the likelihood of the training text
most. What moves are units: every word that makes at least one in HEAD training words (so there are at most HEAD of
them) is a unit; the other words that come twice or more share a unit by their last bytes; words that come once and
words that never came are one unit, which teaches how often new words come. The number of units has a fixed bound, so
their class profiles are a bounded table; word counts are exact and stay distributed.

Texts are encoded once, in blocks with the distinct words of each; the counts of those words come to the block by a
sum over the word's hash. Every exchange round scans the encoded training texts and sums, for each unit, the classes
before and behind it; then the units move one after the other, with the class counts kept up to date.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetables.llm.common import forget, in_blocks, out_schema, query, table, written
from pagetables.llm.vectors import GOLDEN, byte_hashes, byte_set, from_planes, mixed, planes, split_words

CLASSES, ROUNDS = 48, 7
#: Units: words with this share of the training words or more, and groups of other words by their last bytes.
HEAD, TAILS, TAIL_BYTES = 1 << 14, 1 << 11, 3
#: Counts that smooth: of a class in a class's successors, and of any class.
PRIOR, FLOOR = 8.0, 0.5
BLOCK_BYTES = 14 << 20
#: Fixed values of the contract: bytes that end a word.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
END = 0


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def encoded(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """One row a block: doc_ids, held, sizes, codes of all words with the end last; of each distinct word its hash, tail
    group and count in the training texts of the block; and the number of all training words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_ids array<{kind}>, held binary, sizes binary, codes binary, tails binary, hashes binary, counts binary, taught long"
    out = out_schema(docs.sparkSession, schema)
    blank = byte_set(BLANKS)

    def fn(rows: pa.RecordBatch):
        codes, words, owner, _, _ = split_words(rows.column("text"), blank)
        held = rows.column("held").to_numpy(zero_copy_only=False)
        sizes = np.bincount(owner, minlength=rows.num_rows).astype(np.int64) + 1
        with_ends = np.full(sizes.sum(), len(words), np.int32)
        with_ends[np.arange(len(codes)) + owner] = codes
        counts = np.bincount(with_ends[np.repeat(~held, sizes)], minlength=len(words) + 1)
        hashes = np.append(byte_hashes(words), np.uint64(END))
        values = (
            rows.column("doc_id").to_pylist(), held.tobytes(), sizes.tobytes(), planes(with_ends), tails(words).tobytes(),
            hashes.tobytes(), planes(counts), int(counts.sum()),
        )
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out)], schema=out)

    rows = in_blocks(docs.select("doc_id", "text", held_out().alias("held")), fn, schema, size)
    return rows.withColumn("block", F.monotonically_increasing_id())


def tails(words: pa.Array, groups: int = TAILS) -> np.ndarray:
    """The group of each distinct word, by its last bytes, and group 0 for the end."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    out = np.zeros(len(words) + 1, np.int16)
    if len(words):
        data = np.frombuffer(words.buffers()[2], np.uint8)
        total = np.zeros(len(words), np.uint64)
        for i in range(1, TAIL_BYTES + 1):
            at = offsets[1:] - i
            total = total * np.uint64(257) + np.where(at >= offsets[:-1], data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        out[:-1] = mixed(total * GOLDEN) % np.uint64(groups)
    return out


def with_counts(blocks: DataFrame, head: int = HEAD) -> DataFrame:
    """The blocks with the corpus-wide counts of their distinct words instead of their hashes.

    `known` has the counts in the training texts; `first` says whether the block stands for the word when distinct words
    are counted; `places` and `heads` are the words that are units of their own, and their hashes.
    """
    schema = "block long, pos int, h long, n long"
    out = out_schema(blocks.sparkSession, schema)
    least = max(2, -(-training_words(blocks) // head))

    def listed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = np.frombuffer(row["hashes"], np.int64), from_planes(row["counts"]).astype(np.int64)
                for at in range(0, len(hashes), 1 << 17):
                    h, n = hashes[at:at + (1 << 17)], counts[at:at + (1 << 17)]
                    columns = np.full(len(h), row["block"]), np.arange(at, at + len(h), dtype=np.int32), h, n
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=out)

    each = blocks.select("block", "hashes", "counts").mapInArrow(listed, schema)
    order = Window.partitionBy("h").orderBy("block", "pos")  # a word has one row in each block
    total = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    each = each.select("block", "pos", total.alias("c"), (F.row_number().over(order) == 1).alias("first"), "h")
    own = (F.col("c") >= least) | ((F.col("h") == END) & (F.col("c") > 1))
    each = each.withColumn("h", F.when(own, F.col("h")))
    kept = [c for c in blocks.columns if c not in ("block", "hashes", "counts")]
    added = [T.StructField(c, T.BinaryType()) for c in ("known", "first", "places", "heads")]
    types = T.StructType([*blocks.select(*kept).schema, *added])
    final = out_schema(blocks.sparkSession, types)

    def joined(block: pa.Table, rows: pa.Table) -> pa.Table:  # one block and a row for each of its distinct words
        known, first = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, bool)
        pos = rows.column("pos").to_numpy()
        known[pos], first[pos] = rows.column("c").to_numpy(), rows.column("first").to_numpy()
        mine = rows.filter(pc.is_valid(rows.column("h")))
        values = known, first, mine.column("pos").to_numpy(), mine.column("h").to_numpy()
        return pa.Table.from_arrays([*(block.column(c) for c in kept), *(pa.array([v.tobytes()]) for v in values)], schema=final)

    return blocks.select("block", *kept).groupBy("block").cogroup(each.groupBy("block")).applyInArrow(joined, types)


def training_words(blocks: DataFrame) -> int:
    return int(blocks.agg(F.sum("taught").alias("n")).collect()[0]["n"] or 0)


def counted(blocks: DataFrame) -> tuple[int, int, int, np.ndarray]:
    """Training words, distinct ones, those that come once, and the hashes of the words that are units of their own."""

    def fn(batches):
        for batch in batches:
            for row in batch.to_pylist():
                known, first = np.frombuffer(row["known"], np.int64), np.frombuffer(row["first"], bool)
                own = np.frombuffer(row["heads"], np.int64)
                sums = [int((first & (known > 0)).sum()), int((first & (known == 1)).sum())]
                yield pa.RecordBatch.from_arrays([pa.array([*own.tolist(), None], pa.int64()), *(pa.array([0] * len(own) + [x]) for x in sums)], names=["h", "v", "once"])

    rows = blocks.select("known", "first", "heads").mapInArrow(fn, "h long, v long, once long")
    found = rows.groupBy("h").agg(F.sum("v").alias("v"), F.sum("once").alias("once")).collect()  # head + 2 rows at most
    heads = np.array([r["h"] for r in found if r["h"] is not None], np.int64)
    return training_words(blocks), sum(r["v"] for r in found), sum(r["once"] for r in found), heads


class Units:
    """Numbers of the units of a block's distinct words: head words by their hash, tail groups, and the rare unit."""

    def __init__(self, heads: np.ndarray, groups: int = TAILS):
        self.heads, self.groups = np.sort(heads), groups
        self.rare = len(heads) + groups
        self.count = self.rare + 1

    def of(self, known: np.ndarray, tail: np.ndarray, places: np.ndarray, heads: np.ndarray) -> np.ndarray:
        unit = np.where(known > 1, len(self.heads) + tail.astype(np.int64), self.rare)
        unit[places] = np.searchsorted(self.heads, heads)
        return unit


COLUMNS = ["held", "sizes", "codes", "tails", "known", "places", "heads"]


def _block(row: dict, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each text is held out, its number of words, the codes, and the unit and count of each distinct word."""
    known = np.frombuffer(row["known"], np.int64)
    unit = units.of(known, np.frombuffer(row["tails"], np.int16), np.frombuffer(row["places"], np.int32), np.frombuffer(row["heads"], np.int64))
    return np.frombuffer(row["held"], bool), np.frombuffer(row["sizes"], np.int64), from_planes(row["codes"]), unit, known


def profiles(blocks: DataFrame, units: Units, classes: np.ndarray, count: int = CLASSES) -> DataFrame:
    """(unit, same, s0 .., p0 ..): how often each class stands behind and before a unit in the training texts, and the
    unit behind itself. Units from units.count on are the classes themselves."""
    names = ["same", *(f"s{i}" for i in range(count)), *(f"p{i}" for i in range(count))]
    schema = "unit int, " + ", ".join(f"{n} long" for n in names)

    def run(batches):
        behind = np.zeros((units.count, count), np.int64)
        before = np.zeros((units.count, count), np.int64)
        same = np.zeros(units.count, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                held, sizes, codes, unit, _ = _block(row, units)
                line = unit[codes[np.repeat(~held, sizes)]]
                if not len(line):
                    continue
                line = np.append(line[-1], line)  # an end stands before the first word
                kind = classes[line].astype(np.int64)
                behind += np.bincount(line[:-1] * count + kind[1:], minlength=behind.size).reshape(behind.shape)
                before += np.bincount(line[1:] * count + kind[:-1], minlength=before.size).reshape(before.shape)
                same += np.bincount(line[1:][line[1:] == line[:-1]], minlength=units.count)
        by_class = np.zeros((count, count), np.int64)
        np.add.at(by_class, classes, behind)
        some = np.flatnonzero(before.any(axis=1))
        unit = np.concatenate([some, units.count + np.arange(count)])
        values = np.hstack([
            np.concatenate([same[some], np.zeros(count, np.int64)])[:, None], np.vstack([behind[some], by_class]), np.vstack([before[some], np.zeros_like(by_class)]),
        ])
        yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), *(pa.array(c) for c in values.T.copy())], names=["unit", *names])

    rows = blocks.select(*COLUMNS).mapInArrow(run, schema)
    return rows.groupBy("unit").agg(*[F.sum(n).alias(n) for n in names])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(matrix: np.ndarray) -> float:
    """What the classes add to the log-likelihood of the training text."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(axis=0)).sum() - _xlogx(matrix.sum(axis=1)).sum())


def gains(matrix: np.ndarray, own: int, behind: np.ndarray, before: np.ndarray, same: int) -> np.ndarray:
    """What `likelihood` gains when a unit leaves its class for each class; staying gains 0."""
    m = matrix.copy()
    _move(m, own, behind, before, same, -1)
    s, p = behind.copy(), before.copy()
    s[own] -= same
    p[own] -= same
    rows = _xlogx(m + s) - _xlogx(m)
    columns = _xlogx(m + p[:, None]) - _xlogx(m)
    cell = np.diag(m)
    both = rows.sum(axis=1) - np.diag(rows) + columns.sum(axis=0) - np.diag(columns) + _xlogx(cell + s + p + same) - _xlogx(cell)
    out_of, into = m.sum(axis=1) + p, m.sum(axis=0) + s  # the neighbours' counts come back, whatever the class
    both -= _xlogx(out_of + behind.sum()) - _xlogx(out_of) + _xlogx(into + before.sum()) - _xlogx(into)
    return both - both[own]


def _move(m: np.ndarray, kind: int, behind: np.ndarray, before: np.ndarray, same: int, sign: int) -> None:
    """Add a unit's counts to those of a class, or take them away; counts within the class stand in both."""
    m[kind] += sign * behind
    m[:, kind] += sign * before
    m[kind, kind] -= sign * same


def exchanged(rows: pa.Table, matrix: np.ndarray, classes: np.ndarray, turn: int = 0) -> np.ndarray:
    """The classes after each unit, the most frequent first, has gone to its best class; every second one from turn 1 on.

    Each move changes the class counts that the next unit sees, so a class does not draw all units at once; the classes
    of a unit's neighbours are those of the last scan until the next one.
    """
    count = len(matrix)
    unit = rows.column("unit").to_numpy()
    behind, before = (np.stack([rows.column(f"{x}{c}").to_numpy() for c in range(count)], axis=1).astype(np.float64) for x in "sp")
    same = rows.column("same").to_numpy().astype(np.float64)
    m, new = matrix.astype(np.float64), classes.copy()
    for i in np.lexsort((unit, -before.sum(axis=1))).tolist():
        if turn and (unit[i] + turn) % 2:
            continue  # neighbours that move at the same time would go by each other's old classes
        own = int(new[unit[i]])
        s, p = behind[i].copy(), before[i].copy()
        gain = gains(m, own, s, p, same[i])
        to = int(gain.argmax())
        if gain[to] > 1e-6:
            rest_s, rest_p = s.copy(), p.copy()
            rest_s[own] -= same[i]
            rest_p[own] -= same[i]
            _move(m, own, s, p, same[i], -1)
            m[to] += rest_s
            m[:, to] += rest_p
            m[to, to] += same[i]
            np.maximum(m, 0, out=m)
            new[unit[i]] = to
    return new


class Model:
    """Log probabilities: of a class after a class, and of a unit in its class."""

    def __init__(self, units: Units, classes: np.ndarray, matrix: np.ndarray, totals: np.ndarray, once: int, known: int, tokens: int):
        self.units, self.classes = units, classes
        self.once, self.known, self.tokens = once, known, tokens
        own = totals.astype(np.float64)
        own[units.rare] += 1  # there may be no word that came once
        size = np.bincount(classes, weights=own, minlength=len(matrix))
        prior = matrix.sum(axis=0) + FLOOR * (size > 0)  # a class without words never comes
        self.steps = np.log10((matrix + PRIOR * prior / prior.sum() + 1e-300) / (matrix.sum(axis=1, keepdims=True) + PRIOR))
        own = np.maximum(own, 1)  # units without words are never asked for
        self.words = np.log10(own) - np.log10(np.maximum(size[classes], 1))
        self.totals = np.log10(own)

    def of_words(self, unit: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The log probability of words in their classes: a tail word has its share of its group; of the rare unit new
        words have one half and the words that came once the other, or new words all where there are none."""
        n = np.maximum(known, 1)
        share = np.where(unit < len(self.units.heads), 0.0, np.log10(n) - self.totals[unit])
        rare = np.where(known > 0, -np.log10(2.0 * max(1, self.once)), -np.log10(2.0) if self.once else 0.0)
        return self.words[unit] + np.where(unit == self.units.rare, rare, share)

    def base(self, known: np.ndarray) -> np.ndarray:
        return np.log10((known + 0.5) / (self.tokens + 0.5 * (self.known + 1)))


def learn(blocks: DataFrame, count: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """Exchange clustering over the training texts of the blocks; the round of the highest likelihood counts."""
    tokens, known, once, heads = counted(blocks)
    units = Units(heads)
    classes = (np.arange(units.count) % count).astype(np.int64)
    best = None
    for i in range(rounds):
        rows = written(profiles(blocks, units, classes, count))
        matrix = np.zeros((count, count), np.int64)
        for row in rows.filter(F.col("unit") >= units.count).collect():
            matrix[row["unit"] - units.count] = [row[f"s{c}"] for c in range(count)]
        value = likelihood(matrix)
        if best is None or value > best[0]:
            before = sum((F.col(f"p{c}") for c in range(count)), F.lit(0))
            totals = np.zeros(units.count, np.int64)
            for row in rows.filter(F.col("unit") < units.count).select("unit", before.alias("n")).collect():
                totals[row["unit"]] = row["n"]
            best = value, classes, matrix, totals
        if i + 1 < rounds:
            table_ = rows.filter(F.col("unit") < units.count).toArrow()  # a row for each unit, whose number is bounded
            classes = exchanged(table_, matrix, classes, i)
        forget(rows)
    return Model(units, *best[1:], once, known, tokens)


def scored(blocks: DataFrame, model: Model, kind: str) -> DataFrame:
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = out_schema(blocks.sparkSession, schema)
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                held, sizes, codes, unit, known = _block(row, model.units)
                last = unit[codes[-1]]  # the end
                line = unit[codes]
                starts = np.cumsum(sizes) - sizes
                before = np.append(last, line[:-1])
                before[starts] = last
                values = model.steps[model.classes[before], model.classes[line]] + model.of_words(unit, known)[codes]
                columns = (
                    row["doc_ids"], held, sizes, np.add.reduceat((known > 0).astype(np.int64)[codes], starts), np.full(len(sizes), model.tokens),
                    np.add.reduceat(model.base(known)[codes], starts), np.add.reduceat(values, starts),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return blocks.select("doc_ids", *COLUMNS).mapInArrow(run, schema)


def score(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, head: int = HEAD, size: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs` (doc_id, text).

    A null text is empty and has the end alone. Documents without an id teach. Repeated rows stay and teach each time;
    where no text teaches, every word is new and scores 0; other columns are ignored; an empty table gives no rows.
    """
    raw = written(encoded(docs, size))
    blocks = written(with_counts(raw, head))
    forget(raw)
    return scored(blocks, learn(blocks, classes, rounds), docs.schema["doc_id"].dataType.simpleString())


@query("op11_class_model")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
