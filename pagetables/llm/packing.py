"""Packing along a space-filling curve.

Each document's token counts are hashed to a vector, projected to four dimensions and placed on a Hilbert curve.
Documents are range-sorted by their place; the sequences are cut from that one order, so neighbours on the curve
share sequences, every sequence is full, and only the last one of the corpus needs padding.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetables.llm.common import BATCH_BYTES, map_batches, query, table, written

LENGTH = 2048
VOCABULARY = "word_bpe_49k.json"
END = 1
BUCKETS, DIMENSIONS, BITS = 256, 4, 8
#: Chunks of text with known ids that a worker keeps; the table is dropped when full.
KNOWN = 300_000
#: Ranges of the curve, at most; rows of a range for smaller corpora.
RANGES, RANGE_ROWS = 4096, 20_000

#: Latin letters, then marks that are neither letters, digits, white space nor apostrophes and start no special token.
SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-%*-.:;=?@\\[\\]^_|~]*)")

_state: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine keeps the public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as unsigned 16- or 32-bit numbers.

    White space never lies inside a token of this vocabulary's words, so the ids of a text are those of its chunks
    between ASCII blanks, one after the other. Each chunk is encoded once a batch, and not again while it is
    remembered. Chunks of Latin letters with a run of marks behind go to the tokenizer's model as the one or two words
    that its own rules would cut; every other chunk takes the tokenizer's whole path.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.simple = self.tokenizer.normalizer is not None and "Lowercase" in str(self.tokenizer.normalizer)
        self.code = "H" if self.kind == "<u2" else "I"
        self.letters: dict[str, str] = {}
        self.known: dict[str, bytes] = {"": b""}

    def _word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            spelled = word if word.isascii() else "".join(map(self._spell, word))
            found = self.known[word] = array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def _spell(self, letter: str) -> str:
        found = self.letters.get(letter)
        if found is None:
            found = self.letters[letter] = self.bytes.pre_tokenize_str(letter)[0][0]
        return found

    def chunk(self, chunk: str) -> bytes:
        found = self.known.get(chunk)
        if found is not None:
            return found
        parts = SIMPLE.fullmatch(chunk) if self.simple else None
        if parts:
            word, marks = parts.groups()
            return self._word(word.lower()) + self._word(marks) if marks else self._word(word.lower())
        found = array(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self.known[chunk] = found
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end id behind."""
        if len(self.known) > KNOWN:
            self.known = {"": b""}
        chunks = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = chunks.flatten().dictionary_encode()
        each = list(map(self.chunk, coded.dictionary.to_pylist()))
        width = np.dtype(self.kind).itemsize
        sizes = np.fromiter((len(e) // width for e in each), np.int64, len(each))
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = np.frombuffer(b"".join(each), dtype=self.kind)
        index = coded.indices.to_numpy()
        lengths = sizes[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(begins[index] - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
        end = np.array([END], dtype=self.kind)
        return [np.concatenate([ids[a:b], end]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def projection() -> np.ndarray:
    """Fixed signs that take hashed counts to DIMENSIONS numbers."""
    return np.random.default_rng(7).choice([-1.0, 1.0], size=(BUCKETS, DIMENSIONS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with `bits` bits per dimension."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    top = np.uint64(1 << (bits - 1))
    q = top
    while q > 1:  # undo the turns and mirrors of the cells, from the largest
        low = q - np.uint64(1)
        for i in range(n):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - np.uint64(1)), turn)
        q >>= np.uint64(1)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return key.astype(np.int64)


def places(ids: list[np.ndarray]) -> np.ndarray:
    """The curve place of each document's ids."""
    counts = np.stack([np.bincount(i % BUCKETS, minlength=BUCKETS) for i in ids]).astype(np.float64)
    flat = counts @ projection() / np.maximum(1, np.sqrt((counts ** 2).sum(axis=1)))[:, None]
    return hilbert(np.clip((np.tanh(flat / 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def tokenized(docs: DataFrame, path=vocabulary_path) -> DataFrame:
    """doc_id, doc_tokens, place and ids of every row; a null text is empty and has the end id alone."""

    def fn(columns):
        if "encoder" not in _state:
            _state["encoder"] = Encoder(path())
        coder = _state["encoder"]
        ids = coder.encode([t or "" for t in columns["text"]])
        yield {"doc_id": columns["doc_id"], "doc_tokens": [len(i) for i in ids], "width": [np.dtype(coder.kind).itemsize] * len(ids),
               "place": places(ids).tolist(), "ids": [i.tobytes() for i in ids]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), fn, f"doc_id {kind}, doc_tokens long, width int, place long, ids binary", BATCH_BYTES)


def pack(docs: DataFrame, length: int = LENGTH, path=vocabulary_path) -> DataFrame:
    """The pieces of every row of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts give one piece with the end id. Repeated rows are packed each on their own; an empty table
    gives no pieces; other columns are ignored. Documents with equal places are ordered by a hash of their id, so that
    copies may lie in several ranges.
    """
    rows = written(tokenized(docs, path).withColumn("uid", F.monotonically_increasing_id()))
    small = rows.select("uid", "doc_id", "doc_tokens", "place")
    ranges = int(min(RANGES, max(1, small.count() // RANGE_ROWS)))
    order = ["place", "tie", "uid"]
    sorted_rows = written(
        small.withColumn("tie", F.xxhash64("doc_id")).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .select("uid", "doc_tokens", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row"))
    )
    sums = sorted_rows.groupBy("range").agg(F.sum("doc_tokens").alias("n"))  # one row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_start"))
    inner = Window.partitionBy("range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = sorted_rows.withColumn("inner", F.coalesce(F.sum("doc_tokens").over(inner), F.lit(0)))
    at = inside.join(F.broadcast(starts), "range").select("uid", (F.col("range_start") + F.col("inner")).alias("at"))

    def fn(columns):
        out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        for doc_id, ids, width, at in zip(columns["doc_id"], columns["ids"], columns["width"], columns["at"]):
            wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4").tobytes()
            total, start = len(wide) // 4, 0
            while start < total:
                offset = (at + start) % length
                size = min(length - offset, total - start)
                values = (doc_id, start, size, zlib.crc32(wide[4 * start:4 * (start + size)]), total, (at + start) // length, offset)
                for column, value in zip(out.values(), values):
                    column.append(value)
                start += size
        yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    # sorted and merged at every size: the ids are moved once and no side is held in memory
    joined = rows.select("uid", "doc_id", "ids", "width").join(at.hint("merge"), "uid").drop("uid")
    return map_batches(
        joined, fn, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
