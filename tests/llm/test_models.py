"""Class model, collocations and vector codes against brute force, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagetables.llm import classlm, codebooks, collocations
from pagetables.llm.common import QUERIES, table, written

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, h long, n long, word string, block long, unit int, k int"


def docs_of(spark, rows):
    """Documents (doc_id, text, lang) with odd extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, x, "s", 1, 2, "w", 3, 4, 5) for i, t, x in rows], DOCS)


LONG = "ein langer Satz ohne Ende. " * 9000
ODD = [
    (1, None, "en"), (2, "", None), (3, " \n\t ", "de"), (4, "Hello, World", "en"), (4, "Hello, World", "en"), (None, "no id here", None),
    (None, None, None), (7, LONG, "de"), (8, LONG, "de"), (9, "x" * 70000, "und"), (10, "é ß \x01 \x00 \U0001f600 日本語!", ""),
]

# --- 11 -----------------------------------------------------------------------


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower:
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    return (words + [word] if word else words) + [None]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def base_of(rows):
    train = Counter(w for i, t, _ in rows if not is_held(i) for w in tokens_of(t))
    n, v = sum(train.values()), len(train)
    out = []
    for i, t, _ in rows:
        own = tokens_of(t)
        out.append((i, is_held(i), len(own), sum(train[w] > 0 for w in own), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_class_model_base_against_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op11_class_model"](spark, SF).collect()
    close([tuple(r)[:6] for r in got], base_of(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # a better model of texts it has not seen


def test_class_model_on_odd_and_empty_input(spark):
    got = classlm.score(docs_of(spark, ODD), rounds=2).collect()
    close([tuple(r)[:6] for r in got], base_of(ODD))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert classlm.score(docs_of(spark, []), rounds=2).collect() == []
    held = next(i for i in range(100) if is_held(i))
    alone = classlm.score(docs_of(spark, [(held, "nobody taught this", "en")]), rounds=2).collect()[0]
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score, alone.score) == (4, 0, 0, 0.0, 0.0)


def test_class_model_is_a_distribution(spark):
    """After every class the probabilities of all known words, the end and a new word sum to one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    blocks = written(classlm.with_counts(written(classlm.encoded(docs)), 512))
    model = classlm.learn(blocks, 8, 2)
    u, c = [model.units.rare], [0]
    for b in blocks.collect():
        _, _, _, unit, count = classlm._block(b.asDict(), model.units)
        once = np.frombuffer(b["first"], bool) & (count > 0)
        u += unit[once].tolist()
        c += count[once].tolist()
    u, c = np.array(u), np.array(c)
    assert len(u) == model.known + 1 and c.sum() == model.tokens
    each = 10.0 ** model.of_words(u, c)
    for kind in range(8):
        assert abs((10.0 ** model.steps[kind, model.classes[u]] * each).sum() - 1) < 1e-9


def test_exchange_gains_against_the_likelihood():
    """The gain of every move equals the difference of the likelihood of the regrouped bigrams."""
    rng = np.random.default_rng(3)
    line = rng.integers(0, 12, 400)
    classes = rng.integers(0, 4, 12)
    pairs = np.zeros((12, 12), np.int64)
    np.add.at(pairs, (line[:-1], line[1:]), 1)

    def matrix(kinds):
        m = np.zeros((4, 4), np.int64)
        np.add.at(m, (kinds[line[:-1]], kinds[line[1:]]), 1)
        return m

    for unit in range(12):
        behind, before = (np.bincount(classes, weights=x, minlength=4) for x in (pairs[unit], pairs[:, unit]))
        gain = classlm.gains(matrix(classes).astype(float), int(classes[unit]), behind, before, pairs[unit, unit])
        for to in range(4):
            other = classes.copy()
            other[unit] = to
            assert abs(gain[to] - (classlm.likelihood(matrix(other)) - classlm.likelihood(matrix(classes)))) < 1e-6


def test_profiles_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw = written(classlm.encoded(docs, 1 << 16))  # many blocks
    blocks = written(classlm.with_counts(raw, 500))
    counts, own = Counter(), {}
    for b in raw.collect():
        own[bytes(b["codes"]) + bytes(b["tails"])] = np.frombuffer(b["hashes"], np.int64).tolist()
        for h, n in zip(np.frombuffer(b["hashes"], np.int64).tolist(), classlm.from_planes(b["counts"]).tolist()):
            counts[h] += n
    tokens, known, once, heads = classlm.counted(blocks)
    assert (tokens, known) == (sum(counts.values()), sum(c > 0 for c in counts.values()))
    assert once == sum(c == 1 for c in counts.values())
    assert sorted(heads.tolist()) == sorted(h for h, c in counts.items() if c > 1 and (500 * c >= tokens or h == classlm.END))
    units = classlm.Units(heads)
    classes = np.arange(units.count) % 5
    expected = defaultdict(lambda: np.zeros(11, np.int64))
    for b in blocks.collect():
        held, sizes, codes, unit, known = classlm._block(b.asDict(), units)
        assert known.tolist() == [counts[h] for h in own[bytes(b["codes"]) + bytes(b["tails"])]]
        at = 0
        for gone, size in zip(held.tolist(), sizes.tolist()):
            line = [unit[codes[-1]], *unit[codes[at:at + size]]]
            at += size
            for a, z in zip(line, line[1:]):
                if not gone:
                    expected[int(a)][0] += a == z
                    expected[int(a)][1 + classes[z]] += 1
                    expected[int(z)][6 + classes[a]] += 1
    got = {r.unit: list(r)[1:] for r in classlm.profiles(blocks, units, classes, 5).collect() if r.unit < units.count}
    assert {k: v for k, v in got.items() if any(v)} == {k: v.tolist() for k, v in expected.items()}


# --- 12 -----------------------------------------------------------------------


def collocations_of(rows, least, longest, top):
    found, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            lower = lower.replace(c, "\n")
        for piece in lower.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in found.items():
        f = {p: a for p, a in f.items() if a >= least}
        best = []
        for p, a in f.items():
            inside = any(len(q) > len(p) and f[q] >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q in f)
            if len(p) > 1 and not inside:
                cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_collocations_against_brute_force(spark, shards):
    rng = random.Random(shards)
    words = ["a", "b", "B", "c.", "d", "e,f", "ü", "g\th", "x  y", "\n"]
    rows = [(i, " ".join(rng.choices(words, [9, 8, 7, 3, 2, 2, 1, 1, 1, 1], k=rng.randint(0, 60))), rng.choice(["en", "en", "de", None])) for i in range(150)]
    docs = docs_of(spark, rows).repartition(6)
    for slots in (1 << 20, 256, 4):  # with few slots phrases share them, counting starts early, counts stay exact
        got = sorted(map(tuple, collocations.collocations(docs, 6, 5, 40, shards, slots).collect()))
        assert got == collocations_of(rows, 6, 5, 40) and got


def test_collocations_on_odd_and_empty_input(spark):
    got = sorted(map(tuple, collocations.collocations(docs_of(spark, ODD), 2).collect()))
    assert got == collocations_of(ODD, 2, 5, 2000) and got
    assert collocations.collocations(docs_of(spark, [])).collect() == []


def test_collocation_scores_pass_64_bits(spark):
    words = spark.createDataFrame([("en", "x", 10**13, 1), ("en", "y", 10**13, 2)], "lang string, word string, n long, h long")
    phrases = spark.createDataFrame([(2, 1, 2, 10**13 - 1, 5)], "k byte, front long, back long, n long, h long")
    totals = spark.createDataFrame([("en", 9 * 10**16)], "lang string, n long")
    real, collocations.count = collocations.count, lambda *a: (words, phrases, totals)
    try:
        row = collocations.collocations(docs_of(spark, [])).collect()[0]
    finally:
        collocations.count = real
    assert row.score == 1000 * (10**13 - 1) * 9 * 10**16 // (10**13 * 10**13)


# --- 13 -----------------------------------------------------------------------


def codes_of(rows, parts=8, entries=16, rounds=6):
    good = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(1, -(-max((len(v) for _, v, _ in good), default=0) // parts)) * parts
    good = [(i, [math.floor(c * 4096) for c in v] + [0] * (width - len(v)), x, v) for i, v, x in good]
    size = width // parts
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[r[1][p * size:(p + 1) * size] for r in first] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * size:(p + 1) * size], e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _, _ in good:
                own[near(p, v)[1]].append(v[p * size:(p + 1) * size])
            books[p] = [[sum(c) // len(own[j]) for c in zip(*own[j])] if own[j] else e for j, e in enumerate(books[p])]
    found = [(i, [near(p, v) for p in range(parts)], x) for i, v, x, _ in good]
    sums = Counter()
    for _, f, x in found:
        sums[x] += sum(d for d, _ in f)
    name = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, bytes(j for _, j in f).hex(), sum(d for d, _ in f), sums[x], name) for i, f, x in found]


VECTORS = "vec_id long, embedding array<float>, label int, code string, salt int, own int, part int, entry int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, x, "c", 1, 2, 3, 4) for i, v, x in rows], VECTORS)


def by_text(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_codes_of_odd_vectors_against_brute_force(spark):
    rng = random.Random(5)
    grid = [[rng.choice([-0.5, 0.0, 0.25]) for _ in range(16)] for _ in range(30)]  # ties and repeated vectors
    rows = [(i if i % 7 else None, rng.choice(grid), rng.choice([0, 1, None])) for i in range(150)]
    rows += [(500, None, 1), (501, [1.0, None], 1), (502, [math.nan] * 16, 1), (503, [math.inf], 1), (-4, [], 2), (7, [0.125] * 11, None)]
    assert by_text(codebooks.digest(vectors_of(spark, rows)).collect()) == by_text(codes_of(rows))
    few = rows[:5]
    assert by_text(codebooks.digest(vectors_of(spark, few)).collect()) == by_text(codes_of(few))
    assert codebooks.digest(vectors_of(spark, [])).collect() == []


def test_codes_do_not_depend_on_chunks(spark):
    frame = table(spark, SF, "embeddings")
    one = by_text(codebooks.compress(frame)[0].collect())
    assert one == by_text(codebooks.compress(frame.repartition(3), chunk=1 << 12)[0].collect())


def test_cover_tree_against_all_distances():
    rng = np.random.default_rng(1)
    for rows in (rng.integers(-9, 9, (700, 3)), rng.normal(0, 900, (500, 8)).astype(np.int64), np.zeros((40, 2), np.int64)):
        tree = codebooks.CoverTree.build(rows.astype(np.int64), 4)
        assert sorted(tree.order.tolist()) == list(range(len(rows)))
        for centre, start, end, child, children in tree.nodes.tolist():
            inside = [tuple(tree.nodes[c, 1:3]) for c in range(child, child + children)]
            assert not inside or (inside[0][0] == start and inside[-1][1] == end and all(a[1] == b[0] for a, b in zip(inside, inside[1:])))
        entries = rows[rng.choice(len(rows), 12)].astype(np.int64)
        codes, _ = tree.assign(entries)
        assert (codes == codebooks.distances(tree.points.astype(np.int64), entries).argmin(axis=1)).all()
        n, sums = tree.totals(codes, 12)
        for e in range(12):
            assert n[e] == (codes == e).sum() and (sums[e] == tree.points[codes == e].sum(axis=0)).all()


def test_cover_tree_spares_comparisons_of_grouped_vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4000, (16, 8))
    rows = (centres[rng.integers(0, 16, 4000)] + rng.normal(0, 40, (4000, 8))).astype(np.int64)
    _, compared = codebooks.CoverTree.build(rows).assign(centres.astype(np.int64))
    assert compared < 400
