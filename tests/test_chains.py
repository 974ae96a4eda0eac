"""Cursor chains by pointer doubling against a walk."""

import random

from pagetables.sources import payloads as PL


def walk(pages):
    by = {}
    for g, cursor, nxt, _ in pages:
        by.setdefault((g, cursor), nxt)
    out = {}
    for g in {p[0] for p in pages}:
        chain, at, seen = [], None, set()
        while (g, at) in by and at not in seen:
            seen.add(at)
            chain.append(at)
            if by[(g, at)] is None:
                break
            at = by[(g, at)]
        if chain:
            end = "end" if by[(g, chain[-1])] is None else "cycle" if at in seen else "dangling"
            out[g] = chain, end
    return out


def test_chains_equal_a_walk(spark):
    rng = random.Random(4)
    pages = []
    for g in [None, *range(40)]:
        n = rng.choice([1, 2, 3, 7, 16, 33])
        names = [None, *rng.sample([f"c{i}" for i in range(100)] + [""], n - 1)]
        if g == 5:
            names[0] = "x"  # no first page
        for a, b in zip(names, [*names[1:], rng.choice([None, "gone", names[-1], names[n // 2]])]):
            pages += [(g, a, b, [a])] * rng.choice([1, 1, 2])  # repeated answers
        pages.append((g, "alone", "c1", []))
    pages = list({(p[0], p[1]): p for p in pages}.values()) + pages[:9]
    frame = spark.createDataFrame(pages, "g int, cursor string, next_cursor string, items array<string>")
    got = {}
    for r in PL.chain_cursors(frame, ["g"]).collect():
        got.setdefault(r.g, []).append((r.page_seq, r.cursor, r.next_cursor, r.chain_end))
    expected = walk(pages)
    assert set(got) == set(expected)
    for g, (chain, end) in expected.items():
        rows = sorted(got[g], key=lambda r: r[0])
        assert [r[:2] for r in rows] == list(enumerate(chain))
        assert [r[3] for r in rows] == [None] * (len(chain) - 1) + [end]
        assert [r[2] for r in rows] == [*chain[1:], None]
    ends = {r.g: (r.pages, r.chain_end, r.unreached) for r in PL.cursor_chains(frame, ["g"]).collect()}
    for g in {p[0] for p in pages}:
        known = len({p[1] for p in pages if p[0] == g})
        chain, end = expected.get(g, ([], "no start"))
        assert ends[g] == (len(chain), end, known - len(chain))


def test_chains_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "g int, cursor string, next_cursor string, items array<string>")
    assert PL.chain_cursors(frame, ["g"]).collect() == []
    assert PL.paginate_cursor_tokens(frame, ["g"], limit=3).collect() == []
