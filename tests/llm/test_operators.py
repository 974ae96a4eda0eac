"""The ten operators and the pipeline against brute force, and on odd input."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetables.llm import decontaminate, extract, language, near, packing, pii, quality, repeats, sharding, urlrules
from pagetables.llm.common import QUERIES, components, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, score double, row string, uid long, digest string, at int, shard int"
LONG = "Ein sehr langer Text ohne Ende und Ziel. " * 4000


def docs_of(spark, texts, ids=None):
    """Documents with odd extra columns whose names the operators use themselves."""
    rows = [
        (i, t, ("en", "de", None)[n % 3], ("a", None, "b")[n % 3], 0.5, "r", 1, "d", 2, 3)
        for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts))
    ]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "a", "Hello, World", "Hello, World", LONG, LONG, "é ß \x01 \x00 \U0001f600 日本語 text", "x" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    frame = docs_of(spark, ODD)
    return frame.union(frame.filter("doc_id = 4"))  # a repeated row


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# --- 1 ------------------------------------------------------------------------

RULED = [
    ("https://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/25#top", "m.example.com", "/en/25", "example.com/en/", "block"),
    ("http://m.example.com/de/1", "m.example.com", "/de/1", "com/", "allow"),
    ("http://a.b.net/es/1", "a.b.net", "/es/1", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://notexample.com?q=/en/", "notexample.com", "", None, "allow"),
    ("http://xcom/a", "xcom", "/a", None, "allow"),
    ("nothing", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://B.com/x://y", "b.com", "/x://y", "com/", "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(RULED)], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    got = {r.page_id: r for r in urlrules.judge(pages.union(pages.limit(1)), labels).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(RULED):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert urlrules.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(5)
    rows, label = [], []
    for i in range(400):
        host, part = rng.choice(["a.org", "b.org", "c.org"]), rng.choice(["x", "y"])
        rows.append((i, f"http://{host}/{part}/{i}"))
        bad = host == "b.org" and part == "y" if rng.random() < 0.9 else rng.random() < 0.5
        label.append((i, None if i % 50 == 0 else 1, int(bad)))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(label, "doc_id long, quality long, toxic long")
    got = urlrules.judge(pages, labels.union(labels.limit(40)), least=20, confidence=0.5).collect()
    truth = {i: bool(t) for i, _, t in label}
    sets = {i: {f"site={u.split('/')[2]}", *(f"host={h}" for h in u.split("/")[2].split(".")), f"path={u.split('/')[3]}", "path=0"} for i, u in rows}

    def sure(need):
        hit = [i for i in sets if need <= sets[i]]
        bad, n = sum(truth[i] for i in hit), len(hit)
        p, z = bad / n, 9.0
        return (p + z / (2 * n) - 3 * (p * (1 - p) / n + z / (4 * n * n)) ** 0.5) / (1 + z / n) if bad >= 20 else 0, p

    floor = max(0.5, 1 - (1 - sum(truth.values()) / len(truth)) / 1.5)
    blocked = set()
    for r in got:
        own = sorted(sets[r.page_id])
        subsets = [set(c) for k in range(1, len(own) + 1) for c in itertools.combinations(own, k)]
        fits = [sure(s) for s in subsets if sure(s)[0] >= floor]
        assert (r.verdict == "block") == bool(fits)
        if fits:
            blocked.add(r.page_id)
            assert r.confidence in [p for _, p in fits]
    assert 20 < len(blocked) < 200


def test_labels_by_chance_block_nothing(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url")
    for seed in (1, 2):
        chance = pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("quality"), (F.rand(seed) < 0.25).cast("int").alias("toxic"))
        assert urlrules.judge(pages, chance, ()).filter("verdict = 'block'").count() == 0


@pytest.mark.parametrize("others", [80, 20000])
def test_a_bad_host_of_twenty_pages_is_found(spark, others):
    url = F.when(F.col("id") < 20, F.lit("http://spam.biz/a/")).otherwise(F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".org/p/")))
    pages = spark.range(20 + others).select(F.col("id").alias("page_id"), F.concat(url, F.col("id")).alias("url"))
    bad = (F.col("page_id") < 20) | (F.pmod(F.xxhash64("page_id"), F.lit(5)) == 0)
    labels = pages.select(F.col("page_id").alias("doc_id"), F.lit(None).cast("int").alias("quality"), bad.cast("int").alias("toxic"))
    got = [r.page_id for r in urlrules.judge(pages, labels).filter("verdict = 'block'").collect()]
    assert sorted(got) == list(range(20))


# --- 2 ------------------------------------------------------------------------

def base_numbers(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_base(spark, odd, texts):
    for frame, known in ((odd, dict(enumerate(ODD))), (table(spark, SF, "documents"), texts)):
        for r in quality.judge(frame).collect():
            own = base_numbers(known[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
            assert r.base_failed == (own[0] < 20 or 100 * own[4] > 30 * own[0])
            assert not (r.kept and r.base_failed)


def test_quality_lines(spark, empty):
    own = lambda i: " ".join(f"word{i}{chr(97 + j)}" for j in range(40))
    shared = " ".join(f"menu{j}" for j in range(400))
    rows = [(i, f"{own(chr(97 + i))}\n{shared}" if i % 2 else shared + f"\n{i} only little here", "h") for i in range(24)]
    rows += [(100 + i, own("z") + "\nCopy of one page " * 2, "g") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(frame).collect()}
    assert not any(got[i].kept for i in range(0, 24, 2)) and got[0].words_left <= 4
    assert all(got[100 + i].words_left == got[100].n_words for i in range(50))  # copies of one text are one text
    assert quality.judge(empty).count() == 0


def test_quality_limits_at_three_sizes(spark):
    def left(host, texts, holders, **limits):
        """Words of the shared line that the first `holders` of `texts` texts still have."""
        own = F.concat_ws(" ", *[F.concat(F.lit(f"w{chr(97 + j)}"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")) for j in range(30)])
        text = F.when(F.col("id") < holders, F.concat(own, F.lit("\nshared menu line"))).otherwise(own)
        frame = spark.range(texts).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(host).alias("source"))
        rows = quality.judge(frame, **limits).filter(F.col("doc_id") < holders).select("words_left").distinct().collect()
        return {r.words_left - 30 for r in rows}

    assert left("small", 19, 19) == {0} and left("small", 19, 4) == {3}
    assert left("middle", 1000, 20) == {0} and left("middle", 1000, 19) == {3}
    assert left("hot", 20000, 39) == {3} and left("hot", 20000, 39, many=39) == {0}


# --- 3 ------------------------------------------------------------------------

def test_language(spark, odd, empty):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    # what a text is called does not depend on its other columns or neighbours
    alone = language.identify(docs.withColumn("lang", F.when(~language.held_out(), F.col("lang"))).withColumn("source", F.lit("x")))
    assert {(r.doc_id, r.lang_pred, r.score) for r in rows} == {(r.doc_id, r.lang_pred, r.score) for r in alone.collect()}
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(odd).count() == len(ODD) + 1
    assert language.identify(empty).count() == 0
    nothing = language.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_language_stage_rejects_without_evidence(spark):
    rng = random.Random(8)
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(20)]
    junk += ["это простой русский текст о погоде и людях в городе", "日本語の文章です", "zqxj", "to jest polski tekst o pogodzie i ludziach w mieście"]
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    letters = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in language.known_language(docs.union(more)).collect()} == letters
    net, total = np.array([[8.0, 8.0], [8.0, 2.0], [0.0, 0.0], [1.0, 0.0]]), np.array([9, 9, 9, 40])
    assert language.enough(net, total, np.array([0.4, 0.4])).tolist() == [False, True, False, False]


def test_filters_return_all_languages(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("gemeinsam der hund", "de"), ("gemeinsam the dog", "en")] * 20)]
    names, masks = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    hashes, _, _ = language.grams(["gemeinsam"])
    a, b = language.probes(hashes)
    assert names == ["de", "en"] and ((masks[a, 0] & masks[b, 0]) == 3).all()


# --- 4 ------------------------------------------------------------------------

def repeats_brute(docs):
    seen, out = set(), {}
    for key, data in sorted(docs):
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(data[s:s + 100])
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_brute_force(spark, odd, empty):
    rng = random.Random(3)
    pool = ["".join(rng.choices("ab" if k == 0 else "abcdefgh é", k=rng.randint(150, 600))) for k in range(5)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(pool)[rng.randint(0, 40):] if rng.random() < 0.6 else "".join(rng.choices("abcdefgh ", k=rng.randint(1, 150))) for _ in range(rng.randint(1, 5))]
        texts.append("".join(parts) + "x" * rng.choice([0, 0, 200]))
    texts += texts[:20] + [None, "", "y" * 99, "y" * 100, "y" * 101]
    for most in (repeats.MOST, 1):
        old, repeats.MOST = repeats.MOST, most
        try:
            got = {r.doc_id: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in repeats.without_repeats(docs_of(spark, texts)).collect()}
        finally:
            repeats.MOST = old
        assert got == repeats_brute([(i, (t or "").encode()) for i, t in enumerate(texts)])
    rows = repeats.without_repeats(odd).collect()
    assert len(rows) == len(ODD) + 1 and len({(r.doc_id, r.kept_sha256) for r in rows}) == len(ODD)
    assert repeats.without_repeats(empty).count() == 0


def test_maximal_repeats():
    one, two = b"abcdefgh" * 20, b"zy" + b"abcdefgh" * 20
    data = np.concatenate([np.frombuffer(one, np.uint8).astype(np.int64) + 1, [300], np.frombuffer(two, np.uint8).astype(np.int64) + 1, [301]])
    starts, sizes = repeats.repeats(data, np.arange(len(data)))
    gone = {p for s, z in zip(starts.tolist(), sizes.tolist()) for p in range(s, s + z)}
    assert gone == set(range(8, 160)) | set(range(163, 323))


# --- 5 ------------------------------------------------------------------------

def test_packing(spark, odd, empty, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.vocabulary_path())
    for frame, known in ((odd.filter("doc_id <> 4"), dict(enumerate(ODD))), (table(spark, SF, "documents"), texts)):
        rows = packing.pack(frame).collect()
        spots, by_doc = defaultdict(list), defaultdict(list)
        for r in rows:
            spots[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id].append(r)
        for pieces in spots.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= packing.LENGTH
        full = [sum(n for _, n in p) for p in spots.values()]
        assert sorted(spots) == list(range(len(spots))) and sum(n < packing.LENGTH for n in full) <= 1
        assert set(by_doc) == {i for i in known if i != 4 or known is texts}
        for i, pieces in by_doc.items():
            ids = np.array(coder.encode(known[i] or "", add_special_tokens=False).ids + [1], dtype="<u4")
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    assert packing.pack(odd).agg(F.sum("length")).first()[0] > 0
    assert packing.pack(empty).count() == 0


def test_encoder_matches_tokenizer():
    coder = packing.Encoder(packing.vocabulary_path())
    odd = ["áb  c's \x1c x y ΣΑΣ <|endoftext|>z don't  İstanbul 12345!?", "", " ", "\n\nA\n", "été é", "ÀÉ--- x__y",
           "ßẞ ǅ ﬁ", "a|b <|endoftext|>", "Ñ!! %%% Ñ%%%'s", "ªº μ", "a\x0bb\x0cc", "日本語 text\U0001f600", "x" * 3000]
    for text, ids in zip(odd, coder.encode(odd)):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_hilbert_neighbours():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    keys = packing.hilbert(grid, bits=4)
    path = grid[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(256))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# --- 6 ------------------------------------------------------------------------

def test_extraction(spark):
    tree = extract.learn(spark)
    page = ("<!doctype html><html><head><title>T</title><script>if (a<b) '</p>'</script></head><body class='has-sidebar'><header><a href=/>Site</a></header>"
            "<nav><li><a href=/a>A</a></nav><!-- <p>no</p> --><article><h1>Gr&uuml;&szlig;e &amp; more</h1><p>Short.<p>One <b>bo</b>ld&nbsp;and\n "
            "<a href=x>linked</a>, word.<div class='share-buttons'>Share it</div><p>Then the last paragraph of all with some more words.</article>"
            "<div id=comments><p>I have a long opinion on this article and want to share it with all of you.</p></div>"
            "<footer>&copy; me</footer></body></html>")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>cut &am"), (5, "u", "<article><p>x <a href='"), (6, "u", "<" * 3000), (1, "u", page)]
    frame = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, text string")
    got = extract.extract(frame, tree).collect()
    assert len(got) == 7
    one = {r.page_id: r for r in got}
    assert one[1].text == "Grüße & more\nShort.\nOne bold and linked, word.\nThen the last paragraph of all with some more words."
    assert one[2].text == "" and one[3].n_chars == 0 and one[5].text == "x"
    assert extract.extract(frame.limit(0), tree).count() == 0


def test_extraction_of_given_pages(spark):
    """Every article of the table and nothing around it, against a plain cut at its tags."""
    import html

    tree = extract.learn(spark)
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    for r in extract.extract(table(spark, SF, "pages"), tree).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        parts = [html.unescape(re.sub("<[^>]*>", " ", p)) for p in re.split(r"</?(?:p|h1|article)>", inner)]
        expected = "\n".join(" ".join(p.split()) for p in parts if p.strip())
        assert r.text == expected and r.n_chars == len(expected)


# --- 7 ------------------------------------------------------------------------

def test_decontamination(spark, odd, empty, texts):
    item = "the quick brown fox jumps over the lazy dog while nine small cats watch from a warm red roof"
    w = item.split()
    clean = "nothing of interest happens in this short text about weather and gardens in the early spring"
    rows = [
        (1, f"{clean} {item.upper()} {clean}"), (2, clean), (3, " ".join(w[9:]) + f". {clean}. " + " ".join(w[:9])),
        (4, " ".join(w[:6]) + " " + clean), (5, None), (6, ""), (7, f"{item} {item}"), (7, f"{item} {item}"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, coverage int")
    tests = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    # a table of 64 bits lets everything pass, and with one row in two a seed counts as hot
    for bits, hot_share in ((decontaminate.FILTER_BITS, decontaminate.HOT_SHARE), (64, 10 ** 6)):
        got = decontaminate.leaks(docs, tests, bits=bits, hot_share=hot_share).collect()
        assert sorted(r.doc_id for r in got) == [1, 3, 7, 7] and all(r.coverage == 1 for r in got)
        assert {r.doc_id: r.n_tiles for r in got}[3] == 2
        left = decontaminate.without_leaks(docs, tests, bits=bits, hot_share=hot_share)
        assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6] and left.columns == docs.columns
    assert decontaminate.leaks(odd, tests).count() == 0 and decontaminate.leaks(empty, tests).count() == 0
    assert decontaminate.leaks(docs, tests.limit(0)).count() == 0
    # the given tables: an item is found where its five-word runs cover half of it
    items = {r.item_id: decontaminate.words(r.text) for r in table(spark, SF, "benchmark").collect()}
    expected = set()
    for d, text in texts.items():
        own = decontaminate.words(text)
        runs = {tuple(own[i:i + 5]) for i in range(len(own) - 4)}
        for i, words in items.items():
            covered = {k for j in range(len(words) - 4) if tuple(words[j:j + 5]) in runs for k in range(j, j + 5)}
            if len(covered) >= 0.5 * len(words):
                expected.add((d, i))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()} == expected


def test_pairs_against_all_pairs_tiled(spark):
    """Every pair of a text and an item, tiled on their whole words, without seeds, filter or join."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    items = {i: rng.choices(vocabulary, k=rng.randint(3, 30)) for i in range(25)}
    texts = {}
    for d in range(60):
        parts = [rng.choices(vocabulary, k=rng.randint(0, 20))]
        for i in rng.sample(sorted(items), 2):
            cut = rng.randint(0, len(items[i]))
            parts += [items[i][cut:], rng.choices(["x", "y"], k=rng.randint(0, 2)), items[i][:cut]]
        rng.shuffle(parts)
        texts[d] = [w for p in parts for w in p]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()] + [(None, " ".join(texts[0]))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, ", ".join(w)) for i, w in items.items()], "item_id long, text string")
    number = {w: n for n, w in enumerate([*vocabulary, "x", "y"], 1)}
    for coverage, least in ((0.5, 5), (0.9, 4)):
        expected = set()
        for d, text in texts.items():
            for i, item in items.items():
                if len(item) >= least:
                    found = decontaminate.tiles(np.array([number[w] for w in item]), np.array([number[w] for w in text], dtype=np.int64), least)
                    covered = sum(n for _, _, n in found)
                    if found and covered >= coverage * len(item):
                        expected |= {(k, i, len(item), covered) for k in ([d, None] if d == 0 else [d])}
        for hot_share in (4096, 10 ** 6):
            got = decontaminate.leaks(docs, benchmark, coverage, least, hot_share=hot_share).collect()
            assert {(r.doc_id, r.item_id, r.item_words, r.covered_words) for r in got} == expected and len(got) == len(expected)


def test_tiles_do_not_overlap():
    rng = random.Random(2)
    for _ in range(200):
        a, b = np.array(rng.choices(range(1, 5), k=30)), np.array(rng.choices(range(0, 5), k=60))
        found = decontaminate.tiles(a, b, 5)
        for side in (0, 1):
            places = [p for t in found for p in range(t[side], t[side] + t[2])]
            assert len(places) == len(set(places))
        assert all((a[i:i + n] == b[j:j + n]).all() and n >= 5 for i, j, n in found)
        free_a, free_b = np.ones(30, bool), np.ones(60, bool)
        for i, j, n in found:
            free_a[i:i + n] = free_b[j:j + n] = False
        left = {tuple(a[i:i + 5]) for i in range(26) if free_a[i:i + 5].all()}
        assert not left & {tuple(b[j:j + 5]) for j in range(56) if free_b[j:j + 5].all()}


# --- 8 ------------------------------------------------------------------------

PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(number(v)) <= 19 and luhn(number(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(number(v)) <= 15),
]


def number(value):
    return re.sub("[^0-9]", "", value)


def luhn(value):
    total = 0
    for i, c in enumerate(reversed(value)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PII for m in re.finditer(p, text or "") if ok(m[0])]


def test_personal_data(spark, odd, empty, texts):
    rng = random.Random(4)
    made = [
        "a@b.c_d@e.f x.y@z.co.uk, é@é a@b.c@d.e .%@x.y", "1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "\x01é\x01 +1 (555) 010-9999 +12 +123456789012345678", "9" * 4000, "1." * 3000, "a" * 20000 + "@", ("x" * 50 + "@y.z ") * 200, "é" * 50 + "t@u.v",
    ]
    made += ["".join(rng.choices("ab1@. +-(4)\x01é", k=rng.randint(5, 400))) for _ in range(300)]
    for frame, known in ((docs_of(spark, made), dict(enumerate(made))), (odd, dict(enumerate(ODD))), (table(spark, SF, "documents"), texts)):
        for r in pii.digest(frame).collect():
            spans = base_spans(known[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), known[r.doc_id][:80]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in ("email", "ip", "card", "phone")]
            assert r.spans.split(",")[:len(spans)] == spans or not spans
    assert pii.digest(empty).count() == 0


def test_added_kinds_and_masks(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00. My SSN is 123-45-6789; part 123-45-6780. password=d9f3929e83c8655244 mail x@y.org"
    frame = docs_of(spark, [text, "nothing", None, ""]).withColumn("n_chars", F.lit(1).cast("long"))
    spans = pii.digest(frame).filter("doc_id = 0").first().spans
    found = Counter(s.split(":")[0] for s in spans.split(","))
    assert found == Counter({"email": 1, "iban": 1, "national_id": 1, "secret": 1})
    rows = {r.doc_id: r for r in pii.without_personal_data(frame).collect()}
    assert rows[0].text == "IBAN <IBAN>, not DE88 3704 0044 0532 0130 00. My SSN is <NATIONAL_ID>; part 123-45-6780. password=<SECRET> mail <EMAIL>"
    assert rows[0].n_chars == len(rows[0].text) and (rows[1].text, rows[2].text, rows[3].text) == ("nothing", None, "")
    assert pii.without_personal_data(frame).columns == frame.columns


def spans_of(spark, texts, kind):
    rows = {r.doc_id: r.spans for r in pii.digest(docs_of(spark, texts)).collect()}
    spans = [[s.split(":") for s in rows[i].split(",") if s.startswith(kind + ":")] for i in range(len(texts))]
    return [[t[int(a):int(b)] for _, a, b in found] for t, found in zip(texts, spans)]


def test_quoted_and_long_secrets(spark):
    known = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").filter("text ilike '%token = \"%'").collect()]
    wanted = [re.findall(r'(?i)token = "([0-9a-f]{40})"', t) for t in known]
    assert sum(map(len, wanted)) > 0 and spans_of(spark, known, "secret") == wanted
    secret, long = "dfd1944d0f5c", "a1" * 100
    forms = ['token = "%s".', "é {\"api_key\": \"%s\"}", "password='%s'", "{\\\"secret\\\":\\\"%s\\\"}", "token: %s"]
    made = [f % v for f in forms for v in (secret, long)]
    assert spans_of(spark, made, "secret") == [[v] for _ in forms for v in (secret, long)]
    assert spans_of(spark, [f'the name "{secret}"', 'token = "abcdefghijklm"'], "secret") == [[], []]
    lowered = [f'they shathed token = "{secret}"', f'sha1 token = "{secret}"', f'commit_hash token = "{secret}"']
    assert spans_of(spark, lowered, "secret") == [[secret], [], []]


def test_account_numbers_among_words(spark):
    de, no, gb = "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB29NWBK60161331926819"
    made = [f"{de} EUR", f"{de} 25 OPEN", f"{no} A 1 B 2", f"{de} {gb} {no}", f"REF AA11 {gb} END", f"É {gb}X", f"{de[:-1]}1 EUR", f"X{gb}"]
    assert spans_of(spark, made, "iban") == [[de], [de], [no], [de, gb, no], [gb], [], [], []]
    masked = pii.without_personal_data(docs_of(spark, made[3:4])).first().text
    assert masked == "<IBAN> <IBAN> <IBAN>"


# --- 9 ------------------------------------------------------------------------

def near_brute(texts):
    words = {i: re.findall(r"\w+", t.lower()) for i, t in texts.items() if t is not None}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in words.items()}
    first = {}
    for i in sorted(words):
        first.setdefault(texts[i], i)
    up = {i: first.get(texts[i], i) for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links, heads = Counter(), sorted(first.values())
    for x, a in enumerate(heads):
        for b in heads[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {i: (root(i), links[first[t]] if t is not None else 0) for i, t in texts.items()}


def test_near_duplicates(spark, odd, empty, texts):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 200))) for _ in range(8)]
    made = []
    for _ in range(240):
        words = rng.choice(base[:2] if rng.random() < 0.7 else base).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 99)}"
        made.append(" ".join(words))
    made += ["", "", "one two", "one two", "One, two", None, None, "a b c d e", "A b c d e!"]
    known = dict(enumerate(made))
    for block in (near.BLOCK, 16):
        old, near.BLOCK = near.BLOCK, block
        try:
            got = {r.doc_id: (r.class_id, r.n_links) for r in near.join(docs_of(spark, made)).collect()}
        finally:
            near.BLOCK = old
        assert got == near_brute(known)
    small = {i: texts[i] for i in sorted(texts)[:200]}
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.join(table(spark, SF, "documents")).collect()}
    assert got == near_brute(small if len(texts) == 200 else texts)
    assert near.join(odd).count() == len(ODD) + 1
    assert near.join(empty).count() == 0
    kept = near.one_each(docs_of(spark, made))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in near_brute(known).values()}) and kept.columns == odd.columns


def test_recall_sets_the_prefixes():
    def found(similarity, lengths):
        return 1 - np.prod([1 - similarity ** d for d in lengths])

    for similarity, recall in itertools.product((0.5, 0.6, 0.8, 0.9), (0.9, 0.999, near.RECALL)):
        lengths = near.prefix_lengths(similarity, recall)
        assert found(similarity, lengths) >= recall and max(lengths) - min(lengths) <= 1
        if min(lengths) < near.DEPTH:  # the last step was needed
            last = max(i for i, d in enumerate(lengths) if d == min(lengths))
            assert found(similarity, [d + (i == last) for i, d in enumerate(lengths)]) < recall
    assert near.prefix_lengths(0.99) == [near.DEPTH] * near.TREES and len(set(near.prefix_lengths())) == 2
    with pytest.raises(ValueError):
        near.prefix_lengths(0.1)


def test_similar_signatures_agree_enough():
    rng = np.random.default_rng(4)
    for similarity in (0.5, 0.8):
        agreed = rng.binomial(near.TREES * near.DEPTH, similarity, 1_000_000)
        assert (agreed < near.least_agreement(similarity)).sum() <= 3


@pytest.mark.parametrize("similarity", [0.5, 0.65, 0.9])
def test_links_at_other_similarities(spark, similarity):
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 10 ** 6)}" for _ in range(200)] for _ in range(40)]
    made = {}
    for n, words in enumerate(base):
        for k in range(4):
            changed = list(words)
            for _ in range(rng.randint(0, 6)):
                changed[rng.randrange(len(changed))] = f"n{rng.randint(0, 10 ** 6)}"
            made[n * 4 + k] = " ".join(changed)
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(196)} for i, t in made.items()}
    links, heads = Counter(), {t: i for i, t in reversed(made.items())}
    for a, b in itertools.combinations(sorted(heads.values()), 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            links.update((a, b))
    got = {r.doc_id: r.n_links for r in near.join(docs_of(spark, list(made.values())), similarity).collect()}
    assert got == {i: links[heads[t]] for i, t in made.items()} and sum(links.values()) > 20


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    up = {n: n for e in edges for n in e if e[0] != e[1]}
    for a, b in edges * 60:
        if a != b:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == up


# --- 10 -----------------------------------------------------------------------

def test_minimax_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 9))]
        shards = rng.randint(1, 5)
        best = [[0] + [10 ** 9] * len(sizes)]
        for _ in range(shards):
            last = best[-1]
            best.append([min(max(last[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)])
        cuts = [0, *sharding.minimax_cuts(sizes, shards)]
        assert len(cuts) == shards + 1 and cuts == sorted(cuts) and cuts[-1] == len(sizes)
        assert max([sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])]) == best[-1][len(sizes)]


def test_sharding(spark, odd, empty, texts):
    for frame, known, rows in ((odd, dict(enumerate(ODD)), len(ODD) + 1), (table(spark, SF, "documents"), texts, len(texts))):
        got = sharding.shard(frame).collect()
        assert len(got) == rows
        slots, place = defaultdict(list), defaultdict(set)
        for r in got:
            data = (known[r.doc_id] or "").encode()
            assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data) and 0 <= r.shard < 40 and r.law == "bytes"
            slots[r.shard].append(r.slot)
            place[known[r.doc_id] or ""].add(r.shard)
        assert all(len(p) == 1 for p in place.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0
    # a text that holds a third of all bytes leaves the other shards even
    sums = Counter()
    hot = docs_of(spark, ["hot " * 50] * 400 + [f"text {i} " * 20 for i in range(4000)])
    for r in sharding.shard(hot).collect():
        sums[r.shard] += r.size
    rest = sorted(sums.values())[:-1]
    assert len(sums) == 40 and rest[-1] < 1.3 * rest[0]


@pytest.mark.parametrize("cells, opened", [(sharding.CELLS, sharding.OPENED), (4, 2), (2, 1)])
def test_shards_against_the_best_partition_of_groups(spark, cells, opened):
    rng = random.Random(cells)
    rows = [(rng.getrandbits(64) - (1 << 63), rng.choice([20, 100, 500, 3000])) for _ in range(300)]
    rows += rng.choices(rows, k=100)
    frame = spark.createDataFrame(rows, "key long, size long")
    groups = Counter()
    for key, size in rows:
        groups[key] += size
    keys = sorted(groups)
    for shards in (1, 7, 40):
        cuts = sharding.minimax_cuts([groups[k] for k in keys], shards)
        best = max(sum(groups[k] for k in keys[a:b]) for a, b in zip([0, *cuts], cuts))
        ends = [e for e in sharding.group_cuts(frame, shards, cells, opened) if e is not None]
        parts, low = [], None
        for end in ends:
            parts.append(sum(groups[k] for k in keys if k <= end and (low is None or k > low)))
            low = end
        assert len(ends) <= shards and sum(parts) == sum(groups.values()) and max(parts) == best


def test_hot_and_missing_ids_keep_dense_slots(spark):
    frame = docs_of(spark, [f"text {i % 50} " * (i % 9) for i in range(900)]).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")))
    slots = defaultdict(list)
    for r in sharding.shard(frame, shards=5).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 900 and all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- all ----------------------------------------------------------------------

def test_queries_are_registered_and_the_pipeline_runs(spark):
    import __spark_entry__ as entry
    import corpus_pipeline

    names = [re.match(r"op(\d+)_", n)[1] for n in QUERIES if n.startswith("op")]
    assert sorted(map(int, names)) == list(range(1, 14)) and set(QUERIES) <= set(entry.queries()) and "pipeline" in QUERIES
    docs = table(spark, SF, "documents")
    pieces = corpus_pipeline.run(spark, SF).collect()
    kept, at = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        at.append({r.doc_id for r in kept.select("doc_id").collect()})
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert at[0] == set(left)
    assert at[1] == {c for c, _ in near_brute(left).values()}
    leaked = {r.doc_id for r in decontaminate.leaks(docs, table(spark, SF, "benchmark")).collect()}
    assert at[2] == at[1] - leaked and at[3] == at[2] == {r.doc_id for r in pieces}
    assert json.dumps(sorted(at[3]))


def test_pipeline_on_odd_tables(spark, tmp_path, odd, empty):
    import corpus_pipeline

    for name, frame in (("odd", odd), ("empty", empty)):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "odd")


def test_many_matches_in_one_text(spark):
    n = 6000
    frame = spark.createDataFrame([(1, "é1.1.1.1 " * n), (2, "a@b.cc, " * n)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(frame).collect()}
    assert got[1].n_ip == n and got[2].n_email == n
    spans = ",".join(f"ip:{9 * i + 1}:{9 * i + 8}" for i in range(n))
    assert got[1].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.without_personal_data(frame).collect()}
    assert clean == {1: "é<IP> " * n, 2: "<EMAIL>, " * n}


def test_no_text_is_lost_for_its_id(spark):
    words = lambda seed: " ".join(f"w{random.Random(seed * 1000 + i).randint(0, 10**6)}" for i in range(60))
    near_copy = lambda t: t + " tail"
    rows = [
        (None, words(1)), (None, words(2)), (7, words(3)), (7, words(4)), (8, words(3)), (8, words(5)), (None, near_copy(words(2))),
        (9, near_copy(words(1))), (9, near_copy(words(1))), (None, None), (10, None), (10, None), (None, ""), (11, ""),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in near.one_each(frame).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    two = [(None, words(2)), (None, near_copy(words(2)))]  # no id: the smaller digest names the class
    first = min(two, key=lambda r: hashlib.md5(r[1].encode()).digest())
    expected = [(9, near_copy(words(1))), first, (7, words(3)), (7, words(4)), (8, words(5)), (None, None), (10, None), (11, "")]
    assert sorted(kept, key=key) == sorted(expected, key=key)
    links = {(r.doc_id, r.n_links) for r in near.join(frame.filter("doc_id IS NULL AND text <> ''")).collect()}
    assert links == {(None, 0), (None, 1)}


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats_of_many_short_texts(seed):
    """Texts that end inside a common run must not hide longer repeats of the others."""
    rng = random.Random(seed)
    length, most = 9 + seed, 40
    source = "".join(rng.choices("ab", k=60))
    texts = []
    for _ in range(60):
        a = rng.randrange(len(source) - 12)
        text = source[a:a + rng.randint(1, most)]
        texts.append(text if rng.random() < 0.6 else text[:5] + rng.choice("abc") + text[6:])
    data, base, at = [], [], 0
    for i, t in enumerate(texts):
        data += [ord(c) + 1 for c in t] + [257 + i]
        base.append(at)
        at += len(t) + 1
    starts, sizes = repeats.repeats(np.array(data, np.int64), np.arange(len(data)), length, most)
    got = {p for s, n in zip(starts.tolist(), sizes.tolist()) for p in range(s, s + n)}
    seen, expected = set(), set()
    for t, b in zip(texts, base):
        for j in range(len(t) - length + 1):
            w = t[j:j + length]
            if w in seen:
                expected |= set(range(b + j, b + j + length))
            seen.add(w)
    assert got == expected and expected
