"""Schemas from observed payloads and vocabularies, against plain Python."""

import json
import random

from pyspark.sql import functions as F

from pagetables.operators import vocabulary as V
from pagetables.sinks import typed

PAYLOADS = [
    (1, '{"id": 1, "name": "a", "price": 2, "mix": "x", "deep": {"k": 1}}'),
    (2, '{"id": 2, "name": null, "price": 2.5, "mix": 7, "Name": "other case", "odd `key.\\"q\\"": true}'),
    (3, '{"id": 3, "name": "", "price": 1e3, "mix": [1], "only": null, "id": 99}'),
    (4, "null"), (5, "[1, 2]"), (6, "{broken"), (7, None), (8, ""), (9, "{}"), (10, ' {"id": 10, "rest": "r", "PAGE": "p"}'),
]


def frame(spark):
    return spark.createDataFrame(PAYLOADS, "page long, payload string")


def test_types_widen_over_payloads(spark):
    got = {r.key: (r.n, r.type) for r in typed.payload_schema(frame(spark)).collect()}
    assert got["id"] == (4, "BIGINT") and got["name"] == (3, "STRING") and got["price"] == (3, "DOUBLE")
    assert got["mix"] == (3, "VARIANT") and got["deep"] == (1, "VARIANT") and got["only"] == (1, "VOID")


def test_every_value_is_in_a_column_or_in_the_rest(spark):
    for width in (0, 2, 100):
        rows = typed.typed_table(frame(spark), width=width)
        assert len({c.lower() for c in rows.columns}) == len(rows.columns) and rows.columns[0] == "page"
        kept = {r[0]: (r[1], json.loads(r[2]) if r[2] else None) for r in rows.select(
            "page", F.to_json(F.struct(*[typed.quoted(c) for c in rows.columns if c not in ("page", "rest")] or [F.lit(1).alias("none")])), F.to_json("rest")).collect()}
        assert len(kept) == len(PAYLOADS)
        assert all(kept[page][1] is None for page in (4, 5, 6, 7, 8)) and kept[9][1] == {}
        for page, text in PAYLOADS[:3]:
            own = json.loads(kept[page][0])
            own.pop("none", None)
            both = {k: v for k, v in {**own, **kept[page][1]}.items() if v is not None}
            want = {k: v for k, v in json.loads(text, object_pairs_hook=lambda p: dict(reversed(p))).items() if v is not None}
            assert both == want and not set(own) & {k for k, v in kept[page][1].items() if v is not None}
        assert kept[10][1]["rest"] == "r" and kept[10][1]["PAGE"] == "p"


def test_values_that_do_not_fit_a_fixed_type_stay_in_the_rest(spark):
    got = {r.page: (r.mix, r.t) for r in typed.typed_table(frame(spark), columns=[("mix", "BIGINT")]).select(
        "page", "mix", F.try_variant_get("rest", "$.mix", "string").alias("t")).collect()}
    assert got[1] == (None, "x") and got[2] == (7, None)


def test_empty_tables(spark):
    none = frame(spark).limit(0)
    assert typed.payload_schema(none).count() == 0 and typed.typed_table(none).columns == ["page", "rest"]


def matches(texts, tokens):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = {lower(t) for t in tokens if t}
    return sorted((i, w, lower(t).find(w) + 1) for i, t in texts if t for w in words if w in lower(t))


def test_vocabulary_by_automaton_and_by_join_against_find(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abAé \U0001f600") for _ in range(rng.randrange(60)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "ab" * 20000), (102, "b")]
    tokens = ["".join(rng.choice("abBé ") for _ in range(rng.randrange(1, 8))) for _ in range(150)] + [None, "", "A", "a"]
    frame = spark.createDataFrame(texts, "k long, t string").withColumn("token", F.lit("clash")).select("k", F.col("t").alias("body"))
    words = spark.createDataFrame([(t,) for t in tokens], "token string")
    want = matches(texts, tokens)
    for limit in (1000, 0):
        got = V.vocabulary_matches(frame, ["k"], "body", words, limit=limit).collect()
        assert sorted((r.k, r.token, r.first_at) for r in got) == want
        assert V.vocabulary_matches(frame, ["k"], "body", words.limit(0), limit=limit).count() == 0
