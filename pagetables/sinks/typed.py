"""Typed tables from payloads whose fields nobody declared.

The fields and their types come from the payloads: one aggregate per key widens the types that were seen. The fields
that most payloads have become columns, all others stay together in one VARIANT, so no field is lost however many
there are, and the driver sees the chosen columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.functions.payload import first_entries
from pagetables.functions.text import col, let

#: Columns that a typed table has besides its own and the rest.
WIDTH = 200
#: Types of a column; a field of any other type, or of several that do not widen, stays VARIANT.
TYPED = "^(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL\\(\\d+,\\d+\\))$"
REST = "rest"


def observed_fields(payload: Column | str) -> Column:
    """MAP<key, VARIANT> of a JSON object, the first of repeated keys; NULL for anything else, broken JSON included."""
    whole = F.from_json(col(payload), "map<string,variant>")

    def once(found: Column) -> Column:
        keys = F.map_keys(found)
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), first_entries(F.map_entries(found))).otherwise(found)

    return let(whole, once)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def payload_schema(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(key, n, type) of every field of the payloads: the rows that have it and the type that holds all its values.

    Whole numbers widen to decimals, those to doubles; a field without any value is VOID; types that do not widen, and
    nested values, are VARIANT. Counts and types combine map-side, so a field of every row costs one small row per task.
    """
    pairs = df.select(F.explode(observed_fields(payload)).alias("key", "value"))
    seen = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.schema_of_variant_agg("value").alias("type"))
    kind = F.when(F.col("type").rlike(TYPED) | (F.col("type") == "VOID"), F.col("type")).otherwise(F.lit("VARIANT"))
    return seen.select("key", "n", kind.alias("type"))


def chosen_columns(schema: DataFrame, width: int = WIDTH, taken: tuple[str, ...] = (REST,)) -> list[tuple[str, str]]:
    """(key, type) of the `width` most frequent fields, ties by key.

    Column names know no case: of keys that differ by case the more frequent one is chosen, and a key that equals a
    name in `taken` none, so it stays in the rest.
    """
    names = [t.lower() for t in taken]
    place = F.struct((-F.col("n")).alias("n"), "key", "type")
    one = schema.filter(~F.lower("key").isin(names) & (F.col("key") != "")).groupBy(F.lower("key").alias("name"))
    best = one.agg(F.min(place).alias("c")).select("c.*").orderBy("n", "key")
    return [(r["key"], r["type"]) for r in best.limit(width).collect()]


def typed_table(df: DataFrame, payload: str = "payload", width: int = WIDTH, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """`df` without its payload, with a typed column for each chosen field and `rest`, a VARIANT object of all others.

    `columns` (key, type) fixes the columns; without it they are chosen from the payloads, which are read once more. A
    value that does not fit a given type goes to the rest, so every value of a payload but null is in the result once. A
    payload that is no object has blank columns and a NULL rest; a payload without further fields has an empty one.
    """
    own = [c for c in df.columns if c != payload]
    held = list(map(quoted, own))
    if columns is None:
        columns = chosen_columns(payload_schema(df, payload), width, (REST, *own))
    found = df.select(*held, observed_fields(payload).alias("_fields"))
    values = []
    for key, kind in columns:
        value = F.element_at("_fields", F.lit(key))
        if kind == "VOID":
            kind = "STRING"
        values.append((value if kind == "VARIANT" else F.try_variant_get(value, "$", kind)).alias(key))
    kept = found.select(*held, "_fields", *values)
    # a field is in its column if that has a value, or if there was none to hold
    missed = [
        F.when(F.col(quoted(key)).isNull() & ~F.is_variant_null(F.element_at("_fields", F.lit(key))), F.lit(key))
        for key, _ in columns
    ]
    lost = F.array_compact(F.array(*missed)) if missed else F.array().cast("array<string>")
    names = F.array(*[F.lit(key) for key, _ in columns]) if columns else F.array().cast("array<string>")
    rest = F.map_filter("_fields", lambda k, _: ~F.array_contains(names, k) | F.array_contains("_lost", k))
    return kept.withColumn("_lost", lost).select(
        *held, *[F.col(quoted(key)) for key, _ in columns], F.to_variant_object(rest).alias(REST)
    )
