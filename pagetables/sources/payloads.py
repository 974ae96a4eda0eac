"""Crawled JSON payloads and the paging rules of store APIs.

Paging decisions need the size of each page, not its content: the rules run
on one small row per page and are joined back to the payloads.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetables.functions import payload as J
from pagetables.functions.text import let
from pagetables.operators.ranking import top_k
from pagetables.session import cut_lineage

# --- fixed values: results depend on these exact numbers and texts -----------
FEED_PAGE_SIZE = 250
FEED_PRODUCTS = 5000
FEED_COLLECTIONS = 1000
CATEGORY_PRODUCTS = 500
STATE_PATTERN = r'window\[Symbol\.for\("InstantSearchInitialResults"\)\]\s*=\s*(\{[\s\S]*?\})</script>'
# --- end of fixed values -----------------------------------------------------


def read_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return payload_status(spark.read.format(fmt).load(path))


def payload_status(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Payloads that are no JSON object become '{}' with a failed status."""
    is_object = F.coalesce(J.kind_of(F.try_parse_json(F.col(column))) == "OBJECT", F.lit(False))
    return payloads.withColumn("status", F.when(is_object, F.lit("ok")).otherwise(F.lit("failed"))).withColumn(
        column, F.when(F.col("status") == "ok", F.col(column)).otherwise(F.lit("{}"))
    )


def running_pages(sizes: DataFrame, group: Sequence[str], page_size: int, limit: int | None = None) -> DataFrame:
    """Pages that numbered paging fetches: up to and including the first short, empty or missing-next one.

    Every page but the last is full, so with a limit at most limit / page_size + 1
    pages of a group can matter and only those enter the window.
    """
    order = Window.partitionBy(*group).orderBy("page_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = sizes if limit is None else top_k(sizes, group, [F.col("page_no")], limit // page_size + 2)
    state = first.select(
        *group,
        "page_no",
        "size",
        F.coalesce(F.min("size").over(before), F.lit(page_size)).alias("_smallest"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int").alias("taken_before"),
        (F.row_number().over(order) == F.col("page_no")).alias("_in_sequence"),
    )
    keep = (F.col("_smallest") >= page_size) & _below("taken_before", limit) & F.col("_in_sequence")
    return state.filter(keep).drop("_smallest", "_in_sequence")


def paginate_numbered(
    pages: DataFrame, group: Sequence[str], items: str = "items",
    page_size: int = FEED_PAGE_SIZE, limit: int | None = None,
) -> DataFrame:
    """Items of numbered API pages in order; `idx` counts per group and ends at the limit."""
    sizes = pages.select(*group, "page_no", F.size(items).alias("size"))
    kept = running_pages(sizes, group, page_size, limit).drop("size")
    # sizes are guessed from the bytes of a file, so payloads that a query derives would be broadcast through the driver
    rows = pages.join(kept.hint("merge"), [*group, "page_no"]).select(
        *group, "page_no", "taken_before", F.posexplode(items).alias("pos", "item")
    )
    idx = F.col("taken_before") + F.col("pos") + 1
    return rows.withColumn("idx", idx).filter(_below("idx", None if limit is None else limit + 1)).drop("taken_before", "pos")


def api_pages(running: DataFrame, group: Sequence[str]) -> DataFrame:
    """Number of pages fetched per group; an empty last page counts."""
    return running.groupBy(*group).agg(F.count(F.lit(1)).alias("api_pages"))


def _below(column: str, limit: int | None) -> Column:
    return F.lit(True) if limit is None else F.col(column) < limit


def cursor_pages(pages: DataFrame, group: Sequence[str], items: str = "items", limit: int | None = None) -> DataFrame:
    """Pages that cursor paging fetches: it stops at an empty page, at a null cursor or at the limit.

    A page that is passed holds at least one item, so with a limit at most
    limit + 1 pages of a group can matter.
    """
    sizes = pages.select(*group, "page_seq", F.size(items).alias("size"), F.col("next_cursor").isNotNull().alias("more"))
    first = sizes if limit is None else top_k(sizes, group, [F.col("page_seq")], limit + 1)
    before = Window.partitionBy(*group).orderBy("page_seq").rowsBetween(Window.unboundedPreceding, -1)
    state = first.select(
        *group, "page_seq", "size", "more",
        F.coalesce(F.min(F.when(F.col("more"), F.col("size")).otherwise(0)).over(before), F.lit(1)).alias("_passed"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int").alias("taken_before"),
    )
    return state.filter((F.col("_passed") > 0) & _below("taken_before", limit)).drop("_passed")


def paginate_cursor(pages: DataFrame, group: Sequence[str], items: str = "items", limit: int | None = None) -> DataFrame:
    """Items of cursor-paged API answers in order, ending at the limit."""
    kept = cursor_pages(pages, group, items, limit).select(*group, "page_seq", "taken_before")
    rows = pages.join(kept.hint("merge"), [*group, "page_seq"]).select(
        *group, "page_seq", "taken_before", F.posexplode(items).alias("pos", "item")
    )
    idx = F.col("taken_before") + F.col("pos") + 1
    return rows.withColumn("idx", idx).filter(_below("idx", None if limit is None else limit + 1)).drop("taken_before", "pos")


def chain_cursors(pages: DataFrame, group: Sequence[str], cursor: str = "cursor", next_cursor: str = "next_cursor") -> DataFrame:
    """Pages that the cursors of a group reach, with `page_seq` from 0 on and `chain_end` at the last page of a chain.

    A chain starts at the page without a cursor and goes to the page whose cursor the one before names. Ranks come
    by pointer doubling: each round joins what has been reached with pointers of twice the length, so a chain of n
    pages takes log n rounds and no group is walked in one task. Of pages with the same cursor one counts, the first by
    a hash of its columns. `chain_end` is `end` without a next cursor, `dangling` if no page has it, `cycle` if the page was
    passed before; a next cursor that cannot be followed is null.
    """
    group = list(group)
    rows = pages.withColumn("_token", F.coalesce(F.concat(F.lit("="), F.col(cursor).cast("string")), F.lit("")))
    rows = rows.withColumn("_next", F.concat(F.lit("="), F.col(next_cursor).cast("string")))
    rest = [c for c in pages.columns if c not in (*group, cursor)]
    one = rows.groupBy(*group, "_token").agg(
        F.min_by(F.struct(*rest, "_next"), F.xxhash64(F.to_json(F.struct(*rest)))).alias("_page")
    )
    one = cut_lineage(one)
    steps = one.select(*group, F.col("_token").alias("_from"), F.col("_page._next").alias("_to")).filter(F.col("_to").isNotNull())
    exists = one.select(*group, F.col("_token").alias("_to"))
    jump = cut_lineage(_same(steps, exists, [*group, "_to"]))  # pointers of one step, none to a page that is not there
    reached = one.filter(F.col("_token") == "").select(*group, "_token", F.lit(0).cast("long").alias("page_seq"))
    count, length = reached.count(), 1
    while True:
        after = _same(reached.withColumnRenamed("_token", "_from"), jump, [*group, "_from"]).select(
            *group, F.col("_to").alias("_token"), (F.col("page_seq") + length).alias("page_seq")
        )
        reached = cut_lineage(reached.unionByName(after).groupBy(*group, "_token").agg(F.min("page_seq").alias("page_seq")))
        now = reached.count()
        if now == count:
            break
        onward = jump.withColumnsRenamed({"_from": "_mid", "_to": "_far"})
        jump = cut_lineage(_same(jump.withColumnRenamed("_to", "_mid"), onward, [*group, "_mid"]).select(*group, "_from", F.col("_far").alias("_to")))
        count, length = now, 2 * length
    ranked = _same(one, reached, [*group, "_token"])
    later = reached.select(*group, F.col("_token").alias("_next"), F.col("page_seq").alias("_next_seq"))
    ends = _same(ranked.withColumn("_next", F.col("_page._next")), later, [*group, "_next"], "left")
    onward = F.col("_next_seq") > F.col("page_seq")
    end = F.when(F.col("_next").isNull(), "end").when(F.col("_next_seq").isNull(), "dangling").when(~onward, "cycle")
    values = [F.when(onward, F.col(f"_page.`{c}`")).alias(c) if c == next_cursor else F.col(f"_page.`{c}`").alias(c) for c in rest]
    token = F.expr("CASE WHEN _token <> '' THEN substring(_token, 2) END").cast(pages.schema[cursor].dataType)
    return ends.select(*group, token.alias(cursor), "page_seq", *values, end.alias("chain_end"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    named = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    match = [left[k].eqNullSafe(named[f"_r{k}"]) for k in keys]
    return left.join(named, reduce(Column.__and__, match), how).drop(*(f"_r{k}" for k in keys))


def cursor_chains(pages: DataFrame, group: Sequence[str], cursor: str = "cursor", next_cursor: str = "next_cursor") -> DataFrame:
    """Per group: pages reached, how the chain ends, and how many pages with other cursors it never reaches.

    A group without a first page has the end `no start`.
    """
    chained = chain_cursors(pages, group, cursor, next_cursor)
    reached = chained.groupBy(*group).agg(F.count(F.lit(1)).alias("pages"), F.max("chain_end").alias("chain_end"))
    known = pages.groupBy(*group).agg((F.count_distinct(cursor) + F.max(F.col(cursor).isNull().cast("int"))).alias("_all"))
    joined = _same(known, reached, list(group), "left")
    pages_reached = F.coalesce("pages", F.lit(0))
    return joined.select(*group, pages_reached.alias("pages"), F.coalesce("chain_end", F.lit("no start")).alias("chain_end"), (F.col("_all") - pages_reached).alias("unreached"))


def paginate_cursor_tokens(
    pages: DataFrame, group: Sequence[str], items: str = "items", limit: int | None = None, cursor: str = "cursor", next_cursor: str = "next_cursor",
) -> DataFrame:
    """Items of API answers that are known by their cursors only, in the order of the chain, ending at the limit."""
    chained = chain_cursors(pages, group, cursor, next_cursor).withColumnRenamed(next_cursor, "next_cursor")
    return paginate_cursor(cut_lineage(chained), group, items, limit)


def cursor_limit_warnings(cursors: DataFrame, group: Sequence[str], limit: int = CATEGORY_PRODUCTS) -> DataFrame:
    """Groups that reached the limit although another page was offered."""
    cut = cursors.filter((F.col("taken_before") + F.col("size") >= limit) & F.col("more") & (F.col("size") > 0))
    text = F.lit(f"product safety limit reached at {limit} products")
    return cut.select(*group, text.alias("warning")).distinct()


def read_embedded_state(pages: DataFrame) -> DataFrame:
    """Search results that a page carries in a script: one row per result set with hits."""
    states = F.filter(
        F.regexp_extract_all("html", F.lit(STATE_PATTERN), F.lit(1)), lambda s: F.try_parse_json(s).isNotNull()
    )

    def result_sets(state, state_no):
        return F.flatten(
            F.transform(
                F.filter(F.map_entries(J.fields(state)), lambda e: e["value"]["kind"] == "OBJECT"),
                lambda e: let(
                    J.fields(e["value"]["text"])["results"],
                    lambda r: F.transform(
                        F.filter(J.elements(F.when(r["kind"] == "ARRAY", r["text"])), lambda x: x["kind"] == "OBJECT"),
                        lambda x, i: F.struct(
                            state_no.alias("state_no"), e["key"].alias("index_name"), i.alias("result_no"),
                            x["text"].alias("text"),
                        ),
                    ),
                ),
            )
        )

    def number(record: Column, key: str, default: Column) -> Column:
        return F.coalesce(F.nullif(record[key]["text"].try_cast("bigint"), F.lit(0)), default)

    def shaped(found: Column, record: Column, listed: Column) -> Column:
        facets = J.fields(F.when(record["facets"]["kind"] == "OBJECT", record["facets"]["text"]))["category"]
        return F.struct(
            found["state_no"].alias("state_no"), found["index_name"].alias("index_name"), found["result_no"].alias("result_no"),
            number(record, "nbPages", F.lit(1)).alias("nb_pages"), number(record, "nbHits", F.size(listed)).alias("nb_hits"),
            F.size(listed).alias("rendered"),
            F.transform(F.filter(listed, lambda h: h["kind"] == "OBJECT"), lambda h: h["text"]).alias("hits"),
            let(facets, lambda f: F.from_json(F.when(f["kind"] == "OBJECT", f["text"]), "map<string,bigint>")).alias("facets"),
        )

    def read(found: Column) -> Column:
        return let(
            J.fields(found["text"]),
            lambda record: let(
                J.elements(F.when(record["hits"]["kind"] == "ARRAY", record["hits"]["text"])),
                lambda listed: shaped(found, record, listed),
            ),
        )

    # read inside the exploded array: a filter on a column of its own would be pushed below it and read all JSON again
    sets = F.filter(F.transform(F.flatten(F.transform(states, result_sets)), read), lambda r: r["rendered"] > 0)
    return pages.select("page_id", "url", F.explode(sets).alias("r")).select(
        "page_id", "url", *[f"r.{c}" for c in ("state_no", "index_name", "result_no", "nb_pages", "nb_hits", "rendered", "hits", "facets")]
    )
