"""URL filter: fixed host and path rules, and association rules mined from labelled pages for every other URL.

A URL is a set of tokens. Spark's FP-growth mines the token sets that are frequent among the bad labelled pages; those
that lead to a bad label, with a confidence that is beyond chance, block. A rule is looked up by its rarest token
and fits a URL that has all of its tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm.common import query, table, written

#: Fixed rules of the contract: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: A rule needs this many bad pages, whatever the size of the table, and the lower limit of its share of bad pages
#: (Wilson, SURE standard deviations) must reach CONFIDENCE and take the share of good pages down by LIFT.
LEAST, CONFIDENCE, LIFT, SURE = 10, 0.5, 1.5, 3.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first `://`; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)"))


def parted(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the rest behind the path; host and path are empty without `://`."""
    rest = pages.select("page_id", "url").withColumn("rest", F.coalesce(rest_of(F.col("url")), F.lit("")))
    return rest.select(
        "page_id",
        F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract("rest", r"^[^?#]*(?:\?([^#]*))?", 1).alias("search"),
    )


def fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))


def ruled(rules=tuple(RULES)) -> Column:
    """The longest fixed rule that fits, as a struct (rule, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        found = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits(host, path), found).otherwise(out)
    return out


def tokens() -> Column:
    """Distinct tokens in order: host, its labels, path parts with numbers as 0, names of search fields."""
    shape = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    tagged = lambda tag, parts: F.transform(
        F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), shape(p))
    )
    names = F.transform(F.split("search", "&"), lambda p: F.substring_index(p, "=", 1))
    every = F.concat(
        tagged("site=", F.array("host")), tagged("host=", F.split("host", "[.]")),
        tagged("path=", F.split("path", "/")), tagged("field=", names),
    )
    return F.array_sort(F.array_distinct(every))


def lower_limit(bad: Column, n: Column, sure: float = SURE) -> Column:
    """The lower Wilson limit of a share of `bad` in `n`."""
    share, z = bad / n, sure * sure
    return (share + z / (2 * n) - sure * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def mine(labelled: DataFrame, least: int = LEAST, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules (rule_id, needs, rare, bad, n, confidence, sure) from rows (tokens, bad).

    Token sets of `least` bad pages or more are mined from the bad pages; then all labelled pages that have a set are
    counted, found by the set's rarest token among the distinct token sets. `confidence` is the share of bad pages and
    `sure` its lower limit. A rule goes if fewer of its tokens are as sure.
    """
    sets = written(labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")))
    total = sets.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()[0]
    n, bad = total["n"] or 0, total["bad"] or 0
    items = labelled.filter(F.col("bad") & (F.size("tokens") > 0)).select(F.col("tokens").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, bad)), minConfidence=1.0).fit(items)
    mined = model.freqItemsets.filter(F.col("freq") >= least).select(F.array_sort("items").alias("needs"), F.col("freq").alias("bad"))
    mined = written(mined.withColumn("rule_id", F.xxhash64("needs")))
    each = sets.select("tokens", "n", F.explode("tokens").alias("token"))
    single = each.groupBy("token").agg(F.sum("n").alias("freq"))
    by_token = mined.select("rule_id", F.explode("needs").alias("token")).join(single, "token")
    rare = by_token.groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("rare"))
    counted = (
        each.withColumnRenamed("token", "rare").join(mined.join(rare, "rule_id").select("rule_id", "needs", "rare"), "rare")
        .filter(F.size(F.array_except("needs", "tokens")) == 0).groupBy("rule_id").agg(F.sum("n").alias("n"))
    )
    rules = mined.join(rare, "rule_id").join(counted, "rule_id")
    rules = rules.withColumn("confidence", F.col("bad") / F.col("n")).withColumn("sure", lower_limit(F.col("bad"), F.col("n")))
    floor = max(confidence, 1 - (1 - bad / max(1, n)) / lift)
    indexed = written(rules.filter(F.col("sure") >= floor))
    general = indexed.select(F.col("rare").alias("token"), F.col("needs").alias("few"), F.col("sure").alias("as_sure"))
    redundant = (
        indexed.select("rule_id", "needs", "sure", F.explode("needs").alias("token")).join(general, "token")
        .filter((F.size("few") < F.size("needs")) & (F.size(F.array_except("few", "needs")) == 0) & (F.col("as_sure") >= F.col("sure")))
        .select("rule_id").distinct()
    )
    return indexed.join(redundant, "rule_id", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules=tuple(RULES), least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence of every row of `pages` (page_id, url).

    `labels` (doc_id, quality, toxic) judge pages of the same id: quality 0 or toxic 1 is bad, null values are not; of
    repeated labels one bad one is enough, and a page counts once for them.
    A null URL has no tokens and is allowed. Repeated rows stay; without labels nothing is mined; other columns are
    ignored; an empty table gives no rows.
    """
    parts = parted(pages).withColumn("tokens", tokens())
    bad = labels.select(
        F.col("doc_id").alias("page_id"),
        (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"),
    ).groupBy("page_id").agg(F.max("bad").alias("bad"))
    mined = written(mine(parts.join(bad, "page_id").select("tokens", "bad"), least, confidence))
    sets = parts.select("tokens").distinct()
    hits = (
        sets.select("tokens", F.explode("tokens").alias("rare")).join(mined.select("rare", "needs", "confidence", "rule_id"), "rare")
        .filter(F.size(F.array_except("needs", "tokens")) == 0)
        .groupBy("tokens").agg(F.max(F.struct("confidence", F.array_join("needs", " ").alias("mined_rule"))).alias("best"))
    )
    judged = parts.withColumn("fixed", ruled(rules)).join(hits, "tokens", "left")
    return judged.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("best.mined_rule").alias("mined_rule"), F.col("best.confidence").alias("confidence"),
    )


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
