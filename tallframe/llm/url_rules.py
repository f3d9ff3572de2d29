"""URL filters by association rules.

Every URL has items: the suffixes and the words of its host, the segments of
its path, the keys of its query.  Spark's FP-growth mines the combinations of
items that occur often among labelled URLs, each with its label as one more item;
what is kept are rules "these items -> block (or allow)" with enough support
and confidence.  An inverted index leads from an item to the rules that have it
as their rarest one; a URL meets only the rules of its own items, and one fires
if the URL has all its items.  The surest rule that fires gives the verdict.

Rules stated by hand (``Stated``) come first: such a rule fits its host and all
subdomains if the URL's path starts with the rule's, the longest one wins.

A null URL, or one without ``://``, has an empty host and path, fits no rule
and gets ``default``.  Very long URLs are read whole.  Repeated rows are judged
alike, an empty table gives an empty result, and without labels there are
stated rules only.  Labels that are null, or whose URL is, aren't learned from.
Other columns of the tables may have any names; they aren't read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: least labelled URLs that a combination must occur in with its label: a share, and a number
SUPPORT, LEAST = 0.001, 20
CONFIDENCE = 0.8
#: items of a labelled URL that FP-growth takes, which is exponential in them; where a URL has more, combinations
#: are built level by level
MINED = 12
#: times that one task repeats a basket
REPEAT = 10_000
MARK = "label="


class Stated(NamedTuple):
    """A rule by hand: ``verdict`` for hosts and subdomains of ``host`` whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    found = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, found).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def items_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct items of a URL, none where it has no host and no path.  Runs of
    digits in the path count alike."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    words = F.transform(F.filter(F.split(host, r"[^a-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit("word="), x))
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(F.lower(x), r"\d+", "#"))
    )
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, r"(?s)^([^=]*)", 1)))
    return F.array_distinct(F.when((host != "") | (path != ""), F.concat(suffixes, words, segments, keys)).otherwise(F.array().cast("array<string>")))


def described(urls: DataFrame, column: str = "url") -> DataFrame:
    """url, host, path, items of each distinct URL that isn't null."""
    u = F.col("url")
    some = urls.select(F.col(column).alias("url")).where(u.isNotNull()).distinct()
    return some.withColumn("host", host_of(u)).withColumn("path", path_of(u)).withColumn("items", items_of(F.col("host"), F.col("path"), u))


def mine(
    labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, mined: int = MINED
) -> DataFrame:
    """rule_id, items (sorted), verdict, confidence, support (labelled URLs that
    have the items and the label), item (the rarest), from ``labelled(url, verdict)``; every row
    counts, repeated ones as often as they occur.

    Items too rare for any rule go first; all others count.  Where no URL has more
    than ``mined`` of them, FP-growth gives every rule.  Else ``_by_levels`` gives
    those that ``undominated`` can keep: the verdict of any URL is the same."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col("url").isNotNull() & F.col("verdict").isNotNull()).groupBy("url", "verdict").count()
    rows = materialize(rows.join(described(labelled), "url").select("verdict", "items", "count"), "labelled")
    total = rows.agg(F.sum("count")).first()[0]
    if not total:
        return spark.createDataFrame([], "rule_id long, items array<string>, verdict string, confidence double, support long, item string")
    enough = max(least, support * total)
    each = rows.select(F.explode("items").alias("item"), "verdict", "count")
    stats = each.groupBy("item").agg(
        F.sum("count").alias("n"), F.sum(F.when(F.col("verdict") == "block", F.col("count")).otherwise(0)).alias("blocked")
    ).where(F.greatest("blocked", F.col("n") - F.col("blocked")) >= enough)
    stats = stats.select("item", "n")
    stats = materialize(stats, "items")
    alike = rows.groupBy("items", "verdict").agg(F.sum("count").alias("count")).withColumn("set", F.xxhash64("items", "verdict"))
    held = alike.select("set", "verdict", "count", F.explode("items").alias("item")).join(stats, "item")
    whole = held.groupBy("set", "verdict", "count").agg(F.array_sort(F.collect_set("item")).alias("items"))
    baskets = materialize(whole.groupBy("items", "verdict").agg(F.sum("count").alias("count")), "whole")
    if (baskets.agg(F.max(F.size("items"))).first()[0] or 0) <= mined:
        rules = _by_growth(baskets, enough, total, confidence)
    else:
        rules = _by_levels(baskets, enough, confidence)
    # the index: each rule stands under its rarest item
    rare = rules.select("*", F.explode("items").alias("item")).join(stats.select("item", "n"), "item").groupBy("items", "verdict", "confidence", "support").agg(
        F.min(F.struct("n", "item")).alias("rarest")
    )
    name = F.xxhash64("items", "verdict").alias("rule_id")
    return materialize(rare.select(name, "items", "verdict", "confidence", "support", F.col("rarest.item").alias("item")), "rules")


def _by_growth(baskets: DataFrame, enough: float, total: int, confidence: float) -> DataFrame:
    """(items, verdict, confidence, support) of all rules, by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    spark = baskets.sparkSession
    # a basket that occurs often is repeated as often: FP-growth counts rows
    baskets = materialize(baskets.select(F.concat("items", F.array(F.concat(F.lit(MARK), "verdict"))).alias("items"), "count"), "baskets")
    parts = baskets.select("items", "count", F.explode(F.expr(f"sequence(0L, (count - 1) div {REPEAT})")).alias("part")).repartition("items", "part")
    many = parts.select("items", F.explode(F.expr(f"sequence(1L, least({REPEAT}L, count - part * {REPEAT}L))")).alias("n")).select("items")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, enough / total), minConfidence=confidence, numPartitions=parts).fit(many)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(MARK))
    rules = rules.select(
        F.array_sort("antecedent").alias("items"), F.substring(F.element_at("consequent", 1), len(MARK) + 1, 100).alias("verdict"),
        "confidence", F.round(F.col("support") * total).cast("long").alias("support"),
    ).where(F.col("support") >= enough)
    return rules


def _by_levels(baskets: DataFrame, enough: float, confidence: float) -> DataFrame:
    """(items, verdict, confidence, support) of all rules that none with an item
    less makes needless, with baskets of any width.

    Level by level, combinations that differ in their last item and meet in a
    basket are joined and counted over all baskets.  Gone on with are those that
    occur often enough with a label, with both labels, and less often than each of
    their parts: any other says what a part of it says, and so does all that
    contains it.  Only what a basket's combinations share is shuffled."""
    blocked = F.sum(F.when(F.col("verdict") == "block", F.col("count")).otherwise(0)).alias("blocked")
    sets = baskets.groupBy("items").agg(F.sum("count").alias("n"), blocked).select(F.monotonically_increasing_id().alias("set"), "items", "n", "blocked")
    sets = materialize(sets, "sets")
    often = F.greatest("blocked", F.col("n") - F.col("blocked")) >= enough
    mixed = (F.col("blocked") > 0) & (F.col("blocked") < F.col("n"))
    counted = [F.sum("n").alias("n"), F.sum("blocked").alias("blocked")]
    met = sets.select("set", "n", "blocked", F.array().cast("array<string>").alias("head"), F.explode("items").alias("last"))
    known, found = None, []
    while True:
        level = met.groupBy("head", "last").agg(*counted).where(often)
        if known is not None:
            level = level.withColumn("items", F.concat("head", F.array("last")))
            parts = level.select("head", "last", "n", F.explode("items").alias("out"), "items")
            parts = parts.withColumn("part", F.filter("items", lambda x: x != F.col("out"))).select("head", "last", "n", "part")
            apart = parts.join(known, "part").where(F.col("n") < F.col("part_n")).groupBy("head", "last").count()
            level = level.join(apart, ["head", "last"]).where(F.col("count") == F.size("items")).select("head", "last", "n", "blocked")
        level = materialize(level, "level")
        found.append(level)
        on = level.where(mixed)
        known = on.select(F.concat("head", F.array("last")).alias("part"), F.col("n").alias("part_n"))
        held = materialize(met.join(on.select("head", "last"), ["head", "last"]), "held")
        if held.isEmpty():
            break
        more = held.select("set", "head", F.col("last").alias("next"))
        met = held.join(more, ["set", "head"]).where(F.col("last") < F.col("next")).select(
            "set", "n", "blocked", F.concat("head", F.array("last")).alias("head"), F.col("next").alias("last")
        )
    out = None
    for level in found:
        out = level if out is None else out.unionByName(level)
    each = out.select(F.concat("head", F.array("last")).alias("items"), "n", F.explode(F.array(
        F.struct(F.lit("block").alias("verdict"), F.col("blocked").alias("support")), F.struct(F.lit("allow").alias("verdict"), (F.col("n") - F.col("blocked")).alias("support")),
    )).alias("r")).select("items", "r.verdict", (F.col("r.support") / F.col("n")).alias("confidence"), F.col("r.support").alias("support"))
    return each.where((F.col("support") >= enough) & (F.col("confidence") >= confidence))


def undominated(rules: DataFrame) -> DataFrame:
    """The rules without those that one with an item less makes needless: it has
    the same verdict, fires wherever they do, and is at least as sure."""
    r = rules.select("rule_id", "verdict", "confidence", F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x)))).alias("fewer"))
    known = rules.select(F.col("items").alias("fewer"), "verdict", F.col("confidence").alias("surer"))
    needless = r.join(known, ["fewer", "verdict"]).where(F.col("surer") >= F.col("confidence")).select("rule_id").distinct()
    return materialize(rules.join(needless, "rule_id", "left_anti"), "rules")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, learned: the verdict of the surest mined rule that fires; URLs that
    fire none are left out.  ``urls`` as ``described`` gives them."""
    met = urls.select("url", "items", F.explode("items").alias("item")).join(rules.withColumnRenamed("items", "needed"), "item")
    met = met.where(F.size(F.array_except("needed", "items")) == 0)
    rank = F.struct("confidence", "support", F.size("needed").alias("size"), (F.col("verdict") == "block").alias("block"))
    return met.groupBy("url").agg(F.max_by("verdict", rank).alias("learned"))


def stated_rule(host: Column, path: Column, stated: list[Stated]) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest stated rule that fits, nulls
    where none does; of equally long ones the later in the alphabet."""
    rule = verdict = F.lit(None).cast("string")
    for s in sorted(stated, key=lambda s: (len(s.host + s.path), s.host + s.path)):
        fits = ((host == s.host) | F.endswith(host, F.lit("." + s.host))) & F.startswith(path, F.lit(s.path))
        rule, verdict = F.when(fits, s.host + s.path).otherwise(rule), F.when(fits, s.verdict).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, stated: list[Stated], rules: DataFrame | None, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict of every row."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    u = F.col("url")
    rows = rows.withColumn("host", F.coalesce(host_of(u), F.lit(""))).withColumn("path", F.coalesce(path_of(u), F.lit("")))
    rule, verdict = stated_rule(F.col("host"), F.col("path"), stated)
    rows = rows.withColumn("rule", rule).withColumn("stated", verdict)
    if rules is None:
        rows = rows.withColumn("learned", F.lit(None).cast("string"))
    else:
        rows = rows.join(fired(described(rows), rules), "url", "left")
    return rows.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("stated", "learned", F.lit(default)).alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, verdict) of the pages whose document is labelled; the document is
    named by the last number in the URL's path.  A document of low quality or
    with toxic text says block, another allow; null labels say nothing, and
    a document with several labels is blocked by any."""
    number = F.regexp_extract("path", r"(?s)^.*?(\d+)\D*$", 1)
    urls = pages.select("url").where(F.col("url").isNotNull()).withColumn("path", path_of(F.col("url")))
    named = urls.select("url", number.try_cast("long").alias("doc_id"))
    bad = F.coalesce((F.col("quality") == 0), F.lit(False)) | F.coalesce((F.col("toxic") == 1), F.lit(False))
    known = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return named.join(known, "doc_id").select("url", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
