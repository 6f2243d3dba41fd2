"""URL filtering by association rules, in DataFrame functions and Spark's FP-growth only.

A labelled url is a transaction of its tokens (host labels, path segments with numbers folded, query keys) and its label. Tokens that stand in
just the same labelled urls say the same and are one item, so a long url that recurs is few items and not all subsets of its tokens. FP-growth finds
the combinations of items that come with the label; those of enough support and confidence are rules. An
inverted index from a rule's rarest item to the rule finds the rules a url may meet, and a containment test decides.
Stated host and path rules come before the mined ones.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, cut

#: Verdict, host and path of the stated rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: A combination needs this share of the labelled urls, and this many of them.
MIN_SUPPORT, MIN_ROWS = 0.002, 20
MIN_CONFIDENCE = 0.5
#: A rule's confidence over the label's overall share.
MIN_LIFT = 1.5
BAD = "label=block"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` and for null."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://` and for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a url; null and urls without `://` have only what they have."""
    url = F.coalesce(url, F.lit(""))
    fold = lambda x: F.regexp_replace(ascii_lower(x), "[0-9]+", "#")
    of = lambda kind, values: F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind + "="), v))
    labels = F.split(host(url), r"\.")
    segments = F.transform(F.split(path(url), "/"), fold)
    query = F.regexp_extract(url, r"^[^#]*?\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: fold(F.element_at(F.split(p, "="), 1)))
    return F.sort_array(F.array_distinct(F.concat(of("host", labels), of("path", segments), of("query", keys))))


def name_items(rows: DataFrame, least: float) -> DataFrame:
    """(token, item) of the tokens of at least ``least`` bad rows of (tokens, bad); an item is the first of the tokens that stand in just the same rows.

    Other tokens can be in no rule. Rows are told by two 64-bit hashes of their tokens, whose exclusive sums over a token's distinct rows are compared.
    """
    sets = rows.groupBy("tokens").agg(F.count(F.when(F.col("bad"), 1)).alias("n"))
    each = sets.select("n", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"), F.explode("tokens").alias("token"))
    own = each.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("sets"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    own = cut(own.filter(F.col("n") >= least))
    alike = ["sets", "a", "b"]
    return cut(own.join(own.groupBy(*alike).agg(F.min("token").alias("item")), alike).select("token", "item"))


def with_items(rows: DataFrame, items: DataFrame, key: str = "tokens", into: str = "items") -> DataFrame:
    """``rows`` with the sorted items (token, item) that their tokens ``key`` stand for; each distinct token set is named once."""
    each = rows.select(key).distinct().select(key, F.explode(key).alias("token")).join(_small(items), "token")
    named = each.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_set("item")).alias(into))
    return rows.join(named, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(into, F.coalesce(into, F.array().cast("array<string>")))


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT
) -> tuple[DataFrame, DataFrame]:
    """Rules (antecedent, confidence, support) from (tokens, bad), combinations of items that come with a true ``bad``, and the (token, item) that they are of.

    A rule is left out if part of its items makes a rule of no less confidence. Rows with null in either column are not used;
    no bad rows give no rules. No url is cut, however many tokens it has.
    """
    rows = labelled.dropna(subset=["tokens", "bad"]).select(F.sort_array(F.array_distinct(F.array_compact("tokens"))).alias("tokens"), "bad")
    rows = cut(rows)
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "antecedent array<string>, confidence double, support double"), spark.createDataFrame([], "token string, item string")
    if rows.filter("bad").isEmpty():
        return empty
    count = rows.count()
    least = max(min_support * count, MIN_ROWS)
    items = name_items(rows, least)
    baskets = cut(with_items(rows, items).select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
    # Half a row less, as FP-growth rounds the share of the rows up.
    support = min(1.0, max(0.0, (least - 0.5) / count))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent")[0] == BAD).filter(F.col("lift") >= min_lift)
    found = cut(found.select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support"))
    # Every rule is listed under each of its items; a shorter rule that meets one there, is contained and at least as sure, prunes it.
    own = found.select(F.explode("antecedent").alias("t"), F.col("antecedent").alias("a"), F.col("confidence").alias("c"))
    by_token = own.join(
        found.select(F.explode("antecedent").alias("t"), F.col("antecedent").alias("short"), F.col("confidence").alias("s")), "t"
    )
    pruned = by_token.filter(
        (F.size("short") < F.size("a")) & (F.size(F.array_except("short", "a")) == 0) & (F.col("s") >= F.col("c"))
    ).select("a")
    return found.join(pruned.distinct(), found["antecedent"] == F.col("a"), "left_anti"), items


def inverted_index(rules: DataFrame, uses: DataFrame) -> DataFrame:
    """(token, antecedent, confidence): each rule under its token of fewest ``uses`` (token, n), ties by token."""
    each = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(uses, "token", "left")
    return each.groupBy("antecedent", "confidence").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))


def match(pages: DataFrame, rules: DataFrame, items: DataFrame, key: str = "tokens") -> DataFrame:
    """``pages`` with rule_tokens and rule_confidence of the surest mined rule that the items of their tokens meet, else null.

    A token of a page stands for its item, so a rule fits with any of the tokens that say the same; rule_tokens names the first of each.
    Each distinct token set is matched once, so pages of one large host are not many rows of one join key.
    """
    sets = cut(with_items(pages.select(key).distinct(), items, key, "__items"))
    each = sets.select(key, "__items", F.explode("__items").alias("token"))
    index = inverted_index(rules, each.groupBy("token").agg(F.count("*").alias("n")))
    met = (
        each.join(_small(index), "token")
        .filter(F.size(F.array_except("antecedent", "__items")) == 0)
        .groupBy(F.col(key).alias("k"))
        .agg(F.max(F.struct("confidence", "antecedent")).alias("best"))
        .select("k", F.col("best.antecedent").alias("rule_tokens"), F.col("best.confidence").alias("rule_confidence"))
    )
    return pages.join(_small(cut(met)), F.col(key) == F.col("k"), "left").drop("k")


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are few; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def stated(url_host: Column, url_path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (verdict, rule) of the longest stated rule that fits; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((url_host == name) | url_host.endswith("." + name)) & url_path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(out)
    return out


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, rule_tokens, rule_confidence) for every row of ``pages``.

    ``labels`` (doc_id, quality, toxic) mark pages of the same id: bad if toxic or of quality 0. The stated
    rule decides, else block if a mined rule fits, else allow. Null and malformed urls have an empty host and
    path and no tokens and are allowed; repeated rows are judged alike.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumn("tokens", tokens(F.col("url")))
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    found = match(own, *mine(own.join(marks, "page_id").select("tokens", "bad")))
    named = found.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    given = stated(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("rule_tokens").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return named.withColumn("given", given).select(
        "page_id",
        "host",
        "path",
        F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", mined).alias("verdict"),
        "rule_tokens",
        "rule_confidence",
    )


def op1(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns and the mined rule from :func:`filter_urls`."""
    return filter_urls(pages, labels).withColumn("rule_tokens", F.array_join("rule_tokens", " "))
