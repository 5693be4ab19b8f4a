"""URL filtering by association rules, in DataFrame and SQL functions only.

FP-growth mines combinations of URL tokens together with the label of the page. A combination X gives
the rule X -> label if X and the label together are frequent enough (support), if the label's share
among the labelled urls with X is high enough (confidence), and if that share exceeds the label's share
overall (lift). A rule that has a shorter rule of the same verdict inside it, with no lower confidence,
is pruned. Rules are found through an inverted index from each rule's rarest token to the rule, so a
url meets only rules that could match, and the strongest one that matches decides.

Every part of a path, key of a query and suffix of a host is a token, however long the url. Tokens that stand in the same labelled urls
(a site's host and its suffixes, a fixed chain of directories) are one item for the mining, and tokens of every url none: what their
combinations would say is said by one of them, so all of these rules would be pruned. A url has an item if it has any of its tokens.
Where a url still has over DEEP items, which may lie within one another like the directories of a large site, the combinations are grown level by level
instead, leaving out each that holds in the same urls as a shorter one: its rule would be pruned too, so the rules are the same.

Rules are mined from at most ROWS labelled urls, so they and their index do not grow with the table.
Fixed (host, path) rules given by the caller come first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, named, prepare, spread_join, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 0.0, 20, 0.6, 1.1
#: Labelled urls to mine, chosen by a hash of the url; items of a url up to which FP-growth lists all combinations; rows of a table that may be broadcast.
ROWS, DEEP, SMALL = 20_000, 12, 50_000
#: (verdict, host and path) of the production rules; a path begins at the first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The url's distinct tokens: scheme, suffixes of the host, path parts, query keys, fragment.

    Digits are one class, so that numbers do not make every url its own.
    """
    classed = lambda x: F.regexp_replace(F.translate(x, _UPPER, _LOWER), "[0-9]+", "0")
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, k, n), ".")))
    parts = F.transform(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), classed(x)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), classed(F.split(x, "=")[0])))
    scheme = F.array(F.concat(F.lit("scheme:"), F.translate(F.regexp_extract(url, r"(?s)\A(.*?)://", 1), _UPPER, _LOWER)))
    fragment = F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(scheme, suffixes, parts, keys, fragment))


_RULES = "items array<string>, verdict string, confidence double, support long, anchor string"
_ITEMS = "token string, item string, n long"


def _none(spark, schema: str) -> DataFrame:
    return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ") for x in schema.split(", "))))


def looked_up(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left joined to right, a written table unique by `on`: by broadcast if it has at most SMALL rows, else spread over hot keys."""
    return left.join(F.broadcast(right), on) if right.count() <= SMALL else spread_join(written(left, "url-lookups"), right, on)


def _by_growth(baskets: DataFrame, least: float, n: int) -> DataFrame:
    """(items, verdict, both, support) of the combinations of items that `least` labelled urls of a verdict have, by FP-growth."""
    label = F.array(F.concat(F.lit("verdict:"), "verdict"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=1.0).fit(baskets.select(F.concat("items", label).alias("items")))
    frequent = written(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support")), "url-itemsets")
    is_label = lambda x: x.startswith("verdict:")
    with_label = frequent.where(F.exists("items", is_label) & (F.size("items") > 1)).select(
        F.filter("items", lambda x: ~is_label(x)).alias("items"), F.substring(F.filter("items", is_label)[0], 9, 1000).alias("verdict"), F.col("support").alias("both")
    )
    return with_label.join(frequent.where(~F.exists("items", is_label)), "items").select("items", "verdict", "both", "support")


def _by_levels(baskets: DataFrame, least: float) -> DataFrame:
    """As _by_growth, without combinations that hold in as many urls as one with an item less; level by level from single items.

    A combination is tried only if all that have an item less are kept.
    """
    held = baskets.select("row", "verdict", F.array_sort("items").alias("items"))
    found, size = None, 1
    tried = held.select("row", "verdict", "items", F.explode("items").alias("last")).withColumn("set", F.array("last"))
    while True:
        tried = written(tried.select("row", "verdict", "items", "last", "set"), f"url-tried-{size}")
        by_verdict = tried.groupBy("set", "verdict").agg(F.count("*").alias("both")).groupBy("set").agg(F.collect_list(F.struct("verdict", "both")).alias("by"), F.sum("both").alias("support"))
        kept = by_verdict.where(F.exists("by", lambda x: x["both"] >= least))
        if size > 1:
            inner = kept.select("set", "support", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.filter("set", lambda x, i: i != k))).alias("inner"))
            inner = inner.join(before.select(F.col("set").alias("inner"), F.col("support").alias("most")), "inner")
            free = inner.groupBy("set", "support").agg(F.count("*").alias("k"), F.min("most").alias("most")).where((F.col("k") == size) & (F.col("support") < F.col("most"))).select("set")
            kept = kept.join(free, "set")
        before = written(kept, f"url-kept-{size}")
        own = before.select(F.col("set").alias("items"), F.explode("by").alias("x"), "support").select("items", "x.verdict", "x.both", "support").where(F.col("both") >= least)
        found = own if found is None else found.unionByName(own)
        if before.isEmpty():
            return found
        more = tried.join(before.select("set"), "set").select("row", "verdict", "items", "set", "last", F.explode(F.filter("items", lambda x: x > F.col("last"))).alias("next"))
        tried = more.select("row", "verdict", "items", F.col("next").alias("last"), F.concat("set", F.array("next")).alias("set"))
        size += 1


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, rows: int = ROWS, deep: int = DEEP) -> tuple[DataFrame, DataFrame]:
    """Rules (items, verdict, confidence, support, anchor) from labelled (url, verdict), and the items (token, item, n) of tokens.

    At most `rows` labelled rows are taken, those whose url has the least hashes. A rule needs min_count of them, however many there are, so that
    a site's rule does not go as the table grows; min_support, a share of them, can ask for more. n is how many labelled urls have the token.
    A rule with no items, from the labels alone, says what holds for urls that no other rule matches.
    Rows with a null url or label are left out; repeated rows count as often as they come. No labels: no rules.
    """
    spark = prepare(labelled.sparkSession)
    own = labelled.where("url is not null and verdict is not null").select("url", "verdict").orderBy(F.xxhash64("url"), "url", "verdict").limit(rows)
    own = written(own.select(F.monotonically_increasing_id().alias("row"), tokens_of(F.col("url")).alias("tokens"), "verdict"), "url-tokens")
    shares = {r["verdict"]: r["n"] for r in own.groupBy("verdict").agg(F.count("*").alias("n")).collect()}  # a row for each verdict
    n = sum(shares.values())
    if not n:
        return _none(spark, _RULES), _none(spark, _ITEMS)
    least = max(min_support * n, min_count)
    # the rows of a token, by their number and two sums of hashes: equal for tokens of the same rows
    mark = F.xxhash64("row")
    stats = own.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 24)).alias("s"))
    items = stats.where((F.col("n") >= least) & (F.col("n") < n)).select("token", F.min("token").over(Window.partitionBy("n", "x", "s")).alias("item"), "n")
    items = written(items, "url-items")
    baskets = looked_up(own.select("row", F.explode("tokens").alias("token")), items, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    baskets = written(own.select("row", "verdict").join(baskets, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))), "url-baskets")
    longest = baskets.agg(F.max(F.size("items"))).first()[0]
    counts = _by_growth(baskets, least, n) if longest <= deep else _by_levels(baskets, least)
    share = F.coalesce(*(F.when(F.col("verdict") == v, F.lit(k / n)) for v, k in shares.items()))
    rules = counts.select("items", "verdict", (F.col("both") / F.col("support")).alias("confidence"), F.col("both").alias("support"), share.alias("share"))
    rules = rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * F.col("share"))).drop("share")
    plain = spark.range(1).select(F.explode(F.array(*(F.struct(F.array().cast("array<string>").alias("items"), F.lit(v).alias("verdict"), F.lit(k / n).alias("confidence"), F.lit(k).cast("long").alias("support")) for v, k in shares.items()))).alias("r")).select("r.*")
    rules = written(rules.unionByName(plain), "url-rules")
    smaller = rules.select("items", "verdict", "confidence", F.explode("items").alias("x"))
    smaller = smaller.select("items", F.array_remove("items", F.col("x")).alias("inner"), "verdict", "confidence")
    inner = rules.select(F.col("items").alias("inner"), "verdict", F.col("confidence").alias("inner_confidence"))
    pruned = smaller.join(inner, ["inner", "verdict"]).where("inner_confidence >= confidence").select("items", "verdict").distinct()
    single = items.where("token = item").select(F.col("item").alias("x"), "n")
    anchors = rules.select("items", F.explode("items").alias("x")).distinct().join(single, "x").groupBy("items").agg(F.min_by("x", F.struct("n", "x")).alias("anchor"))
    rules = rules.join(pruned, ["items", "verdict"], "left_anti").join(anchors, "items", "left").select("items", "verdict", "confidence", "support", "anchor")
    return written(rules, "url-rule-index"), items


def verdicts(urls: DataFrame, rules: DataFrame, items: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(url, n, verdict) of each distinct url that is not null: how many rows have it, and the strongest matching rule's verdict.

    Strongest: highest confidence, then support, then more items, then verdict and items by name. A rule
    with no items matches every url if it is the strongest such rule; with none, `otherwise` holds. A url meets the rules of its anchors one by one.
    """
    plain = rules.where(F.size("items") == 0).orderBy(F.desc("confidence"), F.desc("support"), "verdict").first()
    otherwise = plain["verdict"] if plain else otherwise
    seen = written(urls.where("url is not null").groupBy("url").agg(F.count("*").alias("n")), "urls")
    index = rules.where("anchor is not null").select("anchor", F.struct("confidence", "support", F.size("items").alias("size"), "verdict", "items").alias("rule"))
    if index.isEmpty():
        return seen.select("url", "n", F.lit(otherwise).alias("verdict"))
    used = written(items.join(index.select(F.explode("rule.items").alias("item")).distinct(), "item", "left_semi").select("token", "item"), "url-items-used")
    own = looked_up(seen.select("url", F.explode(tokens_of(F.col("url"))).alias("token")), used, "token").groupBy("url").agg(F.collect_set("item").alias("held"))
    met = own.select("url", "held", F.explode("held").alias("anchor"))
    if index.count() <= SMALL:
        met = met.join(F.broadcast(index), "anchor")
    else:
        met = spread_join(written(met, "url-anchors"), written(index.groupBy("anchor").agg(F.collect_list("rule").alias("rules")), "url-anchor-rules"), "anchor").select("url", "held", F.explode("rules").alias("rule"))
    best = met.where(F.size(F.array_except("rule.items", "held")) == 0).groupBy("url").agg(F.max("rule")["verdict"].alias("verdict"))
    return seen.join(best, "url", "left").select("url", "n", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits: its host or a subdomain, and its path's beginning."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, labelled: DataFrame, url_col: str = "url", rules=RULES, otherwise: str = "allow", **mining) -> DataFrame:
    """pages with a last column, struct(host, path, rule, verdict), called `judged` or, if pages has that, `_judged`.

    Every row of pages comes out once, repeated rows and null urls too; the columns of pages stay as
    they are; an empty table stays empty. Long urls count whole. `labelled` has url and verdict (block or allow). Null
    urls, and all urls if there are no rules, get `otherwise`. Rows that a fixed rule settles and those without url are
    not shuffled; a url with a great part of all rows meets its verdict by broadcast.
    """
    name, key, mark = fresh(pages, "judged"), fresh(pages, "url_key"), fresh(pages, "url_verdict")
    url = named(url_col)
    fixed = fixed_rule(host_of(url), path_of(url), rules)
    is_open = url.isNotNull() & fixed.isNull()
    left = pages.where(is_open)
    found = written(verdicts(left.select(url.alias("url")), *mined_rules(labelled, **mining), otherwise), "url-verdicts")
    found = found.select(F.col("url").alias(key), F.col("n").alias(fresh(pages, "url_n")), F.col("verdict").alias(mark))
    joined = spread_join(left.withColumn(key, url), found, key, "left", rows=found.columns[1])
    out = joined.select(*(named(c) for c in pages.columns), mark).unionByName(pages.where(~is_open).withColumn(mark, F.lit(None).cast("string")))
    verdict = F.coalesce(fixed["verdict"], F.col(mark), F.lit(otherwise))
    return out.withColumn(name, F.struct(host_of(url).alias("host"), path_of(url).alias("path"), fixed["rule"].alias("rule"), verdict.alias("verdict"))).drop(mark)


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, verdict) of pages whose url's first number in the path is a labelled document: block if it is of low quality or toxic.

    Of repeated labels one that says block decides; null urls and ids, and urls without a number, have no label; repeated pages come as often as they
    are; empty tables give no rows.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?![0-9])", 1).try_cast("bigint")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(bad, "block").otherwise("allow")).alias("verdict"))
    return pages.select("url", number.alias("doc_id")).join(marked, "doc_id").select("url", "verdict")
