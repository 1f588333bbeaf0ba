"""URL filters: fixed host and path rules, and rules mined from labels with FP-growth.

Mining: a labelled URL is a transaction of tokens (host suffixes, path parts, file ending, query keys, scheme) and, if
it is to be blocked, of a label item. Tokens that are too rare for a rule are left out, and tokens that stand in the
same URLs are one item, so a template of many parts makes few itemsets. The combinations sought are those of which at
least min_support of all labelled URLs and min_confidence of those that match are blocked; a rule whose part has the
same confidence or more goes. Spark's FPGrowth, whose itemsets have any length, finds them in the URLs of at most
MOST_ITEMS items. URLs of more items are searched level by level up to max_tokens tokens. A combination that reaches
the threshold over both reaches a share of it in one, the shares adding up to the whole, so what either finds at its
share is all there is; it is then counted over all URLs. Of a URL's items none is left out.

A quarter of the labelled URLs, by hash, is not mined: a rule that matches some of them, of which fewer than
min_confidence are blocked, goes, and the others carry how they did.

Matching: an inverted index has each rule under its rarest token. A URL looks up its tokens and a rule fires when the
URL has all of the rule's tokens. The index is broadcast up to broadcast_rules rules of bounded size; beyond, it's
joined by shuffle. Each distinct URL is matched once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, saved

BLOCKED = "label:block"
#: Items of a URL up to which FP-growth takes it; the sets of a longer one double with each item, so it is searched by levels.
MOST_ITEMS = 12
#: Labelled URLs that a task mines.
PART_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host_col: Column, path_col: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: ("host/path", "allow" or "block"), a short list.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of equally long rules the
    first in the alphabet wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host_col == rule_host) | F.endswith(host_col, F.lit("." + rule_host))) & F.startswith(path_col, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; numbers in paths are one token each, whatever their value."""
    parts = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    steps = F.transform(
        F.filter(F.split(path(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.lower(x), "[0-9]+", "0"))
    )
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("key:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))))
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(F.concat(suffixes, steps, keys, scheme))).otherwise(F.array().cast("array<string>"))


RULE = "tokens array<string>, confidence double, support double"


def _items(rows: DataFrame, least: float) -> DataFrame:
    """(token, item): the tokens of at least so many blocked rows (row, blocked, tokens), each with the first of those that stand in the same rows."""
    seen = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    kept = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("hits"), *marks).filter(F.col("hits") >= least)
    same = kept.groupBy("n", "mark1", "mark2").agg(F.min("token").alias("item"), F.max("hits").alias("hits"), F.collect_list("token").alias("token"))
    return same.select("item", "n", "hits", F.explode("token").alias("token"))


def _grown(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(blocked, tokens, rest) from rows (blocked, items in order): the sets of a row of one item more than there are levels, each with the items behind its last.

    Levels are tables of sets (tokens): a row's set grows only if it is in the level of its size. Nothing but these sets meets the rows.
    """
    step = lambda head, items: (F.posexplode(items).alias("at", "last"), head.alias("head"), items.alias("from"))
    held = [F.concat("head", F.array("last")).alias("tokens"), F.slice("from", F.col("at") + 2, F.size("from")).alias("rest")]
    seen = rows.select("blocked", *step(F.array().cast("array<string>"), F.col("items"))).select("blocked", *held)
    for kept in levels:
        seen = seen.join(broadcast_if_small(kept), "tokens").select("blocked", *step(F.col("tokens"), F.col("rest"))).select("blocked", *held)
    return seen


def _by_levels(rows: DataFrame, least: int, most: int) -> DataFrame:
    """The sets (tokens) of at most so many items that at least so many rows (blocked, items) have."""
    levels = []
    for _ in range(most):
        counts = _grown(rows, levels).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
        levels.append(saved(counts.filter(F.col("n") >= least).select("tokens"), "level"))
    return reduce(DataFrame.unionByName, levels)


def _counted(sets: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(tokens, hits, of): how many rows (blocked, items) have all items of a set of at most so many, and the blocked ones. Sets are in order; their beginnings are counted too."""
    levels, counts = [], []
    for size in range(1, most + 1):
        level = saved(sets.filter(F.size("tokens") >= size).select(F.slice("tokens", 1, size).alias("tokens")).distinct(), "beginnings")
        met = _grown(rows, levels).join(broadcast_if_small(level), "tokens")
        counts.append(met.groupBy("tokens").agg(F.count_if("blocked").alias("hits"), F.count(F.lit(1)).alias("of")))
        levels.append(level)
    return reduce(DataFrame.unionByName, counts)


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, max_tokens: int = 3, min_hits: int = 5) -> DataFrame:
    """Rules (tokens array<string>, confidence, support) from rows (url, blocked boolean). Null urls and labels don't count, repeated rows do.

    Every rule of at most max_tokens tokens that reaches the thresholds is there but for those with a part as good. An
    empty table and one without blocked rows give none. The sets of a URL of more than MOST_ITEMS items are at most the
    max_tokens-th power of its items, and only those that enough such URLs have are held.
    """
    rows = labelled.filter("url is not null and blocked is not null")
    rows = saved(rows.select(F.monotonically_increasing_id().alias("row"), "blocked", tokens(F.col("url")).alias("tokens")), "transactions")
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if("blocked")).first()
    if not bad:
        return rows.sparkSession.createDataFrame([], RULE)
    least = math.ceil(max(min_hits - 0.5, min_support * n))
    items = saved(_items(rows, least), "items")
    if items.isEmpty():
        return rows.sparkSession.createDataFrame([], RULE)
    named = saved(items.filter("token = item").select("item"), "item-names")
    held = rows.select("row", "blocked", F.explode("tokens").alias("item")).join(broadcast_if_small(named), "item")
    # a row's sets are many times its bytes, so rows are dealt by number
    held = held.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS)), "row")
    held = saved(held.groupBy("row", "blocked").agg(F.sort_array(F.collect_list("item")).alias("items")), "held-items")
    long = F.size("items") > MOST_ITEMS
    n_short, n_long, bad_long = held.agg(F.count_if(~long), F.count_if(long), F.count_if(long & F.col("blocked"))).first()
    # what has fewer blocked long rows than this share has the rest of the threshold in short ones
    share = (least + 1) // 2
    rest = least - min(bad_long, share - 1)
    blocked = every = rows.sparkSession.createDataFrame([], "tokens array<string>, freq long")
    if n_short:
        baskets = held.filter(~long).select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCKED))).otherwise(F.col("items")).alias("items"))
        # half a row less, so that no rounding of the quotient takes a set of just so many rows away
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (rest - 0.5) / n_short), minConfidence=min_confidence).fit(saved(baskets, "baskets"))
        sets = saved(model.freqItemsets, "itemsets")
        blocked = sets.filter(F.array_contains("items", BLOCKED) & (F.size("items") > 1) & (F.size("items") <= max_tokens + 1))
        blocked = blocked.select(F.array_sort(F.array_remove("items", BLOCKED)).alias("tokens"), "freq")
        every = sets.select(F.array_sort("items").alias("tokens"), "freq")
    if n_long:
        found = blocked.select("tokens")
        if bad_long >= share:
            found = found.unionByName(_by_levels(held.filter(long & F.col("blocked")).select("blocked", "items"), share, max_tokens)).distinct()
        counts = _counted(saved(found, "found"), held, max_tokens)
    else:
        counts = blocked.withColumnRenamed("freq", "hits").join(every.withColumnRenamed("freq", "of"), "tokens")
    rules = counts.filter(F.col("hits") >= least).select("tokens", (F.col("hits") / F.col("of")).alias("confidence"), (F.col("hits") / F.lit(n)).alias("support"))
    rules = saved(rules.filter(F.col("confidence") >= min_confidence), "rules")
    # a rule goes if dropping one of its tokens leaves a rule with the same confidence or more
    shorter = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"))
    parts = rules.filter(F.size("tokens") > 1).select("tokens", "confidence", F.explode("tokens").alias("out"))
    parts = parts.select("tokens", "confidence", F.array_remove("tokens", F.col("out")).alias("part"))
    needless = parts.join(shorter, "part").filter("part_confidence >= confidence").select("tokens").distinct()
    rules = rules.join(needless, "tokens", "left_anti")
    # an item stands for each of its tokens
    for k in range(max_tokens):
        names = items.select(F.col("item").alias("one"), "token")
        more = rules.withColumn("one", F.get("tokens", F.lit(k))).join(names, "one", "left")
        rules = more.select(F.when(F.col("token").isNull(), F.col("tokens")).otherwise(F.transform("tokens", lambda t, i: F.when(i == k, F.col("token")).otherwise(t))).alias("tokens"), "confidence", "support")  # noqa: B023
    return rules.select(F.array_sort("tokens").alias("tokens"), "confidence", "support").distinct()


def hold(url: Column) -> Column:
    """Whether a labelled URL is held out."""
    return F.crc32(F.encode(url, "UTF-8")) % 4 == 2


def tested(rules: DataFrame, held: DataFrame, min_confidence: float) -> DataFrame:
    """The rules that do as well on held-out rows (url, blocked), with (held_out, held_out_blocked), the rows that they match and the blocked ones."""
    rules = saved(rules, "mined")
    urls = saved(held.filter("url is not null and blocked is not null").select("url", "blocked", tokens(F.col("url")).alias("all")), "held-out")
    found = urls.select("blocked", "all", F.explode("all").alias("token")).join(rules.select("tokens", F.get("tokens", F.lit(0)).alias("token")), "token")
    found = found.filter(F.size(F.array_intersect("all", "tokens")) == F.size("tokens"))
    counts = found.groupBy("tokens").agg(F.count(F.lit(1)).alias("held_out"), F.count_if("blocked").alias("held_out_blocked"))
    out = rules.join(counts, "tokens", "left").fillna(0, ["held_out", "held_out_blocked"])
    return out.filter(F.col("held_out_blocked") >= F.col("held_out") * min_confidence)


def match(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = 10_000) -> DataFrame:
    """(id_col, mined array of the tokens of the best rule, confidence) of the identifiers that a rule matches, one row each.

    The best rule has the largest confidence, then support, then tokens in order.
    """
    rules = saved(rules, "rules")
    if rules.isEmpty():
        return pages.select(id_col, F.array().cast("array<string>").alias("mined"), F.lit(0.0).alias("confidence")).filter(F.lit(False))
    found = pages.select(F.col(id_col).alias("__id"), F.array_sort(tokens(F.col(url_col))).alias("__tokens"))
    looked_up = found.select("__id", "__tokens", F.explode("__tokens").alias("token"))
    counts = looked_up.groupBy("token").count()
    keyed = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = keyed.groupBy("tokens", "confidence", "support").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("key"))
    index = saved(rarest.select("tokens", "confidence", "support", F.col("key.token").alias("token")), "rule-index")
    joined = looked_up.join(broadcast_if_small(index) if index.count() <= broadcast_rules else index, "token")
    fired = joined.filter(F.size(F.array_intersect("__tokens", "tokens")) == F.size("tokens"))
    best = fired.groupBy("__id").agg(F.max(F.struct("confidence", "support", "tokens")).alias("best"))
    return best.select(F.col("__id").alias(id_col), F.col("best.tokens").alias("mined"), F.col("best.confidence").alias("confidence"))


def judge(
    pages: DataFrame, labelled: DataFrame, fixed: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    min_support: float = 0.002, min_confidence: float = 0.6, max_tokens: int = 3,
) -> DataFrame:
    """(id_col, host, path, rule, verdict, mined, confidence) of every page: the fixed rules' verdict, else block if a mined rule matches.

    Null URLs and URLs without :// have an empty host and path, no tokens, and are allowed unless a fixed rule fits. Each
    row is judged by its own URL, whatever its identifier, repeated or null; equal URLs are judged alike. Without labels,
    or with none that makes a rule, only the fixed rules block. URLs are taken whole, however long. Empty tables give an
    empty result; other columns are not looked at.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).alias("__url"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    held = hold(F.col("url"))
    rules = tested(mine(labelled.filter(~held), min_support, min_confidence, max_tokens), labelled.filter(held), min_confidence)
    urls = pages.select(F.col(url_col).alias("__url")).filter("__url is not null").distinct()
    best = broadcast_if_small(saved(match(urls, rules.select("tokens", "confidence", "support"), "__url", "__url"), "matched"))
    return rows.join(best, "__url", "left").select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "mined", "confidence",
    )
