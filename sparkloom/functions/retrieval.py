"""Recall over a catalogue: weighted terms, routes with one budget, candidates by vectors, searches with exact hits first, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.sources.shared import catalogue_side

#: Weights of a name, of an alias, and how much less a compound identifier counts that is there by its parts.
NAME, ALIAS, BY_PARTS = 3, 4, 1
SHORTEST = 2
IDEOGRAPH = r"[\x{4e00}-\x{9fff}]"


def identifier_parts(text: Column) -> Column:
    """array<string> of the parts of PurchaseOrder, purchase_order or purchase-order in lower case."""
    spaced = F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(spaced), r"[^0-9a-z\x{4e00}-\x{9fff}]+"), lambda x: x != "")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9a-z]+"), F.lit(0))


def _pairs_of_ideographs(text: Column) -> Column:
    n = F.char_length(text)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.filter(pairs, lambda p: p.rlike(IDEOGRAPH))


def term_matches(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, code, term, weight) of the terms (code, term, weight) in each text.

    A term with ideographs has to be in the text; another stands between boundaries of letters and digits, of three or
    more characters also in the plural; a compound identifier also counts by all of its parts, BY_PARTS less. Terms of
    one character don't count. Texts and terms meet on a word (or pair of ideographs) of both, so nothing is compared
    that shares none.
    """
    t = terms.select("code", F.lower(F.trim("term")).alias("term"), "weight", identifier_parts(F.col("term")).alias("parts"))
    t = t.filter(F.char_length("term") >= SHORTEST).groupBy("code", "term").agg(F.max("weight").alias("weight"), F.first("parts").alias("parts"))
    wide = F.col("term").rlike(IDEOGRAPH)
    first = F.when(wide, F.get(F.concat(_pairs_of_ideographs(F.col("term")), F.array(F.substr("term", F.lit(1), F.lit(2)))), F.lit(0))).otherwise(F.get(_words(F.col("term")), F.lit(0)))
    names = F.array_distinct(F.filter(F.array(first, F.get("parts", F.lit(0))), lambda x: x.isNotNull()))
    t = t.select("*", F.explode(names).alias("word"))
    low = F.lower(F.trim(F.col(text)))
    words = texts.select(key, low.alias("__text"), F.array_distinct(_words(low)).alias("__words"))
    singular = F.transform("__words", lambda w: F.regexp_replace(w, "s$", ""))
    keys = words.withColumn("word", F.explode(F.array_distinct(F.concat("__words", singular, _pairs_of_ideographs(F.col("__text"))))))
    met = keys.join(catalogue_side(t, "terms"), "word").dropDuplicates([key, "code", "term"])
    quoted = F.concat(F.lit("\\Q"), F.col("term"), F.lit("\\E"))
    plural = F.when(F.char_length("term") >= 3, "s?").otherwise("")
    bounded = F.expr("regexp_like(__text, __pattern)")
    met = met.withColumn("__pattern", F.concat(F.lit("(?<![0-9a-z])"), quoted, plural, F.lit("(?![0-9a-z])")))
    direct = F.when(wide, F.contains("__text", F.col("term"))).otherwise(bounded)
    parts = (F.size("parts") > 1) & (F.size(F.array_except("parts", "__words")) == 0)
    weight = F.when(direct, F.col("weight")).when(parts, F.greatest(F.lit(1), F.col("weight") - BY_PARTS))
    return met.select(key, "code", "term", weight.alias("weight")).filter("weight is not null")


def term_scores(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, code, score, rn): the sum of matched weights, ranked by score and then code."""
    g = term_matches(texts, key, text, terms).groupBy(key, "code").agg(F.sum("weight").alias("score"))
    return g.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "code")))


def routed(routes: list[tuple[str, DataFrame]], key: str, budget: int) -> DataFrame:
    """(key, route, item, score, rn): hits (key, item, score) of several routes in their order, each by score and item, up to a shared budget; an item counts in its first route."""
    out = None
    for n, (name, df) in enumerate(routes):
        part = df.select(key, "item", "score").withColumn("route", F.lit(name)).withColumn("__order", F.lit(n))
        out = part if out is None else out.unionByName(part)
    first = out.withColumn("__first", F.row_number().over(Window.partitionBy(key, "item").orderBy("__order", F.desc("score")))).filter("__first = 1")
    rn = F.row_number().over(Window.partitionBy(key).orderBy("__order", F.desc("score"), "item"))
    return first.withColumn("rn", rn).filter(F.col("rn") <= budget).select(key, "route", "item", "score", "rn")


def vector_candidates(hits: list[DataFrame], owners: DataFrame, key: str, most: float) -> DataFrame:
    """(key, code, distance): hits (key, item, distance) of several collections, those beyond a distance dropped, each item as its owner (item, code), the nearest of an owner kept."""
    out = None
    for h in hits:
        part = h.select(key, "item", "distance").filter(F.col("distance") <= most)
        out = part if out is None else out.unionByName(part)
    return out.join(owners, "item").groupBy(key, "code").agg(F.min("distance").alias("distance"))


def in_source(classes: DataFrame, tables: DataFrame) -> DataFrame:
    """The classes (name, table) whose table is among tables (table), and those without one."""
    key = F.lower("table")
    known = tables.select(key.alias("__t")).distinct()
    return classes.join(known, key == F.col("__t"), "left_semi").unionByName(classes.filter("table is null"))


def suggestions(signals: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, name, score, reasons, rn) from signals (key, name, score, reason): the best score of each name, its reasons by score, the first by score and name."""
    g = signals.groupBy(key, "name").agg(F.max("score").alias("score"), F.collect_set(F.struct((-F.col("score")).alias("s"), "reason")).alias("r"))
    g = g.select(key, "name", "score", F.array_join(F.array_distinct(F.transform(F.array_sort("r"), lambda x: x["reason"])), ",").alias("reasons"))
    return g.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "name"))).filter(F.col("rn") <= most)


def search(df: DataFrame, q: str, columns: list[str], key: str) -> DataFrame:
    """Rows of which a column holds q, without regard to case, or whose key is q: the exact key first, then by key."""
    like = "%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(like), F.lit(False))
    exact = F.coalesce(F.col(key) == F.lit(int(q)), F.lit(False)) if q.isdigit() else F.lit(False)
    return df.filter(hit | exact).withColumn("exact", exact).orderBy(F.desc("exact"), key)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page of the rows in an order that has no ties, and one row with the total of all pages."""
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


def after(df: DataFrame, key: str, last, limit: int = 1000) -> DataFrame:
    """The rows behind a key, the next limit of them in order."""
    return df.filter(F.col(key) > F.lit(last)).orderBy(key).limit(limit)


def before(df: DataFrame, key: str, first, limit: int = 1000) -> DataFrame:
    """The limit rows just before a key, in order."""
    return df.filter(F.col(key) < F.lit(first)).orderBy(F.desc(key)).limit(limit).orderBy(key)


def head_and_tail(df: DataFrame, order: list[Column], most: int = 5) -> DataFrame:
    """(part, *columns) of the first and last rows by an order without ties; a row of a short table is in both."""
    first = df.orderBy(*order).limit(most).withColumn("part", F.lit("head"))
    last = df.orderBy(*[c.desc() for c in order]).limit(most).withColumn("part", F.lit("tail"))
    return first.unionByName(last).select("part", *df.columns)


def kept_hits(hits: DataFrame, catalogue: DataFrame, relations: DataFrame | None = None, types: list[str] | None = None, entities: list[str] | None = None, at: str | None = None) -> DataFrame:
    """Hits (document_id, ...) that may be shown: in the catalogue (document_id, status, document_type, effective_date) and ACTIVE, of a wanted
    type, related (document_id, entity) to a wanted entity, and not of a later day; an unknown day passes. Case does not count."""
    c = catalogue.filter("status = 'ACTIVE'")
    if types:
        c = c.filter(F.upper("document_type").isin([t.upper() for t in types]))
    if at:
        c = c.filter(F.coalesce(F.col("effective_date") <= F.lit(at).cast("date"), F.lit(True)))
    out = hits.join(c.select("document_id"), "document_id", "left_semi")
    if entities and relations is not None:
        wanted = relations.filter(F.upper(F.trim("entity")).isin([e.strip().upper() for e in entities])).select("document_id")
        out = out.join(wanted, "document_id", "left_semi")
    return out


def owned(rows: DataFrame, sessions: DataFrame, viewer, session: str = "session_id", owner: str = "owner") -> DataFrame:
    """Rows of the viewer's sessions, and rows of none."""
    mine = sessions.filter(F.col(owner) == F.lit(viewer)).select(session)
    return rows.join(mine, session, "left_semi").unionByName(rows.filter(F.col(session).isNull()))
