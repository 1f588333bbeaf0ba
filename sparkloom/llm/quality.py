"""Quality scores by Bradley-Terry pairwise ranking.

A document has a strength w.x from features x of its text. Preference pairs set a document of label 1 against one
of label 0; P(first wins) = 1 / (1 + exp(-(w.x1 - w.x0))), so w comes from a logistic loss on the feature
differences, without an intercept. The features are measures of form and signed counts of the text's words, hashed to
WORD_SLOTS places. Every labelled row that trains is in at least one pair a round, however rare its label: rows are
dealt to hash buckets that all hold both labels, and in a bucket the k-th winner, counted round and round, meets the
k-th loser. So pairs grow with the labels, and no group is crossed with another. Of each label at most most_rows
rows train, a sample by hash; scores are of all rows.

The cut is a quantile of the labelled strengths: the share of label 0 lies below it. A score is
1 / (1 + exp(-(strength - cut) - logit(0.7))), so 0.7 is the cut.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import broadcast_if_small, fresh, saved

NAMES = [
    "log_bytes", "upper", "symbols", "bars", "exclaims", "digits", "breaks", "distinct_words", "top_word", "same_neighbours",
    "repeated_triples", "word_length", "odd_ends", "all_upper_words",
]
#: Places of the hashed words.
WORD_SLOTS = 64
WIDTH = len(NAMES) + WORD_SLOTS
#: Rows of each label that train at most.
MOST_ROWS = 1_000_000
SYMBOLS = b"#$%&*@^~<>{}[]\\_=+"
PASS = 0.7


def _bytes_of(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL, _SPACE = _bytes_of(SYMBOLS), _bytes_of(b" \t\n\x0b\x0c\r")


def measure(text: str) -> list[float]:
    """The features of a whole text; an empty one has zeros."""
    words = text.split()
    if not words:
        return [0.0] * WIDTH
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    wide = np.count_nonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) if counts[0xC3] else 0
    upper, lower = counts[65:91].sum() + wide, counts[97:123].sum() + counts[0xC3] - wide
    seen = max(1, len(raw) - counts[_SPACE].sum())
    n = len(words)
    often = Counter(words)
    triples = n - 2
    distinct = len(set(zip(words, words[1:], words[2:], strict=False))) if triples > 0 else 1
    return [
        math.log1p(len(raw)),
        upper / max(1, upper + lower),
        counts[_SYMBOL].sum() / seen,
        counts[ord("|")] / n,
        counts[ord("!")] / n,
        counts[48:58].sum() / seen,
        counts[10] / n,
        len(often) / n ** 0.9,
        max(often.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - distinct / max(1, triples) if triples > 0 else 0.0,
        seen / n / 10,
        sum(1 for w in words if w[-1] in "#$%&*!|") / n,
        sum(map(str.isupper, words)) / n,
        *_hashed_words(often, n),
    ]


def _hashed_words(often: Counter, n: int) -> list[float]:
    """Counts of words in lower case, each added to or taken from the place its hash names, by the root of their number."""
    codes = np.fromiter((zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) for w in often), dtype=np.int64, count=len(often))
    signed = np.where(codes >> 31, 1.0, -1.0) * np.fromiter(often.values(), dtype=np.float64, count=len(often))
    return (np.bincount(codes % WORD_SLOTS, weights=signed, minlength=WORD_SLOTS) / math.sqrt(n)).tolist()


def features(text: Column) -> Column:
    """array<float>: NAMES, then the hashed words. Null counts as empty."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in measure(t or "")] for t in texts], dtype=object)

    return run(text)


@dataclass
class Ranking:
    weights: list[float]
    cut: float

    def strength(self, x: Column) -> Column:
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        return F.aggregate(F.zip_with(x.cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def score(self, x: Column) -> Column:
        """0 to 1; PASS where the strength equals the cut."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(self.strength(x) - F.lit(self.cut)) - F.lit(math.log(PASS / (1 - PASS)))))


def pairs(labelled: DataFrame, rounds: int = 4, bucket_rows: int = 32) -> DataFrame:
    """Preference pairs (better, worse) of feature arrays from rows (id, x, label) of both labels: in each round every row is in at least one."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    out = None
    for r in range(rounds):
        buckets = max(1, min(counts[0], counts[1]) // bucket_rows)
        while True:  # half as many buckets until each has both labels
            dealt = labelled.withColumn("bucket", F.pmod(F.xxhash64(F.col("id"), F.lit(r)), F.lit(buckets)))
            sizes = dealt.groupBy("bucket").agg(F.count_if(F.col("label") == 1).alias("winners"), F.count_if(F.col("label") == 0).alias("losers"))
            if buckets == 1 or sizes.filter("winners = 0 or losers = 0").isEmpty():
                break
            buckets //= 2
        rank = F.row_number().over(Window.partitionBy("bucket", "label").orderBy(F.xxhash64(F.col("id"), F.lit(r + 1000)), "id")) - 1
        ranked = dealt.withColumn("rank", rank).join(sizes, "bucket")
        most = F.greatest("winners", "losers")

        def turns(label: int, own: str, name: str) -> DataFrame:
            """Each row of a label at every turn that it takes: its rank, and again after all others of its label."""
            last = most - 1 - F.pmod(most - 1 - F.col("rank"), F.col(own))
            return ranked.filter(F.col("label") == label).select("bucket", F.explode(F.sequence(F.col("rank").cast("long"), last, F.col(own))).alias("turn"), F.col("x").alias(name))

        found = turns(1, "winners", "better").join(turns(0, "losers", "worse"), ["bucket", "turn"]).select("better", "worse")
        out = found if out is None else out.unionByName(found)
    return out


def fit(labelled: DataFrame, rounds: int = 4, regularisation: float = 1e-3, iterations: int = 40, most_rows: int = MOST_ROWS) -> Ranking:
    """From rows (id, x array<float>, label 0 or 1). Rows with nulls don't count; of a label with more than most_rows rows about so many train.

    Without both labels there are no pairs and all weights are 0: every score is 0.5 if there is only label 0, else
    the threshold itself.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    labelled = saved(labelled.filter("x is not null and label in (0, 1)").select("id", "x", "label"), "labelled")
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Ranking([0.0] * WIDTH, 0.0 if counts.get(1) or not counts else math.log(PASS / (1 - PASS)))
    trained = labelled
    if max(counts.values()) > most_rows:
        part = F.when(F.col("label") == 1, F.lit(most_rows / counts[1])).otherwise(F.lit(most_rows / counts[0]))
        trained = labelled.filter(F.pmod(F.xxhash64("id", F.lit(2000)), F.lit(1_000_000)) < part * 1_000_000)
    rows = saved(pairs(trained, rounds).select(F.zip_with("better", "worse", lambda a, b: (a - b).cast("double")).alias("d")), "pairs")
    # each pair from both sides, so that both classes are there
    rows = rows.withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    rows = rows.select(array_to_vector(F.transform("d", lambda v: v * F.col("sign"))).alias("features"), (F.col("sign") > 0).cast("double").alias("label"))
    model = LogisticRegression(fitIntercept=False, regParam=regularisation, maxIter=iterations).fit(rows)
    ranking = Ranking([float(v) for v in model.coefficients], 0.0)
    share = counts[0] / (counts[0] + counts[1])
    around = F.array(F.lit(share), F.lit(min(1.0, share + 1.5 / sum(counts.values()))))  # the largest below the cut, the next above
    below, above = labelled.select(F.percentile_approx(ranking.strength(F.col("x")), around, F.lit(200_000))).first()[0]
    ranking.cut = (below + above) / 2
    return ranking


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Without the rows held out for evaluation."""
    return labels.filter(~held_out(F.col(id_col)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *more: Column) -> DataFrame:
    """(id_col, score, *more) of every row of docs, learnt from the rows of labels (id_col, label_col) whose text is in docs.

    Null and empty texts have zeros as features and a score like any; a text is measured whole, however long. Several
    labels of one id: the largest counts, and each row of docs with that id trains. Null identifiers get a score and
    have no label. Repeated rows are scored alike, equal scores are no matter. An empty table gives an empty result;
    columns of docs other than those of more are not looked at. The features are written once, a row for each row of docs.
    """
    named = [c.alias(f"m{i}") for i, c in enumerate(more)]
    rows = saved(docs.select(F.col(id_col).alias("id"), *named, features(F.col(text_col)).alias("x")), "features")
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    ranking = fit(rows.select("id", "x").join(known, "id"))
    return rows.select(F.col("id").alias(id_col), ranking.score(F.col("x")).alias("score"), *[f"m{i}" for i in range(len(more))])


def drop_low(docs: DataFrame, labels: DataFrame, threshold: float = PASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; identifiers and texts as in scored.

    The rows that go are named by identifier and a hash of the text, so rows that repeat an identifier are judged each by its own text.
    """
    h = F.xxhash64(text_col)
    gone = scored(docs, labels, id_col, text_col, label_col, h).filter(F.col("score") < threshold)
    names = fresh(docs, "gone_id"), fresh(docs, "gone_hash")
    gone = broadcast_if_small(saved(gone.select(id_col, "m0").distinct(), "rejected").toDF(*names))
    return docs.join(gone, docs[id_col].eqNullSafe(gone[names[0]]) & (h == gone[names[1]]), "left_anti")
