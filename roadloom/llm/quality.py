"""Quality rules whose cutoffs carry a guarantee against false rejection.

Each rule rejects a document when a ratio of its text (per mille) exceeds a
cutoff of its stratum (the language). The labelled documents are split by a hash
of their id. On one part (a quarter) the pairs of rule and cutoff that catch
more than their false rejections cost are ranked, the safest for what they catch
first. The other part, unseen by the ranking, tests the rule set that each rank
makes with all before it: the set is admitted only if the exact binomial tail
proves that it rejects, jointly, at most ``alpha`` of the stratum's good
documents. The sets grow and the test stops at the first that fails
(fixed-sequence testing), so no correction is due within a stratum; across strata
the error level ``delta`` is divided by their number (Bonferroni). With
probability ``1 - delta`` all admitted sets of all strata hold together, and among
them the one that catches most for the fewest false rejections is used. With four
strata about 220 good labels in the testing part prove a set without a false
rejection. A stratum with too few labels admits nothing, and its documents pass.

DataFrame expressions only. Texts are scanned once; the labels meet a table of a
few numbers for each document; counts are partially aggregated by (stratum,
part, levels of all rules).

Null or empty texts have no words and fail the base rule. A null stratum is a
stratum. A null doc_id meets no label. Repeated rows are judged alike; labels
repeated for an id count once, and count as bad if any says so. Without labels
only the base rule rejects. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import SPACE, WORD, stored, text_or_empty

RULES = ("repeats", "symbols", "capitals", "dup_lines", "exclaims")
#: Cutoffs in per mille, strict to lenient, fixed before any label is seen.
CUTOFFS = (5, 10, 20, 35, 50, 75, 100, 150, 200, 300, 450, 600, 800, 1000, 1500, 2500)
#: One labelled document in so many ranks the cutoffs, the others test them.
RANKING = 4
SYMBOLS = "#*$%&|<>"


def _let(value: Column, use) -> Column:
    """Bind a value, so that ``use`` may name it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(hashes: Column, apart: int) -> Column:
    n = F.size(hashes) - apart
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + apart), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column, width: int) -> Column:
    """Positions covered by windows that occur twice or more."""

    def from_sorted(s):
        same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return _let(F.sort_array(F.transform(twice, lambda x: x["p"])), from_places)

    def from_places(p):
        steps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(F.lit(width), b - a))
        return F.aggregate(steps, F.lit(width), lambda acc, x: acc + x)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(ordered, from_sorted))


def repeat_words(words: Column) -> Column:
    """Words within 8-word windows that are found twice or more, the first included."""
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    eight = lambda w: _let(_let(_let(hashes(w), lambda h: _pairs(h, 1)), lambda h: _pairs(h, 2)), lambda h: _pairs(h, 4))
    return F.when(F.size(words) < 9, 0).otherwise(_let(eight(words), lambda h: _covered(h, 8))).cast("long")


def text_features(docs: DataFrame, *carry: str) -> DataFrame:
    """The numbers of each text, with the columns ``carry``."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    narrow = docs.select(
        *carry,
        F.array_remove(F.split(text, SPACE), "").alias("_words"),
        lines.alias("_lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        without("!").cast("long").alias("n_exclaims"),
    )
    return narrow.select(
        *carry,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        "n_capitals",
        "n_exclaims",
        F.size("_lines").cast("long").alias("n_lines"),
    )


def _ratios() -> list[Column]:
    mille = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return [mille("n_repeat_words", "n_words"), mille("n_symbols", "n_words"), mille("n_capitals", "word_chars"), mille("n_dup_lines", "n_lines"), mille("n_exclaims", "n_words")]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x), x >= 1, to double precision: Stirling's series at x + 10, stepped back."""
    y = x + 10
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    steps = F.lit(0.0)
    for i in range(10):
        steps = steps + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) where k < n p, else 1: the largest term and its falling neighbours.

    Beyond 50,000 terms (over 5 standard deviations while n p < 1e8) nothing is left to add.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc, j):
        t = acc["t"] * (k - j + 1) * (1 - p) / ((n - k + j) * p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(50000.0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, 1.0).otherwise(top * F.aggregate(terms, start, step, lambda acc: acc["s"]))


def safe_cutoffs(features: DataFrame, labels: DataFrame, stratum: str, alpha: float, delta: float, cost: int) -> DataFrame:
    """(stratum, one nullable cutoff column for each rule); ``cost``: caught documents that one false rejection outweighs."""
    labels = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    level = lambda ratio: F.size(F.filter(F.lit(list(CUTOFFS)), lambda c: ratio > c))
    seen = features.where(~base_failed()).join(labels, "doc_id")
    ranks = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(RANKING)) == 0
    seen = seen.select(F.col(stratum).alias("_stratum"), ranks.alias("ranks"), F.array(*(level(x) for x in _ratios())).alias("levels"), "good")
    levels = seen.groupBy("_stratum", "ranks", "levels").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("bad")
    )
    levels = stored(levels, "quality-levels")  # at most strata x parts x 17 levels of each rule rows
    # The ranking part: rejected at cutoff j of a rule are all whose level is above j.
    hits = levels.where("ranks").select("_stratum", F.posexplode("levels").alias("rule", "level"), "good", "bad").where("level > 0")
    hits = hits.groupBy("_stratum", "rule", "level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    hits = hits.select("_stratum", "rule", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("j"), "good", "bad")
    hits = hits.groupBy("_stratum", "rule", "j").agg(F.sum("good").alias("k"), F.sum("bad").alias("caught")).where(F.col("caught") > cost * F.col("k"))
    safest = Window.partitionBy("_stratum").orderBy((F.col("k") + 0.5) / F.col("caught"), F.desc("j"), "rule")  # at most rules x cutoffs rows
    ladder = stored(hits.select("_stratum", "rule", "j", F.row_number().over(safest).alias("rank")), "quality-ladder")
    steps = ladder.groupBy(F.col("_stratum").alias("_in")).agg(F.collect_list(F.struct("rank", "rule", "j")).alias("steps"))
    # The first set that rejects, and from it what each set rejects.
    reached = F.filter("steps", lambda x: F.get("levels", x["rule"]) > x["j"])
    first = levels.join(steps, F.col("_stratum").eqNullSafe(F.col("_in"))).withColumn("rank", F.array_min(F.transform(reached, lambda x: x["rank"])))
    tested = lambda c: F.sum(F.when(~F.col("ranks"), F.col(c)).otherwise(0))
    first = first.groupBy("_stratum", "rank").agg(tested("good").alias("k"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    so_far = Window.partitionBy("_stratum").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = first.withColumn("n", F.sum("k").over(Window.partitionBy("_stratum"))).where("rank is not null")
    sets = sets.select("_stratum", "rank", "n", *(F.sum(c).over(so_far).alias(c) for c in ("k", "good", "bad")))
    strata = levels.agg(F.greatest(F.countDistinct(F.coalesce(F.col("_stratum").cast("string"), F.lit("\0"))), F.lit(1)).alias("strata"))
    # The tail rises with k, so the sets admitted are those before the first that fails.
    sets = sets.crossJoin(F.broadcast(strata)).where(binomial_tail(F.col("k"), F.col("n"), alpha) <= F.lit(delta) / F.col("strata"))
    sets = sets.withColumn("gain", F.col("bad") - cost * F.col("good")).where("gain > 0")
    last = sets.groupBy(F.col("_stratum").alias("_in")).agg(F.max(F.struct("gain", "rank"))["rank"].alias("last"))
    best = ladder.join(last, F.col("_stratum").eqNullSafe(F.col("_in"))).where("rank <= last")
    best = best.groupBy("_stratum", F.element_at(F.lit(list(RULES)), F.col("rule") + 1).alias("rule")).agg(F.struct(F.min("j").alias("j")).alias("b"))
    best = best.withColumn("cutoff", F.element_at(F.lit(list(CUTOFFS)), F.col("b.j") + 1))
    return best.groupBy("_stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES))


def judged(features: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, cost: int = 10) -> DataFrame:
    """``features`` with base_failed and kept."""
    cutoffs = stored(safe_cutoffs(features, labels, stratum, alpha, delta, cost), "quality-cutoffs")
    out = features.join(cutoffs, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for rule, ratio in zip(RULES, _ratios()):
        rejected = rejected | F.coalesce(ratio > F.col(f"_{rule}"), F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row."""
    features = stored(text_features(docs, "doc_id", stratum), "quality-features")
    out = judged(features, labels, stratum, alpha, delta)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def good_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    A row is known by its doc_id, stratum and text, all of which may be null.
    """
    key = [F.col("doc_id").alias("_id"), F.col(stratum).alias("_in"), F.xxhash64("text").alias("_hash")]
    numbers = text_features(docs.select("doc_id", stratum, "text", key[2]), "doc_id", stratum, "_hash")
    features = stored(numbers, "quality-features")
    kept = judged(features, labels, stratum, alpha, delta).where("kept").select(key[0], key[1], F.col("_hash").alias("_print")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & docs[stratum].eqNullSafe(kept["_in"]) & (F.xxhash64(docs["text"]) == kept["_print"])
    return docs.join(kept, same, "left_semi")
