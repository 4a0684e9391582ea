"""Quality rules whose cutoffs come from labelled holdouts, with a bound on false rejections.

For each stratum (language) and each rule, the good holdout documents give an order statistic as the
cutoff. With n good documents, k of them above the cutoff and X ~ Binomial(n, alpha), the share of good
documents above it exceeds alpha with a probability of P(X <= k) at most. The largest k with
P(X <= k) <= delta / tests is taken, where tests is strata x rules (Bonferroni), and alpha is split
evenly among the rules. So with confidence 1 - delta, no stratum loses more than ``max_false_rejection``
of its good documents to all rules together. Where a holdout is too small to certify anything, the rule
rejects nothing there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, small_or_shuffled

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"

MAX_FALSE_REJECTION = 0.02
DELTA = 0.05
#: Holdout scale of the rules: ratios are whole numbers of ten-thousandths, so at most 10,001 values.
SCALE = 10_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def with_base_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and, per row, n_words, word_chars (code points in words), n_symbols, n_lines (lines with a
    word), n_dup_lines (those equal to an earlier line), n_repeat_words (words in three-word windows found
    twice or more in the text). All whole numbers; zero for null and empty texts. Columns of these names
    are replaced. One pass without a shuffle; windows are sorted by hash, those whose hashes meet by words
    and place, so equal ones are neighbours."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("__t", text).withColumn("__w", words_of(F.col("__t")))
    w = F.col("__w")
    # A window's hash and, in the lowest bits, its place in one number: sorting these finds the places whose hashes
    # meet. Only there are words compared, so a cut-off hash costs time, not truth.
    out = out.withColumn("__b", F.length(F.bin(F.size(w))))
    packed = lambda i: F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), F.col("__b")).bitwiseOR(i.cast("long"))
    out = out.withColumn("__h", F.when(F.size(w) >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), packed))))
    h = F.col("__h")
    far = lambda x, y: F.call_function("shiftright", x.bitwiseXOR(y), F.col("__b")) != 0
    pairs = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda x, y: F.when(far(x, y), F.lit(None)).otherwise(F.array(x, y)))
    # the places of windows whose hash is that of a neighbour
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__b")) - 1).cast("int")
    out = out.withColumn("__m", F.array_distinct(F.transform(F.flatten(F.array_compact(pairs)), place)))
    window = lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.cast("long").alias("i"))
    out = out.withColumn("__k", F.when(F.size("__m") > 0, F.sort_array(F.transform("__m", window))))
    k = F.col("__k")

    def same(i: Column, j: Column) -> Column:
        a, b = F.get(k, i), F.get(k, j)
        return F.coalesce((a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.lit(False))

    places = F.transform(F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: k[i]["i"])
    out = out.withColumn("__p", F.when(k.isNotNull(), F.sort_array(places)))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(F.col("__p"), start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__l", lines)
    t, long = F.col("__t"), "long"
    return out.withColumns({
        "n_words": F.size(w).cast(long),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast(long),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast(long),
        "n_lines": F.size("__l").cast(long),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast(long),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast(long),
    }).drop("__t", "__w", "__b", "__h", "__m", "__k", "__p", "__l")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.floor(F.lit(SCALE) * F.col(a) / F.nullif(F.col(b), F.lit(0))), F.lit(0)).cast("long")


#: Names of the rules, in the order in which failed ones are listed.
RULES = ["symbols", "duplicate_lines", "repeated_words", "long_words", "short_words"]


def rules() -> dict[str, Column]:
    """Values by rule: a document is the worse, the larger one is."""
    word = F.least(_ratio("word_chars", "n_words") / 100, F.lit(SCALE)).cast("long")  # hundredths of a character
    values = [F.least(_ratio("n_symbols", "word_chars"), F.lit(SCALE)), _ratio("n_dup_lines", "n_lines"), _ratio("n_repeat_words", "n_words"), word, -word]
    return dict(zip(RULES, values, strict=True))


def allowed_above(n: Column, alpha: float, log_delta: Column) -> Column:
    """The largest k with P(Binomial(n, alpha) <= k) <= exp(log_delta), or -1: the exact distribution,
    summed term by term in logarithms up to its mean (beyond it the sum is over one half)."""
    odds = math.log(alpha / (1 - alpha))
    zero = F.struct((n * math.log1p(-alpha)).alias("term"), F.lit(-math.inf).alias("sum"), F.lit(-1).cast("long").alias("k"))

    def step(a: Column, j: Column) -> Column:
        high, low = F.greatest(a["sum"], a["term"]), F.least(a["sum"], a["term"])
        total = high + F.log1p(F.exp(low - high))
        return F.struct((a["term"] + F.log((n - j) / (j + 1)) + odds).alias("term"), total.alias("sum"), F.when(total <= log_delta, j).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * alpha)), zero, step, lambda a: a["k"])


def certified_cutoffs(holdout: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """``holdout``: a row per good labelled document, with ``stratum`` and a column for each rule. Returns a
    row per stratum: stratum, n_good and, for each rule, the cutoff above which it rejects (null: never).

    Counts per value come first, so a hot stratum meets in one task only as its distinct values, of which
    a rule has some 20,001 at most."""
    names = RULES
    long = holdout.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in names])).alias("x")).select("stratum", "x.rule", "x.value")
    counts = materialize(long.groupBy("stratum", "rule", "value").agg(F.count("*").alias("n")), "holdout")
    tests = counts.select("stratum").distinct().count() * len(names)
    by = Window.partitionBy("stratum", "rule")
    above = F.coalesce(F.sum("n").over(by.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n_good"))
    sizes = sizes.withColumn("k", allowed_above(F.col("n_good"), max_false_rejection / len(names), F.lit(math.log(delta / max(1, tests)))))
    cut = counts.withColumn("above", above).join(sizes, ["stratum", "rule"])
    cut = cut.groupBy("stratum").agg(F.max("n_good").alias("n_good"), *[F.min(F.when((F.col("rule") == r) & (F.col("above") <= F.col("k")), F.col("value"))).alias(f"cut_{r}") for r in names])
    return cut


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs``: the id, the base counts, base_failed, kept, and ``failed_rules`` (names of the
    certified rules it fails). Good holdout documents are those that pass the base rules and whose labels
    all say quality 1 and not toxic (null: unknown, not a holdout). A null stratum is a stratum of its own. A null id
    is judged too, but never a holdout. Empty tables give an empty result or, without labels, the base
    verdict."""
    names = RULES
    stats = with_base_stats(docs.select(F.col(id_col).alias("__id"), F.col(stratum_col).cast("string").alias("__s"), F.col(text_col).alias("__text")), "__text").drop("__text")
    stats = stats.withColumn("stratum", F.coalesce(F.concat(F.lit("="), "__s"), F.lit(""))).withColumn("base_failed", base_failed()).withColumns(rules())
    stats = materialize(stats.drop("__s"), "stats")
    good = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).where("q = 1 and x = 0").select("__id")
    holdout = stats.where(~F.col("base_failed")).select("__id", "stratum", *names).join(good, "__id", "left_semi")
    cut = small_or_shuffled(materialize(certified_cutoffs(holdout, max_false_rejection, delta), "cutoffs"))
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in names]), lambda x: x.isNotNull())
    out = stats.join(cut, "stratum", "left").withColumn("failed_rules", failed)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "failed_rules")
