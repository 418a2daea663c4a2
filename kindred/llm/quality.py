"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every rule compares one ratio of a document with a cutoff. Cutoffs are chosen per stratum (language) on labelled
documents: walking a grid from lenient to strict, a cutoff is accepted while the exact binomial (Clopper-Pearson)
upper bound of its false rejection rate, i.e. the share of good documents that it would reject, stays within the
allowed risk; the walk stops at the first cutoff that isn't accepted (fixed-sequence testing, so the grid needs no
correction), and the error probability is divided by the number of walks (Bonferroni). A stratum with too few labels
for a rule takes the cutoff that all strata together allow, or one less strict, as far as its own labels bound the
false rejection rate by WEAK_RISK in a walk of their own; with too few for that it rejects nothing by the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import SPACE_CLASS, durable, let, words_of

WINDOW = 5
#: Allowed false rejection rate of one rule in one stratum, the one where its labels don't suffice for that and the
#: cutoff comes from all strata, and the probability that any bound is wrong.
RISK, WEAK_RISK, ERROR = 0.005, 0.02, 0.1
#: Fixed: each rule's ratio (numerator, denominator); a document fails where the ratio is over the cutoff.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "shouting": ("n_upper", "word_chars"),
    "exclamations": ("n_exclaims", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
}
#: Cutoffs tried, lenient to strict.
GRID = [round(0.9 - 0.05 * i, 2) for i in range(17)] + [0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01]


def repeated_words(words: Column) -> Column:
    """How many words lie in a WINDOW-word window that occurs twice or more among words."""
    windows = F.size(words) - F.lit(WINDOW - 1)
    codes = F.transform(words, lambda w: F.xxhash64(w))

    def window_codes(c: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(c, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(c) - F.lit(WINDOW)), at)

    def covered(starts: Column) -> Column:
        """Positions in the union of [s, s + WINDOW) over ascending starts."""
        step = lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1), s + WINDOW) - s)
        return F.aggregate(F.transform(starts, step), F.lit(0), lambda a, x: a + x)

    def from_sorted(s: Column) -> Column:
        again = lambda x, k: (x["code"] == F.get(s, k - 1)["code"]) | (x["code"] == F.get(s, k + 1)["code"])
        twice = F.filter(s, lambda x, k: F.coalesce(again(x, k), x["code"] == F.coalesce(F.get(s, k - 1), F.get(s, k + 1))["code"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["at"])), covered)

    def count(c: Column) -> Column:
        placed = F.transform(c, lambda x, i: F.struct(x.alias("code"), i.alias("at")))
        return F.when(F.size(F.array_distinct(c)) == F.size(c), 0).otherwise(let(F.sort_array(placed), from_sorted))

    return F.when(windows < 2, 0).otherwise(let(codes, lambda c: let(window_codes(c), count))).cast("long")


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """docs(doc_id, text, lang) to doc_id, lang and the counts that rules and base use; null text has no words.

    carry: with the whole row of docs as struct `row`."""
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = F.regexp_replace(text, r"[^\p{Lu}!#*$%&|<>]+", "")  # one pass over the text; what it leaves is short
    lined = lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
    )
    rows = docs.select("doc_id", "lang", let(words_of(F.col("text")), counted).alias("w"), let(lines, lined).alias("l"), marks.alias("marks"), *row)
    kept_chars = lambda cut: F.length(F.regexp_replace("marks", cut, "")).cast("long")
    base = (F.col("w.n_words") < 10) | (100 * F.col("w.n_repeat_words") > 20 * F.col("w.n_words"))
    return rows.select(
        "doc_id", "lang", "w.n_words", "w.word_chars", kept_chars(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.n").cast("long").alias("n_lines"),
        kept_chars("[^!]+").alias("n_exclaims"), kept_chars(r"\P{Lu}+").alias("n_upper"), base.alias("base_failed"),
        *["row"] * carry,
    )


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series at x + 8, carried back down."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    down = F.log(x)
    for k in range(1, 8):
        down = down + F.log(x + float(k))
    return series - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact but for rounding; 1 where k >= n p (the caller only asks whether it is small).

    Terms are summed from k downwards, over 40 standard deviations at most: what lies below is under 1e-300."""
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 40).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def lower(acc: Column, i: Column) -> Column:
        j = k - i
        term = acc["term"] * (j + 1) * (1 - p) / ((n - j) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.slice(F.sequence(F.lit(0), F.greatest(steps, F.lit(1))), F.lit(2), steps), start, lower, lambda acc: acc["sum"])
    return F.when(k >= n * p, 1.0).otherwise(F.exp(top) * total)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, weak: float = WEAK_RISK) -> DataFrame:
    """(lang, n_good, cut_<rule>...): one row per stratum with labels; a cutoff is null where none is safe.

    labels(doc_id, quality): documents labelled both ways, or null, are left out. Good documents that fail the
    base rules aren't counted, as no cutoff decides on them."""
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q_max")).where("q = q_max and q = 1")
    good = measured.where(~F.col("base_failed")).join(agreed.select("doc_id"), "doc_id", "left_semi")
    over = {f"{rule}_{i}": F.count_if(F.col(x) > c * F.col(of)) for rule, (x, of) in RULES.items() for i, c in enumerate(GRID)}
    counts = durable(good.groupBy("lang").agg(F.count("*").alias("n_good"), *[v.alias(k) for k, v in over.items()]), "quality-counts")
    every = counts.agg(F.lit(None).cast("string").alias("lang"), *[F.sum(c).alias(c) for c in counts.columns[1:]]).withColumn("pooled", F.lit(True))
    counts_all = counts.withColumn("pooled", F.lit(False)).unionByName(every.where("n_good > 0"))
    # Walks: of each stratum at both risks, and of all strata together.
    each = F.lit(float(error)) / ((2 * counts.count() + 1) * len(RULES))
    tried = [
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.col(f"{rule}_{i}").alias("k"))
        for rule in RULES
        for i in range(len(GRID))
    ]
    tried = counts_all.select("lang", "pooled", "n_good", F.explode(F.array(*tried)).alias("t")).select("lang", "pooled", "n_good", "t.*")
    stop = lambda p: F.coalesce(F.min(F.when(binomial_tail(F.col("k"), F.col("n_good"), p) > each, F.col("step"))), F.lit(len(GRID)))
    walked = durable(tried.groupBy("lang", "pooled", "n_good", "rule").agg(stop(risk).alias("strict"), stop(weak).alias("weak")), "quality-walks")
    together = walked.where("pooled").select("rule", F.col("strict").alias("pooled_strict"))
    own = walked.where("not pooled").join(F.broadcast(together), "rule")  # a row for each rule
    steps = F.when(F.col("strict") > 0, F.col("strict")).otherwise(F.least("weak", "pooled_strict"))
    cut = F.get(F.array(*[F.lit(float(c)) for c in GRID]), steps - 1)
    last = [F.max(F.when(F.col("rule") == r, cut)).alias(f"cut_{r}") for r in RULES]
    return durable(own.groupBy("lang", "n_good").agg(*last), "quality-cutoffs")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, weak: float = WEAK_RISK, carry: bool = False) -> DataFrame:
    """doc_id, lang, measures, base_failed, kept for every row of docs; carry: and the row itself as struct `row`.

    Null text counts as empty and fails the base (under 10 words). A null lang is a stratum of its own; a stratum
    without labels, like an empty labels table, applies the base rules only. Rows repeated in docs stay repeated; texts
    of any length are measured whole, and an empty table gives no rows.
    """
    measured = durable(measures(docs, carry), "quality-measures")
    cuts = cutoffs(measured, labels, risk, error, weak).withColumnRenamed("lang", "_stratum").drop("n_good")
    rows = measured.join(cuts, measured["lang"].eqNullSafe(cuts["_stratum"]), "left")
    fails = F.lit(False)
    for rule, (x, of) in RULES.items():
        fails = fails | F.coalesce(F.col(x) > F.col(f"cut_{rule}") * F.col(of), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~fails).select(*measured.columns, "kept")


def passing(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Rows and columns of docs that the rules keep. Extra columns may have any names but those of doc_id, text and lang in
    other letter case, which Spark can't tell apart unless spark.sql.caseSensitive is set."""
    return judge(docs, labels, carry=True, **how).where("kept").select("row.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdict of base rules and risk-controlled rules on every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
