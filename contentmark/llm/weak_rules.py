"""Quality rules as weak supervision (DataFrame only).

Every rule votes good (1), bad (-1) or abstains (0).  A two-class latent model
with one accuracy per rule (votes independent given the class) is fitted by
expectation-maximisation on the table of vote patterns - at most
2 ** rules rows, counted over every document.  The verdict is the posterior probability of the good class.

Repeated 3-word windows are found by a digest within one text (64 bits less the
bits of the word position); where digests agree, the words are compared.

Defined cases: null text has no words and fails the base rule; repeated rows
count as often as they come; very long texts are measured whole (arrays of one
row); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentmark.llm.common import WORD, text_or_empty, words
from contentmark.session import materialize

KEEP_AT = 0.5
#: Prior of a rule's accuracy: votes it starts with, right and wrong.
PRIOR_RIGHT, PRIOR_WRONG = 9.0, 1.0
ROUNDS = 25


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add _x_n_words, _x_word_chars, _x_n_symbols, _x_n_dup_lines,
    _x_n_repeat_words (words inside 3-word windows that occur at least twice
    in the text), _x_n_upper, _x_n_shouts and _x_n_letter_words."""
    text = F.col("_x_text")
    d = docs.withColumn("_x_text", text_or_empty(F.col(text_col)))
    d = d.withColumn("_x_words", words(text))
    d = d.withColumn("_x_n_words", F.size("_x_words").cast("bigint"))
    w, n = F.col("_x_words"), F.size("_x_words")
    # a window is one long: digest above, its position in the low bits
    bits = F.length(F.bin(n))
    d = d.withColumn("_x_bits", bits)
    bits = F.col("_x_bits")

    def digest(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)
    d = d.withColumn("_x_sorted", F.sort_array(F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", digest(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), bits).bitwiseOR(i.cast("bigint"))))
        .otherwise(F.array().cast("array<bigint>"))))
    s = F.col("_x_sorted")
    again = F.filter(s, lambda x, k: (digest(x) == digest(F.get(s, k - 1)))
                     | (digest(x) == digest(F.get(s, k + 1))))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
    d = d.withColumn("_x_pos", F.sort_array(F.transform(again, lambda x: x.bitwiseAND(mask))))
    # only windows whose digest comes again are sorted by their words
    d = d.withColumn("_x_same", F.sort_array(F.transform("_x_pos", lambda x: F.struct(
        *[F.get(w, x.cast("int") + k).alias(f"w{k}") for k in range(3)], x.alias("i")))))
    same = F.col("_x_same")

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce((x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]), F.lit(False))
    d = d.withColumn("_x_pos", F.sort_array(F.transform(F.filter(same, lambda x, k: equal(
        x, F.get(same, k - 1)) | equal(x, F.get(same, k + 1))), lambda x: x["i"])))
    p = F.col("_x_pos")
    covered = F.aggregate(
        F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))),
                   lambda a, b: F.when(a.isNull(), 0).otherwise(F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    lines = F.col("_x_lines")
    d = d.withColumn("_x_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))

    def left(pattern: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return (d.withColumn("_x_n_repeat_words", covered)
            .withColumn("_x_n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"))
            .withColumn("_x_n_lines", F.size(lines).cast("bigint"))
            .withColumn("_x_word_chars", F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("bigint"))
            .withColumn("_x_n_symbols", left(r"[#*$%&|<>]+").cast("bigint"))
            .withColumn("_x_n_upper", left(r"\p{Lu}+").cast("bigint"))
            .withColumn("_x_n_shouts", left(r"!+").cast("bigint"))
            .withColumn("_x_n_letter_words", F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("bigint"))
            .drop("_x_text", "_x_words", "_x_bits", "_x_sorted", "_x_same", "_x_pos", "_x_lines"))


def base_failed() -> Column:
    return ((F.col("_x_n_words") < 50)
            | (100 * F.col("_x_n_repeat_words") > 50 * F.col("_x_n_words")))


def rules() -> dict[str, Column]:
    """Votes over ``measures``.  Most rules know one kind of bad text and
    abstain otherwise; ``prose`` votes good.  Nothing votes on an empty text."""
    n, chars = F.col("_x_n_words"), F.col("_x_word_chars")

    def bad(when: Column) -> Column:
        return F.when((n > 0) & when, -1).otherwise(0)
    return {
        "short": bad(n < 20),
        "symbols": bad(F.col("_x_n_symbols") > 0.2 * n),
        "repeated": bad(F.col("_x_n_repeat_words") > 0.5 * n),
        "dup_lines": bad(2 * F.col("_x_n_dup_lines") > F.col("_x_n_lines")),
        "word_length": bad((chars < 2 * n) | (chars > 15 * n)),
        "capitals": bad(F.col("_x_n_upper") > 0.4 * chars),
        "shouts": bad(F.col("_x_n_shouts") > 0.3 * n),
        "letters": bad(F.col("_x_n_letter_words") < 0.75 * n),
        "prose": F.when((n >= 20) & (F.col("_x_n_letter_words") >= 0.9 * n)
                        & (F.col("_x_n_symbols") <= 0.05 * n) & (F.col("_x_n_upper") <= 0.2 * chars)
                        & (F.col("_x_n_repeat_words") <= 0.2 * n) & (F.col("_x_n_shouts") <= 0.1 * n), 1)
        .otherwise(0),
    }


def fit(patterns: DataFrame, names: list[str]) -> dict[str, float]:
    """EM over (votes..., _x_count): the accuracy of every rule, i.e. the
    probability that its vote is the document's class.  The classes are
    balanced a priori; an abstention says nothing.  The patterns (at most
    2 ** rules) make one row, and all rounds are one expression over it."""
    one = patterns.agg(F.collect_list(F.struct(
        F.array(*names).alias("v"), F.col("_x_count").cast("double").alias("n"))).alias("ps"))
    ps, zero = F.col("ps"), F.lit(0.0)

    def good(p: Column, acc: Column) -> Column:
        steps = F.zip_with(p["v"], acc, lambda v, a: v * F.ln(a / (1 - a)))
        return 1 / (1 + F.exp(-F.aggregate(steps, zero, lambda s, x: s + x)))

    def round_(acc: Column, _: Column) -> Column:
        judged = F.transform(ps, lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"),
                                                    good(p, acc).alias("g")))

        def rule(j: Column) -> Column:
            right = F.aggregate(judged, zero, lambda s, p: s + p["n"] * F.when(
                F.get(p["v"], j) == 1, p["g"]).when(F.get(p["v"], j) == -1, 1 - p["g"]).otherwise(0.0))
            votes = F.aggregate(ps, zero, lambda s, p: s + F.when(F.get(p["v"], j) != 0, p["n"]).otherwise(0.0))
            return (right + PRIOR_RIGHT) / (votes + PRIOR_RIGHT + PRIOR_WRONG)
        return F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), rule)
    start = F.array(*[F.lit(PRIOR_RIGHT / (PRIOR_RIGHT + PRIOR_WRONG))] * len(names))
    row = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_).alias("a")).first()
    return dict(zip(names, row["a"]))


def posterior(accuracy: dict[str, float]) -> Column:
    """Probability of the good class given the vote columns."""
    logit = F.lit(0.0)
    for r, a in accuracy.items():
        logit = logit + F.col(r) * F.lit(math.log(a / (1 - a)))
    return 1 / (1 + F.exp(-logit))


def judge(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with the measures, _x_base_failed, _x_quality (posterior) and
    _x_kept (base rule held and posterior at least ``keep_at``)."""
    voted = measures(docs, text_col)
    named = {f"_x_v_{k}": c for k, c in rules().items()}
    voted = materialize(voted.drop(text_col).withColumns(named)
                        .withColumn("_x_base_failed", base_failed()), "votes")
    names = list(named)
    patterns = materialize(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("_x_count")).coalesce(1),
                           "vote-patterns")
    model = fit(patterns, names)
    return (voted.withColumn("_x_quality", posterior(model))
            .withColumn("_x_kept", ~F.col("_x_base_failed") & (F.col("_x_quality") >= keep_at)))
