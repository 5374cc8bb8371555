"""Quality by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at one property of a text and votes good (1), bad (0) or abstains
(null). Nothing is labelled: expectation-maximisation over the table of vote
patterns estimates, for each rule, how often it votes good on good texts and bad on
bad ones, and the share of good texts. The verdict is the posterior probability of
"good" given all votes, in place of "every rule must pass". All work is DataFrame
expressions; the pattern table has at most 3^rules rows, whatever the corpus.

Defined cases: a null text is an empty one; empty and very short texts fail the base
rule, whatever the posterior; repeated rows get equal verdicts; an empty table gives
no rows and leaves the starting accuracies; further columns are passed through, and
the operator's own columns replace columns of the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import count_words, saved, text_of, words_of

#: Words of a window; a text repeats itself where a window comes twice.
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Words of one or two marks that are neither letters nor digits nor quotes or dashes.
BARE = r"^[!-&(-,./:-@\[-`{-~]+$"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["capitals", "exclamation", "symbols", "bare_marks", "marked_text", "echo", "repeats", "lines", "variety", "word_length"]
#: Where EM starts: rules seldom blame good texts and see one kind of bad text each.
START_GOOD, START_BAD, START_SHARE = 0.98, 0.3, 0.85
LEAST_GOOD, LEAST_BAD = 0.99, 0.03
ITERATIONS = 30


def add_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the counts that only the rules read.

    Words and windows are compared by 64-bit hashes; a window's hash is made from
    those of its halves. Only texts that have an equal pair of hashes sort them to
    find the positions, so most texts pay one hash set.
    """
    t, w, g, h, s = text_of(text), F.col("_w"), F.col("_g"), F.col("_h"), F.col("_s")
    paired = lambda c, k: F.transform(F.col(c), lambda x, i: F.xxhash64(x, F.get(F.col(c), i + k)))
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    twins = F.filter(s, lambda e, i: (e.h == F.get(s, i - 1).h) | (e.h == F.get(s, i + 1).h))
    starts = F.sort_array(F.transform(twins, lambda e: e.p))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a.n + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        lambda a: a.n,
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("_w", words_of(t))
        .withColumn("_g", F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn("_h2", paired("_g", 1))
        .withColumn("_h4", paired("_h2", 2))
        .withColumn("_h8", paired("_h4", 4))
        .withColumn("_h", F.slice("_h8", F.lit(1), F.greatest(F.size(g) - (WINDOW - 1), F.lit(0))))
        .withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
        .withColumn("_l", lines)
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_lines", F.size("_l").cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_repeat_words", F.when(s.isNull(), F.lit(0).cast("long")).otherwise(covered))
        .withColumn("n_capitals", F.regexp_count(t, F.lit("[A-Z]")).cast("long"))
        .withColumn("n_exclaims", F.regexp_count(t, F.lit("!")).cast("long"))
        .withColumn("n_bare", F.size(F.filter(w, lambda x: (F.octet_length(x) <= 2) & x.rlike(BARE))).cast("long"))
        .withColumn("n_distinct", F.size(F.array_distinct(g)).cast("long"))
        .withColumn("n_echoes", F.size(F.filter(g, lambda x, i: x == F.get(g, i - 1))).cast("long"))
        .drop("_w", "_g", "_h2", "_h4", "_h8", "_h", "_s", "_l")
    )


HELPERS = ["n_lines", "n_capitals", "n_exclaims", "n_bare", "n_distinct", "n_echoes"]


def _vote(value: Column, good_to: float, bad_from: float) -> Column:
    """Good up to one bound, bad from another, no vote between them."""
    return F.when(value <= good_to, 1).when(value >= bad_from, 0)


def votes() -> dict[str, Column]:
    """One vote per rule, from the columns of ``add_features``. No words, no vote."""
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    share = lambda c: F.col(c) / n
    letters = F.col("word_chars") / n
    return {
        "capitals": _vote(F.col("n_capitals") / F.when(F.col("word_chars") > 0, F.col("word_chars")), 0.15, 0.5),
        "exclamation": _vote(share("n_exclaims"), 0.05, 0.4),
        "symbols": _vote(share("n_symbols"), 0.05, 0.3),
        "bare_marks": _vote(share("n_bare"), 0.05, 0.3),
        "marked_text": _vote(
            (F.col("n_symbols") + F.col("n_exclaims")) / F.when(F.col("word_chars") > 0, F.col("word_chars")), 0.01, 0.06
        ),
        "echo": _vote(share("n_echoes"), 0.05, 0.25),
        "repeats": _vote(share("n_repeat_words"), 0.1, 0.3),
        "lines": F.when(
            F.col("n_lines") >= 4, _vote(F.col("n_dup_lines") / F.col("n_lines"), 0.1, 0.5)
        ),
        "variety": F.when(n >= 50, _vote(-F.col("n_distinct") / F.sqrt(n), -4.0, -1.5)),
        "word_length": _vote(F.abs(letters - 6.0), 3.0, 6.0),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _logit(rules: list[str], model: dict) -> Column:
    total = F.lit(math.log(model["share"] / (1 - model["share"])))
    for r in rules:
        good, bad = model["good"][r], model["bad"][r]
        total = total + F.when(F.col(r) == 1, math.log(good / (1 - bad))).when(
            F.col(r) == 0, math.log((1 - good) / bad)
        ).otherwise(0.0)
    return total


def posterior(rules: list[str], model: dict) -> Column:
    """Probability that a text is good, from the vote columns named like the rules."""
    return F.lit(1.0) / (1 + F.exp(-_logit(rules, model)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _step(patterns: Column, state: Column, rules: int) -> Column:
    """One iteration of EM over the array of (votes v, texts n)."""

    def odds(v: Column) -> Column:
        each = F.transform(
            v,
            lambda x, j: F.when(x == 1, F.log(state.good[j] / (1 - state.bad[j])))
            .when(x == 0, F.log((1 - state.good[j]) / state.bad[j]))
            .otherwise(0.0),
        )
        start = F.log(state.share / (1 - state.share))
        return F.aggregate(each, start, lambda a, x: a + x)

    split = F.transform(
        patterns,
        lambda p: _let(
            p.n / (1 + F.exp(-odds(p.v))), lambda g: F.struct(p.v.alias("v"), g.alias("g"), (p.n - g).alias("b"))
        ),
    )

    def total(all_: Column, of) -> Column:
        return F.aggregate(all_, F.lit(0.0), lambda a, p: a + of(p))

    def ratio(part: Column, whole: Column, least: float) -> Column:
        return F.least(F.greatest((part + 1) / (whole + 2), F.lit(least)), F.lit(1 - 1e-6))

    def estimate(all_: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(rules - 1))
        cast = lambda p, j, side: F.when(p.v[j].isNotNull(), p[side]).otherwise(0.0)
        hit = lambda p, j, side, x: F.when(p.v[j] == x, p[side]).otherwise(0.0)
        good, bad = total(all_, lambda p: p.g), total(all_, lambda p: p.b)
        return F.struct(
            F.least(F.greatest((good + 1) / (good + bad + 2), F.lit(0.02)), F.lit(0.999)).alias("share"),
            F.transform(
                places,
                lambda j: ratio(total(all_, lambda p: hit(p, j, "g", 1)), total(all_, lambda p: cast(p, j, "g")), LEAST_GOOD),
            ).alias("good"),
            F.transform(
                places,
                lambda j: ratio(total(all_, lambda p: hit(p, j, "b", 0)), total(all_, lambda p: cast(p, j, "b")), LEAST_BAD),
            ).alias("bad"),
        )

    return _let(split, estimate)


def fit(voted: DataFrame, rules: list[str]) -> dict:
    """EM over vote patterns: accuracies on good and bad texts, and the share of good ones.

    One pass counts the patterns, combined in each task before the shuffle. The
    iterations are one expression over the array of patterns, which has at most
    3^rules entries. One pseudo-text per outcome keeps every probability inside
    (0, 1). The least accuracies say what rules are made for: each blames one kind of
    bad text and hardly ever a good one; so kinds that no other rule sees stay in the
    bad class, and the classes cannot change places.
    """
    counted = voted.groupBy(*rules).agg(F.count("*").cast("double").alias("n"))
    entry = F.struct(F.array(*rules).alias("v"), F.col("n"))
    start = F.struct(
        F.lit(START_SHARE).alias("share"),
        F.array_repeat(F.lit(START_GOOD), len(rules)).alias("good"),
        F.array_repeat(F.lit(START_BAD), len(rules)).alias("bad"),
    )
    model = (
        counted.agg(F.array_sort(F.collect_list(entry)).alias("p"))
        .select(
            F.aggregate(
                F.sequence(F.lit(1), F.lit(ITERATIONS)), start, lambda s, _: _step(F.col("p"), s, len(rules))
            ).alias("m")
        )
        .first()["m"]
    )
    by_rule = lambda values: dict(zip(rules, values))
    return {"share": model["share"], "good": by_rule(model["good"]), "bad": by_rule(model["bad"])}


def judge(featured: DataFrame, model: dict) -> DataFrame:
    """``featured`` with ``posterior``, ``base_failed`` and ``kept``."""
    given = {f"_vote_{r}": v.cast("int") for r, v in votes().items()}
    names = list(given)
    own = {"share": model["share"]} | {k: {f"_vote_{r}": x for r, x in model[k].items()} for k in ("good", "bad")}
    return (
        featured.withColumns(given)
        .withColumn("posterior", posterior(names, own))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
        .drop(*names)
    )


def fit_features(featured: DataFrame) -> dict:
    return fit(featured.select(*[v.cast("int").alias(r) for r, v in votes().items()]), RULES)


def quality_table(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Verdict per row of ``docs`` without its text: keys, counts, posterior, verdicts.

    The counts are written once, as a narrow table; fitting and judging read it.
    """
    narrow = add_features(docs.select(*keys, text), text).select(*keys, *FEATURES, *HELPERS)
    featured = saved(narrow, "quality")
    return judge(featured, fit_features(featured))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only and without a shuffle.

    Rows are written with their counts, once: a join of verdicts back to the rows would
    shuffle every text and need a key without repeats, and a filter on counts that are
    not written would be pushed below them, holding each count in full many times.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    wide = docs.select(own, F.col(f"`{text}`").alias("_text"))
    featured = saved(add_features(wide, "_text").select("_row", *FEATURES, *HELPERS), "quality")
    return judge(featured, fit_features(featured)).where("kept").select("_row.*")


__all__ = ["add_features", "count_words", "fit", "judge", "keep_good", "quality_table"]
