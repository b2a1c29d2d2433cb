"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote good or bad, or abstain. Expectation-maximisation over the counts
of vote patterns estimates, for both classes, how each rule votes; a document
is kept by its posterior probability of being good instead of having to pass
every rule. Documents see expressions alone; only the counts of vote patterns, at
most 3 to the number of rules, are shuffled and then read by the driver.

Nulls: a null text has no words, fails the base rules and isn't kept. Rows
are never merged, so repeated rows stay; other columns pass through unless
they are named like a result column, which then replaces them; texts may have
any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, table, written

GOOD, BAD, ABSTAIN = 0, 1, 2
#: Frequent function words of the four corpus languages.
FUNCTION_WORDS = "the of and to in a is that for it de la le les des et que en un el los las por con der die und das ist von den mit est une qui dans se del al y ein nicht zu".split()
DRAWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound(value: Column, use) -> Column:
    """``use`` gets ``value`` as a lambda variable, so it's computed once a row."""
    return F.transform(F.array(value), use)[0]


def repeated_words(windows: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more in the row."""

    def covered(win: Column) -> Column:
        def twice(s: Column) -> Column:
            same = lambda e, i: e["h"].eqNullSafe(F.get(s, i)["h"])
            return F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["p"]))

        at = bound(F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), twice)
        steps = bound(at, lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bound(windows, covered)).cast("long")


def measures(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with the counts that the rules and the base test look at."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__w", F.filter(F.split(t, f"{WORD_SPACE}+"), lambda w: w != ""))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    windows = bound(
        F.col("__h"),
        lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width))),
        ),
    )
    df = df.withColumn("__win", windows)
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD_SPACE.replace("[", "[^")))))
    return df.select(
        "*",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__win"), width).alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("__n_capitals"),
        F.length(F.regexp_replace(t, r"[^.!?]+", "")).alias("__n_stops"),
        F.size(F.array_intersect("__h", F.array(*(F.xxhash64(F.lit(w)) for w in FUNCTION_WORDS)))).alias("__n_function"),
    ).drop("__w", "__h", "__win", "__lines")


def votes() -> dict[str, Column]:
    """The rules: 0 votes good, 1 votes bad, 2 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))

    chars = F.col("word_chars") / n
    return {
        "length": rule(n >= 30, n < 12),
        "word_length": rule((chars >= 3) & (chars <= 9), (chars > 14) | (chars < 2)),
        "symbols": rule(F.col("n_symbols") * 50 < n, F.col("n_symbols") * 12 > n),
        "lines": rule(F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 3 > F.col("__n_lines")),
        "repeats": rule(F.col("n_repeat_words") * 20 < n, F.col("n_repeat_words") * 6 > n),
        "capitals": rule(F.col("__n_capitals") * 6 < F.col("word_chars"), F.col("__n_capitals") * 2 > F.col("word_chars")),
        "sentences": rule(F.col("__n_stops") * 40 >= n, F.col("__n_stops") * 120 < n),
        "function_words": rule(F.col("__n_function") >= 3, (F.col("__n_function") == 0) & (n >= 15)),
    }


def fitted(patterns: list[tuple[tuple[int, ...], int]], rules: list[str], rounds: int = 25, tolerance: float = 1e-6) -> dict:
    """Vote probabilities by class, by EM over vote patterns and their counts.

    Start: a document is good with the share of good votes among its votes.
    """
    if not patterns:
        return {"prior": 0.5, "rules": {r: ([1 / 3] * 3, [1 / 3] * 3) for r in rules}}
    total, before = float(sum(n for _, n in patterns)), None
    good = [(votes.count(GOOD) + 2.0) / (len(votes) - votes.count(ABSTAIN) + 2.5) for votes, _ in patterns]
    for _ in range(rounds):
        g = math.fsum(n * p for (_, n), p in zip(patterns, good, strict=True))
        model = {"prior": (g + 1) / (total + 2), "rules": {}}
        for k, r in enumerate(rules):
            cast = [[(n, p) for (votes, n), p in zip(patterns, good, strict=True) if votes[k] == v] for v in range(3)]
            in_good = [(math.fsum(n * p for n, p in c) + 1) / (g + 3) for c in cast]
            in_bad = [(math.fsum(n * (1 - p) for n, p in c) + 1) / (total - g + 3) for c in cast]
            model["rules"][r] = (in_good, in_bad)
        weights = list(odds(model).values())
        start = math.log(model["prior"] / (1 - model["prior"]))
        good = [1 / (1 + math.exp(-(start + math.fsum(w[v] for w, v in zip(weights, votes, strict=True))))) for votes, _ in patterns]
        if before is not None and abs(model["prior"] - before) < tolerance:
            break
        before = model["prior"]
    return model


def odds(model: dict) -> dict[str, list[float]]:
    """What each vote of a rule says. A vote weighs at most a factor of 200 either way."""
    return {r: [max(-5.3, min(5.3, math.log(a / b))) for a, b in zip(*x, strict=True)] for r, x in model["rules"].items()}


def posterior(model: dict) -> Column:
    """P(good | votes)."""
    score = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, weight in odds(model).items():
        score = score + F.when(F.col(r) == GOOD, weight[GOOD]).when(F.col(r) == BAD, weight[BAD]).otherwise(weight[ABSTAIN])
    return 1.0 / (1.0 + F.exp(-score))


def quality(docs: DataFrame, text: str = "text", least: float = 0.5, carry: list[str] | None = None, stored: bool = True) -> DataFrame:
    """``docs`` with measures, the votes, ``p_good``, ``base_failed`` and ``kept``.

    ``carry`` names the columns of ``docs`` that the result keeps (all if not
    given). ``stored``: texts are measured once; the measured rows are written to
    the shared scratch folder, and the fit and the result read them from there.
    Otherwise they are measured for the fit and again for the result, and nothing
    is written, which is less disk where whole texts are carried.
    """
    rules = votes()
    names = [f"vote_{r}" for r in rules]
    clash = {*DRAWN, *names, "p_good", "base_failed", "kept"}
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in clash]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in clash and c != text))
    voted = measures(docs, text).select(*carry, *DRAWN, *(c.alias(f"vote_{r}") for r, c in rules.items()))
    voted = written(voted, "quality-votes") if stored else voted.select(F.inline(F.array(F.struct("*"))))  # no filter passes below it, to measure anew
    counted = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 to the number of rules
    model = fitted(sorted((tuple(r[:-1]), r.n) for r in counted), names)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.select("*", posterior(model).alias("p_good"), failed.alias("base_failed")).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, carry=["doc_id"]).select("doc_id", *DRAWN, "base_failed", "kept", "p_good")
