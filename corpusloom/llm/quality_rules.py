"""Quality rules as a short-circuit cascade of built-in column expressions.

Every rule is a boolean column that is true where a text is to be rejected. The
cascade measures each rule's own seconds and rejections on a bounded sample, orders the rules by rejections per
second and evaluates them as one chained ``CASE``: a text pays only for the rules
up to the first that rejects it. Base figures that a query returns are made for every text; what only a
rule needs (distinct words, bars, shouts) is part of that rule. The verdict does not depend on the order.

Defined results: a null text counts as empty (no words, so the base rule rejects
it); a row with a null id is scored like any other; repeated rows are each scored;
extra columns are ignored by ``base_metrics`` and kept by ``cascade``; an empty
table gives an empty result. Texts are never cut.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: white space, and the symbols that are counted.
WHITE = " \t\n\u000b\f\r"
SYMBOLS = "[#*$%&|<>]"

#: Rows on which cost and selectivity are estimated, at most about so many.
SAMPLE_ROWS = 2000
#: How often a job meets each row of the sample, how often a job is timed, and seconds a row below which costs count as equal.
REPEATS, TIMES, LEAST_COST = 16, 3, 1e-8


def words_of(text: Column) -> Column:
    """Words of a text; leading or trailing white space makes no empty word."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def hashes_of(words: Column) -> Column:
    """The hash of each three-word window of a column of words.

    ``words`` must be a plain column: an expression would be evaluated once per window.
    """
    n = F.size(words)
    return F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )).otherwise(F.array().cast("array<bigint>"))


def windows_of(hashes: Column) -> Column:
    """The windows of the column ``hashes_of`` made with their positions, by hash; none where no two are equal, so that most texts sort nothing."""
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(
        hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")),
    ))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def repeated_positions(ordered: Column) -> Column:
    """Positions of the windows that occur twice or more, from the column ``windows_of`` made.

    Equal windows are neighbours there: n log n for any text, no map or nested scan.
    """
    return F.sort_array(F.transform(F.filter(
        ordered,
        lambda x, k: F.coalesce((F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]), F.lit(False)),
    ), lambda x: x["i"]))


def covered_words(positions: Column) -> Column:
    """How many words the three-word windows at a column of sorted positions cover together."""
    return F.aggregate(
        F.transform(positions, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(positions, k + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, x: a + x,
    )


def base_metrics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the words and lines arrays and the base figures of every text."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.select(*keep, t.alias("__text"), words_of(F.col(text)).alias("__words"), lines_of(F.col(text)).alias("__lines"))
    out = out.withColumn("__hashes", hashes_of(F.col("__words")))
    out = out.withColumn("__windows", windows_of(F.col("__hashes")))
    out = out.withColumn("__again", repeated_positions(F.col("__windows")))
    return out.select(
        *keep, "__text", "__words", "__lines",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered_words(F.col("__again")).cast("long").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """A named boolean expression over the columns of ``base_metrics``; true rejects."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    """What a sample shows of a rule: seconds a row without the job's own, how far repeats of that differ, and what it rejects."""

    name: str
    cost_s: float
    spread_s: float
    rejected: int
    seen: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost_s, LEAST_COST)


def default_rules() -> list[Rule]:
    """The verdict's rules beyond the base; each threshold is far from ordinary prose."""
    w, n = F.col("__words"), F.col("n_words")
    return [
        Rule("mean_word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("symbol_share", 10 * F.col("n_symbols") > 3 * n),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.size("__lines")),
        Rule("bar_words", 5 * F.size(F.array_remove(w, "|")) < 4 * n),
        Rule("few_distinct_words", 20 * F.size(F.array_distinct(w)) < n),
        Rule("shouting", 5 * F.regexp_count("__text", F.lit("!!(?=[\\x20\\x09-\\x0D]|$)")) > n),
    ]


def estimate(metrics: DataFrame, rules: list[Rule], repeats: int = REPEATS, times: int = TIMES) -> list[Estimate]:
    """Time every rule over the rows of ``metrics``, a bounded sample held in memory; selectivity comes with it.

    Each row is met ``repeats`` times in one job, so that a rule's work stands out. The same job with a rule that
    is a plain column is subtracted, and the least of ``times`` runs counts. Only counts reach the driver.
    """
    sample = metrics.persist()
    try:
        seen = sample.count()
        work = sample.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

        def seconds(rejects: Column) -> tuple[float, float]:
            took = []
            for _ in range(times):
                began = time.perf_counter()
                work.agg(F.count_if(rejects)).collect()
                took.append(time.perf_counter() - began)
            return min(took), sorted(took)[len(took) // 2] - min(took)

        seconds(F.col("repeat") < 0)  # compiles code
        start, _ = seconds(F.col("repeat") < 0)
        rejected = sample.agg(*(F.count_if(r.rejects).alias(f"r{k}") for k, r in enumerate(rules))).first()
        found = []
        for k, rule in enumerate(rules):
            took, spread = seconds(rule.rejects)
            rows = max(seen * repeats, 1)
            found.append(Estimate(rule.name, max(took - start, 0.0) / rows, spread / rows, rejected[k], seen))
        return found
    finally:
        sample.unpersist()


def order(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """Rules by rejections per second, the most first; the cheaper first where none rejects."""
    by = {e.name: e for e in estimates}
    return sorted(rules, key=lambda r: (-by[r.name].worth, by[r.name].cost_s, r.name))


def first_rejection(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null where none does; later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects, F.lit(rule.name)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``keep``, the base figures, ``base_failed``, ``kept`` and ``rejected_by`` for every row.

    The base rule is ranked with the others. ``rejected_by`` names the first rule of the cascade that rejects
    (``base`` for the base rule) and may change with measured costs; ``kept`` does not.
    """
    rules = [Rule("base", base_failed()), *(default_rules() if rules is None else rules)]
    total = df.count()
    sampled = df if total <= sample_rows else df.sample(sample_rows / total, 7)
    ranked = order(rules, estimate(base_metrics(sampled, text, keep), rules))
    out = base_metrics(df, text, keep).withColumn("rejected_by", first_rejection(ranked))
    return out.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")
