"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose feature is above a cutoff of a fixed ladder. In
each stratum the labelled documents are split by a hash of their ids. On the search
part a path is built: from no rule on, each step takes the cutoff of one rule
further down, whichever rejects most bad documents more, with each good one
counted PRICE times, as long as that is a gain. On the holdout part the steps are
tested in that order: of n good documents all rules together reject k, and the exact
binomial tail P(Bin(n, max_risk) <= k) must be at most the level. The first step that
fails ends the path (fixed-sequence testing), and the one before is used. So no level is spent on
rules or steps; it is split over the strata only (Bonferroni), and with probability
1 - error the rules together reject at most max_risk of the good documents in each stratum.

Everything is a DataFrame expression. Features are computed once for every
whole text and cut off by checkpoint(); calibration is one grouped count of cells (of each rule the last cutoff exceeded, so at most 9**5 * 4 a stratum); the
verdict is an expression over a few literals. No text is shuffled.

Defined cases: a null text is empty (no words; base_failed); a null stratum is
a stratum of its own; strata with too few labels to certify anything, and those
without labels, use no rule; of steps with equal gains the first rule's loosest cutoff goes first; texts are read whole, however long; labels for unknown ids and null labels are
ignored; repeated ids count row by row; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LADDER = (0.5, 0.3, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02)
PRICE = 10
#: One labelled document in SEARCH is for the search; the others are the holdout.
SEARCH = 3


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words, the words that lie in a window of five words found twice or more, the first included, to rows with words.

    Windows are compared by 64-bit hashes, within one text. What a lambda looks up is a
    column of its own, so it is computed once a row.
    """
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    window = F.transform(F.sequence(F.lit(1), F.size("hashes") - 4), lambda i: F.xxhash64(*(F.element_at("hashes", i + k) for k in range(5))))
    rows = rows.withColumn("windows", F.when(F.size("hashes") >= 5, window).otherwise(none))
    rows = rows.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    order = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(F.col("repeats"), order))
    same = F.filter("ordered", lambda s, j: (s["h"] == F.get("ordered", j - 1)["h"]) | (s["h"] == F.get("ordered", j + 1)["h"]))
    at = F.array_sort(F.transform(same, lambda s: s["i"]))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(5), i - s["last"])).alias("n")))["n"]
    return rows.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(0).cast("long"))


def features(df: DataFrame, id_col: str, text_col: str, stratum: Column) -> DataFrame:
    """Base counts and the rules' features of every row, without its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col), stratum.cast("string").alias("stratum"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", WS + "+"), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = with_repeats(rows.withColumn("lines", lines))
    n = rows.select(
        id_col,
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        without(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.length("text") - without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").alias("n_lines"),
        (F.length("text") - without(F.col("text"), UPPER)).alias("n_upper"),
        (F.length("text") - without(F.col("text"), "!?")).alias("n_marks"),
        (F.length("text") - without(F.col("text"), "0123456789")).alias("n_digits"),
    )
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return n.select(
        *n.columns[:7],
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_marks") / chars).alias("mark_share"),
        (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
    )


RULES = ("symbol_share", "upper_share", "mark_share", "digit_share", "dup_line_share")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly but for rounding."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


@dataclass(frozen=True)
class Cutoff:
    """A cutoff in use. good, good_rejected, bad_rejected: the stratum's holdout, and what all its rules together reject there."""

    stratum: str | None
    rule: str
    cutoff: float
    good: int
    good_rejected: int
    bad_rejected: int


def path(cells: list[tuple[tuple[int, ...], bool, int]]) -> list[tuple[int, ...]]:
    """Settings (of each rule the number of cutoffs allowed) from none on, each with one rule further down. cells: of each rule the number of cutoffs exceeded; good; count."""
    setting, steps = (0,) * len(RULES), []
    left = cells
    while True:
        best = None
        for r in range(len(RULES)):
            for depth in range(setting[r] + 1, len(LADDER) + 1):
                gain = sum(-PRICE * n if good else n for at, good, n in left if at[r] > len(LADDER) - depth)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, r, depth
        if best is None:
            return steps
        _, r, depth = best
        setting = (*setting[:r], depth, *setting[r + 1 :])
        steps.append(setting)
        left = [c for c in left if not rejected(c[0], setting)]


def rejected(at: tuple[int, ...], setting: tuple[int, ...]) -> bool:
    """A value that exceeds a cutoff exceeds all stricter ones, so it exceeds the depth-th if it exceeds more than len(LADDER) - depth."""
    return any(x > len(LADDER) - depth for x, depth in zip(at, setting, strict=True) if depth)


def certified(steps: list[tuple[int, ...]], cells: list[tuple[tuple[int, ...], bool, int]], max_risk: float, level: float) -> tuple[int, ...] | None:
    """The last setting of the path before the first that fails on the holdout's cells."""
    good, last = sum(n for _, g, n in cells if g), None
    for setting in steps:
        lost = sum(n for at, g, n in cells if g and rejected(at, setting))
        if not good or lost > max_risk * good or binomial_tail(lost, good, max_risk) > level:
            break
        last = setting
    return last


def calibrate(found: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_risk: float = 0.02, error: float = 0.05) -> list[Cutoff]:
    """The certified cutoffs. labels: id and a label, 1 for good and 0 for bad documents."""
    known = found.filter("not base_failed").join(labels.select(id_col, F.col(label_col).cast("int").alias("__good")).filter("__good in (0, 1)"), id_col)
    exceeded = [sum((F.col(rule) > cutoff).cast("int") for cutoff in LADDER).alias(rule) for rule in RULES]
    part = (F.pmod(F.xxhash64(id_col, F.lit(4)), F.lit(SEARCH)) == 0).alias("search")
    rows = known.select("stratum", part, (F.col("__good") == 1).alias("good"), *exceeded).groupBy("stratum", "search", "good", *RULES).count().collect()
    strata: dict[str | None, tuple[list, list]] = {}
    for r in rows:
        strata.setdefault(r["stratum"], ([], []))[r["search"]].append((tuple(r[rule] for rule in RULES), r["good"], r["count"]))
    out = []
    for name, (holdout, search) in strata.items():
        setting = certified(path(sorted(search)), holdout, max_risk, error / len(strata))
        if setting:
            good = sum(n for _, g, n in holdout if g)
            lost, caught = (sum(n for at, g, n in holdout if g is side and rejected(at, setting)) for side in (True, False))
            out += [Cutoff(name, rule, LADDER[depth - 1], good, lost, caught) for rule, depth in zip(RULES, setting, strict=True) if depth]
    return out


def judge(found: DataFrame, cutoffs: list[Cutoff]) -> DataFrame:
    """found, with kept: neither base rules nor a cutoff of the row's stratum reject it."""
    out = F.lit(False)
    for c in cutoffs:
        out = out | (F.col("stratum").eqNullSafe(F.lit(c.stratum)) & (F.col(c.rule) > c.cutoff))
    return found.withColumn("kept", ~F.col("base_failed") & ~out)
