"""Audit of how filters interact: what each removes in every order, from the edges of the lattice of subsets.

A document matters to an order of filters only through the set of filters it
fails. What a filter removes after others depends on which were applied, not on
their order, so the 5! * 5 = 600 steps of all orders are paths over the 5 * 2**4 = 80
edges (already applied subset, next filter) of the subset lattice. Documents are
counted by part, failed set and labels first (at most 32 * 4 rows a part), these rows
contribute to the 80 edges, and only the aggregated edges are joined with the
steps.

The filters: A: fewer than MIN_WORDS words; B: fewer than MIN_DISTINCT percent
of the words are distinct; C: more than MAX_CAPITALS percent of the code points are
A to Z; D: holds one of SYMBOLS; E: equal to the text of a smaller id.

Scale. A to D are expressions of one row. For E the rows are counted by (text
digest, part, labels, id) and then by digest and part before the
smallest id of a digest is looked for, so a text that a third of all rows share
is combined before each shuffle. Texts are told apart by SHA-256. Of texts with as many parts as rows, a skewed join is left to adaptive execution. Only digests
and counts are shuffled, never texts.

Defined cases: a null text is empty, a null part the empty string; an empty text has
no words, so it fails A and none of B, C, D; a null id is neither smaller nor
greater than another, so it never fails E and makes none fail; rows that repeat an
id with the same text are not copies of each other; a label set twice counts if either row
has it, labels of a null id or without a document say nothing; an empty table gives an empty
result; extra columns are ignored; texts are read whole, however long.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint

FILTERS = "ABCDE"
SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed_sets(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, good_col: str, toxic_col: str) -> DataFrame:
    """part, mask (bit i: fails FILTERS[i]), good, toxic and n, the documents that have them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.split(F.btrim(text, F.lit(SPACE)), f"[{SPACE}]+").alias("words"))
    some = F.element_at("words", 1) != ""  # a trimmed text without a word gives one empty string
    n_words, n_distinct = (F.when(some, F.size(w)).otherwise(0).cast("long") for w in ("words", F.array_distinct("words")))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), n_words.alias("words"), n_distinct.alias("distinct"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("capitals"), F.length("text").cast("long").alias("points"), F.col("text").rlike(SYMBOLS).alias("symbols"))
    bits = (F.col("words") < MIN_WORDS, 100 * F.col("distinct") < MIN_DISTINCT * F.col("words"), 100 * F.col("capitals") > MAX_CAPITALS * F.col("points"), F.col("symbols"))
    own = sum((F.when(bit, 1 << i).otherwise(0) for i, bit in enumerate(bits)), F.lit(0)).cast("int")
    counted = rows.groupBy("id", "part", "digest", own.alias("own")).agg(F.count("*").alias("n"))
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in ((good_col, "good"), (toxic_col, "toxic"))))
    known = counted.join(said, "id", "left").fillna(False, ["good", "toxic"])
    # Of each (digest, part, labels): all rows, those without an id, and the smallest id with its rows.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    held = checkpoint(known.groupBy("digest", "own", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), least))
    held = held.join(held.groupBy("digest").agg(F.min("least.id").alias("first")), "digest")
    passing = F.col("n_null") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("own").alias("mask"), passing.alias("n")), F.struct((F.col("own") + (1 << len(bits))).alias("mask"), (F.col("n") - passing).alias("n")))
    return held.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.*").filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges() -> Column:
    """An array of the 80 edges: applied (bits), next (place in FILTERS) and bit (its bit)."""
    n = len(FILTERS)
    return F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(1 << f).alias("bit")) for s in range(1 << n) for f in range(n) if not s >> f & 1))


def paths(spark: SparkSession) -> DataFrame:
    """filter_order, step, applied and next of the 600 steps."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        applied = 0
        for step, f in enumerate(order):
            rows.append(("".join(FILTERS[i] for i in order), step + 1, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def edge_counts(sets: DataFrame) -> DataFrame:
    """COUNTS of each part and edge, zeros included. sets: made by failed_sets()."""
    rows = sets.select("*", F.explode(lattice_edges()).alias("edge")).select("*", "edge.*").drop("edge")
    own = F.col("bit")
    fails, earlier = F.col("mask").bitwiseAND(own) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    return rows.groupBy("part", "applied", "next").agg(
        total(~earlier & ~fails, "kept"), total(~earlier & fails, "removed"), total(earlier & fails, "redundant"), total(F.col("mask") == own, "unique_fails"),
        total(~earlier & fails & F.col("good"), "good_lost"), total(~earlier & fails & F.col("toxic"), "toxic_lost"),
    )


def audit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, good_col: str, toxic_col: str) -> DataFrame:
    """One row for each part, order and step: COUNTS of the step, and shapley, its filter's removals over all orders."""
    edges = edge_counts(failed_sets(df, labels, id_col, text_col, part_col, good_col, toxic_col))
    # An edge lies on |applied|! * (rest)! paths.
    n = len(FILTERS)
    on_paths = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), (F.bit_count("applied") + 1).cast("int"))
    worth = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * on_paths).alias("shapley"))
    steps = edges.join(F.broadcast(paths(df.sparkSession)), ["applied", "next"])  # fixed 600 rows
    return steps.join(worth, ["part", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")
