"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models over characters are trained: one of random
strings, one of ordinary identifiers. A run of identifier characters is a
secret if the sum of the log ratios of its transitions reaches a threshold.

Labelled samples come from about sample_documents (2,000) documents, chosen by
a hash of their ids. Random: what the base patterns match there, and digests of
a counter in base 64, base 32-like capitals and hexadecimal. Ordinary: the longer words
of documents without a base match, and identifiers of two to four of their words (snake,
camel, kebab and constant case, paths, with and without numbers). Half of each class
trains the models. The threshold is the lowest at which at most max_false (1 in
1,000) of the other half's ordinary identifiers are flagged, and at least the logarithm of
odds, by which ordinary identifiers outnumber random strings (10,000,000); the model
keeps that share and the share of random strings found. Both bounds hold at any
input size; the table of ratios has one entry for each pair of characters.

Everything is a DataFrame expression: matches are marked in the text with two
private-use characters, the text is split at the marks, and running lengths
give the spans in code points. No shuffle but for the training counts.

Defined cases: a null text is empty and has no spans; private-use marks in a
text count as other characters; added spans never overlap base ones; equal
rows give equal results; extra columns are ignored; texts are read whole, however long; with no ordinary sample
(empty table) the ordinary model is uniform and the threshold that of the odds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, hash_share

OPEN, CLOSE = "", ""
#: The base kinds in their order, their patterns and the fewest characters, of group 2 for the first.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 12), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16))
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIDE = len(ALPHABET) + 1
#: Shorter runs carry too few transitions to tell the classes apart.
LEAST = 16
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"


def marked(text: Column, pattern: str) -> Column:
    """The text split before each leftmost non-overlapping match, whose end is marked. text holds neither mark."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)


def scanned(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """combine() of each value and all before it, in about log n passes over the array; appending to an array copies it each time."""
    n = F.size(values)
    steps = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(done: Column, k: Column) -> Column:
        far = F.pow(F.lit(2.0), k).cast("int")
        later = F.zip_with(F.slice(done, far + 1, F.size(done)), F.slice(done, 1, F.greatest(F.size(done) - far, F.lit(0))), combine)
        return F.concat(F.slice(done, 1, far), later)

    return F.aggregate(steps, values, step)


def matches(parts: Column) -> Column:
    """Array of (start, end, match) in code points. parts: a column made by marked()."""
    spans = F.array().cast("array<struct<start:int,end:int,match:string>>")
    # The end mark of each part is no character of the text.
    starts = scanned(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda part, i: F.length(part) - F.when(i > 0, 1).otherwise(0)), lambda x, y: x + y)

    def span(part: Column, start: Column) -> Column:
        match = F.substring_index(part, CLOSE, 1)
        return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"))

    return F.when(F.size(parts) > 1, F.zip_with(F.slice(parts, 2, F.size(parts)), starts, span)).otherwise(spans)


def base_pattern(order: int) -> str:
    """Runs of the last two kinds are maximal, so a lower bound in the pattern gives the same matches as a filter."""
    kind, pattern, least = BASE[order]
    return pattern if kind == "assign" else f"{pattern[:-1]}{{{least - (4 if kind == 'access' else 0)},}}"


def kind_spans(parts: Column, order: int) -> Column:
    """Spans of a base kind as (start, order, end, kind)."""
    kind, pattern, least = BASE[order]
    found = matches(parts)
    if kind == "assign":
        found = F.filter(found, lambda m: F.length(F.regexp_extract(m["match"], pattern, 2)) >= least)
    return F.transform(found, lambda m: F.struct(m["start"], F.lit(order).alias("order"), m["end"], F.lit(kind).alias("kind")))


def codes(token: Column) -> Column:
    """Place of each character in the alphabet; 0 for others."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))


def pair_counts(tokens: DataFrame) -> dict[int, int]:
    """Counts of adjacent characters in a column token of two characters or more, as places in a table of SIDE * SIDE; at most so many rows reach the driver."""
    rows = tokens.select(codes(F.col("token")).alias("codes"))
    pairs = F.zip_with(F.slice("codes", 1, F.size("codes") - 1), F.slice("codes", 2, F.size("codes") - 1), lambda a, b: a * SIDE + b)
    return {r["pair"]: r["count"] for r in rows.select(F.explode(pairs).alias("pair")).groupBy("pair").count().collect()}


def total_ratio(token: Column, table: Column) -> Column:
    """Sum of the table's entries over all pairs of adjacent characters."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total"))

    def step(state: Column, code: Column) -> Column:
        gain = F.when(state["last"] >= 0, F.element_at(table, state["last"] * SIDE + code + 1)).otherwise(0.0)
        return F.struct(code.alias("last"), (state["total"] + gain).alias("total"))

    return F.aggregate(codes(token), start, step)["total"]


def transitions(counts: dict[int, int], smoothing: float) -> list[list[float]]:
    """P(next | this) for all pairs, smoothed towards the shares of all next characters, so that characters seldom seen stay unlikely after any other."""
    table = [[counts.get(a * SIDE + b, 0) for b in range(SIDE)] for a in range(SIDE)]
    shares = [sum(row[b] for row in table) + smoothing for b in range(SIDE)]
    extra = [SIDE * smoothing * x / sum(shares) for x in shares]
    return [[(n + x) / (sum(row) + sum(extra)) for n, x in zip(row, extra, strict=True)] for row in table]


def log_ratios(random: dict[int, int], ordinary: dict[int, int], smoothing: float = 0.5) -> list[float]:
    """log P(next | this) under the random model minus that under the ordinary one, for all pairs."""
    pairs = zip(transitions(random, smoothing), transitions(ordinary, smoothing), strict=True)
    return [math.log(x) - math.log(y) for rows in pairs for x, y in zip(*rows, strict=True)]


@dataclass(frozen=True)
class SecretModel:
    """ratios of all pairs of characters, threshold of their sum; on the held-out half, shares of ordinary identifiers flagged and of random strings found."""

    ratios: list[float]
    threshold: float
    false_share: float
    found_share: float


def digests(df: DataFrame, n: int = 2000) -> DataFrame:
    """Labelled samples of the random class, from digests of a counter."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    shapes = F.array(base64, F.translate(base64, "+/", "_-"), F.upper(base64), digest, F.substring(base64, 1, 24), F.substring(base64, 8, LEAST))
    return df.sparkSession.range(0, n, 1, 4).select(F.explode(shapes).alias("token"))


def identifiers(words: Column) -> Column:
    """Ordinary identifiers of neighbouring words, in the styles of names, paths and constants."""
    def named(i: Column) -> Column:
        w = [F.lower(F.element_at(words, i + k)) for k in range(4)]
        c = [F.initcap(x) for x in w]
        n = F.pmod(F.xxhash64(w[0], i), F.lit(300)).cast("string")
        styles = (
            F.concat_ws("_", w[0], w[1], w[2]), F.concat(w[0], c[1], c[2]), F.concat_ws("-", w[0], w[1], w[2]), F.concat_ws("/", w[0], w[1], F.concat_ws("_", w[2], w[3])), F.upper(F.concat_ws("_", w[0], w[1], w[2])), F.concat(c[0], c[1], c[2]),
            F.concat_ws("_", w[0], w[1], n), F.concat(w[0], c[1], n), F.concat_ws("/", w[0], F.concat_ws("-", w[1], w[2], n)), F.concat(c[0], c[1], c[2], c[3]), F.concat_ws("/", w[0], F.concat(w[1], c[2])), F.concat_ws("_", w[0], w[1], w[2], w[3]),
        )
        return F.element_at(F.array(*styles), (F.pmod(F.xxhash64(w[0], w[1]), F.lit(len(styles))) + 1).cast("int"))

    return F.when(F.size(words) >= 4, F.transform(F.sequence(F.lit(1), F.size(words) - 3, F.lit(2)), named)).otherwise(F.array().cast("array<string>"))


def labelled_samples(df: DataFrame, id_col: str, text_col: str, sample_documents: int) -> DataFrame:
    """token, random (its label), train (which half it is in)."""
    share = min(1.0, sample_documents / max(1, df.count()))
    texts = df.filter(hash_share(F.col(id_col), 6) < share).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = [F.expr(f"regexp_extract_all(text, {_sql(p)}, {g})") for p, g in ((ASSIGN, 2), (base_pattern(1), 0), (base_pattern(2), 0))]
    # What a lambda looks up is a column of its own, so it is computed once a row.
    found = texts.withColumn("base", F.concat(*base)).withColumn("flagged", F.exists("base", lambda t: F.length(t) >= 12))
    found = checkpoint(found.withColumn("words", F.regexp_extract_all("text", F.lit("[A-Za-z]{2,12}"), F.lit(0))))
    clean = found.filter("not flagged").select(F.concat(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{6,}"), F.lit(0)), identifiers(F.col("words"))).alias("tokens"))
    random = found.select(F.explode("base").alias("token")).filter(F.length("token") >= LEAST).union(digests(df))
    both = random.withColumn("random", F.lit(True)).union(clean.select(F.explode("tokens").alias("token")).withColumn("random", F.lit(False)))
    return both.distinct().withColumn("train", F.pmod(F.xxhash64("token", F.lit(8)), F.lit(2)) == 0)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(ratios: list[float]) -> Column:
    return F.expr("array(" + ",".join(f"{x!r}D" for x in ratios) + ")")


def learn(df: DataFrame, id_col: str, text_col: str, sample_documents: int = 2000, max_false: float = 0.001, odds: float = 1e7) -> SecretModel:
    samples = checkpoint(labelled_samples(df, id_col, text_col, sample_documents))
    counts = [pair_counts(samples.filter(F.col("train") & (F.col("random") == side)).select("token")) for side in (True, False)]
    ratios = log_ratios(*counts)
    held = samples.filter(~F.col("train") & (F.length("token") >= LEAST)).select("random", total_ratio(F.col("token"), literal_table(ratios)).alias("ratio"))
    # percentile_disc gives a value of the sample; what is above it is at most max_false of all.
    top = held.filter("not random").agg(F.expr(f"percentile_disc({1 - max_false}) WITHIN GROUP (ORDER BY ratio)").alias("top")).first()["top"]
    threshold = max(math.log(odds), math.nextafter(top, math.inf)) if top is not None else math.log(odds)
    shares = {r["random"]: r["share"] for r in held.groupBy("random").agg(F.avg((F.col("ratio") >= threshold).cast("double")).alias("share")).collect()}
    return SecretModel(ratios, threshold, shares.get(False, 0.0), shares.get(True, 0.0))


def apart(runs: Column, base: Column) -> Column:
    """The runs that overlap no base span. Both are put in order of their starts: a run is apart if no span before it ends, and none after it starts, within it."""
    def event(s: Column, run: int, match: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(run).alias("run"), s["end"].alias("end"), match.alias("match"))

    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s, 0, F.lit(""))), F.transform(runs, lambda r: event(r, 1, r["match"]))))
    before = scanned(F.transform(events, lambda e: F.when(e["run"] == 0, e["end"]).otherwise(-1)), lambda x, y: F.greatest(x, y))
    after = F.reverse(scanned(F.reverse(F.transform(events, lambda e: F.when(e["run"] == 0, e["start"]).otherwise(1 << 30))), lambda x, y: F.least(x, y)))
    judged = F.zip_with(events, F.zip_with(before, after, lambda x, y: F.struct(x.alias("end"), y.alias("start"))), lambda e, near: F.struct(e.alias("run"), near.alias("near")))
    alone = F.filter(judged, lambda j: (j["run"]["run"] == 1) & (j["near"]["end"] <= j["run"]["start"]) & (j["near"]["start"] >= j["run"]["end"]))
    return F.when((F.size(runs) > 0) & (F.size(base) > 0), F.transform(alone, lambda j: F.struct(j["run"]["start"].alias("start"), j["run"]["end"].alias("end"), j["run"]["match"].alias("match")))).otherwise(runs)


def scan(df: DataFrame, model: SecretModel, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """The id, keep's columns, base (spans of the base kinds) and spans (all), both arrays of (start, order, end, kind) in order."""
    safe = F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, "��")
    table = literal_table(model.ratios)
    rows = df.select(F.col(id_col), *keep, safe.alias("__safe"))
    patterns = [*(base_pattern(i) for i in range(len(BASE))), CANDIDATE]
    rows = rows.withColumns({f"__parts{i}": marked(F.col("__safe"), p) for i, p in enumerate(patterns)})
    base = F.array_sort(F.concat(*(kind_spans(F.col(f"__parts{i}"), i) for i in range(len(BASE)))))
    rows = rows.withColumns({"base": base, "__runs": matches(F.col(f"__parts{len(BASE)}"))})

    def secret(run: Column) -> Column:
        return total_ratio(run["match"], table) >= model.threshold

    added = F.transform(F.filter(apart(F.col("__runs"), F.col("base")), secret), lambda r: F.struct(r["start"], F.lit(len(BASE)).alias("order"), r["end"], F.lit("random").alias("kind")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", added))).drop("__safe", "__runs", *(f"__parts{i}" for i in range(len(patterns))))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span (in order of their starts) replaced by the mark; overlapping spans become one. Pieces are cut from four bytes a code point, so that their places are found at once."""
    reach = scanned(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    # What was reached before each span, and after the last.
    ends = F.concat(F.array(F.lit(0)), reach)

    def joined(wide: Column) -> Column:
        def piece(low: Column, high: Column) -> Column:
            return F.decode(F.substr(wide, 4 * low + 1, 4 * F.greatest(high - low, F.lit(0))), "UTF-32")

        pieces = F.zip_with(F.slice(ends, 1, F.size(spans)), spans, lambda low, s: F.when(s["start"] >= low, F.concat(piece(low, s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), piece(F.element_at(ends, -1), F.length(text)))

    # A lambda's own variable is computed once, what it takes from outside for each element.
    return F.when(F.size(spans) > 0, F.transform(F.array(F.encode(text, "UTF-32")), joined)[0]).otherwise(text)
