"""Which spans hold a place, and what a name means there.

Lines stand in blocks of BLOCK_LINES, the leaves of a binary tree. A span is cut into the blocks that it
holds in part (two at most) and the fewest whole subtrees of the others (two a level at most), a place belongs to its
block and the subtrees around it, on the levels that any span has, and the two meet in an equal join on
(file, level, subtree). A place is so compared only with spans that hold its line or begin or end in its block, in
however large a file, and no file is one group.

Scopes: a definition is bound in the innermost scope around it, a name means the definition bound to
it in the innermost scope around the place that binds it. Of one name bound twice in a
scope, the later definition counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the tree: lines below 2**30. Lines of a block, and the level of a block held in part.
LEVELS = 31
BLOCK_LINES, PART_LEVEL = 16, -1
LAST_LINE = (1 << 30) - 1
SCOPE_KINDS = ("File", "Module", "Class", "Interface", "Function", "Method")


def subtrees(first: Column, last: Column) -> Column:
    """The largest whole subtrees that make up the lines first to last: an array of (level, tree)."""
    none = F.array().cast("array<struct<level:int,tree:bigint>>")
    start = F.struct(first.cast("long").alias("low"), (last.cast("long") + 1).alias("high"), none.alias("out"))

    def tree(level: Column, number: Column) -> Column:
        return F.array(F.struct(level.cast("int").alias("level"), number.cast("long").alias("tree")))

    def step(s: Column, level: Column) -> Column:
        odd_low, odd_high = s["low"] % 2, s["high"] % 2
        # What is left of (low, high) once an odd low and an odd high are taken as trees of their own.
        left = F.when((s["low"] < s["high"]) & (odd_low == 1), tree(level, s["low"])).otherwise(none)
        right = F.when((s["low"] + odd_low < s["high"]) & (odd_high == 1), tree(level, s["high"] - 1)).otherwise(none)
        return F.struct(F.floor((s["low"] + odd_low) / 2).alias("low"), F.floor((s["high"] - odd_high) / 2).alias("high"), F.concat(s["out"], left, right).alias("out"))

    # What is left halves from level to level.
    top = F.least(F.floor(F.log2((last.cast("long") - first.cast("long") + 1).cast("double"))).cast("int") + 1, F.lit(LEVELS - 1))
    return F.aggregate(F.sequence(F.lit(0), top), start, step)["out"]


def pieces(first: Column, last: Column) -> Column:
    """The lines first to last as blocks held in part and subtrees of whole blocks: an array of (level, tree)."""
    none = F.array().cast("array<struct<level:int,tree:bigint>>")
    low, high = F.floor(first.cast("long") / BLOCK_LINES), F.floor(last.cast("long") / BLOCK_LINES)
    part_low = (first % BLOCK_LINES != 0) | (last < low * BLOCK_LINES + BLOCK_LINES - 1)
    part_high = ((last + 1) % BLOCK_LINES != 0) & (high != low)
    part = lambda test, block: F.when(test, F.array(F.struct(F.lit(PART_LEVEL).alias("level"), block.alias("tree")))).otherwise(none)
    whole_low, whole_high = low + part_low.cast("int"), high - part_high.cast("int")
    cut = F.concat(part(part_low, low), part(part_high, high), F.when(whole_low <= whole_high, subtrees(whole_low, whole_high)).otherwise(none))
    root = F.array(F.struct(F.lit(((LAST_LINE + 1) // BLOCK_LINES).bit_length() - 1).alias("level"), F.lit(0).cast("long").alias("tree")))
    one = F.array(F.struct(F.lit(PART_LEVEL).alias("level"), low.alias("tree")))
    # A whole file, as each has one for a scope, and a part of one block, as most spans are, need no cutting.
    return F.when((first == 0) & (last == LAST_LINE), root).when((low == high) & part_low, one).otherwise(cut)


def around(line: Column, levels: Column) -> Column:
    """The block or subtree of each of the levels that a line belongs to: an array of (level, tree)."""
    block = F.floor(line.cast("long") / BLOCK_LINES)
    return F.transform(levels, lambda level: F.struct(level.alias("level"), F.when(level == PART_LEVEL, block).otherwise(F.floor(block / F.pow(F.lit(2.0), level))).alias("tree")))


def _by_subtree(rows: DataFrame, at: Column) -> DataFrame:
    return rows.withColumn("at", F.explode(at)).withColumns({"level": F.col("at.level"), "tree": F.col("at.tree")}).drop("at")


def holding(places: DataFrame, spans: DataFrame, by: tuple[str, ...] = ("file_id",), like: DataFrame | None = None) -> DataFrame:
    """Each place (file_id, line and, if it has one, col) with each span (file_id, start_line, end_line and, if places have col, start_col, end_col) that holds it, ends included.

    With by, places and spans meet only where these columns are equal. like: spans among which are those of spans, if they are found at less cost. A span that ends before it starts and, with columns, an empty one holds nothing; a null file or line is nowhere.
    """
    low, high, line = F.col("start_line"), F.col("end_line"), F.col("line")
    held, known = (x.filter((low >= 0) & (high >= low)) for x in (spans, spans if like is None else like))
    cut = _by_subtree(held, pieces(low, high))
    levels = F.broadcast(known.select(F.explode(pieces(low, high)["level"]).alias("level")).agg(F.collect_set("level").alias("levels")))  # one row, LEVELS numbers at most
    asked = _by_subtree(places.filter((line >= 0) & (line <= LAST_LINE)).join(levels), around(line, F.col("levels"))).drop("levels")
    # Sizes are estimated before rows are exploded, so that a broadcast could be many times as large as it seems.
    found = asked.hint("merge").join(cut, [*by, "level", "tree"]).drop("level", "tree").filter((line >= low) & (line <= high))
    if "col" not in places.columns:
        return found
    empty = (low == high) & (F.col("start_col") == F.col("end_col"))
    return found.filter(~empty & ((line > low) | (F.col("col") >= F.col("start_col"))) & ((line < high) | (F.col("col") <= F.col("end_col"))))


def scopes_of(nodes: DataFrame) -> DataFrame:
    """The scopes of nodes: their spans, and one of each file that holds all of it (scope_id null). Where nodes have their place in the file (local_idx), it comes with the first, so that rows stay where they are."""
    of = lambda *columns: F.struct(*(c.alias(n) for c, n in zip(columns, ("scope_id", "start_line", "start_col", "end_line", "end_col"), strict=True)))
    own = of(F.col("id"), *(F.col(c).cast("int") for c in ("start_line", "start_col", "end_line", "end_col")))
    whole = of(F.lit(None).cast("long"), F.lit(0), F.lit(0), F.lit(LAST_LINE), F.lit(0))
    scope = F.col("kind").isin(*SCOPE_KINDS)
    if "local_idx" in nodes.columns:
        found = F.filter(F.array(F.when(F.col("local_idx") == 0, whole), F.when(scope, own)), lambda s: s.isNotNull())
        return nodes.select("file_id", F.inline(found))
    return nodes.filter(scope).select("file_id", own.alias("s")).unionByName(nodes.select("file_id").distinct().select("file_id", whole.alias("s"))).select("file_id", "s.*")


def _inner() -> Column:
    """Of nested scopes, the inner one starts later or ends earlier, so it is the greatest."""
    return F.struct("start_line", "start_col", (-F.col("end_line")).alias("before_line"), (-F.col("end_col")).alias("before_col"), "scope_id")


def bindings(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each name bound in a scope: file_id, name, node_id and the scope's place. A scope does not hold its own definition."""
    defined = nodes.select("file_id", "name", F.col("id").alias("node_id"), F.col("start_line").alias("line"), F.col("start_col").alias("col"))
    inside = holding(defined, scopes).filter(F.col("scope_id").isNull() | (F.col("scope_id") != F.col("node_id")))
    inner = inside.groupBy("file_id", "name", "node_id", "line", "col").agg(F.max(_inner()).alias("s"))
    last = inner.groupBy("file_id", "name", "s").agg(F.max(F.struct("line", "col", "node_id")).alias("d"))
    return last.select("file_id", "name", "d.node_id", "s.start_line", "s.start_col", (-F.col("s.before_line")).alias("end_line"), (-F.col("s.before_col")).alias("end_col"), "s.scope_id")


def resolve_names(uses: DataFrame, nodes: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """uses (use_id, file_id, name, line, col) with node_id: what the name means there, null if nothing. nodes: id, kind, name, file_id and span. Uses and nodes that are dealt by files stay so."""
    scopes = scopes if scopes is not None else scopes_of(nodes)
    bound = bindings(nodes, scopes)
    found = holding(uses.select("use_id", "file_id", "name", "line", "col"), bound, ("file_id", "name"), like=scopes)
    meant = found.groupBy("file_id", "use_id").agg(F.max(F.struct(_inner().alias("s"), "node_id")).alias("m"))
    return uses.join(meant.select("file_id", "use_id", "m.node_id"), ["file_id", "use_id"], "left").select(*uses.columns, "node_id")
