"""Lexical search, suffix dedup and the filter audit against brute-force versions."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from graphloom.llm import common, filter_audit, lexical, suffix_dedup
from test_contracts import AWKWARD, PROSE, SMALL, WORD, awkward, empty, result, rows_of, write  # noqa: F401 (fixtures)

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def items_at(folder, items):
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string()), "doc_id": pa.array(["clash"] * len(items), pa.string()), "score": pa.array([1.5] * len(items))}), f"{folder}/benchmark.parquet")


# 11


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))


def brute_search(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    big_n, big_l = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            n, score = sum(bag.values()), 0
            for t in {*terms(text)} & bag.keys():
                w, m = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))), 10 + (90 * n * big_n) // big_l
                score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, PROSE), (2, "THE harbour, the Harbour!"), (3, None), (4, "..."), (5, "nothing-of this kindofword"), (6, "日本語 x é"), (7, "a b c one two three four five"), (7, "storm hills"), (None, "night again"), (8, "x" * 70_000)]


def searched(spark, folder):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in result(spark, "op11_lexical_search", folder)), key=repr)


def test_lexical_search_of_awkward_rows(spark, awkward):  # noqa: F811
    items_at(awkward, ITEMS)
    expected = brute_search([(r["doc_id"], r["text"]) for r in rows_of(awkward)], ITEMS)
    assert searched(spark, awkward) == expected and len(expected) > 20


def test_lexical_search_of_the_small_tables(spark):
    items = [(r["item_id"], r["text"]) for r in rows_of(SMALL, "benchmark")]
    assert searched(spark, SMALL) == brute_search([(r["doc_id"], r["text"]) for r in rows_of(SMALL)], items)


def test_lexical_search_in_waves_segments_and_ties(spark, tmp_path, monkeypatch):
    """Many waves and small segments give the same; of more than ten equal documents the smallest ids stand."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(1000 - i, " ".join(draw.choices(words, range(60, 0, -1), k=draw.randrange(0, 40)))) for i in range(150)] + [(i, "w1 w2 w3 copy") for i in range(2000, 2030)] + [(None, "w1 w2 w3 copy")]
    items = [(i, " ".join(draw.sample(words, 6))) for i in range(6)] + [(9, "w2 copy")]
    folder = write(tmp_path, [(i, t, "en") for i, t in docs])
    items_at(folder, items)
    monkeypatch.setattr(lexical, "MOST_TERMS", 12)
    monkeypatch.setattr(lexical, "SEGMENT_TERMS", 100)
    monkeypatch.setattr(lexical, "CHUNK", 500)
    expected = brute_search(docs, items)
    assert searched(spark, folder) == expected
    assert [d for i, _, d, _ in sorted(expected, key=lambda r: r[1]) if i == 9] == list(range(2000, 2010))


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    table = lexical.TermTable(["abc", "abd", "zz"])
    table.hashes[:] = 7
    data = lexical.LOWER[lexical.np.frombuffer(b"abd abcd ABC zz", lexical.np.uint8)]
    starts = lexical.np.array([0, 4, 9, 13])
    places, found = table.find(data, lexical.np.array([0, 15]), lexical.np.full(4, 7, lexical.np.uint64), starts)
    assert sorted(zip(places.tolist(), found.tolist())) == [(0, 1), (2, 0), (3, 2)]


# 12


def brute_spans(docs, length=400):
    """Spans of repeated strings of each (id, text), by all windows."""
    seen = Counter(t[k : k + length] for t in docs for k in range(len(t) - length + 1))
    out = []
    for t in docs:
        covered = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                covered[k : k + length] = b"\x01" * length
        out.append([m.span() for m in re.finditer(b"\x01+", covered)])
    return out


def digests(docs, spans):
    out = []
    for (i, t), runs in zip(docs, spans, strict=True):
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + t[at:a], b
        out.append((i, len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept + t[at:]).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("where", ["awkward", SMALL])
def test_suffix_dedup(spark, awkward, where):  # noqa: F811
    folder = awkward if where == "awkward" else where
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in rows_of(folder)]
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result(spark, "op12_suffix_dedup", folder)), key=repr)
    assert found == digests(docs, brute_spans([t for _, t in docs]))


def repeated(draw, alphabet, length):
    """Texts with passages cut at any place, copies, near copies, self-repeats and runs of one letter."""
    word = lambda n: "".join(draw.choice(alphabet) for _ in range(n))
    passages = [word(draw.randrange(length // 2, 4 * length)) for _ in range(6)]
    texts = []
    for k in range(60):
        pieces = [word(draw.randrange(0, 2 * length))]
        for _ in range(draw.randrange(4)):
            p = draw.choice(passages)
            low = draw.randrange(len(p) // 2)
            pieces += [p[low : low + draw.randrange(len(p))], word(draw.randrange(0, length))]
        texts.append("".join(pieces))
    near = list(texts[7])
    for at in range(5, len(near), length + length // 3):
        near[at] = "#"
    texts += [texts[3], texts[3], "".join(near), "é" * length * 2, passages[0] * 3, "", None, word(length), "z" * (length - 1)]
    return [(k, t) for k, t in enumerate(texts)] + [(0, texts[5]), (None, texts[6]), (None, None), (3, texts[3])]


@pytest.mark.parametrize("alphabet,length,segment", [("abcdefgh ", 100, 1 << 24), ("ab", 100, 700), ("abcdefghijkl", 260, 3000)])
def test_suffix_dedup_at_the_ends_of_passages(spark, monkeypatch, alphabet, length, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(suffix_dedup, "CHUNK", segment)
    rows = repeated(random.Random(length), alphabet, length)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id long, text string, seg string").repartition(3)
    docs = [(i, (t or "").encode()) for i, t in rows]
    expected = sorted(((i, tuple(runs)) for (i, _), runs in zip(docs, brute_spans([t for _, t in docs], length), strict=True)), key=repr)
    found = suffix_dedup.repeated_spans(df, "id", "text", suffix_dedup.F.col("seg"), length=length).collect()
    assert sorted(((r.id, tuple((s.start, s.end) for s in r.spans)) for r in found), key=repr) == expected
    assert sum(len(runs) for _, runs in expected) > 15 and all(r.seg == "clash" for r in found)
    assert {r.id: r.n_removed for r in found if r.id is not None and r.id > 10}.items() <= {i: sum(b - a for a, b in runs) for i, runs in expected if i is not None and i > 10}.items()


def test_suffix_dedup_holds_little_in_python(spark, monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(suffix_dedup.CHUNK), np.uint8)
    monkeypatch.setattr(common, "_powers", {})
    tracemalloc.start()
    suffix_dedup.anchors(data, np.array([0, len(data)]), 400, 96)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 40e6 and most < 160e6
    plans, store = [], suffix_dedup.stored_table
    monkeypatch.setattr(suffix_dedup, "stored_table", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    text = "".join(random.Random(2).choices("abcdefgh ", k=900))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = suffix_dedup.repeated_spans(spark.createDataFrame([(1, "x" + text), (2, "y" + text)], "id long, text string"), "id", "text")
        assert [r.n_removed for r in found.collect()] == [900, 900]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    python = re.compile("FlatMapCoGroupsInArrow|MapInArrow")
    for plan in plans:  # between two Python steps is a shuffle, so that a core has one worker at a time
        above = []
        for line in plan.splitlines():
            depth = len(re.match(r"[ :+-]*", line)[0])
            above = [(d, x) for d, x in above if d < depth]
            since = [x for _, x in above]
            for k, x in enumerate(since):
                assert not (python.search(line) and python.search(x)) or any("Exchange" in y for y in since[k:]), plan
            above.append((depth, line))



# 13


def brute_audit(rows, labels):
    facts, first = [], {}
    for i, text, part in rows:
        text = text or ""
        if i is not None:
            first[text] = min(i, first.get(text, i))
    quality, toxic = ({r["doc_id"] for r in labels if r["doc_id"] is not None and r[c] == 1} for c in ("quality", "toxic"))
    for i, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50, "B": 100 * len({*words}) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text],
        }
        facts.append((part or "", {f for f, bad in fails.items() if bad}, i in quality, i in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                alive = [x for x in own if not x[1] & {*order[:step]}]
                gone = [x for x in alive if f in x[1]]
                out[(part, "".join(order), step + 1)] = [len(alive) - len(gone), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[(part, f)] += len(gone)
    return {k: (*v, shapley[(k[0], k[1][k[2] - 1])]) for k, v in out.items()}


@pytest.mark.parametrize("where", ["awkward", SMALL])
def test_filter_audit(spark, awkward, where):  # noqa: F811
    folder = awkward if where == "awkward" else where
    found = result(spark, "op13_filter_audit", folder)
    said = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in found}
    assert len(said) == len(found) and said == brute_audit([(r["doc_id"], r["text"], r["source"]) for r in rows_of(folder)], rows_of(folder, "labels"))


def test_filter_audit_of_copies_ties_and_repeated_labels(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "a"), (9, text, "b"), (None, text, None), (4, text + " #", "a"), (4, text + " #", "a"), (7, "WORD", "b"), (8, None, "b"), (2, "", "a")]
    labels = [(9, 1, 0), (9, 0, 1), (5, None, 1), (None, 1, 1), (77, 1, 1)]
    df, said = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(df, said, "doc_id", "text", "source", "quality", "toxic").collect()
    expected = brute_audit(rows, [{"doc_id": i, "quality": q, "toxic": t} for i, q, t in labels])
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in found} == expected and len(expected) == 3 * 600


def test_the_lattice_has_80_edges_on_600_steps(spark):
    assert spark.range(1).select(filter_audit.F.size(filter_audit.lattice_edges())).first()[0] == 80
    steps = filter_audit.paths(spark).collect()
    assert len(steps) == 600 and len({(r.applied, r.next) for r in steps}) == 80
