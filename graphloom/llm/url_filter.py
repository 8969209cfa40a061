"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed side by side into the bits of a few 64-bit words.
One Shift-And step a character advances every rule on every URL of a batch
at once: a bit moves on where its rule accepts the character, and stays where
its rule has a wildcard that accepts it. Nothing is joined or shuffled; the
packed masks are a few KB for each thousand rules.

Defined cases: a null URL, or one without "://", has empty host and path and
matches no host rule; URLs of any length are read whole; an empty table gives an empty result; equal rows are
judged alike; columns of the input other than the id and the URL are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import extended, text_buffers


@dataclass(frozen=True)
class Rule:
    """A glob over host + path: "?" is any character, "*" a run without "/", "**" any run. Of the rules that fit, the one with the highest rank wins, then the first."""

    glob: str
    name: str | None
    verdict: str
    rank: int


def host_rule(host: str, path: str, verdict: str) -> list[Rule]:
    """A rule for a host, all its subdomains and every path with that prefix, as two globs. Longer rules win."""
    return [Rule(f"{head}{host}{path}**", host + path, verdict, 1_000_000 + len(host + path)) for head in ("", "*.")]


#: Host rules of the query's contract, in its order.
CONTRACT_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Globs that decide where no host rule fits: spam words in the host, then all else.
DEFAULT_GLOBS = tuple(Rule(glob, None, verdict, rank) for glob, verdict, rank in (
    ("*cheap-*/**", "block", 2), ("*free-bets*/**", "block", 2), ("*casino*/**", "block", 2), ("*-pills*/**", "block", 2), ("*xxx*/**", "block", 2),
    ("**/login**", "block", 1), ("**/cart/**", "block", 1), ("**", "allow", 0),
))


def compile_rules(rules: Sequence[Rule]) -> dict[str, np.ndarray]:
    """Masks for 256 byte values: step (a character moves the bit on), stay (it may remain); start and accept bits; free (wildcards that match nothing)."""
    cells: list[list[tuple[str, str]]] = []
    for rule in rules:
        parts, glob = [], rule.glob.encode().decode("latin-1")
        while glob:
            kind = "**" if glob.startswith("**") else glob[0]
            glob = glob[len(kind) :]
            if kind in ("*", "**"):
                parts.append(("wild", kind))
            else:
                parts.append(("char", kind))
        cells.append(parts)
    # A rule of n characters takes n + 1 bits: bit i is set when its first i characters are matched. A wildcard before character i lets bit i stay.
    sizes = [sum(kind == "char" for kind, _ in parts) + 1 for parts in cells]
    words = (sum(sizes) + 63) // 64
    step, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    start, accept = np.zeros(words, np.uint64), np.zeros((len(rules), 2), np.int64)
    no_slash = [c for c in range(256) if c != ord("/")]
    inner = range(0x80, 0xC0)  # bytes of a character but its first
    heads = [c for c in range(256) if c not in inner]
    at = 0
    for r, parts in enumerate(cells):
        start[at // 64] |= np.uint64(1 << at % 64)
        for kind, what in parts:
            if kind == "char":
                at += 1
                step[heads if what == "?" else ord(what), at // 64] |= np.uint64(1 << at % 64)
                if what == "?":
                    stay[inner, at // 64] |= np.uint64(1 << at % 64)
            else:
                stay[range(256) if what == "**" else no_slash, at // 64] |= np.uint64(1 << at % 64)
        accept[r] = at // 64, at % 64
        at += 1
    return {"step": step, "stay": stay, "start": start, "accept": accept}


def match_all(masks: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row of bytes and each rule, whether the rule matches the whole row."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    words = masks["step"].shape[1]
    state = np.tile(masks["start"], (len(lengths), 1))
    begin, live = offsets[:-1][order], lengths[order]
    for i in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-live, -i, "left"))  # rows longer than i come first
        chars = data[begin[:n] + i]
        now = state[:n]
        moved = now << np.uint64(1)
        if words > 1:
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[:n] = (moved & masks["step"][chars]) | (now & masks["stay"][chars])
    accept = masks["accept"]
    found = np.zeros((len(lengths), len(accept)), bool)
    found[order] = (state[:, accept[:, 0]] >> accept[:, 1].astype(np.uint64)) & np.uint64(1)
    return found


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row: its id, canonical host and path, the winning rule's name and verdict (both null if none fits)."""
    # Only the first "://" counts; what stands before it goes.
    after = F.regexp_extract(F.coalesce(url_col, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.regexp_extract(after, "(?s)^[^/?#]*(.*)$", 1), "^[^?#]*", 0)
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    masks, rules = compile_rules(rules), list(rules)
    by_rank = sorted(range(len(rules)), key=lambda r: -rules[r].rank)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([rules[r].name for r in by_rank] + [None], pa.string())
        verdicts = pa.array([rules[r].verdict for r in by_rank] + [None], pa.string())
        for batch in batches:
            canonical = pc.binary_join_element_wise(batch.column(1), batch.column(2), "")
            found = match_all(masks, *text_buffers(canonical))[:, by_rank]
            found = np.concatenate((found, np.ones((len(found), 1), bool)), axis=1)
            best = pa.array(found.argmax(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(best), verdicts.take(best)], names=[*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(judge, extended(parts, "rule string, verdict string"))


def contract_rules() -> list[Rule]:
    return [rule for r in CONTRACT_RULES for rule in host_rule(*r)] + list(DEFAULT_GLOBS)
