"""Conversation repair against a plain search over all edits, and the passes of the parallel version."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from cases import ordered, rows_of, sha

import oracle
from linkloom.llm import catalog, conversations

SCHEMA = "conv_id long, turn long, role string, text string, part string, place string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def plain_edits(symbols):
    """Cheapest edits, least in ASCII: every edit in every state, by cost and then by text."""

    @lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(symbols) and state in ("", "a") else []
        if inserted < 3:
            options += [(c + 2, "I" + e, (r, *m)) for r in "ua" if r in NEXT[state] for c, e, m in [best(i, NEXT[state][r], inserted + 1)]]
        if i < len(symbols):
            initial, fault = symbols[i]
            late = fault == "truncated"
            c, e, m = best(i + 1, state, 0)
            options.append((c + 3, "D" + e, ("", *m)))
            if fault in ("", "truncated"):
                for edit, cost, role in [("K", 0, initial), ("R", 2, "u"), ("R", 2, "a")]:
                    if role in NEXT[state]:
                        c, e, m = best(i + 1, NEXT[state][role], 0)
                        options.append((c + cost + late, edit + e, ("=" if edit == "K" else role, *m)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    return best(0, "", 0)


def plain_repair(rows):
    spelled = lambda x: " " if x is None else str(x)
    damaged = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spelled(conv)}:{spelled(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else spelled(role), {1: "", 2: re.sub("[.!?]", "", spelled(text))}.get(kind, spelled(text))
        damaged.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = []
    for conv, found in damaged.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:32].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, symbols = set(), []
        for _, role, text in found:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            symbols.append((role[:1], fault))
        cost, audit, moves = plain_edits(tuple(symbols))
        said, left = [], iter(found)
        for edit, move in zip(audit, moves, strict=True):
            if edit == "I":
                said.append(f"{NAMES[move]}:")
                continue
            _, role, text = next(left)
            if edit != "D":
                said.append(f"{role if move == '=' else NAMES[move]}:{text}")
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == x for _, f in symbols) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
        out.append((conv, gaps, *counts, illegal, cost, audit, sha("\n".join(said))))
    return out


def awkward_rows(seed=4, longest=300):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Hi.", "ok", "what? ", "a" * 50 + ".", " \n\x0b", "", None, "Été!", "e ", "　"]
    rows = [(c or None, rng.choice([t, t, t, None, t + 3, t // 2]), rng.choice(roles), rng.choice([*texts, f"x{rng.randrange(9)}."])) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(777, t, rng.choice(roles[:5]), rng.choice(["Fine.", f"T{t}.", f"no end {t}"])) for t in range(longest)]
    return rows + [rows[5], rows[5], rows[7]]


@pytest.fixture(autouse=True)
def deep():
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    yield
    sys.setrecursionlimit(old)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", None) for r in rows], SCHEMA)


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_awkward_conversations(spark, monkeypatch, parts):
    """The long conversation fills whole parts, so states and costs cross several boundaries."""
    rows = awkward_rows()
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, rows)
        damaged = conversations.damage(df)
        assert rows_of(conversations.summarise(damaged, df), *COLUMNS) == ordered(plain_repair(rows))
        said = {}
        for r in conversations.repaired(damaged).orderBy("conv_id", "place", "step").collect():
            said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert ordered([(r[0], r[-1]) for r in plain_repair(rows)]) == ordered([(c, sha("\n".join(said.get(c, [])))) for c in {r[0] for r in rows}])
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_every_short_conversation():
    """All conversations of up to four rows: the trace is the least of the cheapest edits."""
    kinds = [(i, f) for i in "suat" for f in (0, 3)] + [("u", 1)]
    level = [()]
    for _ in range(4):
        level = [(*s, k) for s in level for k in kinds]
        for symbols in level if len(level) < 1000 else random.Random(1).sample(level, 1500):
            vectors = conversations.backward(list(symbols), conversations.FINAL)
            state, audit = conversations.START, ""
            for i, symbol in enumerate(symbols):
                made, _, _, state = conversations.trace(state, symbol, vectors[len(symbols) - 1 - i])
                audit += made
            audit += "I" * len(conversations.ending(state))
            assert audit == plain_edits(tuple((i, conversations.FAULTS[f]) for i, f in symbols))[1]


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    rng = random.Random(6)
    for _ in range(300):
        symbols = [(rng.choice("suat"), rng.choice([0, 0, 1, 3])) for _ in range(rng.randrange(0, 40))]
        true, guess = (0, 4, 2, 0), rng.choice([(2, 2, 0, 2), (0, 0, 0, 0), (0, 4, 2, 0), (3, 0, 0, 2)])
        assert conversations.fixed_up(symbols, guess, true) == conversations.backward(symbols, true)


def test_query_matches_oracle_and_brute_force(spark, sf_dir):
    df = catalog.op12_conversation_repair(spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(df, *COLUMNS) == ordered(plain_repair(rows))
    assert oracle.differences(df, oracle.connect(sf_dir), catalog.oracles()["op12_conversation_repair"]) == []


def test_oracle_on_awkward_rows(spark, tmp_path):
    rows = awkward_rows(9, longest=40)
    frame(spark, rows).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(str(tmp_path / "in"))
    (next((tmp_path / "in").glob("*.parquet"))).rename(tmp_path / "conversations.parquet")
    df = catalog.op12_conversation_repair(spark, str(tmp_path))
    assert oracle.differences(df, oracle.connect(str(tmp_path)), catalog.oracles()["op12_conversation_repair"]) == []


def test_conversations_without_rows(spark):
    empty = frame(spark, [])
    assert conversations.summarise(conversations.damage(empty), empty).collect() == []
    assert conversations.repaired(empty).collect() == []
    gone = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    lone = frame(spark, [(5, gone, "user", "Hi.")])
    assert rows_of(conversations.summarise(conversations.damage(lone), lone), *COLUMNS) == [(5, 0, 0, 0, 0, 0, 0, "", sha(""))]
