"""Repair of turn structure by rank-convergence parallel Viterbi.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Each row is kept (0), given the role user or assistant (2) or
deleted (3, the only choice for blank and duplicate rows); a user or assistant row without text may be inserted anywhere (2); a
truncated row that stays adds 1. Of the cheapest edits those are taken whose initials D, I, K, R read least.

The rows are dealt by a range shuffle over their whole order, so a conversation of any length lies in consecutive parts, which are
the chunks of the method; a part boundary crosses one conversation at most. Then:

1. Each part runs backward costs (one per state of the automaton) from a speculative vector after its last row.
2. Fix-up passes run the parts anew whose true vector differs from the assumed one by more than a constant, from the right until the
   old and the new vector differ by a constant only; the rest of the part keeps its choices. They are repeated until no part is wrong.
   Parts that hold the start of a conversation give the same first vector whatever comes after, so the passes only follow conversations
   that fill whole parts.
3. With the stitched costs, each part maps its four possible first states to last ones; chained, they give the state at each boundary.
4. Each part traces its least edits by itself.

The driver holds one row per part (two ids and a few small numbers), whose number is the shuffle setting. A part is held without its
texts, as three small values per row. Vectors are kept less their minimum; there are only a few of them, so one step is a table look-up.

Defined cases: NULL roles and texts count as one space; rows with a NULL conv_id are one conversation; rows come by turn (NULL first),
rows of one turn by role, the first 32 characters and the MD5 of the text; copies of a row are duplicates of the first; blank means
no character outside ``\\x20\\x09-\\x0D``; an initial is the first character, whatever the role is called; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import durable

BLANKS = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")

# States: nothing yet, after system, after user, after assistant. An initial that a state does not list is illegal there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INSERTED = "uuau"  # the only role to insert in each state, which is also the one to give
START, FINAL = 0, (0, 4, 2, 0)  # cost to complete the end of a conversation

Vector = tuple[int, int, int, int]
Symbol = tuple[str, int]  # initial and fault


def _close(costs: list[int]) -> list[int]:
    """Allow insertions first: at most two are ever worth while."""
    for _ in range(2):
        costs = [min(costs[s], 2 + costs[NEXT[s][INSERTED[s]]]) for s in range(4)]
    return costs


def _options(state: int, symbol: Symbol) -> list[tuple[str, int, int]]:
    """Edits of a row in a state, as (initial, cost, next state), by initial."""
    initial, fault = symbol
    out = [("D", 3, state)]
    if fault not in (1, 2):
        late = int(fault == 3)
        if initial in NEXT[state]:
            out.append(("K", late, NEXT[state][initial]))
        out.append(("R", 2 + late, NEXT[state][INSERTED[state]]))
    return out


@lru_cache(None)
def step(after: Vector, symbol: Symbol) -> tuple[Vector, int]:
    """Backward costs before a row from those after it, less their minimum, and that minimum."""
    costs = _close([min(cost + after[to] for _, cost, to in _options(s, symbol)) for s in range(4)])
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(None)
def trace(state: int, symbol: Symbol, after: Vector) -> tuple[str, str, str, int]:
    """Least edits up to and with a row: their initials, roles inserted before, role of the row ('' deleted, '=' kept), next state."""
    costs, least = step(after, symbol)
    edits = before = ""
    while True:
        now = costs[state] + least
        moves = {e: (cost, to) for e, cost, to in _options(state, symbol)}
        inserted = NEXT[state][INSERTED[state]]
        if moves["D"][0] + after[state] == now:
            return edits + "D", before, "", state
        if 2 + costs[inserted] + least == now:
            edits, before, state = edits + "I", before + INSERTED[state], inserted
        elif "K" in moves and moves["K"][0] + after[moves["K"][1]] == now:
            return edits + "K", before, "=", moves["K"][1]
        else:
            return edits + "R", before, INSERTED[state], moves["R"][1]


def ending(state: int) -> str:
    """Roles to insert at the end of a conversation."""
    out = ""
    while FINAL[state]:
        out, state = out + INSERTED[state], NEXT[state][INSERTED[state]]
    return out


def backward(symbols: list[Symbol], end: Vector) -> list[Vector]:
    """Cost vectors before each row and after the last, from the right: the first is ``end``."""
    out = [end]
    for symbol in reversed(symbols):
        out.append(step(out[-1], symbol)[0])
    return out


def fixed_up(symbols: list[Symbol], old_end: Vector, end: Vector) -> list[Vector]:
    """As ``backward`` from ``end``, taking over the vectors of the speculative run as soon as both agree but for a constant."""
    old, out = backward(symbols, old_end), [end]
    for i, symbol in enumerate(reversed(symbols)):
        if out[-1] == old[i]:
            return out + old[i + 1 :]
        out.append(step(out[-1], symbol)[0])
    return out


class _Part(NamedTuple):
    """What the driver knows of a part."""

    first: object  # conversations of the first and the last row
    last: object
    whole: bool  # both are one segment
    start: Vector  # before the first row, given ``end`` after the last
    end: Vector


def damage(rows: DataFrame) -> DataFrame:
    """The stand-in input of the query: rows dropped, emptied, cut short, repeated or given a wrong role by a hash of their place."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    known = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return known.select("conv_id", "turn", role.alias("role"), changed.alias("text"), copies.alias("_copy")).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """All rows in order with their ``place`` and ``part``; fixed by a checkpoint. Copies of a row are spread by their row number."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    base = rows.select("conv_id", "turn", text("role"), text("text")).withColumn("_row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", F.substring("text", 1, 32), F.md5("text"), "_row"]
    fixed = durable(base.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row"))
    return fixed.withColumns({"place": F.monotonically_increasing_id(), "part": F.spark_partition_id()})


def faults(placed: DataFrame) -> DataFrame:
    """``place``, ``part``, ``conv_id``, role ``initial`` and number of the first ``fault`` of each row, without the texts."""
    bare = F.rtrim("text", F.lit(BLANKS))
    light = placed.select(
        "place", "part", "conv_id", "role", F.substring("role", 1, 1).alias("initial"), (F.length(bare) == 0).alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"), F.sha2("text", 256).alias("said"),
    )
    # One row per thing said; places are unique, so no conversation gathers in one task.
    firsts = light.groupBy("conv_id", "role", "said").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("truncated"), 3).otherwise(0)
    return light.join(firsts, "place", "left").select("place", "part", "conv_id", "initial", fault.alias("fault"))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """The rows (place, conv_id, symbol) of each part; they come sorted."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "place", "conv_id", "initial", "fault")), strict=True))
    seen: dict[tuple, Symbol] = {}
    for part, group in groupby(rows, key=lambda r: r[0]):
        yield part, [(place, conv, seen.setdefault((initial, fault), (initial, fault))) for _, place, conv, initial, fault in group]


def _segments(rows: list) -> list[tuple[object, list]]:
    return [(conv, list(group)) for conv, group in groupby(rows, key=lambda r: r[1])]


def _over_parts(table: DataFrame, work: Callable[[int, list], Iterable[dict]], ddl: str, schema: pa.Schema) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts(batches):
            out = list(work(part, rows))
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[i : i + 10_000], schema=schema)

    return table.mapInArrow(run, ddl)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _run_parts(table: DataFrame, ends: dict[int, tuple[Vector, Vector | None]]) -> dict[int, _Part]:
    """Backward costs of the parts in ``ends`` (all if empty): the vector after the last row, and that of an earlier pass if any."""
    conv, kind = _arrow(table, "conv_id"), dict(table.dtypes)["conv_id"]

    def work(part: int, rows: list) -> Iterator[dict]:
        segments = _segments(rows)
        end, earlier = ends.get(part, (FINAL, None))
        symbols = [r[2] for r in segments[0][1]]
        if len(segments) > 1:
            vectors = backward(symbols, FINAL)
        else:
            vectors = backward(symbols, end) if earlier is None else fixed_up(symbols, earlier, end)
        yield {"part": part, "first": rows[0][1], "last": rows[-1][1], "whole": len(segments) == 1, "start": list(vectors[-1])}

    schema = pa.schema([("part", pa.int32()), ("first", conv), ("last", conv), ("whole", pa.bool_()), ("start", pa.list_(pa.int64()))])
    asked = table.filter(F.col("part").isin(list(ends))) if ends else table
    found = _over_parts(asked, work, f"part int, first {kind}, last {kind}, whole boolean, start array<long>", schema).collect()
    return {r["part"]: _Part(r["first"], r["last"], r["whole"], tuple(r["start"]), ends.get(r["part"], (FINAL, None))[0]) for r in found}


def stitch(table: DataFrame) -> dict[int, tuple[Vector, int, bool]]:
    """Per part: the true cost vector after its last row, the state before its first, and whether its last conversation goes on."""
    parts = _run_parts(table, {})
    numbers = sorted(parts)
    goes_on = {a: parts[a].last == parts[b].first for a, b in zip(numbers, numbers[1:], strict=False)}
    after = dict(zip(numbers, numbers[1:], strict=False))
    while True:
        true_end = {p: parts[after[p]].start if goes_on.get(p) else FINAL for p in numbers}
        wrong = {p: (true_end[p], parts[p].end) for p in numbers if parts[p].whole and true_end[p] != parts[p].end}
        if not wrong:
            break
        parts.update(_run_parts(table, wrong))

    crossing = [p for p in numbers if goes_on.get(p)]
    states = dict.fromkeys(numbers, START)
    if crossing:

        def work(part: int, rows: list) -> Iterator[dict]:
            segments = _segments(rows)
            symbols = [r[2] for r in segments[-1][1]]
            vectors = backward(symbols, true_end[part])
            last = []
            for state in range(4):
                for i, symbol in enumerate(symbols):
                    state = trace(state, symbol, vectors[len(symbols) - 1 - i])[3]
                last.append(state)
            yield {"part": part, "states": last}

        schema = pa.schema([("part", pa.int32()), ("states", pa.list_(pa.int32()))])
        found = _over_parts(table.filter(F.col("part").isin(crossing)), work, "part int, states array<int>", schema).collect()
        maps = {r["part"]: r["states"] for r in found}
        for p in crossing:
            states[after[p]] = maps[p][states[p] if parts[p].whole else START]
    return {p: (true_end[p], states[p], bool(goes_on.get(p))) for p in numbers}


def edits(placed: DataFrame) -> DataFrame:
    """Per row: its ``fault``, its ``edits`` (initials), the roles inserted ``before`` and ``after`` it, and ``own``: the row's role
    afterwards, '=' if kept and '' if deleted. Roles are given by their initials.
    """
    table = durable(faults(placed).repartition("part").sortWithinPartitions("part", "place"))
    known = stitch(table)

    def work(part: int, rows: list) -> Iterator[dict]:
        end, state, goes_on = known[part]
        segments = _segments(rows)
        for n, (conv, segment) in enumerate(segments):
            last = n == len(segments) - 1
            symbols = [r[2] for r in segment]
            vectors = backward(symbols, end if last else FINAL)
            state = state if n == 0 else START
            for i, (place, _, symbol) in enumerate(segment):
                made, before, own, state = trace(state, symbol, vectors[len(symbols) - 1 - i])
                closing = ending(state) if i == len(segment) - 1 and not (last and goes_on) else ""
                yield {"place": place, "conv_id": conv, "fault": symbol[1], "edits": made + "I" * len(closing), "before": before, "own": own, "after": closing}

    conv, kind = _arrow(table, "conv_id"), dict(table.dtypes)["conv_id"]
    schema = pa.schema([("place", pa.int64()), ("conv_id", conv), ("fault", pa.int32()), *[(c, pa.string()) for c in ("edits", "before", "own", "after")]])
    return _over_parts(table, work, f"place long, conv_id {kind}, fault int, edits string, before string, own string, after string", schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id``, ``place`` and ``step`` (their order), ``turn`` (NULL if inserted), role and text."""
    placed = ordered(rows)
    full = placed.drop("part").join(edits(placed).drop("conv_id"), "place")
    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    added = lambda c: F.transform(F.array_remove(F.split(c, ""), ""), lambda x: F.struct(F.lit(None).cast(turn).alias("turn"), name(x).alias("role"), F.lit("").alias("text")))
    turn = dict(rows.dtypes)["turn"]
    role = F.when(F.col("own") == "=", F.col("role")).otherwise(name(F.col("own")))
    itself = F.when(F.col("own") != "", F.array(F.struct("turn", role.alias("role"), "text"))).otherwise(F.array())
    made = full.select("conv_id", "place", F.posexplode(F.concat(added("before"), itself, added("after"))).alias("step", "row"))
    return made.select("conv_id", "place", "step", "row.turn", "row.role", "row.text")


class _Tally:
    """The digest of one conversation, fed row by row."""

    def __init__(self, conv: object):
        self.conv, self.faults, self.cost, self.illegal = conv, [0, 0, 0, 0], 0, 0
        self.last_initial = self.low = self.high = None
        self.turns, self.audit, self.hash, self.empty = 0, [], hashlib.sha256(), True

    def say(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def add(self, edit: dict, turn: int | None, role: str, text: str) -> None:
        self.faults[edit["fault"]] += 1
        self.audit.append(edit["edits"])
        deleted = edit["own"] == ""
        self.cost += 2 * edit["edits"].count("I") + (3 if deleted else 2 * (edit["own"] != "=") + (edit["fault"] == 3))
        if self.last_initial is not None and self.last_initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = role[:1]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        for initial in edit["before"]:
            self.say(NAMES[initial], "")
        if not deleted:
            self.say(role if edit["own"] == "=" else NAMES[edit["own"]], text)
        for initial in edit["after"]:
            self.say(NAMES[initial], "")

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "conv_id": self.conv, "gaps": gaps, "blank": self.faults[1], "duplicate": self.faults[2], "truncated": self.faults[3],
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest(),
        }


def summarise(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: faults, gaps, cost and edits of its ``rows``, and a hash of the repaired ones.

    Rows and edits meet in the order of places and are read as a stream, so only the audit of a conversation, which is one value of the
    result, is held. SHA-256 is sequential: the hash of one conversation is taken by one task, whatever its length.
    """
    placed = ordered(rows)
    none = lambda *cs: [F.lit(None).cast(t).alias(c) for c, t in cs]
    texts = placed.select("conv_id", "place", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", *none(("fault", "int"), ("edits", "string"), ("before", "string"), ("own", "string"), ("after", "string")))
    made = edits(placed).select("conv_id", "place", F.lit(0).alias("kind"), *none(("turn", "long"), ("role", "string"), ("text", "string")), "fault", "edits", "before", "own", "after")
    names = conversations.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(0).alias("kind"), *none(*[(c, t) for c, t in texts.dtypes[3:]]))
    stream = texts.union(made).union(names).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")
    conv, kind = _arrow(texts, "conv_id"), dict(texts.dtypes)["conv_id"]
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", conv), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def tallies(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        tally = edit = None
        for batch in batches:
            for row in batch.to_pylist():
                if tally is None or tally.conv != row["conv_id"]:
                    if tally is not None:
                        yield tally.row()
                    tally = _Tally(row["conv_id"])
                if row["edits"] is not None:
                    edit = row
                elif row["role"] is not None:
                    tally.add(edit, row["turn"], row["role"], row["text"])
        if tally is not None:
            yield tally.row()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in tallies(batches):
            held.append(row)
            if len(held) >= 5_000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return stream.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")
