"""Mixing by iterative proportional fitting.

Token counts per cell (source, language, topic) are raked until their marginals meet the targets; a document is then sampled with the
probability that its cell's weight calls for. The cells are a grouped table that stays in Spark; a round rescales it along each
dimension by partial aggregates, so a source with a third of all rows is only a few cells.

The targets are tempered shares: a value that has the share s of all tokens aims for a share in proportion to ``s ** power``. The probability
of a document is ``budget * weight / tokens`` of its cell, with the budget as a share of all tokens. No cell can give more
than it has, so a weight counts up to that bound in every sum: a full cell stays full, and what it cannot give is asked of the other cells of
its source, language and topic. A value with fewer tokens than its target gets the target that it can meet, and the others share the
rest in proportion (``feasible``). Rounds go on until all marginals are within ``TOLERANCE``, or ``ROUNDS`` are done; targets of different
dimensions may contradict each other, and ``unmet`` tells which ones are missed. The draw is a hash of the seed and the id, so it can be
repeated anywhere.

Documents meet their cell by broadcast, in blocks of ``BLOCK_ROWS`` cells whose number is counted first; texts are never shuffled.

Defined cases: NULL in a dimension counts as the value ''; a NULL or blank text has no tokens and is never drawn; rows that repeat an id share
one draw; a NULL id draws as the id ''; an empty table gives an empty result; other columns pass through, whatever their names, unless they bear the
name of a result column, in which case the result replaces them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.rows import stored

DIMENSIONS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 12
TOLERANCE = 1e-11
BUDGET = 0.5
BLOCK_ROWS = 1 << 17
SEED = "mix"
SPACES = "[\\x20\\x09-\\x0D]+"
BRIEF, LONG = 200, 1000  # tokens: below the first a text is a note, from the second on long-form


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` (words of the whole text) and ``topic``, a stand-in from the text's form."""
    counted = docs.withColumn("n_tokens", F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("long"))
    form = F.when(F.col("n_tokens") < BRIEF, "note").when(F.col("n_tokens") < LONG, "article").otherwise("long-form")
    return counted.withColumn("topic", form)


def feasible(targets: DataFrame) -> DataFrame:
    """``targets`` (value, ``target``, ``room``) with each target at most its room, and the surplus spread over the others in proportion."""
    full, scale = None, 1.0
    while True:
        reached = F.col("target") * F.lit(scale) >= F.col("room")
        sums = targets.agg(F.count_if(reached).alias("n"), F.sum(F.when(reached, F.col("room"))).alias("given"), F.sum(F.when(~reached, F.col("target"))).alias("open")).first()
        if sums["n"] == full or not sums["open"]:
            return targets.withColumn("target", F.least(F.col("target") * F.lit(scale), "room"))
        full, scale = sums["n"], max(scale, (1.0 - (sums["given"] or 0.0)) / sums["open"])


def rake(cells: DataFrame, dimensions: dict[str, float] = DIMENSIONS, rounds: int = ROUNDS, budget: float = 0.0) -> DataFrame:
    """``cells`` (dimensions and ``tokens``, all above 0) with ``weight``: shares whose marginals are the targets.

    With a ``budget``, a share of all tokens, no weight exceeds what its cell can give.
    """
    return _raked(cells, dimensions, rounds, budget)[0]


def _raked(cells: DataFrame, dimensions: dict[str, float], rounds: int, budget: float) -> tuple[DataFrame, dict[str, DataFrame]]:
    cells = stored(cells)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    room = F.col("tokens") / F.lit(budget * total) if budget else F.lit(math.inf)
    now = stored(cells.withColumns({"weight": F.col("tokens") / F.lit(total), "_room": room}))
    targets = {}
    for name, power in dimensions.items():
        shares = now.groupBy(name).agg(F.sum("weight").alias("share"), F.sum("_room").alias("room")).withColumn("share", F.pow("share", F.lit(power)))
        whole = shares.agg(F.sum("share")).first()[0] or 1.0
        targets[name] = stored(feasible(stored(shares.select(name, (F.col("share") / F.lit(float(whole))).alias("target"), "room"))))
    for _ in range(rounds):
        worst = None
        for name in dimensions:
            held = now.groupBy(name).agg(F.sum(F.least("weight", "_room")).alias("_sum")).join(targets[name], name)
            # Written, because a step reads the cells twice and plans of unwritten steps would double.
            held = stored(held.select(name, (F.col("target") / F.col("_sum")).alias("_factor")))
            off = held.select(F.abs(F.col("_factor") - 1).alias("off"))
            worst = off if worst is None else worst.unionByName(off)
            now = now.join(held, name).withColumn("weight", F.col("weight") * F.col("_factor")).drop("_factor")
        now = stored(now)
        if (worst.agg(F.max("off")).first()[0] or 0.0) < TOLERANCE:
            break
    return now.withColumn("weight", F.least("weight", "_room")).drop("_room"), targets


def unmet(cells: DataFrame, dimensions: dict[str, float] = DIMENSIONS, rounds: int = ROUNDS, budget: float = BUDGET, tolerance: float = 0.01) -> DataFrame:
    """Targets that the weights miss by more than ``tolerance`` of the target: ``dimension``, ``value``, ``target``, ``reached``."""
    raked, targets = _raked(cells, dimensions, rounds, budget)
    out = None
    for name in dimensions:
        sums = raked.groupBy(name).agg(F.sum("weight").alias("reached")).join(targets[name], name)
        one = sums.select(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"), "target", "reached")
        out = one if out is None else out.unionByName(one)
    return out.filter(F.abs(F.col("reached") - F.col("target")) > F.col("target") * tolerance)


def draw(doc_id: str, seed: str = SEED) -> Column:
    """A number from 0 up to 1 for each id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def cells_of(measured: DataFrame, dimensions: dict[str, float] = DIMENSIONS) -> DataFrame:
    """Tokens per cell of the measured documents."""
    keys = [F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dimensions]
    return measured.filter("n_tokens > 0").groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))


def sample(measured: DataFrame, doc_id: str = "doc_id", budget: float = BUDGET, dimensions: dict[str, float] = DIMENSIONS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``weight`` (of the document's cell), ``probability`` and ``sampled`` to measured documents."""
    raked = rake(cells_of(measured, dimensions), dimensions, rounds, budget)
    sums = raked.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    chance = F.least(F.lit(1.0), F.lit(float(budget * (sums["tokens"] or 0))) * F.col("weight") / F.col("tokens"))
    keys = [F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dimensions]
    place = F.xxhash64(*keys)  # only deals the cells out; the names themselves are compared
    known = stored(raked.select(F.struct(*dimensions).alias("_cell"), F.struct("weight", chance.alias("probability")).alias("_mix")))
    blocks = max(1, math.ceil(sums["n"] / BLOCK_ROWS))
    # All columns of the caller's in one, so that none can clash with those of the join.
    packed = measured.drop("weight", "probability", "sampled")
    rows = packed.select(F.struct(*[F.col(f"`{c}`") for c in packed.columns]).alias("_row"), F.struct(*[k.alias(d) for k, d in zip(keys, dimensions, strict=True)]).alias("_at"), place.alias("_place"))
    found = []
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64(*[F.col(f"_cell.{d}") for d in dimensions]), F.lit(blocks)) == block)
        part = part.select(F.col("_cell").alias(f"_cell{block}"), F.col("_mix").alias(f"_mix{block}"))
        rows = rows.join(F.broadcast(part), F.col("_at") == F.col(f"_cell{block}"), "left")
        found.append(F.col(f"_mix{block}"))
    mix = F.coalesce(*found, F.struct(F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability")))
    mixed = rows.select("_row.*", *[mix[c].alias(c) for c in ("weight", "probability")])
    drawn = F.coalesce((F.col("n_tokens") > 0) & (draw(doc_id) < F.col("probability")), F.lit(False))
    return mixed.withColumn("sampled", drawn)


def oracle(budget: float = BUDGET, dimensions: dict[str, float] = DIMENSIONS, rounds: int = ROUNDS, documents: str = "documents") -> str:
    """The digest of ``sample`` in DuckDB SQL over a table of documents."""
    names = list(dimensions)
    cols = ", ".join(names)
    steps = [
        f"""measured AS MATERIALIZED (SELECT *, CASE WHEN n_tokens < {BRIEF} THEN 'note' WHEN n_tokens < {LONG} THEN 'article' ELSE 'long-form' END AS topic
  FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, source AS raw_source, lang AS raw_lang,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {documents}))""",
        f"cells AS MATERIALIZED (SELECT {cols}, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM measured WHERE n_tokens > 0 GROUP BY ALL)",
        f"w0 AS MATERIALIZED (SELECT *, tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM cells) AS weight, tokens / ({budget} * (SELECT CAST(sum(tokens) AS DOUBLE) FROM cells)) AS room FROM cells)",
    ]
    for name, power in dimensions.items():
        steps.append(f"raw_{name} AS MATERIALIZED (SELECT {name}, pow(sum(weight), {power}) AS share FROM w0 GROUP BY 1)")
        steps.append(f"to_{name} AS MATERIALIZED (SELECT {name}, share / (SELECT sum(share) FROM raw_{name}) AS target FROM raw_{name})")
    for name in names:
        # Values by room per target: full up to the first that has room left at the scale at which the others take what remains.
        steps.append(f"""room_{name} AS MATERIALIZED (SELECT t.*, room, sum(room) OVER o - room AS given, sum(target) OVER o - target AS taken
  FROM to_{name} t JOIN (SELECT {name}, sum(room) AS room FROM w0 GROUP BY 1) r USING ({name}) WINDOW o AS (ORDER BY room / target, {name}))""")
        steps.append(f"""fit_{name} AS MATERIALIZED (SELECT {name}, least(target * (SELECT coalesce(min(greatest(1.0, (1.0 - given) / (1.0 - taken))) FILTER (greatest(1.0, (1.0 - given) / (1.0 - taken)) < room / target), max(room / target))
  FROM room_{name} WHERE taken < 1), room) AS target FROM room_{name})""")
    at = 0
    for _ in range(rounds):
        for name in names:
            steps.append(
                f"w{at + 1} AS MATERIALIZED (SELECT w.* REPLACE (w.weight * (t.target / s.whole) AS weight) FROM w{at} w "
                f"JOIN (SELECT {name}, sum(least(weight, room)) AS whole FROM w{at} GROUP BY 1) s USING ({name}) JOIN fit_{name} t USING ({name}))"
            )
            at += 1
    return (
        "WITH " + ",\n".join(steps) + f""",
chances AS MATERIALIZED (SELECT {cols}, least(weight, room) AS weight, least(1.0, {budget} * (SELECT CAST(sum(tokens) AS DOUBLE) FROM cells) * least(weight, room) / tokens) AS probability FROM w{at})
SELECT m.doc_id, m.raw_source AS source, m.raw_lang AS lang, m.topic, m.n_tokens, round(coalesce(c.weight, 0), 9) AS weight, round(coalesce(c.probability, 0), 9) AS probability,
  coalesce(n_tokens > 0 AND CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / CAST({16**13} AS DOUBLE) < c.probability, false) AS sampled
FROM measured m LEFT JOIN chances c USING ({cols})"""
    )
