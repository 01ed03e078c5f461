"""URL filters: rules on host and path, and for the rest trust and distrust spread over the link graph of hosts.

A rule such as ``block example.com/de/`` fits its host and all subdomains where the path starts with the rule's; the longest
fitting rule wins (of equally long ones the first in alphabetical order). Hosts are seeded with the share of their pages that rules allow (trust) and
block (distrust). Personalised PageRank carries trust along links, from a host to those that it links to, and distrust
against them, from a host to those that link to it. A page without a rule is blocked if its host's distrust is above its
trust and at least ``BLOCK_FROM``; otherwise it is allowed.

Rounds go on until what is still to come can turn no host's verdict, or is ``SETTLED`` at most. Scores only grow, and what is to
come is at most ``DAMPING / (1 - DAMPING)`` times the last round's growth over all hosts, since a host shares out what it has.

Edges are counted per pair of hosts before anything else, so a host with a third of all pages is a few rows of the
graph. All steps are columns, joins and aggregates; every round is written to the shared folder.

Defined cases: a NULL url, or one without ``://``, has an empty host and path, fits no rule and is allowed; a NULL html has no links;
links without a host stay within theirs; repeated rows count as pages of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import durable

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
ROUNDS = 130  # of the SQL counterpart: what is missing then, damping ** rounds, is below SETTLED
SETTLED = 1e-9
BLOCK_FROM = 0.075  # a host of which half the pages are blocked has this much by itself
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def _fold(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return _fold(F.regexp_extract(after, "^[^/?#]*", 0)), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` and ``decided``, its verdict, to rows with ``host`` and ``path``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "decided": verdict})


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links between different hosts: ``src``, ``dst`` and their number ``n``."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), 1)).alias("dst"))
    edges = links.withColumn("dst", _fold(F.col("dst"))).filter("src <> '' AND dst <> '' AND src <> dst")
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _blocked(trust: Column, distrust: Column) -> Column:
    return (distrust > trust) & (distrust >= BLOCK_FROM)


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` from ``seeds`` (host, good, bad) and ``edges`` (src, dst, n)."""
    sent = edges.groupBy("src").agg(F.sum("n").alias("sent"))
    got = edges.groupBy("dst").agg(F.sum("n").alias("got"))
    graph = durable(edges.join(sent, "src").join(got, "dst").select("src", "dst", (F.col("n") / F.col("sent")).alias("forth"), (F.col("n") / F.col("got")).alias("back")))
    named = graph.select(F.col("src").alias("host")).union(graph.select("dst")).distinct()
    zero, rest = F.lit(0.0), F.lit(1 - damping)
    hosts = seeds.join(named, "host", "full").select("host", F.coalesce("good", zero).alias("good"), F.coalesce("bad", zero).alias("bad"))
    now = durable(hosts.withColumns({"trust": rest * F.col("good"), "distrust": rest * F.col("bad")}))
    while True:
        scores = now.select("host", "trust", "distrust")
        forth = graph.join(scores.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("trust") * F.col("forth")).alias("in"))
        back = graph.join(scores.withColumnRenamed("host", "dst"), "dst").groupBy(F.col("src").alias("host")).agg(F.sum(F.col("distrust") * F.col("back")).alias("out"))
        trust = rest * F.col("good") + F.lit(damping) * F.coalesce("in", zero)
        distrust = rest * F.col("bad") + F.lit(damping) * F.coalesce("out", zero)
        grown = [F.abs(trust - F.col("trust")).alias("trust_grown"), F.abs(distrust - F.col("distrust")).alias("distrust_grown")]
        step = now.join(forth, "host", "left").join(back, "host", "left").select("host", "good", "bad", trust.alias("trust"), distrust.alias("distrust"), *grown)
        now = durable(step)
        to_come = [damping / (1 - damping) * (x or 0.0) for x in now.agg(F.sum("trust_grown"), F.sum("distrust_grown")).first()]
        if sum(to_come) <= SETTLED:
            break
        most_trust, most_distrust = F.col("trust") + F.lit(to_come[0]), F.col("distrust") + F.lit(to_come[1])
        if now.filter(_blocked(F.col("trust"), most_distrust) & ~_blocked(most_trust, F.col("distrust"))).isEmpty():
            break
    return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """Per page: id, ``host``, ``path``, ``rule`` and ``verdict``."""
    host, path = host_and_path(F.col(url))
    ruled = with_rule(pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"), host.alias("host"), path.alias("path")), rules)
    share = lambda what: F.avg(F.when(F.col("decided") == what, 1.0).otherwise(0.0))
    seeds = ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    scores = propagate(seeds, host_edges(ruled))
    blocked = _blocked(F.col("trust"), F.col("distrust"))
    judged = ruled.drop("html").join(scores, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(blocked, "block").otherwise("allow")).alias("verdict"))


def oracle(rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """``judge`` in DuckDB SQL, with all rounds written out."""
    quoted = LINK.replace("'", "''")
    fold = f"translate({{0}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    rule_case, verdict_case = "CASE", "CASE"
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, path = text[: text.index("/")], text[text.index("/") :]
        fits = f"((host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{path}'))"
        rule_case += f" WHEN {fits} THEN '{text}'"
        verdict_case += f" WHEN {fits} THEN '{what}'"
    steps = [
        "cut AS MATERIALIZED (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages)",
        f"split AS MATERIALIZED (SELECT page_id, html, {fold.format(chr(39).join(['regexp_extract(tail, ', '^[^/?#]*', ')']))} AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)",
        f"ruled AS MATERIALIZED (SELECT *, {rule_case} END AS rule, {verdict_case} END AS decided FROM split)",
        f"links AS MATERIALIZED (SELECT host AS src, {fold.format('unnest(regexp_extract_all(html, ' + chr(39) + quoted + chr(39) + ', 1))')} AS dst FROM ruled)",
        "edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
        "graph AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM edges)",
        "seeds AS MATERIALIZED (SELECT host, avg(CASE WHEN decided = 'allow' THEN 1.0 ELSE 0 END) AS good, avg(CASE WHEN decided = 'block' THEN 1.0 ELSE 0 END) AS bad FROM ruled WHERE host <> '' GROUP BY 1)",
        f"s0 AS MATERIALIZED (SELECT host, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, {1 - damping} * coalesce(good, 0) AS trust, {1 - damping} * coalesce(bad, 0) AS distrust "
        "FROM seeds FULL JOIN (SELECT src AS host FROM graph UNION SELECT dst FROM graph) USING (host))",
    ]
    for i in range(rounds):
        steps.append(
            f"s{i + 1} AS MATERIALIZED (SELECT host, good, bad, {1 - damping} * good + {damping} * coalesce(f.x, 0) AS trust, {1 - damping} * bad + {damping} * coalesce(b.x, 0) AS distrust FROM s{i} "
            f"LEFT JOIN (SELECT g.dst AS host, sum(s.trust * g.forth) AS x FROM graph g JOIN s{i} s ON s.host = g.src GROUP BY 1) f USING (host) "
            f"LEFT JOIN (SELECT g.src AS host, sum(s.distrust * g.back) AS x FROM graph g JOIN s{i} s ON s.host = g.dst GROUP BY 1) b USING (host))"
        )
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.decided, CASE WHEN s.distrust > s.trust AND s.distrust >= {BLOCK_FROM} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN s{rounds} s USING (host)"""
    )
