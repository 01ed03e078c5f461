"""DuckDB SQL that states what the operators on words compute, by plain joins over all windows."""

from __future__ import annotations

import string

from linkloom.llm import decontaminate, licenses, mixing, nearcopies, quality, substrings

_SPACED = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _folded(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def decontamination(window: int = decontaminate.WINDOW) -> str:
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_folded('text')} AS w FROM documents),
i AS MATERIALIZED (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_folded('text')} AS w FROM benchmark),
grams AS MATERIALIZED (SELECT DISTINCT item, least(len(w), {window}) AS n, array_to_string(w[s:s + least(len(w), {window}) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
hits AS MATERIALIZED (SELECT p.r, p.s, p.n, grams.item FROM places p JOIN grams USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""


def similarity_join(size: int = nearcopies.SHINGLE, threshold: float = nearcopies.THRESHOLD) -> str:
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[s:s + {size - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE c / (a.n + b.n - c) >= CAST({threshold} AS DOUBLE)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE x = c.doc_id) AS n_links FROM classes c"""


def substring_dedup(window: int = substrings.WINDOW, whole: bool = False) -> str:
    """``whole`` returns the words that are left instead of their hash."""
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {_SPACED} AS w FROM documents),
places AS MATERIALIZED (SELECT doc_id, s, array_to_string(w[s:s + {window - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS s FROM d)),
firsts AS (SELECT g, min(doc_id) AS doc, arg_min(s, (doc_id, s)) AS first FROM places GROUP BY g),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(s, s + {window})) AS p FROM places JOIN firsts USING (g) WHERE doc_id <> doc OR s <> first),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed, {'coalesce(kept, $$$$) AS kept' if whole else "sha256(coalesce(kept, '')) AS kept_sha256"}
FROM d LEFT JOIN kept USING (doc_id)"""


def license_scan() -> str:
    gram = licenses.GRAM
    texts = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"('{label}', '{' '.join(words)}', {len(words)})" for label, words in licenses.PHRASES.items())
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_folded('text')} AS w FROM documents),
phrases AS (SELECT * FROM (VALUES {phrases}) t(label, phrase, n)),
starts AS MATERIALIZED (SELECT r, label, s - 1 AS p FROM (SELECT r, w, label, phrase, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, phrases) WHERE array_to_string(w[s:s + n - 1], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM starts GROUP BY r),
t AS MATERIALIZED (SELECT id, label, {_folded('body')} AS w FROM (VALUES {texts}) v(id, label, body)),
grams AS (SELECT id, s, array_to_string(w[s:s + {gram - 1}], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - {gram - 2})) AS s FROM t)),
places AS (SELECT r, s, array_to_string(w[s:s + {gram - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {gram - 2})) AS s FROM d)),
votes AS MATERIALIZED (SELECT p.r, g.id, p.s - g.s AS diagonal, g.s AS position FROM places p JOIN grams g USING (g)),
apart AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, id ORDER BY diagonal) <= {licenses.SLACK} THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT r, id, diagonal FROM votes)),
spans AS (SELECT *, sum(new) OVER (PARTITION BY r, id ORDER BY diagonal) AS span FROM apart),
covers AS (SELECT r, id, span, count(DISTINCT p) AS covered FROM (SELECT r, id, span, unnest(range(position, position + {gram})) AS p FROM votes JOIN spans USING (r, id, diagonal)) GROUP BY ALL),
reaches AS (SELECT r, id, span, min(diagonal + position) AS lo, max(diagonal + position) + {gram} AS hi FROM votes JOIN spans USING (r, id, diagonal) GROUP BY ALL),
scores AS MATERIALIZED (SELECT r, id, span, lo, hi, len(t.w) AS size, covered / (len(t.w) + greatest(0, hi - lo - covered)) AS score FROM covers JOIN reaches USING (r, id, span) JOIN t USING (id)),
claims AS (SELECT r, unnest(range(lo, hi)) AS word, {{'score': score, 'size': size, 'early': -id, 'nearer': -span, 'lo': lo, 'hi': hi}} AS claim FROM scores WHERE score >= CAST({licenses.COVERED} AS DOUBLE)),
won AS (SELECT r, claim, count(*) AS n FROM (SELECT r, word, max(claim) AS claim FROM claims GROUP BY ALL) GROUP BY ALL HAVING 2 * count(*) >= claim.hi - claim.lo),
named AS (SELECT DISTINCT r, label FROM starts UNION SELECT won.r, t.label FROM won JOIN t ON t.id = -won.claim.early)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM starts x WHERE x.r = d.r)), '') AS base_labels,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM named x WHERE x.r = d.r), '') AS labels,
  round(coalesce((SELECT max(score) FROM scores x WHERE x.r = d.r), 0), 6) AS score FROM d LEFT JOIN base USING (r)"""


def quality_rules() -> str:
    """The label model in SQL: one pair of steps per round, over the counts of vote patterns."""
    wordy = "regexp_matches({}, '[^\\x20\\x09-\\x0D]')"
    vote = "CASE WHEN {} THEN -1 WHEN {} THEN 1 ELSE 0 END"
    votes = {
        "symbols": vote.format("10 * n_symbols > n_words", "n_words > 0 AND 50 * n_symbols <= n_words"),
        "density": vote.format("20 * n_symbols > word_chars", "n_words > 0 AND 100 * n_symbols <= word_chars"),
        "repeats": vote.format("5 * n_repeat_words > n_words", "n_words > 0 AND 20 * n_repeat_words <= n_words"),
        "lines": vote.format("5 * n_dup_lines > n_lines", "n_lines > 2 AND 10 * n_dup_lines <= n_lines"),
        "capitals": vote.format("10 * n_capitals > 3 * n_letters", "n_letters > 0 AND 10 * n_capitals <= n_letters"),
        "shouts": vote.format("10 * n_shouts > 3 * n_words", "n_words > 0 AND 20 * n_shouts <= n_words"),
        "word_length": vote.format("10 * word_chars < 44 * n_words OR 10 * word_chars > 60 * n_words", "n_words > 0 AND 10 * word_chars BETWEEN 46 * n_words AND 56 * n_words"),
        "closed_lines": vote.format("n_lines > 0 AND 10 * n_closed < 9 * n_lines", "n_lines > 0 AND 100 * n_closed >= 98 * n_lines"),
    }
    listed = ", ".join(votes[r] for r in quality.RULES)
    failed = f"n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words"
    (bad, good), texts, start = quality.PRIOR, quality.PRIOR_TEXTS, quality.PRIOR_SHARE
    outcomes = ", ".join(f"({o}, CAST({b} AS DOUBLE), CAST({g} AS DOUBLE))" for o, b, g in zip(quality.OUTCOMES, bad, good, strict=True))
    steps = [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_SPACED} AS w FROM documents)",
        "triples AS MATERIALIZED (SELECT r, s, w[s:s + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM d))",
        "again AS (SELECT r, s FROM triples SEMI JOIN (SELECT r, g FROM triples GROUP BY ALL HAVING count(*) > 1) USING (r, g))",
        "repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([s, s + 1, s + 2]) AS p FROM again) GROUP BY r)",
        f"""lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (regexp_matches(line, '[.!?:;"'')][\\x20\\x09-\\x0D]*$')) AS closed
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE {wordy.format('line')} GROUP BY r)""",
        """counts AS MATERIALIZED (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
  coalesce(l.closed, 0) AS n_closed, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(text, '!')) AS n_shouts
  FROM d LEFT JOIN lines l USING (r) LEFT JOIN repeated p USING (r))""",
        f"voted AS MATERIALIZED (SELECT *, [{listed}] AS votes FROM counts)",
        f"patterns AS MATERIALIZED (SELECT votes, count(*) FILTER (NOT ({failed})) AS n FROM voted GROUP BY 1)",
        "cast_votes AS MATERIALIZED (SELECT votes, n, unnest(votes) AS v, generate_subscripts(votes, 1) AS rule FROM patterns)",
        f"grid AS MATERIALIZED (SELECT rule, v, b, g FROM (SELECT unnest(range(1, {len(quality.RULES) + 1})) AS rule), (VALUES {outcomes}) o(v, b, g))",
        "t0 AS MATERIALIZED (SELECT rule, v, b AS bad, g AS good FROM grid)",
        f"s0 AS (SELECT CAST({start} AS DOUBLE) AS share)",
    ]

    def posterior(k: int) -> str:
        return f"""p{k} AS MATERIALIZED (SELECT votes, any_value(n) AS n, 1 / (1 + exp(ln(1 - any_value(share)) - ln(any_value(share)) + sum(ln(bad) - ln(good)))) AS p
  FROM cast_votes JOIN t{k} USING (rule, v), s{k} GROUP BY votes)"""

    for k in range(quality.ROUNDS):
        steps.append(posterior(k))
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT (sum(n * p) + {start * texts}) / (sum(n) + {texts}) AS share, sum(n * (1 - p)) AS bads, sum(n * p) AS goods FROM p{k})")
        steps.append(f"""t{k + 1} AS MATERIALIZED (SELECT rule, v, (coalesce(x, 0) + {texts} * b) / (bads + {texts}) AS bad, (coalesce(y, 0) + {texts} * g) / (goods + {texts}) AS good
  FROM grid LEFT JOIN (SELECT rule, v, sum(c.n * (1 - p)) AS x, sum(c.n * p) AS y FROM cast_votes c JOIN p{k} USING (votes) GROUP BY ALL) USING (rule, v), s{k + 1})""")
    steps.append(posterior(quality.ROUNDS))
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, round(p, 9) AS quality, NOT ({failed}) AND round(p, 9) >= {quality.KEEP_FROM} AS kept
FROM voted JOIN p{quality.ROUNDS} USING (votes)"""


def pipeline() -> str:
    """The five stages, each of the statements above over what the stage before has kept."""

    def over(sql: str, table: str) -> str:
        return sql.replace("FROM documents", f"FROM {table}")

    return f"""WITH stage1 AS MATERIALIZED (SELECT d.* FROM documents d JOIN ({quality_rules()}) q USING (doc_id) WHERE q.kept),
stage2 AS MATERIALIZED (SELECT d.* FROM stage1 d JOIN ({over(similarity_join(), "stage1")}) j USING (doc_id) WHERE j.class_id = d.doc_id),
stage3 AS MATERIALIZED (SELECT d.doc_id, CASE WHEN c.n_removed > 0 THEN c.kept ELSE d.text END AS text, d.lang, d.source
  FROM stage2 d JOIN ({over(substring_dedup(whole=True), "stage2")}) c USING (doc_id) WHERE c.n_removed = 0 OR c.n_removed < c.n_words),
stage4 AS MATERIALIZED (SELECT d.* FROM stage3 d JOIN ({over(decontamination(), "stage3")}) h USING (doc_id) WHERE NOT h.contaminated)
SELECT d.doc_id, d.text, d.lang, d.source, length(d.text) AS n_chars, m.n_tokens, m.topic, m.weight, m.probability
FROM stage4 d JOIN ({mixing.oracle(documents="stage4")}) m USING (doc_id) WHERE m.sampled"""


def conversation_repair() -> str:
    """CRC-32 bit by bit, backward costs and the least trace as two recursions over the rows of a conversation."""
    crc = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
    kept = lambda initials: " ".join(f"WHEN initial = '{i}' THEN late + c.{to}" for i, to in initials.items())
    best = lambda state, initials, given: f"least(3 + c.{state}, CASE WHEN fault IN (1, 2) THEN 99 + c.{state} ELSE least(2 + late + c.{given}, CASE {kept(initials)} ELSE 2 + late + c.{given} END) END) AS g_{state}"
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (SELECT *, {crc} % 20 AS kind FROM raw),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), md5(text)) AS i,
  dense_rank() OVER (ORDER BY conv_id) AS k FROM damaged),
faulty AS MATERIALIZED (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS earlier,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault FROM placed),
sizes AS (SELECT k, any_value(conv_id) AS conv_id, max(i) AS n FROM faulty GROUP BY 1),
rows_ AS MATERIALIZED (SELECT k, i, role, text, initial, fault, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS late FROM faulty),
costs AS (SELECT k, n + 1 AS i, CAST(0 AS BIGINT) AS o, CAST(4 AS BIGINT) AS s, CAST(2 AS BIGINT) AS u, CAST(0 AS BIGINT) AS a FROM sizes
  UNION ALL SELECT k, i, least(g_o, 2 + g_u, 4 + g_a), least(g_s, 2 + g_u, 4 + g_a), least(g_u, 2 + g_a), least(g_a, 2 + g_u)
  FROM (SELECT r.k, r.i, {best("o", {"s": "s", "u": "u"}, "u")}, {best("s", {"u": "u"}, "u")}, {best("u", {"a": "a"}, "a")}, {best("a", {"u": "u"}, "u")}
    FROM costs c JOIN rows_ r ON r.k = c.k AND r.i = c.i - 1)),
grid AS MATERIALIZED (SELECT c.k, c.i, [c.o, c.s, c.u, c.a] AS here, [d.o, d.s, d.u, d.a] AS next, r.role, r.text, r.initial, r.fault, r.late
  FROM costs c LEFT JOIN costs d ON d.k = c.k AND d.i = c.i + 1 LEFT JOIN rows_ r ON r.k = c.k AND r.i = c.i),
traced AS (SELECT k, CAST(1 AS BIGINT) AS i, 1 AS state, '' AS audit, CAST([] AS VARCHAR[]) AS said, false AS ended FROM sizes
  UNION ALL SELECT k, CASE WHEN edit = 'I' OR edit = '' THEN i ELSE i + 1 END,
    CASE edit WHEN 'D' THEN state WHEN '' THEN state WHEN 'K' THEN to_state ELSE given END, audit || edit,
    CASE edit WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'I' THEN list_append(said, name || ':') WHEN 'R' THEN list_append(said, name || ':' || text) ELSE said END, edit = ''
  FROM (SELECT *, CASE WHEN role IS NULL THEN CASE WHEN state IN (1, 4) THEN '' ELSE 'I' END WHEN 3 + next[state] = here[state] THEN 'D'
      WHEN 2 + here[given] = here[state] THEN 'I' WHEN fault NOT IN (1, 2) AND to_state > 0 AND late + next[to_state] = here[state] THEN 'K' ELSE 'R' END AS edit
    FROM (SELECT t.k, t.i, t.state, t.audit, t.said, g.* EXCLUDE (k, i), [3, 3, 4, 3][t.state] AS given, CASE WHEN t.state = 3 THEN 'assistant' ELSE 'user' END AS name,
      CASE WHEN t.state = 1 AND initial = 's' THEN 2 WHEN t.state <> 3 AND initial = 'u' THEN 3 WHEN t.state = 3 AND initial = 'a' THEN 4 ELSE 0 END AS to_state
      FROM traced t JOIN grid g ON g.k = t.k AND g.i = t.i WHERE NOT t.ended))),
counts AS (SELECT k, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1),
done AS (SELECT s.conv_id, c.*, f.o AS cost, t.audit, sha256(array_to_string(t.said, chr(10))) AS repaired_sha256
  FROM sizes s JOIN counts c USING (k) JOIN (SELECT * FROM traced WHERE ended) t USING (k) JOIN (SELECT k, o FROM costs WHERE i = 1) f USING (k))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id"""
