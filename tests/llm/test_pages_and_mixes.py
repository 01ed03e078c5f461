"""URL filters, main texts, mixing, languages and archives."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from cases import ordered, rows_of
from oracle import connect, differences
from pyspark.sql import functions as F

from linkloom.llm import catalog, language, mixing, urlfilter, warc, wrappers

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    assert differences(catalog.queries()[name](spark, sf_dir), duck, catalog.oracles()[name]) == []


# URL filters

LINKS = [
    (1, "https://a.net/x", '<a href="https://b.example.com/1">b</a>'), (2, "HTTP://B.Example.COM/de/2?x#y", None),
    (3, "https://b.example.com/en/3", '<a href = \'//A.net/\'>'), (4, "https://c.org/fr/1", '<a href=http://d.com>d</a><a href="/local">'),
    (5, "https://d.com", ""), (6, None, '<a href="https://a.net">'), (7, "no scheme", "x"), (8, "https://www.example.net/en/a", "y"),
    (9, "https://example.net/fr/a", None), (10, "https://notexample.net.com/en/", None), (11, "https://only.com/links", '<a href="http://a.net/z">'),
    (11, "https://only.com/links", '<a href="http://a.net/z">'), (12, "ftp://net/", None), (13, "https://x.net?q", None), (None, "http://e.com/a://b", "🙂"),
]


def test_url_filter_on_awkward_pages(spark):
    pages = spark.createDataFrame(LINKS, PAGES).withColumns({"host": F.lit("mine"), "rule": F.lit("mine")})
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", LINKS)
    got = urlfilter.judge(pages)
    assert differences(got, con, urlfilter.oracle()) == []
    verdicts = {(r["page_id"], r["host"]): r["verdict"] for r in got.collect()}
    assert verdicts[11, "only.com"] == "block"  # it links to nothing but a blocked host
    assert verdicts[5, "d.com"] == verdicts[None, "e.com"] == verdicts[6, ""] == "allow"
    assert verdicts[1, "a.net"] == "block" and verdicts[8, "www.example.net"] == "allow"


def test_scores_spread_until_no_verdict_can_turn(spark):
    """Two hosts that link to each other: the distrust of the second is 0.07501 in the end, but 0.0721 after 20 rounds."""
    a = [(i, f"https://www.example.com/{'de' if i < 8 else 'en'}/{i}", '<a href="https://b.io/">b</a>') for i in range(49)]
    # A hot host that all others link to, and a ring without seeds.
    ring = [(200 + i, f"https://r{i}.io/", f'<a href="https://r{(i + 1) % 30}.io/">r</a><a href="https://hub.io/">hub</a>') for i in range(30)]
    pages = spark.createDataFrame([*a, (100, "https://b.io/", '<a href="https://www.example.com/">a</a>'), *ring, (300, "https://hub.io/", "")], PAGES)
    verdicts = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages).collect()}
    assert verdicts[100] == "block" and all(verdicts[i] == "allow" for i in (300, *range(200, 230)))


def linked_pages(seed=3):
    """Hosts with rules and without, linked at random, with cycles, loops, repeats, and one host that half of all pages are on and link to."""
    rng = random.Random(seed)
    hosts = [f"h{i}.io" for i in range(40)] + ["hot.io"] * 40 + ["www.example.com", "www.example.net", "a.net", "b.org", "sub.example.com"] * 3
    rows = []
    for i in range(400):
        links = [rng.choice(hosts) for _ in range(rng.randrange(5))]
        path = rng.choice(["/de/x", "/en/y", "/fr/", "/", "/x?y#z"])
        rows.append((i, f"https://{rng.choice(hosts)}{path}", " ".join(f'<a href="https://{h.upper() if rng.random() < 0.1 else h}/p">x</a>' for h in links)))
    return rows + [(400, None, None), (401, "no host", '<a href="https://hot.io/">x</a>'), (402, "https://hot.io/", None)]


def test_propagation_matches_plain_python_and_sql(spark, tmp_path):
    rows = linked_pages()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    df = urlfilter.judge(pages)
    host = lambda url: url.split("://", 1)[1].split("/")[0].lower() if url and "://" in url else ""
    edges, decided = {}, {}
    for r in df.collect():
        decided.setdefault(r["host"], []).append(r["rule"] and r["verdict"])
    for _, url, html in rows:
        for target in re.findall(r'href="https://([^/"]*)/', html or ""):
            if host(url) and host(url) != target.lower():
                edges[host(url), target.lower()] = edges.get((host(url), target.lower()), 0) + 1
    names = {h for e in edges for h in e} | {h for h in decided if h}
    seed = {h: [sum(v == what for v in decided.get(h, [])) / max(1, len(decided.get(h, []))) for what in ("allow", "block")] for h in names}
    sent, got = Counter(), Counter()
    for (a, b), n in edges.items():
        sent[a] += n
        got[b] += n
    d, trust, distrust = urlfilter.DAMPING, {h: 0.0 for h in names}, {h: 0.0 for h in names}
    for _ in range(300):
        trust, distrust = (
            {h: (1 - d) * seed[h][0] + d * sum(trust[a] * n / sent[a] for (a, b), n in edges.items() if b == h) for h in names},
            {h: (1 - d) * seed[h][1] + d * sum(distrust[b] * n / got[b] for (a, b), n in edges.items() if a == h) for h in names},
        )
    spread = {r["page_id"]: r["verdict"] for r in df.filter("rule IS NULL").collect()}
    want = {i: "block" if host(u) and distrust[host(u)] > trust[host(u)] and distrust[host(u)] >= urlfilter.BLOCK_FROM else "allow" for i, u, _ in rows if i in spread}
    assert spread == want and set(want.values()) == {"allow", "block"}
    pages.coalesce(1).write.parquet(str(tmp_path / "in"))
    next((tmp_path / "in").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert differences(df, connect(str(tmp_path)), urlfilter.oracle()) == []


def test_url_filter_empty_table(spark):
    assert urlfilter.judge(spark.createDataFrame([], PAGES)).count() == 0


# Main texts

PAGE = (
    "<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><div id=top-menu>Menu</div>"
    "<div class='cookie-notice'>We use cookies</div>{0}<aside>Side</aside><div class=\"comments\"><p>Nice!</p></div><form>Mail <input></form>"
    "<div class=tagline>Since 1999 &amp; on</div><footer>&copy;</footer><script>var t='</p><p>no';</script></body></html>"
)


def test_extract_reads_only_the_article():
    page = PAGE.format("<article><h1>A &lt;b&gt; c</h1><!-- <p>hidden</p> --><p><b>One\n two.<br><p>Three&nbsp;<i>f</i>our<div class=ad>Buy</div><ul><li>x<li>y</ul><p class='share'>Share</article>")
    assert wrappers.extract(page) == "A <b> c\nOne two.\nThree four\nx\ny"
    assert wrappers.extract(None) == wrappers.extract("") == wrappers.extract("<p></p>") == ""
    assert wrappers.extract("plain <b>text") == "plain text"
    assert wrappers.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert wrappers.extract("a < b <p>c<!-- open") == "a < b\nc"


def test_wrappers_leave_out_constant_texts(spark):
    rng = random.Random(1)
    bodies = ["".join(f"<p>{rng.random()} text {i}</p>" for _ in range(rng.randrange(1, 6))) for i in range(12)]
    rows = [(i, f"https://h{i % 2}.com/{i}", PAGE.format(f"<div><h2>Daily {i % 2}</h2>{b}</div>")) for i, b in enumerate(bodies)]
    rows += [(20, "https://solo.com/", PAGE.format("<div><p>Alone</p></div>")), (21, None, None), (22, "https://h0.com/c", PAGE.format("")), (None, "https://h1.com/", "")]
    rows.append(rows[0])
    got = wrappers.main_texts(spark.createDataFrame(rows, PAGES).withColumns({"text": F.lit("mine"), "host": F.lit("mine")}))
    texts = defaultdict(list)
    for r in got.collect():
        assert r["n_chars"] == len(r["text"])
        texts[r["page_id"]].append(r["text"])
    for i, b in enumerate(bodies):
        assert texts[i][0] == b.replace("<p>", "").replace("</p>", "\n").strip("\n"), i
    assert texts[0] == texts[0][:1] * 2 and texts[20] == ["Alone\nSince 1999 & on"] and texts[21] == texts[None] == [""]
    assert texts[22] == ["Since 1999 & on"]  # nothing but template is left, so it stays
    assert wrappers.main_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_alignment_matches_the_largest_common_tree():
    a = wrappers.parse("<ul><li>1</li><li>2</li></ul><p>x</p>")
    b = wrappers.parse("<ul><li>0</li><li>1</li><li>2</li></ul><h1>n</h1><p>y</p>")
    size, pairs = wrappers.align(a, b)
    assert size == 1 + 1 + 4 + 2 and len(pairs) == 3
    assert wrappers.align(a, a)[0] == size


@pytest.mark.parametrize("page, text", [
    ('<body class="right-sidebar"><article><p>a</p></article></body>', "a"), ('<html class="has-header"><body id=widget><p>a</p></body></html>', "a"),
    ('<article class="post no-comments"><p>a</p></article>', "a"), ('<main class="sidebar"><p>a</p><div class="sidebar">b</div></main>', "a"),
    ('<article><h1 class="header">a</h1><div class="article-header">b</div><div class="social">c</div><div class="related">d</div><div class="widget">e</div></article>', "a\nb\nc\nd\ne"),
    ('<div class="elementor-widget-text"><p>a</p></div><div class="site-header">b</div>', "a"), ('<div class="menu"><p>a</p></div>', "a"),
    ('<div class="menu"><article>a</article></div>', "a"),
])
def test_names_alone_lose_no_article(page, text):
    assert wrappers.extract(page) == text


@pytest.mark.parametrize(
    "comments",
    [
        '<section class="post-comments"><p>C</p></section>', '<ol class="comment-list"><li>C</li></ol>', '<div id="comments-area"><p>C</p></div>',
        '<div class="user-comments"><div>C</div></div>', '<div class="comments"><p>C</p></div>', "<article><h4>Ann</h4><p>C</p></article><article><p>C too</p></article>",
    ],
)
def test_reader_comments_go(comments):
    body = "<h1>T</h1><p>The first paragraph says more than a comment.</p><p class='no-comments'>second</p>"
    assert wrappers.extract(f"<body><article>{body}{comments}</article></body>") == "T\nThe first paragraph says more than a comment.\nsecond"


def test_leads_beside_an_article_stay():
    page = "<body><main><h1>Title</h1><div><p>Lead</p><article>Body</article></div><div>teaser</div><aside>x</aside></main></body>"
    assert wrappers.extract(page) == "Title\nLead\nBody"
    several = "<body><article><h2>All posts</h2><article><p>A whole first post.</p></article><article><p>A whole second post.</p></article></article></body>"
    assert wrappers.extract(several) == "All posts\nA whole first post.\nA whole second post."


def test_end_tags_of_deep_elements_close_nothing_else():
    for deep in (5, 160, 20_000):
        page = f"<div id=w><article>{'<div>' * deep}x{'</div>' * deep}<p>after</p></article></div><p>outside</p>"
        assert wrappers.extract(page) == "x\nafter"
        assert [n.tag for n in wrappers.parse(page).children] == ["div", "p"]
    page = f"<div id=w><article>{'<div>' * 160}x</article><p>b</p></div><p>c</p>"
    assert [n.tag for n in wrappers.parse(page).children] == ["div", "p"]


def test_suspect_names_count_together_with_a_constant_slot(spark):
    rng = random.Random(6)
    links = lambda: f"<div class='related-posts'><h3>Read on</h3><a>{rng.random()} link</a></div>"
    rows = [(i, f"https://h.com/{i}", f"<body><div class='has-sidebar'><p>Top</p><article><div class='article-header'>{i} head</div>{_notes(rng, 2 + i % 3)}{links()}</article></div></body>") for i in range(9)]
    for r in wrappers.main_texts(spark.createDataFrame(rows, PAGES)).collect():
        assert "link" not in r["text"] and r["text"].startswith(f"{r['page_id']} head") and r["text"].count("words") == 2 + r["page_id"] % 3


def test_alignment_prefers_equal_texts_and_is_exact_for_long_lists():
    a = wrappers.parse("<div><p>1</p><p>2</p><p>Notice</p></div>")
    b = wrappers.parse("<div><p>3</p><p>4</p><p>5</p><p>6</p><p>Notice</p></div>")
    size, pairs = wrappers.align(a, b)
    assert size == 1 + 7 and ["Notice", "Notice"] in [[x.text, y.text] for x, y in pairs]
    left = [f"<li>{'<b>x</b>' * (i % 3)}{i}</li>" for i in range(700)]
    right = [*left[:100], "<li><i>new</i></li>", *left[150:400], "<li><u>new</u></li>", *left[450:]]
    a, b = (wrappers.parse(f"<ul>{''.join(x)}</ul>") for x in (left, right))
    size, pairs = wrappers.align(a, b)
    assert size == b.size - 4  # of the new items only <li> has a partner
    assert sum(x.text == y.text for x, y in pairs if x.text.isdigit()) == 600


def _notes(rng, n):
    return "".join(f"<p>{rng.random()} words</p>" for _ in range(n))


def test_pages_that_differ_in_words_alone_are_aligned_once(monkeypatch):
    """What is looked up is what an alignment of the two pages gives, also with white space, repeated and equal texts."""
    calls, align = [], wrappers.align
    monkeypatch.setattr(wrappers, "align", lambda a, b, known=None: calls.append(1) or align(a, b, known))
    rng, known = random.Random(4), wrappers.Alignments()

    def page(words):
        lines = "".join(rng.choice(("<p>{}</p>", "<p><b>{}</b> </p>", "<li>{}")).format(rng.choice(words)) for _ in range(rng.randint(1, 5)))
        return wrappers.Texts(wrappers.parse(f"<nav>Menu</nav><div>{lines}</div>"))

    pages = [page(("x", "y", "Menu", f"w{i}", f"v{i}")) for i in range(60)]
    for a in pages[:6]:
        for b in pages:
            want = [(x, y) for x, y in align(a.root, b.root)[1] if x.said]
            assert [(a.nodes[i], b.nodes[j]) for i, j in known.places(a, b)] == want
    made = len(calls)
    for a in pages[:6]:
        for i in range(40):
            known.places(a, wrappers.Texts(wrappers.parse(f"<nav>Menu</nav><div><p>new{i}</p><li>other{i}</div>")))
    assert len(calls) <= made + 6


def test_constant_slots_decide_inside_landmarks(spark):
    rng = random.Random(3)
    rows = [(i, f"https://h.com/{i}", f"<body><article><h1>Title {i}</h1>{_notes(rng, 1 + i % 4)}<p>Read our terms</p></article></body>") for i in range(12)]
    for r in wrappers.main_texts(spark.createDataFrame(rows, PAGES)).collect():
        assert r["text"].split("\n")[0] == f"Title {r['page_id']}" and "terms" not in r["text"]
        assert r["text"].count("words") == 1 + r["page_id"] % 4


def test_each_layout_of_a_host_has_its_template(spark):
    rng = random.Random(4)
    many = [(i, "https://h.com/a", f"<body><div><span>Front</span></div><div>{_notes(rng, 1 + i % 4)}</div><div>Ours</div></body>") for i in range(60)]
    few = [(100 + i, "https://h.com/b", f"<body><section><div><table><tr><td>Shop menu</td><td>{_notes(rng, 4 + i % 4)}</td></tr></table></div></section><span>Call us</span></body>") for i in range(4)]
    for r in wrappers.main_texts(spark.createDataFrame(many + few, PAGES)).collect():
        assert not any(x in r["text"] for x in ("Front", "Ours", "Shop", "Call")), r
        assert r["text"].count("words") == (1 + r["page_id"] % 4 if r["page_id"] < 100 else 4 + r["page_id"] % 4)


def test_every_article_is_found(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in catalog.op4_html_extraction(spark, sf_dir).collect():
        body = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        for tag in ("h1", "p"):
            body = body.replace(f"<{tag}>", "\0").replace(f"</{tag}>", "\0")
        blocks = (" ".join(wrappers.entities.unescape(wrappers.re.sub("<[^>]*>", " ", x)).split()) for x in body.split("\0"))
        assert r["text"] == "\n".join(filter(None, blocks)) != ""


# Mixing


def test_raking_meets_the_marginals(spark):
    rng = random.Random(2)
    cells = [(f"s{i}", f"l{j}", rng.randrange(1, 10_000)) for i in range(6) for j in range(3)]
    powers = {"source": 0.3, "lang": 0.0}
    raked = mixing.rake(spark.createDataFrame(cells, "source string, lang string, tokens long"), powers, rounds=5).collect()
    total = sum(c[2] for c in cells)
    for at, (name, power) in enumerate(powers.items()):
        shares, got = defaultdict(float), defaultdict(float)
        for c in cells:
            shares[c[at]] += c[2] / total
        for r in raked:
            got[r[name]] += r["weight"]
        whole = sum(s**power for s in shares.values())
        assert all(abs(got[k] - s**power / whole) < 1e-3 for k, s in shares.items())


def test_skewed_sources_meet_the_budget(spark):
    """Many cells are full: they give all they have, the others make up for it, and what no weight can meet is named."""
    rng = random.Random(1)
    cells = [
        (f"s{i}", lang, topic, max(1, int(1e6 / (i + 1) ** 1.5 * a * b * rng.uniform(0.5, 1.5))))
        for i in range(60) for lang, a in (("en", 0.6), ("de", 0.3), ("fr", 0.1)) for topic, b in (("note", 0.1), ("article", 0.9)) if rng.random() < 0.75
    ]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    raked = mixing.rake(df, budget=0.5).collect()
    total = sum(c[3] for c in cells)
    chances = [0.5 * total * r["weight"] / r["tokens"] for r in raked]
    assert max(chances) <= 1 + 1e-9 and sum(c > 1 - 1e-9 for c in chances) > 50
    assert abs(sum(r["weight"] for r in raked) - 1) < 0.02
    missed = {(r["dimension"], r["value"]): abs(r["reached"] / r["target"] - 1) for r in mixing.unmet(df, tolerance=0.05).collect()}
    assert len(missed) <= 6 and all(off < 0.2 for off in missed.values())


def test_texts_are_not_shuffled(docs):
    plan = mixing.sample(mixing.measure(docs))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_cells_in_several_blocks(docs, monkeypatch):
    columns = ("doc_id", "n_tokens", "weight", "probability", "sampled")
    usual = rows_of(mixing.sample(mixing.measure(docs)), *columns)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    clashing = docs.withColumns({c: F.lit("mine") for c in ("_source", "_lang", "_topic", "_row", "_mix0", "_cell0", "_room")})
    blocks = mixing.sample(mixing.measure(clashing))
    assert rows_of(blocks, *columns) == usual
    assert {c for c in clashing.columns if c != "n_chars"} <= set(blocks.columns)


def test_sample_of_awkward_documents(docs, awkward, no_docs):
    clashing = docs.withColumns({c: F.lit(9.0) for c in ("weight", "probability", "n_tokens", "topic")})
    out = mixing.sample(mixing.measure(clashing)).collect()
    assert len(out) == len(awkward)
    assert all(0 <= r["probability"] <= 1 and r["sampled"] <= (r["n_tokens"] > 0) for r in out)
    assert len({(r["doc_id"], r["n_tokens"], r["sampled"]) for r in out}) == len({(r["doc_id"], r["n_tokens"]) for r in out})
    assert mixing.sample(mixing.measure(no_docs)).count() == 0


# Languages


def test_forward_pass_sums_all_segmentations(tmp_path):
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate([b" ", b"a", b"b", b"ab", b" a", b"aba"])))
    pieces = language.Pieces(str(path))
    table = np.append(np.random.default_rng(0).random((pieces.size, 2)), np.zeros((1, 2)), 0)
    names = sorted({b" ", b"a", b"b", b"ab", b" a", b"aba"} | {bytes([i]) for i in range(256)})

    def brute(rest, column):
        return 1.0 if not rest else sum(table[i, column] * brute(rest[len(p) :], column) for i, p in enumerate(names) if rest.startswith(p))

    got = language.word_scores(["abab", "b", "ababa"], pieces, table)
    assert np.allclose(np.exp(got), [[brute(b" " + w, c) for c in (0, 1)] for w in (b"abab", b"b", b"ababa")])
    counts = language.expected_pieces([b" abab"], np.array([3.0]), pieces, table[:, 0])
    assert np.isclose(sum(n * len(p) for n, p in zip(counts, names, strict=True)), 3 * 5)  # each byte is used once


def test_long_words_are_scored_whole(tmp_path, monkeypatch):
    """Byte by byte, in blocks of any size, as all short words are; over any number of bytes without underflow."""
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate([b" a", b"ab", b"aba", b"babab", "é".encode()])))
    pieces = language.Pieces(str(path))
    assert pieces.longest == 5
    table = np.append(np.random.default_rng(0).random((pieces.size, 2)) * 1e-6, np.zeros((1, 2)), 0)
    words = ["ab" * n for n in range(1, 15)] + ["é" * 9, "abéba", "x"]
    usual = language.word_scores(words, pieces, table)
    for block in (1, 3, 1000):
        monkeypatch.setattr(language, "LONG_BLOCK", block)
        assert np.allclose(np.array([language._long_score(language._spelled(w), pieces, table) for w in words]), usual)
    assert np.isfinite(language.word_scores(["ab" * 5000], pieces, table)).all()


def test_letters():
    assert language.words_of("Été ²½ ① x1y naïve cafe\u0301 हिन्दी 漢字かな İ") == ["été", "x", "y", "naïve", "cafe\u0301", "हिन्दी", "漢字かな", "i\u0307"]
    assert language.words_of("² ½ ① 12 _ \u0301") == []


def test_identification_matches_brute_force(spark, tmp_path):
    """Learning and scoring in plain Python, over a small vocabulary that is written out."""
    extra = [b" th", b"the", b" un", b"und", b"ch", b"er", b" de", b"la", b"ing", b" de la", "é".encode()]
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate(extra)))
    names = sorted(set(extra) | {bytes([b]) for b in range(256)})
    number = {p: i for i, p in enumerate(names)}
    rng = random.Random(6)
    stock = {"de": ["und", "der", "nicht", "buch"], "en": ["the", "thing", "under", "ring"], "fr": ["de", "la", "été", "chérie"]}
    rows = [(i, " ".join(rng.choices(stock[k], k=rng.randrange(1, 6))) + rng.choice(["", " 12", " Under!", " " + "la" * 30]), k if rng.random() < 0.8 else None) for i in range(60) for k in [rng.choice(sorted(stock))]]
    rows += [(70, "123 ²", "en"), (71, None, "de"), (None, "der und", "de")]

    def passes(word, chance):
        n = len(word)
        pieces = [(a, b, number[word[a:b]]) for a in range(n) for b in range(a + 1, n + 1) if word[a:b] in number]
        forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for a, b, p in sorted(pieces, key=lambda x: x[1]):
            forward[b] += forward[a] * chance[p]
        for a, b, p in sorted(pieces, key=lambda x: -x[0]):
            backward[a] += backward[b] * chance[p]
        return pieces, forward, backward

    def spelled(text):
        return [b" " + w.encode() for w in language.words_of(text)]

    crc = lambda i: zlib.crc32(str(i).encode()) % 3
    taught = {k: [w for i, t, lang in rows if i is not None and crc(i) != 1 and lang == k and t is not None for w in spelled(t) if len(w) <= 40] for k in stock}
    chances = {k: [1 / len(names)] * len(names) for k in stock}
    for _ in range(language.ROUNDS):
        for k, words in taught.items():
            sums = [language.SMOOTHING] * len(names)
            for word in words:
                pieces, forward, backward = passes(word, chances[k])
                for a, b, p in pieces:
                    sums[p] += forward[a] * chances[k][p] * backward[b] / forward[-1]
            chances[k] = [x / sum(sums) for x in sums]
    got = {(r["doc_id"], r["held_out"]): (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(path)).collect()}
    for i, text, _ in rows:
        pred, score = got[i, i is not None and crc(i) == 1]
        scores = {k: sum(math.log(passes(w, chances[k])[1][-1]) for w in spelled(text)) for k in stock}
        if not spelled(text):
            assert (pred, score) == ("und", 0)
        else:
            best = max(scores, key=scores.get)
            assert pred == best and abs(score - 1 / sum(math.exp(s - scores[best]) for s in scores.values())) < 1e-6


def test_language_of_held_out_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = catalog.op8_language_id(spark, sf_dir).join(table.select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string")).alias("crc")), "doc_id").collect()
    assert len(rows) == table.count() and all(r["held_out"] == (r["crc"] % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 20 and sum(r["lang_pred"] == r["lang"] for r in unseen) >= 0.97 * len(unseen)


def test_language_of_awkward_documents(docs, awkward, no_docs):
    out = language.identify(docs).collect()
    assert len(out) == len(awkward)
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] not in (None, 3)}
    for doc, text, *_ in awkward:
        if doc in by_id:
            assert (by_id[doc]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert not next(r for r in out if r["doc_id"] is None)["held_out"]
    assert language.identify(no_docs).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


# Archives

CAPTURES = [
    (1, "https://b.com/x", "<p>WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n\r\nsame</p>"), (2, "https://A.com/y", "<p>WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n\r\nsame</p>"), (3, None, None), (4, "https://a.com/y", ""),
    (5, "http://a.com/\r\nX: y", "été 🙂\n"), (5, "http://a.com/2", "été 🙂\n"), (None, "http://n.com", "null id"), (None, "http://n.com", ""), (9, "https://b.com/x", "z" * 300_000),
]


def test_archives_come_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = spark.createDataFrame(CAPTURES, PAGES).repartition(3).withColumns({"digest": F.lit(1), "first": F.lit(2), "value": F.lit(3)})
    warc.write(pages, str(tmp_path / "w"))
    runs = warc.read(spark, str(tmp_path / "w"))
    index = warc.merge(runs).collect()
    assert [(r["url_key"], r["captured"]) for r in index] == sorted((r["url_key"], r["captured"]) for r in index)
    data = {p.name: gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*")}
    largest = {}
    for page, _, html in CAPTURES:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    expected = []
    for page, _, html in CAPTURES:
        raw, first = (html or "").encode(), largest[html or ""]
        again = first != (-1 if page is None else page)
        expected.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert ordered([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index]) == ordered(expected)
    payloads = {p: (h or "").encode() for p, _, h in CAPTURES}
    for r in index:
        record = data[r["file"]][r["offset"] : r["offset"] + r["length"]]
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert record.endswith(b"\r\n\r\n" + payloads[r["page_id"]])


def test_ranges_hold_a_bounded_number_of_lines(spark, tmp_path, monkeypatch):
    """One URL with most captures, in many files, merged in ranges of a few lines."""
    rows = [(i, "https://hot.example/" if i % 4 else f"https://s{i}.example/", f"<p>{i}</p>") for i in range(400)]
    warc.write(spark.createDataFrame(rows, PAGES).repartition(6), str(tmp_path / "w"))
    monkeypatch.setattr(warc, "RANGE_LINES", 40)
    index = warc.merge(warc.read(spark, str(tmp_path / "w"))).withColumn("part", F.spark_partition_id())
    lines = index.collect()
    assert [(r["url_key"], r["captured"]) for r in lines] == sorted((r["url_key"], r["captured"]) for r in lines) and len(lines) == 400
    sizes = [r["count"] for r in index.groupBy("part").count().collect()]
    assert max(sizes) <= 100 and len(sizes) >= 8


def test_a_large_page_does_not_swell_its_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 50_000)
    rows = [(i, f"https://a.example/{i}", "x" * (20_000 if i % 10 == 0 else 10)) for i in range(100)]
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"))
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("part-*")]
    assert max(sizes) <= 50_000
    assert warc.merge(warc.read(spark, str(tmp_path / "w"))).count() == 100


def test_archives_reject_a_changed_payload():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 9\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse(head + b"H\r\n\r\nbody\r\n\r\n", "f"))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges_like_a_sort(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(7))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_of_an_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_base32_digests(spark):
    texts = ["", "a", "é🙂", "x" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32_sha1(F.col("t")).alias("d"))
    assert rows_of(got, "t", "d") == ordered([(t, base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()) for t in texts])
