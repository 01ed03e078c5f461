"""Text functions against plain Python on hand-written and generated cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linkloom.functions import answers, domains, text
from linkloom.functions.links import find_links

random.seed(7)


def column(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expr(F.col("v")).alias("o"))
    return [r["o"] for r in sorted(df.collect(), key=lambda r: r["i"])]


SPACES = [" ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　"]


def scribble(pieces, n=300, size=12):
    return ["".join(random.choice(pieces) for _ in range(random.randint(0, size))) for _ in range(n)]


def test_strip_and_words(spark):
    cases = scribble([*SPACES, "a", "Ж", ".", '"'])
    assert column(spark, cases, text.strip) == [c.strip() for c in cases]
    assert column(spark, cases, text.word_count) == [len(c.split()) for c in cases]
    assert column(spark, cases, lambda c: text.strip_marks(c, '".')) == [c.strip().strip('".') for c in cases]


def test_lines(spark):
    cases = scribble(["a", "b", "\r\n", "\n", "\r", "\x0b", "\x0c", "\x1d", "\x85", " "])
    got = column(spark, cases, lambda c: F.filter(text.lines(c), lambda x: x != ""))
    assert got == [[x for x in c.splitlines() if x] for c in cases]


def test_rounding(spark):
    cases = [0.35, 48.25, 2.675, 0.25, 1 / 3, 99.95, 0.05, 1.0, 0.0]
    cases += [k / 200 for k in range(2000)] + [random.random() * 100 for _ in range(2000)]
    for digits in (1, 4):
        got = column(spark, cases, lambda c, d=digits: text.round_half_even(c, d), "double")
        assert got == [round(c, digits) for c in cases]


LINK = re.compile(r"https?://[^\s|<>\"'`]+")


def links_in_python(value):
    return [re.sub(r"[.,;!?)]+$", "", u) for u in LINK.findall(value)]


def test_links(spark):
    cases = [
        "(https://a.com/x).",
        "https://b.com\xa0tail",
        "https://a.com/w_(x)",
        "see http://x.org/a?b=1&c=2#d, `https://q.io`|https://r.io<https://s.io>",
        "https://...",
    ]
    cases += scribble(["https://", "http://", "a.b", "/", ")", ".", ",", "|", "<", "'", "`", "Ж", *SPACES], 400, 20)
    assert column(spark, cases, find_links) == [links_in_python(c) for c in cases]
    assert column(spark, cases[:3], find_links) == [["https://a.com/x"], ["https://b.com"], ["https://a.com/w_(x"]]


def test_domains(spark):
    url = ["https://WWW.Habr.com:8080/a", "https://www.a.com?x=www.b", "https://[::1]:80/x", "http://u:p@Www.x.рф/y"]
    assert column(spark, url, domains.norm_domain) == ["habr.com:8080", "a.com", "[::1]:80", "u:p@www.x.рф"]
    assert column(spark, url, domains.rule_domain)[0] == "WWW.Habr.com:8080"
    assert column(spark, url, domains.report_domain)[:2] == ["WWW.Habr.com:8080", "a.com?x=b"]


def test_like(spark):
    rows = ["Hello World", "50% off", "a\\b", "ПРИВЕТ", None]
    assert column(spark, rows, lambda c: text.like_anywhere(c, "hello w")) == [True, False, False, False, None]
    assert column(spark, rows, lambda c: text.like_anywhere(c, "0%off")) == [False, True, False, False, None]
    assert column(spark, rows, lambda c: text.like_anywhere(c, "h_llo")) == [True, False, False, False, None]
    assert column(spark, rows, lambda c: text.like_anywhere(c, "A\\B")) == [False, False, True, False, None]
    assert column(spark, rows, lambda c: text.like_anywhere(c, "привет")) == [False, False, False, False, None]


NAMES = ["cat1", "cat2", "cat3", "cat4", "Данные и аналитика", "SaaS"]


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame([(i, n, "s", i) for i, n in enumerate(NAMES)], "id long, name string, section string, sort_order long")


def normal_in_python(raw):
    known = {n.lower(): n for n in NAMES}
    marks = "\"'.,;:-"
    tries = [raw.strip().strip(marks)]
    bold = re.search(r"\*\*(.+?)\*\*", raw)
    tries += [bold.group(1).strip().strip(marks)] if bold else []
    named = re.search(r"(?:категория|катерия|category)\s*[:—–-]\s*(.+)", raw, re.IGNORECASE)
    tries += [named.group(1).strip().strip(marks + "*")] if named else []
    tries += [line.strip().strip(marks + "*") for line in raw.splitlines()]
    return next((known[t.lower()] for t in tries if t.lower() in known), None)


def test_normalize(spark, taxonomy):
    from linkloom.operators.classify import normalized

    cases = ["**Nope** Category: cat1", "cat1 and cat2", "", "x\n *SAAS*\ny", "КАТЕГОРИЯ —\n данные И аналитика."]
    parts = ["cat1", "CAT2", "saas", "Category", "категория", ":", " — ", "**", "*", "\n", " ", ".", '"', "junk", "\x1c"]
    cases += scribble(parts, 600, 8)
    df = spark.createDataFrame(list(enumerate(cases)), "i int, raw string")
    got = {r["i"]: r["category"] for r in normalized(df, taxonomy).collect()}
    assert [got[i] for i in range(len(cases))] == [normal_in_python(c) for c in cases]
    assert [got[i] for i in range(5)] == ["cat1", None, None, "SaaS", "Данные и аналитика"]


def test_numbered(spark, taxonomy):
    from linkloom.operators.classify import parsed_batches

    cases = [("1. cat1\n3) cat2\n9. cat3\n1. cat4\n1. junk", 3), ("", 2), ("2.cat1\n 2. **cat2** ", 2), ("99999999999. cat1\n1) cat3", 1)]
    df = spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(cases)], "i int, raw string, n int")
    got = {}
    for r in parsed_batches(df, taxonomy).collect():
        got.setdefault(r["i"], {})[r["item"]] = r["category"]
    assert got == {0: {1: "cat4", 2: None, 3: "cat2"}, 1: {1: None, 2: None}, 2: {1: None, 2: "cat2"}, 3: {1: "cat3"}}


def test_valid_tags(spark):
    cases = ["sorry, no", "a b c d e", "x" * 41, "URL: x", "Data", "x" * 40, "my web page", "HTTP stuff"]
    assert column(spark, cases, answers.is_valid_tag) == [False, False, False, False, True, True, False, False]
