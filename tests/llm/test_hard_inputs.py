"""Pages of any markup, ids that are missing, repeat or are of other types."""

import collections
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import html_extract, mixing, vector_search, warc
from millrace.llm.common import table

PLAIN = html_extract.Weights({}, {})


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000,
        '<a x=">"' * 130_000,
        '<a x=">"' * 130_000 + 'x="',
        '<a "' * 250_000 + ">",
        "<!" * 500_000,
        "<!--" * 250_000,
        "<b>" * 300_000,
        "<li><ul>" + "<b>" * 150_000 + "<li></li>" * 60_000,
        "</b>" * 250_000,
        "<script " * 130_000,
        '<p id="content-' + "content-" * 120_000 + '">',
    ],
)
def test_a_megabyte_of_odd_markup_takes_linear_time(page):
    start = time.process_time()
    assert html_extract.extract(page, PLAIN) == ""
    assert time.process_time() - start < 8  # quadratic forms take minutes to hours


def test_very_long_article():
    body = " ".join(f"word{i}" for i in range(200_000))
    assert html_extract.extract(f"<nav>menu</nav><article><p>{body}</p></article>", PLAIN) == body


def test_broken_tags_leave_no_markup():
    of = lambda page: html_extract.extract(page, PLAIN)
    assert of('<p title="foo>text') == "text"
    assert of('<p>one <img alt="a > b"> two <a href=x"y>three</a> four < five') == "one two three four < five"
    assert of("<p>a text that is cut off <a href='x") == "a text that is cut off"
    assert of("<p>a text that is cut off </") in ("a text that is cut off </", "a text that is cut off")
    assert of("") == "" and of("<>") in ("", "<>")


def test_articles_are_found_without_their_marks(spark, sf):
    pages = [r["html"] or "" for r in table(spark, sf, "pages").select("html").collect()]
    weights = html_extract.Weights(*html_extract.learn(html_extract.items(p) for p in pages[::2]))
    scores = []
    for page in pages[1::2]:
        want = collections.Counter(html_extract.extract(page, weights).split())
        bare = re.sub(r"</?(?:article|main)\b[^>]*>", "", page)
        got = collections.Counter(html_extract.extract(bare, weights).split())
        scores.append(2 * sum((want & got).values()) / max(1, want.total() + got.total()))
    assert np.mean(scores) > 0.95


def test_sample_bound_never_chooses_nothing():
    assert html_extract.sample_bound(4000, 10) == html_extract.HASHES - 1
    for n in (10**4, 10**9, 5 * 10**9, 10**13):
        share = html_extract.sample_bound(4000, n) / html_extract.HASHES
        assert share == pytest.approx(4000 / n, rel=1e-6)


def test_pages_of_odd_tables(spark):
    rows = [(None, None, "<p>the same text here</p>", 1), (None, None, "<p>the same text here</p>", 1), (3, "u", None, 2)]
    pages = spark.createDataFrame(rows, "page_id smallint, url string, html string, n_chars int")
    got = sorted((r["text"], r["n_chars"]) for r in html_extract.extracted(pages).collect())
    assert got == [("", 0), ("the same text here", 18), ("the same text here", 18)]


def test_mix_without_ids_meets_targets(spark):
    docs = spark.range(30000).selectExpr(
        "CAST(IF(id % 2 = 0, NULL, 7) AS long) AS doc_id", "concat('s', id % 3) AS source", "concat(id, ' b c d') AS text"
    )
    by = mixing.mixed(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    for r in by:
        assert r["taken"] == pytest.approx(r["target"], rel=0.03)
    again = [mixing.mixed(docs).agg(F.sum(F.col("taken") * F.col("size"))).first()[0] for _ in range(2)]
    assert again[0] == again[1]


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string", "decimal(20,0)"])
def test_archives_keep_the_type_of_ids(spark, kind):
    long = "x" * 1200
    rows = [("1", "u", long), ("2", "u", long), (None, None, None), ("3", "v", "short")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    pages = pages.selectExpr(f"CAST(page_id AS {kind}) AS page_id", "url", "html", "1 AS length", "2 AS archive")
    found = warc.archived(pages)
    assert found.schema["page_id"].dataType == found.schema["refers_to"].dataType == pages.schema["page_id"].dataType
    text = lambda x: None if x is None else str(x)
    got = {text(r["page_id"]): (r["record_type"], text(r["refers_to"]), r["payload_bytes"]) for r in found.collect()}
    assert got == {
        "1": ("revisit", "2", 1200),
        "2": ("response", None, 1200),
        None: ("response", None, 0),
        "3": ("response", None, 5),
    }


def test_vectors_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [2.0, 0.0], 2), (51, [3.0, 0.0], 3), (50, [2.0, 0.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, `row` int")
    got = collections.Counter(
        (r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.searched(df).collect()
    )
    whole = [(i, 256 * int(v[0])) for i, v, _ in rows]
    want = collections.Counter()
    for at, (i, x) in enumerate(whole):
        if i % 50 == 0:
            others = sorted(((-x * y, j) for k, (j, y) in enumerate(whole) if k != at))
            want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(others[:5]))
    assert got == want
