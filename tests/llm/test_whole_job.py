"""What a sample, a limit or an early drop must not change."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import html_extract, quality_model, token_counts, toxicity
from millrace.llm.common import table


# --- classifiers: frequent classes beyond the sample ---------------------------------


def test_quality_prior_of_all_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    whole, capped = quality_model.fit(docs, labels), quality_model.fit(docs, labels, 20)
    assert abs(whole.log_prior) > 0.5
    assert capped.log_prior == pytest.approx(whole.log_prior)
    few = quality_model.fit(docs, labels, 1)  # no covariance of one row
    n = math.exp(whole.log_prior)
    assert few.constant == pytest.approx(n / (1 + n), abs=0.01)


def test_toxicity_rows_stand_for_their_class():
    rng = np.random.default_rng(5)
    votes = (rng.random((120, 6)) < 0.25).astype(float)
    start, of = rng.random(120), rng.integers(1, 5, 120)
    many = np.repeat(np.arange(120), of)
    one, all_ = toxicity.fit_label_model(votes, start, stands_for=of), toxicity.fit_label_model(votes[many], start[many])
    assert one.posterior(votes) == pytest.approx(all_.posterior(votes))
    p = one.posterior(votes)
    assert toxicity.fit_linear(votes, p, stands_for=of) == pytest.approx(toxicity.fit_linear(votes[many], p[many]))


def test_toxicity_of_a_capped_sample(spark, monkeypatch):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    used = {}
    real = toxicity.fit_linear

    def seen(x, p, **more):
        used["share"] = more["stands_for"]
        return real(x, p, **more)

    monkeypatch.setattr(toxicity, "fit_linear", seen)
    toxicity.fit(docs, labels, {1: 100, 0: 100})
    every = toxicity.class_counts(docs, labels, "toxic", toxicity.FOLDS, toxicity.FOLD)
    assert every[0] > 5 * every[1] > 500
    assert used["share"].sum() == pytest.approx(every[0] + every[1])
    assert sorted(set(used["share"])) == pytest.approx([every[1] / 100, every[0] / 100])


# --- HTML: names that only look like boilerplate -------------------------------------

BODY = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize(
    "before, after",
    [
        ("<div class='content-sidebar-wrap'>", "</div>"),
        ("<div class='page has-sidebar'>", "</div>"),
        ("<div class='page comments-open' id=no-nav>", "</div>"),
        ("<form action='./'><div>", "</div></form>"),
        ("<form action='./'><div><article>", "</article></div></form>"),
        ("<div class='widget'><main>", "</main></div>"),
        ("<div class='site-header-page'><div class='share'>Share this</div>", "</div>"),
        ("<article class='post has-comments'>", "</article>"),
    ],
)
def test_extract_in_wrappers(before, after):
    page = (
        f"<html><body><nav><a>Home</a></nav>{before}<h1>Title</h1><p>{BODY}</p><div class=ad><p>Buy now</p></div><p>End of it after some more words that close the text</p>{after}"
        "<div class='sidebar'><p>More of this</p></div><div id='comments'><article><p>One says much of it</p></article></div></body></html>"
    )
    for w in (html_extract.Weights({}, {}), html_extract.Weights(*html_extract.learn([html_extract.items(page)]))):
        assert html_extract.extract(page, w) == f"Title {BODY} End of it after some more words that close the text"


def test_extract_leaves_real_blocks():
    talk = "<p>" + "a reader says something " * 60 + "</p>"
    for block in (f"<div class='comment-list'><article>{talk}</article></div>", f"<aside><article>{talk}</article></aside>", f"<div class=sidebar>{talk}</div>"):
        page = f"<body><div class=text><p>{BODY}</p></div>{block}</body>"
        assert html_extract.extract(page, html_extract.Weights({}, {})) == BODY


# --- tokens: parts without a space ---------------------------------------------------


def test_counts_inside_long_parts(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    texts = [
        "日本語の文章は空白なしで続く。" * 20,
        "กินข้าวแล้วหรือยัง" * 15,
        "one\tTwo's\u00a0three\u3000" * 12,
        "thequickbrownfox" * 20,
        "e\u0301a\u0323\u0302" * 40 + "\u1112\u1161\u11ab" * 20,
        "ab<|endoftext|>日本'll" * 12,
        "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" * 6,
        "!?'re''s" * 30,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = token_counts.prefix_counts(docs)
    asked = counted.select("*", token_counts.count_at(F.col("steps"), 77).alias("at"), token_counts.longest_prefix(F.col("steps"), 20).alias("cut"))
    rows = asked.collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        want = [len(e.ids) for e in tok.encode_batch([text[: i + 1] for i in range(len(text))], add_special_tokens=False)]
        assert np.cumsum(r["steps"]).tolist() == want
        assert (r["n_tokens"], r["at"]) == (want[-1], want[76])
        assert r["cut"] == max(i + 1 for i, n in enumerate(want) if n <= 20)
