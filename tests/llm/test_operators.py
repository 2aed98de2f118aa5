"""Each operator against a plain version of what it has to return, over small or odd tables."""

import collections
import gzip
import hashlib
import html
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import (
    html_extract,
    mixing,
    packing,
    quality_model,
    quality_rules,
    simhash,
    token_counts,
    toxicity,
    vector_search,
    warc,
)
from millrace.llm.common import table
from millrace.session import store

ODD = [
    (1, "", "en", "a"),
    (2, None, "en", None),
    (3, "one", None, "a"),
    (3, "one", None, "a"),
    (None, "one two  three\n\n four\t<|endoftext|> it's", "de", "b"),
    (7, "Größe 12,5!! 日本語 x y z \x00 end ", "de", "b"),
    (8, "word " * 3000, "en", "c"),
    (9, "x" * 5000, "en", "c"),
    (10, "a b c a b c\na b\na b\n\n \n", "fr", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double, n_words string, `copies` int"


@pytest.fixture
def odd(spark):
    rows = [(*r, 0.5, "x", 1) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def none(odd):
    return odd.filter("false")


@pytest.fixture
def small(spark, sf):
    return table(spark, sf, "documents")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# --- HTML ----------------------------------------------------------------------------


def test_extract_articles(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r["page_id"]: r for r in html_extract.extracted(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want)


def test_extract_other_layouts(spark, sf):
    body = " ".join(f"word{i}" for i in range(60))
    page = (
        '<html><body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a>Home</a></li></ul></nav>'
        f'<div class="cookie-notice"><p>We use cookies on this site</p></div><div class="content"><h1>Ti&amp;tle</h1>'
        f"<p>{body} <b>bo</b>ld</p><div class=ad><p>Buy now</p></div><p>Second  &lt;p&gt; part<br>line</p></div>"
        '<section id="comments"><p>First comment by a reader who says much</p></section>'
        "<form><input><label>Name</label></form><footer><p>Contact us</p></footer><script>var a='<p>x</p>';</script></body></html>"
    )
    pages = spark.createDataFrame(
        [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<nav><a>only menu</a></nav>"), (None, "u", "plain words")],
        "page_id long, url string, html string",
    )
    known = table(spark, sf, "pages").select("page_id", "url", "html")
    weights = html_extract.fit(known)
    for w in (weights, html_extract.Weights({}, {})):
        assert html_extract.extract(page, w) == f"Ti&tle {body} bold Second <p> part line"
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(pages).collect()}
    assert (got[2], got[3], got[4], got[None]) == ("", "", "", "plain words")
    assert html_extract.extracted(pages.filter("false")).count() == 0


def test_best_region():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = rng.integers(-5, 5, 12).tolist()
        a, b = html_extract.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(12) for j in range(i + 1, 13))])


# --- classifiers ---------------------------------------------------------------------


def test_toxicity_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = toxicity.scored(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "predicted", "toxic").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    own = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == r["toxic"] for r in own)
    assert right >= 0.97 * len(own)
    assert sum(r["predicted"] for r in own if r["toxic"]) >= 0.9 * sum(r["toxic"] for r in own)


def test_quality_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = quality_model.scored(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    own = [r for r in got if r["held_out"]]
    for y in (0, 1):
        cases = [r for r in own if r["quality"] == y]
        assert sum(r["predicted"] == y for r in cases) >= 0.95 * len(cases)
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_model, "quality")])
def test_classifiers_on_odd_tables(spark, odd, none, module, label):
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (8, 0), (8, 1), (99, 0)], f"doc_id long, {label} int")
    got = module.scored(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert module.scored(none, labels.filter("false")).count() == 0
    assert module.scored(odd, labels.filter("false")).count() == len(ODD)


def test_quality_filter_keeps_columns(spark, small, sf):
    model = quality_model.fit(small, table(spark, sf, "labels"))
    more = small.withColumn("score", F.lit("x")).withColumn("tags", F.array(F.lit(1)))
    kept = quality_model.keep_good(more, model)
    assert kept.columns == more.columns and kept.schema["tags"].dataType == more.schema["tags"].dataType
    by = quality_model.scored(small, table(spark, sf, "labels")).filter("predicted = 1")
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in by.select("doc_id").collect()}


# --- mixing --------------------------------------------------------------------------


def poured(sizes, weights, share=1.5, most=2.0):
    """Targets by pouring out again and again what sources cannot take."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        part = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += part * weight[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mix(spark, small, odd, none):
    for docs in (small, odd):
        rows = mixing.plan_mix(docs).collect()
        sizes = collections.Counter()
        for r in docs.collect():
            sizes[r["source"]] += len(words(r["text"]))
        want = poured(dict(sizes), mixing.WEIGHTS)
        assert len(rows) == docs.count()
        for r in rows:
            assert r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]])
            rate = r["target"] / r["source_size"] if r["source_size"] else 0
            assert math.floor(rate) <= r["copies"] <= math.ceil(rate)
        again = mixing.mix(docs).groupBy("doc_id").count().collect()
        plan = collections.Counter()
        for r in rows:
            plan[r["doc_id"]] += r["copies"]
        assert {r["doc_id"]: r["count"] for r in again} == {k: v for k, v in plan.items() if v}
        assert mixing.mix(docs).columns == docs.columns
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_meets_targets(spark):
    docs = spark.range(60000).selectExpr("id AS doc_id", "concat('s', id % 4 * (id % 3)) AS source", "repeat('w ', cast(id % 9 AS int)) AS text")
    by = mixing.mixed(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    for r in by:
        assert r["taken"] == pytest.approx(r["target"], rel=0.03)


# --- search --------------------------------------------------------------------------


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(0, 700)]
    rows += [(900 + i, [1.0, -1.0] * 10) for i in range(40)]  # copies: ties
    rows += [(50, None), (2000, [float("nan")] * 20), (2050, [None] + [0.0] * 19), (2100, [3e8] * 20), (None, [0.0] * 20), (2150, []), (2200, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in vector_search.searched(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    for i, v in usable:
        if i % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(w) == len(v)]
            want = [(k + 1, j, -s) for k, (s, j) in enumerate(sorted(scores)[:5])]
            assert sorted(got.pop(i, [])) == want
    assert not got
    assert vector_search.searched(df.filter("false")).count() == 0


# --- WARC ----------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 1200
    rows = [(1, "http://a/ b\n", long), (2, None, long), (5, "u", long), (5, "u", long), (3, "u", "é" * 600), (4, "u", "é" * 600)]
    rows += [(6, "u", "short"), (7, "u", "short"), (8, "u", None), (None, "u", long), (9, "u", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(warc.with_revisits(pages))
    got = warc.read_records(index, keep_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        body = next((h or "") for i, _, h in rows if i == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        refers = {1: 5, 2: 5, 3: 4, None: 5}.get(r["page_id"])
        assert r["refers_to"] == refers
        assert r["record_type"] == ("response" if refers is None else "revisit")
        assert r["payload"] is None if refers else bytes(r["payload"]) == body
    some = index.filter("record_type = 'revisit' OR page_id > 6")
    assert warc.read_records(some).count() == 4 + 3
    assert warc.archived(pages.filter("false")).count() == 0


def test_warc_files_are_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "y" * i * 40) for i in range(50)], "page_id long, url string, html string")
    folder = str(tmp_path / "archives")
    index = warc.write_archives(warc.with_revisits(pages.coalesce(1)), folder, archive_bytes=2000).collect()
    found = b""
    for name in sorted({r["archive"] for r in index}):
        found += gzip.decompress((tmp_path / "archives" / name).read_bytes())
    assert len({r["archive"] for r in index}) > 1
    assert found.count(b"WARC/1.1\r\n") == 50


# --- near duplicates -----------------------------------------------------------------


def plain_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=3):
    parent = {p: p for _, p in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = sorted(parent)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for i, p in rows:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return {(i, p): least.get(root(p)) for i, p in rows}


def test_simhash(spark, small, odd, none):
    for docs in (small, odd):
        rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
        want = plain_components(rows)
        got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(((i, p) for i, p, _ in got), key=key) == sorted(rows, key=key)
        assert all(want[(i, p)] == c for i, p, c in got)
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len({c for c in want.values() if c is not None}) + (None in want.values())
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_links_survive_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**63, 600, dtype=np.uint64)
    for _ in range(3):  # clouds of near copies around some points
        flips = np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        points = np.concatenate([points, points[rng.integers(0, 60, 300)] ^ flips])
    points = np.unique(points)
    rows = [(i, int(p)) for i, p in enumerate(points)]
    want = plain_components(rows)
    monkeypatch.setattr(simhash, "SHARD", 100)
    monkeypatch.setattr(simhash, "BLOCK", 120)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows], "least long, fp long")
    got = simhash.components(simhash.store(df, "points"))
    found = {(i, int(p)): None for i, p in rows}
    for r in got.join(df, "fp").collect():
        found[(r["least"], r["fp"] % (1 << 64))] = r["component"]
    assert found == want


# --- packing -------------------------------------------------------------------------


def check_packing(docs, rows, capacity):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = collections.Counter()
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert want == collections.Counter(tuple(r)[:5] for r in rows)
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(used) <= 1.05 * math.ceil(total / capacity) + 1
    return used


def test_packing(spark, small, odd, none):
    check_packing(small, packing.packed(small).collect(), 1024)
    check_packing(odd, packing.packed(odd).collect(), 1024)
    assert packing.packed(none).count() == 0


def test_rounds_are_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for capacity in (10, 37):
        lengths = sorted(rng.integers(1, capacity + 1, 300).tolist(), reverse=True)
        gaps = []
        for n in lengths:
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(capacity - n)
        placed = packing.rounds(dict(collections.Counter(lengths)), capacity)
        assert sum(p[2] for p in placed) == 300
        assert max(p[3] + p[2] for p in placed) == len(gaps)


# --- token counts --------------------------------------------------------------------


def test_token_counts(spark, small, odd, none):
    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    for docs in (small.limit(60), odd):
        rows = docs.collect()
        want = collections.Counter(
            (r["doc_id"], len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows
        )
        assert want == collections.Counter(tuple(r)[:3] for r in token_counts.counted(docs).collect())
    assert token_counts.counted(none).count() == 0


def test_counts_of_every_prefix(spark, odd):
    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    docs = odd.filter("doc_id IN (3, 7, 10) OR doc_id IS NULL")
    rows = token_counts.prefix_counts(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert rows
    for r in rows:
        for i in range(len(r["text"]) + 1):
            assert sum(r["steps"][:i]) == count(r["text"][:i])
    asked = token_counts.prefix_counts(docs).select(
        token_counts.count_at(F.col("steps"), 3).alias("at"), token_counts.longest_prefix(F.col("steps"), 2).alias("cut"), "doc_id"
    )
    by = {r["doc_id"]: r for r in asked.collect()}
    text = dict((i, t) for i, t, *_ in ODD)[10]
    assert by[10]["at"] == count(text[:3])
    assert by[10]["cut"] == max(i for i in range(len(text) + 1) if count(text[:i]) <= 2)


# --- rules ---------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_rules_measures(spark, small, odd, none):
    for docs in (small, odd):
        want = collections.Counter((r["doc_id"], *plain_measures(r["text"])) for r in docs.collect())
        got = quality_rules.ruled(docs).collect()
        assert want == collections.Counter(tuple(r)[:6] for r in got)
        for r in got:
            failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])
        kept = quality_rules.keep_good(docs)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.ruled(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_rules_adapt(spark):
    rows = []
    for source, sign in (("plain", ""), ("tables", " |")):
        for i in range(400):
            text = " ".join(f"w{i}x{j}{sign if j % 4 else ''}" for j in range(80))
            rows.append((len(rows), text, "en", source))
    rows.append((9000, " ".join(f"v{j} |" for j in range(80)), "en", "plain"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.ruled(docs).collect()}
    assert all(got[i] for i in range(800)) and not got[9000]


def test_sketch_is_close(spark):
    values = spark.range(0, 100000).selectExpr("id AS v").withColumn("b", quality_rules.bucket(F.col("v")))
    assert values.filter("b > v OR v - b > v / 128").count() == 0


def lined(i, lines, copies, more=0):
    """``lines`` lines of own words and ``copies`` equal ones, of ten words with ``more`` letters each."""
    of = lambda tag: " ".join(f"w{i}{tag}x{j}{'y' * more}" for j in range(10))
    return "\n".join([of(f"l{k}") for k in range(lines)] + [of("same")] * copies)


def test_rules_limits_follow_groups(spark):
    rng = np.random.default_rng(11)
    rows = []
    # Two sources that differ in repeated lines and in word lengths, and one too small for limits of its own.
    for source, most, letters, size in (("forms", 5, 6, 300), ("prose", 2, 0, 300), ("few", 2, 0, 20)):
        for _ in range(size):
            i = len(rows)
            rows.append((i, lined(i, 20, int(rng.integers(0, most)), letters + int(rng.integers(0, 3))), "en", source))
    odd_ones = {s: len(rows) + k for k, s in enumerate(("forms", "prose", "few"))}
    for s, i in odd_ones.items():
        rows.append((i, lined(i, 20, 5, 7 if s == "forms" else 1), "en", s))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = store(quality_rules.measure(docs), "measured")
    found = {r["source"]: r["limits"] for r in quality_rules.group_limits(measured).collect()}
    everyone = measured.toPandas()
    everyone = everyone[~everyone["base_failed"]]

    def start(v):
        drop = max(len(bin(v)) - 2 - quality_rules.DIGITS, 0)
        return v >> drop << drop

    for source, limits in found.items():
        own = everyone if source == "few" else everyone[everyone["source"] == source]
        for name, rule in quality_rules.STATISTICS.items():
            ranked = sorted(map(start, map(int, own[name])))
            low, high = (ranked[-(-len(ranked) * q // 100) - 1] for q in (rule.lower, rule.upper))
            spread = rule.reach * max(high - low, high >> quality_rules.DIGITS - 1)
            assert limits["high_" + name] == max(high + spread, rule.least)
            assert limits["low_" + name] == (low - spread if rule.both else 0)
    assert found["forms"]["high_line_rate"] > found["prose"]["high_line_rate"]
    assert found["forms"]["high_word_length"] != found["prose"]["high_word_length"]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.ruled(docs).collect()}
    assert kept[odd_ones["forms"]] and not kept[odd_ones["prose"]]
    usual = [i for i in range(620) if kept[i]]
    assert len(usual) >= 0.99 * 620
