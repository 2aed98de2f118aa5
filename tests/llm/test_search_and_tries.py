"""Ranked search, license scans and conversation tries against plain versions of what they return."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from millrace.llm import conversation_trie, lexical_search, license_scan
from millrace.llm.common import table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def terms(text):
    return TERM.findall(lowered(text))


# --- ranked search -----------------------------------------------------------------------


def plain_search(docs, items, wanted=20):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scored = collections.Counter(terms(text)), []
        for d, c in counts:
            m = 75 + (25 * c.total() * n) // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, q in asked.items()
                if t in c
            )
            if score > 0:
                scored.append((d, score))
        scored.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, i + 1, d, s) for i, (d, s) in enumerate(scored[:wanted])]
    return collections.Counter(out)


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture
def odd_docs():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Größe", "日本語", "it's", "\x00", "--", "A1"]
    docs = [(i // 2, " ".join(rng.choices(words, k=rng.choice([1, 3, 30, 200])))) for i in range(150)]
    docs += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, None), (8, ""), (9, " \n--"), (10, "w5 " * 30000), (11, "w1 w2 W3")]
    return docs


def test_search_equals_plain(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "DOCS", 16)
    monkeypatch.setattr(lexical_search, "ITEMS", 3)
    items = [(1, "w1 w2 w2"), (1, "w1 w2 w2"), (2, None), (3, "nowhere"), (4, "Größe 日本語 w7 it's"), (None, "w5 A1"), (5, "")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in odd_docs], "doc_id long, text string, rank int, `item` string")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    assert rows_of(lexical_search.searched(docs, asked)) == plain_search(odd_docs, items)
    assert lexical_search.searched(docs, asked.filter("false")).count() == 0
    assert lexical_search.searched(docs.filter("false"), asked).count() == 0


def test_search_by_shuffle(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "SENT", 0)
    items = [(1, "w1 w2 w2"), (2, "w9")]
    docs = spark.createDataFrame(odd_docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical_search.searched(docs, asked)) == plain_search(odd_docs, items)


def test_bounds_hold_and_exclude(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    texts = [r["text"] or "" for r in docs.collect()]
    counts = [collections.Counter(lexical_search.alphanumeric_words(t.encode())) for t in texts]
    df = collections.Counter(t for c in counts for t in c)
    rows = [r.asDict() | {"text": r["text"].encode()} for r in items.collect()]
    queries = lexical_search.Queries(rows, df, len(texts), sum(c.total() for c in counts))
    placed, names = lexical_search.with_position(docs.select("doc_id", "text"), "file", "row")
    numbered = {r[names[1]]: r["text"] or "" for r in placed.collect()}
    left = pairs = 0
    for block in lexical_search.build_index(placed, *names).collect():
        for item, upper in queries.bounds(block["n"], block["width"], bytes(block["bits"])):
            for row, n, bound in zip(block["rows"], block["n"], upper.tolist()):
                words = collections.Counter(lexical_search.alphanumeric_words(numbered[row].encode()))
                score = queries.score(item, words, lexical_search.measure(n, queries.documents, queries.terms))
                assert score <= bound
                pairs, left = pairs + 1, left + (bound <= 2 * score)
    assert left > 0.5 * pairs  # bounds are near the scores


# --- licences ----------------------------------------------------------------------------


def plain_base(text):
    words = [w for w in TERM.findall(lowered(text))]
    found = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), labels


NOTICE = license_scan.TEMPLATES[0].text
LICENSED = [
    (1, "Under the MIT license. under THE mit\nLicense-under the mit license", "mit"),
    (2, "Apache License, Version 2.0 and CC BY-NC 4.0", "apache-2,cc-by-nc"),
    (3, "prose " * 50 + NOTICE + " prose" * 50, "mit"),
    (4, NOTICE.replace("free of charge", "without any charge"), ""),  # a key phrase is missing
    (5, NOTICE.replace(" copy, ", " copy, translate, adapt, ").replace("Software", "Work", 1), "mit"),
    (6, "the license of a software is free of charge and the rights to use it are granted", ""),
    (7, "This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    (8, "x under the mit licenses and apache license version 20", ""),
    (9, None, ""),
    (9, "", ""),
    (None, "日本語 cc by nc日本 cc by nc", "cc-by-nc"),
    (10, "cc by " * 30000 + "nc", "cc-by-nc"),
    (11, "license " * 30000, ""),
    (11, "license " * 30000, ""),
]


def test_license_scans(spark):
    rows = [(d, t, "b", "l", 3) for d, t, _ in LICENSED]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base_labels string, places string, words int")
    got = license_scan.scanned(docs).collect()
    want = collections.Counter()
    for d, t, labels in LICENSED:
        want[(d, *plain_base(t), labels)] += 1
    assert collections.Counter(tuple(r)[:7] for r in got) == want
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in got)
    assert license_scan.scanned(docs.filter("false")).count() == 0


def test_license_base_places(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:6] for r in license_scan.scanned(table(spark, sf, "documents")).collect()}
    assert got == {r["doc_id"]: plain_base(r["text"]) for r in rows}
    assert any(v[1] for v in got.values())


def test_license_spans(spark):
    docs = spark.createDataFrame([(1, "a b " + NOTICE)], "doc_id long, text string")
    (row,) = license_scan.license_places(docs, license_scan.build_index(docs)).collect()
    (place,) = row["places"]
    assert (place["label"], place["first"], place["base"], place["share"]) == ("mit", 2, False, 1.0)


# --- tries -------------------------------------------------------------------------------


def plain_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for p, convs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(p))
        out.append(
            (min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(kids), len(leaves), saved,
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return collections.Counter(out)


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(-7, 30), 10**12, 10**12 + 1]:
        if c in (15, 21):
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", None, ""]), rng.choice(["a", "b", "ü", None, "ab"])))
    rows += [(4, 1, "user", "a"), (4, 1, "user", "a"), (4, 1, "system", "z"), (None, 1, "user", "a"), (22, 0, "user", "x" * 50000)]
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(9)]  # copies
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("layer, keys", [(512, 50_000), (3, 4), (1, 1)])
def test_trie_equals_plain(spark, monkeypatch, layer, keys):
    monkeypatch.setattr(conversation_trie, "KEYS", keys)
    monkeypatch.setattr(conversation_trie, "BLOB", 5)
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", key string, `above` int")
    assert rows_of(conversation_trie.nodes(df, layer)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_trie.nodes(empty).count() == 0
    alone = spark.createDataFrame([(5, None, None, None)], SCHEMA)
    assert rows_of(conversation_trie.nodes(alone)) == plain_trie([(5, None, None, None)])


def test_radix_layouts():
    rng = random.Random(1)
    keys = {bytes(rng.choices(range(256), k=rng.choice([2, 2, 2, 40]))) for _ in range(3000)} | {b"", b"\0", b"\0\0"}
    keys |= {bytes([9, i]) for i in range(256)} | {bytes([7, i]) for i in range(30)}
    tree = conversation_trie.Tree()
    order = rng.sample(sorted(keys), len(keys))
    for key in order:
        tree.add(key)
    kinds, found = set(), []

    def walk(item, so_far):
        if isinstance(item, int):
            found.append(tree.keys[item])
            return
        kinds.add(item.kind)
        so_far += item.path
        if item.end >= 0:
            assert tree.keys[item.end] == so_far
            found.append(so_far)
        for byte, child in item.pairs():
            if isinstance(child, int):
                assert tree.keys[child].startswith(so_far + bytes([byte]))
            walk(child, so_far + bytes([byte]))

    walk(tree.root, b"")
    assert sorted(found) == sorted(keys)
    assert kinds == {4, 16, 48, 256}
