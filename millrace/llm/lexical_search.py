"""Ranked lexical search over bit-sliced Bloom signatures.

Every document has a signature: a Bloom filter of its terms, and of (term, level) for those that occur at
least 2, 4 or 8 times. Documents of about as many terms share a block, and a block is kept by slices: for each
bit of the signature a bitmap over its documents. The slices of a term's bits, and-ed, say which documents may
hold it how often; filters never miss a term, so summing each term's weight times the most that such a count
can earn bounds every document's score from above. The best-bounded documents are scored exactly first; the
score of the last wanted place among them is a floor, and each document whose bound reaches the floor of an
item is scored exactly from its whole text. What is left out is provably not among the results.

Queries are taken in blocks of ``ITEMS``; the index is built once.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from millrace.llm.common import alphanumeric_words, quoted, slices
from millrace.llm.simhash import with_position
from millrace.session import store, workspace

WANTED = 20
#: Documents of a block, bits of its slices together, and hash functions of a filter.
DOCS, BLOCK_BITS, HASHES = 1024, 1 << 25, 4
#: Least occurrences a level of the filter stands for, and the most that the next one leaves open.
LEVELS = np.array([1, 2, 4, 8])
MOST = (1, 3, 7)
#: What a term earns per unit of weight stays under this, however often it occurs.
CEILING = 1_000_000
#: Items and bytes of item texts in a block of queries.
ITEMS, ITEM_BYTES = 256, 1 << 22
#: Documents to be scored that go to every task; more meet the documents in a shuffle.
SENT = 100_000
_REMEMBERED = 300_000

INDEX = "file string, rows array<long>, n array<long>, width long, bits binary"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def places(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """Bits of the filter for terms of these hashes at a level: a row per term."""
    with np.errstate(over="ignore"):
        mixed = hashes * _MIX[level]
        mixed ^= mixed >> np.uint64(29)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        at = mixed[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return (at & np.uint64(width - 1)).astype(np.int64)


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, 0)


def earned(tf, m):
    """What ``tf`` occurrences earn per unit of weight in a document of length measure ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def measure(n, documents: int, terms: int):
    """Length measure of a document of ``n`` terms among ``documents`` with ``terms`` in all."""
    return 75 + (25 * n * documents) // terms


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _bytes(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.string()), "").cast(pa.large_binary()).to_pylist()


# --- the index -------------------------------------------------------------------------


class _Block:
    """Documents of one size class on their way to slices."""

    def __init__(self, width: int):
        self.width, self.room = width, max(8, min(DOCS, BLOCK_BITS // width))
        self.rows, self.n, self.bits = [], [], []

    def add(self, row: int, n: int, bits: np.ndarray) -> bool:
        self.rows.append(row)
        self.n.append(n)
        self.bits.append(bits)
        return len(self.rows) == self.room

    def slices(self) -> bytes:
        docs = -(-len(self.rows) // 8) * 8
        table = np.zeros((self.width, docs), bool)
        for doc, bits in enumerate(self.bits):
            table[bits, doc] = True
        return np.packbits(table, axis=1, bitorder="little").tobytes()


def build_index(placed: DataFrame, file: str, row: str) -> DataFrame:
    """Stored ``INDEX`` rows, a block each, over ``placed`` documents with terms: their row numbers in ``file``,
    their numbers of terms and the slices. Filters have 8 to 16 bits a term and level, so the index is a
    fraction of the texts, also for very long ones, which have blocks of few documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        open_: dict[int, _Block] = {}
        here = None

        def batch_of(block: _Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"file": [here], "rows": [block.rows], "n": [block.n], "width": [block.width], "bits": [block.slices()]},
                pa.schema(
                    [("file", pa.string()), ("rows", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]
                    + [("width", pa.int64()), ("bits", pa.binary())]
                ),
            )

        def hash_of(term: bytes) -> int:
            if (h := known.get(term)) is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                h = known[term] = term_hash(term)
            return h

        for batch in slices(batches):
            files, rows = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for text, f, r in zip(_bytes(batch.column(0)), files, rows):
                if f != here:
                    yield from map(batch_of, open_.values())
                    open_, here = {}, f
                counts = Counter(alphanumeric_words(text))
                if not counts:
                    continue
                hashes = np.fromiter(map(hash_of, counts), np.uint64, len(counts))
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                entries = int((tf[:, None] >= LEVELS).sum())
                width = 1 << max(6, entries.bit_length() + 3)
                bits = np.concatenate([places(hashes[tf >= t], i, width).ravel() for i, t in enumerate(LEVELS)])
                block = open_.setdefault(width, _Block(width))
                if block.add(r, int(tf.sum()), bits):
                    yield batch_of(open_.pop(width))
        yield from map(batch_of, open_.values())

    return store(placed.select("text", quoted(file), quoted(row)).mapInArrow(build, INDEX), "signatures")


# --- a block of queries ----------------------------------------------------------------


class Queries:
    """Items of a block: their ids, weights by term, and for the bounds the terms' hashes."""

    def __init__(self, items: list[Row], df: dict[bytes, int], documents: int, terms: int):
        self.documents, self.terms = documents, terms
        weights = {t: w for t, n in df.items() if (w := weight(n, documents))}
        self.weights = [
            {t: q * weights[t] for t, q in Counter(alphanumeric_words(i["text"])).items() if t in weights} for i in items
        ]
        self.vocabulary = sorted(set().union(*self.weights))
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.hashes = np.fromiter(map(term_hash, self.vocabulary), np.uint64, len(self.vocabulary))
        self.at = [np.array([number[t] for t in own], np.int64) for own in self.weights]
        self.by = [np.array(list(own.values()), np.int64) for own in self.weights]

    def bounds(self, n: list[int], width: int, bits: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """Upper bounds of the scores of a block's documents, for every item with a term in the block."""
        table = np.frombuffer(bits, np.uint8).reshape(width, -1)
        m = measure(np.array(n, np.int64), self.documents, self.terms)
        most = np.stack([*(earned(t, m) for t in MOST), np.full(len(n), CEILING)])
        gains = np.diff(most, axis=0, prepend=0)
        held = np.stack([np.bitwise_and.reduce(table[places(self.hashes, i, width)], axis=1) for i in range(len(LEVELS))])
        held = np.bitwise_and.accumulate(held, axis=0)
        there = held[0].any(axis=1)
        slot = np.cumsum(there) - 1
        best = np.zeros((int(there.sum()), len(n)), np.int64)
        for level, gain in zip(held, gains):
            best += np.unpackbits(level[there], axis=1, count=len(n), bitorder="little") * gain
        for item, (at, by) in enumerate(zip(self.at, self.by)):
            own = there[at]
            if own.any():
                yield item, by[own] @ best[slot[at[own]]]

    def score(self, item: int, counts: Counter, m: int) -> int:
        return sum(w * earned(tf, m) for t, w in self.weights[item].items() if (tf := counts.get(t)))


def _document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that hold each term of the block's ``vocabulary``, over all texts; a row per term and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in _bytes(batch.column(0)):
                seen.update(vocabulary.intersection(alphanumeric_words(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "n"]
        )

    found = docs.select("text").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in found.collect()}


def _bounded(index: DataFrame, queries: Queries, floors: list[int] | None) -> DataFrame:
    """``item, file, row, bound``: of each block the best-bounded documents per item, or with ``floors`` all
    documents whose bound reaches their item's."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, rows, n, width, bits in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                items, kept, bounds = [], [], []
                for item, upper in queries.bounds(n, width, bits):
                    if floors is None:
                        own = np.argpartition(-upper, WANTED)[:WANTED] if len(upper) > WANTED else np.arange(len(upper))
                        own = own[upper[own] > 0]
                    else:
                        own = np.flatnonzero(upper >= max(floors[item], 1))
                    items.append(np.full(len(own), item))
                    kept.append(np.array(rows, np.int64)[own])
                    bounds.append(upper[own])
                if items:
                    flat = [np.concatenate(x).astype(np.int64) for x in (items, kept, bounds)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(flat[0]), pa.array([file] * len(flat[0]), pa.string()), pa.array(flat[1]), pa.array(flat[2])],
                        ["item", "file", "row", "bound"],
                    )

    return index.mapInArrow(bound, "item long, file string, row long, bound long")


def _scored(placed: DataFrame, names: list[str], chosen: DataFrame, queries: Queries) -> DataFrame:
    """``item, doc_id, score`` of the stored ``chosen(item, file, row)``, from the documents' whole texts."""
    wanted = chosen.groupBy("file", "row").agg(F.collect_list("item").alias("items"))  # a block's items at most
    wanted = store(wanted.select(F.col("file").alias(names[0]), F.col("row").alias(names[1]), "items"), "to-score")
    wanted = F.broadcast(wanted) if wanted.count() <= SENT else wanted.hint("shuffle_hash")
    texts = placed.join(wanted, names).select("doc_id", "text", "items")
    kind = placed.select("doc_id").schema.fields[0].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, items, scores = [], [], []
            for i, (text, own) in enumerate(zip(_bytes(batch.column(1)), batch.column(2).to_pylist())):
                words = alphanumeric_words(text)
                counts, m = Counter(words), measure(len(words), queries.documents, queries.terms)
                for item in own:
                    at.append(i)
                    items.append(item)
                    scores.append(queries.score(item, counts, m))
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(scores, pa.int64())],
                ["item", "doc_id", "score"],
            )

    return texts.mapInArrow(score, f"item long, doc_id {kind}, score long").where("score > 0")


def _ranked(scores: DataFrame) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= WANTED)


def searched(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``WANTED`` best of ``docs(doc_id, text)`` for every row of
    ``items(item_id, text)``.

    A null text has no terms; an item without terms, or without a document that scores, has no rows. Each row of
    either table counts for itself, also if its id is null or repeated; equal scores go by ``doc_id``, null
    last. Texts of any length count whole. Empty tables give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    placed, names = with_position(docs.select("doc_id", "text"), "file", "row")
    index = build_index(placed, *names)
    total = index.agg(
        F.sum(F.size("rows")).alias("documents"),
        F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms"),
    ).first()
    items = store(items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "items")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(-(-size["n"] // ITEMS), -(-size["b"] // ITEM_BYTES))
    out = workspace(spark, "ranked")
    shape = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    spark.createDataFrame([], shape).write.parquet(f"{out}/block=-1")
    for k in range(blocks if total["documents"] else 0):
        # Rows of a block: about ``ITEMS``, by a hash of what they are.
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = block.withColumn("text", F.col("text").cast("binary")).collect()
        vocabulary = frozenset(w for r in rows for w in alphanumeric_words(r["text"]))
        queries = Queries(rows, _document_frequencies(placed, vocabulary), total["documents"], total["terms"])
        if not queries.vocabulary:
            continue
        best = Window.partitionBy("item").orderBy(F.col("bound").desc(), "file", "row")
        probes = _bounded(index, queries, None).withColumn("place", F.row_number().over(best))
        probes = _scored(placed, names, probes.where(F.col("place") <= WANTED), queries)
        floors, seen = [0] * len(rows), defaultdict(list)
        for r in probes.collect():  # ``WANTED`` an item
            seen[r["item"]].append(r["score"])
        for item, scores in seen.items():
            if len(scores) >= WANTED:
                floors[item] = sorted(scores)[-WANTED]
        ranked = _ranked(_scored(placed, names, _bounded(index, queries, floors), queries))
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, {shape.split(',')[0]}")
        ranked = ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        ranked.write.parquet(f"{out}/block={k}")
    return spark.read.schema(shape).parquet(out).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (
  SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf
  FROM (SELECT r, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS r, * FROM documents))
  GROUP BY r, term
), lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM d GROUP BY r
), total AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(total.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM d, total GROUP BY term
), asked AS (
  SELECT i, any_value(item_id) AS item_id, term, count(*) AS q
  FROM (SELECT i, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark))
  GROUP BY i, term
), scores AS (
  SELECT i, any_value(item_id) AS item_id, d.r, any_value(doc_id) AS doc_id,
    sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * lengths.n * total.n) // total.l))))::BIGINT AS score
  FROM asked JOIN d USING (term) JOIN weights USING (term) JOIN lengths ON lengths.r = d.r, total
  GROUP BY i, d.r
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0
) WHERE rank <= 20
"""
