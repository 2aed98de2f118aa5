"""Near-duplicates by SimHash, with vantage-point trees over the fingerprints.

Fingerprints that differ in few bits are found in three steps. A vantage-point tree built from a bounded
sample cuts the space of fingerprints into shards: a node sends what lies within its radius of the
vantage point one way and the rest the other. By the triangle inequality two fingerprints within ``bits``
of each other can only be parted if the farther one lies within ``bits`` outside the radius, so exactly
that strip is sent both ways and every close pair meets in some shard. In a shard the same cut
is repeated while it parts the points; what is left is compared exactly: two fingerprints that differ in
``bits`` bits agree in one of ``bits + 1`` stretches of them, so only those that share a stretch are. A
shard returns which of its fingerprints hang together, one row each, never the pairs; what several
shards found is then joined up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, no_nulls, quoted, slices
from millrace.session import store

SHINGLE = 3
BITS = 3
SEED = 42
#: Fingerprints wanted in a shard, before the strips are added.
SHARD = 65_536
#: Bounds of the sample that the tree is built from, and of its leaves.
SAMPLE = 131_072
MOST_SHARDS = 8_192
#: Larger shards (one dense cloud that no radius cuts) are compared block against block, a task each. It is
#: a few times ``SHARD``, as strips make shards larger than wanted.
BLOCK = 262_144
#: Fingerprints that are cut no further.
LEAF = 4_096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text: lower case A-Z, words between ASCII white space, XXH64 of word shingles, repeats
    counted; a bit is set if it is in over half of the hashes. A text without words has fingerprint 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())],
        np.uint64,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    set_bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def add_fingerprint(df: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` without ``text`` and with its fingerprint, the 64 bits as a long, in ``name``."""
    at = df.columns.index(text)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(t, shingle) for t in no_nulls(batch.column(at)).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            columns.append(pa.array(np.array(prints, np.uint64).view(np.int64)))
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(columns, [*names, name])

    return df.mapInArrow(hashed, df.drop(text).withColumn(name, F.lit(0).cast("long")).schema)


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _radius(d: np.ndarray, bits: int) -> int | None:
    """The radius that leaves least to do: both sides' squares, strips included; None if none helps."""
    n = len(d)
    upto = np.cumsum(np.bincount(d, minlength=66 + bits))[: 65 + bits]
    inside = upto[bits:][:65].astype(float)  # at most radius + bits away
    outside = n - upto[:65].astype(float)
    cost = inside**2 + outside**2
    best = int(np.argmin(cost))
    return best if cost[best] < 0.8 * n * n else None


def build_tree(sample: np.ndarray, leaves: int, bits: int = BITS) -> list[tuple]:
    """Nodes ``(vantage, radius, inside, outside)``; a negative child -k-1 is leaf k. Empty for one leaf."""
    nodes: list[tuple] = []
    made = [0]
    least = max(8, len(sample) // max(leaves, 1))

    def grow(points: np.ndarray) -> int:
        radius = None
        if len(points) > 1.5 * least:
            # The vantage that parts best among a few: an end of the cloud rather than its middle.
            tried = points[:: max(1, len(points) // 8)][:8]
            found = [(v, r) for v in tried if (r := _radius(distances(points, v), bits)) is not None]
            if found:
                strip = [
                    np.count_nonzero((d := distances(points, v)) <= r + bits) ** 2.0
                    + np.count_nonzero(d > r) ** 2.0
                    for v, r in found
                ]
                vantage, radius = found[int(np.argmin(strip))]
        if radius is None:
            made[0] += 1
            return -made[0]
        at = len(nodes)
        nodes.append(())
        d = distances(points, vantage)
        nodes[at] = (int(vantage), int(radius), grow(points[d <= radius]), grow(points[d > radius]))
        return at

    if grow(sample) < 0:
        return []
    return nodes


def route(points: np.ndarray, nodes: list[tuple], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Every shard that each point is in: indices of the points, shards."""
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), np.int64)
    found, todo = [], [(0, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if node < 0:
            found.append((own, np.full(len(own), -node - 1)))
        elif len(own):
            vantage, radius, inside, outside = nodes[node]
            d = distances(points[own], np.uint64(vantage))
            todo += [(inside, own[d <= radius + bits]), (outside, own[d > radius])]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class _Groups:
    """Which of n things hang together."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.of[at]
        while not np.array_equal(up := self.of[root], root):
            root = up
        self.of[at] = root
        return root

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.of, np.maximum(ra, rb), np.minimum(ra, rb))


def link_close(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For distinct ``points`` the number of each one's group under links of at most ``bits``."""
    groups = _Groups(len(points))
    edges = np.linspace(0, 64, bits + 2).astype(int)

    def compare(own: np.ndarray) -> None:
        for low, high in zip(edges, edges[1:]):
            stretch = points[own] << np.uint64(64 - high) >> np.uint64(64 - high + low)
            order = np.argsort(stretch)
            key, sorted_ = stretch[order], own[order]
            # Each point with the next, the one after that, and so on within its run of equal stretches.
            at, step = np.arange(len(own) - 1), 1
            while len(at):
                at = at[at + step < len(own)]
                at = at[key[at] == key[at + step]]
                a, b = sorted_[at], sorted_[at + step]
                near = np.bitwise_count(points[a] ^ points[b]) <= bits
                groups.link(a[near], b[near])
                step += 1

    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) > LEAF:
            d = distances(points[own], points[own[len(own) // 2]])
            radius = _radius(d, bits)
            if radius is not None:
                todo += [own[d <= radius + bits], own[d > radius]]
                continue
        compare(own)
    return groups.roots(np.arange(len(points)))


def shard_groups(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``fp, part, root``: for distinct ``prints(fp)`` the group ``(part, root)`` of every fingerprint that
    has a link within a shard (or pair of blocks) ``part``. A fingerprint may have several rows."""
    spark = prints.sparkSession
    n = prints.count()
    leaves = min(MOST_SHARDS, -(-n // SHARD))
    nodes: list[tuple] = []
    if leaves > 1:
        sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, 16 * leaves)).collect()
        nodes = build_tree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), leaves, bits)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            at, shard = route(points, nodes, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(shard, pa.int64())], ["fp", "shard"]
            )

    dealt = store(prints.select("fp").mapInArrow(routed, "fp long, shard long"), "shards")
    # A row per shard, at most a few times MOST_SHARDS of them.
    sizes = {r["shard"]: r["n"] for r in dealt.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    cuts = [(s, -(-k // BLOCK)) for s, k in sizes.items() if k > BLOCK]
    table = spark.createDataFrame(cuts, "shard long, blocks int")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    keyed = (
        dealt.join(F.broadcast(table), "shard", "left")
        .select("fp", "shard", own.alias("own"), other.alias("other"))
        .select(
            "fp",
            F.concat_ws("-", "shard", F.least("own", "other"), F.greatest("own", "other")).alias("part"),
        )
    )

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("fp")
        points = frame["fp"].to_numpy(np.int64).view(np.uint64)
        root = link_close(points, bits)
        _, index, count = np.unique(root, return_inverse=True, return_counts=True)
        out = pd.DataFrame({"fp": frame["fp"].to_numpy(), "part": frame["part"].to_numpy(), "root": points[root].view(np.int64)})
        return out[count[index] > 1]

    return keyed.groupBy("part").applyInPandas(linked, "fp long, part string, root long")


def connect(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the stored ``edges(a, b)``: the least node it is connected to.

    Each round gives every node the least label among its neighbours' and then the label of that label.
    Rounds are written out, so no lineage grows, and end when none changes a label.
    """
    both = store(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = store(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), "label")
        least = both.join(seen, "b").groupBy("a").agg(F.min("label").alias("least"))
        up = labels.join(least, labels["node"] == least["a"]).select("node", "label", F.least("label", "least").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("jumped"))
        step = up.join(jump, "new").select(
            "node", F.col("label").alias("was"), F.least("new", "jumped").alias("label")
        )
        step = store(step, "labels")
        if not step.filter(F.col("was") != F.col("label")).limit(1).count():
            return step.select("node", "label")
        labels = step.select("node", "label")


def components(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``fp, component``: of every distinct fingerprint, the stored ``prints(fp, least)`` (fingerprint and
    its least document id) joined to the least id that links of at most ``bits`` lead to."""
    members = store(shard_groups(prints, bits), "members")
    group = F.struct("part", "root")
    first = members.groupBy("fp").agg(F.min(group).alias("first"))
    # Groups of different shards that share a fingerprint are one. A few edges per group, not per document.
    edges = (
        members.join(first, "fp")
        .select(group.alias("a"), F.col("first").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .distinct()
    )
    edges = store(edges, "group-edges")
    merged = connect(edges) if not edges.isEmpty() else None
    owner = first.select("fp", F.col("first").alias("node"))
    if merged is not None:
        owner = owner.join(merged, "node", "left").select("fp", F.coalesce("label", "node").alias("node"))
    owner = store(owner, "owners")
    least = owner.join(prints, "fp").groupBy("node").agg(F.min("least").alias("component"))
    found = owner.join(least, "node").select("fp", "component")
    return prints.join(found, "fp", "left").select(
        "fp", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component")).alias("component")
    )


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    Texts without words (null, empty) have fingerprint 0 and link like any other. A component takes the
    least id in it; ids that are null count only if there is no other. Rows that share an id each keep
    their own text's fingerprint and component. An empty table gives no rows.
    """
    rows = store(add_fingerprint(docs.select("doc_id", "text"), "text", "fp"), "fingerprints")
    prints = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    return rows.join(components(prints, bits), "fp").select(
        "doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def with_position(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``df`` with two columns that tell its rows apart for good: the file and the row in it.

    A table that is not read from Parquet files as it stands is stored first.
    """
    names = fresh(df, *wanted)

    def add(rows: DataFrame) -> DataFrame:
        meta = rows.metadataColumn("_metadata")
        return rows.select("*", meta["file_path"].alias(names[0]), meta["row_index"].alias(names[1]))

    try:
        return add(df), names
    except AnalysisException:
        return add(store(df, "rows")), names


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component: of the least id, and of those the first in the files.
    Null ids come last. Columns stay as they are; ids may repeat. The rows meet the kept positions in one
    shuffle without a sort, at every size."""
    placed, (path, row) = with_position(docs, "row_file", "row_number")
    narrow = placed.select(quoted("doc_id").alias("doc_id"), quoted("text").alias("text"), quoted(path).alias("file"), quoted(row).alias("at"))
    rows = store(add_fingerprint(narrow, "text", "fp"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "file", "at")
    prints = store(rows.groupBy("fp").agg(F.min(order).alias("least")), "distinct-fingerprints")
    winners = store(components(prints, bits).select("component.file", "component.at").distinct(), "kept")
    winners = winners.select(F.col("file").alias(path), F.col("at").alias(row))
    return placed.join(winners.hint("shuffle_hash"), [path, row], "left_semi").select(*[quoted(c) for c in docs.columns])
