"""Prefix tries of conversations: adaptive radix trees over fixed-width turn ids.

A turn is its role and text; its id is a fixed number of bytes, big-endian (of their SHA-256, then of the
text's size), so that a conversation is a byte string and equal beginnings of conversations are equal
beginnings of bytes. Tasks put such keys into adaptive radix trees: inner nodes of 4, 16, 48 or 256 places
that grow as needed, and path compression for bytes without a branch. Only byte depths that end a turn are
nodes of the trie.

No task needs all keys of a subtree. Everything asked of a node is a sum, or a least id, over the distinct
keys that run through it, once each key knows how many turns it shares with its neighbours in sorted order:
a node is brought in by one key only (that which shares less with the key before it), and a key ends in a
leaf unless the next one goes on from it. So each task's tree gives partial nodes, trees are emptied
whenever they reach a bound, and partial nodes of one path are added up.

Keys are cut after ``LAYER`` turns; what follows is a trie of its own under the node it hangs from, handled
in a layer of its own from the deepest up. No conversation is gathered beyond a layer's turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import store

#: Bytes of a turn's id: 16 of its digest, then its text's size in 4.
WIDTH = 20
#: Bytes of a trie node's id.
NODE = 16
#: Turns of a layer.
LAYER = 512
#: Keys and key bytes after which a task's trees are emptied.
KEYS, KEY_BYTES = 50_000, 1 << 25
#: How conversations are rebuilt: groups of five, heads of up to eight turns.
GROUP, HEADS = 5, 9
#: Bytes of joined ids that go on together to a node's hash.
BLOB = 1 << 20

ROOT = bytes(NODE)
SHA_OF_NOTHING = hashlib.sha256(b"").hexdigest()
PARTIAL = (
    "id binary, parent binary, depth long, conv_id long, n long, kids long, leaves long, saved long, end binary"
)


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()[:NODE]


def boundary(above: bytes, key: bytes) -> bytes:
    """Id of the node at the end of a full layer."""
    return digest(above, hashlib.sha256(key).digest())


# --- the tree --------------------------------------------------------------------------


class Node:
    """An inner node: the compressed path above it and, by next byte, its children.

    Up to 4 and 16 children are sorted pairs of arrays; up to 48 are found through an index of 256 bytes;
    more have a place each.
    """

    __slots__ = ("path", "some", "end", "kind", "bytes", "places", "n")

    def __init__(self, path: bytes, some: int):
        # ``some`` is the number of a key below, ``end`` that of the key that ends here.
        self.path, self.some, self.end, self.kind, self.n = path, some, -1, 4, 0
        self.bytes, self.places = bytearray(), []

    def child(self, byte: int):
        if self.kind <= 16:
            at = self.bytes.find(byte)
            return None if at < 0 else self.places[at]
        if self.kind == 48:
            at = self.bytes[byte]
            return None if at == 255 else self.places[at]
        return self.places[byte]

    def put(self, byte: int, child) -> None:
        """Sets the child at ``byte``, in a larger layout if this one is full."""
        if self.child(byte) is None:
            if self.n == self.kind:
                self._grow()
            self.n += 1
            if self.kind <= 16:
                at = sum(b < byte for b in self.bytes)
                self.bytes.insert(at, byte)
                self.places.insert(at, child)
            elif self.kind == 48:
                self.bytes[byte] = len(self.places)
                self.places.append(child)
            else:
                self.places[byte] = child
        elif self.kind <= 16:
            self.places[self.bytes.find(byte)] = child
        elif self.kind == 48:
            self.places[self.bytes[byte]] = child
        else:
            self.places[byte] = child

    def _grow(self) -> None:
        pairs = self.pairs()
        if self.kind == 4:
            self.kind = 16
        elif self.kind == 16:
            self.kind, self.bytes, self.places = 48, bytearray(b"\xff" * 256), []
            for byte, child in pairs:
                self.bytes[byte] = len(self.places)
                self.places.append(child)
        else:
            self.kind, self.bytes, self.places = 256, bytearray(), [None] * 256
            for byte, child in pairs:
                self.places[byte] = child

    def pairs(self) -> list[tuple[int, object]]:
        if self.kind <= 16:
            return list(zip(self.bytes, self.places))
        if self.kind == 48:
            return [(b, self.places[at]) for b, at in enumerate(self.bytes) if at != 255]
        return [(b, c) for b, c in enumerate(self.places) if c is not None]

    def children(self) -> list:
        return [c for _, c in self.pairs()]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Tree:
    """Distinct byte keys. A leaf is the number of its key, kept whole in ``keys`` (lazy expansion)."""

    def __init__(self):
        self.keys: list[bytes] = []
        self.root = Node(b"", 0)

    def add(self, key: bytes) -> int:
        number, keys = len(self.keys), self.keys
        keys.append(key)
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.end = number
                return number
            child = node.child(key[at])
            if child is None:
                node.put(key[at], number)
                return number
            if isinstance(child, int):
                other = keys[child]
                same = _common(other[at + 1 :], key[at + 1 :])
                branch = Node(key[at + 1 : at + 1 + same], number)
                below = at + 1 + same
                if below == len(other):
                    branch.end = child
                else:
                    branch.put(other[below], child)
            else:
                same = _common(child.path, key[at + 1 : at + 1 + len(child.path)])
                if same == len(child.path):
                    node, at = child, at + 1 + same
                    continue
                branch = Node(child.path[:same], number)
                branch.put(child.path[same], child)
                child.path = child.path[same + 1 :]
            node.put(key[at], branch)
            node, at = branch, at + 1 + len(branch.path)


class Block:
    """The tree of one layer below the node ``above``, whose depth is ``depth``, and what each key brings:
    ``(key, conversations, least id, end, turns shared with the key before, and with the key after, kids, leaves
    and saved bytes of the layer below)``."""

    def __init__(self, above: bytes, depth: int, layer: int):
        self.above, self.depth, self.layer = above, depth, layer
        self.tree, self.rows = Tree(), []

    def add(self, row: tuple) -> None:
        self.tree.add(row[0])
        self.rows.append(row)

    def emit(self, out: list) -> None:
        """Appends rows of ``PARTIAL``, children before parents.

        What goes up from a subtree: its conversations, their least id, its leaves, its saved bytes, the least
        number of turns that a key of it shares with the key before, and how many of its topmost nodes are
        brought in by its keys. Paths are linked lists of ids, deepest first.
        """
        found: list[tuple] = []
        todo: list[tuple] = [(self.tree.root, -1, (self.above, None), False)]
        while todo:
            item, top, link, back = todo.pop()
            if isinstance(item, int):
                row = self.rows[item]
                turns = len(row[0]) // WIDTH
                link = self._lengthen(link, row[0], top // WIDTH, turns)
                found.append(self._climb(self._own(row), row[3], row[0], link, top, turns, out))
                continue
            bottom = top + 1 + len(item.path)
            key, turns = self.rows[item.some][0], bottom // WIDTH
            if not back:
                link = self._lengthen(link, key, max(top, 0) // WIDTH, turns)
                todo.append((item, top, link, True))
                todo += [(c, bottom, link, False) for c in item.children()]
                continue
            parts, end = found[len(found) - item.n :], None
            del found[len(found) - item.n :]
            if item.end >= 0:
                parts.append(self._own(self.rows[item.end]))
                end = self.rows[item.end][3]
            n, least, leaves, saved, before, kids = zip(*parts)
            whole = sum(n), min(least), sum(leaves), sum(saved), min(before), sum(kids)
            found.append(self._climb(whole, end, key, link, top, turns, out))

    def _own(self, row: tuple) -> tuple:
        """What a key brings to the node it ends in."""
        key, n, least, _, before, after, kids, leaves, saved = row
        return n, least, leaves if kids else int(after < len(key) // WIDTH), saved, before, kids

    def _lengthen(self, link: tuple, key: bytes, done: int, turns: int) -> tuple:
        for t in range(done + 1, turns + 1):
            own = key[(t - 1) * WIDTH : t * WIDTH]
            link = (boundary(self.above, key[: t * WIDTH]) if t == self.layer else digest(link[0], own), link)
        return link

    def _climb(self, up: tuple, end, key: bytes, link: tuple, top: int, turns: int, out: list) -> tuple:
        """Emits the nodes after ``turns`` turns and upwards, down to those within the parent's ``top`` bytes."""
        n, least, leaves, saved, before, kids = up
        while turns * WIDTH > top:
            own, link = link[0], link[1]
            if turns:
                brought = int(before < turns)
                saved += (n - brought) * int.from_bytes(key[turns * WIDTH - 4 : turns * WIDTH])
                out.append((own, link[0], self.depth + turns, least, n, kids, leaves, saved, end))
                kids = brought
            else:
                out.append((own, b"", self.depth, least, n, kids, leaves, saved, end))
            turns, end = turns - 1, None
        return n, least, leaves, saved, before, kids


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _batches(rows: Iterator[tuple], schema: str, most: int = 5000, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``most`` rows and about ``size`` bytes of binaries."""
    kind, held, bytes_ = _arrow(schema), [], 0
    for row in rows:
        held.append(row)
        bytes_ += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= most or bytes_ >= size:
            yield _table(held, kind)
            held, bytes_ = [], 0
    if held:
        yield _table(held, kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


# --- turns to keys ---------------------------------------------------------------------


def _bytes_of(hexadecimal: Column, size: int = NODE) -> Column:
    return F.unhex(F.substring(hexadecimal, 1, 2 * size))


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``conv, turn, id`` of every row with a ``conv_id``; null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = lambda c: F.octet_length(c)
    whole = F.concat(size(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.unhex(F.concat(F.substring(F.sha2(whole, 256), 1, 32), F.lpad(F.hex(size(text)), 8, "0"))).alias("id"),
    )


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored ``conv, id, no`` with each turn's number in its conversation, and ``conv, n`` with their counts.

    Rows are sorted by ranges of (conversation, turn), so that a long conversation is spread over tasks;
    each task numbers what it has and adds the counts of the tasks before it, known for at most one
    conversation per task.
    """
    order = ["conv", "turn", "id", "tie"]
    spread = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            task, conv, no = TaskContext.get().partitionId(), None, 0
            for c, id_ in _rows(b.select(["conv", "id"]) for b in batches):
                conv, no = c, no + 1 if c == conv else 1
                yield c, id_, no, task

        return _batches(rows(), "conv long, id binary, no long, task long")

    stored = store(spread.mapInArrow(number, "conv long, id binary, no long, task long"), "turns")
    counts = stored.groupBy("conv", "task").agg(F.max("no").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = store(counts.withColumn("before", F.sum("n").over(earlier)), "turn-counts")
    carried = F.broadcast(counts.where("before > 0").select("conv", "task", "before"))  # at most a row per task
    rows = stored.join(carried, ["conv", "task"], "left").select(
        "conv", "id", (F.col("no") + F.coalesce("before", F.lit(0))).alias("no")
    )
    return rows, counts.groupBy("conv").agg(F.sum("n").alias("n"))


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame, layer: int = LAYER) -> tuple[DataFrame, int]:
    """Stored ``conv, layer, length, key`` of every rebuilt conversation, and its greatest length.

    A conversation is the first turns of that at the head of its group, as many as ``head_length`` says, and
    its own turns after as many. A conversation without turns has an empty key.
    """
    rows, counts = numbered(store(turn_ids(conversations), "turn-ids"))
    counts = store(
        counts.withColumn("base", F.col("conv") - F.col("conv") % GROUP).withColumn("h", head_length(F.col("conv"))),
        "conversations",
    )
    of_base = counts.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = counts.join(of_base, "base", "left").withColumn("heads", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = plan.withColumn("length", F.col("heads") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = store(plan.select("conv", "base", "h", "heads", "length"), "rebuilding")
    longest = plan.agg(F.max("length")).first()[0] or 0

    tails = rows.where(F.col("no") > head_length(F.col("conv"))).join(plan, "conv")
    tails = tails.select("conv", "length", (F.col("heads") + F.col("no") - F.col("h")).alias("pos"), "id")
    heads = rows.where((F.col("no") < HEADS) & (F.col("conv") % GROUP == 0)).withColumnRenamed("conv", "base")
    heads = heads.join(plan, "base").where(F.col("no") <= F.col("heads")).select("conv", "length", F.col("no").alias("pos"), "id")
    # A place ahead of the first turn, so that conversations without turns are there.
    start = plan.select("conv", "length", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("id"))
    place = F.expr(f"greatest(pos - 1, 0) div {layer}")
    turns = F.array_sort(F.collect_list(F.struct("pos", "id")))  # a layer's turns at most
    key = F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["id"])), ""))
    keys = tails.union(heads).union(start).withColumn("layer", place)
    return store(keys.groupBy("conv", "layer", "length").agg(key.alias("key")), "conversation-keys"), longest


def with_above(keys: DataFrame, layer: int) -> DataFrame:
    """Stored ``keys`` with ``above``, the id of the node that each layer of a conversation hangs from."""
    alone = keys.where(F.col("length") <= layer).withColumn("above", F.lit(ROOT))
    long = keys.where(F.col("length") > layer)
    order = long.select("conv", "layer", F.unhex(F.sha2("key", 256)).alias("hash"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv = above = None
            for c, no, hash_ in _rows(batches):
                if c != conv:
                    conv, above = c, ROOT
                yield c, no, above
                above = digest(above, hash_)

        return _batches(rows(), "conv long, layer long, above binary")

    order = order.repartition("conv").sortWithinPartitions("conv", "layer")
    chained = order.mapInArrow(chain, "conv long, layer long, above binary")
    return store(alone.unionByName(long.join(chained, ["conv", "layer"])), "conversation-layers")


# --- keys to nodes ---------------------------------------------------------------------

_KEY = "above binary, key binary, n long, least long, end binary, kids long, leaves long, saved long"
_LINKED = f"{_KEY}, before long, after long"


def _shared(above: bytes, key: bytes, other_above: bytes | None, other: bytes | None) -> int | None:
    """Turns two keys of one node above begin with alike; None if they are of different ones."""
    if other is None or above != other_above:
        return None
    n = min(len(key), len(other)) // WIDTH
    if key[: n * WIDTH] == other[: n * WIDTH]:
        return n
    return next(t for t in range(n) if key[t * WIDTH : (t + 1) * WIDTH] != other[t * WIDTH : (t + 1) * WIDTH])


def with_neighbours(keys: DataFrame) -> DataFrame:
    """Distinct ``keys`` with ``before`` and ``after``: turns shared with the sorted neighbours of the same node
    above (0 and -1 if there is none). The first and last key of a task look their neighbours up among the
    first and last keys of all tasks, two rows a task."""
    ordered = keys.repartitionByRange("above", "key").sortWithinPartitions("above", "key")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, before, edge = None, None, 1
            for row in _rows(batches):
                if held is not None:
                    shared = _shared(row[0], row[1], held[0], held[1])
                    yield (*held, before, -1 if shared is None else shared, edge)
                    before, edge = shared or 0, 0
                held = row
            if held is not None:
                yield (*held, before, None, edge + 2)

        return _batches(rows(), f"{_LINKED}, edge long")

    linked = store(ordered.mapInArrow(link, f"{_LINKED}, edge long"), "sorted-keys")
    edges = linked.where("edge > 0")
    by_key = Window.orderBy("above", "key")  # two rows a task
    for name, step in (("p", F.lag), ("s", F.lead)):
        edges = edges.withColumn(f"{name}_above", step("above").over(by_key)).withColumn(f"{name}_key", step("key").over(by_key))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for *row, before, after, edge, p_above, p_key, s_above, s_key in _rows(batches):
                if edge & 1:
                    before = _shared(row[0], row[1], p_above, p_key) or 0
                if edge & 2:
                    shared = _shared(row[0], row[1], s_above, s_key)
                    after = -1 if shared is None else shared
                yield (*row, before, after)

        return _batches(rows(), _LINKED)

    return linked.where("edge = 0").drop("edge").union(edges.mapInArrow(mend, _LINKED))


def partial_nodes(linked: DataFrame, depth: int, layer: int) -> DataFrame:
    """Rows of ``PARTIAL`` from radix trees over the keys each task meets."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            blocks: dict[bytes, Block] = {}
            count = size = 0

            def emptied() -> Iterator[tuple]:
                while blocks:
                    out: list[tuple] = []
                    blocks.popitem()[1].emit(out)
                    yield from out

            for above, key, n, least, end, kids, leaves, saved, before, after in _rows(batches):
                if above not in blocks:
                    blocks[above] = Block(above, depth, layer)
                blocks[above].add((key, n, least, end, before, after, kids, leaves, saved))
                count, size = count + 1, size + len(key)
                if count >= KEYS or size >= KEY_BYTES:
                    yield from emptied()
                    count = size = 0
            yield from emptied()

        return _batches(rows(), PARTIAL)

    return linked.mapInArrow(grow, PARTIAL)


def hashes_of_ends(members: DataFrame) -> DataFrame:
    """``end, ends_sha256`` of ``members(end, conv)``: the hash of each end's ids in order, comma-joined.

    Ids are sorted by ranges of (end, id) and joined to texts by all tasks; only the hash itself, which cannot
    be split, runs over an end's texts in order, one at a time.
    """
    ordered = members.repartitionByRange("end", "conv").sortWithinPartitions("end", "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            end, first, ids, size = None, None, [], 0
            for e, conv in _rows(batches):
                if ids and (e != end or size >= BLOB):
                    yield end, first, b",".join(ids)
                    ids, size = [], 0
                if not ids:
                    end, first = e, conv
                ids.append(b"%d" % conv)
                size += len(ids[-1]) + 1
            if ids:
                yield end, first, b",".join(ids)

        return _batches(rows(), "end binary, first long, text binary")

    texts = ordered.mapInArrow(join, "end binary, first long, text binary")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            end, sha = None, None
            for e, _, text in _rows(batches):
                if e != end:
                    if sha:
                        yield end, sha.hexdigest()
                    end, sha = e, hashlib.sha256(text)
                else:
                    sha.update(b",")
                    sha.update(text)
            if sha:
                yield end, sha.hexdigest()

        return _batches(rows(), "end binary, ends_sha256 string")

    texts = texts.repartition("end").sortWithinPartitions("end", "first")
    return texts.mapInArrow(hashed, "end binary, ends_sha256 string")


_SUMS = ("n", "kids", "leaves", "saved")


def trie(conversations: DataFrame, layer: int = LAYER) -> DataFrame:
    """Every node: ``id, parent, depth, conv_id, n, kids, leaves, saved, ends_sha256`` (the last null where no
    conversation ends). A layer costs a few jobs; conversations of up to ``layer`` turns are one layer."""
    keys, longest = rebuilt(conversations, layer)
    last = max(longest - 1, 0) // layer
    keys = with_above(keys, layer) if last else keys.withColumn("above", F.lit(ROOT))
    end = F.when(
        F.col("layer") == F.expr(f"greatest(length - 1, 0) div {layer}"),
        F.unhex(F.sha2(F.concat("above", "key"), 256)),
    )
    keys = keys.withColumn("end", end)
    below, parts = None, []
    for k in range(last, -1, -1):
        alike = keys.where(F.col("layer") == k).groupBy("above", "key").agg(
            F.count("*").alias("n"), F.min("conv").alias("least"), F.max(F.col("end").isNotNull()).alias("ended")
        )
        own_end = F.when(F.col("ended"), F.unhex(F.sha2(F.concat("above", "key"), 256))).alias("end")
        if below is None:
            under = [F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")]
        else:
            node = _bytes_of(F.sha2(F.concat("above", F.unhex(F.sha2("key", 256))), 256))
            alike = alike.withColumn("id", node).join(below, "id", "left")
            under = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kids", "leaves", "saved")]
        alike = alike.select("above", "key", "n", "least", own_end, *under)
        part = store(partial_nodes(with_neighbours(alike), k * layer, layer), "partial-nodes")
        if k:
            joint = part.where(F.col("depth") == k * layer)
            below = store(joint.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")]), "joints")
            part = part.where(F.col("depth") > k * layer)
        parts.append(part)
    partial = parts[0]
    for part in parts[1:]:
        partial = partial.union(part)
    merged = partial.groupBy("id", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in _SUMS]
    )
    hashes = hashes_of_ends(keys.where("end is not null").select("end", "conv"))
    ends = partial.where("end is not null").select("id", "parent", "depth", "end").join(hashes, "end").drop("end")
    return store(merged.join(ends, ["id", "parent", "depth"], "left"), "trie")


def nodes(conversations: DataFrame, layer: int = LAYER) -> DataFrame:
    """The digest: a row per node of the trie of all rebuilt ``conversations(conv_id, turn, role, text)``.

    Turns are taken by number, null first; those of one number in the order of their ids (SHA-256 of the role's
    size, a colon, role and text), equal rows each. Rows without ``conv_id`` take no part; an empty table
    gives no rows. Texts of any length are hashed whole. Other columns are not looked at.
    """
    found = trie(conversations, layer)
    parents = found.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return found.join(parents, "parent", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(SHA_OF_NOTHING)).alias("ends_sha256"),
    )


#: CRC-32 of the decimal id bit by bit, then prefixes as lists of turn hashes.
ORACLE = """
WITH turns AS (
  SELECT conv_id AS c, octet_length(encode(coalesce(text, ''))) AS b,
         sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         turn
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS no FROM turns
), convs AS (
  SELECT DISTINCT c, c - c % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)),
      lambda v, i: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h
  FROM turns
), rebuilt AS (
  SELECT v.c, 0 AS part, n.no, n.id, n.b FROM convs v JOIN numbered n ON n.c = v.base AND n.no <= v.h
  UNION ALL
  SELECT v.c, 1, n.no, n.id, n.b FROM convs v JOIN numbered n ON n.c = v.c AND n.no > v.h
), seqs AS (
  SELECT v.c, coalesce(ids, []) AS ids, coalesce(bs, []) AS bs FROM convs v LEFT JOIN (
    SELECT c, list(id ORDER BY part, no) AS ids, list(b ORDER BY part, no) AS bs FROM rebuilt GROUP BY c
  ) USING (c)
), paths AS (
  SELECT c, d, len(ids) AS n, array_to_string(ids[1:d], ',') AS p, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b
  FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT p, d, any_value(b) AS b, min(c) AS c, count(*) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = paths.n), '')) AS ends
  FROM paths GROUP BY p, d
), placed AS (
  SELECT x.*, u.p AS up FROM nodes x LEFT JOIN paths u ON u.c = x.c AND u.d = x.d - 1
), kids AS (SELECT up, count(*) AS k FROM placed WHERE up IS NOT NULL GROUP BY up
), whole AS (
  SELECT a.p, sum(CASE WHEN k.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.b) AS saved
  FROM nodes x LEFT JOIN kids k ON k.up = x.p JOIN paths a ON a.c = x.c AND a.d <= x.d GROUP BY a.p
)
SELECT x.c AS conv_id, x.d AS depth, u.c AS parent_conv_id, x.n AS n_convs, coalesce(k.k, 0) AS n_children,
       w.leaves::BIGINT AS n_leaves, w.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM placed x JOIN whole w ON w.p = x.p LEFT JOIN kids k ON k.up = x.p LEFT JOIN nodes u ON u.p = x.up
"""
