"""The prefix trie of conversations, from adaptive radix trees over ranges of their keys.

A turn is known by the 16 bytes of the MD5 digest of its role and text, in big-endian order; a conversation
is the string of the ids of its turns. Equal conversations are one key. The keys are dealt out by ranges,
so that a common first turn is spread over tasks, and each task puts its keys into an adaptive radix
tree: a node has room for 4, 16, 48 or 256 branches and grows as they come, and bytes that do not branch are
kept as one path. Only depths at a multiple of 16 bytes are nodes of the trie, those inside a path too.

A node inside a range is whole there. One on the way to the first or last key of a range may reach into
other ranges; of these nodes, some for each range and none of them large, every task gives its share, and
the shares are added up by one more pass. A node is named by a digest of its bytes on the way.

Edge cases: a null role or text is empty. Rows with a null conv_id belong to no conversation. Turns are
ordered by turn, null first, equal ones by the digest of role and text; a repeated row is a turn of its
own. Without conversations there is no node, not even the root. Other columns are not read. One conversation
is one string of 20 bytes a turn. The ids that end at a node are hashed in their order as they stream
through one task, which holds one of them at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.session import written

#: Bytes of a turn id.
WIDTH = 16
#: Keys of one range, about.
KEYS_PER_RANGE = 50_000
#: Bytes of the table of shared nodes up to which it is broadcast.
BROADCAST_BYTES = 16 << 20

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes for a role and a text; the length in front keeps them apart."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation with its turns (id, bytes of text) in order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            turn_id(F.col("role"), F.col("text")).alias("id"),
            F.octet_length(text).alias("bytes"),
        ).alias("t"),
    )
    grouped = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["id"], x["bytes"])).alias("turns"))


def rebuilt(convs: DataFrame, base: Column, shared: Column, most_shared: int) -> DataFrame:
    """Every conversation with its first `shared` turns taken from the conversation `base`."""
    convs = written(convs, "own-turns")
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most_shared).alias("head"))
    both = convs.withColumns({"base": base, "shared": shared}).join(heads, "base", "left")
    first = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("shared"))
    own = F.slice("turns", F.col("shared") + 1, F.size("turns"))
    return both.select("conv_id", F.concat(first, own).alias("turns"))


class Tree:
    """An adaptive radix tree: keys of whole turns, with a value each.

    A node is [path, value, kind, labels, branches]. Kinds of 4 and 16 keep their branches sorted by
    label; 48 has an index of 256 places into its branches; 256 has a place for every label.
    """

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _leaf(path: bytes, value) -> list:
        return [path, value, 4, bytearray(), []]

    @staticmethod
    def branch(node: list, label: int) -> list | None:
        kind, labels, branches = node[2], node[3], node[4]
        if kind <= 16:
            at = bisect_left(labels, label)
            return branches[at] if at < len(labels) and labels[at] == label else None
        if kind == 48:
            return branches[labels[label] - 1] if labels[label] else None
        return branches[label]

    @staticmethod
    def put(node: list, label: int, child: list) -> None:
        """Add a branch or replace the one with the label; a full node gets the next larger layout."""
        kind, labels, branches = node[2], node[3], node[4]
        if kind <= 16:
            at = bisect_left(labels, label)
            if at < len(labels) and labels[at] == label:
                branches[at] = child
                return
            if len(labels) < kind:
                labels.insert(at, label)
                branches.insert(at, child)
                return
            if kind == 4:
                node[2] = 16
            else:
                index = bytearray(256)
                for place, known in enumerate(labels, 1):
                    index[known] = place
                node[2], node[3] = 48, index
            Tree.put(node, label, child)
        elif kind == 48:
            if labels[label]:
                branches[labels[label] - 1] = child
            elif len(branches) < 48:
                branches.append(child)
                labels[label] = len(branches)
            else:
                node[2], node[3] = 256, None
                node[4] = [branches[labels[x] - 1] if labels[x] else None for x in range(256)]
                Tree.put(node, label, child)
        else:
            branches[label] = child

    @staticmethod
    def sorted_branches(node: list) -> list:
        kind, labels, branches = node[2], node[3], node[4]
        if kind <= 16:
            return branches
        if kind == 48:
            return [branches[place - 1] for place in labels if place]
        return [b for b in branches if b is not None]

    def insert(self, key: bytes, value) -> None:
        if self.root is None:
            self.root = self._leaf(key, value)
            return
        parent, label, node, at = None, 0, self.root, 0
        while True:
            path = node[0]
            if key.startswith(path, at):
                at += len(path)
                if at == len(key):
                    node[1] = value
                    return
                parent, label, child = node, key[at], self.branch(node, key[at])
                if child is None:
                    self.put(node, label, self._leaf(key[at:], value))
                    return
                node = child
                continue
            same = _common(path, key, at)
            above = self._leaf(path[:same], None)
            self.put(above, path[same], node)
            node[0] = path[same:]
            if at + same == len(key):
                above[1] = value
            else:
                self.put(above, key[at + same], self._leaf(key[at + same :], value))
            if parent is None:
                self.root = above
            else:
                self.put(parent, label, above)
            return


def _common(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of the path agree with the key from a place on."""
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if path[:middle] == key[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    """A node of the trie while its subtree is summed up."""

    __slots__ = ("depth", "digest", "bytes", "parent", "shared", "conv", "ends", "n_convs", "n_children", "n_leaves", "saved_tokens", "open")

    def __init__(self, depth: int, digest, size: int, parent: "_Node | None", shared: bool) -> None:
        self.depth, self.digest, self.bytes, self.parent, self.shared = depth, digest, size, parent, shared
        self.conv: int | None = None
        self.ends: str | None = None
        self.n_convs = self.n_children = self.n_leaves = self.saved_tokens = 0
        self.open: list[_Node] = []


def trie_nodes(tree: Tree, first: bytes, last: bytes) -> Iterator[_Node]:
    """The nodes of a tree, children before their parents; those on the way to the first or last key are shared.

    A value is (number of conversations, smallest id, digest of the ids, bytes of each turn).
    A shared node sums up what is whole in its range below it, but not other shared nodes.
    """
    top = _Node(0, hashlib.md5(), 0, None, True)
    stack: list[tuple] = [(tree.root, top, b"", b"")]
    while stack:
        step = stack.pop()
        if len(step) == 1:
            done = step[0]
            _close(done)
            yield done
            continue
        node, above, tail, way = step
        # the turns that end on this path
        tail += node[0]
        way += node[0]
        whole = len(tail) // WIDTH
        sizes = _any_value(node)[3] if whole else ()
        for k in range(whole):
            digest = above.digest.copy()
            digest.update(tail[k * WIDTH : (k + 1) * WIDTH])
            depth = above.depth + 1
            prefix = way[: depth * WIDTH]
            shared = above.shared and (first.startswith(prefix) or last.startswith(prefix))
            above = _Node(depth, digest, int(sizes[depth - 1]), above, shared)
            stack.append((above,))
        tail = tail[whole * WIDTH :]
        if node[1] is not None:
            above.n_convs += node[1][0]
            above.conv = node[1][1] if above.conv is None else min(above.conv, node[1][1])
            above.ends = node[1][2]
        for child in reversed(Tree.sorted_branches(node)):
            stack.append((child, above, tail, way))
    _close(top)
    yield top


def _any_value(node: list) -> tuple:
    """The value of some key below a node; equal bytes on the way mean equal sizes."""
    while node[1] is None:
        node = next(b for b in Tree.sorted_branches(node))
    return node[1]


def _close(node: _Node) -> None:
    """A node's children are summed up: finish it and add it to its parent."""
    if not node.shared:
        if not node.n_children:
            node.n_leaves += 1
        node.saved_tokens += (node.n_convs - 1) * node.bytes
    above = node.parent
    if above is None:
        return
    above.n_convs += node.n_convs
    above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
    if not node.shared:
        above.n_children += 1
        above.n_leaves += node.n_leaves
        above.saved_tokens += node.saved_tokens


_NODE_FIELDS = [
    ("node", pa.binary()),
    ("parent", pa.binary()),
    ("shared", pa.bool_()),
    ("parent_shared", pa.bool_()),
    ("conv_id", pa.int64()),
    ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()),
    *[(c, pa.int64()) for c in COUNTS],
    ("bytes", pa.int64()),
    ("ends", pa.string()),
]
_NODES = pa.schema(_NODE_FIELDS)
NODES = (
    "node binary, parent binary, shared boolean, parent_shared boolean, conv_id bigint, depth bigint, parent_conv_id bigint, "
    + ", ".join(f"{c} bigint" for c in COUNTS)
    + ", bytes bigint, ends string"
)
_PIECE = 20_000


def _row(node: _Node) -> tuple:
    above = node.parent
    return (
        node.digest.digest(),
        above.digest.digest() if above else None,
        node.shared,
        bool(above and above.shared),
        node.conv,
        node.depth,
        None,
        *(getattr(node, c) for c in COUNTS),
        node.bytes,
        node.ends,
    )


def _range_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range of keys."""
    tree, first, last = Tree(), None, None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("key", "n", "conv", "ends", "sizes"))
        for key, n, conv, ends, sizes in zip(*columns):
            tree.insert(key, (n, conv, ends, np.frombuffer(sizes, np.int32)))
            first = key if first is None else min(first, key)
            last = key if last is None else max(last, key)
    if first is None:
        return
    rows: list[tuple] = []
    waiting: list[_Node] = []
    for node in trie_nodes(tree, first, last):
        # the parent's smallest member is known when the parent is done
        waiting_here = node.open
        node.open = []
        for child in waiting_here:
            row = list(_row(child))
            row[6] = node.conv
            rows.append(tuple(row))
        if node.shared or node.parent is None:
            rows.append(_row(node))
        else:
            node.parent.open.append(node)
        if len(rows) >= _PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _NODE_FIELDS)], schema=_NODES)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _NODE_FIELDS)], schema=_NODES)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, smallest id and digest of the ids of each key, whose rows follow each other in order."""
    now, running, n, least = None, None, 0, 0
    names = ["node", "n", "conv", "ends"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        rows = []
        for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if key != now:
                if now is not None:
                    rows.append((now, n, least, running.hexdigest()))
                now, running, n, least = key, hashlib.sha256(str(conv).encode()), 1, conv
            else:
                running.update(b",%d" % conv)
                n += 1
        if rows:
            yield batch_of(rows)
    if now is not None:
        yield batch_of([(now, n, least, running.hexdigest())])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared nodes, deepest first, with the sums of the shared nodes below them."""
    below: dict[bytes, list[int]] = {}
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            children, leaves, saved = below.pop(x["node"], (0, 0, 0))
            x["n_children"] += children
            x["n_leaves"] += leaves + (not x["n_children"])
            x["saved_tokens"] += saved + ((x["n_convs"] - 1) * x["bytes"])
            if x["parent"] is not None:
                sums = below.setdefault(x["parent"], [0, 0, 0])
                sums[0] += 1
                sums[1] += x["n_leaves"]
                sums[2] += x["saved_tokens"]
            rows.append(x)
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def prefix_trie(convs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, turns as arrays of id and bytes)."""
    spark = convs.sparkSession
    key = F.coalesce(F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")), F.unhex(F.lit("")))
    sizes = F.unhex(F.array_join(F.transform("turns", lambda t: _little_endian(t["bytes"])), ""))
    keyed = convs.select("conv_id", key.alias("key"), sizes.alias("sizes")).withColumn("node", F.unhex(F.md5("key")))
    keyed = written(keyed, "conversations")
    ends = keyed.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = ends.mapInArrow(_hash_ends, "node binary, n bigint, conv bigint, ends string")
    keys = keyed.select("node", "key", "sizes").dropDuplicates(["node"]).join(ends, "node")
    keys = written(keys.drop("node"), "keys")
    ranges = ranges or max(1, keys.count() // KEYS_PER_RANGE, spark.sparkContext.defaultParallelism)
    dealt = keys.repartitionByRange(ranges, "key")
    nodes = written(dealt.mapInArrow(_range_nodes, NODES), "nodes")

    shared = nodes.where("shared").groupBy("node").agg(
        F.first("parent", True).alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.first("bytes").alias("bytes"),
        F.max("ends").alias("ends"),
    )
    # some nodes a range: its first and last key
    summed = shared.coalesce(1).sortWithinPartitions(F.desc("depth"))
    summed = written(summed.mapInArrow(_sum_up, shared.schema), "shared")
    named = summed.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    if summed.count() * 64 <= BROADCAST_BYTES:
        named = F.broadcast(named)
    result = [F.col(c) for c in ("conv_id", "depth", "parent_conv_id", *COUNTS)]
    result.append(F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    inside = nodes.where(~F.col("shared"))
    within = inside.where(~F.col("parent_shared")).select(*result)
    edge = inside.where("parent_shared").join(named, "parent")
    edge = edge.withColumn("parent_conv_id", F.col("above")).select(*result)
    spine = summed.join(named, "parent", "left").withColumn("parent_conv_id", F.col("above")).select(*result)
    return within.unionByName(edge).unionByName(spine)


def _little_endian(number: Column) -> Column:
    """Eight hexadecimal digits, least byte first."""
    digits = F.lpad(F.hex(number.cast("long")), 8, "0")
    return F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])
