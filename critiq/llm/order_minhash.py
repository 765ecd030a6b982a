"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its sequence of shingles of five words. Each of several hash functions picks the
smallest few shingles of a text, where repeated shingles count as different ones by their
occurrence, and keeps what it picked in the order of the text: an entry of the sketch. Texts
that agree in an entry are candidates. Of short texts, entries are their rarest shingles instead, as
many as are needed for two similar texts to have one in common. A pair is linked if, with L shingles
aligned in order,

    L / (shingles of one + shingles of the other - L) >= 0.8.

The alignment follows the diagonals within the number of insertions and deletions that this
similarity leaves, and stops where it is exceeded.

Equal texts are one node, known by a digest of their words. Nodes with the same entry form a
bucket. First every member is compared with the first node of its bucket, which settles most
of them. Then only buckets remain in which several components meet. Their members are dealt to blocks
of bounded size, and every two blocks of a bucket are a tile, worked on by one task: it counts the
shingles that members share, aligns those pairs that share enough and are not yet connected, and
returns a link only where two components become one. So rows grow with members and blocks and never
with pairs, no bucket is collected, and no candidate is left out: one common entry is enough.

If the shorter text has at most 60 shingles, every similar pair is a candidate. Of two longer ones at
exactly 0.8, whose shingles are distinct, one of 32 entries of five agrees with a probability above
0.99999 at every length; the more similar, the surer.

Edge cases: a text of fewer than five words is one shingle; texts without words are never
grouped. A null id gets a null class. Rows are told apart by id and text: those with one id and
different texts are documents of their own, which may be in different classes. The class id is
the smallest id of the class, so two classes bear the same one if an id has several texts. Of a class,
the row of the smallest id stays, of several texts of that id the one with the smallest hash. An empty
table gives an empty result. A very long text is one row, cut into pieces only where batches are.
Input columns stay; one named class_id is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.components import components
from critiq.llm.hashing import hash_windows, hash_words, mix, slices
from critiq.llm.rows import give_back, hold
from critiq.session import discard, written

SHINGLE = 5
SIMILARITY = 0.8
#: Entries of a sketch, and shingles in an entry.
ENTRIES = 32
PICKS = 5
#: Shingles up to which a text is found by its rarest shingles instead of a sketch.
EXACT = 60
#: Members of a bucket in one block, and shingles of all of them together, about.
TILE_MEMBERS, TILE_SHINGLES = 1024, 1 << 21
#: Members of a tile up to which pairs are counted one by one.
FEW_MEMBERS = 12
#: Rows of the ids of candidates up to which they are broadcast to the texts.
BROADCAST_ROWS = 1_000_000
FACTOR = 0x9E3779B97F4A7C15
CHUNK_BYTES = 8 << 20
#: Numbers hashed together for one text.
BLOCK = 1 << 20

SKETCHES = "id bigint, key bigint, digest binary, n int, entries array<bigint>, marked array<bigint>"


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash per run of `size` words; one for all words of a shorter text."""
    if len(hashes) <= size:
        return hash_windows(hashes, np.zeros(min(1, len(hashes)), np.int64), len(hashes), FACTOR)
    return hash_windows(hashes, np.arange(len(hashes) - size + 1), size, FACTOR)


def labelled(sequence: np.ndarray) -> np.ndarray:
    """The same numbers, made different by occurrence."""
    order = np.argsort(sequence, kind="stable")
    ordered = sequence[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    if new.all():
        return sequence
    at = np.arange(len(ordered))
    nth = np.empty(len(ordered), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mix(sequence + nth * np.uint64(FACTOR))


def sketch(sequence: np.ndarray, entries: int = ENTRIES, picks: int = PICKS) -> np.ndarray:
    """One number per hash function: the picked shingles in the order of the text."""
    seeds = mix(np.arange(1, entries + 1, dtype=np.uint64) * np.uint64(FACTOR))
    if not len(sequence):
        return np.zeros(0, np.uint64)
    marked = labelled(sequence)
    picked = np.empty((entries, min(picks, len(sequence))), np.uint64)
    step = max(1, BLOCK // len(sequence))
    for start in range(0, entries, step):
        part = slice(start, min(start + step, entries))
        if len(sequence) <= picks:
            picked[part] = sequence
            continue
        ranks = mix(marked[None, :] ^ seeds[part, None])
        places = np.argpartition(ranks, picks - 1, axis=1)[:, :picks]
        places.sort(axis=1)
        picked[part] = sequence[places]
    keys = seeds.copy()
    for column in picked.T:
        keys = mix(keys * np.uint64(FACTOR) + column)
    return keys


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketcher(entries: int, picks: int, size: int, similarity: float) -> Callable:
    """The sketch of a text that is not short, and the shingles of one that can be similar to a short one."""
    none, most = np.zeros(0, np.uint64), int(EXACT / similarity + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            digests, counts, rows, marked = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sequence = shingles(hash_words(words), size)
                counts.append(len(sequence))
                rows.append(sketch(sequence, entries, picks) if len(sequence) > EXACT else none)
                marked.append(labelled(sequence) if 0 < len(sequence) <= most else none)
            columns = [batch.column("id"), batch.column("key"), pa.array(digests, pa.binary()), pa.array(counts, pa.int32())]
            columns += [_lists(rows), _lists(marked)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "digest", "n", "entries", "marked"])

    return run


def rarest_shingles(nodes: DataFrame, similarity: float) -> DataFrame:
    """(digest, rarest) of nodes with `marked` shingles: the rarest ones, less those that stand in one text only.

    A similar text shares at least ceil(similarity * n) of the n shingles. So if both texts leave out
    fewer than they must share, in one order of all shingles, the first shared one is in both.
    """
    found = nodes.where(F.size("marked") > 0).select("digest", "n", F.explode("marked").alias("shingle"))
    counts = found.groupBy("shingle").agg(F.count("*").alias("texts"))
    ranked = found.join(counts, "shingle").groupBy("digest", "n")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("ranked"))
    needed = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9).cast("int") + 1
    first = F.filter(F.slice("ranked", 1, needed), lambda x: x["texts"] > 1)
    return ranked.select("digest", first["shingle"].alias("rarest"))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sequences share, each as often as in both."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(nx[i], ny[j]).sum())


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most `most` insertions and deletions turn one sequence into the other.

    For each number of edits, the furthest point reached on every diagonal of the band.
    """
    same = min(len(a), len(b))
    head = same if (a[:same] == b[:same]).all() else int(np.argmin(a[:same] == b[:same]))
    a, b = a[head:], b[head:]
    same = min(len(a), len(b))
    tail = (a[::-1][:same] == b[::-1][:same])
    cut = same if tail.all() else int(np.argmin(tail))
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    n, m = len(a), len(b)
    if n + m <= most:
        return True
    if abs(n - m) > most:
        return False
    first, second, x_bytes, y_bytes = a.tolist(), b.tolist(), a.tobytes(), b.tobytes()

    def equal(x: int, y: int, length: int) -> bool:
        fits = x + length <= n and y + length <= m
        return fits and x_bytes[8 * x : 8 * (x + length)] == y_bytes[8 * y : 8 * (y + length)]

    def run_on(x: int, y: int) -> int:
        """The end on the first sequence of the equal run that starts at (x, y)."""
        if x >= n or y >= m or first[x] != second[y]:
            return x
        step = 4
        while equal(x, y, step):
            x, y, step = x + step, y + step, 2 * step
        while step > 1:
            step //= 2
            if equal(x, y, step):
                x, y = x + step, y + step
        return x

    reached = {1: 0}
    for edits in range(most + 1):
        for diagonal in range(-edits, edits + 1, 2):
            if diagonal < -m or diagonal > n:
                continue
            down, right = reached.get(diagonal + 1, -1), reached.get(diagonal - 1, -1) + 1
            x = down if diagonal == -edits or (diagonal != edits and right <= down) else right
            if x > n or x - diagonal > m or x < 0:
                reached[diagonal] = x
                continue
            x = run_on(x, x - diagonal)
            reached[diagonal] = x
            if x >= n and x - diagonal >= m:
                return True
    return False


def are_similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two shingle sequences are aligned to the similarity at least."""
    total = len(a) + len(b)
    need = int(np.ceil(similarity * total / (1 + similarity) - 1e-9))
    if min(len(a), len(b)) < need or _shared(a, b) < need:
        return False
    return within(a, b, total - 2 * need)


def verifier(similarity: float, size: int) -> Callable:
    """The pairs whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            known: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
            good: list[tuple[int, int]] = []
            for a, b, text_a, text_b in zip(*columns):
                if known[0] != text_b:
                    known = text_b, shingles(hash_words(_words(text_b)), size)
                if are_similar(shingles(hash_words(_words(text_a)), size), known[1], similarity):
                    good.append((a, b))
            yield _links(good)

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _sequences(size: int) -> Callable:
    """The shingles of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            rows = [shingles(hash_words(_words(text)), size) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(rows)], names=["node", "shingles"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers every two sets of different numbers share, as a matrix."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    numbers, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    kept = often[column]
    owner, column = owner[kept], place[column[kept]]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(1, BLOCK // len(sets))
    for start in range(0, int(often.sum()), step):
        part = slice(*np.searchsorted(column, (start, start + step)))
        holds = np.zeros((len(sets), step), np.float32)
        holds[owner[part], column[part] - start] = 1
        counts += holds @ holds.T
    return counts


def tile_links(members: list[tuple[int, int, int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links that connect components of a tile; a member is (block, node, component, shingles).

    Two blocks are compared with each other; a block alone with itself.
    """
    own: dict[int, int] = {}

    def root(component: int) -> int:
        while (above := own.get(component, component)) != component:
            component = above
        return component

    two_blocks = len({m[0] for m in members}) > 1

    def apart(i: int, j: int) -> bool:
        return not (two_blocks and members[i][0] == members[j][0]) and root(members[i][2]) != root(members[j][2])

    lengths = np.array([len(m[3]) for m in members])
    if len(members) <= FEW_MEMBERS:
        pairs = ((i, j) for j in range(len(members)) for i in range(j))
    else:
        total = lengths[:, None] + lengths[None]
        need = np.ceil(similarity * total / (1 + similarity) - 1e-9)
        enough = np.triu(shared_counts([labelled(m[3]) for m in members]) >= need, 1)
        components = np.unique([m[2] for m in members], return_inverse=True)[1]
        enough &= components[:, None] != components[None]
        pairs = zip(*(x.tolist() for x in np.nonzero(enough)))
    links = []
    for i, j in pairs:
        if apart(i, j) and are_similar(members[i][3], members[j][3], similarity):
            links.append((members[i][1], members[j][1]))
            own[root(members[i][2])] = root(members[j][2])
    return links


def _tiles(similarity: float) -> Callable:
    """The links of every tile, whose rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("entry", "one", "other", "block", "node", "component")]
            lists = batch.column("shingles")
            offsets, numbers = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
            for row, (*tile, block, node, component) in enumerate(zip(*columns)):
                if tile != now:
                    found += tile_links(members, similarity) if len(members) > 1 else []
                    now, members = tile, []
                members.append((block, node, component, numbers[offsets[row] : offsets[row + 1]]))
            yield _links(found)
        if len(members) > 1:
            yield _links(tile_links(members, similarity))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verifier(similarity, size), "a bigint, b bigint")


def _links_of_meeting(members: DataFrame, texts: DataFrame, found: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links between components that meet in a bucket; `members` has (entry, node, n)."""
    members = members.join(found.withColumnRenamed("id", "node"), "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    mark = F.xxhash64("node")
    buckets = members.groupBy("entry").agg(
        F.min("component").alias("x"),
        F.max("component").alias("y"),
        F.count("*").alias("members"),
        F.sum("n").alias("shingles"),
        F.sum(mark.cast("decimal(20,0)")).alias("mark"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("other_mark"),
    )
    # texts that agree in several entries often make several buckets of the same members: one of them is enough
    same = ["x", "y", "members", "shingles", "mark", "other_mark"]
    buckets = buckets.where("x < y").groupBy(*same).agg(F.min("entry").alias("entry"))
    by_members, by_shingles = F.ceil(F.col("members") / TILE_MEMBERS), F.ceil(F.col("shingles") / TILE_SHINGLES)
    buckets = buckets.select("entry", F.greatest(by_members, by_shingles).cast("int").alias("blocks"))
    dealt = members.join(buckets, "entry").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "entry", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "block", "node", "component"
    )
    dealt = written(dealt, "tiles")
    asked = texts.join(dealt.select("node").distinct(), "node", "left_semi")
    sequences = asked.mapInArrow(_sequences(size), "node bigint, shingles array<bigint>")
    tile = ["entry", "one", "other"]
    lined_up = dealt.join(sequences, "node").repartition(*tile).sortWithinPartitions(*tile, "node")
    return lined_up.mapInArrow(_tiles(similarity), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    size: int = SHINGLE,
    entries: int = ENTRIES,
    picks: int = PICKS,
) -> DataFrame:
    """(id, key, class_id, stays): one row per id that is not null and text, which `key` is a hash of.

    `stays` marks the one that stands for its class.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), _key(text_col).alias("key"), F.col(text_col).alias("text"))
    given = given.where(F.col("id").isNotNull())
    sketches = written(given.mapInArrow(sketcher(entries, picks, size, similarity), SKETCHES), "sketches")
    with_words = sketches.where(F.col("n") > 0).groupBy("digest")
    first_row = F.min(F.struct("id", "key")).alias("row")
    found_nodes = written(with_words.agg(first_row, *[F.first(c).alias(c) for c in ("n", "entries", "marked")]), "nodes")
    keys = F.concat("entries", F.coalesce("rarest", F.array().cast("array<bigint>")))
    nodes = found_nodes.join(rarest_shingles(found_nodes, similarity), "digest", "left")
    # numbers given once and written, so that they stay the same: short, in place of digests
    numbered = nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "row", "n", keys.alias("entries"))
    nodes = written(numbered, "nodes")
    discard(found_nodes)
    members = nodes.select("node", "n", F.explode("entries").alias("entry"))

    def close(n: str, m: str) -> Column:
        return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    buckets = members.groupBy("entry").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last"))
    buckets = buckets.where(F.col("first.node") < F.col("last")).select("entry", "first.node", "first.n").toDF("entry", "b", "m")
    # all but the first of their bucket, with which they are compared now; tiles compare the rest
    rest = members.join(buckets, "entry").where(F.col("node") != F.col("b"))
    rest = written(rest.select("entry", "node", "n", "b", close("n", "m").alias("close")), "members")
    pairs = written(rest.select(F.col("node").alias("a"), "b", "close").distinct(), "pairs")
    asked = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    rows = nodes.join(asked, "node").select("node", "row.id", "row.key")
    rows = written(rows, "asked")
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows  # 24 bytes each; beyond that, texts are moved
    texts = given.join(rows, ["id", "key"]).groupBy("node").agg(F.min("text").alias("text"))
    texts = written(texts, "texts")
    links = written(_verified(pairs.where("close").select("a", "b"), texts, similarity, size), "verified")
    stars = components(links)
    more = written(_links_of_meeting(rest.select("entry", "node", "n"), texts, stars, similarity, size), "verified")
    found = components(more.unionByName(stars.toDF("a", "b"))) if not more.isEmpty() else stars

    grouped = nodes.select("node", "digest", "row").join(found.withColumnRenamed("id", "node"), "node", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "node"))
    firsts = grouped.groupBy("component").agg(F.min("row").alias("first"))
    grouped = grouped.join(firsts, "component").select("digest", "first")
    own = F.struct("id", "key")
    every = sketches.select("id", "key", "digest").distinct().join(grouped, "digest", "left")
    first = F.coalesce("first", own)
    return every.select("id", "key", first["id"].alias("class_id"), (first == own).alias("stays"))


def _key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return hold(docs, key_=F.struct(F.col(id_col).cast("long").alias("id"), _key(text_col).alias("key")))


def with_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns of `docs` with `class_id`; null where the id is null."""
    classes = near_duplicates(docs, id_col, text_col, **options).select(F.struct("id", "key").alias("key_"), "class_id")
    return give_back(_with_key(docs, id_col, text_col).join(classes, "key_", "left"), docs, ["class_id"])


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document with the smallest id of every class, once; rows with a null id all stay."""
    classes = near_duplicates(docs, id_col, text_col, **options)
    first = classes.where("stays").select(F.struct("id", "key").alias("key_"))
    held = _with_key(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    kept = give_back(held.join(first, "key_", "left_semi").dropDuplicates(["key_"]), docs, [])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
