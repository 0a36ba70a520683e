"""Near-duplicate classes by HyperMinHash, banding and exact confirmation.

Sketches. The shingles of a document go through REPEATS hash functions. Each deals them to four
buckets and stores of the smallest hash of each bucket the number of leading zeros and ten bits
of mantissa, 16 bits in all. The four registers of a repeat are a band. Two documents of
similarity J agree in a band with probability about J**4, so at 0.75 they share none of the 40
bands once in four million times.

Candidates. Documents with equal shingle sets, told by a 128-bit digest of the whole set, are one
node. Within the nodes of a band key, all are paired with the oldest one alone. Pairs whose
similarity, estimated from all registers and corrected for chance collisions, is `sigmas` standard
errors below the threshold are left out (with `sigmas` None no pair is); the others are confirmed on
their full sets. Confirmed links give components.

Then a closure: wherever a band key holds nodes of several components, its nodes are dealt to blocks,
a large component to blocks of its own and small ones together, and those likely linked are compared
on their full sets for each two blocks that hold different components. Blocks of one component never
meet, so a key that one group of copies fills costs work in proportion to its size, and no link
between components is lost. Of the links that join the same components one is kept.

Everything is a distributed join or aggregate; groups are pre-aggregated, hot pivots and hot nodes
salted and oversize band keys split to blocks. Only counts come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import LAST_ID, discard, documents, ids, map_texts, materialize, partitions, pieces, texts, unused

SHINGLE, PERCENT = 5, 75
REPEATS, BUCKETS, MANTISSA = 40, 4, 10
REGISTERS = REPEATS * BUCKETS
#: Chance that registers of different minima are equal: of equal leading zeros, 1 / 3, and mantissa.
COLLISION = 2.0**-MANTISSA / 3
SIGMAS = 5.0
#: Members that one task confirms against a pivot, and nodes of a band key compared at once.
SALT, BLOCK = 64, 512
#: Links of one node that a task joins with its label.
HOT = 100_000
#: Shingles hashed at once, for the cache, and columns of an incidence matrix.
STRIDE, COLUMNS = 1 << 15, 4096

SKETCHES = "doc_id long, text_key long, n_shingles long, digest binary, sketch binary"
CLASSES = "doc_id long, n_shingles long, component_id long, kept boolean"


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, first of each text)."""
    data, offsets = K.text_buffer(column)
    words = K.split_words(K.LOWER[data], offsets)
    hashes = K.word_hashes(words)
    counts = words.counts
    at, grams = K.window_hashes(hashes, words.first, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = K.mix(K.range_hash(K.prefix_hash(hashes, 0xE7037ED1A0B428DB), words.first[:-1][short], words.first[1:][short]) + counts[short].astype(K.U64))
    doc = np.concatenate([np.searchsorted(words.first, at, side="right") - 1, short])
    values = np.concatenate([grams, whole])
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


_SEEDS = K.mix(np.arange(1, REPEATS + 1, dtype=K.U64) * K.U64(0xA24BAED4963EE407))
_FACTORS = K.mix(np.arange(101, 101 + REPEATS, dtype=K.U64) * K.U64(0x9FB21C651E98DF25)) | K.U64(1)
_EMPTY = K.U64(K._MASK)
_INNER = K.U64((1 << 62) - 1)


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers of each set (REPEATS x BUCKETS codes of 16 bits); 0 is an empty bucket."""
    n = len(first) - 1
    least = np.full((REPEATS, BUCKETS, n), _EMPTY)
    some = np.flatnonzero(np.diff(first))
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(first[some + 1], first[some[at]] + STRIDE, side="right")))
        own = some[at:to]
        part, begin = values[first[own[0]] : first[own[-1] + 1]], first[own] - first[own[0]]
        for j in range(REPEATS):
            x = (part ^ _SEEDS[j]) * _FACTORS[j]
            x ^= x >> K.U64(29)
            x *= K.U64(0xBF58476D1CE4E5B9)
            bucket = (x >> K.U64(62)).astype(np.uint8)
            x &= _INNER
            for b in range(BUCKETS):
                least[j, b, own] = np.minimum.reduceat(np.where(bucket == b, x, _EMPTY), begin)
        at = to
    return codes(least.transpose(2, 0, 1).reshape(n, REGISTERS))


def codes(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 62-bit minima, plus 1."""
    value = least >> K.U64(9)  # 53 bits, exact as floats
    exponent = np.frexp(value.astype(np.float64))[1]
    zeros = (53 - exponent).astype(K.U64)
    mantissa = ((value << zeros) & K.U64((1 << 52) - 1)) >> K.U64(52 - MANTISSA)
    return np.where(least == _EMPTY, 0, (zeros << K.U64(MANTISSA)) + mantissa + K.U64(1)).astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each repeat of each sketch."""
    four = registers.reshape(-1, REPEATS, BUCKETS).astype(K.U64)
    packed = four[:, :, 0] | four[:, :, 1] << K.U64(16) | four[:, :, 2] << K.U64(32) | four[:, :, 3] << K.U64(48)
    return K.mix(packed + K.mix(np.arange(1, REPEATS + 1, dtype=K.U64))).view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, sigmas: float | None = SIGMAS) -> np.ndarray:
    """Whether the estimated similarity of sketches (rows) does not rule out the threshold."""
    if sigmas is None:
        return np.ones(np.broadcast_shapes(a.shape, b.shape)[:-1], dtype=bool)
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    seen = ((a == b) & (a != 0)).sum(axis=-1) / np.maximum(used, 1)
    estimate = (seen - COLLISION) / (1 - COLLISION)
    t = PERCENT / 100
    return estimate >= t - sigmas * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def unpack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """SKETCHES rows of (doc_id, text)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, first = shingle_sets(texts(batch))
            made = sketches(values, first)
            digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids(batch)), batch.column("text_key"), pa.array(np.diff(first), pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in made], pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "digest", "sketch"],
            )

        return each

    return map_texts(docs.withColumn("text_key", F.xxhash64("text")), make, SKETCHES)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(unpack(batch.column("sketch")))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("node").take(pa.array(np.repeat(np.arange(len(keys)), REPEATS)))], names=["key", "node"])


def _estimated(sigmas: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = likely(unpack(batch.column("sketch_a")), unpack(batch.column("sketch_b")), sigmas)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _across(part: pa.Table, sigmas: float | None) -> pa.Table:
    """The rows of two blocks of a band key (or one) that are likely linked across components."""
    component = part["component"].to_numpy()
    sketch = unpack(part["sketch"])
    left, right = _sides(part)
    wanted = np.zeros(len(component), dtype=bool)
    for x in left.tolist():
        others = right[component[right] != component[x]]
        if len(others):
            others = others[likely(sketch[x][None], sketch[others], sigmas)]
            wanted[others] = True
            wanted[x] |= len(others) > 0
    return part.select(["key", "i", "j", "side", "node", "component"]).filter(pa.array(wanted))


def _sides(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two blocks that meet, or twice those of one that meets itself."""
    side = part["side"].to_numpy()
    left = np.flatnonzero(side == 0)
    return left, np.flatnonzero(side == 1) if (side == 1).any() else left


def _compare(part: pa.Table) -> pa.Table:
    """Links across components between two blocks of a band key (or within one), confirmed on full
    sets: all intersections at once, as products of incidence matrices over a stretch of shingles.
    Of links that join the same components one is returned."""
    node, component = part["node"].to_numpy(), part["component"].to_numpy()
    values, first = shingle_sets(texts(part))
    sizes, owner = np.diff(first), np.repeat(np.arange(len(node)), np.diff(first))
    left, right = _sides(part)
    _, which, many = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(many > 1) - 1
    shared = many[which] > 1
    which, owner = column[which[shared]], owner[shared]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    row = [np.full(len(node), -1), np.full(len(node), -1)]
    row[0][left], row[1][right] = np.arange(len(left)), np.arange(len(right))
    for lo in range(0, int(which[-1]) + 1 if len(which) else 0, COLUMNS):
        a, b = np.searchsorted(which, [lo, lo + COLUMNS])
        sides = []
        for at, n in zip(row, (len(left), len(right))):
            here = at[owner[a:b]]
            side = np.zeros((n, COLUMNS), np.float32)
            side[here[here >= 0], which[a:b][here >= 0] - lo] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    linked = 100 * both >= PERCENT * (sizes[left][:, None] + sizes[right][None, :] - both)
    linked &= component[left][:, None] != component[right][None, :]
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while x in group:
            x = group[x]
        return x

    found = []
    for x, y in np.argwhere(linked).tolist():
        a, b = root(int(component[left[x]])), root(int(component[right[y]]))
        if a != b:
            group[max(a, b)] = min(a, b)
            found.append((node[left[x]], node[right[y]]))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, role): the pivot's text, then those of its members."""
    pivot, members = None, np.zeros(0, K.U64)
    for batch in batches:
        for piece in pieces(batch):
            values, first = shingle_sets(texts(piece))
            a, b, role = (piece.column(c).to_pylist() for c in ("a", "b", "role"))
            linked = []
            for r, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                if role[r] == 0:
                    pivot, members = a[r], values[lo:hi].copy()
                elif a[r] == pivot:
                    own = values[lo:hi]
                    at = np.searchsorted(members, own)
                    both = int((members[np.minimum(at, len(members) - 1)] == own).sum()) if len(members) else 0
                    if 100 * both >= PERCENT * (len(members) + len(own) - both):
                        linked.append(r)
            if linked:
                yield pa.RecordBatch.from_arrays([pa.array([a[r] for r in linked], pa.int64()), pa.array([b[r] for r in linked], pa.int64())], names=["a", "b"])


def estimate(pairs: DataFrame, nodes: DataFrame, sigmas: float | None = SIGMAS) -> DataFrame:
    """The distinct pairs (a, b) that sizes and sketches do not rule out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_estimated(sigmas), "a long, b long")


def confirm(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; `held` is (node, text)."""
    parts = partitions(pairs.sparkSession)
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    pivots = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("a", F.col("a").alias("b"), "salt", F.lit(0).alias("role"))
    members = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    wanted = pivots.unionByName(members)
    rows = wanted.join(held.select(F.col("node").alias("b"), "text"), "b").select("a", "b", "salt", "role", "text")
    return rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_confirm, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node it is connected to.

    Each round takes the smallest label among neighbours and then the label of that label, so stars
    settle in two rounds and chains in a logarithmic number. The links of a node that has more than
    HOT are dealt to several tasks, each with a copy of its label.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    busy = materialize(both.groupBy("b").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts")).where("salts > 1"), "busy")
    dealt = both.join(busy, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        told_by = labels.select(F.col("node").alias("b"), "component").join(busy, "b", "left")
        told_by = told_by.select("b", "component", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        near = dealt.join(told_by, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        told = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        over = labels.select(F.col("node").alias("new"), F.col("component").alias("next"))
        made = materialize(told.join(over, "new").select("node", F.least("new", "next").alias("component"), (F.least("new", "next") != F.col("old")).alias("moved")), "labels")
        moved = made.where("moved").limit(1).count()
        discard(labels)
        labels = made
        if not moved:
            discard(both)
            discard(busy)
            return labels.select("node", "component")


def meetings(placed: DataFrame) -> DataFrame:
    """(key, i, j, side, node, component) for the nodes of each two blocks of a band key that hold
    different components, or of one block that does. `placed` is (key, node, component).

    A component of at least BLOCK nodes in a key has blocks of its own, numbered by its nodes' hash;
    smaller ones are dealt whole to blocks that they share.
    """
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    whole = sizes.groupBy("key").agg(F.count("*").alias("components"), F.sum(F.when(F.col("c") < BLOCK, F.col("c")).otherwise(0)).alias("small")).where("components > 1").drop("components")
    own = sizes.join(whole, "key")
    large = F.col("c") >= BLOCK
    own = own.select("key", "component", F.when(large, F.col("component")).otherwise(-1).alias("owner"), F.ceil(F.when(large, F.col("c")).otherwise(F.col("small")) / BLOCK).cast("int").alias("blocks"))
    number = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number")
    blocks = own.select("key", "owner", "blocks").distinct().select("key", "owner", number)
    names = lambda x: blocks.select("key", F.struct("owner", "number").alias(x))
    pairs = names("i").join(names("j"), "key").where("i <= j and (i.owner != j.owner or i.owner = -1)")
    dealt = F.when(F.col("owner") == -1, F.xxhash64("component")).otherwise(F.xxhash64("node"))
    nodes = placed.join(own, ["key", "component"]).select("key", "node", "component", F.struct("owner", F.pmod(dealt, F.col("blocks")).cast("int").alias("number")).alias("block"))
    sides = pairs.withColumn("side", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    sides = sides.withColumn("block", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    said = lambda x: F.xxhash64(f"{x}.owner", f"{x}.number").alias(x)
    return nodes.join(sides, ["key", "block"]).select("key", said("i"), said("j"), "side", "node", "component")


def grouped(docs: DataFrame, sigmas: float | None = SIGMAS) -> DataFrame:
    """(doc_id, text_key, n_shingles, component, component_id) of each row of (doc_id, text).

    A null id is LAST_ID here. A text without shingles has no component.
    """
    made = materialize(sketch_documents(docs), "sketches")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    sets = made.where("n_shingles > 0").groupBy("digest").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = materialize(sets.select(F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"), "digest", "n_shingles", "sketch"), "nodes")

    bands = nodes.select("node", "sketch").mapInArrow(_keyed, "key long, node long")
    several = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    meeting = materialize(bands.join(several, "key"), "bands")
    pairs = meeting.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    # the texts that can have a partner, once, for both rounds of confirmation
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("rep"), F.xxhash64("text").alias("text_key"), "text")
    partnered = nodes.select("node", "rep", "text_key").join(meeting.select("node").distinct(), "node", "left_semi")
    held = materialize(keyed.join(partnered, ["rep", "text_key"]).select("node", "text"), "texts")
    told = materialize(estimate(pairs, nodes, sigmas), "pairs")
    links = materialize(confirm(told, held), "links")
    labels = components(links)

    # closure: band keys that hold several components
    placed = meeting.select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    placed = materialize(placed.join(mixed, "key"), "placed")
    spread = meetings(placed)
    across = lambda part: _across(part, sigmas)
    likely_ = spread.join(nodes.select("node", "sketch"), "node").groupBy("key", "i", "j").applyInArrow(across, "key long, i long, j long, side int, node long, component long")
    more = materialize(likely_.join(held, "node").groupBy("key", "i", "j").applyInArrow(_compare, "a long, b long").distinct(), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    for table in (meeting, held, told, links, placed, more):  # the result reads sketches, nodes and labels
        discard(table)

    named = nodes.select("node", "rep", "digest").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    oldest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = named.join(oldest, "component").select("digest", "component", "component_id")
    return made.select("doc_id", "text_key", "n_shingles", "digest").join(classes, "digest", "left").drop("digest")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sigmas: float | None = SIGMAS) -> DataFrame:
    """One row of CLASSES for each document.

    Shingles are SHINGLE words, with A-Z in lower case; a text of fewer words is one shingle. Linked
    are documents with 100 * intersection >= PERCENT * union; component_id is the smallest id that
    links lead to, the own one included. A text without words is linked with nothing. kept says that
    the id is its component's; rows that repeat that id are all kept. `sigmas` None confirms every pair
    of a band key on full sets, whatever its estimate.
    """
    component = F.coalesce("component_id", "doc_id")
    said = lambda c: F.when(c != LAST_ID, c)
    return grouped(documents(docs, id_col, text_col), sigmas).select(said(F.col("doc_id")).alias("doc_id"), "n_shingles", said(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, but of each group of near duplicates only the one with
    the smallest id. Texts without words all stay; of rows that repeat id and text one stays."""
    rows = materialize(grouped(documents(docs, id_col, text_col)), "classes")
    key = F.struct("doc_id", "text_key").alias("key")
    winners = rows.where("component is not null").groupBy("component").agg(F.min(key).alias("key")).select("key.*")
    stay = winners.unionByName(rows.where("component is null").select("doc_id", "text_key").distinct())
    names = unused(docs, "doc_id", "text_key")
    tagged = docs.withColumns({names[0]: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)), names[1]: F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    kept = tagged.join(stay.toDF(*names), names, "left_semi")
    repeats = rows.where("component is not null").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key").toDF(*names)
    if repeats.limit(1).count():
        # an aggregate, so copies of a row are combined where they are read
        once = kept.join(repeats, names, "left_semi").dropDuplicates(names)
        kept = kept.join(repeats, names, "left_anti").unionByName(once)
    return kept.drop(*names)
