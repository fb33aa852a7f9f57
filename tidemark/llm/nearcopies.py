"""Near copies: texts whose word-shingle sets have Jaccard similarity 0.8 or more, found by
SimHash fingerprints in tries and verified shingle by shingle.

Texts of equal shingle sets are one node, with a fingerprint of 128 bits: the majority of
two 64-bit hashes of each shingle. Sets of similarity 0.8 differ in a seventh of the bits at
random, far below `MAX_BITS`. Nodes meet in groups: each is dealt to the `KEYS` smallest of
its shingle hashes. In one order of all hashes every hash of a union is shared with
probability s, so two sets of similarity s meet nowhere with probability (1 - s)**KEYS; sets
of up to `KEYS` shingles always meet. Groups are read twice:

1. each node is held against one leader of each of its groups, and the closest is verified:
   a plain aggregation and join, whatever a group's size. Components of these links follow;
2. in each group that spans two components or more, the nodes outside the largest visit all
   others: the fingerprints of a block are joined as a binary trie, and near pairs of two
   components leave the block as stars, never as pairs. Large groups are split into blocks
   of `BLOCK_ROWS`, each with the group's visitors, so no task holds a large group. Sets of
   nodes that these stars span go to one place, again by pairs of blocks where there are
   many, and each near pair of two components is counted exactly there. Each block returns
   stars of verified links, so no step writes a row for each pair of a group.

A key shared by more than `HOT` nodes (a passage that many texts repeat) does not gather
texts that have enough keys of their own: a node with `COLD` keys below that size leaves
such groups, since a near copy of it would share one of those. At a similarity of exactly
0.8 this and the keys together lose a link with probability 3e-6, less above it; nothing
else is left out, and links are only made at `SIMILARITY` or more, by exact counts.

Defined cases: null, empty and blank texts have the empty set and are one node; fewer
words than a shingle make one shingle of all of them; null and repeated doc_ids are rows
like any other; extra columns pass through. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import flagged, giving, materialise, remove, runs, utf8
from tidemark.llm.graph import components
from tidemark.llm.simhash import hook, keep_found, text_hash, trie_links

SHINGLE = 5
SIMILARITY = 0.8
SEED = 43
KEYS = 16
MAX_BITS, SMALL_BITS, SMALL = 38, 44, 16  # of 128; the second where a set has at most SMALL shingles
HOT, COLD = 512, 12
BLOCK_ROWS, SET_ROWS = 1024, 512
COLUMNS = 4096
CHUNK_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted."""
    words = text.lower().split()
    if len(words) <= shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = [b" ".join(s) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, SEED) for p in parts], dtype=np.uint64))


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit words of majority bits for each set."""
    out = np.zeros((len(sets), 2), dtype=np.uint64)
    counts = np.array([len(s) for s in sets], dtype=np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        h = np.concatenate(sets)
        second = h * _ODD
        second = (second ^ (second >> np.uint64(29))) * _ODD
        bits = np.unpackbits(np.stack([h, second ^ (second >> np.uint64(32))], axis=1).astype("<u8").view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(sums * 2 > counts[some][:, None], axis=1, bitorder="little").view("<u8")
    return out


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least common shingles for similarity 0.8 (4 of 5): 9 x common >= 4 x (a + b)."""
    return -(-4 * (a + b) // 9)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


_NODE = "n int, f bigint, g bigint, keys array<bigint>"


def _nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, node, n (shingles), f and g (fingerprint) and keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(2))
            for lo, hi in runs([len(t) for t in texts], CHUNK_BYTES):
                sets = [shingles(t, shingle) for t in texts[lo:hi]]
                prints = fingerprints(sets).view(np.int64)
                made = [
                    pa.array(_signed(np.array([node_of(s) for s in sets], dtype=np.uint64))),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(prints[:, 0].copy()),
                    pa.array(prints[:, 1].copy()),
                    pa.array([_signed(s[:KEYS]) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in (b.column(0), b.column(1))] + made, names=["doc_id", "text_hash", "node", "n", "f", "g", "keys"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(f"text_hash bigint, node bigint, {_NODE}").fields])
    return docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(giving(run), schema)


def _near(n: Column, m: Column, bits: Column) -> Column:
    """Whether sizes and fingerprint bits allow the similarity."""
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (bits <= F.when(F.least(n, m) <= SMALL, SMALL_BITS).otherwise(MAX_BITS))


def _with_leaders(groups: DataFrame) -> DataFrame:
    """a, b: each node and the closest leader of its groups that is near enough."""
    bits = F.bit_count(F.col("f").bitwiseXOR(F.col("leader.f"))) + F.bit_count(F.col("g").bitwiseXOR(F.col("leader.g")))
    held = groups.where("node <> leader.node").select("node", "n", F.col("leader.node").alias("to"), F.col("leader.n").alias("m"), bits.cast("int").alias("bits"))
    best = held.where(_near(F.col("n"), F.col("m"), F.col("bits"))).groupBy("node").agg(F.min(F.struct("bits", "to")).alias("best"))
    return best.select(F.least("node", "best.to").alias("a"), F.greatest("node", "best.to").alias("b")).distinct()


def block_pairs(n: np.ndarray, f: np.ndarray, g: np.ndarray, root: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of near pairs of different roots, one of the two at least the block's own."""
    order = np.argsort(f)
    n, root, own = n[order], root[order], own[order]
    for i, j in trie_links(f[order], SMALL_BITS, wide=g[order]):
        least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        may = (root[i] != root[j]) & (own[i] | own[j]) & (least * 5 >= most * 4)
        i, j = i[may], j[may]
        if len(i):
            x, y = order[i], order[j]
            bits = np.bitwise_count(f[x] ^ f[y]).astype(np.int64) + np.bitwise_count(g[x] ^ g[y])
            near = bits <= np.where(np.minimum(n[i], n[j]) <= SMALL, SMALL_BITS, MAX_BITS)
            yield x[near], y[near]


def _across(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Stars a, b of near pairs of a group in different components."""
    hot = groups.where(F.col("size") > HOT).groupBy("node").agg(F.count(F.lit(1)).alias("hot"))
    cold = F.least("n", F.lit(KEYS)) - F.coalesce("hot", F.lit(0))
    leaves = (F.col("size") > HOT) & ((cold >= COLD) | ((F.col("n") <= KEYS) & (cold * 5 > F.col("n"))))
    placed = groups.join(roots.withColumnsRenamed({"node": "k"}), F.col("node") == F.col("k"), "left").join(hot, "node", "left").where(~leaves)
    placed = materialise(placed.select("key", "node", "n", "f", "g", F.coalesce("root", "node").alias("root")), "placed")
    shares = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    rows = placed.join(mixed.select("key", F.col("most.root").alias("main"), blocks.alias("blocks")), "key")
    rows = rows.withColumn("spot", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = F.when((F.col("root") == F.col("main")) | (F.col("blocks") == 1), F.array("spot")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.select(F.col("key"), F.explode(to).alias("block"), "spot", "node", "n", "f", "g", "root")
    dealt = dealt.select("key", "block", (F.col("block") == F.col("spot")).alias("own"), "node", "n", "f", "g", "root")

    def near(t: pa.Table) -> pa.RecordBatch | None:
        node, n, f, g, root = (t.column(c).to_numpy() for c in ("node", "n", "f", "g", "root"))
        own = t.column("own").to_numpy(zero_copy_only=False)
        if len(node) < 2 or (root == root[0]).all():
            return None
        parent = np.arange(len(node))
        for i, j in block_pairs(n.astype(np.int64), f.view(np.uint64), g.view(np.uint64), root, own):
            hook(parent, i, j)
        return _star(node, parent)

    return dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(giving(_by_group(near)), "a bigint, b bigint").distinct()


def _star(node: np.ndarray, parent: np.ndarray) -> pa.RecordBatch:
    member = np.flatnonzero(parent != np.arange(len(parent)))
    return pa.RecordBatch.from_arrays([pa.array(node[member]), pa.array(node[parent[member]])], names=["a", "b"])


def _by_group(close: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by their first two columns: what close makes of each group of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = (np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(x)], strict=True):
                here = (int(x[lo]), int(y[lo]))
                if held and here != last:
                    made = close(pa.Table.from_batches(held))
                    held.clear()
                    if made is not None:
                        yield made
                last = here
                held.append(b.slice(lo, hi - lo))
        if held and (made := close(pa.Table.from_batches(held))) is not None:
            yield made

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray], near: np.ndarray) -> np.ndarray:
    """Shingles that each near pair of a left and a right set has in common; elsewhere anything."""
    out = np.zeros(near.shape, dtype=np.int64)
    i, j = np.nonzero(near)
    if len(i) <= 4 * (len(left) + len(right)):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            out[x, y] = len(np.intersect1d(left[x], right[y], assume_unique=True))
        return out
    sides = [np.concatenate(s) for s in (left, right)]
    both = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    owner, column = [], []
    for flat, sets in zip(sides, (left, right), strict=True):
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        known = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        by = np.argsort(at[known], kind="stable")
        owner.append(np.repeat(np.arange(len(sets)), [len(x) for x in sets])[known][by]), column.append(at[known][by])
    for lo in range(0, len(both), COLUMNS):
        hi, dense = min(len(both), lo + COLUMNS), []
        for who, what, sets in zip(owner, column, (left, right), strict=True):
            a, z = np.searchsorted(what, [lo, hi])
            x = np.zeros((len(sets), hi - lo), dtype=np.float32)
            x[who[a:z], what[a:z] - lo] = 1
            dense.append(x)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _counted(members: DataFrame) -> DataFrame:
    """Stars a, b of verified links between members(cluster, node, n, f, g, root, set) of one
    cluster and different roots."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / SET_ROWS).cast("int")
    rows = members.join(sizes.select("cluster", blocks.alias("blocks")), "cluster").withColumn("spot", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select("cluster", "spot", "node", "n", "f", "g", "root", "set", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    both = F.least("spot", "other").cast("bigint") * F.col("blocks") + F.greatest("spot", "other")
    dealt = rows.select("cluster", both.alias("both"), (F.col("spot") <= F.col("other")).alias("left"), (F.col("spot") >= F.col("other")).alias("right"), "node", "n", "f", "g", "root", "set")

    def linked(t: pa.Table) -> pa.RecordBatch | None:
        node, n, f, g, root = (t.column(c).to_numpy() for c in ("node", "n", "f", "g", "root"))
        sides = [np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right")]
        (i, j), n = sides, n.astype(np.int64)
        if not len(i) or not len(j) or (root == root[0]).all():
            return None
        least, most = np.minimum.outer(n[i], n[j]), np.maximum.outer(n[i], n[j])
        bits = np.bitwise_count(np.bitwise_xor.outer(f[i], f[j]).view(np.uint64)) + np.bitwise_count(np.bitwise_xor.outer(g[i], g[j]).view(np.uint64))
        near = (root[i][:, None] != root[j]) & (least * 5 >= most * 4) & (bits <= np.where(least <= SMALL, SMALL_BITS, MAX_BITS))
        if not near.any():
            return None
        sets = [np.frombuffer(x, "<u8") for x in t.column("set").to_pylist()]
        common = common_counts([sets[k] for k in i], [sets[k] for k in j], near)
        x, y = np.nonzero(near & (common >= needed(least, most)))
        parent = np.arange(len(node))
        hook(parent, i[x], j[y])
        return _star(node, parent)

    return dealt.repartition("cluster", "both").sortWithinPartitions("cluster", "both").mapInArrow(giving(_by_group(linked)), "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, rows: DataFrame, ends: DataFrame, shingle: int) -> DataFrame:
    """node, set of the nodes in ends(node), read from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(t, shingle).astype("<u8").tobytes() for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["node", "set"])

    one = rows.join(ends, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    one = materialise(one, "texts")
    hashed = docs.select(text_hash().alias("text_hash"), "text")
    asked = flagged(hashed, F.col("text_hash"), one.select(F.col("text_hash").alias("key")), "asked").where("asked")
    texts = asked.join(one, "text_hash").select("node", "text")
    return texts.mapInArrow(giving(run), "node bigint, set binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= needed(len(x), len(y)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(giving(run), "a bigint, b bigint")


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, root (a node that names the component) of every row."""
    rows = materialise(_nodes(docs, shingle), "rows")
    nodes = rows.where("n > 0").select("node", "n", "f", "g", "keys").dropDuplicates(["node"])
    dealt = materialise(nodes.select(F.explode("keys").alias("key"), "node", "n", "f", "g"), "dealt")
    chosen = F.min_by(F.struct("node", "n", "f", "g"), F.xxhash64("node", "key"))
    leaders = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), chosen.alias("leader")).where("size > 1")
    groups = materialise(dealt.join(leaders, "key"), "groups")
    _drop(dealt)

    pairs = materialise(_with_leaders(groups), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = materialise(_sets(docs, rows, ends, shingle), "sets")
    links = materialise(_verified(pairs, sets), "links")
    _drop(sets)
    first = materialise(components(links), "first")
    clusters = materialise(components(_across(groups, first)).withColumnsRenamed({"root": "cluster"}), "clusters")
    _drop(groups)
    placed = nodes.select("node", "n", "f", "g").join(clusters, "node").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sets = materialise(_sets(docs, rows, clusters.select("node"), shingle), "sets")
    more = materialise(_counted(placed.join(sets, "node")), "more")
    _drop(sets)
    found = first if more.isEmpty() else components(links.unionByName(more))
    return rows.select("doc_id", "text_hash", "node").join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def _drop(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, path)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, chosen as simhash.keep_one does."""
    return keep_found(docs, materialise(near_copies(docs), "found"))
