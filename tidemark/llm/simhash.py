"""SimHash near-duplicates by a binary-trie self-join.

A text's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles.
Equal fingerprints are one node. Two nodes within `MAX_BITS` = 3 differing bits agree on
one of four 16-bit blocks at least, so each fingerprint is dealt to four groups (block,
value). A group above `GROUP_ROWS` fingerprints is dealt again, by four blocks of its
other bits, and once more until four levels are used; what is left of such a group can
hold no more than 2**20 different fingerprints, however many rows there are. Every
group is then joined with itself as a binary trie: pairs of trie nodes are walked down
together, the differing bits of their prefixes are added up, and a pair over the budget
is pruned. Links within a group leave it as a star on each linked set, never as all
pairs; no link between different fingerprints is lost, since the stars of all groups
together span the same components.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of all of them; rows with a null
doc_id get a fingerprint, and the smallest non-null doc_id of their component (null if
there is none); repeated doc_ids give one row each; other columns do not matter. Texts
are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import flagged, fresh, load, materialise, runs, utf8
from tidemark.llm.graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
GROUP_ROWS = 512
LEVELS = 4
CHUNK_BYTES = 1 << 20


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints of UTF-8 texts."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo, hi in runs([len(t) for t in texts], CHUNK_BYTES):
        hashes: list[int] = []
        ends = np.empty(hi - lo, dtype=np.int64)
        for k in range(lo, hi):
            words = texts[k].lower().split()
            if len(words) > shingle:
                hashes += [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
            elif words:
                hashes.append(digest(b" ".join(words), SEED))
            ends[k - lo] = len(hashes)
        counts = np.diff(ends, prepend=0)
        some = np.flatnonzero(counts)
        if len(some):
            bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, (ends - counts)[some], axis=0, dtype=np.int32)
            major = sums * 2 > counts[some][:, None]
            out[lo + some] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def trie_links(points: np.ndarray, most: int = MAX_BITS, leaf: int = 4096, wide: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into sorted uint64 points) within `most` differing bits. `wide` holds the
    second 64 bits of longer fingerprints, which count too; the trie is over the first.

    A trie node is a range of the sorted points with a common prefix. Node pairs carry
    the differing bits so far; one over the budget is dropped, and one of at most `leaf`
    point pairs is compared directly.
    """
    todo = [(np.array([[0, len(points), 0, len(points), 0]], dtype=np.int64), 63)]
    while todo:
        pairs, bit = todo.pop()
        area = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        done = (area <= leaf) | (bit < 0)
        if done.any():
            yield from _leaves(points, pairs[done], most, wide)
        pairs = pairs[~done]
        if not len(pairs):
            continue
        if len(pairs) > 65536:
            todo += [(pairs[i : i + 65536], bit) for i in range(0, len(pairs), 65536)]
            continue
        split = []
        for at in (0, 2):
            lo, hi = pairs[:, at], pairs[:, at + 1]
            head = points[lo] >> np.uint64(bit) >> np.uint64(1) << np.uint64(1) | np.uint64(1)
            split.append(np.clip(np.searchsorted(points, head << np.uint64(bit)), lo, hi))
        a0, a1, b0, b1, diff = pairs.T
        am, bm = split
        same = (a0 == b0) & (a1 == b1)
        kids = [
            np.stack([a0, am, b0, bm, diff], 1),
            np.stack([am, a1, bm, b1, diff], 1),
            np.stack([a0, am, bm, b1, diff + 1], 1),
            np.stack([am, a1, b0, bm, diff + 1], 1)[~same],
        ]
        kids = np.concatenate(kids)
        todo.append((kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= most)], bit - 1))


def _leaves(points: np.ndarray, pairs: np.ndarray, most: int, wide: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo in range(0, len(pairs), 256):
        a0, a1, b0, b1, _ = pairs[lo : lo + 256].T
        na, nb = a1 - a0, b1 - b0
        area = na * nb
        which = np.repeat(np.arange(len(area)), area)
        k = np.arange(area.sum()) - np.repeat(np.cumsum(area) - area, area)
        i, j = a0[which] + k // nb[which], b0[which] + k % nb[which]
        apart = np.bitwise_count(points[i] ^ points[j])
        near = (i < j) & ((apart if wide is None else apart + np.bitwise_count(wide[i] ^ wide[j])) <= most)
        if near.any():
            yield i[near], j[near]


def hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Puts both ends of every link under one root, in place; every node hangs on its root."""
    while True:  # hook roots on smaller roots, then shorten, until these links are inside
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def stars(points: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) of each linked set of distinct sorted points, centres left out."""
    parent = np.arange(len(points))
    for i, j in trie_links(points, most):
        hook(parent, i, j)
    member = np.flatnonzero(parent != np.arange(len(points)))
    return points[member], points[parent[member]]


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, key, fp) sorted by (path, key): each group's stars."""
    held: list[np.ndarray] = []
    last: tuple[int, int] | None = None
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def close() -> None:
        points = np.unique(np.concatenate(held))
        if len(points) > 1:
            for side, got in zip((a, b), stars(points), strict=True):
                side.append(got)

    def out() -> pa.RecordBatch:
        sides = [pa.array(np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64)) for x in (a, b)]
        a.clear(), b.clear()
        return pa.RecordBatch.from_arrays(sides, names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        path, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(path) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
            here = (int(path[lo]), int(key[lo]))
            if held and here != last:
                close()
                held.clear()
            last = here
            held.append(fp[lo:hi].view(np.uint64))
        yield out()
    if held:
        close()
    yield out()


def _blocks(bits: list[int], parts: int = 4) -> list[list[int]]:
    return [bits[len(bits) * k // parts : len(bits) * (k + 1) // parts] for k in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _deal(frame: DataFrame, paths: dict[int, list[int]]) -> tuple[DataFrame, dict[int, list[int]]]:
    """Each row dealt to the four sub-blocks of its path. paths: bits fixed so far, by path."""
    made: dict[int, list[int]] = {}
    options = F.lit(None)
    for path, fixed in paths.items():
        free = [x for x in range(64) if x not in fixed]
        four = []
        for k, block in enumerate(_blocks(free)):
            made[path * 4 + k] = fixed + block
            four.append((path * 4 + k, sum(1 << x for x in fixed + block)))
        options = F.when(F.col("path") == path, F.array(*(F.struct(F.lit(p).alias("path"), F.lit(_signed(m)).alias("mask")) for p, m in four))).otherwise(options)
    rows = frame.select("fp", F.explode(options).alias("o"))
    return rows.select(F.col("o.path").alias("path"), F.col("fp").bitwiseAND(F.col("o.mask")).alias("key"), "fp"), made


def link_fingerprints(nodes: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) that span the components of distinct fingerprints nodes(fp)."""
    level, paths = nodes.withColumn("path", F.lit(0)), {0: []}
    edges = None
    for depth in range(LEVELS):
        rows, paths = _deal(level, paths)
        counts = rows.groupBy("path", "key").count()
        last = depth == LEVELS - 1
        if not last:
            hot = materialise(counts.where(F.col("count") > group_rows).select("path", "key"), "hot")
            cold = rows.join(hot, ["path", "key"], "left_anti")
        else:
            cold = rows
        dealt = cold.select("path", "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key")
        part = dealt.mapInArrow(_join_groups, "a bigint, b bigint")
        edges = part if edges is None else edges.unionByName(part)
        if last or hot.isEmpty():
            return edges
        level = materialise(rows.join(hot, ["path", "key"], "left_semi").select("path", "fp"), "dealt")
    return edges


def fingerprint_rows(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (of the whole text) and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(utf8(b.column(2)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", text_hash().alias("text_hash"), "text")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint that names the component), component_id of every row."""
    rows = materialise(fingerprint_rows(docs, shingle), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(link_fingerprints(nodes.select("fp"), group_rows)).withColumnsRenamed({"node": "fp"})
    placed = materialise(nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "placed")
    named = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    known = materialise(placed.join(named, "root").select("fp", "root", "component_id"), "known")
    return rows.join(known, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each near-duplicate group: its smallest doc_id (null ids last;
    of equal ids the smallest text hash). All columns stay."""
    return keep_found(docs, near_duplicates(docs, shingle))


def keep_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """keep_one for groups found(doc_id, text_hash, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    own_hash, keep_id, keep_hash, nth = (fresh(docs, c) for c in ("_text_hash", "_keep_id", "_keep_hash", "_nth"))
    keep = found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.d").alias(keep_id), F.col("k.h").alias(keep_hash))
    keep = materialise(keep, "keep")
    own_key, suspect = F.xxhash64("doc_id", "text_hash"), fresh(docs, "_suspect")
    kept_key = F.xxhash64(keep_id, keep_hash)
    # rows that go, and rows met more than once: only what may be one of these is shuffled, the rest just stays
    counts = found.groupBy(own_key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    some = counts.join(keep.select(kept_key.alias("kept")), F.col("key") == F.col("kept"), "left").where("kept is null or n > 1").select("key")
    own = docs.withColumn(own_hash, text_hash())
    own = flagged(own, F.xxhash64("doc_id", own_hash), materialise(some, "suspects"), suspect)
    stays = own.where(~F.col(suspect)).select(*docs.columns)
    kept = own.where(F.col(suspect)).join(keep, F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(own_hash) == F.col(keep_hash)))
    once = Window.partitionBy(keep_id, keep_hash).orderBy(F.lit(0))
    return stays.unionByName(kept.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).select(*docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
