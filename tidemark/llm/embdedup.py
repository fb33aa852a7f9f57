"""Embedding near-duplicates through an inverted multi-index.

Two codebooks, one for each half of the vectors, form a product grid of cells. Every
vector is indexed in the cell of its two nearest codewords. Each vector then visits
cells in order of their distance (the multi-sequence order: the sum of the two halves'
squared distances) up to its own cell's distance plus a margin, and is compared with the
vectors there in double precision. Of a pair's two cells the smaller one's vector is the
visitor, so a pair is compared at most once. The margin is set on the fitting sample: it is
the one at which neighbours at a cosine spread evenly between the threshold and one, and
the sample's own near pairs, would be found with TARGET recall. No cell or candidate is
capped.

Equal vectors are first folded into one with a count. Cells are dealt by their first
codeword; a codeword with many vectors or visitors is split into blocks of both, each
pair of blocks a group of its own, so no task holds a hot cell. Groups return sums of
links and a star per linked set, never pairs.

Only the codebooks' fit reads a sample (SAMPLE vectors of smallest hash); all vectors are
indexed and search.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers,
and rows with a null id, link with nothing; vectors of different widths link with
nothing of another width; repeated rows are vectors of their own; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import load, materialise
from tidemark.llm.graph import components

THRESHOLD = 0.9
TARGET = 0.99
SAMPLE = 16_384
CELL_ROWS = 16
MAX_CODES = 1024
BLOCK_ROWS, VISITOR_ROWS = 1024, 8192


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _squared(x, codes).argmin(1)
        sums, counts = np.zeros_like(codes), np.bincount(at, minlength=len(codes))
        np.add.at(sums, at, x)
        codes = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), len(codes))])
    return codes


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray, margin: float = 0.0):
        self.first, self.second, self.margin = first, second, margin

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squared(x[:, :half], self.first), _squared(x[:, half:], self.second)

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """Own cell, and by first codeword the second codewords to visit, of each vector."""
        width = len(self.second)
        order1, order2 = d1.argsort(1), d2.argsort(1)
        for row in range(len(d1)):
            o1, o2, a, b = order1[row], order2[row], d1[row], d2[row]
            sorted2, own = b[o2], int(o1[0]) * width + int(o2[0])
            bound = a[o1[0]] + sorted2[0] + self.margin
            out = []
            for i in o1.tolist():
                many = int(np.searchsorted(sorted2, bound - a[i], side="right"))
                if not many:
                    break
                cells = o2[:many][i * width + o2[:many] >= own]
                if len(cells):
                    out.append((i, cells))
            yield own, out


def build(sample: np.ndarray, distinct: int, threshold: float = THRESHOLD, target: float = TARGET) -> MultiIndex:
    """Codebooks and margin from unit rows; `distinct` is how many vectors will be indexed."""
    codes = int(2 ** round(math.log2(max(1.0, math.sqrt(distinct / CELL_ROWS)))))
    codes, half = min(codes, MAX_CODES), sample.shape[1] // 2
    index = MultiIndex(kmeans(sample[:, :half], codes), kmeans(sample[:, half:], codes))
    rng = np.random.default_rng(12)
    v = sample[rng.permutation(len(sample))[:4096]]
    noise = rng.standard_normal(v.shape)
    noise -= (noise * v).sum(1, keepdims=True) * v
    size = np.sqrt((noise * noise).sum(1, keepdims=True))
    noise = np.divide(noise, size, out=np.zeros_like(noise), where=size > 1e-9)
    c = rng.uniform(threshold, 1, (len(v), 1))
    pairs = [(v, c * v + np.sqrt(1 - c * c) * noise)]
    near = np.argwhere(np.triu(v @ v.T >= threshold, 1))
    if len(near) >= 100:
        near = near[rng.permutation(len(near))[:4096]]
        pairs.append((v[near[:, 0]], v[near[:, 1]]))
    for x, y in pairs:
        (x1, x2), (y1, y2) = index.distances(x), index.distances(y)
        cx, cy = (d1.argmin(1) * len(index.second) + d2.argmin(1) for d1, d2 in ((x1, x2), (y1, y2)))
        swap = (cx > cy)[:, None]
        d1, d2, to = np.where(swap, y1, x1), np.where(swap, y2, x2), np.maximum(cx, cy)
        at = np.arange(len(to))
        need = d1[at, to // len(index.second)] + d2[at, to % len(index.second)] - d1.min(1) - d2.min(1)
        index.margin = max(index.margin, float(np.quantile(need, target)) + 1e-9)
    return index


def _matrix(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


_FOUND = "a bigint, b bigint, n bigint"


def _links(width: int, threshold: float):
    """Rows (group, kind, id, cell, copies, vector, cells) by group, vectors (kind 0) before visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, cells, copies, rows, gained = None, None, None, None, None, None
        held: list[tuple] = []

        def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            parent, i, j = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
            while len(i):
                x, y = parent[i], parent[j]
                apart = x != y
                i, j, x, y = i[apart], j[apart], x[apart], y[apart]
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                while (parent[parent] != parent).any():
                    parent = parent[parent]
            member = np.flatnonzero(parent != np.arange(len(nodes)))
            return nodes[member], nodes[parent[member]]

        def emit(a, b, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            kinds = batch.column(1).to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                own_ids, own_cells, own_copies = (part.column(i).to_numpy() for i in (2, 3, 4))
                x = _matrix(part.column(5), width)
                if keys[lo] != group:
                    group, held = keys[lo], []
                if kinds[lo] == 0:
                    held.append((own_ids, own_cells, own_copies, x))
                    continue
                if not held:
                    continue
                if len(held) > 1 or rows is not held[0][3]:
                    held = [tuple(np.concatenate(c) for c in zip(*held, strict=True))]
                    order = held[0][1].argsort(kind="stable")
                    held = [tuple(c[order] for c in held[0])]
                ids, cells, copies, rows = held[0]
                wanted = part.column(6)
                flat = wanted.flatten().to_numpy()
                who = np.repeat(np.arange(hi - lo), np.diff(wanted.offsets.to_numpy()))
                by = flat.argsort(kind="stable")
                flat, who = flat[by], who[by]
                sums: dict[str, list] = {"i": [], "j": []}
                edges = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]))
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    l, r = np.searchsorted(flat, cells[s]), np.searchsorted(flat, cells[s], side="right")
                    for k in range(l, r, 2048):
                        q = who[k : min(r, k + 2048)]
                        i, j = np.nonzero(x[q] @ rows[s:e].T >= threshold)
                        i, j = q[i], j + s
                        fresh = (own_cells[i] != cells[j]) | (own_ids[i] < ids[j])
                        sums["i"].append(i[fresh]), sums["j"].append(j[fresh])
                i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in sums.values())
                if len(i):
                    mine = np.bincount(i, copies[j], minlength=len(own_ids)).astype(np.int64)
                    theirs = np.bincount(j, own_copies[i], minlength=len(ids)).astype(np.int64)
                    yield emit(own_ids[mine > 0], [None] * int((mine > 0).sum()), mine[mine > 0])
                    yield emit(ids[theirs > 0], [None] * int((theirs > 0).sum()), theirs[theirs > 0])
                    a, b = star(own_ids[i], ids[j])
                    yield emit(a, b, [0] * len(a))
        yield emit([], [], [])

    return run


def _search(nodes: DataFrame, width: int, threshold: float) -> DataFrame:
    """nodes(id, copies, v) of one width: rows (a, b, n) as _links makes them."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    index = build(unit(np.array([r.v for r in sample], dtype=np.float64)), nodes.count(), threshold)
    sent = spark.sparkContext.broadcast(index)
    kind = nodes.schema["v"].dataType
    schema = T.StructType([*T.StructType.fromDDL("code int, kind int, id bigint, cell bigint, copies bigint").fields, T.StructField("v", kind), T.StructField("cells", T.ArrayType(T.LongType()))])
    names = [f.name for f in schema.fields]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_index = sent.value
        seconds = len(own_index.second)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                d1, d2 = own_index.distances(_matrix(part.column(2), width))
                row, code, kinds, cell, cells = [], [], [], [], []
                for r, (own, visits) in enumerate(own_index.visits(d1, d2)):
                    row.append(r), code.append(own // seconds), kinds.append(0), cell.append(own), cells.append([])
                    for i, js in visits:
                        row.append(r), code.append(i), kinds.append(1), cell.append(own), cells.append(i * seconds + js)
                at = pa.array(row, pa.int64())
                taken = [part.column(i).take(at) for i in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(kinds, pa.int32()), taken[0], pa.array(cell, pa.int64()), taken[1], taken[2], pa.array(cells, pa.list_(pa.int64()))], names=names)

    dealt = materialise(nodes.select("id", "copies", "v").mapInArrow(deal, schema), "dealt")
    sizes = {(r.code, r.kind): r.n for r in dealt.groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 x MAX_CODES rows
    blocks = {c: (-(-sizes.get((c, 0), 0) // BLOCK_ROWS), -(-sizes.get((c, 1), 0) // VISITOR_ROWS)) for c, _ in sizes}
    table = spark.createDataFrame([(c, max(1, p), max(1, q)) for c, (p, q) in blocks.items()], "code int, p int, q int")
    known = dealt.join(F.broadcast(table), "code")
    spot = F.pmod(F.xxhash64("id"), F.when(F.col("kind") == 0, F.col("p")).otherwise(F.col("q"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 0, F.col("q")).otherwise(F.col("p")) - 1))
    spread = known.withColumn("spot", spot).withColumn("other", other)
    key = F.when(F.col("kind") == 0, F.struct("code", F.col("spot").alias("p"), F.col("other").alias("q"))).otherwise(F.struct("code", F.col("other").alias("p"), F.col("spot").alias("q")))
    packed = spread.withColumn("group", F.xxhash64(key["code"], key["p"], key["q"])).select("group", "kind", "id", "cell", "copies", "v", "cells")
    return packed.repartition("group").sortWithinPartitions("group", "kind").mapInArrow(_links(width, threshold), _FOUND)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding)."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    sound = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("h", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("v")))
    folded = rows.where("h is not null").groupBy("h", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(folded, "vectors")
    found = None
    for (width,) in sorted(tuple(r) for r in nodes.select(F.size("v")).distinct().collect()):
        part = _search(nodes.where(F.size("v") == width), width, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "links")
    sums = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnsRenamed({"node": "id"})
    told = nodes.join(sums, "id", "left").join(roots, "id", "left")
    told = materialise(told.select("h", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "told")
    alone = F.coalesce("root", "vec_id")
    return (
        rows.alias("r")
        .join(told.alias("t"), (F.col("r.h") == F.col("t.h")) & (F.col("r.v") == F.col("t.v")), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), alone.alias("component_id"), F.coalesce(F.col("vec_id") == alone, F.lit(False)).alias("kept"))
    )


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM s a JOIN s b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, CAST((SELECT count(*) FROM e WHERE e.x = vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = x
"""
