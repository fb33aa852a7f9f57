"""Benchmark decontamination: a broadcast set of normalised test n-grams is matched
against every window of every training text.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters, ASCII
lower-cased. An item with n or more words gives all its windows of n words; a shorter
one, but not an empty one, is a single window.

The window set is broadcast: arrays of window hashes, word ids and items, about 60 bytes a
window. Its size is checked: a pass holds at most `max_pass_bytes` of item text, and a
larger benchmark is scanned in several passes, one after the other, each written before
the next set is made. So what is held and broadcast at a time never grows with the data.
Cutting goes round all passes until none finds a window: what one pass's cut joins may be
a window of another.

Defined cases: a null or wordless text has no words and no hits; a null item_id or a
wordless item is ignored; items that share an id count once; repeated rows give
repeated results; an empty benchmark hits nothing; other columns pass through as they
are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import giving, load, materialise, runs, utf8

WINDOW = 8
MAX_PASS_BYTES = 2 << 20
CHUNK_BYTES = 1 << 20
_KEEP = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_TABLE = bytes(x if x in _KEEP else 32 for x in bytes(range(256)).lower())
_PRIMES = (np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BREAK = b"|"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class WindowSet:
    """Item windows by length, found by a rolling hash and then verified word by word."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        index, found = {x: k for k, x in enumerate(self.names)}, {}
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], dtype=np.int32)
            if size := min(n, len(ids)):
                rows = np.lib.stride_tricks.sliding_window_view(ids, size)
                found.setdefault(size, []).append((rows, np.full(len(rows), index[item], dtype=np.int32)))
        #: by length: hashes, word ids, and starts into the items of each distinct window
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in found.items():
            rows, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            mixed = _mix(rows.astype(np.uint64))
            order = np.lexsort((owner, *rows.T, mixed))
            rows, owner, mixed = rows[order], owner[order], mixed[order]
            first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))))
            self.by_size[size] = mixed[first], rows[first], np.append(first, len(rows)), owner

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, number of words, items) of every window in a sequence of word ids."""
        known = ids > 0
        if not known.any():
            return
        seen = np.concatenate(([0], np.cumsum(known)))
        for size, (hashes, rows, starts, owner) in self.by_size.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(seen[size:] - seen[:-size] == size)
            if not len(at):
                continue
            mixed = _mix(ids[at[:, None] + np.arange(size)].astype(np.uint64))
            place = np.searchsorted(hashes, mixed)
            some = np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == mixed)
            for i, k, m in zip(at[some].tolist(), place[some].tolist(), mixed[some], strict=True):
                while k < len(hashes) and hashes[k] == m:
                    if (rows[k] == ids[i : i + size]).all():
                        yield i, size, {self.names[x] for x in owner[starts[k] : starts[k + 1]].tolist()}
                        break
                    k += 1


def _mix(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        out += rows[:, k] * _PRIMES[k % 64] * _PRIMES[(k // 64) % 64]
    return out


def scan(texts: list[bytes], index: WindowSet) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: number of words, merged hit ranges of words, items whose windows occur."""
    clean = [t.translate(_TABLE) for t in texts]
    for lo, hi in runs([len(t) for t in clean], CHUNK_BYTES):
        words = (b" %s " % _BREAK).join(clean[lo:hi]).split()
        ends = [*(i for i, w in enumerate(words) if w == _BREAK), len(words)]
        if len(ends) != hi - lo:
            raise AssertionError("texts and breaks differ")
        ids = np.fromiter(map(index.vocab.get, words, repeat(0)), dtype=np.int64, count=len(words))
        starts = np.array([0, *(e + 1 for e in ends[:-1])], dtype=np.int64)
        found: dict[int, tuple[list, set]] = {}
        for i, size, items in sorted(index.hits(ids), key=lambda h: h[:2]):
            doc = int(np.searchsorted(starts, i, side="right")) - 1
            ranges, names = found.setdefault(doc, ([], set()))
            a, b = i - int(starts[doc]), i - int(starts[doc]) + size
            if ranges and a <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            else:
                ranges.append((a, b))
            names |= items
        for k in range(hi - lo):
            ranges, names = found.get(k, ([], set()))
            yield ends[k] - int(starts[k]), ranges, names


_FOUND = "n_words bigint, ranges array<struct<start:bigint,end:bigint>>, items array<string>"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t")).where("item is not null and t is not null")


def _pass_count(benchmark: DataFrame, max_pass_bytes: int) -> int:
    size = _items(benchmark).agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("item") + 64), F.lit(0))).first()[0]
    return max(1, -(-size // max_pass_bytes))


def _passes(benchmark: DataFrame, n: int, count: int) -> Iterator[Broadcast]:
    """The window set of each pass, broadcast while it is in use."""
    rows = _items(benchmark)
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "t"), F.lit(count)) == k)
        held = benchmark.sparkSession.sparkContext.broadcast(WindowSet([(r.item, r.t.encode()) for r in part.toLocalIterator()], n))
        yield held
        if count > 1:
            held.unpersist()


def find_windows(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_pass_bytes: int = MAX_PASS_BYTES) -> DataFrame:
    """doc_id, n_words, ranges (merged hit word ranges, end exclusive) and items of each row of docs."""
    base, count = docs.select("doc_id", "text"), _pass_count(benchmark, max_pass_bytes)

    def one(held: Broadcast, frame: DataFrame, keys: list[str]) -> DataFrame:
        # an Arrow stream of records: key columns, then what was found
        kinds = frame.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(scan(utf8(b.column(b.schema.get_field_index("text"))), held.value))
                made = [
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in g[1]] for g in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(g[2]) for g in got], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in keys] + made, names=[*keys, "n_words", "ranges", "items"])

        heads = ", ".join(f"{k} {kinds[k].dataType.simpleString()}" for k in keys)
        return frame.mapInArrow(giving(run), f"{heads}, {_FOUND}")

    if count == 1:
        return one(next(_passes(benchmark, n, 1)), base, ["doc_id"])
    keyed = base.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    found, counts = None, keyed
    for held in _passes(benchmark, n, count):
        part = materialise(one(held, keyed, ["doc_id", "text_hash"]), "pass")
        if found is None:
            counts = part.select("doc_id", "text_hash", "n_words")
        part = part.where(F.size("items") > 0).dropDuplicates(["doc_id", "text_hash"])
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("ranges")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    seen = counts.alias("c").join(merged.alias("m"), F.col("c.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("c.text_hash") == F.col("m.text_hash")), "left")
    step = F.aggregate(
        F.array_sort(F.coalesce("m.r", F.array().cast("array<struct<start:bigint,end:bigint>>"))),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return seen.select(F.col("c.doc_id").alias("doc_id"), F.col("c.n_words").alias("n_words"), step.alias("ranges"), F.coalesce("m.i", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_items: int = 2, remove: str = "both", max_pass_bytes: int = MAX_PASS_BYTES) -> DataFrame:
    """docs without contaminated rows (remove="documents": rows with windows of min_items
    items or more go), with the hit words cut out of their texts (remove="spans": again
    until no window is left), or both: rows of min_items items go, the others' hits are cut.
    All columns stay; n_chars, where there is one, follows the text. A benchmark above
    max_pass_bytes is applied pass by pass: items are joined per text, spans are cut round
    and round."""
    if remove not in ("documents", "spans", "both"):
        raise ValueError(f"remove is {remove!r}, not documents, spans or both")
    count = _pass_count(benchmark, max_pass_bytes)

    def cut(held: Broadcast, frame: DataFrame, drop: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.schema.get_field_index("text")
                texts = utf8(b.column(at))
                got = list(scan(texts, held.value))
                if drop:
                    stays = [len(g[2]) < min_items for g in got]
                    b = b.filter(pa.array(stays, pa.bool_()))
                    texts, got = ([x for x, s in zip(xs, stays, strict=True) if s] for xs in (texts, got))
                yield b if remove == "documents" else _cut(b, at, texts, got, held.value)

        return frame.mapInArrow(giving(run), docs.schema)

    if count == 1:
        return cut(next(_passes(benchmark, n, 1)), docs, remove != "spans")
    if remove != "spans":
        bad = None
        for held in _passes(benchmark, n, count):
            part = materialise(_items_of(docs, held), "items")
            bad = part if bad is None else bad.unionByName(part)
        bad = bad.groupBy("k").agg(F.size(F.array_distinct(F.flatten(F.collect_list("items")))).alias("n")).where(F.col("n") >= min_items).select("k")
        docs = docs.join(bad, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["k"], "left_anti")
        if remove == "documents":
            return docs
    again = True
    while again:
        again = False
        for held in _passes(benchmark, n, count):
            if not _items_of(docs, held).isEmpty():
                docs, again = materialise(cut(held, docs, False), "cut"), True
    return docs


def _cut(b: pa.RecordBatch, at: int, texts: list[bytes], got: list, index: WindowSet) -> pa.RecordBatch:
    hit = {i: _without(texts[i], g[1]) for i, g in enumerate(got) if g[1]}
    if not hit:
        return b
    todo = list(hit)
    while todo:  # what a cut joins may be a window again
        again = [(i, g) for i, g in zip(todo, scan([hit[i] for i in todo], index), strict=True) if g[1]]
        hit |= {i: _without(hit[i], g[1]) for i, g in again}
        todo = [i for i, _ in again]
    columns = list(b.columns)

    def changed(k: int, value) -> None:
        values = columns[k].to_pylist()
        for i, t in hit.items():
            values[i] = value(t)
        columns[k] = pa.array(values, b.schema.field(k).type)

    changed(at, bytes.decode)
    if "n_chars" in b.schema.names:
        changed(b.schema.get_field_index("n_chars"), lambda t: len(t.decode()))
    return pa.RecordBatch.from_arrays(columns, schema=b.schema)


def _items_of(docs: DataFrame, held) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [sorted(g[2]) for g in scan(utf8(b.column(1)), held.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.list_(pa.string()))], names=["k", "items"])

    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text")
    return keyed.mapInArrow(giving(run), "k bigint, items array<string>").where(F.size("items") > 0).dropDuplicates(["k", "items"])


def _without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the words of these ranges and what stands between them."""
    flags = np.frombuffer(text.translate(_TABLE), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_windows(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT item, len(w) AS n, array_to_string(w, ' ') AS win FROM iw WHERE len(w) BETWEEN 1 AND 7
  UNION
  SELECT item, 8 AS n, array_to_string(list_slice(w, i, i + 7), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - 6)) AS i FROM iw WHERE len(w) >= 8)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT d.rid, d.i, d.n, win.item FROM dwin d JOIN win ON d.n = win.n AND d.win = win.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY rid)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
  coalesce(its.n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
