"""Language-model scores from a hierarchical Pitman-Yor model over word bigrams.

Restaurants: one for each token that is seen before another and one for the start of a
text, all sharing one parent (the unigram restaurant), whose base is uniform over the
training words and one unknown word. In each restaurant a word's customers sit at tables;
the number of tables is resampled by Gibbs from its conditional, proportional to
S_d(c, t) a^t, with S_d the generalised Stirling numbers and a the weight of a new table
through the parent. Above STIRLING customers the Chinese-restaurant process itself is run
in growing steps. Predictive probabilities are averaged over SAMPLES states.

Counts cover the whole training text and stay distributed; each pair (word, token before)
has one home, where all its occurrences meet:

1. words are counted exactly; the TOP most frequent are broadcast, a bounded list, and so
   are their totals as words and as contexts later;
2. each text is coded once, in blocks, and all that is coded is shuffled once. Pairs of two of the DENSE most frequent words are counted by
   word in a table of DENSE x (DENSE + 1) cells, whose probabilities are broadcast. Other
   pairs are dealt into buckets: by the word if it is not a top word, else by the context
   if that is not one, else by both. A bucket thus has every customer of its words in the
   parent, and every table of its contexts but for pairs of two words that are both no top
   words; those are seated in the word's bucket, and their counts are sent to the context's
   too;
3. seating starts with one table a pair. A run of sweeps in each bucket starts from the
   totals of all top words and contexts, which are added up after it for the next run, and
   from what buckets tell each other: a context's bucket is told the tables of its pairs
   that are seated elsewhere, and then tells the words' buckets the context's total. ROUNDS
   runs, then the one whose SAMPLES seatings are scored;
4. each bucket returns its share of every text's score. Pairs of two words that are no top
   words are scored in the context's bucket, where the word's probabilities are sent, one
   message from bucket to bucket.

All pairs are resampled. Totals from other buckets are those of the run before; sums stay
exact, so the probabilities of a context add up to one. No pair is dropped. A word with
over 1/TOP of the tokens is a top word, so no bucket is hot. Words are identified by 63-bit
hashes.

Defined cases: a null, empty or blank text is its end token alone; without training
texts N and V are zero and every score is that of the uniform base; repeated and null
doc_ids give a row each; other columns are not read. docs must give the same rows in the same
order when a task is run again, as a table does: blocks are numbered by task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, give_back, load, materialise, runs, utf8

TOP = 65_000
DENSE = 2048
RANGE = 64
CODES = 1 << 16
START, RARE = CODES - 2, CODES - 1
BIG = np.uint64(1 << 63)
D0, THETA0 = 0.75, 10.0
D1, THETA1 = 0.8, 10.0
BURN_IN, SAMPLES, ROUNDS = 2, 4, 3
STIRLING = 64
DRAWN_CELLS = 1 << 19
MIN_BUCKETS, BUCKET_TOKENS, MOST_TASKS = 64, 1_000_000, 20_000
SLICES = 16
PASSES = 2
BLOCK_BYTES = 8 << 20
LEAST_BYTES = BLOCK_BYTES // 65_000  # so that a block has under 2**16 texts
CHUNK_BYTES = 1 << 20
FLUSH_WORDS = 300_000
END = b" end"
END_HASH = xxhash.xxh64_intdigest(END) | 1 << 63


# --- counting -------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """h (hash of a token, ends included) and n of the texts of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            h = np.fromiter((xxhash.xxh64_intdigest(w) | 1 << 63 for w in seen), dtype=np.uint64, count=len(seen))
            n = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for b in batches:
            texts = utf8(b.column(0))
            for t in texts:
                seen.update(t.lower().split())
                if len(seen) > FLUSH_WORDS:
                    yield out()
            if texts:
                seen[END] += len(texts)
        yield out()

    return docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Words:
    """The top words, most frequent first: hashes, training counts and log10 base probabilities."""

    hashes: np.ndarray
    counts: np.ndarray
    base: np.ndarray

    def coder(self):
        order = np.argsort(self.hashes)
        ranked = self.hashes[order]
        known: dict[bytes, int] = {}

        def code(tokens: list[bytes]) -> np.ndarray:
            """Per token: its rank among the top words, or its hash, which is at least BIG."""
            got = list(map(known.get, tokens))
            at = [i for i, x in enumerate(got) if x is None]
            if at:
                h = np.fromiter((xxhash.xxh64_intdigest(tokens[i]) | 1 << 63 for i in at), dtype=np.uint64, count=len(at))
                place = np.minimum(np.searchsorted(ranked, h), max(0, len(ranked) - 1))
                top = ranked[place] == h if len(ranked) else np.zeros(len(h), bool)
                for k in np.flatnonzero(top).tolist():
                    known[tokens[at[k]]] = got[at[k]] = int(order[place[k]])
                for k in np.flatnonzero(~top).tolist():
                    got[at[k]] = 0
                ids = np.array(got, dtype=np.uint64)
                ids[np.array(at)[~top]] = h[~top]
                return ids
            return np.array(got, dtype=np.uint64)

        return code


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids >> np.uint64(31) & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)


def _mixed(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    x = w * np.uint64(0x9E3779B97F4A7C15) ^ (u + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _homes(w: np.ndarray, u: np.ndarray, mixed: np.ndarray, buckets: int) -> np.ndarray:
    return np.where(w >= BIG, _bucket(w, buckets), np.where(u >= BIG, _bucket(u, buckets), mixed % np.uint64(buckets)))


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([x for a in arrays for x in (ord(a.dtype.char), len(a))], dtype="<u4")
    return np.uint32(len(arrays)).tobytes() + head.tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    head, at, out = np.frombuffer(blob, "<u4", 2 * n, 4), 4 + 8 * n, []
    for kind, size in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(blob, chr(kind), size, at))
        at += out[-1].nbytes
    return out


def shut(blob: bytes, level: int = 1) -> bytes:
    """Compressed, for what is shuffled: entropy coding halves ranks and counts, Spark's own codec does not."""
    return zstandard.ZstdCompressor(level=level).compress(blob)


def opened(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _split(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as 16-bit ranks, RARE for hashes, and the hashes."""
    big = ids >= BIG
    return np.where(big, np.uint64(RARE), ids).astype(np.uint16), ids[big]


def _joined(ranks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = ranks.astype(np.uint64)
    out[ranks == RARE] = hashes
    return out


def _pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, contexts, training counts, occurrences."""
    w, w_hashes, u, u_hashes, c, m = unpack(blob)
    return _joined(w, w_hashes), _joined(u, u_hashes), c, m


_CODED = "kind int, bucket int, block bigint, idx int, held boolean, n_tokens bigint, known bigint, base double, codes binary, types binary, probes binary"


def code_texts(docs: DataFrame, held: Column, words: Words, buckets: int, dense: int) -> DataFrame:
    """Rows of three kinds: 0 texts with their dense pairs, 1 the other pairs of a block and
    bucket, 2 training counts of dense pairs of a range."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    names = [*(x.split()[0] for x in _CODED.split(", ")), "doc_id"]
    width = dense + 1

    def rows(doc_ids: pa.Array, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"kind": pa.int32(), "bucket": pa.int32(), "block": pa.int64(), "idx": pa.int32(), "held": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64()}
        made = [pa.array(columns[c], kinds.get(c, pa.binary())) if c in columns else pa.nulls(n, kinds.get(c, pa.binary())) for c in names[:-1]]
        return pa.RecordBatch.from_arrays([*made, doc_ids], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base, seen = sent.value.coder(), sent.value.base, sent.value.counts > 0
        waiting: list[np.ndarray] = []
        counts = np.zeros(dense * width, dtype=np.uint32)
        kind = pa.null()
        blocks = 0

        def count() -> None:
            if waiting:
                at, n = np.unique(np.concatenate(waiting), return_counts=True)
                counts[at] += n.astype(np.uint32)
                waiting.clear()

        for b in batches:
            kind = b.column(0).type
            out = b.column(2).to_pylist()
            long = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for lo, hi in runs([max(n, LEAST_BYTES + 1) for n in long], BLOCK_BYTES):
                texts = utf8(b.column(1).slice(lo, hi - lo))
                block = TaskContext.get().partitionId() << 32 | blocks
                blocks += 1
                totals: list[int] = []
                codes: list[bytes] = []
                known: list[np.ndarray] = []
                bases: list[np.ndarray] = []
                others: list[tuple[np.ndarray, ...]] = []
                for a, z in runs(long[lo:hi], CHUNK_BYTES):
                    tokens: list[bytes] = []
                    ends: list[int] = []
                    for t in texts[a:z]:
                        tokens += t.lower().split()
                        tokens.append(END)
                        ends.append(len(tokens))
                    ids = code(tokens)
                    sizes = np.diff(ends, prepend=0)
                    before = np.concatenate((np.array([START], dtype=np.uint64), ids[:-1]))
                    before[np.array(ends[:-1], dtype=np.int64)] = START
                    doc = np.repeat(np.arange(a, z), sizes)
                    train = ~np.array(out[lo + a : lo + z], dtype=bool)[doc - a]
                    top = ids < BIG
                    ranks = ids[top].astype(np.int64)
                    known.append(np.bincount(doc[top] - a, seen[ranks], minlength=z - a).astype(np.int64))
                    bases.append(np.bincount(doc[top] - a, base[ranks], minlength=z - a))
                    near = (ids < dense) & ((before < dense) | (before == START))
                    both = (ids[near] * np.uint64(width) + np.minimum(before[near], np.uint64(dense))).astype(np.uint32)
                    waiting.append(both[train[near]])
                    cuts = np.cumsum(np.bincount(doc[near] - a, minlength=z - a))[:-1]
                    codes += [x.tobytes() for x in np.split(both, cuts)]
                    totals += sizes.tolist()
                    others.append((ids[~near], before[~near], doc[~near].astype(np.uint16), train[~near]))
                if sum(map(len, waiting)) > 4_000_000:
                    count()
                n = hi - lo
                yield rows(b.column(0).slice(lo, n), kind=[0] * n, bucket=[int(_bucket(np.array([block * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64), buckets)[0])] * n, block=[block] * n, idx=list(range(n)), held=out[lo:hi], n_tokens=totals, known=np.concatenate(known), base=np.concatenate(bases), codes=codes)
                made = list(_deal(*(np.concatenate(x) for x in zip(*others, strict=True)), buckets))
                if made:
                    yield rows(pa.nulls(len(made), kind), kind=[1] * len(made), bucket=[m[0] for m in made], block=[block] * len(made), types=[m[1] for m in made], probes=[m[2] for m in made])
        count()
        at = np.flatnonzero(counts)
        cuts = np.flatnonzero(np.diff(at // (RANGE * width))) + 1
        parts = np.split(at, cuts) if len(at) else []
        if parts:
            blobs = [np.concatenate([p % (RANGE * width), counts[p]]).astype(np.uint32).tobytes() for p in parts]
            yield rows(pa.nulls(len(parts), kind), kind=[2] * len(parts), bucket=[int(p[0] // (RANGE * width)) for p in parts], types=blobs)
        give_back()

    schema = T.StructType([*T.StructType.fromDDL(_CODED).fields, T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    return docs.select("doc_id", "text", held.alias("held")).mapInArrow(run, schema)


def _deal(w: np.ndarray, u: np.ndarray, doc: np.ndarray, train: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """By bucket: types (word, context, training count, occurrences) and the texts they occur in.
    A type of two rare words also goes, without occurrences, to its context's bucket."""
    if not len(w):
        return
    mixed = _mixed(w, u)
    home = _homes(w, u, mixed, buckets)
    bits = np.uint64(max(1, (buckets - 1).bit_length()))
    order = np.argsort(home << (np.uint64(64) - bits) | mixed >> bits)
    w, u, doc, home = w[order], u[order], doc[order], home[order]
    # equal sort keys of unlike pairs only split a type in two rows, which are added up later
    first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (u[1:] != u[:-1]))))
    c = np.add.reduceat(train[order].astype(np.int64), first)
    m = np.diff(np.append(first, len(w)))
    w, u, home = w[first], u[first], home[first]
    copied = np.flatnonzero((w >= BIG) & (u >= BIG))
    copied = copied[_bucket(u[copied], buckets) != home[copied]]
    every = np.concatenate((np.arange(len(w)), copied))
    m = np.concatenate((m, np.zeros(len(copied), dtype=m.dtype)))
    home = np.concatenate((home, _bucket(u[copied], buckets)))
    order = np.argsort(home, kind="stable")
    every, m, home = every[order], m[order], home[order]
    ends = np.cumsum(m)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(home)) + 1, [len(home)]))
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = every[a:z]
        types = pack(*_split(w[at]), *_split(u[at]), c[at].astype(np.uint32), m[a:z].astype(np.uint32))
        yield int(home[a]), shut(types), shut(doc[ends[a] - m[a] : ends[z - 1]].tobytes())


# --- seating --------------------------------------------------------------------------


class State:
    """What all buckets share, a row for each sample, by 16-bit code: training customers and
    tables of top contexts; parent customers of top words; totals of the parent and the root."""

    def __init__(self, tokens: int, words: int, customers: np.ndarray, added: np.ndarray, before: State | None):
        """added: sums of a run by sample: tables, parent customers, and of rare words the
        parent's customers and tables."""
        self.words, self.customers = words, customers
        self.tables, own, rest = added[:, :CODES], added[:, CODES : 2 * CODES], added[:, 2 * CODES :]
        roots = np.minimum(own, 1)
        if before is not None:
            rng = np.random.default_rng(tokens)
            weights = np.full(CODES, before.fresh[0])
            roots = np.stack([draw_tables(x.astype(np.int64), weights, D0, rng) for x in own])
        self.parents = own.sum(1) + rest[:, 0]
        self.fresh = (THETA0 + D0 * (roots.sum(1) + rest[:, 1])) / (words + 1)
        self.parent = np.stack([self.predictive(own[s], roots[s], s) for s in range(len(own))])

    def predictive(self, own: np.ndarray, roots: np.ndarray, sample: int) -> np.ndarray:
        """The parent's probabilities of words with that many customers and tables."""
        return (own - D0 * roots + self.fresh[sample]) / (THETA0 + self.parents[sample])


def stirling(d: float, most: int = STIRLING) -> np.ndarray:
    """log S_d(c, t) for c, t up to most."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, t - 1], s[c, t] + np.log(np.maximum(c - d * t, 0)))
    return s


_LOGS = {d: stirling(d) for d in (D0, D1)}


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of c customers each when a new table weighs a."""
    t = np.minimum(c, 1).astype(np.int64)
    for most in (4, 16, STIRLING):
        some = np.flatnonzero((c >= 2) & (c <= most) & (c > {4: 1, 16: 4, STIRLING: 16}[most]))
        size = DRAWN_CELLS // most
        for lo in range(0, len(some), size):
            at = some[lo : lo + size]
            steps = np.arange(1, most + 1)
            logits = _LOGS[d][c[at]][:, 1 : most + 1] + np.log(np.maximum(a[at], 1e-300))[:, None] * steps
            p = np.exp(logits - logits.max(1, keepdims=True)).cumsum(1)
            t[at] = 1 + (p < (rng.random(len(at)) * p[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(c > STIRLING)
    if len(many):
        todo, tables, seated = c[many].astype(np.float64), np.ones(len(many)), np.ones(len(many))
        weight = a[many]
        while (open_ := seated < todo).any():
            step = np.where(open_, np.minimum(np.ceil(seated * 0.1), todo - seated), 0)
            fresh = weight / (weight + np.maximum(seated - d * tables, 1e-9))
            tables += rng.binomial(step.astype(np.int64), np.clip(fresh, 0, 1))
            seated += step
        t[many] = tables.astype(np.int64)
    return t


class Pairs:
    """The types of a bucket: w, u and c of each, in order of (w, u)."""

    def __init__(self, w: np.ndarray, u: np.ndarray, c: np.ndarray, bucket: int, buckets: int):
        self.w, self.u, self.c = w, u, c
        self.rare_w, self.rare_u = w >= BIG, u >= BIG
        mine_w = self.rare_w & (_bucket(w, buckets) == bucket)
        mine_u = self.rare_u & (_bucket(u, buckets) == bucket)
        self.at_w, self.at_u = np.flatnonzero(mine_w), np.flatnonzero(mine_u)
        self.words, self.of_w = np.unique(w[self.at_w], return_inverse=True)
        self.contexts, self.of_u = np.unique(u[self.at_u], return_inverse=True)
        self.place_w, self.place_u = np.full(len(w), -1), np.full(len(w), -1)
        self.place_w[self.at_w], self.place_u[self.at_u] = self.of_w, self.of_u
        self.both = self.rare_w & self.rare_u
        self.asked = self.both & mine_w
        many = c >= 2
        self.drawn = np.flatnonzero(many & (~self.both | mine_w))
        # pairs seated here with a context elsewhere, and pairs seated elsewhere with a context here
        self.away, self.copied = np.flatnonzero(many & self.asked & ~mine_u), np.flatnonzero(many & self.both & ~mine_w)

    def own(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.of_w, t[self.at_w], minlength=len(self.words)).astype(np.int64)

    def totals(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.of_u, t[self.at_u], minlength=len(self.contexts)).astype(np.int64)

    def spread(self, at: np.ndarray, rare: np.ndarray, top: np.ndarray, words: bool) -> np.ndarray:
        """Values of the types at `at` by their word or context: own ones of rare, shared ones of top."""
        ids, is_rare, place = (self.w, self.rare_w, self.place_w) if words else (self.u, self.rare_u, self.place_u)
        out = np.zeros(len(at))
        big = is_rare[at]
        out[~big] = top[ids[at[~big]].astype(np.int64)]
        mine = np.flatnonzero(place[at] >= 0)
        out[mine] = rare[place[at[mine]]]
        return out


class Mail:
    """What a bucket is told by others: by sample, the tables beyond one a pair that pairs of
    its contexts have elsewhere; and the tables of the contexts of its pairs `away`."""

    def __init__(self, pairs: Pairs, samples: int, added: list[bytes] = (), totals: list[bytes] = ()):
        self.added = np.zeros((samples, len(pairs.contexts)), dtype=np.int64)
        for u, *over in map(unpack, added):
            at = np.searchsorted(pairs.contexts, u)
            for s, n in enumerate(over):
                np.add.at(self.added[s], at, n)
        self.tables = np.zeros(len(pairs.w))
        if totals:
            u, n = (np.concatenate(x) for x in zip(*map(unpack, totals), strict=True))
            order = np.argsort(u)
            self.tables[pairs.away] = n[order[np.searchsorted(u, pairs.u[pairs.away], sorter=order)]]


def letters(pairs: Pairs, seats: np.ndarray, over: list[np.ndarray], bucket: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """From a bucket after a run, for `answers`: to itself (kind 0) tables of contexts that
    pairs elsewhere have and the buckets of these; to contexts' buckets (kind 1) tables
    beyond one of the pairs that are away, by sample."""
    if len(pairs.copied):
        ask = np.unique(_bucket(pairs.w[pairs.copied], buckets) << np.uint64(32) | pairs.place_u[pairs.copied].astype(np.uint64))
        at, of = np.unique(ask & np.uint64(0xFFFFFFFF), return_inverse=True)
        at = at.astype(np.int64)
        yield bucket, 0, pack(pairs.contexts[at], seats[at].astype(np.uint32), (ask >> np.uint64(32)).astype(np.uint32), of.astype(np.uint32))
    some = np.flatnonzero(np.sum(over, axis=0))
    u = pairs.u[pairs.away[some]]
    to = _bucket(u, buckets).astype(np.int64)
    for x in np.unique(to).tolist():
        mine = to == x
        yield x, 1, pack(u[mine], *(n[some[mine]].astype(np.uint32) for n in over))


def answers(bucket: int, own: bytes, added: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """From a context's bucket before the next run: to words' buckets (kind 0) all tables of
    the contexts; to itself (kind 1) what it was told."""
    u, n, to, of = unpack(own)
    n = n.astype(np.int64)
    for blob in added:
        told, over = unpack(blob)
        np.add.at(n, np.searchsorted(u, told), over)
        yield bucket, 1, blob
    edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        yield int(to[a]), 0, pack(u[of[a:z]], n[of[a:z]].astype(np.uint32))


def seatings(pairs: Pairs, before: State | None, samples: int, seed: int, mail: Mail | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Seatings of a bucket: tables of each type, and of each rare word in the parent its
    customers and tables. Without a state before, the first one: a table for each type."""
    c = pairs.c
    t = np.minimum(c, 1).astype(np.int64)
    own = pairs.own(t)
    roots = np.minimum(own, 1)
    if before is None:
        yield t, own, roots
        return
    rng = np.random.default_rng(seed)
    mail = mail or Mail(pairs, 1)
    drawn = pairs.drawn
    local = drawn[pairs.rare_w[drawn] | pairs.rare_u[drawn]]
    for sweep in range(BURN_IN + samples):
        at = local if sweep < BURN_IN else drawn
        parent = pairs.spread(at, before.predictive(own, roots, 0), before.parent[0], True)
        tables = pairs.spread(at, pairs.totals(t) + mail.added[0], before.tables[0], False) + mail.tables[at]
        t = t.copy()
        t[at] = draw_tables(c[at], (THETA1 + D1 * tables) * parent, D1, rng)
        own = pairs.own(t)
        roots = draw_tables(own, np.full(len(own), before.fresh[0]), D0, rng)
        if sweep >= BURN_IN:
            yield t, own, roots


def sums(pairs: Pairs, before: State | None, samples: int, seed: int, into: np.ndarray, mail: Mail | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Adds what a State is made of, for each sample, to `into`. Returns the tables that own
    contexts have here in the first sample, and by sample those of pairs away beyond one."""
    seats, over = None, []
    top_u, top_w = np.flatnonzero(~pairs.rare_u), np.flatnonzero(~pairs.rare_w)
    u, w = pairs.u[top_u].astype(np.int64), pairs.w[top_w].astype(np.int64)
    for s, (t, own, roots) in enumerate(seatings(pairs, before, samples, seed, mail)):
        seats = pairs.totals(t) if s == 0 else seats
        over.append(t[pairs.away] - 1)
        into[s, :CODES] += np.bincount(u, t[top_u], minlength=CODES)
        into[s, CODES : 2 * CODES] += np.bincount(w, t[top_w], minlength=CODES)
        into[s, 2 * CODES :] += own.sum(), roots.sum()
    return seats, over


def log_probabilities(pairs: Pairs, before: State | None, after: State, seed: int, mail: Mail | None = None, told: Mail | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """log10 of each type's predictive probability, averaged over the samples, zero where both
    are rare; and by sample the tables of own contexts, the parent's probabilities of asked
    types and their tables beyond one. mail is of the run before, told of these samples."""
    told = told or Mail(pairs, len(after.parents))
    every = np.arange(len(pairs.w))
    customers = pairs.spread(every, pairs.totals(pairs.c), after.customers, False)
    p = np.zeros(len(every))
    tables, parents, over = [], [], []
    for s, (t, own, roots) in enumerate(seatings(pairs, before, len(after.parents), seed, mail)):
        tables.append((pairs.totals(t) + told.added[s]).astype(np.uint32))
        over.append((t - np.minimum(pairs.c, 1))[pairs.asked].astype(np.uint32))
        parent = pairs.spread(every, after.predictive(own, roots, s), after.parent[s], True)
        parents.append(parent[pairs.asked].astype(np.float32))
        p += (pairs.c - D1 * t + (THETA1 + D1 * pairs.spread(every, tables[-1], after.tables[s], False)) * parent) / (THETA1 + customers)
    return np.log10(np.where(pairs.both, 1.0, p / len(after.parents))), tables, parents, over


# --- groups of pairs ------------------------------------------------------------------


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Distinct types of a bucket: words, contexts, counts; per row of the blobs its type and occurrences."""
    w, u, c, m = (np.concatenate(x) for x in zip(*map(_pairs, blobs), strict=True))
    order = np.lexsort((u, w))
    w, u = w[order], u[order]
    fresh = np.concatenate(([True], (w[1:] != w[:-1]) | (u[1:] != u[:-1])))
    of = np.empty(len(w), dtype=np.int64)
    of[order] = np.cumsum(fresh) - 1
    return w[fresh], u[fresh], np.bincount(of, c, minlength=int(fresh.sum())).astype(np.int64), of, m


def _dense(bucket: int, counts: np.ndarray, dense: int) -> tuple[Pairs, np.ndarray]:
    """The pairs of a range that occur, and the cells they are in."""
    at = np.flatnonzero(counts)
    w, u = at // (dense + 1) + bucket * RANGE, at % (dense + 1)
    return Pairs(w.astype(np.uint64), np.where(u == dense, START, u).astype(np.uint64), counts[at], bucket, 1), at


def _seed(group: int, run: int) -> int:
    return run << 40 | group


def _table(names: str, *columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for (_, k), c in zip(fields, columns, strict=True)], names=[n for n, _ in fields])


_SUMS = "bucket int, kind int, blob binary"
_SUM, _TOLD, _TYPES = -1, 2, 3  # kinds of rows beside letters, which are 0 and 1
_PARTS = "bucket int, kind int, block bigint, blob binary"


def _slices(total: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(total.ravel(), SLICES)
    return _table(_SUMS, list(range(SLICES)), [_SUM] * SLICES, [zlib.compress(x.astype(np.int64).tobytes(), 1) for x in parts])


def _add_up(frame: DataFrame, samples: int) -> np.ndarray:
    """Sums over all rows of _slices, added by slice; what comes back has one size whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(blob), np.int64)
                held[i] = held[i] + x if i in held else x
        yield _table(_SUMS, list(held), [_SUM] * len(held), [zlib.compress(x.tobytes(), 1) for x in held.values()])

    rows = frame.repartitionById(SLICES, "bucket").mapInArrow(add, _SUMS).collect()
    by = {r.bucket: np.frombuffer(zlib.decompress(r.blob), np.int64) for r in rows}
    if not by:
        return np.zeros((samples, 2 * CODES + 2))
    return np.concatenate([by[i] for i in range(SLICES)]).reshape(samples, -1).astype(np.float64)


def score_texts(docs: DataFrame, held: Column, top_words: int = TOP, dense: int = DENSE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of
    docs(doc_id, text), learning from the rows for which held is false. top_words, at most
    TOP, is the number of words whose totals are broadcast, dense that of words whose pairs
    are. After no rounds the first seating is scored: interpolated absolute discounting."""
    if not 1 <= dense <= top_words <= TOP:
        raise ValueError(f"1 <= dense <= top_words <= {TOP} is not so: {dense}, {top_words}")
    spark = docs.sparkSession
    context = spark.sparkContext
    counted = materialise(word_counts(docs.where(~held)), "words")
    tokens, vocabulary = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counted.orderBy(F.desc("n"), "h").limit(top_words).collect()
    hashes = np.array([r.h for r in top], dtype=np.int64).view(np.uint64)
    counts = np.array([r.n for r in top], dtype=np.int64)
    end = int(np.array([END_HASH], dtype=np.uint64).view(np.int64)[0])
    ends = counted.where(F.col("h") == end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # an end is never a context, the start of a text is one as often
    customers = np.zeros(CODES)
    customers[: len(counts)] = np.where(hashes == np.uint64(END_HASH), 0, counts)
    customers[START] = ends
    buckets = max(MIN_BUCKETS, -(-tokens // BUCKET_TOKENS))
    width = dense + 1
    words = Words(hashes, counts, np.log10((counts + 1) / (tokens + vocabulary + 1)))
    coded = code_texts(docs, held, words, buckets, dense)
    tasks = min(buckets, MOST_TASKS)

    def deal(frame: DataFrame, *order: str, tasks: int = tasks) -> DataFrame:
        """A bucket a task, so that tasks are alike."""
        return frame.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions(*order)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as they are; of each range its counts, of each bucket its types and where they occur."""
        key, blobs, total = None, [], np.zeros(RANGE * width, dtype=np.int64)

        def out(like: pa.RecordBatch) -> pa.RecordBatch:
            if key[0] == 2:
                made = {"types": total.tobytes()}
            else:
                types_ = [opened(x[1]) for x in blobs]
                rows_ = np.array([int(np.frombuffer(x, "<u4", 2, 4)[1]) for x in types_])
                w, u, c, of, m = _merged(types_)
                doc = np.frombuffer(b"".join(opened(x[2]) for x in blobs), np.uint16)
                types = pack(*_split(w), *_split(u), c.astype(np.uint32), np.zeros(0, np.uint32))
                made = {"types": shut(types, 3), "probes": shut(pack(np.array([x[0] for x in blobs], np.int64), rows_, of.astype(np.uint32), m, doc), 3)}
            made |= {"kind": key[0], "bucket": key[1]}
            return pa.RecordBatch.from_arrays([pa.array([made.get(f.name)], f.type) for f in like.schema], schema=like.schema)

        for b in batches:
            if not b.num_rows:
                continue
            kinds, buckets_ = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts_ = int((kinds == 0).sum())  # rows are in order of kind
            if texts_:
                yield b.slice(0, texts_)
            at = {n: b.schema.get_field_index(n) for n in ("block", "types", "probes")}
            for i in range(texts_, b.num_rows):
                now = (int(kinds[i]), int(buckets_[i]))
                if key is not None and now != key:
                    yield out(b)
                    blobs.clear()
                    total[:] = 0
                key = now
                types = b.column(at["types"])[i].as_py()
                if now[0] == 2:
                    cells, n = np.frombuffer(types, "<u4").reshape(2, -1)
                    total[cells] += n
                else:
                    blobs.append((b.column(at["block"])[i].as_py(), types, b.column(at["probes"])[i].as_py()))
        if key is not None:
            yield out(b)
        blobs.clear()
        give_back()

    gathered = materialise(deal(coded, "kind", "bucket", "block").mapInArrow(gather, coded.schema), "gathered")
    ranges = gathered.where("kind = 2").select("bucket", F.col("types").alias("counts"))
    others = gathered.where("kind = 1").select("bucket", F.lit(_TYPES).alias("kind"), F.col("types").alias("blob"), "probes")
    # a task returns sums of one size whatever it reads, so a run has fewer tasks than buckets
    few = max(MIN_BUCKETS, tasks // 8)

    def with_mail(rows: DataFrame, mail: DataFrame | None, tasks: int) -> DataFrame:
        """rows of buckets behind the letters to them."""
        return rows if mail is None else deal(rows.unionByName(mail, allowMissingColumns=True), "bucket", "kind", tasks=tasks)

    def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Pairs, dict[int, list[bytes]], bytes | None]]:
        """Buckets, one's bytes at a time: pairs, letters by kind, and where the pairs occur."""
        mail: dict[int, list[bytes]] = {0: [], 1: [], _TOLD: []}
        for b in batches:
            for i in range(b.num_rows):
                bucket, kind, blob = (c[i].as_py() for c in b.columns[:3])
                if kind != _TYPES:
                    mail[kind].append(blob)
                    continue
                w, u, c, _ = _pairs(opened(blob))
                yield bucket, Pairs(w, u, c.astype(np.int64), bucket, buckets), mail, b.column(3)[i].as_py() if b.num_columns > 3 else None
                mail = {0: [], 1: [], _TOLD: []}

    def answered_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, own, added = None, None, []

        def out() -> pa.RecordBatch:
            return _table(_SUMS, *map(list, zip(*answers(bucket, own, added), strict=True)))

        for b in batches:
            for now, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    if own is not None:
                        yield out()
                    bucket, own, added = now, blob, []
                elif now != bucket:
                    raise RuntimeError(f"bucket {now} has no totals of its contexts")
                else:
                    added.append(blob)
        if own is not None:
            yield out()

    def seated(before: State | None, mail: DataFrame | None, samples: int, run_: int) -> DataFrame:
        """Sums of a run, in slices, and letters."""
        sent_state = context.broadcast(before)

        def of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((samples, 2 * CODES + 2))
            for b in batches:
                for r in b.to_pylist():
                    pairs, _ = _dense(r["bucket"], np.frombuffer(r["counts"], np.int64), dense)
                    sums(pairs, sent_state.value, samples, _seed(r["bucket"], run_), total)
            yield _slices(total)

        def of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((samples, 2 * CODES + 2))
            for bucket, pairs, mail_, _ in buckets_of(batches):
                seats, over = sums(pairs, sent_state.value, samples, _seed(CODES + bucket, run_), total, Mail(pairs, 1, mail_[1], mail_[0]))
                made = list(letters(pairs, seats, over, bucket, buckets))
                if made:
                    yield _table(_SUMS, *map(list, zip(*made, strict=True)))
            yield _slices(total)
            give_back()

        rows = with_mail(others.drop("probes"), mail, few)
        return ranges.mapInArrow(of_ranges, _SUMS).unionByName(rows.mapInArrow(of_buckets, _SUMS))

    before, state, mail, made = None, None, None, None
    final = 1 if rounds == 0 else SAMPLES
    for run_ in range(rounds + 1):  # the last run's seatings are those that are scored
        before, samples = state, final if run_ == rounds else 1
        if run_:
            mail = deal(made.where("kind in (0, 1)"), "bucket", "kind", tasks=few).mapInArrow(answered_letters, _SUMS)
        made = materialise(seated(before, mail, samples, run_), "seated")
        state = State(tokens, vocabulary, customers, _add_up(made.where(f"kind = {_SUM}"), samples), before)
    told = None if mail is None else mail.unionByName(made.where("kind = 1").withColumn("kind", F.lit(_TOLD)))
    shared = context.broadcast((before, state))

    def score_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, after = shared.value
        for b in batches:
            for r in b.to_pylist():
                pairs, at = _dense(r["bucket"], np.frombuffer(r["counts"], np.int64), dense)
                p, *_ = log_probabilities(pairs, own, after, _seed(r["bucket"], rounds))
                yield _table("bucket int, cells binary", [r["bucket"]], [pack(at.astype(np.uint32), p.astype(np.float32))])

    # at most dense x width single-precision numbers, however large the corpus
    table = np.empty((dense, width), dtype=np.float32)
    samples = len(state.parents)
    unseen = np.zeros((dense, width))
    codes = np.append(np.arange(dense), START)
    for s in range(samples):
        unseen += (THETA1 + D1 * state.tables[s][codes]) / (THETA1 + customers[codes]) * state.parent[s][:dense, None]
    table[:] = np.log10(unseen / samples)
    for r in ranges.mapInArrow(score_ranges, "bucket int, cells binary").collect():
        at, p = unpack(r.cells)
        table.ravel()[at + r.bucket * RANGE * width] = p
    sent = context.broadcast(table)

    def score_dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = sent.value.ravel()
        for b in batches:
            scores = [float(flat[np.frombuffer(x, "<u4")].sum(dtype=np.float64)) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64()), pa.nulls(b.num_rows, pa.binary())], names=[*b.schema.names[:-1], "score", "blob"])

    texts = gathered.where("kind = 0").select("block", "kind", "idx", "doc_id", "held", "n_tokens", "known", "base", "codes")
    sums_of = T.StructType([*texts.schema.fields[:-1], *T.StructType.fromDDL("score double, blob binary").fields])
    scored = texts.mapInArrow(score_dense, sums_of)

    nothing = (np.zeros(0, np.uint16), np.zeros(0, np.uint32), np.zeros(0))

    def by_block(blocks: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Blocks and their stretches of rows in order of block."""
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        return ((int(blocks[a]), slice(a, z)) for a, z in zip(edges[:-1], edges[1:], strict=True) if z > a)

    def score_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bucket contexts' totals for itself (kind 0); for the contexts' buckets types of
        two rare words with the words' probabilities (kind 1); and scores of the rest (kind 2)."""
        own, after = shared.value
        for bucket, pairs, mail_, probes in buckets_of(batches):
            p, tables, parents, over = log_probabilities(pairs, own, after, _seed(CODES + bucket, rounds), Mail(pairs, 1, mail_[1], mail_[0]), Mail(pairs, samples, mail_[_TOLD]))
            yield _table(_PARTS, [bucket], [0], [None], [pack(pairs.contexts, pairs.totals(pairs.c), *tables)])
            n = np.full(len(p), -1)
            n[pairs.at_w] = pairs.own(pairs.c)[pairs.of_w]
            base = np.log10((np.maximum(n, 0) + 1) / (tokens + vocabulary + 1))
            blocks, rows_, of, m, doc = unpack(opened(probes))
            block = np.repeat(blocks, rows_)
            kinds, at = np.repeat(of, m), np.repeat(block, m)
            made: list[tuple[int, int, int | None, bytes]] = []
            for name, rows__ in by_block(at):
                d, k = doc[rows__], kinds[rows__]
                found = np.flatnonzero(np.bincount(d))
                mine = n[k] >= 0
                rare = np.flatnonzero(np.bincount(d[mine]))
                known = np.bincount(d[mine], n[k[mine]] > 0)[rare]
                based = np.bincount(d[mine], base[k[mine]])[rare]
                made.append((bucket, 2, name, pack(found.astype(np.uint16), np.bincount(d, p[k])[found].astype(np.float32), rare.astype(np.uint16), known.astype(np.uint32), based)))
            place = np.full(len(pairs.w), -1)
            place[pairs.asked] = np.arange(int(pairs.asked.sum()))
            sent_ = np.flatnonzero((place[of] >= 0) & (m > 0))
            to = _bucket(pairs.u[of[sent_]], buckets).astype(np.int64)
            order = np.argsort(to, kind="stable")
            sent_, to = sent_[order], to[order]
            starts = np.cumsum(m, dtype=np.int64) - m
            beyond = np.sum(over, axis=0)
            for name, rows__ in by_block(to):
                x = sent_[rows__]
                many = m[x].astype(np.int64)
                docs_ = doc[np.repeat(starts[x] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                ask = place[of[x]]
                more = np.flatnonzero(beyond[ask])
                made.append((name, 1, None, shut(pack(pairs.u[of[x]], pairs.c[of[x]].astype(np.uint32), m[x], block[x], docs_, more.astype(np.uint32), *(v[ask[more]] for v in over), *(v[ask] for v in parents)))))
            yield _table(_PARTS, *map(list, zip(*made, strict=True))) if made else _table(_PARTS, [], [], [], [])
        give_back()

    def score_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores by block: those of kind 2 as they are, those of types of two rare words from
        their words' probabilities and the totals of the bucket."""
        bucket, told = None, []
        asked: list[tuple[np.ndarray, ...]] = []

        def answered() -> Iterator[pa.RecordBatch]:
            if asked:
                block, doc, score = (np.concatenate(x) for x in zip(*asked, strict=True))
                order = np.argsort(block, kind="stable")
                block, doc, score = block[order], doc[order], score[order]
                blocks, blobs = [], []
                for name, at in by_block(block):
                    found = np.flatnonzero(np.bincount(doc[at]))
                    blocks.append(name)
                    blobs.append(pack(found.astype(np.uint16), np.bincount(doc[at], score[at])[found].astype(np.float32), *nothing))
                asked.clear()
                yield _table("block bigint, blob binary", blocks, blobs)

        for b in batches:
            kinds, buckets_ = b.column(1).to_numpy(), b.column(0).to_numpy()
            for i, (now, kind) in enumerate(zip(buckets_.tolist(), kinds.tolist(), strict=True)):
                if kind == 2:
                    continue
                blob = b.column(3)[i].as_py()
                if kind == 0:
                    yield from answered()
                    bucket, told = now, unpack(blob)
                    continue
                if now != bucket:
                    raise RuntimeError(f"bucket {now} has no totals of its contexts")
                u, c, m, block, doc, more, *by_sample = unpack(opened(blob))
                where = np.searchsorted(told[0], u)
                c = c.astype(np.float64)
                over = np.zeros((samples, len(c)))
                over[:, more] = by_sample[:samples]
                p = sum(c - D1 * (np.minimum(c, 1) + over[s]) + (THETA1 + D1 * told[2 + s][where]) * x for s, x in enumerate(by_sample[samples:])) / (THETA1 + told[1][where]) / samples
                asked.append((np.repeat(block, m), doc, np.repeat(np.log10(p), m)))
            done = np.flatnonzero(kinds == 2)
            if len(done):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(done)) for c in b.columns[2:]], names=["block", "blob"])
        yield from answered()
        give_back()

    parts = others.mapInArrow(score_buckets, _PARTS)
    if told is not None:  # a part of the buckets is beside its letters at a time, so that what is shuffled stays small
        passes = []
        for k in range(PASSES):
            some = F.pmod("bucket", F.lit(PASSES)) == k
            rows = with_mail(others.where(some), told.where(some), tasks // PASSES | 1)
            passes.append(materialise(rows.mapInArrow(score_buckets, _PARTS), "scores"))
        parts = reduce(DataFrame.unionByName, passes)
    returned = deal(parts, "bucket", "kind").mapInArrow(score_asked, "block bigint, blob binary")
    returned = returned.select("block", F.lit(-1).alias("kind"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in sums_of.fields[2:-1]), "blob")
    together = returned.unionByName(scored).repartition("block").sortWithinPartitions("block", "kind")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        found = np.zeros((3, CODES))
        for b in batches:
            if not b.num_rows:
                continue
            ids, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if ids[lo] != block:
                    block = ids[lo]
                    found[:] = 0
                if kinds[lo] == -1:
                    for blob in b.column(b.num_columns - 1).slice(lo, hi - lo).to_pylist():
                        doc, part, rare, known, based = unpack(blob)
                        found[2][doc] += part
                        found[0][rare] += known
                        found[1][rare] += based
                    continue
                _, _, idx, doc_id, held_, n_tokens, known, base, score, _ = b.slice(lo, hi - lo).columns
                at = idx.to_numpy()
                made = [known.to_numpy() + found[0][at].astype(np.int64), base.to_numpy() + found[1][at], score.to_numpy() + found[2][at]]
                yield pa.RecordBatch.from_arrays([doc_id, held_, n_tokens, *(pa.array(x) for x in made)], names=names)

    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double").fields])
    return together.mapInArrow(finish, out).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, and the perplexity a token of score and of base_score."""
    per = [F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens")).alias(a) for c, a in (("score", "perplexity"), ("base_score", "base_perplexity"))]
    return scored.groupBy("held_out").agg(*per)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(load(spark, sf_dir, "documents"), fold("doc_id", 7, 2))
