"""Packing documents into training sequences: dominance reduction, then best fit.

A document is its tokens and one end id; only a longer one than a sequence is cut. What
matters for packing is how many pieces there are of each length, and lengths are whole
numbers up to the capacity: the instance is a histogram of at most `capacity` counts,
whatever the corpus, so the driver plans it exactly and globally. The plan first fixes
sets that provably dominate every other set with the same piece (Martello and Toth):

* a piece as long as a sequence, or one beside which nothing fits, alone;
* a piece with the one that fills the rest exactly;
* a piece with the longest that fits, if no two or more others that fit have a larger sum;
* where no three others fit beside it, a piece with the longest that fits and the longest
  beside that, if no other two that fit have a longer smaller one.

Every length is tried, and all again until a whole pass fixes nothing. The remainder is packed by best fit, longest first, on counts. The plan is a list of runs
("ranks a to b of length l go to these sequences at this offset"), a few per length, so it
is broadcast. Pieces get their rank within their length from counts of (length, bucket)
and a row number inside a bucket: no task holds a whole length, and token ids never move.

Defined cases: a null or empty text is one piece with only the end id; repeated and null
doc_ids are documents of their own; an empty table gives no rows; other columns are not
read. A tokenizer is a file whose path is a parameter; the driver reads it and sends it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import give_back, kept, load, materialise, runs, utf8

CAPACITY = 4096
END_ID = 1
CACHED_CHUNKS, CHUNK_MOST = 300_000, 128
GROUP, BREAK = 64, "\x01"
CHUNK_BYTES = 1 << 19
BUCKET_ROWS, MAX_BUCKETS = 128, 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


# --- token ids ------------------------------------------------------------------------

_UNITS = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
#: bytes of plain texts: white space, ASCII but for the apostrophe, and letters from U+00C0 to U+00FF
_PLAIN = bytes({9, 10, 11, 12, 13, *range(32, 127), 0xC3, *range(0x80, 0xC0)} - {39})
_SIGNS = "\u00d7".encode(), "\u00f7".encode()
OWN = "tokenizers"
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: what a tokenizer must do before its merges for its texts to be coded chunk by chunk
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BY_BYTE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it shows, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}


class ChunkTokenizer:
    """Ids of whole texts through a cache of the ids of their parts.

    Texts are coded by parts only where the tokenizer's own definition says that it drops
    white space, lower-cases, and then cuts letters, digits and marks apart. ASCII capitals
    are lowered first. A plain text, one of ASCII without apostrophes and Latin-1 letters,
    is cut as the tokenizer cuts it: into words, digits and runs of marks. Any other text is
    cut at white space only. A text that holds an added token's string, whatever its case,
    is encoded as it is, and so is every text of any other tokenizer.

    The cache has two generations of CACHED_CHUNKS parts of at most CHUNK_MOST bytes each.
    New parts are encoded many to a call. One of Latin letters is one word, which needs no
    pattern, and its last id is one that ends words; others are told apart by a control
    character that stands between them.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        cut, model = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}], parts["model"]
        self.chunked = (
            (parts.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and cut[0].get("pattern") == {"Regex": _PATTERN}
            and cut[0].get("behavior") == "Removed"
            and cut[0].get("invert") is True
            and cut[1:] == [_BY_BYTE]
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and not parts.get("truncation")
        )
        self.added = [x["content"].lower().encode() for x in parts.get("added_tokens") or ()]
        suffix = model.get("end_of_word_suffix")
        self.words = self.last = None
        if suffix and self.chunked:
            self.words = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
            vocabulary = self.words.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        breaks = self.tokenizer.encode(BREAK, add_special_tokens=False).ids
        self.break_id = breaks[0] if len(breaks) == 1 else None
        self.letters = _byte_letters()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, chunks: Iterable[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        letters, mixed = ([], []), ([], [])
        for c in chunks:
            word = None
            if self.last is not None:
                if c.isalpha():
                    word = c.decode()
                elif _LETTERS.fullmatch(t := c.decode().lower()):
                    word = t.encode().decode("latin-1").translate(self.letters)
            if word is not None:
                letters[0].append(c), letters[1].append(word)
            elif self.break_id is None or BREAK.encode() in c:
                out[c] = self._whole(c)
            else:
                mixed[0].append(c), mixed[1].append(c.decode())
        for tokenizer, (some, words), between in ((self.words, letters, " "), (self.tokenizer, mixed, f" {BREAK} ")):
            if not some:
                continue
            texts = [between.join(words[i : i + GROUP]) + between for i in range(0, len(some), GROUP)]
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            own = tokenizer is self.words
            ends = np.flatnonzero(self.last[ids] if own else ids == self.break_id)
            if len(ends) != len(some):
                raise AssertionError("chunks and their ends differ")
            starts, after = np.concatenate(([0], ends[:-1] + 1)), ends + own
            raw = ids.tobytes()
            for c, a, b in zip(some, (4 * starts).tolist(), (4 * after).tolist(), strict=True):
                out[c] = raw[a:b]
        return out

    def _learn(self, chunks: set[bytes]) -> None:
        """Puts the ids of chunks into the cache."""
        if self.old:
            known = {c: self.old[c] for c in chunks if c in self.old}
            self.new |= known
            chunks = chunks.difference(known)
        self.new |= self._encode(chunks)

    def _cut(self, text: bytes) -> list[bytes] | None:
        text = text.lower()
        if not self.chunked or any(x in text for x in self.added):
            return None
        plain = not text.translate(None, _PLAIN) and not any(x in text for x in _SIGNS)
        return _UNITS.findall(text) if plain else text.split()

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for lo, hi in runs([len(t) for t in texts], CHUNK_BYTES):
            if len(self.new) > CACHED_CHUNKS:
                self.old, self.new = self.new, {}
            split = list(map(self._cut, texts[lo:hi]))
            got = [None if words is None else list(map(self.new.get, words)) for words in split]
            late: list[tuple[list, int, bytes]] = []  # ids, place and chunk of what the cache lacks
            for words, g in zip(split, got, strict=True):
                at = -1
                for _ in range(g.count(None) if g else 0):
                    at = g.index(None, at + 1)
                    late.append((g, at, words[at]))
            missing = {c for _, _, c in late}
            long = self._encode([c for c in missing if len(c) > CHUNK_MOST])
            self._learn(missing.difference(long))
            for g, at, c in late:
                g[at] = long[c] if c in long else self.new[c]
            for k, g in enumerate(got, lo):
                yield self._whole(texts[k]) if g is None else b"".join(g)


def tokenizer_of(definition: str) -> ChunkTokenizer:
    """One tokenizer and cache for each definition and Python worker, until another stage needs the memory."""
    key = zlib.crc32(definition.encode())
    own = kept.setdefault(OWN, {})
    if key not in own:
        own[key] = ChunkTokenizer(definition)
    return own[key]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokenizer_of(held.value)
        for b in batches:
            rows, part, start, length, crc, ids = [], [], [], [], [], []
            for i, coded in enumerate(of.ids(utf8(b.column(1)))):
                coded += end
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    own = coded[at : at + 4 * capacity]
                    rows.append(i), part.append(k), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int64))
            made = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(made + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names=names)
        give_back(OWN)

    kinds = [docs.schema["doc_id"].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType()] + [T.ArrayType(T.LongType())] * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


# --- the plan -------------------------------------------------------------------------

#: a set of equal sequences: ((length, how many), ...) in each, and how many sequences
Pattern = tuple[tuple[tuple[int, int], ...], int]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that some best packing has, and the counts that are left."""
    left, fixed = {k: n for k, n in counts.items() if n}, []

    def take(*lengths: int) -> bool:
        inside = tuple(sorted(((x, lengths.count(x)) for x in set(lengths)), reverse=True))
        n = min(left.get(x, 0) // q for x, q in inside)
        if n:
            fixed.append((inside, n))
            for x, q in inside:
                left[x] -= q * n
                if not left[x]:
                    del left[x]
        return n > 0

    for x in sorted(left, reverse=True):
        if x == capacity:
            take(x)
        elif capacity - x in left and x >= capacity - x and x in left:
            take(x, capacity - x)
    again = True
    while again:
        again = False
        for x in sorted(left, reverse=True):
            while x in left and (best := _dominating(left, x, capacity)) is not None and take(x, *best):
                again = True
    return fixed, left


def _dominating(left: dict[int, int], x: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths beside one piece of length x that dominate all others; None where none of at most two do."""
    rest, own = capacity - x, {k: n - (k == x) for k, n in left.items()}
    fits = sorted(k for k, n in own.items() if n and k <= rest)
    if not fits:
        return ()
    best = fits[-1]
    if best == rest or not _sums_above(fits, best, rest):
        return (best,)
    smallest = [k for k in fits[:3] for _ in range(min(own[k], 3))][:3]
    if len(smallest) == 3 and sum(smallest) <= rest:
        return None
    # at most two fit: the longest and the longest beside it, if no pair has a longer smaller piece
    beside = [k for k in fits if k <= rest - best and (k != best or own[k] > 1)]
    if not beside:
        return None
    lesser = max((b for b in fits for a in (b, *fits[bisect_left(fits, b) + 1 :][:1]) if a + b <= rest and (a != b or own[b] > 1)), default=0)
    return (best, beside[-1]) if beside[-1] >= lesser else None


def _sums_above(fits: list[int], best: int, rest: int) -> bool:
    """Whether two or more of the lengths that fit, repeats allowed, sum to more than best and at most rest."""
    ones, most = sum(1 << k for k in fits), (1 << (rest + 1)) - 1
    some = grown = 0
    for k in fits:
        grown |= ones << k
    grown &= most
    while grown & ~some:
        if grown >> (best + 1):
            return True
        fresh, some, more = grown & ~some, some | grown, 0
        while fresh:
            low = (fresh & -fresh).bit_length() - 1
            fresh &= fresh - 1
            more |= ones << low
        grown = more & most
    return False


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, of equal pieces at a time."""
    open_at: dict[int, list[list]] = {}  # room -> [inside, how many]
    rooms: list[int] = []

    def put(inside: tuple, many: int, room: int) -> None:
        if many:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append([inside, many])

    for x in sorted(counts, reverse=True):
        todo = counts[x]
        while todo:
            k = bisect_left(rooms, x)
            if k == len(rooms):
                q = capacity // x
                put(((x, q),), todo // q, capacity - q * x)
                put(((x, todo % q),), bool(todo % q), capacity - todo % q * x)
                break
            room = rooms[k]
            inside, many = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(k)
            q = room // x
            full = min(many, todo // q)
            put((*inside, (x, q)), full, room - q * x)
            todo -= full * q
            if full < many and todo:
                put((*inside, (x, todo)), 1, room - todo * x)
                put(inside, many - full - 1, room)
                todo = 0
            else:
                put(inside, many - full, room)
    return [(inside, many) for room in rooms for inside, many in open_at[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, end rank, first sequence, offset, pieces of it in each sequence), sorted."""
    fixed, left = reduce_by_dominance(counts, capacity)
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for inside, many in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for length, q in inside:
            rows.append((length, used[length], used[length] + q * many, sequence, offset, q))
            used[length] += q * many
            offset += q * length
        sequence += many
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


# --- placing --------------------------------------------------------------------------


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts(doc_id, piece, start, length, ids_crc32) with sequence_id and offset of every piece.
    parts should be cheap to read twice, as a written table is."""
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = plan(counts, capacity)
    buckets = min(MAX_BUCKETS, max(1, -(-max(counts.values(), default=0) // BUCKET_ROWS)))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    held = parts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_ = held.value
        keys = (runs_[:, 0] << 48) | runs_[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            _, first, _, sequence, offset, q = runs_[at].reshape(-1, 6).T
            made = [pa.array(sequence + (rank - first) // np.maximum(q, 1)), pa.array(offset + (rank - first) % np.maximum(q, 1) * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    kept = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(materialise(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id and its token ids, at most `capacity` of them."""
    parts = materialise(pieces(docs, tokenizer, capacity, end_id, with_ids=True), "pieces")
    placed = place(parts.drop("ids"), capacity)
    own = [F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32").alias("k")]
    content = parts.select(*own, "ids").dropDuplicates(["k"])
    slots = placed.select(*own, "sequence_id", "offset").join(content, "k")
    ordered = slots.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return ordered.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
