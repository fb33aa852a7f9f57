"""Personal data: base rules, and a skip-chain conditional random field that adds to them.

Base spans follow four rules (email, ip, card, phone), leftmost and non-overlapping per
kind; what a rule matches but its check refuses is dropped. Offsets are code points, ends
exclusive.

The field's nodes are a document's mentions: tokens around an @ and groups of digits.
Their labels are the four kinds or none. Neighbouring mentions share chain potentials;
mentions with the same or similar content anywhere in the document (equal but for case,
equal digits, equal last digits, equal local part) share skip potentials, each linked to
the next of its like, so there are as many skip links as mentions. Mentions in base spans
are observed. Loopy sum-product message passing gives the others' marginals, so a number
written as a phone once is found where it stands again without its prefix. A span is
added where a label's marginal reaches `MARGINAL` and an observed mention of that label
is among its likes; base spans always stay.

Potentials are fitted piecewise (unary, chain and skip factors each on their own) with
the base spans as distant labels, on at most `SAMPLE` documents, those with the smallest
hash of their id among the ones that have a digit or an @. A mention without a base span
that has one among its likes is what the field is to decide: its label is not known, and
it and its links are left out of the fit.

Defined cases: a null text is empty and has no spans (its digest is that of the empty
string); repeated and null doc_ids give a row each; spans of different kinds may overlap;
an empty table gives no rows; other columns pass `redact` untouched but for n_chars.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import giving, load, runs, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # the last is none
SAMPLE = 2048
MARGINAL = 0.9
ROUNDS, DAMPING = 8, 0.5
CHUNK_BYTES = 2 << 20

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_GROUP = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9])*+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    if not _HINT.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# --- the field ------------------------------------------------------------------------

_SHAPES = 12


class Mentions:
    """Mentions of one or more texts: place, likes and shape, and what the base rules say."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.label: list[int] = []
        self.shape: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        found: list[tuple[int, int, str]] = []
        at = text.find("@")
        while at >= 0:
            a = b = at
            while a > 0 and text[a - 1] in _LOCAL:
                a -= 1
            while b + 1 < len(text) and text[b + 1] in _LOCAL:
                b += 1
            if a < at < b:
                found.append((a, b + 1, text[a : b + 1].strip(".")))
            at = text.find("@", b + 1)
        starts, ends = [x[0] for x in found], [x[1] for x in found]
        for m in _GROUP.finditer(text):
            k = bisect_right(starts, m.start()) - 1
            if (k < 0 or ends[k] <= m.start()) and len(_NOT_DIGIT.sub("", m[0])) >= 7:
                found.append((*m.span(), m[0]))
        found.sort()
        first, likes = len(self.doc), {}
        by_kind = [[s[1:] for s in base if s[0] == k] for k in range(len(KINDS))]
        for a, b, core in found:
            node, label = len(self.doc), LABELS - 1
            for k, own in enumerate(by_kind):  # spans of a kind are in order and apart
                i = bisect_left(own, (b,)) - 1
                if i >= 0 and own[i][1] > a:
                    label = k
                    break
            self.doc.append(doc), self.span.append((a, b)), self.label.append(label), self.shape.append(_shape(core))
            if node > first:
                self.chain.append((node - 1, node))
            for key in _likes(core):
                if key in likes:
                    self.skip.append((likes[key], node))
                likes[key] = node


def _likes(core: str) -> set[str]:
    if "@" in core:
        return {f"a{core.lower()}", f"l{core.lower().partition('@')[0]}"}
    digits = _NOT_DIGIT.sub("", core)
    return {f"d{digits}", f"t{digits[-9:]}"} if len(digits) >= 9 else {f"d{digits}"}


def _shape(core: str) -> list[int]:
    """Shape features that hold; what decides a base rule (prefix, checksum, ranges) is not among them."""
    digits = sum(map(str.isdigit, core))
    bucket = next(i for i, most in enumerate((7, 9, 12, 15, 19, 10**9)) if digits <= most)
    out = [0, 1 + bucket]
    out += [7] * ("@" in core) + [8] * (core.count(".") == 3) + [9] * ("(" in core) + [10] * ("-" in core) + [11] * (" " in core)
    return out


def _one_hot(shapes: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(shapes), _SHAPES))
    for i, s in enumerate(shapes):
        x[i, s] = 1
    return x


class Field:
    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, m: Mentions) -> np.ndarray:
        """Label marginals of each mention by loopy sum-product; observed mentions are certain."""
        n = len(m.doc)
        scores = _one_hot(m.shape) @ self.unary
        label = np.array(m.label)
        seen = label < LABELS - 1
        scores[seen] = np.where(np.arange(LABELS) == label[seen][:, None], 0.0, -50.0)
        local = np.exp(scores - scores.max(1, keepdims=True))
        edges = np.array(m.chain + m.skip, dtype=np.int64).reshape(-1, 2)
        kind = np.repeat([0, 1], [len(m.chain), len(m.skip)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        factors = np.stack([self.chain, self.skip])
        across = np.concatenate([factors[kind], factors[kind].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        sent = np.full((len(source), LABELS), 1.0 / LABELS)
        for _ in range(ROUNDS if len(edges) else 0):
            logs = np.zeros((n, LABELS))
            np.add.at(logs, target, np.log(sent))
            without = np.log(local[source] + 1e-30) + logs[source] - np.log(sent[back])
            without = np.exp(without - without.max(1, keepdims=True))
            fresh = np.einsum("ei,eij->ej", without, across)
            fresh = np.maximum(fresh / fresh.sum(1, keepdims=True), 1e-12)
            sent = DAMPING * sent + (1 - DAMPING) * fresh
        logs = np.log(local + 1e-30)
        np.add.at(logs, target, np.log(sent))
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, m: Mentions) -> list[tuple[int, Span]]:
        """(text, span) of what the base rules missed."""
        label = np.array(m.label, dtype=np.int64)
        if not m.skip or (label == LABELS - 1).all() or (label < LABELS - 1).all():
            return []
        parent = list(range(len(label)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in m.skip:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        witnessed = {(root(i), int(k)) for i, k in enumerate(label) if k < LABELS - 1}
        p, out = self.marginals(m), []
        for i in np.flatnonzero(label == LABELS - 1).tolist():
            k = int(p[i, :-1].argmax())
            if p[i, k] >= MARGINAL and (root(i), k) in witnessed:
                out.append((m.doc[i], (k, *m.span[i])))
        return out


def fit(shapes: list[list[int]], labels: list[int], chain: list[tuple[int, int]], skip: list[tuple[int, int]], steps: int = 300) -> Field:
    """Piecewise fit: softmax regression, and smoothed pair counts over those of independence."""
    y = np.array(labels, dtype=np.int64)
    known = np.ones(len(y), dtype=bool)
    for a, b in skip:
        if (y[a] < LABELS - 1) != (y[b] < LABELS - 1):
            known[a if y[a] == LABELS - 1 else b] = False
    chain, skip = ([(a, b) for a, b in edges if known[a] and known[b]] for edges in (chain, skip))
    unary = np.zeros((_SHAPES, LABELS))
    if known.any():
        x, want = _one_hot(shapes)[known], np.eye(LABELS)[y[known]]
        for _ in range(steps):
            z = x @ unary
            p = np.exp(z - z.max(1, keepdims=True))
            unary -= 0.5 * (x.T @ (p / p.sum(1, keepdims=True) - want) / len(x) + 0.01 * unary)
    share = (np.bincount(y[known], minlength=LABELS) + 1.0) / (known.sum() + LABELS)

    def pairs(edges: list[tuple[int, int]], prior: np.ndarray) -> np.ndarray:
        counts = prior.copy()
        for a, b in edges:
            counts[y[a], y[b]] += 1
            counts[y[b], y[a]] += 1
        return np.clip(counts / counts.sum() / np.outer(share, share), 0.25, 4.0)

    # likes agree or differ, whatever the label: a smoothed share of agreeing links
    same = (sum(y[a] == y[b] for a, b in skip) + 30.0) / (len(skip) + 31.0)
    agree = np.full((LABELS, LABELS), (1 - same) / (LABELS - 1)) + np.eye(LABELS) * (same - (1 - same) / (LABELS - 1))
    return Field(unary, pairs(chain, np.outer(share, share) * 20), agree)


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fits on docs(doc_id, text)."""
    order = F.xxhash64("doc_id", F.lit("pii"))
    ids = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id").orderBy(order, "doc_id").limit(sample).distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.list_(pa.int32()))
        for b in batches:
            made = []
            for t in utf8(b.column(1)):
                m, text = Mentions(), t.decode()
                m.add(0, text, base_spans(text))
                made.append((m.label, m.shape, m.chain, m.skip))
            columns = list(zip(*made, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.list_(pa.int32())), *(pa.array([[list(x) for x in row] for row in c], pair) for c in columns[1:])], names=["h", "label", "shape", "chain", "skip"])

    found = rows.mapInArrow(giving(run), "h bigint, label array<int>, shape array<array<int>>, chain array<array<int>>, skip array<array<int>>")
    shapes, labels, chain, skip = [], [], [], []
    for r in found.orderBy("h").limit(sample).collect():
        n = len(labels)
        labels += r.label
        shapes += [list(s) for s in r.shape]
        chain += [(a + n, b + n) for a, b in r.chain]
        skip += [(a + n, b + n) for a, b in r.skip]
    return fit(shapes, labels, chain, skip)


def spans_of(texts: list[bytes], field: Field) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """Text, base spans and all spans of each text."""
    for lo, hi in runs([len(t) for t in texts], CHUNK_BYTES):
        decoded = [t.decode() for t in texts[lo:hi]]
        base = [base_spans(t) for t in decoded]
        every = [list(b) for b in base]
        m = Mentions()
        for i, (t, b) in enumerate(zip(decoded, base, strict=True)):
            if b:  # without an observed mention nothing can be added
                m.add(i, t, b)
        for i, span in field.added(m):
            every[i].append(span)
        for t, b, e in zip(decoded, base, every, strict=True):
            yield t, b, sorted(set(e))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and spans, arrays of (kind, start, end), of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(spans_of(utf8(b.column(1)), sent.value))
            made = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in g[at]] for g in got], kind) for at in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(f"base {span}, spans {span}").fields])
    return docs.select("doc_id", "text").mapInArrow(giving(run), schema)


def digest(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base spans, the digest of base spans and all spans as text."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(base, joined(base), joined(every)) for _, base, every in spans_of(utf8(b.column(1)), sent.value)]
            counts = [pa.array([sum(s[0] == k for s in g[0]) for g in got], pa.int64()) for k in range(len(KINDS))]
            texts = [pa.array(x, pa.string()) for x in ([hashlib.sha256(g[1].encode()).hexdigest() for g in got], [g[2] for g in got])]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *texts], names=names)

    kinds = [docs.schema["doc_id"].dataType, *[T.LongType()] * 4, T.StringType(), T.StringType()]
    return docs.select("doc_id", "text").mapInArrow(giving(run), T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind in brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for k, a, b in sorted(spans, key=lambda s: s[1:]):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def cleared(text: str, spans: list[Span]) -> str:
    """Redacted until no base rule matches: a cut can free what a longer match had hidden."""
    while spans:
        text = redacted(text, spans)
        spans = base_spans(text)
    return text


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with spans replaced in text, and n_chars (where there is one) the new length."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index("text")
            texts = [cleared(t, s) if s else t for t, _, s in spans_of(utf8(b.column(at)), sent.value)]
            nulls = b.column(at).is_null().to_pylist()
            columns = list(b.columns)
            columns[at] = pa.array([None if z else t for t, z in zip(texts, nulls, strict=True)], b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([o if z else len(t) for t, z, o in zip(texts, nulls, b.column(k).to_pylist(), strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(giving(run), docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return digest(docs, train(docs))
