"""License scans by sentence rules.

A text is cut into sentences (at end marks and empty lines; a line break alone is a space,
comment marks at line starts are dropped), each normalised: lower case, one spelling of
"license", words of letters and digits with single spaces. Sentence patterns turn a
normalised sentence into sentence ids in reading order; a sentence can give several. The
text's sequence of ids is then read by ordered rules: at each place the first rule whose
ids all follow in order there names a license and uses them up, and an id no rule starts
with is passed over. Rules for whole license texts come before those for their parts.

A sentence that speaks of licensing (a cue word) but has no id is counted as unknown.
Texts are read whole, and a pattern counts at each place where it occurs. `may_match` leaves
out only sentences that no pattern and no cue can match: it asks for single words (a line
break or a mark may stand between two), one of each pattern, in any sentence.

Defined cases: a null, empty or blank text has no licenses; every row gives one row, null
and repeated ids too; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.common import load

_CUES = re.compile(r"\b(?:(?:re|sub|un)?licens(?:e|es|ed|ing|or|ee)|copyright(?:ed|s)?|all rights reserved|public domain|warranty|warranties|redistribut(?:e|ed|ion|ions))\b")
_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/|//+|#+|\*+|--+|;+|%+|<!--|dnl\b|rem\b)[ \t]*")
_ENDS = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|(?<=:)[ \t]*\n|\n[ \t\r]*\n")
_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")

_V = r"(?:,? (?:version |ver |v ?)?|-v?|v)(?P<{0}>\d+(?:\.\d+)*)"
_LATER = r"(?P<{0}>(?:\+| or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?|-or-later))"
_ONLY = r"(?: only|-only)"
#: SPDX stem, pattern, whether a version follows
_FAMILIES = [
    ("AGPL", r"(?:gnu )?(?:affero (?:general public license|gpl)|agpl)", True),
    ("LGPL", r"(?:gnu )?(?:(?:lesser|library) (?:general public license|gpl)|lgpl)", True),
    ("GPL", r"(?:gnu )?(?:general public license|gpl)", True),
    ("Apache", r"apache(?: software| public)?(?: license)?", True),
    ("MPL", r"(?:mozilla public license|mpl)", True),
    ("EPL", r"(?:eclipse public license|epl)", True),
    ("EUPL", r"(?:european union public license|eupl)", True),
    ("CDDL", r"(?:common development and distribution license|cddl)", True),
    ("Artistic", r"artistic license", True),
    ("BSL", r"boost software license", True),
    ("CC0", r"(?:cc0|creative commons zero)(?: universal)?", True),
    ("CC", r"(?:creative commons|cc)[ -](?P<cc>(?:by|attribution)(?:[ -](?:nc|sa|nd|non-?commercial|share-?alike|no-?deriv(?:ative)?s?))*)(?: license)?", True),
    ("BSD", r"(?:(?P<b1>[0234]|zero|two|three|four)[ -]clause )?(?:(?P<b2>new|modified|revised|simplified|original) )?bsd(?:[ -](?P<b3>[0234]|zero|two|three|four)(?:[ -]clause)?)?", False),
    ("MIT", r"(?:mit(?:[ -]?x11)?|expat)", False),
    ("ISC", r"isc", False),
    ("Zlib", r"zlib(?: libpng)?", False),
    ("Unlicense", r"unlicense", False),
    ("WTFPL", r"(?:do what the fuck you want to public license|wtfpl)", False),
]
_NAMES = [
    (stem, re.compile(r"(?:the |a |an )?(?:(?:version|v) ?(?P<before>\d+(?:\.\d+)*)(?P<soon> or (?:at your option )?(?:any )?later)?(?: of)? (?:the )?)?" + body + (rf"(?:(?: international| license)*(?:{_V.format('after')}))?(?:{_ONLY}|{_LATER.format('later')})?" if versioned else "") + r"(?: international| license)?(?![^\s])"))
    for stem, body, versioned in _FAMILIES
]
_VERBS = r"(?:licensed|dual-licensed|sublicensed|relicensed|released|distributed|redistributed|published|available|provided|covered|offered|governed|issued|subject|shared|used|modify|copied|redistribute|use)"
_REFERENCE = re.compile(
    rf"(?<!not )(?<!never )\b{_VERBS}\b(?: (?!not\b)\S+){{0,6}}? (?:under|by|to|with)(?: (?:the|both|either|terms|conditions|provisions|and|or|of|a|an)\b){{0,8}} "
)
_JOIN = re.compile(r"(?: and| or|,)(?: (?:the|under|either|terms|conditions|of)\b)*? ")
_AS_PUBLISHED = re.compile(r" as published by the free software foundation(?: either)?(?: version (\d+(?:\.\d+)*)(?: of the license)?)?( or at your option any later version)?")
_URL = re.compile(r"\S+://\S+")
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)", re.I)
_SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
_NUMBERS = {"zero": "0", "two": "2", "three": "3", "four": "4", "new": "3", "modified": "3", "revised": "3", "simplified": "2", "original": "4"}

#: sentences of license texts
_SENTENCES = [
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this \w+.*? to deal in the \w+ without restriction"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("IscGrant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("BsdConditions", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("BsdAdvertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("BsdEndorse", r"neither the names? of .*? may be used to endorse or promote products|the names? of .*? may not be used to endorse or promote products"),
    ("AsIs", r"\bis provided (?:by .*? )?as is\b.*?\bwarrant(?:y|ies)|disclaims all warranties"),
    ("NoLiability", r"in no event shall .*? be liable"),
    ("ApacheObtain", r"you may obtain a copy of the license at"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations"),
    ("GplHope", r"distributed in the hope that it will be useful but without any warranty"),
    ("GplSee", r"see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("GplCopy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license"),
    ("ZlibAsIs", r"this software is provided as-is without any express or implied warranty"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("ZlibNotice", r"this notice may not be removed or altered from any source distribution"),
    ("UnlicenseDomain", r"this is free and unencumbered software released into the public domain"),
    ("MplSource", r"this source code form is subject to the terms of the mozilla public license"),
    ("PublicDomain", r"\b(?:placed|released|dedicated|put) (?:in|into|to) the public domain|\bis in the public domain"),
    ("AllRights", r"\ball rights reserved\b"),
    ("Copyright", r"\bcopyright (?:c )?(?:\d{4}|by\b)|\bcopyright c\b"),
]
_SENTENCES = [(name, re.compile(p)) for name, p in _SENTENCES]

#: every sentence pattern, every cue and every name not in _SHORT has one of these in a word
_STEMS = ("licen", "copyright", "permission", "redistribut", "warrant", "liable", "domain", "reserved", "endorse", "notice", "advertising", "spdx")
_SHORT = re.compile(r"(?<![^\W_])(?:[al]?gpl|apache|mpl|epl|eupl|cddl|cc0|creative|bsd|wtfpl|(?:cc|mit|mitx11|expat|isc|zlib)(?![^\W_]))")
_VERB = re.compile(rf"(?<![^\W_]){_VERBS}(?![^\W_])")

#: (license, sentence ids in order; "?" ones may be absent), tried from first to last
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-4-Clause", ("BsdConditions", "BsdSource", "BsdBinary", "BsdAdvertising", "?BsdEndorse", "?AsIs", "?NoLiability")),
    ("BSD-3-Clause", ("BsdConditions", "BsdSource", "BsdBinary", "BsdEndorse", "?AsIs", "?NoLiability")),
    ("BSD-2-Clause", ("BsdConditions", "BsdSource", "BsdBinary", "?AsIs", "?NoLiability")),
    ("MIT", ("MitGrant", "?MitNotice", "?AsIs", "?NoLiability")),
    ("ISC", ("IscGrant", "?AsIs", "?NoLiability")),
    ("Zlib", ("ZlibAsIs", "?NoLiability", "ZlibGrant", "?ZlibNotice")),
    ("Zlib", ("ZlibGrant", "?ZlibNotice")),
    ("Unlicense", ("UnlicenseDomain", "?AsIs", "?NoLiability")),
    ("Apache-2.0", ("=Apache-2.0", "ApacheObtain", "?ApacheAsIs", "?ApacheSee")),
    *((f"{g}", (f"={g}", "GplHope", "?GplSee", "?GplCopy")) for g in ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later")),
    ("LicenseRef-public-domain", ("PublicDomain",)),
]
_BY_FIRST: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _rule in RULES:
    _BY_FIRST.setdefault(_rule[1][0], []).append(_rule)


def _dotted(version: str) -> str:
    return version if "." in version else f"{version}.0"


def _spdx(stem: str, found: re.Match, more: tuple[str | None, str | None] = (None, None)) -> str:
    g = found.groupdict()
    version = g.get("after") or g.get("before") or more[0]
    later = bool(g.get("later") or g.get("soon") or more[1])
    if stem == "BSD":
        n = g["b1"] or g["b3"] or g["b2"]
        return f"BSD-{_NUMBERS.get(n, n)}-Clause" if n else "BSD"
    if stem == "CC":
        parts = re.sub(r"attribution", "by", g["cc"])
        for long, short in ((r"non-?commercial", "nc"), (r"share-?alike", "sa"), (r"no-?deriv(?:ative)?s?", "nd")):
            parts = re.sub(long, short, parts)
        stem = "CC-" + parts.replace(" ", "-").upper()
    if not version:
        return stem
    if stem in ("GPL", "LGPL", "AGPL"):
        return f"{stem}-{_dotted(version)}-{'or-later' if later else 'only'}"
    return f"{stem}-{_dotted(version)}"


def normalise(sentence: str) -> str:
    return re.sub(r"\blicenc", "licens", " ".join(_WORD.findall(sentence.lower()))).replace("licensse", "license")


def sentences(text: str) -> list[str]:
    return [s for s in _ENDS.split(_MARKS.sub("", text)) if s.strip()]


def _name_at(sentence: str, at: int) -> tuple[str, int] | None:
    best = None
    for stem, pattern in _NAMES:
        found = pattern.match(sentence, at)
        if found and (best is None or found.end() > best[1].end()):
            best = stem, found
    if best is None:
        return None
    stem, found = best
    published = _AS_PUBLISHED.match(sentence, found.end())
    return _spdx(stem, found, published.groups() if published else (None, None)), published.end() if published else found.end()


def sentence_ids(sentence: str) -> list[str]:
    """Ids of a normalised sentence in reading order; a named license is "=" and its name."""
    got: list[tuple[int, str]] = [(m.start(), name) for name, p in _SENTENCES for m in p.finditer(sentence)]
    done = 0
    for start in _REFERENCE.finditer(sentence):
        if start.start() < done:
            continue
        at = start.end()
        while (named := _name_at(sentence, at)) is not None:
            got.append((at, f"={named[0]}"))
            done = named[1]
            join = _JOIN.match(sentence, done)
            if not join:
                break
            at = join.end()
    return [name for _, name in sorted(got)]


def match_rules(ids: list[str]) -> list[str]:
    """Licenses that the ordered rules read from a sequence of sentence ids."""
    out, at = [], 0
    while at < len(ids):
        for name, parts in _BY_FIRST.get(ids[at], ()):
            to, whole = at, True
            for part in parts:
                if to < len(ids) and ids[to] == part.lstrip("?"):
                    to += 1
                elif part[0] != "?":
                    whole = False
                    break
            if whole:
                out.append(name)
                at = to
                break
        else:
            if ids[at][0] == "=":
                out.append(ids[at][1:])
            at += 1
    return out


def may_match(lower: str) -> bool:
    """False only where no sentence of the lower-cased text has an id or a cue."""
    return any(x in lower for x in _STEMS) or (_SHORT.search(lower) is not None and _VERB.search(lower) is not None)


def scan(text: str | None) -> tuple[list[str], list[str], int]:
    """Licenses (distinct, sorted), sentence ids in order, and the number of unknown license sentences."""
    if not text or not may_match(text.lower()):
        return [], [], 0
    ids: list[str] = []
    unknown = 0
    for s in sentences(text):
        if not may_match(s.lower()):
            continue
        tagged = [f"={x}" for line in _SPDX.findall(s) for x in _SPDX_ID.findall(line.split("*/")[0]) if x not in ("OR", "AND", "WITH")]
        got = tagged + sentence_ids(normalise(_SPDX.sub(" ", s)))
        ids += got
        if not got and _CUES.search(normalise(_URL.sub(" ", s))):
            unknown += 1
    return sorted(set(match_rules(ids))), ids, unknown


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, licenses, sentence_ids and n_unknown of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t) for t in b.column(1).to_pylist()]
            names = pa.list_(pa.string())
            made = [pa.array([g[0] for g in got], names), pa.array([g[1] for g in got], names), pa.array([g[2] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", "licenses", "sentence_ids", "n_unknown"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("licenses array<string>, sentence_ids array<string>, n_unknown int").fields])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))
