import random
import re

import pytest

from tidemark.llm import licenses
from tidemark.llm.common import load
from tidemark.llm.licenses import op2_licenses, scan, scan_licenses
from tidemark.llm.queries import QUERIES

MIT = """// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction, including the rights to use it.
//
// The above copyright notice and this permission notice shall be included in
// all copies or substantial portions of the Software.
//
// THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
// AUTHORS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
{}THIS SOFTWARE IS PROVIDED BY THE AUTHORS "AS IS" AND ANY WARRANTIES ARE DISCLAIMED."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version. It is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""

CASES = [
    (None, [], 0),
    (" \n", [], 0),
    ("Plain prose about noble things.", [], 0),
    ("a b c\nLicensed under the Apache License, Version 2.0.\nd e", ["Apache-2.0"], 0),
    ("x ***\nReleased under the MIT License.", ["MIT"], 0),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"], 0),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], 0),
    ("It is licenced under the Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"], 0),
    ("Available under the MIT license or the Apache License 2.0.", ["Apache-2.0", "MIT"], 0),
    ("Distributed under the terms of the 3-clause BSD license.", ["BSD-3-Clause"], 0),
    ("Licensed under version 2 of the GNU GPL.", ["GPL-2.0-only"], 0),
    ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */\nint x;", ["Apache-2.0", "MIT"], 0),
    ("It is not licensed under the MIT License.", [], 1),
    ("Licensed under our own terms.", [], 1),
    ("Copyright (c) 2020 Someone.", [], 0),
    (MIT, ["MIT"], 0),
    (BSD.format(""), ["BSD-2-Clause"], 0),
    (BSD.format("3. Neither the name of X nor Y may be used to endorse or promote products.\n"), ["BSD-3-Clause"], 0),
    (GPL.format(3), ["GPL-3.0-or-later"], 0),
    (APACHE, ["Apache-2.0"], 0),
    ("word " * 20_000 + ". Released under the MIT License.", ["MIT"], 0),
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_scan(case):
    text, licenses, unknown = case
    got = scan(text)
    assert (got[0], got[2]) == (licenses, unknown), got


ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software of X.\n"
ENDORSE = "4. Neither the name of X nor Y may be used to endorse or promote products.\n"
#: sentences without words like "license" or "warranty", cue words over a line break, and a sentence with parts of two licenses
SENTENCES = [
    ("Released under the GPL, version 3.", ["GPL-3.0-only"], 0),
    ("This text is distributed under Apache 2.0 or MIT. Plain prose.", ["Apache-2.0", "MIT"], 0),
    ("Available under CC BY 4.0.", ["CC-BY-4.0"], 0),
    ("It was placed in the public\n   domain by its author.", ["LicenseRef-public-domain"], 0),
    ("This is in the public domain, or\nnot: ask who holds the public\ndomain.", ["LicenseRef-public-domain"], 0),
    ("Who is in charge of the public\ndomain?", [], 1),
    (BSD.format(ADVERTISING), ["BSD-4-Clause"], 0),
    (BSD.format(ADVERTISING + ENDORSE), ["BSD-4-Clause"], 0),
    (" ".join(re.findall(r"\w+", BSD.format("") + BSD.format(ENDORSE))), ["BSD-2-Clause", "BSD-3-Clause"], 0),
]


@pytest.mark.parametrize("case", SENTENCES, ids=range(len(SENTENCES)))
def test_every_sentence_is_matched(case):
    test_scan(case)


def test_no_sentence_with_an_id_or_a_cue_is_left_out():
    r = random.Random(2)
    names = "GNU GPL v2|GPLv3|AGPL-3.0|Lesser GPL|Apache 2.0|MPL-2.0|EPL 1.0|EUPL v1.2|CDDL|CC0 1.0|Creative Commons Zero|CC BY 4.0|CC-BY-SA 4.0|BSD|New BSD|3-clause BSD|BSD-2-Clause|MIT|MIT X11|MITX11|Expat|ISC|zlib|WTFPL|Mozilla Public License 2.0|Boost Software Licence|Artistic License 2.0|the unlicense".split("|")
    verbs = re.findall(r"[a-z-]{3,}", licenses._VERBS)
    parts = [p.pattern for _, p in licenses._SENTENCES] + [licenses._CUES.pattern]
    words = [w for p in parts for w in re.findall(r"[a-z]+", p.replace(r"\b", " ").replace(r"\w", " ").replace(r"\d", " "))]
    seen = set()
    for i in range(20_000):
        if i % 2:
            made = [r.choice(verbs), r.choice(["under", "by", "with the"]), r.choice(names)]
        else:  # a stretch of the patterns' own words, whose alternatives stand in a row
            at = r.randrange(len(words))
            made = [w for w in words[at : at + r.randint(2, 24)] if r.random() < 0.9]
        text = "".join(w + r.choice([" ", " ", "\n", ", ", "_ _", " (", "\n * "]) for w in " ".join(made).split())
        s = licenses._MARKS.sub("", r.choice([text, text.upper(), f"_{text}_"]))
        ids = licenses.sentence_ids(licenses.normalise(s))
        if ids or licenses._CUES.search(licenses.normalise(s)):
            assert licenses.may_match(s.lower()), s
            seen.update(ids)
    assert len([x for x in seen if x[0] == "="]) > 20 and len([x for x in seen if x[0] != "="]) > 10, seen


def test_rows(spark, sf):
    frame = spark.createDataFrame([(1, CASES[3][0], "x"), (1, CASES[3][0], "x"), (None, None, "x")], "doc_id bigint, text string, licenses string")
    assert sorted((str(r.doc_id), r.licenses) for r in scan_licenses(frame).collect()) == [("1", ["Apache-2.0"]), ("1", ["Apache-2.0"]), ("None", [])]
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    got = {r.doc_id: r.licenses for r in QUERIES["op2_licenses"](spark, sf).collect()}
    docs = load(spark, sf, "documents").collect()
    assert QUERIES["op2_licenses"] is op2_licenses and len(got) == len({r.doc_id for r in docs})
    for r in docs:
        assert got[r.doc_id] == sorted({name for line, name in lines.items() if re.search(re.escape(line), r.text or "")})
    assert any(got.values())
