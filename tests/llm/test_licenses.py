"""License scans: whole license files, headers in comments, and every similarity against a plain computation."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import licenses

PROSE = [f"w{k}x" for k in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(PROSE, k=n))


def scanned(spark, rows):
    return licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"))


AGPL = """                    GNU AFFERO GENERAL PUBLIC LICENSE
                       Version 3, 19 November 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU Affero General Public License is a free, copyleft license for
software and other kinds of works, specifically designed to ensure
cooperation with the community in the case of network server software.
"""
GPL = """#!/usr/bin/env python
# frob - frobnicates
# Copyright (C) 2020  Jane Doe
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
import os

print(os.getcwd())
"""
BSD = """Copyright (c) 2011, Some Company
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.
"""


def apache_header(mark):
    lines = ["Copyright 2019 The Authors", "", 'Licensed under the Apache License, Version 2.0 (the "License");', "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0"]
    return "\n".join(f"{mark} {line}".rstrip() for line in lines) + "\n\ncode(1)\n" + prose(80, 4)


def whole(name, year="2021", who="Ann Other"):
    text = dict(licenses.WHOLE)[name].replace("(c)", f"(c) {year} {who}")
    words, lines = text.split(), []
    while words:
        lines.append(" ".join(words[:11]))
        words = words[11:]
    return "\n".join(lines) + "\n"


def test_license_files_and_headers(spark):
    texts = {
        "agpl/LICENSE": (AGPL, "AGPL-3.0"), "gpl/frob.py": (GPL, "GPL-3.0"), "bsd/LICENSE": (BSD, "BSD-2-Clause"), "apache/LICENSE": (APACHE, "Apache-2.0"), "a/h.py": (apache_header("#"), "Apache-2.0"), "b/h.c": (apache_header(" *"), "Apache-2.0"),
        "m/t": ("The MIT License (MIT)\n\nCopyright (c) 2020 X\n", "MIT"), "s/i.js": ("// SPDX-License-Identifier: ISC\nrun()\n" + prose(50, 5), "ISC"), "s/g.js": ("// SPDX-License-Identifier: GPL-2.0-or-later\n" + prose(50, 6), "GPL-2.0"),
        **{f"w/{name}": (whole(name), name) for name, _ in licenses.WHOLE},
        "b3/named": (BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to\n   endorse or promote products derived from this software without specific prior written permission.\n", "BSD-3-Clause"),
        "n/1": ("MIT", None), "n/2": ("ISC\nBSD\nGPL\nApache", None), "n/3": (prose(400, 7), None), "n/4": ("The license of the museum was renewed.\nPermission was granted to the public for free.", None),
        "n/5": ("He bought software under a general license from the foundation, free of charge.\n" + prose(30, 8), None),
    }
    rows = [(k, path, text) for k, (path, (text, _)) in enumerate(texts.items())]
    got = {r.path: (r.license, r.is_license_file) for r in scanned(spark, rows).collect()}
    assert {p: g[0] for p, g in got.items()} == {p: want for p, (_, want) in texts.items()}
    assert all(got[p][1] for p in texts if p.endswith("LICENSE") or p.startswith("w/"))


def test_files_inherit_from_license_files(spark):
    rows = [(1, "x/LICENSE", AGPL), (2, "x/a/b/c.py", prose(20, 1)), (3, "x/a/COPYING", APACHE), (4, "y/z.py", prose(20, 2)), (5, "x/q.py", None), (None, "x/a/d.py", "")]
    got = {r.path: (r.effective, r.inherited_from) for r in scanned(spark, rows).collect()}
    assert got == {"x/LICENSE": ("AGPL-3.0", None), "x/a/b/c.py": ("Apache-2.0", "x/a"), "x/a/COPYING": ("Apache-2.0", None), "y/z.py": (None, None), "x/q.py": ("AGPL-3.0", "x"), "x/a/d.py": ("Apache-2.0", "x/a")}


def plain(text):
    """The best template of a text's units, each compared with every template."""
    every = [*licenses.TEMPLATES, *licenses.SHARED, *licenses.WHOLE]
    idf, unit, unseen = licenses.weights(every)
    first, last = len(licenses.TEMPLATES), len(licenses.TEMPLATES) + len(licenses.SHARED)
    found = []
    for b, block in enumerate([text, *re.split(r"\n(?:[^a-zA-Z0-9\n]*\n)+", text)]):
        parts = [block] if b == 0 else list(dict.fromkeys([block, *re.split(r"(?<=[.!?:])\s+", block), *re.split(r"\n|(?<=[.!?])\s+", block)]))
        for p, part in enumerate(parts):
            v = {w: (1 + math.log(n)) * idf.get(w, unseen) for w, n in Counter(re.findall("[a-z0-9]+", part.lower())).items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1
            for k, (name, _) in enumerate(every):
                hit = [w for w in unit[k] if w in v]
                s = round(sum(v[w] * unit[k][w] for w in hit) / norm, 9)
                if (k >= last) == (b == 0) and len(hit) >= licenses.COVER * len(unit[k]) and s >= licenses.THRESHOLD:
                    found.append(((not first <= k < last, s, -b, -p, -k), name))
    best = max(found, default=None)
    return (best[1], best[0][1]) if best else (None, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    r = random.Random(seed)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(r.randint(1, 6)):
            t = r.choice([*licenses.TEMPLATES, *licenses.SHARED, *licenses.WHOLE])[1].split()
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice([*words, *PROSE[:9], "\n# ", "//"])
            lines.append(r.choice(["", "# ", " * "]) + " ".join(t[: r.choice([len(t), len(t) // 2])]) + r.choice(["", "\n", "\n--\n"]))
        texts.append("\n".join(lines) if r.random() < 0.8 else lines[0])
    got = {x.doc_id: (x.license, x.similarity) for x in scanned(spark, list(zip(range(len(texts)), ["p/x.py"] * len(texts), texts))).collect()}
    for k, t in enumerate(texts):
        name, s = plain(t)
        assert got[k][0] == name and (s is None or abs(got[k][1] - s) < 1e-8), t


def test_repeated_rows_and_other_columns(spark):
    text = prose(20, 3) + "\nReleased under the MIT License."
    rows = [(1, "p/a", text, "x", 1)] * 3 + [(2, None, None, None, None), (3, "p/b", "word " * 200_000 + "\nReleased under the MIT License.\n" + "x" * 300_000, "y", 2)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string, license string, row int"))
    assert sorted((r.doc_id, r.license or "", r.similarity) for r in got.collect() if r.doc_id != 2) == [(1, "MIT", 1.0)] * 3 + [(3, "MIT", 1.0)]
