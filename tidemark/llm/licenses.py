"""License scans: TF-IDF cosine of headers, statements and whole license files to templates, then inheritance from the nearest directory above.

A text's units are the text as a whole, which is compared with whole license files, and its blocks between empty lines, their sentences and their lines, which are compared with notices, titles and headers; comment marks are no terms and don't count. Terms are weighted by frequency and by how few templates have them; words that no template has count fully in a unit's length. Only units with an anchor can reach the threshold: anchors are the templates' heaviest terms, taken until what is left of every template could not, and any other unit is passed over unseen. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: License ids and statements that name them: notices, titles and first paragraphs of license files, headers of source files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under the CC0 1.0 Public Domain Dedication license."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy, under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Names behind SPDX-License-Identifier, and the license that each means.
SPDX = {
    "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC0-1.0": "CC0-1.0",
    "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1",
    "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "ISC": "ISC", "0BSD": "0BSD", "MIT": "MIT", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense",
}
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {spdx}") for spdx, name in SPDX.items())
#: Statements that licenses share; they count where a text has no other.
SHARED = (("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),)
#: What whole license files are made of.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = next(t for name, t in TEMPLATES if name == "MIT" and t.endswith("conditions:"))
_BSD = """Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. " + next(t for _, t in TEMPLATES if t.startswith("Neither the name"))
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Whole license files, with which whole texts are compared.
WHOLE = (
    ("MIT", f"Copyright (c) {_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_AS_IS}"),
    ("ISC", f"Copyright (c) {next(t for name, t in TEMPLATES if name == 'ISC' and t.startswith('Permission'))} {_ISC_AS_IS}"),
    ("0BSD", f"Copyright (c) {next(t for name, t in TEMPLATES if name == '0BSD' and t.startswith('Permission'))} {_ISC_AS_IS}"),
)
#: Words of the templates that are frequent in any text.
FREQUENT = frozenset(
    "a above all an and any are as at be been but by can do either event every for form forms free from has in is it its may more must no nor not of on one only or other our out person shall such subject than that the their these this those to under use used using version was way when which with without work you your".split()
)
FREQUENT_IDF = 0.3
THRESHOLD = 0.7
#: A text with at least this share of its words in one statement is a license file of its directory.
FILE_SHARE = 0.3
#: A template matches only where at least this share of its terms stands: a lone "MIT" is no license, however close to a title of two words.
COVER = 0.6
#: Parts that a directory's rows are dealt into before they meet what the directory inherits.
SALT = 32
_TERM = "[a-z0-9]+"


def weights(templates=TEMPLATES + SHARED + WHOLE) -> tuple[dict[str, float], list[dict[str, float]], float]:
    """(idf of each term, unit vectors of the templates, idf of a term of none)."""
    bags = [Counter(re.findall(_TERM, t.lower())) for _, t in templates]
    df = Counter(w for b in bags for w in b)
    idf = {w: FREQUENT_IDF if w in FREQUENT else math.log((len(bags) + 1) / (n + 0.5)) for w, n in df.items()}
    unit = []
    for b in bags:
        v = {w: (1 + math.log(n)) * idf[w] for w, n in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit.append({w: x / norm for w, x in v.items()})
    return idf, unit, math.log((len(bags) + 1) / 0.5)


def anchors(unit: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms without which no statement reaches the threshold: by Cauchy's bound, the rest of every template is shorter than that. A template's heaviest terms are taken first, frequent words last."""
    chosen: set[str] = set()
    for v in unit:
        for w in sorted(v, key=lambda w: (w in FREQUENT or w.isdigit(), -v[w], w)):
            if math.sqrt(sum(x * x for u, x in v.items() if u not in chosen)) < threshold:
                break
            chosen.add(w)
    return sorted(chosen)


def units(src: DataFrame, near: str) -> DataFrame:
    """(row, words, block, part, t): the terms of what templates are compared with, of ``src`` (row, text), where it has an anchor. Block 0 is the whole text; blocks from 1 are what lines without a letter or digit leave, as one part, as sentences over wrapped lines, and as lines and their sentences."""
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), F.lit(0)))
    blocks = F.concat(F.array("text"), F.split("text", r"\n(?:[^a-zA-Z0-9\n]*+\n)++"))
    cut = src.where(F.col("text").rlike(near)).select("row", words.alias("words"), F.posexplode(blocks).alias("block", "b")).where(F.col("b").rlike(near))
    parts = F.array_distinct(F.concat(F.array("b"), F.split("b", r"(?<=[.!?:])\s+"), F.split("b", r"\n|(?<=[.!?])\s+")))
    each = cut.select("row", "words", "block", F.posexplode(F.when(F.col("block") == 0, F.array("b")).otherwise(parts)).alias("part", "u"))
    return each.where(F.col("u").rlike(near)).select("row", "words", "block", "part", F.regexp_extract_all(F.lower("u"), F.lit(_TERM), F.lit(0)).alias("t"))


def statements(src: DataFrame, threshold: float, templates=TEMPLATES, shared=SHARED, whole=WHOLE) -> DataFrame:
    """(row, block, part, license, similarity, own, n_words, words): the best template of every unit that reaches the threshold; ``own`` is false for templates that licenses share."""
    spark = src.sparkSession
    every = [*templates, *shared, *whole]
    idf, unit, unseen = weights(every)
    names = "|".join(anchors(unit, threshold))
    found = units(src, rf"(?i)(?<![a-z0-9])(?:{names})(?![a-z0-9])")
    # What a unit has outside the templates' words alone is at least so long that most can't reach the threshold, whatever the rest counts.
    known = F.array_intersect("t", F.array(*[F.lit(w) for w in sorted(idf)]))
    squares = F.create_map(*[F.lit(x) for w in sorted(idf) for x in (w, idf[w] ** 2)])
    most = F.aggregate(known, F.lit(0.0), lambda s, w: s + F.try_element_at(squares, w)) * F.pow(1 + F.log(F.size("t").cast("double")), 2)
    strange = (F.size(F.array_distinct("t")) - F.size(known)) * unseen**2
    near = found.where(most * (1 - threshold**2) >= strange * threshold**2 * (1 - 1e-9))
    # Rows that are equal in all have one key, and count once.
    near = near.groupBy("row", "block", "part").agg(F.first("words").alias("words"), F.first("t").alias("t"))
    terms = near.select("row", "block", "part", "words", F.size("t").alias("n_words"), F.explode("t").alias("term")).groupBy("row", "block", "part", "words", "n_words", "term").agg(F.count(F.lit(1)).alias("tf"))
    table = spark.createDataFrame([(w, idf[w], [(k, v[w]) for k, v in enumerate(unit) if w in v]) for w in sorted(idf)], "term string, idf double, of array<struct<k:int,w:double>>")
    weight = (1 + F.log(F.col("tf"))) * F.coalesce("idf", F.lit(unseen))
    key = ["row", "block", "part", "words", "n_words"]
    weighed = terms.join(F.broadcast(table), "term", "left").select(*key, weight.alias("w"), "of")
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("of").isNotNull(), F.struct("w", "of"))).alias("hits"))
    pairs = norms.select(*key, "norm", F.explode("hits").alias("h")).select(*key, "norm", F.col("h.w").alias("w"), F.explode("h.of").alias("o"))
    dots = pairs.groupBy(*key, "norm", "o.k").agg((F.sum(F.col("w") * F.col("o.w")) / F.col("norm")).alias("dot"), F.count(F.lit(1)).alias("n"))
    about = spark.createDataFrame([(k, name, len(unit[k]), k < len(templates) or k >= len(templates) + len(shared), k >= len(templates) + len(shared)) for k, (name, _) in enumerate(every)], "k int, license string, n_terms int, own boolean, whole boolean")
    kept = dots.join(F.broadcast(about), "k").where((F.col("whole") == (F.col("block") == 0)) & (F.col("n") >= F.col("n_terms") * COVER)).withColumn("similarity", F.round("dot", 9)).where(F.col("similarity") >= threshold)
    best = kept.groupBy("row", "block", "part", "words", "n_words").agg(F.max(F.struct("own", "similarity", (-F.col("k")).alias("k"), "license")).alias("best"))
    return best.select("row", "block", "part", F.col("best.license").alias("license"), F.col("best.similarity").alias("similarity"), F.col("best.own").alias("own"), "n_words", "words")


def parents(directory: Column) -> Column:
    """A directory and those above it, the empty root included, as (directory, depth)."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.struct(F.lit("").alias("dir"), F.lit(0).alias("depth")))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), n.alias("depth"))))


def license_scan(files: DataFrame, threshold: float = THRESHOLD, file_share: float = FILE_SHARE, templates=TEMPLATES, shared=SHARED, whole=WHOLE) -> DataFrame:
    """(doc_id, path, license, similarity, is_license_file, inherited, inherited_from, effective) for every row of ``files`` (doc_id, path, text).

    ``license`` is the best template of the text's best unit, ties by the first in the text; templates that licenses share count where a text has no other; a text without one inherits from the nearest directory at or above its own that has a license file, of several there the most similar one, then the smallest license id. License files are those named LICENSE, LICENCE, COPYING or NOTICE, and texts of which one unit is at least ``file_share``. Null or empty texts have no license of their own; a null path is the root; repeated rows are judged alike, once a row; an empty table gives no rows. Other columns of ``files`` are not read, whatever their names.
    """
    src = files.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.length("path").cast("string"), "path", "text").cast("binary")))
    own = statements(src.select("row", "text").where("text <> ''"), threshold, templates, shared, whole)
    own = own.groupBy("row").agg(F.max(F.struct("own", "similarity", (-F.col("block")).alias("block"), (-F.col("part")).alias("part"), "license")).alias("b"), F.max(F.col("n_words") >= F.col("words") * file_share).alias("mainly")).select("row", F.col("b.license").alias("license"), F.col("b.similarity").alias("similarity"), "mainly")
    named = src.select("doc_id", "path", "row", F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).join(own, "row", "left")
    is_file = F.col("license").isNotNull() & (F.coalesce("mainly", F.lit(False)) | F.regexp_extract("path", "[^/]*$", 0).rlike(r"(?i)^(licen[cs]e|copying|notice)(\.\w+)?$"))
    marked = named.withColumn("is_license_file", is_file)
    given = marked.where("is_license_file").groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("l")).select("dir", F.col("l.license").alias("given"))
    above = marked.select(F.col("dir").alias("own")).distinct().select("own", F.explode(parents(F.col("own"))).alias("p")).select("own", F.col("p.dir").alias("dir"), F.col("p.depth").alias("depth"))
    nearest = above.join(given, "dir").groupBy("own").agg(F.max(F.struct("depth", "dir", "given")).alias("n"))
    salted = nearest.select(F.col("own").alias("dir"), F.col("n.given").alias("given"), F.col("n.dir").alias("from"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    out = marked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(salted, ["dir", "salt"], "left")
    bare = F.col("license").isNull()
    return out.select("doc_id", "path", "license", "similarity", "is_license_file", F.when(bare, F.col("given")).alias("inherited"), F.when(bare & F.col("given").isNotNull(), F.col("from")).alias("inherited_from"), F.coalesce("license", "given").alias("effective"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """``documents`` as a tree of files: source / language / file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs.select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt")).alias("path"), "text"))
