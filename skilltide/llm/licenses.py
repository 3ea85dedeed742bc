"""Licence scan of files: sparse TF-IDF cosine to templates, then inheritance from directories.

Around every licence cue a window somewhat longer than the template slides over the
words, and is compared with each template as a sparse vector, weighted by the inverse
document frequency that the templates' words have over all files. Words outside the
template do not count, so a notice is found among any others; in return the words
that tell a template from its like have to stand in the window. An SPDX line names
its licence itself. A file that matches has its own licence; a matching licence file
also gives its directory one. Any other file inherits from its nearest ancestor directory with
a licence: the different directories, not the files, are joined with their
ancestors' paths.

Edge cases: null and empty texts match nothing and can only inherit; a null path
has no directory and inherits nothing; files at the top inherit from the top's
licence file; equal scores go to the template with more matching words, then to the
first; reserved rights stand back behind any licence; equal licence files of one
directory to the higher score, then to the smaller path; repeated rows are scanned
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: Licence notices by identifier: fixed texts as they stand in headers and licence files.
#: The third text holds the words that have to be there.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache 2.0 terms"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License.", "bsd 2 clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED", "redistribution binary retain reproduce provided"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License.", "bsd 3 clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary permitted"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "redistribution binary neither endorse"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "creative commons attribution noncommercial sharealike 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. Dedicated to the public domain under CC0 1.0.", "waived copyright related rights"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0.", "public domain cc0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gnu general public version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu general public version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser version 3"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu lesser version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu affero version 3"),
    ("ISC", "Released under the ISC License.", "isc license"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission fee granted appear"),
    ("MIT", "Released under the MIT License.", "mit license"),
    ("MIT", "Licensed under the MIT License.", "licensed mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "permission granted free charge deal"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "mozilla 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    ("Proprietary", "Copyright. All rights reserved.", "all rights reserved"),
)
_CUES = ("licen", "copyright", "spdx", "public domain", "all rights reserved", "permission is hereby", "permission to use", "creative commons", "redistribution and use", "free software")
_CUE = re.compile("|".join(_CUES))
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_FILE = re.compile(r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense|notice)(?:[.\-_][^/]*)?$")


#: Words that may stand beyond a template's length in its window, and characters looked at on each side of a cue.
SLACK, REACH = 8, 2000
_SPDX = re.compile(r"(?i)spdx-license-identifier\s*:[ \t]*([^\r\n]*)")
_ID = re.compile(r"(?:DocumentRef-[\w.\-]+:)?(?=[\w.\-]*(?:[A-Z][\w.\-]*[A-Z]|\d|-))[A-Za-z0-9][\w.\-]*\+?|(?:Unlicense|Zlib|curl|Ruby|Vim|PostgreSQL|OpenSSL|Beerware|mit|isc)\b")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in words_of(t)})
NAMES = {name.lower(): name for name, _, _ in TEMPLATES}


def spdx(value: str) -> str | None:
    """The expression at the start of an SPDX line's value, single identifiers as the templates name them."""
    found, at, depth, open_end = [], 0, 0, True
    for m in re.finditer(r"\s*(?:(\()|(\))|(AND|OR|WITH)(?=\s)|([^\s()*/<>,;\"']+))", value):
        if m.start() != at:
            break
        if m[1] and open_end:
            depth += 1
        elif m[2] and not open_end and depth:
            depth -= 1
        elif m[3] and not open_end:
            open_end = True
        elif m[4] and open_end and _ID.fullmatch(m[4].rstrip(".")):
            open_end = False
        else:
            break
        at = m.end()
        found.append(m[0].strip().rstrip("."))
    while found and found[-1] in ("AND", "OR", "WITH", "("):
        depth -= found.pop() == "("
    if not found or depth:
        return None
    named = [NAMES.get(re.sub(r"(?:-only|-or-later|\+)$", "", w.lower()), w) for w in found]
    return " ".join(named).replace("( ", "(").replace(" )", ")")


class Matcher:
    """Cosine to each template of the template's words in windows around the cues of a text."""

    def __init__(self, idf: dict[str, float], rare: float, least: float = 0.7):
        self.least = least
        self.templates = []
        for name, text, needed in TEMPLATES:
            counts = Counter(words_of(text))
            square = {w: (n * idf.get(w, rare)) ** 2 for w, n in counts.items()}
            total = sum(square.values())
            part = {w: x / total / counts[w] for w, x in square.items()}
            self.templates.append((name, counts, part, frozenset(needed.split()), sum(counts.values()) + SLACK, total))

    def _near(self, words: list[str], at: int) -> Iterator[tuple[float, float, str]]:
        """(score, weight of the matching words, name) of each template that has its needed words in a window over the word ``at``."""
        here = set(words)
        for name, counts, part, needed, size, total in self.templates:
            if not needed <= here:
                continue
            places = [i for i in range(max(0, at - size + 1), min(len(words), at + size)) if words[i] in counts]
            held: Counter[str] = Counter()
            best, value, first = 0.0, 0.0, 0
            for i in places:
                w = words[i]
                held[w] += 1
                value += part[w] if held[w] <= counts[w] else 0.0
                while places[first] <= i - size:
                    w = words[places[first]]
                    value -= part[w] if held[w] <= counts[w] else 0.0
                    held[w] -= 1
                    first += 1
                if value > best and all(held[w] for w in needed):
                    best = value
            if best > 0:
                yield round(math.sqrt(best), 9), round(best * total, 6), name

    def scan(self, text: str | None) -> tuple[float, str | None]:
        """Best match around the cues of a text; licences that reach ``least`` go before reserved rights."""
        if not text:
            return 0.0, None
        low = text.lower()
        if not any(c in low for c in _CUES):
            return 0.0, None
        for m in _SPDX.finditer(text):
            name = spdx(m[1])
            if name:
                return 1.0, name
        top, rank = (0.0, None), (False, 0.0, 0.0)
        seen = set()
        for m in _CUE.finditer(low):
            around = low[max(0, m.start() - REACH) : m.start()], low[m.start() : m.end() + REACH]
            key = xxhash.xxh3_128_digest("\0".join(around).encode("utf-8", "surrogatepass"))
            if key in seen:  # the same words again
                continue
            seen.add(key)
            before, after = map(words_of, around)
            for score, weight, name in self._near(before + after, len(before)):
                one = (score >= self.least and name != "Proprietary", score, weight)
                if one > rank:
                    top, rank = (score, name), one
        return top


def document_frequency(files: DataFrame, text_col: str) -> tuple[dict[str, int], int]:
    """Of each template word, the files that hold it, and all files: over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts, wanted = 0, Counter(), set(VOCABULARY)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    counts.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(["", *counts], pa.string()), pa.array([n, *counts.values()], pa.int64())], ["word", "n"])

    got = files.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in got}
    return counts, counts.pop("", 0)


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """All of ``files`` but its text, with license, score, basis (header, file, inherited or null) and license_path.

    Columns of the input that have one of these four names are replaced.
    """
    counts, n = document_frequency(files, text_col)
    idf = {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1 for w in VOCABULARY}
    rare = math.log(1 + n) + 1
    keep = [c for c in files.columns if c not in (text_col, "license", "score", "basis", "license_path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(idf, rare, least)
        for batch in batches:
            found = [matcher.scan(t) for t in batch.column("_text").to_pylist()]
            names = pa.array([name if score >= least else None for score, name in found], pa.string())
            scores = pa.array([score if score >= least else None for score, _ in found], pa.float64())
            rest = [batch.column(i) for i in range(len(keep) + 1)]
            yield pa.RecordBatch.from_arrays([*rest, names, scores], [*(f"c{i}" for i in range(len(keep))), "_path", "_own", "_score"])

    kinds = dict(files.dtypes)
    rows = files.select(*(files[c].alias(f"c{i}") for i, c in enumerate(keep)), files[path_col].cast("string").alias("_path"), files[text_col].cast("string").alias("_text"))
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(keep)), "_path string, _own string, _score double"])
    rows = written(rows.mapInArrow(run, schema), "license-matches").withColumn("_dir", F.regexp_extract("_path", r"^(.*)/[^/]*$", 1))

    is_file = F.coalesce(F.col("_path").rlike(_FILE.pattern), F.lit(False))
    # The highest score of a directory's licence files; of equal ones the smallest path
    given = rows.where(is_file & F.col("_own").isNotNull()).groupBy(F.col("_dir").alias("_above")).agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_path").alias("p"), F.col("_own").alias("l"))).alias("g"))
    places = rows.where("_own is null and _path is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nearest = places.select("_dir", F.posexplode(F.array_distinct(above)).alias("_depth", "_above")).join(given, "_above")
    nearest = nearest.groupBy("_dir").agg(F.max_by("g", "_depth").alias("g"))
    rows = rows.join(nearest, (rows["_dir"] == nearest["_dir"]) & rows["_own"].isNull(), "left").drop(nearest["_dir"])
    basis = F.when(F.col("_own").isNotNull(), F.when(is_file, "file").otherwise("header")).when(F.col("g").isNotNull(), "inherited")
    return rows.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.coalesce("_own", "g.l").alias("license"), F.coalesce(F.col("_score"), -F.col("g.s")).alias("score"),
        basis.alias("basis"), F.when(F.col("_own").isNotNull(), F.col("_path")).otherwise(F.col("g.p")).alias("license_path"),
    )


def documents_as_files(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: a hundred documents to a directory of their source; the first of each is its LICENSE."""
    at = F.col("doc_id").cast("long")
    name = F.when(at % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(at.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(at / 10_000).cast("string"), F.floor(at / 100).cast("string"), name)
    return docs.select("doc_id", F.when(at.isNotNull(), path).alias("path"), "text")


def document_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(documents_as_files(table(spark, sf_dir, "documents")))
