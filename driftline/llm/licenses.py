"""License scans: MinHash over overlapping windows retrieves templates, exact containment verifies.

A text's positions are its 5-word shingles in order (words of letters and digits, A-Z
lower-cased; fewer words make one shingle).  A template of m distinct shingles is looked
for in windows of W = 2 ** ceil(log2(2 m)) positions that start at every W / 2-th, so
that any m positions in a row lie in one window.  A window and a template meet in a band
if one of BANDS minima is equal (one row a band).  A window that holds 75 % of a template
has a Jaccard similarity of at least 0.75 m / (W + 0.25 m) > 0.17, which the bands miss
with a chance of less than (1 - 0.17) ** 64 < 1e-5, and far less where all is there.
Every retrieved window is then verified: it matches if it holds at least PERCENT of the
template's distinct shingles.

Defined cases: null and empty texts match nothing; repeated rows are each scanned; an
empty table gives no rows; very long texts are scanned whole; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import table

SHINGLE, PERCENT, BANDS = 5, 75, 64

#: Notices of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}

CC = "This work is licensed under a Creative Commons Attribution"
FSF = "as published by the Free Software Foundation"

#: More notices.  The headers hold only what the GPL's header doesn't mostly hold too.
MORE = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-header": f"under the terms of the GNU Affero General Public License {FSF}",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-no-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": f"{CC}-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": f"{CC}-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-nd-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0": f"{CC}-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-sa-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0": f"{CC}-NoDerivatives 4.0 International License.",
    "cc-by-nd-4.0-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0": f"{CC}-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "lgpl-header": f"under the terms of the GNU Lesser General Public License {FSF}",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


class Scanner:
    """Templates by window size, with their minima for each band."""

    def __init__(self, templates: dict[str, str], percent: int = PERCENT):
        self.percent = percent
        self.factors = np.random.Generator(np.random.PCG64(10)).integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names, self.sets = list(templates), []
        for t in templates.values():
            self.sets.append(K.shingles(*K.texts(pa.array([t])), SHINGLE, K.ALNUM)[0])
        #: log2 of half the window of each template
        self.level = [max(0, (len(s) - 1).bit_length()) for s in self.sets]
        self.minima = np.array([[(s * f).min() for f in self.factors] for s in self.sets])

    def scan(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, template, first position of the window, template shingles held) of each verified window."""
        buf, off = K.texts(column)
        out = []
        for a, b in K.pieces(off):
            part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            st, en, wo = K.words(part, o, K.ALNUM)
            h = K.span_hash(K.prefix(part, K.FOLDED), st, en)
            at, so = K.window_starts(wo, SHINGLE)
            s = K.gram_hash(h, at, SHINGLE)
            n = np.diff(wo)
            short = np.flatnonzero((n > 0) & (n < SHINGLE))
            count = np.diff(so)
            count[short] = 1
            # texts begin at multiples of the largest block
            top = max(self.level)
            room = ((count + (1 << top) - 1) >> top) << top
            base = np.concatenate(([0], np.cumsum(room)))
            pos = np.full(base[-1], np.iinfo(np.uint64).max, np.uint64)
            held = np.zeros(base[-1], bool)
            idx = np.arange(len(s)) + np.repeat(base[:-1] - so[:-1], np.diff(so))
            pos[idx], held[idx] = s, True
            for d in short:
                pos[base[d]], held[base[d]] = K.gram_hash(h, wo[d : d + 1], int(n[d]))[0], True
            if not len(pos):
                continue
            hits = [np.zeros(len(pos) >> l, bool) for l in self.level]
            last = {l: np.zeros(len(pos) >> l, bool) for l in set(self.level)}
            for l, x in last.items():
                x[(base[1:][room > 0] >> l) - 1] = True
            full = np.iinfo(np.uint64).max
            for f, minima in zip(self.factors, self.minima.T):
                low = np.where(held, pos * f, full)
                for l in range(top + 1):
                    if l:
                        low = np.minimum(low[0::2], low[1::2])
                    if l in last:
                        window = low.copy()
                        np.minimum(window[:-1], low[1:], out=window[:-1], where=~last[l][:-1])
                        for t, level in enumerate(self.level):
                            if level == l:
                                hits[t] |= window == minima[t]
            for t, (l, hit) in enumerate(zip(self.level, hits)):
                for j in np.flatnonzero(hit):
                    d = int(np.searchsorted(base, j << l, "right")) - 1
                    end = min((j + 2) << l, int(base[d + 1]))
                    w = pos[j << l : end][held[j << l : end]]
                    got = len(np.intersect1d(w, self.sets[t]))
                    if 100 * got >= self.percent * len(self.sets[t]):
                        out.append((a + d, t, int((j << l) - base[d]), got))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, matches array<struct<license, window, held, of>>: every window of every text that holds a template."""
    scanner = Scanner(templates or TEMPLATES)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("window", pa.int64()), ("held", pa.int64()), ("of", pa.int64())]))

    def run(batches):
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for d, t, start, got in scanner.scan(batch.column("text")):
                found[d].append({"license": scanner.names[t], "window": start, "held": got, "of": len(scanner.sets[t])})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "matches"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, matches array<struct<license:string,window:long,held:long,of:long>>")


def _named(matches: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct("matches.license"))
    return matches.select("doc_id", F.size("matches").cast("long").alias("n_windows"), F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(scan(table(spark, sf_dir, "documents"), TEMPLATES | MORE))


def op10_license_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; kept for those who call it by this name."""
    return op10_license_scan(spark, sf_dir)


def _sql() -> str:
    words = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    rows = ", ".join(f"('{n}', '{t}')" for n, t in (TEMPLATES | MORE).items())
    return f"""
WITH t AS (SELECT n, {words.format("t")} AS w FROM (VALUES {rows}) AS v(n, t)),
ts AS (SELECT DISTINCT n, w[i:i + 4] AS g FROM (SELECT n, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t)),
tm AS (SELECT n, count(*) AS m, (2 ** ceil(log2(count(*))))::BIGINT AS half FROM ts GROUP BY n),
d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
h AS (SELECT doc_id, n, m, i // half AS j, g FROM ds JOIN ts USING (g) JOIN tm USING (n)),
x AS (SELECT doc_id, n, m, j, g FROM h UNION SELECT doc_id, n, m, j - 1, g FROM h WHERE j > 0),
c AS (SELECT doc_id, n, j FROM x GROUP BY doc_id, n, m, j HAVING 100 * count(DISTINCT g) >= 75 * m),
r AS (SELECT doc_id, count(*) AS k, count(DISTINCT n) AS l, string_agg(DISTINCT n, ',' ORDER BY n) AS names FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_windows, coalesce(l, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses FROM d LEFT JOIN r USING (doc_id)
"""


SQL = _sql()
