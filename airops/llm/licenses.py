"""License scans: MinHash bands over overlapping text windows.

Texts and license templates are lower-cased, stripped of ASCII punctuation and
cut into word shingles (of five words; a template of fewer is one shingle and
must occur as it is). A window begins at every shingle that a template also
has, so that windows overlap, and is a fifth longer than the template; at the
end of a text it is as short as the text. Of a window only the shingles of the
template are looked at, so the Jaccard similarity of the two sets is the
containment: the share of the template's shingles that the window holds. The
window's MinHash signature is the sliding minimum of ``BANDS * ROWS`` hash
functions; it retrieves the template if they agree in all rows of some band, at
the least containment 0.8 with probability 1 - (1 - 0.8 ** ROWS) ** BANDS =
0.9997. Retrieved windows are verified by exact containment. Templates that no
text has enough shingles of are left out before, which loses nothing.

What licenses have in common (openers, notices, bodies) is told apart by the
phrases of ``TELLS`` from the start of the passage on; where none is found,
the label is the template's own.

Defined cases: a null or empty text matches nothing; of overlapping windows of
a template the one with the largest containment, then the shortest, then the
first, is reported, from its first to its last shingle that counts; a passage
inside a longer one of the same family of licenses is part of that;
repeated rows are scanned alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from airops.llm import license_texts, textops
from airops.llm.common import bound_batches, read_table, schema

SHINGLE, CONTAINMENT = 5, 0.8
BANDS, ROWS = 8, 2

# Notices and opening sentences of public licenses, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("LicenseRef-BSD", "Redistribution and use in source and binary forms, with or without modification, are "
                       "permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LicenseRef-GPL", "This program is free software: you can redistribute it and/or modify it under the terms "
                       "of the GNU General Public License as published by the Free Software Foundation"),
    ("LicenseRef-LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of "
                        "the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LicenseRef-LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of "
                        "the GNU Library General Public License as published by the Free Software Foundation"),
    ("LicenseRef-AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of "
                        "the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LicenseRef-reserved", "All rights reserved."),
    ("MIT", "under the MIT License"),
    ("ISC", "under the ISC License"),
    ("BSD-2-Clause", "under the BSD 2-Clause License"),
    ("BSD-3-Clause", "under the BSD 3-Clause License"),
    ("Apache-2.0", "under the Apache License 2.0"),
    ("Apache-2.0", "under the Apache 2.0 License"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted"),
    ("0BSD", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee "
             "is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    *((f"CC-BY-{v}-4.0", f"Licensed under CC BY-{v} 4.0.") for v in ("ND", "NC-SA", "NC-ND")),
    *((f"CC-BY-{v}-4.0", f"This work is licensed under a Creative Commons Attribution-{long} 4.0 International License.")
      for v, long in (("ND", "NoDerivatives"), ("NC-SA", "NonCommercial-ShareAlike"),
                      ("NC-ND", "NonCommercial-NoDerivatives"))),
    *((i, f"SPDX-License-Identifier: {i}") for i in (
        "MIT MIT-0 0BSD ISC Unlicense Apache-2.0 BSD-2-Clause BSD-3-Clause CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 "
        "CC-BY-NC-4.0 MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only "
        "LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later").split()),
    ("MIT", license_texts.MIT),
    ("BSD-2-Clause", license_texts.BSD),
    ("0BSD", license_texts.ZERO_BSD),
    ("Unlicense", license_texts.UNLICENSE),
    ("Apache-2.0", license_texts.APACHE_2),
    ("CC0-1.0", license_texts.CC0_1),
    ("MPL-2.0", license_texts.MPL_2),
    ("GPL-2.0-only", license_texts.GPL_2),
    ("GPL-3.0-only", license_texts.GPL_3),
    ("LGPL-2.1-only", license_texts.LGPL_21),
    ("LGPL-3.0-only", license_texts.LGPL_3),
]

#: Templates of more words than this are the bodies of long licenses: what tells them apart is their title.
LONG, TITLE = 400, 20


def _versions(license_id: str, name: str, *versions: str) -> list[tuple[str, list[str], list[str]]]:
    out = []
    for v in versions:
        full, given = f"{license_id}-{v if '.' in v else v + '.0'}", [f"gnu {name} license"]
        said = v.replace(".", "")
        out += [(f"{full}-or-later", [*given, f"version {said} of the license", "any later version"], []),
                (f"{full}-or-later", [f"gnu {name} license version {said} or"], []),
                (f"{full}-or-later", [f"gnu {name} license v{said}0 or"], []),
                (f"{full}-only", [*given, f"version {said} of the license"], []),
                (f"{full}-only", [f"gnu {name} license version {said}"], []),
                (f"{full}-only", [f"gnu {name} license as published by the free software foundation version {said}"], [])]
    return out


_GNU = [*_versions("AGPL", "affero general public", "3"), *_versions("LGPL", "lesser general public", "2.1", "3"),
        *_versions("LGPL", "library general public", "2"), *_versions("GPL", "general public", "2", "3"),
        *((f"LicenseRef-{i}", [f"gnu {name} license as published by the free software foundation"], [])
          for i, name in (("AGPL", "affero general public"), ("LGPL", "lesser general public"),
                          ("LGPL", "library general public"), ("GPL", "general public")))]
_ISC = [("ISC", ["this permission notice appear in all copies"], []),
        ("HPND", ["provided that the above copyright notice appear in all copies"], [])]
#: By family of licenses: words from the start of the passage, and (label, phrases there, phrases not there) in order.
TELLS: dict[str, tuple[int, list[tuple[str, list[str], list[str]]]]] = {
    "GPL": (60, _GNU), "LGPL": (60, _GNU), "AGPL": (60, _GNU), "ISC": (60, _ISC), "0BSD": (60, _ISC),
    "BSD": (300, [("BSD-4-Clause", ["all advertising materials mentioning features or use of this software"], []),
                  ("BSD-3-Clause", ["endorse or promote products derived from this software"], []),
                  ("BSD-1-Clause", ["this software is provided by"], ["redistributions in binary form"]),
                  ("BSD-2-Clause", ["this software is provided by", "redistributions in binary form"], [])]),
    "MIT": (220, [("X11", ["shall not be used in advertising or otherwise to promote"], []),
                  ("MIT-0", ["free of charge", "the software is provided as is"],
                   ["shall be included in all copies"])]),
    "GPL body": (40, [("AGPL-3.0-only", ["gnu affero general public license version 3"], [])]),
}

_PUNCTUATION = string.punctuation.encode()
_MULTIPLY = textops.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = textops.mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))
_FILTER_BITS = 20


def normalised(column) -> list[bytes]:
    return [t.translate(None, _PUNCTUATION) for t in textops.as_bytes(column, fold=True)]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if span < width else x


def family(license_id: str) -> str:
    return re.sub(r"(?<=[A-Z])-\d.*", "", license_id.removeprefix("LicenseRef-"))


class TemplateIndex:
    """The shingles of the templates by width, each with the templates that have it."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        self.names = [n for n, _ in templates]
        w = textops.Words(normalised([t for _, t in templates]))
        self.size, self.keys, self.tells = [], [], []
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, name in enumerate(self.names):
            n = int(w.first[k + 1] - w.first[k])
            sh = np.unique(textops.shingles(w, k, SHINGLE))
            self.size.append(len(sh))
            self.keys.append(band_keys(sh, np.ones(len(sh), dtype=bool), len(sh))[:, 0])
            # a tag or a name of up to five words stands for itself
            self.tells.append(TELLS.get(family(name) + (" body" if n > LONG else "")) if n > SHINGLE else None)
            by_width.setdefault(min(SHINGLE, n), []).append((k, sh))
        self.size = np.asarray(self.size)
        self.groups = {}
        for width, of in by_width.items():
            every = np.concatenate([sh for _, sh in of])
            order = np.argsort(every, kind="stable")
            known = np.zeros(1 << _FILTER_BITS, dtype=bool)
            known[every >> np.uint64(64 - _FILTER_BITS)] = True
            self.groups[width] = (known, every[order], np.repeat([k for k, _ in of], [len(sh) for _, sh in of])[order])


def band_keys(sh: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """(BANDS, windows): the key of each band of every window of ``size``
    shingles, of which those that count are hashed."""
    out = []
    for b in range(BANDS):
        key = np.full(len(sh) - size + 1, b + 1, dtype=np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            h = np.where(counts, textops.mix(sh * _MULTIPLY[r] + _ADD[r]), np.uint64(2**64 - 1))
            key = textops.mix(key ^ _sliding_min(h, size))
        out.append(key)
    return np.stack(out)


def _windows(index: TemplateIndex, k: int, at: np.ndarray, sh: np.ndarray) -> list[tuple[float, int, int]]:
    """(-containment, shingles from first to last, first) of the windows for
    template ``k``, whose shingles ``sh`` stand at ``at`` in a text."""
    n = int(index.size[k])
    reach = n + (n // 5 + 4 if n > 1 else 0)
    ends = np.searchsorted(at, at + reach)
    begins = np.flatnonzero(ends - np.arange(len(at)) >= CONTAINMENT * n)
    if not len(begins):
        return []
    span = int(at[-1] - at[0]) + reach
    dense, counts = np.zeros(span, dtype=np.uint64), np.zeros(span, dtype=bool)
    dense[at - at[0]], counts[at - at[0]] = sh, True
    agree = (band_keys(dense, counts, reach)[:, at[begins] - at[0]] == index.keys[k][:, None]).any(axis=0)
    out = []
    for s in begins[agree].tolist():
        first = np.unique(sh[s:ends[s]], return_index=True)[1]
        if len(first) >= CONTAINMENT * n:
            out.append((-len(first) / n, int(at[s + first.max()] - at[s]) + 1, int(at[s])))
    return out


def _told(index: TemplateIndex, k: int, w: textops.Words, lo: int, hi: int, text: int) -> str:
    """The label of a passage of template ``k`` that begins at word ``lo``, where
    the next one begins at ``hi``."""
    if index.tells[k] is None:
        return index.names[k]
    ahead, tells = index.tells[k]
    if index.size[k] > LONG:
        lo = max(lo - TITLE, int(w.first[text]))
    hi = min(hi, lo + ahead, int(w.first[text + 1]))
    said = b" " + b" ".join(w.buf[w.start[lo]:w.end[hi - 1]].tobytes().split()) + b" "
    for name, there, absent in tells:
        if all(f" {p} ".encode() in said for p in there) and not any(f" {p} ".encode() in said for p in absent):
            return name
    return index.names[k]


def scan_texts(index: TemplateIndex, texts: list[bytes]) -> list[tuple]:
    """(text, license, template, first word, past last word, containment) of all matches."""
    out = []
    for lo, hi in textops.steps(texts, 1 << 18):
        w = textops.Words(texts[lo:hi])
        found: dict[int, list[tuple]] = {}
        for width, (known, every, template) in index.groups.items():
            sh = textops.windows_hash(w.hash, width)
            at = np.flatnonzero(known[sh >> np.uint64(64 - _FILTER_BITS)])
            a, z = np.searchsorted(every, sh[at]), np.searchsorted(every, sh[at], "right")
            text = np.searchsorted(w.first, at, "right") - 1
            many = np.where(at + width <= w.first[text + 1], z - a, 0)
            of = template[np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            at, text = np.repeat(at, many), np.repeat(text, many)
            order = np.lexsort((at, of, text))
            at, text, of = at[order], text[order], of[order]
            cut = np.flatnonzero(np.diff(text * len(index.names) + of, prepend=-1, append=-1))
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                k, i = int(of[s]), int(text[s])
                if e - s < CONTAINMENT * index.size[k]:
                    continue
                taken: list[tuple[int, int, float]] = []
                for same, span, first in sorted(_windows(index, k, at[s:e], sh[at[s:e]])):
                    past = first + span + width - 1
                    if all(past <= t or first >= p for t, p, _ in taken):
                        taken.append((first, past, -same))
                taken.sort()
                for (first, past, same), after in zip(taken, [t for t, _, _ in taken[1:]] + [len(w.hash)]):
                    found.setdefault(i, []).append((first, past, _told(index, k, w, first, after, i), k, same))
        for i, rows in found.items():
            begin = int(w.first[i])
            for first, past, name, k, same in rows:
                if not any(f <= first and past <= p and p - f > past - first and family(n) == family(name)
                           for f, p, n, _, _ in rows):
                    out.append((lo + i, name, k, first - begin, past - begin, same))
    return sorted(out)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per license passage: doc_id, license, template, words (of the
    normalised text) and containment."""
    bound_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = TemplateIndex(templates)
        for pdf in batches:
            rows = scan_texts(index, normalised(pdf["text"]))
            out = pd.DataFrame(rows, columns=["k", "license", "template", "start_word", "end_word", "containment"])
            out.insert(0, "doc_id", pdf["doc_id"].take(out.pop("k").to_numpy(dtype=np.int64)).array)
            yield out

    return picked.mapInPandas(run, schema(
        ("doc_id", picked.schema["doc_id"].dataType), ("license", "string"), ("template", "int"),
        ("start_word", "bigint"), ("end_word", "bigint"), ("containment", "double")))


def op8_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License passages of every whole text of ``documents``."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))
