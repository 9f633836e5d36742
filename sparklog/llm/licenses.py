"""License scan (operator 7): MinHash bands over overlapping windows, verified by shingle containment.

A template is the set of its 5-word shingles (words: runs of letters and digits, A-Z lower-cased; a shorter
template is one shingle).  A template of t shingles is sought in windows of 1.5 t shingles that start
every t / 2 shingles, so a whole copy lies inside some window.  A window that holds three quarters of the
template's shingles has a Jaccard similarity of at least 0.75 / (1 + 1.5 - 0.75) = 0.43 with it, and
meets it in one of ``BANDS`` = 25 one-minhash bands with probability 1 - (1 - 0.43) ** 25 > 1 - 1e-6.
The bands of all templates form one table (band, minhash) -> templates per window size; the minhashes of
every window are looked up in it, and the templates that it returns are verified by exact containment:
at least 75 % of the template's shingles are among the window's.  Equal minhashes mean a shared shingle, so
windows without any shingle of any template meet no band and are not formed.  Documents are not
shuffled; templates are a parameter (fixed texts).

Defined cases: a null or wordless text has no license; a template without words is left out; rows
repeating a document id are scanned one by one; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, ALNUM, LOWER, Words, mix, small_batches, table, text_chunks
from .license_texts import DECIDE, TEXTS

SHINGLE = 5
CONTAINED = 75
BANDS = 25

# License statements and notices, as published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at",
}

_GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as " \
    "published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_GNU_ONLY = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License " \
    "{}as published by the Free Software Foundation{}."
_KINDS = {"GPL-1.0": ("program", "", "1"), "GPL-2.0": ("program", "", "2"), "GPL-3.0": ("program", "", "3"),
          "LGPL-2.0": ("library", "Library ", "2"), "LGPL-2.1": ("library", "Lesser ", "2.1"), "LGPL-3.0": ("library", "Lesser ", "3"),
          "AGPL-3.0": ("program", "Affero ", "3")}

# The templates with their siblings; a name is the license and, after ~, which of its texts this is.
SIBLINGS = {
    **{f"{k}~statement": f"This work is licensed under the GNU {name}General Public License, version {v}."
       for k, (_, name, v) in _KINDS.items() if k != "GPL-3.0"},
    **{f"{k}~notice": _GNU.format(what, ";", name, ";", v) for k, (what, name, v) in _KINDS.items() if k != "GPL-3.0"},
    **{f"{k}~only-before": _GNU_ONLY.format(what, name, f"version {v} ", "") for k, (what, name, v) in _KINDS.items()},
    **{f"{k}~only-after": _GNU_ONLY.format(what, name, "", f"; version {v} of the License") for k, (what, name, v) in _KINDS.items()},
    "GPL-1.0~old-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
    "GPL-2.0~old-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version.",
    "GPL-3.0~old-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 3, or (at your option) any later version.",
    "MIT-0~permission": TEMPLATES["MIT-permission"].replace(" subject to the following conditions:", "") + " THE SOFTWARE IS PROVIDED \"AS IS\"",
    "NCSA~permission": TEMPLATES["MIT-permission"].replace("deal in the", "deal with the"),
    "ECL-2.0~notice": TEMPLATES["Apache-2.0-notice"].replace("Apache License", "Educational Community License"),
}
_FAMILY = {"Apache-2.0-notice": "Apache-2.0", "GPL-3.0-notice": "GPL-3.0", "MIT-permission": "MIT", "CC-BY-4.0-statement": "CC-BY-4.0",
           "MPL-2.0-notice": "MPL-2.0"}
_LONE = {"GPL": "gnu general public license", "AGPL": "gnu affero general public license", "LGPL": "gnu lesser general public license"}


def license_of(name: str) -> str:
    return _FAMILY.get(name, name.split("~")[0])


def reported(name: str) -> str:
    """Names of texts as in ``TEMPLATES``: a GNU notice says so, whichever of its forms it is."""
    base, _, text = name.partition("~")
    if name == "CC-BY-4.0~attribution":
        return "CC-BY-4.0-statement"
    return f"{base}-notice" if "GPL-" in base and (text == "notice" or text.startswith(("only", "old"))) else base


def deciding(name: str) -> list[str]:
    """Phrases (words joined by blanks, five at most) without which a text doesn't state this license."""
    if name in TEXTS:  # a short one needs all its shingles
        return DECIDE.get(name) or [TEXTS[name]]
    lic = license_of(name)
    kind, _, version = lic.partition("-")
    if kind in _LONE:
        phrase = "gnu library general public license" if lic == "LGPL-2.0" else _LONE[kind]
        return [phrase, f"version {version.removesuffix('.0').replace('.', ' ')}"]
    return {"Apache-2.0": ["apache license version 2"], "ECL-2.0": ["educational community license version 2"],
            "MPL-2.0": ["mozilla public license v 2"], "CC-BY-4.0": ["creative commons attribution 4 0"],
            "MIT": ["mit license"] if name == "MIT" else ["to deal in the software", "do so subject to the"],
            "MIT-0": ["to deal in the software", "do so the software"], "NCSA": ["to deal with the software"],
            "BSD-redistribution": ["source and binary forms"]}.get(lic, [])


_random = np.random.default_rng(77)
_XOR = _random.integers(1, 2**63, BANDS, dtype=np.uint64)
_MUL = _random.integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)


def _whole(hashes: np.ndarray) -> np.uint64:
    return mix((hashes * _ODD[:len(hashes)]).sum(dtype=np.uint64)[None] + mix(np.array([len(hashes)], np.uint64)))[0]


class Templates:
    """Shingle sets, band values, window sizes and deciding shingles of the templates."""

    def __init__(self, texts: dict[str, str]):
        self.names, self.sets, self.words, self.length, self.decide = [], [], [], [], []
        for name in sorted(texts):
            data = np.frombuffer(texts[name].encode(), np.uint8)
            words = Words(data, np.array([0, len(data)]), ALNUM, LOWER)
            if len(words.hash):
                n = min(SHINGLE, len(words.hash))
                self.names.append(name)
                self.words.append(n)
                self.length.append(len(words.hash))
                order = words.windows(SHINGLE)[1] if n == SHINGLE else np.array([_whole(words.hash)], np.uint64)
                self.sets.append(np.unique(order))
                self.decide.append(self._deciding(name, words.hash, order, n))
        #: (shingle size, set size) -> per band, its minhashes in order and the template of each.
        self.tables = {}
        for kind in sorted({(n, len(s)) for n, s in zip(self.words, self.sets)}):
            members = np.array([i for i, (n, s) in enumerate(zip(self.words, self.sets)) if (n, len(s)) == kind])
            values = np.stack([self.band(self.sets[i]) for i in members])
            self.tables[kind] = [(values[order, b], members[order]) for b in range(BANDS) for order in [np.argsort(values[:, b], kind="stable")]]
        #: All shingles of the templates of a size, so that texts are searched once.
        self.every = {n: np.unique(np.concatenate([s for s, k in zip(self.sets, self.words) if k == n])) for n in set(self.words)}

    @staticmethod
    def _deciding(name: str, words: np.ndarray, order: np.ndarray, size: int) -> list[np.ndarray]:
        """Per deciding phrase, the template's shingles that hold it whole."""
        out = []
        for phrase in deciding(name):
            data = np.frombuffer(phrase.encode(), np.uint8)
            part = Words(data, np.array([0, len(data)]), ALNUM, LOWER).hash
            at = [i for i in range(len(words) - len(part) + 1) if (words[i:i + len(part)] == part).all()]
            if len(part) > size:  # a longer phrase: each of its shingles
                out += [np.array([h], np.uint64) for i in at for h in order[i:i + len(part) - size + 1]]
                continue
            shingles = [order[k] for i in at for k in range(max(0, i + len(part) - size), min(i, len(order) - 1) + 1)]
            if not shingles:
                raise ValueError(f"{name}: no shingle of the template holds '{phrase}'")
            out.append(np.unique(np.array(shingles, np.uint64)))
        return out

    @staticmethod
    def band(hashes: np.ndarray) -> np.ndarray:
        return ((hashes[:, None] ^ _XOR) * _MUL).min(0)

    def _windows(self, words: Words):
        """(template, row, first shingle, shingles of the window, containment), each of three quarters containment."""
        out = []
        texts: dict[int, tuple] = {}
        for (size, t), table in self.tables.items():
            if size not in texts:
                texts[size] = self._shingles(words, size)
            hashes, some, doc, begin, count = texts[size]
            if not len(some):
                continue
            step, width = max(1, t // 2), t + -(-t // 2)
            own = some - begin[doc[some]]  # the windows that hold a shingle of any template
            starts = (own // step)[:, None] - np.arange(-(-width // step) + 1)[None, :]
            held = (starts >= 0) & (starts * step + width > own[:, None])
            windows = np.unique(np.stack([np.repeat(doc[some], held.sum(1)), starts[held] * step], 1), axis=0)
            first = begin[windows[:, 0]] + windows[:, 1]
            end = np.minimum(first + width, begin[windows[:, 0]] + count[windows[:, 0]])
            for w, i in self._met(hashes, first, end, table):
                shingles, wanted = hashes[first[w]:end[w]], self.sets[i]
                inside = int(np.isin(wanted, shingles).sum())
                if 100 * inside >= CONTAINED * t:
                    out.append((i, int(windows[w, 0]), int(windows[w, 1]), shingles, inside / t))
        return sorted(out, key=lambda m: m[:3])

    def _shingles(self, words: Words, size: int) -> tuple:
        """Hashes of all shingles of the size, those that some template has, their documents, and each document's first and count."""
        if size == SHINGLE:
            at, hashes = words.windows(SHINGLE)
        else:  # a template of fewer words: its word sequence anywhere
            at, hashes = words.windows(size)
            total = np.zeros(len(at), np.uint64)
            for k in range(size):
                total += words.hash[at + k] * _ODD[k]
            hashes = mix(total + mix(np.array([size], np.uint64)))
        every = self.every[size]
        some = np.flatnonzero(every[np.minimum(np.searchsorted(every, hashes), len(every) - 1)] == hashes)
        doc = words.doc[at]
        rows = np.arange(len(words.count))
        begin = np.searchsorted(doc, rows)
        return hashes, some, doc, begin, np.searchsorted(doc, rows, "right") - begin

    @staticmethod
    def _met(hashes: np.ndarray, first: np.ndarray, end: np.ndarray, table: list) -> list[tuple[int, int]]:
        """(window, template) pairs that share the minhash of a band."""
        size = end - first
        place = np.cumsum(size) - size
        flat = hashes[np.repeat(first - place, size) + np.arange(size.sum())]
        met = []
        for xor, mul, (values, members) in zip(_XOR, _MUL, table):
            low = np.minimum.reduceat((flat ^ xor) * mul, place)
            left, right = np.searchsorted(values, low), np.searchsorted(values, low, "right")
            n = right - left
            w = np.repeat(np.arange(len(low)), n)
            met.append(np.stack([w, members[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + left[w]]], 1))
        return np.unique(np.concatenate(met), axis=0).tolist()

    def find(self, words: Words) -> list[tuple[int, str, int, int, float]]:
        """(row, license, first word, words, containment): windows that contain a template, the best of each run of windows."""
        out = []
        best: dict[tuple, tuple] = {}
        for i, d, s, shingles, share in self._windows(words):
            held = np.flatnonzero(np.isin(shingles, self.sets[i]))
            first, end = s + int(held[0]), s + int(held[-1]) + self.words[i]
            found = (d, self.names[i], first, end - first, share)
            before = best.get((i, d))
            if before is not None and before[2] + before[3] > first:
                best[i, d] = max(before, found, key=lambda m: m[4])
            else:
                if before is not None:
                    out.append(before)
                best[i, d] = found
        return sorted([*out, *best.values()])

    def _claim(self, i: int, s: int, shingles: np.ndarray, free: np.ndarray | None):
        """What template ``i`` holds of a window: (-containment, -words of the template, words, first word), the
        shortest run of words with all shingles held; None below three quarters or without a deciding phrase."""
        wanted, size = self.sets[i], self.words[i]
        place = np.minimum(np.searchsorted(wanted, shingles), len(wanted) - 1)
        held = wanted[place] == shingles
        if free is not None:
            held &= np.lib.stride_tricks.sliding_window_view(free, size).all(1)
        at = np.flatnonzero(held)
        kinds = place[at]
        n = len(np.unique(kinds))
        if 100 * n < CONTAINED * len(wanted) or not all(np.isin(wanted[kinds], d).any() for d in self.decide[i]):
            return None
        seen: dict[int, int] = {}
        left, run = 0, (len(shingles) + size, 0)
        for right, k in enumerate(kinds.tolist()):
            seen[k] = seen.get(k, 0) + 1
            while seen[int(kinds[left])] > 1:
                seen[int(kinds[left])] -= 1
                left += 1
            if len(seen) == n:
                run = min(run, (int(at[right] - at[left]) + size, s + int(at[left])))
        return -n / len(wanted), -self.length[i], *run

    def stated(self, words: Words) -> list[tuple[int, str, int, int, float]]:
        """As ``find``, but rival licenses share no words: the template held best takes its run first."""
        out = []
        rows: dict[int, list] = {}
        for i, d, s, shingles, _ in self._windows(words):
            rows.setdefault(d, []).append((i, s, shingles))
        for d, windows in rows.items():
            owner = np.full(int(words.count[d]), -1, np.int64)  # license of every word given away
            known: dict[str, int] = {}
            mine: dict[int, np.ndarray] = {}  # words given to a template
            heap = [(c, k) for k, w in enumerate(windows) if (c := self._claim(*w, None))]
            heapq.heapify(heap)
            while heap:
                claim, k = heapq.heappop(heap)
                i, s, shingles = windows[k]
                who = known.setdefault(license_of(self.names[i]), len(known))
                part = slice(s, s + len(shingles) + self.words[i] - 1)
                free = (owner[part] == -1) | (owner[part] == who)
                if i in mine:
                    free &= ~mine[i][part]
                now = self._claim(i, s, shingles, free)
                if now is None:
                    continue
                if now != claim:  # less is left of it; it waits for its turn
                    heapq.heappush(heap, (now, k))
                    continue
                share, _, n, first = claim
                owner[first:first + n] = who
                mine.setdefault(i, np.zeros(len(owner), bool))[first:first + n] = True
                out.append((d, self.names[i], first, n, -share))
        return sorted(out)


_FOUND = "array<struct<license:string,start:int,words:int,containment:double>>"


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, matches: every template of three quarters containment."""
    return _scanned(docs, TEMPLATES if templates is None else templates, Templates.find)


def license_statements(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, matches: the licenses stated, rivals decided by name, version and containment."""
    return _scanned(docs, {**TEMPLATES, **SIBLINGS, **TEXTS} if templates is None else templates, Templates.stated)


def _scanned(docs: DataFrame, templates: dict[str, str], find) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(Templates(templates))  # a fixed parameter
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("words", pa.int32()), ("containment", pa.float64())]))

    def scan(batches):
        for batch in batches:
            for rows, data, offsets in text_chunks(batch):
                words = Words(data, offsets, ALNUM, LOWER)
                found: list = [[] for _ in range(rows.num_rows)]
                for d, name, start, n, share in find(known.value, words):
                    found[d].append({"license": reported(name), "start": start, "words": n, "containment": share})
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words.count.astype(np.int64)), pa.array(found, kind)],
                                                 ["doc_id", "n_words", "matches"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_words long, matches " + _FOUND)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Which licenses every document states: doc_id, n_words, n_licenses, licenses (sorted, comma-joined)."""
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return license_statements(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))
