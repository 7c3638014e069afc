"""License scan by conditional compression.

Windows of words that share enough words with a template are candidates; white space and
line breaks don't count, so a notice may be wrapped, and a line may hold several. Every
candidate is compressed with each template as a zstandard raw dictionary, and templates are
ranked by the bytes that they save. Down this ranking the candidate is aligned with the
template: which words it lacks and which it has beyond it. The first with few enough
differences, none of them in a word that names another license, is confirmed.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, lower_codes, text_bytes, word_bounds, word_hashes
from .decontaminate import plain_words, slices

#: Wording of common notices, a line each.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "all-rights-reserved": ["All rights reserved."],
}
#: A window is a candidate if so large a share of a template's distinct words is in it, and confirmed if so few words differ.
SHARED, DIFFERENT = 0.6, 0.25
#: Words that tell licenses apart, besides numbers. None of them may be missing or added.
TELLING = set("mit apache gnu affero lesser library mozilla cc cc0 nc nd sa noncommercial noderivatives noderivs sharealike bsd".split())
SLICE_BYTES = 2 << 20
LEVEL = 19

#: Words are runs of ASCII letters, digits and bytes beyond ASCII.
WORDS = ALNUM.copy()
WORDS[0x41:0x5B] = True
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
FOUND = "array<struct<line:int,license:string,saved:int,exact:boolean,missing:array<string>,added:array<string>>>"
RESULT = f"doc_id long, n_lines long, n_candidates long, licenses array<string>, found {FOUND}"
FOUND_ARROW = pa.list_(pa.struct([("line", pa.int32()), ("license", pa.string()), ("saved", pa.int32()), ("exact", pa.bool_()),
                                  ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]))


def spoken(text: str) -> list[str]:
    return WORD.findall(text.lower())


def wording(template: list[str], words: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of the template that the best-matching part of the words lacks, words put between them,
    and where that part begins and ends. What stands around it is not the notice's."""
    missing, added, first, last = [], [], len(words), 0
    steps = difflib.SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
    for k, (what, a, b, c, d) in enumerate(steps):
        if what == "equal":
            first, last = min(first, c), d
        else:
            missing += template[a:b]
            if 0 < k < len(steps) - 1:
                added += words[c:d]
    return missing, added, first, last


class Scanner:
    """Templates as raw dictionaries."""

    def __init__(self, templates: list[tuple[str, str]]):
        import zstandard
        self.names = [(name, spoken(line)) for name, line in templates]
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.given = []
        for _, line in templates:
            own = zstandard.ZstdCompressionDict(line.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.given.append(zstandard.ZstdCompressor(dict_data=own))

    def savings(self, text: str) -> list[int]:
        """Bytes that each template saves on a text."""
        raw = " ".join(text.lower().split()).encode()
        alone = len(self.plain.compress(raw))
        return [alone - len(c.compress(raw)) for c in self.given]

    def confirmed(self, text: str) -> tuple | None:
        """The first template that wording confirms, of those that save bytes on the text, the largest
        saving first (ties: the longer template, then the name): (saving, template, missing, added, first, last)."""
        gains, words = self.savings(text), spoken(text)
        for k in sorted(range(len(gains)), key=lambda k: (-gains[k], -len(self.names[k][1]), self.names[k][0], k)):
            if gains[k] <= 0:
                return None
            own = self.names[k][1]
            if len(own) - len(words) > DIFFERENT * len(own):
                continue
            missing, added, first, last = wording(own, words)
            if len(missing) + len(added) <= DIFFERENT * len(own) and not any(w in TELLING or w.isdigit() for w in missing + added):
                return gains[k], k, missing, added, first, last
        return None

    def notices(self, windows: list[tuple[int, int, int]], read) -> list[dict]:
        """Non-overlapping confirmed notices of a text. ``windows``: template that they are like, first
        word, end; ``read(i, j)``: the text of the words i to j."""
        found: dict[int, list] = {}
        for at, end in sorted({w[1:] for w in windows}):
            best = self.confirmed(read(at, end))
            if best is not None:
                _, k, missing, added, first, last = best
                gain = self.savings(read(at + first, at + last))[k]
                if gain > 0:
                    found.setdefault(k, []).append(((len(missing) + len(added)) / len(self.names[k][1]), -gain, at + first, at + last, missing, added))
        # of one template's overlapping places the closest in wording, then of all templates' the larger saving
        places = [(gain, far, -len(self.names[k][1]), self.names[k][0], first, end, missing, added)
                  for k, own in found.items() for far, gain, first, end, missing, added in apart(sorted(own), 2)]
        return sorted(({"first": first, "end": end, "license": name, "saved": -gain, "exact": not missing and not added, "missing": missing, "added": added}
                       for gain, _, _, name, first, end, missing, added in apart(sorted(places), 4)), key=lambda o: o["first"])


def apart(places: list[tuple], at: int) -> list[tuple]:
    """The places, best first, that overlap no better one; items ``at`` and the next are a place's first word and end."""
    starts, ends, out = [], [], []
    for x in places:
        k = bisect_right(starts, x[at])
        if (k == 0 or ends[k - 1] <= x[at]) and (k == len(starts) or x[at + 1] <= starts[k]):
            starts.insert(k, x[at])
            ends.insert(k, x[at + 1])
            out.append(x)
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """License notices in every text, wherever its lines break.

    Returns one row per input row: doc_id, n_lines, n_candidates (places where windows are like a
    template), licenses (distinct, sorted) and found, every notice that overlaps no better one: line
    number of its first word (from 0), license, bytes saved, exact (same words in the same
    order), missing and added words. Of overlapping ones of a template the closest in wording wins, of different
    templates the larger saving, then the closer wording, the longer template, the name. A null or empty text has no lines. Repeated rows give equal
    rows. An empty table gives no rows. Other columns are not read."""
    every = [(name, line) for name, lines in templates.items() for line in lines if spoken(line)]
    codes, off = plain_words(*text_bytes(pa.array([line for _, line in every], pa.large_string())))
    vocabulary = np.unique(codes)
    own_codes = [codes[a:b] for a, b in zip(off, off[1:])]
    owns = np.zeros((len(every), len(vocabulary)), bool)
    for k, own in enumerate(own_codes):
        owns[k, np.searchsorted(vocabulary, own)] = True
    need = np.ceil(SHARED * owns.sum(1))
    # a confirmed notice lacks at most ``slack`` words and has at most so many more
    slack = [int(DIFFERENT * len(own)) for own in own_codes]

    def windows(words, woff):
        """By text: (template, first word, end) of every window that holds enough words of a template."""
        at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
        known = np.flatnonzero(vocabulary[at] == words) if len(vocabulary) else np.zeros(0, np.int64)
        kind, end = at[known], woff[np.searchsorted(woff, known, "right")]
        out: dict[int, list] = {}
        for k, own in enumerate(own_codes):
            mine = owns[k][kind]
            first, kinds = known[mine], kind[mine]
            stop = np.minimum(first + len(own) + slack[k], end[mine])
            held = np.searchsorted(first, stop) - np.arange(len(first))
            for i in np.flatnonzero(held >= len(own) - slack[k]).tolist():
                if len(np.unique(kinds[i:i + held[i]])) >= need[k]:
                    a, b = int(first[i]), int(stop[i])
                    doc = int(np.searchsorted(woff, a, "right")) - 1
                    out.setdefault(doc, []).append((k, a, b))
        return out

    def run(batches):
        scanner = Scanner(every)
        for batch in batches:
            buf, doc_off = text_bytes(batch.column(1))
            for lo, hi in slices(doc_off, SLICE_BYTES):
                part, poff = buf[doc_off[lo]:doc_off[hi]], doc_off[lo:hi + 1] - doc_off[lo]
                feeds = np.concatenate([[0], np.cumsum(part == 0x0A)])
                # a line ends behind its line feed or with its text
                n_lines = feeds[poff[1:]] - feeds[poff[:-1]]
                full = np.flatnonzero(np.diff(poff))
                n_lines[full] += part[poff[full + 1] - 1] != 0x0A
                starts, ends, woff = word_bounds(part, poff, WORDS)
                like = windows(word_hashes(part, starts, ends, lower_codes()), woff)
                found, candidates = {}, np.zeros(hi - lo, np.int64)
                for doc, seen in like.items():
                    reach = -1
                    for _, a, b in sorted(seen, key=lambda x: x[1:3]):
                        candidates[doc] += a >= reach
                        reach = max(reach, b)
                    found[doc] = [{"line": int(feeds[starts[o.pop("first")]] - feeds[poff[doc]]), **o}
                                  for o in scanner.notices(seen, lambda i, j: part[starts[i]:ends[j - 1]].tobytes().decode("utf-8", "replace"))]
                cell = [[{f: v for f, v in o.items() if f != "end"} for o in found.get(k, [])] for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(n_lines.astype(np.int64)), pa.array(candidates),
                    pa.array([sorted({f["license"] for f in c}) for c in cell], pa.list_(pa.string())), pa.array(cell, FOUND_ARROW)],
                    names=["doc_id", "n_lines", "n_candidates", "licenses", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)
