"""License scans: fuzzy search for short notices, whole texts, at most `edits` insertions, deletions and changes.

Pigeonhole: a notice that occurs with at most k edits has, cut into k + 1 parts, at least one part unharmed. The parts
of all notices are found by one automaton; a hit of a part names the stretch of text in which the notice may lie, and
there the regex library matches the whole notice with bounded errors. Stretches of the same notice that overlap are
searched as one. Case doesn't matter, and runs of white space count as one space.

A span is reported as the best match by fewest edits, then leftmost, and what its stretch holds before and after it is
searched in the same way. Of spans that overlap, those of the fewest edits, then the longest, then of the first notice stay.
Defined results: null and empty texts hold nothing; texts of any length are searched whole, a text a time; rows that
repeat are each searched; a null doc_id stays null; other columns are not looked at, whatever their names; an empty table
gives an empty result."""

from __future__ import annotations

import re
from bisect import bisect

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._shared import doc_columns

#: license, notice
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL", "GNU Lesser General Public License"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification"),
    ("BSD", "licensed under the BSD License"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("Proprietary", "All rights reserved"),
)
EDITS_PER = 12  # an edit for so many characters of a notice
SPACE = re.compile(r"\s+")


def fold(text: str) -> str:
    """Lower case of the same length: a character whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(y if len(y := x.lower()) == 1 else x for x in text)


class Scanner:
    def __init__(self, notices=NOTICES, edits_per: int = EDITS_PER):
        import ahocorasick

        self.notices = []
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (license_id, notice) in enumerate(notices):
            plain = SPACE.sub(" ", fold(notice.strip()))
            k = len(plain) // edits_per
            self.notices.append((license_id, notice, plain, k, regex.compile(f"(?b)(?:{regex.escape(plain, special_only=True)}){{e<={k}}}")))
            cuts = [len(plain) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(plain[a:b], []).append((i, a))
        for s, where in seeds.items():
            self.automaton.add_word(s, (len(s), where))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, str, int, int, int]]:
        """license, notice, start, end, edits of each span, by place."""
        low, at = fold(text), None
        if gaps := [m for m in SPACE.finditer(low) if m.group() != " "]:
            # places in the text for each character of the folded one
            parts, at, last = [], [], 0
            for m in gaps:
                parts += [low[last : m.start()], " "]
                at += range(last, m.start() + 1)
                last = m.end()
            parts.append(low[last:])
            at += range(last, len(low) + 1)
            low = "".join(parts)
        stretches: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(low):
            for i, offset in where:
                _, _, plain, k, _ = self.notices[i]
                a = max(0, end + 1 - size - offset - k)
                b = min(len(low), end + 1 - size - offset + len(plain) + k)
                own = stretches.setdefault(i, [])
                own.append([a, b])
        out = []
        for i, own in sorted(stretches.items()):
            license_id, notice, plain, k, pattern = self.notices[i]
            own.sort()
            joined = [own[0]]
            for a, b in own[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            while joined:
                a, b = joined.pop()
                if b - a >= len(plain) - k and (m := pattern.search(low, a, b)):
                    s, e = m.span()
                    out.append((license_id, notice, at[s] if at else s, (at[e - 1] + 1 if at else e), sum(m.fuzzy_counts)))
                    joined += [[a, s], [e, b]]
        kept: list[tuple[str, str, int, int, int]] = []  # by place, and apart, so only neighbours can overlap
        for x in sorted(out, key=lambda x: (x[4], x[2] - x[3])):
            i = bisect(kept, x[2], key=lambda y: y[2])
            if (i == 0 or kept[i - 1][3] <= x[2]) and (i == len(kept) or x[3] <= kept[i][2]):
                kept.insert(i, x)
        return kept


_made: dict = {}


def scan(docs: DataFrame, notices=NOTICES, edits_per: int = EDITS_PER) -> DataFrame:
    """doc_id, license, notice, span_start, span_end (characters of the text), edits."""

    def run(batches):
        key = (notices, edits_per)
        if key not in _made:
            _made[key] = Scanner(notices, edits_per)
        s = _made[key]
        for b in batches:
            rows = [(d, *x) for d, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True) if (t := text.as_py()) for x in s.scan(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "notice", "span_start", "span_end", "edits"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, license string, notice string, span_start long, span_end long, edits long")
