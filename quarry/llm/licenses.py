"""License scans by conditional compression.

A candidate block is REACH words on both sides of a cue, over line ends;
overlapping blocks join.  Around each cue of a block a window of each wording's
length and some slack is compressed alone and with the wording as a raw zstandard
dictionary.  The bytes saved, against those of the wording compressed alone, rank the
wordings; those that save SAVED of themselves or more are the winners, and each is
confirmed by an exact word difference: a license counts where MATCHED of the wording's
words stand together in the window in their order, with its key words among them.
Its gain is the share of the window's bytes that the wording saves.

Conditions that licenses share are read as what tells them apart: the BSD conditions
are those of BSD-3-Clause with the third one in the text (or with the first line
alone), else of BSD-2-Clause.

Defined results: null, empty and cue-less texts give no row; a license is
reported once a document, with its number of blocks and best figures; rows with a null id are reported with it;
repeated rows are reported each; other columns are not read.  One scan, no
shuffle; templates are a fixed list; memory is bounded by one text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged, work

# Between the words of a cue a line may end and a comment go on.
CUES = r"licen[sc]e|gplv[23]|neither the name|redistributions in binary|express or implied|copyright|all rights reserved|creative commons|public domain|permission is hereby|redistribution and use|permission to use|without warranty|\bcc[ -](?:by|0)|\bcc0".replace("[ -]", " ").replace(" ", r"[\s#*/;-]+")
REACH = 60
MATCHED = 0.8
#: Least share of a wording's own compressed bytes that it saves of a window around a notice.
SAVED = 0.12
TUNED = {"strategy": zstandard.STRATEGY_BTULTRA, "window_log": 12, "hash_log": 10, "chain_log": 11, "search_log": 5, "min_match": 3, "target_length": 64}

# Public wordings of licenses, each with the key words that tell it from its neighbours.
TEMPLATES: dict[str, tuple[list[str], str]] = {
    "Apache-2.0": (["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Released under the Apache 2.0 license", "Apache License Version 2.0, January 2004"], r"apache.*2"),
    "BSD-3-Clause": (["Released under the BSD 3-Clause License"], r"bsd 3|bsd-3"),
    "bsd-conditions": (["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"], r"redistribution and use"),
    "bsd-second-condition": (["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"], r"redistributions in binary"),
    "bsd-third-condition": (["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"], r"neither the name"),
    "BSL-1.0": (["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"], r"boost software license"),
    "EPL-2.0": (["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0"], r"eclipse public license.*2"),
    "Zlib": (["Released under the zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"], r"\bzlib\b|provided as-is"),
    "CC-BY-4.0": (["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"], r"(cc by|attribution) 4"),
    "CC-BY-NC-4.0": (["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"], r"by-nc 4|attribution-noncommercial 4"),
    "CC-BY-SA-4.0": (["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"], r"by-sa 4|attribution-sharealike 4"),
    "CC0-1.0": (["Released under CC0 1.0", "To the extent possible under law, the author has dedicated this work to the public domain"], r"cc0|public domain"),
    "GPL-2.0": (["This work is licensed under the GNU General Public License, version 2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "Licensed under the GPLv2", "under the terms of version 2 of the GNU General Public License", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"], r"(?<!lesser )(?<!affero )general public license.*2|version 2 of the gnu general public|\bgplv2"),
    "GPL-3.0": (["This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "Licensed under the GPLv3", "under the terms of version 3 of the GNU General Public License", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"], r"(?<!lesser )(?<!affero )general public license.*3|version 3 of the gnu general public|\bgplv3"),
    "MIT": (["Released under the MIT License", "Licensed under the MIT License", "distributed under the terms of the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"], r"\bmit\b|permission is hereby granted"),
    "MPL-2.0": (["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"], r"mozilla public license"),
    "AGPL-3.0": (["This work is licensed under the GNU Affero General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"], r"affero general public license.*3"),
    "BSD-2-Clause": (["Released under the BSD 2-Clause License", "Licensed under the simplified BSD License"], r"bsd 2|simplified bsd"),
    "ISC": (["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"], r"\bisc\b|permission to use"),
    "LGPL-2.1": (["This work is licensed under the GNU Lesser General Public License, version 2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"], r"lesser general public license.*2\.1"),
    "LGPL-3.0": (["This work is licensed under the GNU Lesser General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"], r"lesser general public license.*3"),
    "Unlicense": (["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"], r"unencumbered"),
    "all-rights-reserved": (["All rights reserved", "Copyright. All rights reserved"], r"all rights reserved"),
}

# Identifiers in the tags of source files, beside the names above.
TAGS = {"GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "LGPL-2.1": ["LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0-only", "LGPL-3.0-or-later"]}
TAG = re.compile(r"spdx-license-identifier:\s*\(?\s*([a-z0-9.+-]+(?:\s+(?:or|and)\s+[a-z0-9.+-]+)*)", re.IGNORECASE)
BSD = ("bsd-conditions", "bsd-second-condition", "bsd-third-condition")


def tagged(text: str) -> set[str]:
    """Licenses of the known ones that the text's identifier tags name."""
    names = {n.lower(): n for n in TEMPLATES if n not in (*BSD, "all-rights-reserved")} | {t.lower(): n for n, tags in TAGS.items() for t in tags}
    said = {x.lower().rstrip("+.") for m in TAG.finditer(text) for x in re.split(r"\s+(?:or|and)\s+", m.group(1), flags=re.IGNORECASE)}
    return {names[x] for x in said if x in names}


def wording(text: str) -> list[str]:
    return [w for w in (x.strip("-./,;:()\"'“”!%&$#*|") for x in text.lower().split()) if w]


def cued(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of the words of a text, and the words at which cues start."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    starts = [a for a, _ in words]
    return words, sorted({max(0, bisect_right(starts, m.start()) - 1) for m in re.finditer(CUES, text, re.IGNORECASE)})


def blocks(text: str) -> list[str]:
    """Candidate blocks of a whole text, in order."""
    words, cues = cued(text)
    spans: list[list[int]] = []
    for k in cues:
        low, high = max(0, k - REACH), min(len(words), k + REACH)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    return [text[words[a][0] : words[b - 1][1]] for a, b in spans]


def slack(n: int) -> int:
    return 2 + n // 4


class Scanner:
    def __init__(self, templates: dict[str, tuple[list[str], str]] = TEMPLATES):
        # Notices are short: small tables, and matches of three bytes count.
        fine = zstandard.ZstdCompressionParameters(**TUNED, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(compression_params=fine)
        #: Of each wording: license, words, compressor with it as dictionary, its own compressed bytes.
        self.wordings = []
        for name, (texts, _) in templates.items():
            for t in texts:
                data = zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(compression_params=fine)
                self.wordings.append((name, wording(t), zstandard.ZstdCompressor(dict_data=data, compression_params=fine), len(self.alone.compress(t.lower().encode()))))
        self.key = {name: re.compile(k, re.DOTALL) for name, (_, k) in templates.items()}

    def ranked(self, windows: dict[int, str]) -> list[tuple[float, int, float]]:
        """(share of its own bytes saved, wording, share of the window's bytes saved), best first; windows: a window for each length of wordings."""
        sizes = {n: (w.lower().encode(), len(self.alone.compress(w.lower().encode()))) for n, w in windows.items()}
        out = []
        for i, (_, words, given, own) in enumerate(self.wordings):
            data, alone = sizes[len(words)]
            saved = alone - len(given.compress(data))
            out.append((saved / own, i, saved / alone))
        return sorted(out, reverse=True)

    def confirm(self, window: str, i: int) -> int | None:
        """Words of a wording that the window lacks, if MATCHED of them are there in order."""
        name, t, _, _ = self.wordings[i]
        words = wording(window)
        if not self.key[name].search(" ".join(words)):
            return None
        known, lacking = set(t), []
        size = len(t) + 2 * slack(len(t))
        before = [0, *accumulate(w in known for w in words)]
        for start in range(max(1, len(words) - size + 1)):
            # Parts with too few of the wording's words are no notices in any order.
            if before[min(start + size, len(words))] - before[start] < MATCHED * len(t):
                continue
            part = words[start : start + size]
            same = [m for m in SequenceMatcher(None, t, part, autojunk=False).get_matching_blocks() if m.size]
            # A single word far from the rest at an end is a chance match, as of another number.
            while len(same) > 1 and same[-1].size == 1 and same[-1].b - same[-2].b - same[-2].size > 2:
                same.pop()
            while len(same) > 1 and same[0].size == 1 and same[1].b - same[0].b > 3:
                same.pop(0)
            n = sum(m.size for m in same)
            # The key words stand in the notice, the word after it included where a version is written otherwise.
            if n >= MATCHED * len(t) and self.key[name].search(" ".join(part[same[0].b : same[-1].b + same[-1].size + 1])):
                lacking.append(len(t) - n)
        return min(lacking) if lacking else None

    def winners(self, block: str, least: float = SAVED) -> dict[str, tuple[float, int]]:
        """license: (best gain, fewest lacking words) of a block."""
        words, cues = cued(block)
        best: dict[str, tuple[float, int]] = {}
        for k in cues:
            windows = {}
            for n in {len(w) for _, w, _, _ in self.wordings}:
                reach = n + slack(n)
                windows[n] = block[words[max(0, k - reach)][0] : words[min(len(words), k + reach) - 1][1]]
            for share, i, gain in self.ranked(windows):
                if share < least:
                    break
                name, t, _, _ = self.wordings[i]
                lacking = self.confirm(windows[len(t)], i)
                if lacking is not None:
                    old = best.get(name, (-1.0, 1 << 30))
                    best[name] = (max(gain, old[0]), min(lacking, old[1]))
        return best

    def scan(self, text: str, least: float = SAVED) -> list[tuple[str, int, float, int]]:
        """(license, blocks, best gain, fewest lacking words) of a text, by name."""
        found: dict[str, tuple[int, float, int]] = {}
        for block in blocks(text):
            for name, (gain, lacking) in self.winners(block, least).items():
                n, g, w = found.get(name, (0, -1.0, 1 << 30))
                found[name] = (n + 1, max(g, gain), min(w, lacking))
        conditions = {name: found.pop(name) for name in BSD if name in found}
        if conditions:
            first, second, third = (name in conditions for name in BSD)
            name = "BSD-2-Clause" if second and not third else "BSD-3-Clause"
            if first or third:
                rows = [*conditions.values(), *([found[name]] if name in found else [])]
                found[name] = (max(r[0] for r in rows), max(r[1] for r in rows), min(r[2] for r in rows))
        for name in tagged(text):
            found.setdefault(name, (1, 0.0, 0))
        return [(name, *found[name]) for name in sorted(found)]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, license, n_blocks, gain, lacking_words for each license of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for piece in ragged.pieces(batch, limit=4_000_000):
                texts = piece.column("text")
                hit = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, CUES, ignore_case=True), False))
                rows = [(i, *found) for i in hit.to_pylist() for found in scanner.scan(texts[i].as_py())]
                if rows:
                    at, name, n, gain, lacking = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id").take(pa.array(at)), pa.array(name), pa.array(n, pa.int64()), pa.array(gain), pa.array(lacking, pa.int64())],
                        ["doc_id", "license", "n_blocks", "gain", "lacking_words"],
                    )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return work.map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, license string, n_blocks long, gain double, lacking_words long")
