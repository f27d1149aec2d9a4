"""Token counts, toxicity, decontamination, license scans, mixing and the pipeline."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontam, licenses, mixing, queries, tokens, toxicity, weights
from test_dedup import classes

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")

# ---- token counts


def odd_texts(n=1500):
    r = random.Random(3)
    parts = ["a", "b", "e", "the", "▁", " ", "  ", "\n", "\t", "\r", "é", "季", "😀", "}", "{", "1", "ing", "</s>", "<0x41>", "　", " ", " the", " of", "%%%", "\x00"]
    fixed = ["", None, " ", "  ", "\n", "a\n", "\n\na", "x" * 5000, "ab" * 3000, " " * 300, "e e  e"]
    return fixed + ["".join(r.choice(parts) for _ in range(r.randint(1, 120))) for _ in range(n)]


def test_tokens_equal_the_library(spark):
    texts = odd_texts()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a", 0), (0, "", 0)], "doc_id long, text string, n_tokens int")
    got = tokens.count(df, MODEL, limit=40).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = "a" if r.doc_id is None else texts[r.doc_id] or ""
        n = len(sp.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 40)
    assert tokens.count(df.limit(0), MODEL).count() == 0


def test_merges_one_by_one_equal_merges_together():
    m = tokens.Merger(MODEL)
    words = [t for t in odd_texts(300) if t]
    assert m.together(words).tolist() == [m.one_by_one(w) for w in words]


# ---- toxicity


def test_gradients():
    r = np.random.default_rng(0)
    n = toxicity.Network.start(np.zeros(toxicity.WORD_BUCKETS, np.float32), np.zeros(toxicity.CHAR_BUCKETS, np.float32))
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    x = r.standard_normal((11, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    x[-1] = 0
    codes = r.integers(0, 10, (3, toxicity.WINDOW))
    codes[2, 20:] = 10  # padding
    _, kept = n.forward(x, codes, keep=True)
    w = r.standard_normal(3)
    g, dx = n.gradients(x, codes, kept, w)
    f = lambda: n.forward(x, codes)[0] @ w
    for array, grad in [*((n.p[k], g[k]) for k in ("wx", "wh", "b", "attend", "out", "bias")), (x, dx)]:
        i = tuple(r.integers(0, s) for s in array.shape) if array is not x else (4, 2)
        array[i] += 1e-3
        up = f()
        array[i] -= 2e-3
        down = f()
        array[i] += 1e-3
        assert abs((up - down) / 2e-3 - grad[i]) < 1e-3 * max(1, abs(grad[i]))


def test_windows_cover_every_word():
    sizes = [0, 1, 31, 32, 33, 56, 57, 500]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at, row = toxicity.windows(offsets)
    assert Counter(row.tolist()).keys() == set(range(len(sizes)))
    assert set(at[at >= 0].tolist()) == set(range(sum(sizes)))
    for k, r in enumerate(row):
        inside = at[k][at[k] >= 0]
        assert all(offsets[r] <= i < offsets[r + 1] for i in inside) and len(inside) == min(toxicity.WINDOW, sizes[r])


def labelled(n, seed):
    r = random.Random(seed)
    clean = [f"{a}{b}" for a in ("th", "re", "on", "st", "ble") for b in ("an", "er", "in", "ed", "ou", "ly")]
    rude = ["nasty", "vile", "rotten", "awful", "filthy"]
    texts, y = [], []
    for k in range(n):
        words = [r.choice(clean) for _ in range(r.randrange(20, 300))]
        if k % 4 == 0:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(rude))
        texts.append(" ".join(words))
        y.append(int(k % 4 == 0))
    return texts, np.array(y)


def test_network_on_held_out_rows(spark):
    texts, y = labelled(600, 1)
    model = toxicity.train(texts, y)
    more, z = labelled(300, 2)
    p = model.probability(model.score_texts(pa.array(more))) >= toxicity.THRESHOLD
    assert (p == z).mean() > 0.95
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([None, "", "vile", *more[:20]])] + [(None, "x", 0.5), (0, None, 0.5)], "doc_id long, text string, score double")
    got = toxicity.score(df, model).collect()
    assert len(got) == 25 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[0] == by[1] < by[2]
    kept = toxicity.accept(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score(df.limit(0), model).count() == 0


def test_training_in_a_task_equals_the_driver(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    here, there = toxicity.train(*toxicity.training_rows(docs, labels)), toxicity.fit(docs, labels)
    texts = pa.array([r.text for r in docs.limit(80).collect()])
    assert np.abs(here.probability(here.score_texts(texts)) - there.probability(there.score_texts(texts))).max() < 1e-3
    assert toxicity.fit(docs.limit(0), labels) == 0.5 and toxicity.fit(docs, labels.where("toxic = 1")) == 1.0


def test_training_rows_leave_out_held_out_ids(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(100)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    texts, y = toxicity.training_rows(docs, labels)
    seen = {f"text {i % 50}" for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(texts) == len(set(texts)) and set(texts) == seen and set(y) == {0.0, 1.0}
    assert toxicity.train([], np.array([])) == 0.5 and toxicity.train(["a"], np.array([1])) == 1.0


# ---- decontamination


def passages(n=30):
    r = random.Random(12)
    common = ["the", "of", "and", "to", "in", "is"]
    word = lambda: r.choice(common) if r.random() < 0.4 else f"v{r.randrange(3000)}"
    items = [" ".join(word() for _ in range(r.randrange(17, 60))) for _ in range(n)]
    docs = [" ".join(word() for _ in range(r.randrange(5, 300))) for _ in range(4 * n)]
    planted = {}
    for i, item in enumerate(items):
        words = item.split()
        if i % 3 == 1:  # a paraphrase: a tenth of the words differ
            for _ in range(len(words) // 10):
                words[r.randrange(len(words))] = f"z{i}"
        docs[i] = docs[i] + " " + " ".join(words).upper() + "\n" + docs[i + n]
        planted[i] = i
    return items, docs, planted


def test_leaks_and_paraphrases_are_found(spark):
    items, texts, planted = passages()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(900, None, 0), (901, "", 0), (None, items[0], 0), (0, texts[0], 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*enumerate(items), (900, None), (901, ""), (902, "one two three"), (None, items[1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.search(docs, bench).collect()}
    want = {(d, i) for d, i in planted.items()} | {(1, None), (None, 0)}
    assert got == want
    kept = decontam.accept(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(30, 120), 900, 901}
    assert decontam.search(docs.limit(0), bench).count() == 0 and decontam.search(docs, bench.limit(0)).count() == 0


def test_passage_sums_equal_plain_ones_in_less_time():
    r = np.random.default_rng(8)
    words = (r.zipf(1.3, 120_000) % 20_000).tolist()
    texts = ["", "a", "a a a a a a a", "b " * 12, *(" ".join(f"w{x}" for x in words[k : k + 300 + k % 7]) for k in range(0, len(words), 300))]
    h, offsets = decontam.ragged.hashed(pa.array(texts))
    weight = 1 + r.random(weights.BUCKETS).astype(np.float32)
    basis = r.standard_normal((decontam.TERMS, 56)).astype(np.float32)
    w, t = weight[weights.bucket(h)], decontam.term(h)
    first, stop, _ = decontam.passages(offsets)

    def plain():  # a vector for each word, added up by passage, then by term
        each = np.concatenate([np.zeros((1, 56)), np.cumsum(w[:, None] * basis[t], axis=0, dtype=np.float64)])
        square = np.concatenate([[0], np.cumsum(w.astype(np.float64) ** 2)])
        seen = (each[stop] - each[first]) / (square[stop] - square[first])[:, None]
        change = np.zeros((len(h) + 1, 56))
        np.add.at(change, first, seen)
        np.add.at(change, stop, -seen)
        total = np.zeros((decontam.TERMS, 56))
        np.add.at(total, t, w[:, None] * np.cumsum(change, axis=0)[:-1])
        return total

    def by_blocks():  # as it was: sums over blocks and terms by reduceat
        start, _ = decontam.blocks(offsets)
        sums = np.add.reduceat(w[:, None] * basis[t], start, axis=0)
        order = np.argsort(t, kind="stable")
        block = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))[order]
        np.add.reduceat(w[order][:, None] * sums[block], np.flatnonzero(np.diff(t[order], prepend=-1)), axis=0)

    total, table = np.zeros((weights.BUCKETS, 56), np.float32), decontam.word_vectors(weight, basis)
    decontam.add_passages(total, h, offsets, weight, table)
    want = plain()
    assert np.abs(decontam.folded(total, weight) - want).max() < 1e-5 * np.abs(want).max()

    def seconds(f):
        def once():
            began = time.process_time()
            f()
            return time.process_time() - began

        return min(once() for _ in range(5))

    assert seconds(lambda: decontam.add_passages(total, h, offsets, weight, table)) < 0.7 * seconds(by_blocks)


def test_common_subsequences():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.randrange(6) + 2 for _ in range(r.randrange(1, 13))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pad = lambda v, z: np.array([v + [z] * (12 - len(v))], dtype=np.uint64)
        assert decontam.lcs(np.array(a), np.array(b)) == table[-1][-1] == decontam.lcs_many(pad(a, 0), pad(b, 1))[0]


def test_candidates_against_brute_force():
    r = np.random.default_rng(0)
    basis = r.standard_normal((decontam.TERMS, decontam.RANK)).astype(np.float32)
    items, texts, _ = passages()
    idf = np.ones(decontam.weights.BUCKETS, dtype=np.float32)
    q = decontam.items(list(enumerate(items)), idf, basis)
    v = decontam.unit(q.vectors + 0.05 * r.standard_normal(q.vectors.shape).astype(np.float32)).astype(np.float32)
    found = set(zip(*map(lambda x: x.tolist(), decontam.candidates(v, q)), strict=True))
    brute = set(zip(*map(lambda x: x.tolist(), np.nonzero(v @ q.vectors.T >= decontam.MIN_COSINE)), strict=True))
    assert found <= brute and len(found) >= 0.9 * len(brute)


# ---- licenses


def test_licenses(spark):
    long = "word " * 500
    texts = [
        "Text here.\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "this work is licensed under the gnu general public license, version 2", long + "Licensed under CC BY-NC 4.0. " + long,
        "Licensed under CC BY 4.0.", "All rights reserved. Licensed under the Apache License, Version 2.0.", "We license nothing and copyright means little to us here.", "A driver license was renewed by the office in spring.", None, "", "no cue",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[4], "x")], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.license) for r in licenses.scan(df).collect()), key=str)
    want = [(0, "MIT"), (0, "MIT"), (1, "GPL-3.0"), (2, "GPL-2.0"), (3, "CC-BY-NC-4.0"), (4, "CC-BY-4.0"), (5, "Apache-2.0"), (5, "all-rights-reserved"), (None, "CC-BY-4.0")]
    assert got == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_blocks_keep_every_cue():
    text = "a " * 300 + "license one " + "b " * 300 + "copyright two " + "c " * 20 + "license three"
    found = licenses.blocks(text)
    assert len(found) == 2 and "license one" in found[0] and "copyright two" in found[1] and "license three" in found[1]


#: The wordings that name a license by themselves.
LICENSES = {name: t for name, t in licenses.TEMPLATES.items() if name not in licenses.BSD}


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randrange(2, 10))) for _ in range(n))


def test_notices_in_ordinary_prose():
    scanner = licenses.Scanner()
    for name, (wordings, _) in LICENSES.items():
        for n in (10, 40, 80, 200):
            for t in wordings:
                assert name in {x[0] for x in scanner.scan(f"{prose(n, n)} {t}. {prose(n, n + 1)}")}, (name, n, t)
    many = ["Released under a MIT License", "Licensed under the CC BY-SA 4.0", "Released under the BSD 3-clause licence", "Licensed under the Apache License, version v2.0", "All rights are reserved"]
    assert len(scanner.scan(". ".join(many))) >= 4


# The usual headers as they stand in files.
HEADERS = {
"MIT":"""Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software""",
"GPL-2.0":"""This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
"GPL-3.0":"""This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
"AGPL-3.0":"""This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
"LGPL-2.1":"""This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
"LGPL-3.0":"""This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
"BSD-3-Clause":"""Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice""",
"MPL-2.0":"""This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
"CC0-1.0":"""To the extent possible under law, the author(s) have dedicated all
copyright and related and neighboring rights to this software to the
public domain worldwide. CC0 1.0 Universal. Released under CC0 1.0""",
"ISC":"""Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
"Apache-2.0":"""Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
"Unlicense":"""This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose""",
}


def test_usual_headers_wrapped_indented_and_commented():
    scanner = licenses.Scanner()
    for name, header in HEADERS.items():
        for mark in ("", "   ", " * ", "# ", "// ", "-- "):
            text = "import os\n" + "\n".join(mark + line for line in header.split("\n")) + "\n\nint main() { return 0; }"
            assert [x[0] for x in scanner.scan(text)] == [name], (name, mark)


def test_wrapped_notices():
    import textwrap

    scanner = licenses.Scanner()
    for name, (wordings, _) in LICENSES.items():
        for t in wordings:
            for width, mark in ((76, ""), (30, ""), (60, "# "), (40, " * ")):
                wrapped = "\n".join(mark + x for x in textwrap.wrap(t, width, break_on_hyphens=False))
                assert name in {x[0] for x in scanner.scan(f"{prose(8, 1)}\n{wrapped}\n{prose(8, 2)}")}, (name, width, t)
    gpl = "licensed under the GNU General Public License,\nversion 3.\nCopyright 2024, see section 2"
    assert [x[0] for x in scanner.scan("This work is " + gpl)] == ["GPL-3.0"]


CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_conditions_tell_licenses_apart():
    scanner = licenses.Scanner()
    names = lambda t: [x[0] for x in scanner.scan(t)]
    assert names(CLAUSES) == ["BSD-2-Clause"] and names(CLAUSES + THIRD) == ["BSD-3-Clause"]
    assert names("Licensed under the BSD 2-Clause License.\n" + "word " * 200 + CLAUSES + THIRD) == ["BSD-2-Clause", "BSD-3-Clause"]


def test_notices_of_many_forms():
    scanner = licenses.Scanner()
    forms = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "distributed under the terms of the MIT license": "MIT",
        "Licensed under the GPLv3": "GPL-3.0", "Released under the Apache 2.0 license": "Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004": "Apache-2.0",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007": "GPL-3.0", "it may be changed under the terms of version 2 of the GNU General Public License": "GPL-2.0",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "are made available under the terms of the Eclipse Public License 2.0": None, "Released under the zlib License": "Zlib",
        "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.": "Zlib",
        "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0": "EPL-2.0",
    }
    for t, name in forms.items():
        for before, after in (("", ""), ("import os\n", "\nint x;"), (prose(60, 1) + ". ", ". " + prose(60, 2))):
            assert [x[0] for x in scanner.scan(before + t + after)] == ([name] if name else []) or name is None, (t, before)
    assert licenses.tagged("SPDX-License-Identifier: (MIT OR GPL-2.0-only)") == {"MIT", "GPL-2.0"}
    assert licenses.tagged("SPDX-License-Identifier: LicenseRef-own") == set()


def test_the_ranking_loses_no_notice():
    """Winners by bytes saved against confirming every wording at every cue, on notices with words changed, left out and put in."""
    scanner, r = licenses.Scanner(), random.Random(12)
    both = ranked = 0
    for name, (wordings, _) in licenses.TEMPLATES.items():
        for t in wordings:
            for k in range(6):
                words = t.split()
                for _ in range(k * len(words) // 30):
                    at = r.randrange(len(words))
                    words[at : at + 1] = r.choice([[], [prose(1, r.randrange(10**6))], [words[at], "also"]])
                text = f"{prose(r.randrange(60), k)} {' '.join(words)} {prose(r.randrange(60), k + 9)}"
                for block in licenses.blocks(text):
                    every, won = set(scanner.winners(block, -9.0)), set(scanner.winners(block))
                    assert won <= every
                    both, ranked = both + len(every), ranked + len(won)
    assert both > 200 and ranked >= 0.98 * both
    # Prose without a notice leaves few wordings to confirm.
    tried = [share >= licenses.SAVED for k in range(40) for share, _, _ in scanner.ranked({n: f"{prose(n, k)} license {prose(n, k + 50)}" for n in {len(w) for _, w, _, _ in scanner.wordings}})]
    assert sum(tried) < 0.2 * len(tried)


# ---- mixing


def filled(sizes, share=1.5, weights=(5, 2, 1), cap=2.0):
    """Targets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


def mixed(spark, data, **k):
    return mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string, size string"), **k).collect()


@pytest.mark.parametrize("slots", [16, 4096])
def test_mixture(spark, slots):
    r = random.Random(7)
    data = [(i, " ".join("x" * r.randrange(1, 200)), r.choice(["a", "a", "a", "b", "c", "é", None, ""]), "clash") for i in range(400)] + [(None, "y y", "b", ""), (None, "y y", "b", ""), (500, None, "a", ""), (501, " \n", "zz", "")]
    out = mixed(spark, data, slots=slots)
    assert len(out) == len(data)
    size = Counter()
    for _, t, s, _ in data:
        size[s] += len((t or "").split())
    want, taken = filled(size), Counter()
    for x in out:
        assert abs(x.target - want[x.source]) < 1e-6 and x.source_size == size[x.source] and 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert sorted(map(str, out)) == sorted(map(str, mixed(spark, data[::-1], slots=slots)))


def test_mixture_of_nothing(spark):
    assert mixed(spark, []) == []
    assert [(x.size, x.taken, x.target) for x in mixed(spark, [(1, None, None, "")])] == [(0, 0, 0.0)]


def test_schedule_is_low_discrepancy(spark):
    sources = spark.createDataFrame([(1, "a", 10, 6000, 6000.0), (2, "b", 10, 3000, 3000.0), (3, "c", 10, 1000, 1000.0)], "sid long, source string, n_docs long, source_size long, target double")
    slots = [x.sid for x in mixing.schedule(sources, 10, 1000).orderBy("slot").collect()]
    for n in range(50, 1000, 50):
        part = Counter(slots[:n])
        assert all(abs(part[s] - n * w) <= 4 for s, w in ((1, 0.6), (2, 0.3), (3, 0.1)))


# ---- the pipeline


def slow_features(words):
    """Word and n-gram buckets one by one."""
    ids, grams, ends = [], [], [0]
    for w in words:
        w = re.sub(r"^\W+|\W+$", "", w)
        ids.append(xxhash.xxh64_intdigest(w) % toxicity.WORD_BUCKETS)
        marked = f"<{w}>"
        grams += [xxhash.xxh32_intdigest(marked[k : k + g]) % toxicity.CHAR_BUCKETS for g in toxicity.GRAMS for k in range(len(marked) - g + 1)] if w else [0]
        ends.append(len(grams))
    return ids, grams, ends


def test_features_equal_slow_ones_in_less_time():
    r = random.Random(4)
    odd = ["", "_", "...", "a", "ab.", ".é", "a-b", "<a>", "😀", "²", "日本語の長い単語です", "𝒳" * 9]
    some = ["".join(r.choice(letters) for _ in range(r.randrange(1, 20))) for letters in ("abcxyzABC09_", "ab.,'\"-()<>", "aéßяİ́季😀𝒳.«\x00") for _ in range(8000)]
    for words in ([], [""], ["..."], ["é"], odd, odd + some):
        assert [x.tolist() for x in toxicity.features(words)] == [*map(list, slow_features(words))]

    def seconds(f):
        began = time.process_time()
        f(some)
        return time.process_time() - began

    # The former code was about as slow as the plain one.
    assert 1.5 * min(seconds(toxicity.features) for _ in range(3)) < min(seconds(slow_features) for _ in range(3))


def slow_score(net, text):
    """A text's score word by word: windows, both directions, attention and the logistic curve as they are defined."""
    words = (text or "").lower().split()
    x = net.inputs(*toxicity.features(words))
    n, size = len(words), toxicity.WINDOW
    starts = [0] if n <= size else [*range(0, n - size, toxicity.STRIDE), n - size]
    sig = lambda v: 1 / (1 + np.exp(-v))
    best = -np.inf
    for a in starts:
        rows = [x[k] if k < n else x[-1] for k in range(a, a + size)]
        real = [k < n for k in range(a, a + size)]
        seen = np.zeros((size, 2, toxicity.HIDDEN))
        for side in (0, 1):
            state, h = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN
            for t in range(size) if side == 0 else reversed(range(size)):
                if real[t]:
                    g, u = rows[t] @ net.p["wx"][side] + net.p["b"][side][0], state @ net.p["wh"][side]
                    z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                    c = np.tanh(g[2 * h :] + r * u[2 * h :])
                    state = (1 - z) * c + z * state
                seen[t, side] = state
        both = seen.reshape(size, -1)
        score = np.where(real, both @ net.p["attend"], -1e9)
        weight = np.exp(score - score.max())
        best = max(best, (weight / weight.sum()) @ both @ net.p["out"] + net.p["bias"][0])
    return float(sig(net.scale * best + net.shift))


def test_scores_equal_a_slow_rewrite(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = toxicity.train(*toxicity.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    long = " ".join(r.text for r in docs.orderBy("doc_id").limit(60).collect())
    texts = [None, "", "one", " ".join(f"w{i}" for i in range(31)), " ".join(f"w{i}" for i in range(33)), " ".join(f"w{i}" for i in range(56)), " ".join(f"w{i}" for i in range(57)), long[:6000]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, long * 30])], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - slow_score(net, t)) < 1e-4
    assert abs(got[len(texts)] - slow_score(net, long * 30)) < 1e-4  # over a megabyte


def test_whole_search_against_brute_force(spark):
    """Every item that a brute-force common subsequence finds in a document, by the share of changed words; figures are in the README."""
    r = random.Random(77)
    pool = [f"v{i}" for i in range(3000)]
    items = [[r.choice(pool) for _ in range(n)] for n in (5, 8, 10, 12, 14, 17, 20, 25, 30, 40, 60, 90) for _ in range(4)]
    texts, planted = [], {}
    for share in (0.0, 0.1, 0.2):
        for k, item in enumerate(items):
            w = list(item)
            for i in r.sample(range(len(w)), int(share * len(w))):
                w[i] = f"x{r.randrange(10**6)}"
            planted[len(texts)] = (k, share)
            texts.append(" ".join([r.choice(pool) for _ in range(r.randrange(20, 60))] + w + [r.choice(pool) for _ in range(r.randrange(20, 60))]))
    texts += [" ".join(r.choice(pool) for _ in range(150)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.search(df, bench).collect()}
    assert all(planted.get(d, (None,))[0] == k for d, k in got)
    for share, low, high, least in ((0.0, 17, 99, 1.0), (0.1, 17, 99, 0.95), (0.2, 17, 99, 0.9), (0.0, 4, 16, 0.9)):
        sought = [(d, k) for d, (k, s) in planted.items() if s == share and low <= len(items[k]) <= high]
        found = sum(x in got for x in sought) / len(sought)
        print(f"items of {low} to {high} words, {share:.0%} of words changed: recall {found:.2f}")
        assert found >= least


def test_pipeline_stage_by_stage(spark):
    """Each stage against its operator's decisions on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    model = toxicity.train(*toxicity.training_rows(docs, labels))
    rude = {r.doc_id for r in docs.collect() if slow_score(model, r.text) >= toxicity.THRESHOLD}
    a = corpus_pipeline.work.save(stages["toxicity"](spark, docs, SF), "test")
    assert {r.doc_id for r in a.collect()} == set(range(200)) - rude
    b = corpus_pipeline.work.save(stages["line_dedup"](spark, a, SF), "test")
    n = Counter(k for r in a.collect() for k in {x.strip().lower() for x in r.text.split("\n")})
    before = {r.doc_id: r.text for r in a.collect()}
    for r in b.collect():
        assert r.text == "\n".join(x for x in before[r.doc_id].split("\n") if n[x.strip().lower()] < 10 or not x.strip()) and r.n_chars == len(r.text)
    c = corpus_pipeline.work.save(stages["near_dedup"](spark, b, SF), "test")
    rows = sorted((r.doc_id, r.text) for r in b.collect())
    alike = classes([t for _, t in rows], np.sqrt(weights.idf(*weights.frequencies(b))))
    assert {r.doc_id for r in c.collect()} == {rows[i][0] for i in set(alike.values())}
    d = corpus_pipeline.work.save(stages["decontamination"](spark, c, SF), "test")
    held = {i for i, t in ((r.doc_id, " ".join(r.text.lower().split())) for r in c.collect()) if any(" ".join(x.text.lower().split()) in t for x in bench.collect())}
    gone = {r.doc_id for r in c.collect()} - {r.doc_id for r in d.collect()}
    assert held <= gone and len(gone) <= len(held) + 2
    assert all(x.columns == docs.columns for x in (a, b, c, d))
    out = stages["mixing"](spark, d, SF)
    assert out.count() == d.count() and out.agg(F.sum("size")).first()[0] == sum(len(r.text.split()) for r in d.collect())


def test_pipeline_of_odd_inputs(spark, tmp_path):
    """Null ids and texts, repeated rows, empty texts and columns beside the usual ones; an empty table gives no rows."""
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b c d e f", "en", None, 11), (901, "", "en", "s", 0), (902, None, None, "s", None), (903, "x " * 40_000, "en", "s", 80_000), (904, "p q r s t", "en", "s", 9), (904, "p q r s t", "en", "s", 9)], kind)
    extra = [F.lit("clash").alias(c) for c in ("row", "score", "class_id", "gone")]
    for name, docs in (("odd", some.unionByName(odd)), ("none", some.limit(0))):
        folder = tmp_path / name
        docs.select("*", *extra).write.parquet(str(folder / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(folder / f"{t}.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        ids = [r.doc_id for r in out]
        if name == "none":
            assert out == []
        else:
            assert len(ids) == len([i for i in ids if i is None]) + len({i for i in ids if i is not None}) and ids.count(None) == 2
            # Null and empty texts are copies of each other: the least id stays.
            assert 901 in ids and 902 not in ids and 903 in ids and ids.count(904) == 1
            assert {r.doc_id: r.size for r in out}[903] == 40_000


def test_registered_queries():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_fit_learns_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 10)
    monkeypatch.setattr(toxicity, "MAX_NEGATIVE", 20)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 64)
    r = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(r.choice(words, 60)) + (" vile" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(300)]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    inside = {x.doc_id for x in toxicity.sampled(docs, labels).collect()}
    assert len(inside) == 30
    model, again = toxicity.fit(docs, labels), toxicity.fit(docs, labels)
    assert all(np.allclose(model.p[k], again.p[k], atol=1e-6) for k in model.p)
    # Rows that are not in the first sample count: their words move, and so do the scores.
    other = docs.withColumn("text", F.when(F.col("doc_id").isin(*inside), F.col("text")).otherwise("quite other words"))
    changed = toxicity.fit(other, labels)
    assert not np.allclose(model.p["words"], changed.p["words"], atol=1e-6) and abs(model.shift - changed.shift) > 1e-3
    p = model.probability(model.score_texts(pa.array([x[1] for x in rows])))
    assert abs(p.mean() - 1 / 3) < 0.05


def test_basis_comes_from_all_passages(spark, monkeypatch):
    monkeypatch.setattr(decontam, "FIT_DOCS", 8)
    docs = spark.createDataFrame([(k, " ".join(f"d{k}w{j}" for j in range(12))) for k in range(120)], "doc_id long, text string")
    n, df = decontam.weights.frequencies(docs)
    basis = decontam.fit(docs, n, decontam.weights.idf(n, df))
    h, _ = decontam.ragged.hashed(pa.array([" ".join(f"d{k}w{j}" for j in range(12)) for k in range(120)]))
    assert basis.shape == (decontam.TERMS, decontam.RANK) and np.isfinite(basis).all()
    outside = np.abs(basis[decontam.term(h)]).max(axis=1) < 1e-6
    assert outside.mean() < 0.05
