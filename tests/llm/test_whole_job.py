"""Cases of which an operator once did only a part."""

import random
import textwrap

import numpy as np
import pyarrow as pa

from brightwell.llm import classifier, license_scan, line_dedup, lm


def licenses(text):
    return [m["license"] for m in license_scan.Scanner(license_scan.TEMPLATES).scan(text)]


def test_license_within_long_lines():
    around = [f"word{i * 7919 % 5003}" for i in range(4000)]
    for name, templates in license_scan.TEMPLATES.items():
        for t in templates:
            for n in (10, 500, 2000):
                assert licenses(" ".join([*around[:n], t, *around[-n:]])) == [name], (name, t, n)


def test_wrapped_licenses():
    for name, templates in license_scan.TEMPLATES.items():
        for t in templates:
            for width in (20, 40, 60, 80):
                for mark in ("", "# ", " * "):
                    lines = [mark + line for line in textwrap.wrap(t, width, break_on_hyphens=False, break_long_words=False)]
                    assert licenses("\n".join(lines)) == [name], (name, t, width)
                    assert licenses("\n\n".join(["Some words", *lines, "and more"])) == [name], (name, t, width)


def test_usual_license_files():
    mit = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
    bsd = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    gpl = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
    assert [licenses(t) for t in (mit, bsd, gpl)] == [["MIT"], ["BSD-2-Clause"], ["GPL-3.0-or-later"]]
    assert sorted(licenses("\n".join([mit, bsd, gpl]))) == ["BSD-2-Clause", "GPL-3.0-or-later", "MIT"]
    match = license_scan.Scanner(license_scan.TEMPLATES).scan(mit)[0]
    assert (match["first_line"], match["after_line"], match["differences"]) == (4, 13, 0)


def test_lines_alike_only_in_their_words_first_characters(spark, docs):
    urls = [f"https://www.example.org/{c * 3}/{i * 7919:08x}/{c}{i}" for i, c in enumerate("abcdefgh")]
    unspaced = ["今天天气非常好我们" + rest for rest in ("一起去公园散步吧", "决定留在家里看书写字", "明天再讨论这个问题")]
    long_url = "https://www.example.org/" + "".join(f"{i * i:x}" for i in range(60))
    lines = [*urls, *unspaced, "see " + "k" * 9 + "eys/of/one/kind/here", "see " + "k" * 9 + "eys/of/another/sort/there", long_url]
    rows = [(i, line) for i, line in enumerate(lines)] + [(100, long_url + "x")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == dict(rows) | {100: ""}


def test_long_texts_do_not_end_the_training_sample(spark, docs):
    rows = [(i, "a long trusted text of usual words " * 400) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = classifier.judge(docs(rows), labels, train_bytes=8192).collect()
    assert len(got) == 40 and all(r.perplexity < 64 for r in got)


def test_wide_bands_are_split_without_losing_a_pair(spark):
    rng = random.Random(4)
    sketches = {i: 9 | 17 << 30 | sum(rng.randrange(3) << 6 * j for j in range(10) if j not in (0, 5)) for i in range(300)}
    placed = spark.createDataFrame([(7, i, s, i, -1) for i, s in sketches.items()], "band long, id long, sketch long, root long, last int")
    few, agreeing = line_dedup._groups(line_dedup._open_bands(placed), 12, [])
    alike = lambda a, b: sum(not (a ^ b) & 63 << 6 * j for j in range(10)) >= line_dedup.AGREE
    groups, wide = {}, {}
    for rows, into in ((few, groups), (agreeing, wide)):
        for r in rows.collect():
            into.setdefault(r.band, set()).add(r.id)
    met = {(a, b) for g in (*groups.values(), *wide.values()) for a in g for b in g if a < b}
    want = {(a, b) for a in sketches for b in sketches if a < b and alike(sketches[a], sketches[b])}
    assert want and want <= met
    assert all(len(g) <= 12 for g in groups.values())
    assert all(alike(sketches[a], sketches[b]) for g in wide.values() for a in g for b in g)


def test_workers_give_back_what_scoring_took(spark):
    rows = spark.range(0, 12_000, 1, 2).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 400), i -> hex(hash(id, i) & 262143))) as text")
    assert lm.score_documents(rows).where("n_tokens = 401").count() == 12_000

    def resident(batches):
        for batch in batches:
            with open("/proc/self/status") as f:
                kb = next(int(x.split()[1]) for x in f if x.startswith("RssAnon"))
            yield pa.RecordBatch.from_arrays([pa.array([kb // 1024] * batch.num_rows)], names=["mb"])

    assert max(r.mb for r in spark.range(0, 8, 1, 8).mapInArrow(resident, "mb long").collect()) < 150


def test_packed_columns_come_back():
    for n in (0, 1, 1000):
        columns = [np.sort(np.random.default_rng(i).integers(0, 1 << 63, n, np.uint64)) if not i else np.random.default_rng(i).integers(0, 9, n, np.uint64) for i in range(3)]
        assert all((a == b).all() and len(a) == n for a, b in zip(columns, lm.unpack(lm.pack(*columns), 3), strict=True))
