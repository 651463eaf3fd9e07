"""Operators against brute force on small tables, with nulls, empties, ties, repeats and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from brightwell.llm import bpe, classifier, decontam, license_scan, lm, quality_rules, sharding, simhash, warc
from brightwell.llm.elias_fano import EliasFano, stored
from brightwell.llm.shared import shared_path
from tests.llm.conftest import lower, space_words

CLASH = "row string, found string, shard int, band int, bucket int, id int, n_words int, "


def clashing(spark, docs):
    """The same rows with columns that operators use inside."""
    from pyspark.sql import functions as F

    extra = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.strip(", ").split(", ")}
    return docs.withColumns(extra)


# Sharding


@given(st.lists(st.integers(1, 1000), max_size=40), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_differencing(sizes, k):
    part = sharding.difference(sizes, k)
    assert len(part) == len(sizes) and set(part) <= set(range(k))
    sums = [sum(x for x, p in zip(sizes, part) if p == s) for s in range(k)]
    assert max(sums) - min(sums) <= max(sizes, default=0)


def test_differencing_beats_greedy():
    assert sorted(sum(x for x, p in zip([8, 7, 6, 5, 4], s) if p == 0) for s in [sharding.difference([8, 7, 6, 5, 4], 2)]) in ([14], [16])
    rng = random.Random(1)
    sizes = [rng.randrange(1, 10**6) for _ in range(2000)]
    part = sharding.difference(sizes, 8)
    sums = [sum(x for x, p in zip(sizes, part) if p == s) for s in range(8)]
    assert max(sums) - min(sums) < 100


def test_sharding(spark, docs, sample):
    frame = clashing(spark, docs(sample + [(20_000 + i, "copy") for i in range(300)]))
    got = sharding.shard_documents(frame, 8).collect()
    assert len(got) == len(sample) + 300
    texts = {(d, zlib.crc32((t or "").encode())): t or "" for d, t in sample}
    groups, sums = defaultdict(set), Counter()
    for r in got:
        text = texts.get((r.doc_id, r.text_crc32), "copy")
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        groups[text].add(r.shard)
        sums[r.shard] += r.size
    assert all(len(s) == 1 for s in groups.values()) and set(sums) <= set(range(8))
    assert max(sums.values()) - min(sums[s] for s in range(8)) < 1000 or max(sums.values()) == max(len(t.encode()) + 1 for t in groups)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(docs([]), 8).count() == 0


def test_sharding_in_levels(spark):
    groups = spark.range(3000).selectExpr("unhex(sha2(cast(id as string), 256)) as item", "1 + id % 97 as bytes")
    placed, _ = sharding.assign_groups(groups, 8, last_items=64, bucket_items=16)
    sums = {r["shard"]: r["n"] for r in placed.join(groups, "item").groupBy("shard").agg({"bytes": "sum"}).withColumnRenamed("sum(bytes)", "n").collect()}
    assert placed.count() == 3000 and len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 97


# Decontamination


def brute_hits(text, items, window):
    """Every window of every item looked up at every place."""
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    seq, held = plain(text), defaultdict(set)
    for k, t in items:
        item = plain(t)
        n = min(window, len(item))
        for i in range(len(item) - n + 1 if n else 0):
            held[tuple(item[i : i + n])].add(k)
    hit, found = [0] * len(seq), set()
    for n in {len(w) for w in held}:
        for j in range(len(seq) - n + 1):
            if near := held.get(tuple(seq[j : j + n])):
                hit[j : j + n] = [1] * n
                found |= near
    return len(seq), sum(hit), sorted(found)


@given(st.lists(st.text("abc D.", max_size=30), max_size=6), st.text("abcd D,", max_size=60), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_automaton(items, text, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    automaton = decontam.Automaton([(k, decontam.words(t.encode())) for k, t in named], window)
    spans, found = automaton.match(decontam.words(text.encode()))
    assert (sum(e - s for s, e in spans), sorted(found)) == brute_hits(text, named, window)[1:]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_decontaminate(spark, docs, sample):
    bench = [(1, "the Quick brown fox jumps over the lazy dog and runs far away"), (2, "tiny Item"), (3, None), (4, ""), (5, sample[3][1]), (1, "the Quick brown fox jumps over the lazy dog and runs far away")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    rows = sample + [(30_001, "Before.\nTHE quick, brown fox-jumps over the lazy dog and runs! " + "after " * 30), (30_002, "a tiny item " + "b " * 20), (30_003, "tiny. ITEM")]
    found = decontam.find_spans(clashing(spark, docs(rows)), items).selectExpr("row.doc_id", "row.text", "found.*").collect()
    named = [(str(k), t) for k, t in bench]
    for r in found:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(r.text, named, 10)
    assert len(found) == len(rows)
    for most, piece in ((400, 100), (1500, 1 << 18), (100, 1)):  # several automata, of pieces too, find the same
        folder, parts = decontam.automata(items, 10, "item_id", "text", most, piece)
        assert len(parts) > 1
        matched = decontam._matcher(folder, parts)([decontam.words((r.text or "").encode()) for r in found])
        for r, (spans, ids) in zip(found, matched):
            assert (sum(e - s for s, e in spans), sorted(ids)) == brute_hits(r.text, named, 10)[1:]
    nameless = spark.createDataFrame([(None, bench[0][1]), (None, bench[1][1]), (7, bench[1][1])], "item_id long, text string")
    for r in decontam.find_spans(docs(rows), nameless).selectExpr("row.doc_id", "row.text", "found.*").collect():
        hit = brute_hits(r.text, [("x", bench[0][1]), ("7", bench[1][1])], 10)
        assert (r.n_hit, r["items"]) == (hit[1], [i for i in hit[2] if i != "x"])
    clean = {r.doc_id: r for r in decontam.decontaminate(docs(rows), items).collect()}
    assert 30_003 not in clean and clean[30_001].text.startswith("Before.\n! after") and clean[30_001].n_chars == len(clean[30_001].text)
    assert clean[30_002].text == "a  " + "b " * 20 and clean[10_001].text is None
    for d, t in rows:
        if d in clean and not brute_hits(t, named, 10)[1]:
            assert clean[d].text == t
        elif d in clean:
            assert brute_hits(clean[d].text, named, 10)[1] == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_spans(docs(rows), empty).where("found.n_hit > 0").count() == 0
    assert decontam.find_spans(docs([]), items).count() == 0


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path), bpe.ForcedBPE(open(path, encoding="utf-8").read())


@given(st.text(st.one_of(st.sampled_from("abc XYZ'stmdl  \n\t!!??.,12349½²éß日本語　\xa0\x85 ​\x1c\x00😀ñ́İſ"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_is_the_library(tokenizer, text):
    _, theirs, ours = tokenizer
    ids = np.frombuffer(ours.encode(text), np.int32).tolist()
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids == want and ours.decode(ids) == theirs.decode(want, skip_special_tokens=False) == text


def test_bpe_long_and_special(tokenizer):
    _, theirs, ours = tokenizer
    for text in ("a" * 5000, "!?" * 3000, " " * 999, "é" * 3000, "x<|endoftext|><|endoftext|> y", "<|endoftext|>", "\r\n" * 50, "".join(map(chr, range(1, 0x250)))):
        ids = np.frombuffer(ours.encode(text), np.int32).tolist()
        assert ids == theirs.encode(text, add_special_tokens=False).ids and ours.decode(ids) == text


def test_bpe_cuts_are_forced(tokenizer):
    ours = tokenizer[2]
    pairs = {(a, b) for t in ours.ids for a, b in zip(t, t[1:])}
    assert pairs == ours.pairs and len(pairs) < 256 * 256


def test_bpe_frames(spark, docs, sample, tokenizer):
    path, theirs, _ = tokenizer
    coded = bpe.encode(clashing(spark, docs(sample)), path).selectExpr("row.doc_id", "row.text", "found.ids")
    back = bpe.decode(coded, path).selectExpr("row.text as text", "row.ids as ids", "found.decoded as decoded").collect()
    assert len(back) == len(sample)
    for r in back:
        assert r.ids == theirs.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), path).first().found.decoded == ""


# SimHash


def test_covering_masks():
    rng = random.Random(3)
    for radius in (1, 2, 3, 4, 5):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(500):
            differ = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(not m & differ for m in masks)


@given(st.lists(st.integers(0, 2**12), unique=True, max_size=60))
@settings(max_examples=100, deadline=None)
def test_forest(prints):
    edges = simhash.forest(np.array(prints, np.uint64), 2)
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    assert components(prints, edges) == components(prints, [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 2])


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_print(text):
    seq = space_words(lower(text))
    runs = [" ".join(seq[i : i + 4]) for i in range(max(1, len(seq) - 3))] if seq else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(spark, docs, sample):
    base = sample[5][1]
    rows = sample + [(40_000 + i, base + " tail" * (i % 3) + f" {i}" * (i % 2)) for i in range(60)]
    got = simhash.near_duplicates(clashing(spark, docs(rows))).collect()
    prints = {(d, t): brute_print(t) for d, t in rows}
    nodes = sorted(set(prints.values()))
    up = components(nodes, [(a, b) for a in nodes for b in nodes if (a ^ b).bit_count() <= 4])
    least = {}
    for (d, _), p in prints.items():
        if d is not None:
            least[up[p]] = min(least.get(up[p], d), d)
    want = sorted((str(d), f"{prints[d, t]:016x}", least.get(up[prints[d, t]])) for d, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, {least.get(up[p]) for p in prints.values()}))
    assert all((r.doc_id, r.text) in prints for r in kept)
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.keep_one(docs([])).count() == 0


def test_links_over_batches():
    """Groups that straddle batches are whole."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 8, 300).astype(np.uint64)
    table, masked = np.sort(rng.integers(0, 3, 300)), np.zeros(300, np.int64)
    whole = pa.RecordBatch.from_arrays([pa.array(table), pa.array(masked), pa.array(prints.view(np.int64))], names=["table", "masked", "print"])
    want = None
    for size in (300, 1, 7, 64):
        edges = [e for out in simhash._links(1)(iter([whole.slice(i, size) for i in range(0, 300, size)])) for e in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        found = components(sorted(set(prints.tolist())), edges)
        want = want or found
        assert found == want


# Language model


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=80), st.lists(st.integers(0, 2**64 - 1), max_size=20), st.integers(0, 63))
@settings(max_examples=200, deadline=None)
def test_elias_fano(values, queries, shift):
    v = np.unique(np.array(values, np.uint64) >> np.uint64(shift))
    held, _ = EliasFano.restore(np.frombuffer(b"\0" * 16 + stored(EliasFano.build(v).dump()), np.uint8), 16)
    if len(v):
        assert (held.access(np.arange(len(v))) == v).all()
    q = np.concatenate([v, np.array(queries, np.uint64) >> np.uint64(shift)])
    place, equal = held.successor(q)
    assert (place == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()


def brute_lm(rows):
    tokens = [(d, t, [w for w in space_words(lower(t))] + [None]) for d, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _, _ in tokens]
    c, pairs, triples = Counter(), Counter(), Counter()
    for (_, _, seq), h in zip(tokens, held):
        if not h:
            c.update(seq)
            pairs.update(zip([None, *seq], seq))
            triples.update(zip([None, *seq], seq, seq[1:]))
    types, contexts, after = Counter(u for u, _ in pairs), Counter(), Counter((t, u) for t, u, _ in triples)
    for (t, u, _), k in triples.items():
        contexts[t, u] += k
    n, v = sum(c.values()), len(c)
    one = lambda w: (c[w] + 1) / (n + v + 1)
    two = lambda u, w: (pairs[u, w] + types[u] * one(w)) / (c[u] + types[u]) if types[u] else one(w)
    three = lambda t, u, w: (triples[t, u, w] + after[t, u] * two(u, w)) / (contexts[t, u] + after[t, u]) if after[t, u] else two(u, w)
    score = lambda seq: math.log10(two(None, seq[0])) + sum(math.log10(three(t, u, w)) for t, u, w in zip([None, *seq], seq, seq[1:]))
    out = [(d, h, len(seq), sum(c[w] > 0 for w in seq), n, sum(math.log10(one(w)) for w in seq), score(seq), sum(math.log10(two(u, w)) for u, w in zip([None, *seq], seq))) for (d, t, seq), h in zip(tokens, held)]
    for t, u in list(after)[:5]:  # the model is a distribution; its unknown word has the rest
        rest = types[u] / (c[u] + types[u]) / (n + v + 1)
        assert abs(sum(two(u, w) for w in c) + rest - 1) < 1e-9
        assert abs(sum(three(t, u, w) for w in c) + after[t, u] / (contexts[t, u] + after[t, u]) * rest - 1) < 1e-9
    return out


def test_lm(spark, docs, sample):
    got = sorted(lm.score_documents(clashing(spark, docs(sample))).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = sorted(brute_lm(sample), key=lambda r: (str(r[0]), r[2]))
    assert [tuple(r[:5]) for r in got] == [w[:5] for w in want]
    for r, w in zip(got, want):
        assert r.base_score == pytest.approx(w[5], abs=1e-6) and r.score == pytest.approx(w[6], abs=lm.STEP * w[2] + 1e-6)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score for r in held) > sum(w[7] for w in want if w[1] and w[2] > 20)  # better than order two
    assert lm.score_documents(docs([])).count() == 0
    only = [d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2][0]
    row = lm.score_documents(docs([(only, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_counts_are_packed_whole():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    counts = np.arange(1, len(keys) + 1, dtype=np.uint64)
    k, c = lm.unpack(lm.pack(keys, counts), 2)
    assert (k == keys).all() and (c == counts).all()
    k, c = lm.tally([keys, keys[:10]], [counts, counts[:10]])
    assert (k == keys).all() and (c[:10] == 2 * counts[:10]).all() and (c[10:] == counts[10:]).all()
    for n, columns in ((1000, 3), (0, 2)):
        back = lm.unpack(lm.pack(*[counts[:n]] * columns), columns)
        assert len(back) == columns and all((x == counts[:n]).all() for x in back)


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 40)), unique=True, max_size=120), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 45)), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_level_is_searched_within_its_context(pairs, queries):
    context, word = (np.array([p[i] for p in sorted(pairs)], np.int64) for i in (0, 1))
    level, _ = lm.Level.restore(np.frombuffer(stored([*lm.Level.build(context, word, 7, 50), np.zeros(len(word), np.uint8)]), np.uint8), 0)
    asked = sorted(set(queries))
    held, back = np.unique([q[0] for q in asked], return_inverse=True)
    at, equal = level.find(held, back, np.array([q[1] for q in asked]), 50)
    for q, i, e in zip(asked, at.tolist(), equal.tolist()):
        assert e == (q in pairs) and (not e or sorted(pairs)[i] == q)


# WARC


def test_warc(spark):
    rows = [(3, "http://x/3", "same"), (1, "http://x/1", "same"), (2, None, "é日本"), (4, "u\r\nX: y", None), (5, "u", ""), (None, "u", "same"), (1, "again", "same"), (6, "u", "long " * 100_000), (7, "u", "same"), (8, "u", "x\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "'b' as body", "2 as file")
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder)
    got = sorted(warc.read_archives(spark, folder, manifest).collect(), key=lambda r: str(r))
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    want = []
    for i, u, t in rows:
        data, first = (t or "").encode(), least.get(t or "")
        again = i is not None and i != first
        want.append((i, None if again else data, len(data), warc.digest32(data), "revisit" if again else "response", first if again else None, None if u is None else u.replace("\r\n", "%0D%0A")))
    assert [tuple(None if x is None else bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got] == sorted(want, key=lambda w: str(w)) or sorted(map(str, (tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got))) == sorted(map(str, want))
    assert manifest.count() == len(rows) and manifest.selectExpr("min(offset) > 8").first()[0]
    none = shared_path(spark, "warc-test")
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), none)
    assert empty.count() == 0 and warc.read_archives(spark, none, empty).count() == 0 and warc.read_archives(spark, none).count() == 0


def test_warc_minimum(spark):
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string"), folder, min_payload_bytes=3)
    assert {r.page_id: r.record_type for r in warc.read_archives(spark, folder, manifest).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


class _Sink(list):
    write = list.append


def test_warc_validation():
    sink = _Sink()
    samples = [f"<html>page {i} of many pages</html>".encode() * 20 for i in range(400)]
    writer = warc.ArchiveWriter(sink, samples, 4096, 3)
    records = [warc.record_bytes(i, "u", s, warc.digest32(s), len(s), None) for i, s in enumerate(samples)]
    places = [writer.add(r) for r in records]
    data = b"".join(sink)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and len(data) < sum(map(len, records)) / 3
    assert [r["payload"] for r in warc.read_archive(data)] == samples
    assert places[0][0] == 8 + int.from_bytes(data[4:8], "little") and places[-1][0] + places[-1][1] == len(data)
    for broken in (data[:-3], data[4:], b"", data[: places[5][0] + 7], data[:100] + data[101:], data + b"xxxx"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(broken))
    for old, new in ((b"Content-Length: ", b"Content-Length: 9"), (b"WARC/1.1", b"WARC/9.9"), (b"X-Payload-Length: ", b"X-Payload-Length: 1"), (b"sha1:", b"sha1:A"), (b"WARC-Type: response", b"WARC-Type: revisit"), (b"WARC-Record-ID", b"WARC-Other"), (b"u\r\n", b"u\r\nnothing\r\n")):
        with pytest.raises((warc.WarcError, ValueError)):
            warc.parse_record(records[3].replace(old, new, 1))
    packed = zstandard.ZstdCompressor().compress(data[8 : places[0][0]])  # the dictionary itself may be compressed
    other = (0x184D2A5D).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + data[places[0][0] :]
    assert [r["payload"] for r in warc.read_archive(other)] == samples


# Licenses


def test_licenses(spark, docs, sample):
    rows = sample + [
        (50_001, "Licensed under CC BY-NC 4.0.\nSome text"),
        (50_002, "x\nReleased under the MIT License.\ny\n\n\n\n\nThis work is licensed under the GNU General Public License, version 3."),
        (50_003, "This licence is nothing in particular, and a license may be had."),
        (50_004, license_scan.TEMPLATES["MIT"][0].replace("any person", "any  PERSON")),
        (50_005, "Licensed under CC BY-NC-SA 4.0."),
        (50_006, license_scan.TEMPLATES["GPL-2.0-or-later"][0]),
        (50_007, license_scan.TEMPLATES["GPL-3.0-or-later"][0]),
        (50_008, "license " * 9000 + "Released under the MIT License."),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(clashing(spark, docs(rows))).selectExpr("row.doc_id", "found.*").collect()}
    names = lambda d: sorted({m.license for m in got[d].matches})
    assert [names(50_000 + i) for i in range(1, 9)] == [["CC-BY-NC-4.0"], ["GPL-3.0-only", "MIT"], [], ["MIT"], ["CC-BY-NC-SA-4.0"], ["GPL-2.0-or-later"], ["GPL-3.0-or-later"], ["MIT"]]
    assert got[50_003].n_blocks == 1 and got[10_001].n_blocks == 0 and got[50_002].n_blocks == 2
    assert license_scan.scan_licenses(docs([])).count() == 0


# Classifier


def brute_kneser_ney(texts, order):
    """log p of a byte after its context, by dictionaries, from the definition."""
    padded = [b"\0" * (order - 1) + t for t in texts]
    tables = {order: Counter(t[i : i + order] for t in padded for i in range(len(t) - order + 1))}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    discounts = {}
    for n, table in tables.items():
        k = Counter(table.values())
        y = k[1] / (k[1] + 2 * k[2])
        d = [1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3]]
        discounts[n] = [0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))]
    after = {n: defaultdict(dict) for n in tables}
    for n, table in tables.items():
        for g, c in table.items():
            after[n][g[:-1]][g[-1:]] = c

    def p(n, context, symbol):
        if not n:
            return 1 / 256
        context = context[len(context) - n + 1 :]
        seen = after[n].get(context)
        if not seen:
            return p(n - 1, context, symbol)
        d, c = discounts[n], seen.get(symbol, 0)
        left = sum(d[min(x, 3)] for x in seen.values())
        return (c - d[min(c, 3)] + left * p(n - 1, context, symbol)) / sum(seen.values())

    return p


def test_kneser_ney_against_its_definition(spark):
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "cat", "sat", "on", "mat", "日本", "thé", "a"], k=rng.randint(1, 30))) for _ in range(60)] + ["", "x"]
    model, _ = classifier.train(spark.createDataFrame([(t,) for t in texts], "words string"))
    p = brute_kneser_ney([t.encode() for t in texts if t], classifier.ORDER)
    probes = texts[:20] + ["the dog", "\U0001f600 cat", "zzzzzzz", "mat on the cat s"]
    keys, starts = classifier.symbols(pa.array(probes))
    logs = model.logs(keys)
    assert starts.tolist() == np.cumsum([0, *(len(t.encode()) for t in probes)]).tolist()
    for t, at in zip(probes, starts.tolist()):
        data = b"\0" * (classifier.ORDER - 1) + t.encode()
        for i in range(len(data) - classifier.ORDER + 1):
            gram = data[i : i + classifier.ORDER]
            assert math.exp(logs[at + i]) == pytest.approx(p(classifier.ORDER, gram[:-1], gram[-1:]), rel=1e-9)
    for key in keys[::40].tolist():  # a distribution over all symbols
        all_ = (key >> classifier.BITS << classifier.BITS) + np.arange(classifier.SYMBOLS, dtype=np.uint64)
        assert np.exp(model.logs(all_)).sum() == pytest.approx(1, abs=1e-9)


def test_worst_passages():
    rng = np.random.default_rng(4)
    sizes = [0, 5, classifier.WINDOW, classifier.WINDOW + 1, 300, 0, 47]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    cost = rng.random(starts[-1])
    some = np.flatnonzero(sizes)
    got = classifier._worst(cost, starts, some)
    for i, g in zip(some, got):
        own = cost[starts[i] : starts[i + 1]]
        want = [own[j : j + classifier.WINDOW].mean() for j in range(len(own) - classifier.WINDOW + 1)]
        assert g == (pytest.approx(max(want)) if want else -np.inf)


def test_classifier(spark, docs, sample):
    rng = random.Random(7)
    syllables = ["ta", "ne", "ri", "so", "lu", "men"]
    good = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(60))
    rows = [(i, good(), "en" if i % 2 else "xx", "s", 1) for i in range(400)] + [(1000 + i, good().upper().replace(" ", "!! "), "en", "s", 1) for i in range(40)]
    rows += [(2001, None, "en", "s", None), (2002, "", None, None, 0), (None, good(), None, "s", 1), (5, rows[5][1], "en", "s", 1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 400)] + [(1000 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (3, None, None), (1001, 1, 1)], "doc_id long, quality int, toxic int")
    frame = clashing(spark, docs(rows))
    got = classifier.judge(frame, labels, quantile=0.99).collect()
    assert len(got) == len(rows)
    kept = Counter(r.doc_id for r in got if r.kept)
    assert sum(i in kept for i in range(400)) >= 380 and not any(1000 + i in kept for i in range(40)) and 2001 not in kept and 2002 not in kept and None in kept
    passed = classifier.keep_good(frame, labels, quantile=0.99)
    assert passed.columns == frame.columns and Counter(r.doc_id for r in passed.collect()) == kept
    marred = {i: r.kept for r in classifier.judge(docs(rows + [(3000 + i, good()[:400] + " XQWJ#KZVPFGHBY DMCXQ" * 3 + good()[:400], "en", "s", 1) for i in range(20)]), labels).collect() for i in [r.doc_id]}
    assert not any(marred[3000 + i] for i in range(20))  # a bad passage in a good text
    nothing = classifier.judge(docs(rows), labels.limit(0)).collect()
    assert all(r.kept == bool(r.n_symbols) for r in nothing)
    assert classifier.judge(docs([]), labels).count() == 0


# Quality rules


def test_quality_rules(spark, docs, sample):
    import duckdb

    rows = sample + [(60_000 + i, f"word{i} " * 3 + "some plain words that go on and on here") for i in range(30)] + [(61_000, "a\nb\n\na\n \nb b"), (61_001, "### a% b$ " * 20)]
    full = [(d, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", None) for i, (d, t) in enumerate(rows)]
    frame = docs(full)
    con = duckdb.connect()
    documents = frame.toPandas().astype({"n_chars": "float64", "doc_id": "float64"})  # noqa: F841  DuckDB reads it by name
    want = con.execute(quality_rules.ORACLE).fetchall()
    got = quality_rules.judge(clashing(spark, frame)).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    key = lambda r: str(tuple(int(x) if isinstance(x, float) and x == x else None if isinstance(x, float) else x for x in r))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert quality_rules.judge(docs([])).count() == 0
    plan = quality_rules.judge(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeats_by_brute_force(spark, docs):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 40)))) for i in range(120)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measured(docs(rows)).select("row.doc_id", "n_repeat_words").collect()}
    for i, t in rows:
        seq = t.split()
        runs = Counter(tuple(seq[k : k + 5]) for k in range(len(seq) - 4))
        assert got[i] == len({k + j for k in range(len(seq) - 4) if runs[tuple(seq[k : k + 5])] > 1 for j in range(5)})


def test_sketch_error():
    values = np.random.default_rng(2).lognormal(size=5000)
    bucket = np.ceil(np.log(values) / math.log(quality_rules.GAMMA))
    back = quality_rules.GAMMA**bucket * 2 / (1 + quality_rules.GAMMA)
    assert (np.abs(back / values - 1) <= quality_rules.ALPHA * 1.0001).all()
