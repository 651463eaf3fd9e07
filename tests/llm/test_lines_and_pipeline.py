"""Line deduplication against all pairs, union-find, and the pipeline against its parts."""

import random
import re

import pytest

from brightwell.llm import line_dedup
from brightwell.llm.components import connected_components
from tests.llm.conftest import SPACE
from tests.llm.test_small_operators import brute_hits, brute_print, clashing, components


def brute_dedup(rows):
    """Texts by (doc_id, text) as all-pairs similarity and union-find leave them."""
    cut = lambda line: frozenset(line[i : i + 9] for i in range(max(1, len(line) - 8)))
    place = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            norm = line.strip(SPACE).lower()
            if norm:
                place.setdefault(norm, []).append((d is None, d or 0, t, i))
    lines = sorted(place)
    sets = {x: cut(x) for x in lines}
    links = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = components(lines, links)
    first = {}
    for x in lines:
        first[root[x]] = min(first.get(root[x], min(place[x])), min(place[x]))
    out = {}
    for d, t in rows:
        kept = [line for i, line in enumerate((t or "").split("\n")) if not line.strip(SPACE) or first[root[line.strip(SPACE).lower()]] == (d is None, d or 0, t, i)]
        out[d, t] = None if t is None else "\n".join(kept)
    return out, len(links)


def test_lines(spark, docs, sample):
    rng = random.Random(2)
    base = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"], k=30)) for _ in range(6)]
    near = []
    for i in range(60):
        seq = rng.choice(base).split()
        seq[rng.randrange(30)] = f"new{i}"
        near.append((70_000 + i, "\n".join([rng.choice(base), " " + " ".join(seq).upper() + "\t", "", f"own line {i} of its own kind {i * i}"])))
    rows = sorted(sample, key=str)[:60] + [(10_001, None), (10_002, ""), (10_003, " \t\n "), (None, "alone in the world\nx"), (10_104, "x"), (10_104, "x")] + near
    rows = list(dict.fromkeys(r for r in rows if r[0] != 10_004)) + [(10_104, "x")]
    want, n_links = brute_dedup(rows)
    frame = clashing(spark, docs(rows))
    got = line_dedup.dedup_lines(frame)
    assert got.columns == frame.columns
    held = {r.doc_id: r for r in got.collect()}
    assert n_links > 20
    for (d, t), text in want.items():
        assert held[d].text == text, (d, t)
        assert held[d].n_chars == (None if text is None else len(text))
    assert sum(r.doc_id == 10_104 for r in got.collect()) == 2
    counts = {r.doc_id: r for r in line_dedup.dedup_lines(docs(rows), counts=True).collect()}
    assert counts[10_001].n_lines == 0 and counts[10_003].n_lines == 2 and all(r.n_removed >= 0 for r in counts.values())
    assert line_dedup.dedup_lines(docs([])).count() == 0


def mutated(rng, line, edits):
    for _ in range(edits):
        at = rng.randrange(len(line) or 1)
        line = line[:at] + rng.choice(["", "#", "xy"]) + line[at + 1 :]
    return line


def many_kinds(rng):
    """Lines of several kinds and near copies of them, many of which lie about the similarity that counts."""
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(300)]
    kinds = [
        lambda: " ".join(rng.choices(words, k=rng.randint(5, 60))),
        lambda: "https://www.example.org/" + "/".join(rng.choices(words, k=rng.randint(2, 6))),
        lambda: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(rng.randint(9, 60))),
        lambda: "_".join(rng.choices(words, k=rng.randint(2, 5))) + f"({rng.randrange(999)});",
        lambda: "".join(rng.choices("é😀ñ日abc ", k=rng.randint(1, 40))) + "x",
    ]
    lines = [rng.choice(kinds)() for _ in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    lines += [" ".join([*rng.choices(words, k=rng.randint(5, 25)), passage, *rng.choices(words, k=5)]) for _ in range(120)]
    lines += [mutated(rng, rng.choice(lines), rng.randint(1, 4)) for _ in range(700)]
    return lines


def test_recall_and_precision_on_character_shingles(spark, docs):
    cut = lambda line: frozenset(line[i : i + 9] for i in range(max(1, len(line) - 8)))
    rows = [(i, line) for i, line in enumerate(many_kinds(random.Random(8)))]
    for many in (line_dedup.MANY, 4):  # with and without prefix filtering
        _, found, _ = line_dedup.line_components(docs(rows), many=many)
        root = {r.node: r.root for r in found.collect()}
        ids = {r.line: r.id for r in line_dedup._numbered(docs(rows), "doc_id", "text").select("line", "id").collect()}
        lines = sorted(ids)
        sets = [cut(x) for x in lines]
        links = [(a, b) for i, a in enumerate(lines) for j, b in enumerate(lines[:i]) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        joined = sum(ids[a] in root and ids[b] in root and root[ids[a]] == root[ids[b]] for a, b in links)
        assert len(links) > 200 and joined >= 0.99 * len(links)
        whole = components(lines, links)
        by_id = {v: k for k, v in ids.items()}
        for node, r in root.items():  # nothing is joined that is not linked
            assert whole[by_id[node]] == whole[by_id[r]]


def test_marks_bound_similarity_from_above(spark):
    from pyspark.sql import functions as F

    lines = sorted(set(many_kinds(random.Random(9))))[:150]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id long, line string")
    marked = line_dedup.marks(frame, 150).join(frame, "id")
    pairs = marked.toDF("a", "marks_a", "line_a").join(marked.toDF("b", "marks_b", "line_b"), F.col("a") < F.col("b"))
    got = pairs.select("line_a", "line_b", line_dedup._may_be_similar("marks_a", "marks_b", 0.5).alias("may"), line_dedup.similar_lines(F.col("line_a"), F.col("line_b"), 0.5).alias("is")).collect()
    cut = lambda line: frozenset(line[i : i + 9] for i in range(max(1, len(line) - 8)))
    for r in got:
        a, b = cut(r.line_a), cut(r.line_b)
        assert r["is"] == (10 * len(a & b) >= 5 * len(a | b)) and (r.may or not r["is"])
    assert sum(not r.may for r in got) > 0.8 * len(got)


def near_copies(rng, n):
    """Lines that are one line with one to twelve of its words replaced: many of them lie about the similarity that counts."""
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(300)]
    base = rng.choices(words, k=70)
    lines = []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(70), rng.randint(1, 12)):
            own[at] = rng.choice(words)
        lines.append(" ".join(own))
    return sorted(set(lines))


def test_a_dense_group_yields_few_pairs(spark, docs, monkeypatch):
    lines = near_copies(random.Random(11), 600)
    made, near = [], line_dedup._near
    monkeypatch.setattr(line_dedup, "_near", lambda *args: made.append(near(*args).count()) or near(*args))
    _, found, _ = line_dedup.line_components(docs(list(enumerate(lines))))
    root = {r.node: r.root for r in found.collect()}
    assert sum(made) <= len(lines)
    ids = {r.line: r.id for r in line_dedup._numbered(docs(list(enumerate(lines))), "doc_id", "text").select("line", "id").collect()}
    sets = [frozenset(x[i : i + 9] for i in range(len(x) - 8)) for x in lines]
    links = [(lines[i], lines[j]) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    whole = components(lines, links)
    assert len(links) > 10 * len(lines) and len(set(whole.values())) < len(lines)
    by_id = {v: k for k, v in ids.items()}
    assert all(whole[by_id[node]] == whole[by_id[r]] for node, r in root.items())
    joined = sum(root.get(ids[a], ids[a]) == root.get(ids[b], ids[b]) for a, b in links)
    assert joined >= 0.99 * len(links)


def test_marks_tell_lines_apart_that_share_most(spark):
    from pyspark.sql import functions as F

    lines = near_copies(random.Random(12), 150) + ["ab " * 40 + "cd", "ab " * 41 + "cd"]  # the last two: the same shingles, other numbers of times
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    marked = line_dedup.marks(frame, len(lines)).join(frame, "id")
    pairs = marked.toDF("a", "marks_a", "line_a").join(marked.toDF("b", "marks_b", "line_b"), F.col("a") < F.col("b"))
    got = pairs.select(line_dedup._may_be_similar("marks_a", "marks_b", 0.8).alias("may"), line_dedup.similar_lines(F.col("line_a"), F.col("line_b"), 0.8).alias("is")).collect()
    assert all(r.may or not r["is"] for r in got)
    assert sum(r["is"] for r in got) > 300 and sum(r.may and not r["is"] for r in got) < 0.5 * sum(r["is"] for r in got)


def test_signatures_and_marks_make_few_rows(spark, monkeypatch):
    """Shingles are not a row each, and minima, numbers and parities are those of shingles cut one by one."""
    from pyspark.sql import functions as F

    lines = sorted(set(many_kinds(random.Random(13))))[:200] + ["", "a", "nine char", "ten chars!", "é😀" * 40, "ab " * 40, "".join(chr(0x4E00 + i * 7 % 5000) for i in range(9_001)), "ab " * 2_000]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    made, hashed = [], line_dedup._hashed
    monkeypatch.setattr(line_dedup, "_hashed", lambda *args, **named: made.append(hashed(*args, **named).count()) or hashed(*args, **named))
    signed = {r.id: r for r in line_dedup.signatures(frame).collect()}
    marked = {r.id: r.marks for r in line_dedup.marks(frame, len(lines)).collect()}
    cut = [[x[i : i + 9] for i in range(max(1, len(x) - 8))] for x in lines]
    assert made[0] <= sum(map(len, cut)) // 8 + 2 * len(lines) and sum(made[1:]) <= sum(len(c) for c in cut if len(c) > 4_000)
    rows = spark.createDataFrame([(i, x, len(c)) for i, c in enumerate(cut) for x in set(c)], "id long, x string, n int").select("id", F.xxhash64(F.substring(F.encode("x", "utf-32"), 1, 36)).alias("h"))
    held = rows.groupBy("id").agg(F.collect_list("h").alias("h")).collect()
    assert len(held) == len(signed) == len(marked) == len(lines)
    for r in held:
        own = [h % 2**64 for h in r.h]
        turned = lambda h, b: (h << b | h >> 64 - b) % 2**64
        least = [min(turned(h, 64 * i // 10) ^ 1 << 63 for h in own) ^ 1 << 63 for i in range(10)]
        assert signed[r.id].n == 1 and signed[r.id].sketch == sum((m & 63) << 6 * i for i, m in enumerate(least))
        words = [0] * 32
        for h in own:
            words[h >> 6 & 31] ^= 1 << (h & 63)
        assert marked[r.id].size == len(own) and [marked[r.id][f"w{i}"] % 2**64 for i in range(32)] == words


def test_very_long_lines(spark, docs):
    rng = random.Random(10)
    long = "".join(rng.choices("abcdefghij klmnop", k=60_000)).strip()
    rows = [(1, long), (2, long[:30_000] + "#" + long[30_000:]), (3, "".join(rng.choices("abcdefghij klmnop", k=60_000))), (4, long[:40_000])]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1], 4: rows[3][1]}


def test_lines_run_no_python(spark, docs):
    frame = line_dedup.dedup_lines(docs([(1, "a b c\nd e f"), (2, "a b c")]))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sorted((r.doc_id, r.text) for r in frame.collect()) == [(1, "a b c\nd e f"), (2, "")]


@pytest.mark.parametrize("seed", range(3))
def test_union_find(spark, seed):
    rng = random.Random(seed)
    n = 200
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(7, None), (None, 8), (900, 900)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(frame)[0].collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert connected_components(frame.limit(0))[0].count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_dedup", "decontamination", "bpe"]
    held = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = held.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in held.collect()]
        held = stage(spark, held, sf)
        after = held.collect()
        assert {r.doc_id for r in after} <= {d for d, _ in before} and after
        if name != "bpe":
            assert held.columns == columns
            assert all(r.n_chars == len(r.text) for r in after)
        texts = {r.doc_id: r.text for r in after}
        if name == "line_dedup":
            want, _ = brute_dedup(before)
            wrong = [d for d, t in before if texts[d] != want[d, t]]
            assert len(wrong) <= 0.01 * len(before)
        elif name == "simhash_dedup":
            prints = {d: brute_print(t) for d, t in before}
            nodes = sorted(set(prints.values()))
            root = components(nodes, [(a, b) for a in nodes for b in nodes if (a ^ b).bit_count() <= 4])
            least = {}
            for d, p in prints.items():
                least[root[p]] = min(least.get(root[p], d), d)
            assert set(texts) == set(least.values())
        elif name == "decontamination":
            hits = {d: brute_hits(t, bench, 10) for d, t in before}
            assert any(h[1] for h in hits.values())
            assert all(texts[d] == t for d, t in before if not hits[d][1])
            assert not any(brute_hits(t, bench, 10)[1] for t in texts.values())
        elif name == "bpe":
            assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in after)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.text) for r in whole.collect()) == sorted(texts.items())


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert any(q.startswith(f"op{n}_") for q in names)
    assert "pipeline" in names and "op10_quality_rules" in __spark_entry__.oracle_sql()
