"""SimHash near-duplicates with a covering family of bit masks.

Each bit position i has a vector phi(i) of radius+1 bits; table v (any non-zero vector) keeps
the positions whose phi(i) has an odd overlap with v. At most `radius` differing positions span
less than the whole space, so some v is orthogonal to all of them and that table's masked
fingerprints are equal: every pair within the radius meets in a table, for certain.

Only distinct fingerprints go to the tables, so copies, however many, are one row there. What
shares a masked value is searched breadth-first, emitting a spanning forest of true links and
never all pairs; the forests of all tables meet in a distributed union-find.

Defined cases: a null text, or one without words, has fingerprint zero and links like any other;
a null id is a row of its own and never names a component unless a component has no other id
(then component_id is null); rows that repeat have one component. An empty table gives an empty
table. Other columns are ignored by near_duplicates and kept by keep_one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.llm.components import connected_components
from brightwell.llm.shared import lean, pieces, small_batches, written

BITS = 64
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of each run of width words, joined by one space; of all words if there are fewer."""
    seq = text.translate(_LOWER).split()
    if not seq:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(seq)
    if len(seq) <= width:
        return [digest(joined, seed)]
    ends = (np.cumsum([len(w) + 1 for w in seq]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :])]


def fingerprint(hashes: list[int]) -> int:
    """Bit set where over half the hashes have it."""
    if not hashes:
        return 0
    held = np.array(hashes, np.uint64)
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(held), 1 << 16):
        bits = np.unpackbits(held[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(held), bitorder="little").view(np.uint64)[0])


def covering_masks(radius: int) -> list[int]:
    """2**(radius+1)-1 masks of which, for any radius positions, one holds none of them."""
    n = (2 << radius) - 1
    phi = [1 + i % n for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the link graph on distinct prints: exact, each a true link."""
    left, edges = prints, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            taken = np.full(len(left), -1, np.int64)
            step = max(1, (1 << 21) // len(left))
            for at in range(0, len(front), step):
                open_ = np.flatnonzero(taken < 0)
                if not len(open_):
                    break
                near = np.bitwise_count(front[at : at + step, None] ^ left[None, open_]) <= radius
                hit = near.any(axis=0)
                taken[open_[hit]] = at + near.argmax(axis=0)[hit]
            got = taken >= 0
            edges += zip(front[taken[got]].tolist(), left[got].tolist(), strict=True)
            front, left = left[got], left[~got]
    return edges


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                found = np.array([fingerprint(shingle_hashes(t or b"", width, seed)) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "print", "row_hash"])

    return run


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by table and masked value; the last group of a batch waits for the next."""
        waiting: list[np.ndarray] = []
        key = None

        def found(prints: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            a, b = prints[two], prints[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            edges = [(a[near], b[near])]
            for s, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if more := forest(prints[s : s + n], radius):
                    edges.append(tuple(np.array(x, np.uint64) for x in zip(*more, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[i] for e in edges]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table, masked, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            prints = prints.view(np.uint64)
            cut = np.flatnonzero((np.diff(table) != 0) | (np.diff(masked) != 0)) + 1
            if key == (table[0], masked[0]):
                if not len(cut):
                    waiting.append(prints)
                    continue
                waiting.append(prints[: cut[0]])
                first = int(cut[0])
            else:
                first = 0
            if waiting:
                group = np.concatenate(waiting)
                if len(group) > 1:
                    yield found(group, np.array([0, len(group)]))
            last = int(cut[-1]) if len(cut) else 0
            bounds = np.array([first, *cut[cut > first].tolist()], np.int64)
            if len(bounds) > 1:
                yield found(prints, bounds)
            waiting, key = [prints[last:]], (table[-1], masked[-1])
        if waiting:
            group = np.concatenate(waiting)
            if len(group) > 1:
                yield found(group, np.array([0, len(group)]))

    return run


def fingerprint_rows(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print, row_hash) of every row; row_hash tells rows of one id apart by their text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("words"), F.xxhash64(F.col(text_col).cast("string")).alias("row_hash"))
    return rows.mapInArrow(lean(_fingerprints(width, seed)), "doc_id long, print long, row_hash long")


def link_edges(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Forest edges (a, b) over distinct prints, from all tables of the covering family."""
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    dealt = prints.select("print", F.posexplode(F.array(*map(F.lit, masks))).alias("table", "mask")).select("table", F.col("print").bitwiseAND(F.col("mask")).alias("masked"), "print")
    return dealt.repartition("table", "masked").sortWithinPartitions("table", "masked").mapInArrow(lean(_links(radius)), "a long, b long")


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """(print, root) of each distinct print."""
    prints = rows.select("print").distinct()
    edges, _ = written(link_edges(prints, radius).distinct(), "simhash-edges")
    roots, _ = connected_components(edges, "simhash")
    return prints.join(roots, prints["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint of 16 hex digits, component_id) for every row of docs."""
    rows, _ = written(fingerprint_rows(docs, width, seed, id_col, text_col), "simhash-rows")
    classes, _ = written(_classes(rows, radius), "simhash-classes")
    ids = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    least = ids.join(classes, "print").groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id (null last), with the columns of docs."""
    rows, _ = written(fingerprint_rows(docs, width, seed, id_col, text_col), "simhash-rows")
    classes = _classes(rows, radius)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")
    per_print = rows.groupBy("print").agg(F.min(order).alias("first"))
    first = per_print.join(classes, "print").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.row_hash")
    keepers, _ = written(first.join(rows.groupBy("doc_id", "row_hash").agg(F.count("*").alias("copies")), (F.col("copies") > 0) & first["doc_id"].eqNullSafe(rows["doc_id"]) & (first["row_hash"] == rows["row_hash"])).select(first["doc_id"].alias("kept_id"), first["row_hash"].alias("kept_hash"), "copies"), "simhash-keepers")
    own_id, own_hash = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))

    def those(which: DataFrame) -> DataFrame:
        which = which.select("kept_id", "kept_hash")
        return docs.join(which, own_id.eqNullSafe(which["kept_id"]) & (own_hash == which["kept_hash"]), "left_semi")

    single = those(keepers.where("copies = 1"))
    if keepers.where("copies > 1").limit(1).count():
        single = single.unionByName(those(keepers.where("copies > 1")).dropDuplicates([id_col, text_col]))
    return single
