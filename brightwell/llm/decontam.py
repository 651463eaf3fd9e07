"""Benchmark decontamination with a generalised suffix automaton over the test items' words.

The automaton is built once from the benchmark's normalised words and streamed over each
document: at every word it holds the longest suffix of the words so far that occurs in some
item. A match of at least `window` words, or one that is a whole shorter item, marks its words
as hit. Documents are read once and nothing is shuffled. The items' words are dealt, in pieces
that overlap by a window less a word, to as many automata as their size needs, each of a bounded
number of bytes and built by an executor into a file of the shared folder; a task holds a few of
them at a time and lets each batch of texts pass one after another.

Defined cases: a null text or item has no words; an item without words is ignored; the windows of
an item whose id is null hit words like any other, but there is no id to report; items that repeat
an id count once; rows that repeat are each judged; a very long text or item is taken whole. An
empty benchmark finds nothing, and an empty table gives an empty table. Columns of the documents
are kept whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightwell.llm.shared import file_system, map_rows, pieces, put_file, shared_path, small_batches

#: UTF-8 bytes of words: digits, letters and everything outside ASCII; A-Z lower-cased.
_WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20) for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of item words in one automaton, about, and in one piece of an item at most; automata held by a task.
AUTOMATON_BYTES, PIECE_BYTES, HELD = 1 << 20, 1 << 18, 4
_FILTER_BITS = 22


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of (item_id, words) with the items of every window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        for _, seq in items:
            for w in seq:
                self.vocab.setdefault(w, len(self.vocab))
        coded = [(k, [self.vocab[w] for w in seq]) for k, seq in items if seq]
        self.next, self.link, self.len = [{}], [-1], [0]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.least = min((min(window, len(seq)) for _, seq in coded), default=0)
        self._mark(coded)
        self.pairs = np.zeros(1 << _FILTER_BITS, bool)
        for _, seq in coded:
            if len(seq) > 1:
                a = np.asarray(seq, np.int64)
                self.pairs[self._pair(a[:-1], a[1:])] = True

    @staticmethod
    def _pair(a, b):
        return (a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) & ((1 << _FILTER_BITS) - 1)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        n = len(self.next)
        self.win, self.short_near = [-1] * n, [-1] * n
        self.items: dict[int, set[str]] = {}  # of window states
        self.shorts: dict[int, dict[int, set[str]]] = {}  # of states that are whole short items, by length
        order = sorted(range(1, n), key=self.len.__getitem__)
        for v in order:
            if self.len[v] >= self.window:
                self.win[v] = v if self.len[self.link[v]] < self.window else self.win[self.link[v]]
        for k, seq in coded:
            v = 0
            for w in seq:
                v = self.next[v][w]
                if self.win[v] >= 0 and len(seq) >= self.window:
                    self.items.setdefault(self.win[v], set()).add(k)
            if len(seq) < self.window:
                self.shorts.setdefault(v, {}).setdefault(len(seq), set()).add(k)
        # A prefix state of an item may be shorter than the window although its state is long.
        for k, seq in coded:
            v = 0
            for i, w in enumerate(seq):
                v = self.next[v][w]
                if i + 1 < self.window and len(seq) >= self.window and self.win[v] >= 0 and k in self.items.get(self.win[v], ()) and not self._has(seq, v):
                    self.items[self.win[v]].discard(k)
        for v in order:
            self.short_near[v] = v if v in self.shorts else self.short_near[self.link[v]]

    def _has(self, seq: list[int], window_state: int) -> bool:
        """Whether a window of seq ends in this state's window state."""
        v = 0
        for i, w in enumerate(seq):
            v = self.next[v][w]
            if i + 1 >= self.window and self.win[v] == self.win[window_state]:
                return True
        return False

    def match(self, seq: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Spans [start, end) of hit words, apart and in order, and the items with windows there."""
        if not self.least or len(seq) < self.least:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, seq, itertools.repeat(-1)), np.int64, len(seq))
        if self.least > 1:
            ok = self.pairs[self._pair(ids[:-1], ids[1:])] & (ids[:-1] >= 0) & (ids[1:] >= 0)
            need = self.least - 1
        else:
            ok, need = ids >= 0, 1
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= need
        spans: list[list[int]] = []
        states: set[int] = set()
        shorts: set[tuple[int, int]] = set()
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            self._stream(ids[a : b + (self.least > 1)].tolist(), a, spans, states, shorts)
        found = set().union(*(self.items[v] for v in states)) if states else set()
        for v, n in shorts:
            found |= self.shorts[v][n]
        return spans, found

    def _stream(self, ids: list[int], base: int, spans: list, states: set, shorts: set) -> None:
        nxt, link, length, window = self.next, self.link, self.len, self.window
        v = n = 0
        for i, w in enumerate(ids, base):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            reach = 0
            if n >= window:
                reach = n
                states.add(self.win[v])
            u = self.short_near[v]
            while u > 0:
                for m in self.shorts[u]:
                    if m <= n:
                        shorts.add((u, m))
                        reach = max(reach, m)
                u = self.short_near[link[u]] if link[u] > 0 else -1
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])


def _merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def cut(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join(out) + text[at:]


_RANGE = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))
FOUND = T.StructType().add("n_words", T.LongType()).add("n_hit", T.LongType()).add("items", T.ArrayType(T.StringType())).add("spans", _RANGE).add("cleaned", T.StringType())
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _item_pieces(window: int, most_bytes: int):
    """(item, words) of pieces of each item that hold all its windows, words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, held = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                seq, start = words(text or b""), 0
                while seq:
                    end, size = start, 0
                    while end < len(seq) and (size < most_bytes or end < start + window):
                        size += len(seq[end]) + 1
                        end += 1
                    names.append(item)
                    held.append(b" ".join(seq[start:end]))
                    if end == len(seq):
                        break
                    start = end - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], names=["item", "words"])

    return run


def _build(folder: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, set[tuple[str | None, bytes]]] = {}
        for batch in batches:
            for part, item, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(part, set()).add((item, held))
        for part, rows in parts.items():
            ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1]))
            put_file(folder, f"automaton-{part}", pickle.dumps(Automaton([(i, held.split(b" ")) for i, held in ordered], window)))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], names=["part"])

    return run


@functools.lru_cache(HELD)
def _automaton(folder: str, part: int) -> Automaton:
    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/automaton-{part}") as f:
        return pickle.loads(f.read())


def automata(benchmark: DataFrame, window: int, id_col: str, text_col: str, most_bytes: int = AUTOMATON_BYTES, piece_bytes: int = PIECE_BYTES) -> tuple[str, list[int]]:
    """The folder of the automata over the benchmark, and the numbers of these."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("words")).where("words is not null").distinct()
    held = items.mapInArrow(_item_pieces(window, piece_bytes), "item string, words binary")
    total = held.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    n, folder = max(1, -(-total // most_bytes)), shared_path(benchmark.sparkSession, "automata")
    dealt = held.select(F.pmod(F.xxhash64("item", "words"), F.lit(n)).alias("part"), "item", "words").repartition(n, "part")
    return folder, sorted(r["part"] for r in dealt.mapInArrow(_build(folder, window), "part long").collect())


def _matcher(folder: str, parts: list[int]):
    def match(seqs: list[list[bytes]]) -> list[tuple[list[list[int]], set[str | None]]]:
        """Spans and items of each text, one automaton after another."""
        out: list[tuple[list[list[int]], set[str | None]]] = [([], set()) for _ in seqs]
        for part in parts:
            automaton = _automaton(folder, part)
            for i, seq in enumerate(seqs):
                spans, items = automaton.match(seq)
                if spans:
                    out[i] = (_merge(out[i][0], spans) if out[i][0] else spans, out[i][1] | items)
        return out

    return match


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", clean: bool = False) -> DataFrame:
    """(row, found) for every document: found holds n_words, n_hit, items, spans and, if asked, the cleaned text.

    Cleaning removes spans until no window is left, so that words which a removal brings
    together cannot form a new one. See the module for nulls and other special cases.
    """
    match = _matcher(*automata(benchmark, window, item_col, item_text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                seqs = [words(t) for t in texts]
                matched = match(seqs)
                kept: dict[int, bytes] = {}
                left = {i: spans for i, (spans, _) in enumerate(matched) if spans} if clean else {}
                while left:
                    kept |= {i: cut(kept.get(i, texts[i]), spans) for i, spans in left.items()}
                    again = match([words(kept[i]) for i in left])
                    left = {i: spans for i, (spans, _) in zip(left, again, strict=True) if spans}
                out = [
                    (len(seq), sum(e - s for s, e in spans), sorted(i for i in items if i is not None), [{"start": s, "end": e} for s, e in spans], kept[i].decode("utf-8", "replace") if i in kept else None)
                    for i, (seq, (spans, items)) in enumerate(zip(seqs, matched, strict=True))
                ]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                found = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.string()), _SPAN, pa.string()), strict=True)], names=FOUND.names)
                yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "found"])

    return map_rows(docs, [F.col(f"`{text_col}`").cast("string").alias("words")], run, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_coverage: float = 0.5, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """Documents without the benchmark's passages, with the columns of docs.

    A document of whose words more than most_coverage are hit goes; from any other the hit spans
    are removed and length_col, if there, is counted anew. Documents without a hit stay as they are.
    """
    found = find_spans(docs, benchmark, window, text_col, clean=True)
    hit, text = F.col("found.n_hit") > 0, F.col("found.cleaned")
    kept = found.where(F.col("found.n_hit") <= most_coverage * F.col("found.n_words"))
    out = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        new = text if c == text_col else F.length(text).cast(docs.schema[c].dataType) if c == length_col else None
        out.append((old if new is None else F.when(hit, new).otherwise(old)).alias(c))
    return kept.select(*out)


