"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Training: each task counts its tokens, sorted and compressed, by shard of the hash space; a shard's
words in hash order get consecutive numbers, and its sorted hashes (Elias-Fano) and exact counts
are level one. With words numbered, each token is counted once more with the two before it, by
shard of the first of the three; those of the few first words that are frequent enough to fill a
shard on their own are dealt by the second word. A shard then has
    level two: monotone pointers from each first word to its range of second words,
    level three: monotone pointers from each pair of level two to its range of third words.
Within its range a word has its number relative to where the range begins, so that each level is
one monotone sequence; it is found by a successor search between its context's two pointers. Each
pair and triple has its discounted log10 probability, the first term below, and each pair its
back-off weight, in 8 bits. The levels are files in the shared folder that scoring tasks map into memory; a folder that
is no local path is fetched shard by shard, each of bounded size.

Model: interpolated Witten-Bell, order three. With c counts, T(h) the number of different words
seen after h, N all training tokens and V the different ones,
    p1(w) = (c(w) + 1) / (N + V + 1)
    p(w | u) = c(u w) / (c(u) + T(u)) + T(u) / (c(u) + T(u)) p1(w), and p1(w) after an unseen u
    p(w | t u) = c(t u w) / (c(t u) + T(t u)) + T(t u) / (c(t u) + T(t u)) p(w | u), and p(w | u) after
    an unseen t u.
The end token also stands before a text's first word, which has that one word of context. Each
distribution sums to one over the V words and one unknown word. Words are told apart by 64-bit
hashes.

Defined cases: a null text is the empty one, of one end token; a null id counts as the empty
string, whose checksum puts it in training; rows that repeat are each learned and scored; a very
long text is scored as a whole, in arrays of its length. Without any training text every token is
unknown, and an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.llm.elias_fano import EliasFano, stored
from brightwell.llm.shared import drop_path, file_system, lean, pieces, put_file, shared_path, small_batches, written

_U = np.uint64
_HASH = xxhash.xxh64_intdigest
END = _HASH(b"")
#: Step of the quantised log10 probabilities and back-off weights; code 255 stands for the least.
STEP = 0.05
_POWER = 10.0 ** (-STEP * np.arange(256))
_HELD_KEYS = 1_500_000
COUNTED = "shard int, payload binary"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the different tokens, the place among them of each token, and where each text begins.

    A text's tokens are its words and one end.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, ends = split.flatten(), np.diff(split.offsets.to_numpy())
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    held = words.filter(pa.array(real)).dictionary_encode()
    hashes = np.fromiter(map(_HASH, [b"", *held.dictionary.cast(pa.binary()).to_pylist()]), _U, len(held.dictionary) + 1)
    unique, place = np.unique(hashes, return_inverse=True)
    text_of = np.repeat(np.arange(len(texts)), ends)[real]
    size = np.bincount(text_of, minlength=len(texts)) + 1
    starts = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    flat = np.full(starts[-1], place[0], np.int64)
    flat[np.arange(len(text_of)) + text_of] = place[1 + held.indices.to_numpy()]  # one end for each text before
    return unique, flat, starts


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers, the first as differences, by byte plane, compressed."""
    n = len(columns[0])
    frame = zstandard.ZstdCompressor(level=1).compressobj(size=8 + 8 * n * len(columns))
    parts = [frame.compress(np.array([n], _U).tobytes())]
    for i, x in enumerate(columns):  # one after another: a shard's columns are large
        x = x.astype(_U, copy=False) if i else np.diff(x, prepend=_U(0))
        parts.append(frame.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).ravel()))
    return b"".join([*parts, frame.flush()])


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw[:8], _U)[0])
    step, *rest = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 + i * 8 * n).reshape(8, n).T).view(_U).ravel() for i in range(columns))
    return [np.cumsum(step, dtype=_U), *rest]


def tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key, sorted."""
    if not keys:
        return np.zeros(0, _U), np.zeros(0, _U)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _map(folder: str, name: str) -> np.ndarray:
    fs, root = file_system(folder)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.asarray(np.memmap(f"{root}/{name}", np.uint8, "r"))
    with fs.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read_buffer(), np.uint8)


@functools.lru_cache(64)
def _words(folder: str, shard: int) -> tuple[EliasFano, np.ndarray]:
    data = _map(folder, f"words-{shard}")
    held, at = EliasFano.restore(data, 0)
    return held, data[at : at + 8 * held.n].view(_U)


class Level:
    """A level of a shard's trie: pointers from contexts to ranges of words, and their codes.

    A context's words stand relative to the place where its range begins, context * n_words, so
    that the whole level is one monotone sequence.
    """

    def __init__(self, pointers: EliasFano, words: EliasFano, codes: np.ndarray):
        self.pointers, self.words, self.codes = pointers, words, codes

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, n_contexts: int, n_words: int) -> list[np.ndarray]:
        """Arrays of the pointers and words of sorted pairs of (context, word)."""
        ends = np.concatenate(([0], np.cumsum(np.bincount(context, minlength=n_contexts)))).astype(_U)
        return [*EliasFano.build(ends).dump(), *EliasFano.build(context.astype(_U) * _U(n_words) + word.astype(_U)).dump()]

    @classmethod
    def restore(cls, data: np.ndarray, at: int) -> tuple[Level, int]:
        pointers, at = EliasFano.restore(data, at)
        words, at = EliasFano.restore(data, at)
        return cls(pointers, words, data[at : at + words.n]), at + -(-words.n // 8) * 8

    def find(self, context: np.ndarray, back: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Position of each word between the pointers of context[back], and whether it is there."""
        lo, hi = (x.astype(np.int64) for x in self.pointers.access_two(context))
        return self.words.search(context[back].astype(_U) * _U(n_words) + word.astype(_U), lo[back], hi[back])


@functools.lru_cache(64)
def _grams(folder: str, shard: int) -> tuple[Level, np.ndarray, Level]:
    """Level two, its back-off codes, level three."""
    data = _map(folder, f"grams-{shard}")
    two, at = Level.restore(data, 0)
    back_off = data[at : at + two.words.n]
    three, _ = Level.restore(data, at + -(-two.words.n // 8) * 8)
    return two, back_off, three


def _coded(share: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log10(share) / -STEP), 0, 255).astype(np.uint8)


class Model:
    """What the driver knows of a trained model; everything else is in the folder's levels."""

    def __init__(self, folder: str, bits: int, bases: np.ndarray, n_tokens: int):
        self.folder, self.bits, self.bases, self.n_tokens = folder, bits, bases, n_tokens
        self.n_words = int(bases[-1])
        self.hot, self.hot_types = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each of the sorted hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> _U(64 - self.bits)).astype(np.int64)
        for s in np.unique(shard).tolist():
            a, b = np.searchsorted(shard, [s, s + 1])
            held, counts = _words(self.folder, s)
            at, equal = held.successor(hashes[a:b])
            where = np.flatnonzero(equal)
            number[a + where] = self.bases[s] + at[where]
            count[a + where] = counts[at[where]]
        return number, count

    def one(self, counts: np.ndarray) -> np.ndarray:
        """p1 of words of these counts."""
        return (counts + 1) / (self.n_tokens + self.n_words + 1)

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words by number, in any order."""
        out = np.zeros(len(numbers), np.int64)
        for s, own in _by_shard(np.searchsorted(self.bases, numbers, side="right") - 1):
            out[own] = _words(self.folder, s)[1][numbers[own] - self.bases[s]]
        return out

    def hot_rank(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank among the frequent words, and whether each is one of them."""
        at = np.searchsorted(self.hot, t)
        return at, (at < len(self.hot)) & (self.hot[np.minimum(at, len(self.hot) - 1)] == t) if len(self.hot) else np.zeros(len(t), bool)

    def place(self, t: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard of each pair of numbers, and its first word's context number there: frequent ones follow the shard's own words."""
        shard = np.searchsorted(self.bases, t, side="right") - 1
        rank, hot = self.hot_rank(t)
        mixed = u[hot].astype(_U) * _U(0x9E3779B97F4A7C15)
        shard[hot] = (mixed >> _U(64 - self.bits)).astype(np.int64)
        size = self.bases[shard + 1] - self.bases[shard]
        return shard, np.where(hot, size + rank, t - self.bases[shard])

    def types(self, t: np.ndarray) -> np.ndarray:
        """T(t): from the pointers, or for frequent words from what the driver has summed."""
        out = np.zeros(len(t), np.int64)
        rank, hot = self.hot_rank(t)
        out[hot] = self.hot_types[rank[hot]]
        cold = np.flatnonzero(~hot)
        for s, own in _by_shard(np.searchsorted(self.bases, t[cold], side="right") - 1):
            i = t[cold[own]] - self.bases[s]
            lo, hi = _grams(self.folder, s)[0].pointers.access_two(i)
            out[cold[own]] = (hi - lo).astype(np.int64)
        return out

    def probabilities(self, number: np.ndarray, count: np.ndarray, before: np.ndarray, now: np.ndarray, pair: np.ndarray, following: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """p1 of words, p(now | before) of pairs, and that of each triple (pair, following); following -1: none.

        before, now and following are places in number and count; pair and short, the pair of a
        triple's last two words, are places among the pairs. Pairs and triples are each sorted.
        """
        one = self.one(count)
        types = np.zeros(len(number))
        known = np.flatnonzero(number >= 0)
        types[known] = self.types(number[known])
        two = np.where(types[before] > 0, types[before] / np.maximum(count[before] + types[before], 1), 1) * one[now]
        both = np.flatnonzero((number[before] >= 0) & (number[now] >= 0))
        shard, context = self.place(number[before[both]], number[now[both]])
        shard_of, at_pair, back_off = np.full(len(before), -1, np.int64), np.full(len(before), -1, np.int64), np.ones(len(before))
        shard_of[both] = shard
        for s, own in _by_shard(shard):
            level, weights, _ = _grams(self.folder, s)
            held, back = np.unique(context[own], return_inverse=True)
            at, equal = level.find(held, back, number[now[both[own]]], self.n_words)
            where, at = both[own[equal]], at[equal]
            two[where] += _POWER[level.codes[at]]
            back_off[where], at_pair[where] = _POWER[weights[at]], at
        three = back_off[pair] * two[short]
        seen = np.flatnonzero((following >= 0) & (at_pair[pair] >= 0) & (number[following] >= 0))
        for s, own in _by_shard(shard_of[pair[seen]]):
            level = _grams(self.folder, s)[2]
            held, back = np.unique(at_pair[pair[seen[own]]], return_inverse=True)
            at, equal = level.find(held, back, number[following[seen[own]]], self.n_words)
            three[seen[own[equal]]] += _POWER[level.codes[at[equal]]]
        return one, two, three

    def score(self, unique: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) of each text of a batch from tokens()."""
        number, count = self.lookup(unique)
        (before, now, back_pair), (pair, following, back_triple) = windows(flat, starts, int(np.searchsorted(unique, _U(END))), len(unique))
        short = np.empty(len(pair), np.int64)
        short[back_triple] = np.concatenate((back_pair[1:], [0]))  # the following token's pair
        one, two, three = map(np.log10, self.probabilities(number, count, before, now, pair, following, short))
        at = starts[:-1]
        value = np.empty(len(flat))
        value[1:] = three[back_triple[:-1]]  # a token's triple begins with the one two before it
        value[at] = two[back_pair[at]]
        return np.add.reduceat((count[flat] > 0).astype(np.int64), at), np.add.reduceat(one[flat], at), np.add.reduceat(value, at)


def windows(flat: np.ndarray, starts: np.ndarray, end: int, n: int):
    """The different pairs (before, now) and triples (pair, following) of the n tokens' places, and those of each token.

    following is -1 at a text's end. Both are sorted by their parts.
    """
    before = np.concatenate(([end], flat[:-1])).astype(np.int64)
    before[starts[:-1]] = end  # the end token stands before the first word
    key, back_pair = np.unique(before * n + flat, return_inverse=True)
    following = np.concatenate((flat[1:], [-1])).astype(np.int64)
    following[starts[1:] - 1] = -1
    triple, back_triple = np.unique(back_pair * (n + 1) + following + 1, return_inverse=True)
    return (key // n, key % n, back_pair), (triple // (n + 1), triple % (n + 1) - 1, back_triple)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places that have it, in order."""
    order = np.argsort(shard, kind="stable")
    edges = [*np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist(), len(order)]
    for a, b in zip(edges, edges[1:]):
        yield int(shard[order[a]]), order[a:b]


def _payloads(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], names=["shard", "payload"])


def _count_words(bits: int):
    """Sorted, compressed counts of words for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_c, size = [], [], 0

        def flush():
            k, c = tally(held_k, held_c)
            return _payloads([(s, pack(k[own], c[own])) for s, own in _by_shard((k >> _U(64 - bits)).astype(np.int64))])

        for whole in batches:
            for batch in pieces(whole, 0):
                unique, flat, _ = tokens(batch.column(0))
                count = np.bincount(flat, minlength=len(unique))
                held_k.append(unique[count > 0])
                held_c.append(count[count > 0].astype(_U))
                size += len(held_k[-1])
                if size > 2 * _HELD_KEYS:
                    k, c = tally(held_k, held_c)
                    held_k[:], held_c[:], size = [k], [c], len(k)
                    if size > _HELD_KEYS:
                        yield flush()
                        held_k, held_c, size = [], [], 0
        if held_k:
            yield flush()

    return run


def _count_triples(model: Model):
    """(context * V + second word, third word, count) of each batch for each shard; the third word V stands for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0, 6 << 20):
                unique, flat, starts = tokens(batch.column(0))
                number = model.lookup(unique)[0]
                (before, now, _), (pair, following, back) = windows(flat, starts, int(np.searchsorted(unique, _U(END))), len(unique))
                count = np.bincount(back)
                shard, context = model.place(number[before], number[now])
                key = context.astype(_U) * _U(model.n_words) + number[now].astype(_U)
                third = np.where(following < 0, model.n_words, number[following]).astype(_U)
                yield _payloads([(s, pack(key[pair[own]], third[own], count[own].astype(_U))) for s, own in _by_shard(shard[pair])])

    return run


def _merged(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of the last column by the others, sorted by these; columns is emptied."""
    *keys, count = (np.concatenate([c[i] for c in columns]) for i in range(len(columns[0])))
    columns.clear()
    if len(keys) == 2 and (int(keys[0].max()) + 1) * (int(keys[1].max()) + 1) < 1 << 64:
        order = np.argsort(keys[0] * (keys[1].max() + _U(1)) + keys[1], kind="stable")
    else:
        order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for i, k in enumerate(keys):
        keys[i] = k = k[order]
        new[1:] |= k[1:] != k[:-1]
    count, order = count[order], None
    first = np.flatnonzero(new)
    return [*(k[first] for k in keys), np.add.reduceat(count, first)]


def _gathered(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Summed counts of one shard after another; rows arrive by shard. Parts are summed as they come."""
    now, held, size, least = None, [], 0, 0
    for batch in batches:
        for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if shard != now and now is not None:
                yield now, _merged(held)
                held, size, least = [], 0, 0
            now = shard
            held.append(unpack(payload.as_buffer(), columns))
            size += len(held[-1][0])
            if size > max(_HELD_KEYS, 2 * least):
                held = [_merged(held)]
                size = least = len(held[0][0])
    if now is not None:
        yield now, _merged(held)


def _build_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (keys, counts) in _gathered(batches, 2):
            put_file(folder, f"words-{shard}", stored([*EliasFano.build(keys).dump(), counts]))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["shard", "words", "total"])

    return run


def _find_hot(folder: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                at = np.flatnonzero(_words(folder, shard)[1] >= least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(at)], names=["shard", "place"])

    return run


def _gather_triples(model: Model):
    """Writes each shard's counts: p(w | u) needs T(u), which for frequent words is known only when all shards are. The levels come in a second step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (key, third, count) in _gathered(batches, 3):
            put_file(model.folder, f"raw-{shard}", pack(key, third, count))
            context = key[np.concatenate(([True], key[1:] != key[:-1]))] // _U(model.n_words)
            size = int(model.bases[shard + 1] - model.bases[shard])
            hot, types = np.unique(context[context >= size].astype(np.int64) - size, return_counts=True)
            rows = [(shard, -1, 0), *zip([shard] * len(hot), model.hot[hot].tolist(), types.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["shard", "hot", "types"])

    return run


def _levels(model: Model, shard: int, key: np.ndarray, third: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Arrays of levels two and three from a shard's sorted counts."""
    v, count = _U(model.n_words), count.astype(np.int64)
    base, size = int(model.bases[shard]), int(model.bases[shard + 1] - model.bases[shard])
    n_contexts = size + len(model.hot)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    context, u = (key[first] // v).astype(np.int64), (key[first] % v).astype(np.int64)
    hot = context >= size
    t, types = context + base, np.bincount(context, minlength=n_contexts)[context]
    t[hot], types[hot] = model.hot[context[hot] - size], model.hot_types[context[hot] - size]
    of_pair = np.add.reduceat(count, first) if len(first) else count
    two = _coded(of_pair / (model.counts(t) + types))
    t = types = hot = None
    real = third < v
    pair = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(key)]))))[real]
    following = np.bincount(pair, minlength=len(first))  # 0 only for pairs that end in the end token
    back_off = _coded(np.where(following > 0, following / (of_pair + following), 1))
    three = _coded(count[real] / (of_pair + following)[pair])
    n_pairs, third = len(first), third[real]
    key = count = first = of_pair = real = following = None
    return [*Level.build(context, u, n_contexts, model.n_words), two, back_off, *Level.build(pair, third, n_pairs, model.n_words), three]


def _build_levels(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in (done := batch.column(0).to_pylist()):
                put_file(model.folder, f"grams-{shard}", stored(_levels(model, shard, *unpack(_map(model.folder, f"raw-{shard}").tobytes(), 3))))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], names=["shard"])

    return run


def _of_shards(df: DataFrame, n_shards: int) -> DataFrame:
    return df.repartition(n_shards, "shard").sortWithinPartitions("shard")


def train(texts: DataFrame, folder: str, bits: int) -> Model:
    """Train on the one column of texts; levels go to folder. 2**bits shards, each built in one task."""
    spark, n_shards = texts.sparkSession, 1 << bits
    counted = texts.mapInArrow(lean(_count_words(bits)), COUNTED)
    sizes = {r["shard"]: r for r in _of_shards(counted, n_shards).mapInArrow(lean(_build_words(folder)), "shard int, words long, total long").collect()}
    bases = np.concatenate(([0], np.cumsum([sizes[s]["words"] if s in sizes else 0 for s in range(n_shards)]))).astype(np.int64)
    for s in set(range(n_shards)) - set(sizes):  # of an all but empty corpus
        put_file(folder, f"words-{s}", stored([*EliasFano.build(np.zeros(0, _U)).dump(), np.zeros(0, _U)]))
    model = Model(folder, bits, bases, sum(r["total"] for r in sizes.values()))
    # At most 8 words a shard reach that count.
    shards = spark.range(0, n_shards, 1, min(n_shards, 4 * spark.sparkContext.defaultParallelism)).select(F.col("id").cast("int").alias("shard"))
    hot = shards.mapInArrow(lean(_find_hot(folder, max(1, model.n_tokens // (8 * n_shards)))), "shard int, place long").collect()
    model.hot = np.array(sorted(int(bases[r["shard"]]) + r["place"] for r in hot), np.int64)
    model.hot_types = np.zeros(len(model.hot), np.int64)
    triples = texts.mapInArrow(lean(_count_triples(model)), COUNTED)
    built, at = written(_of_shards(triples, n_shards).mapInArrow(lean(_gather_triples(model)), "shard int, hot long, types long"), "lm-hot")
    done = {r["shard"] for r in built.select("shard").distinct().collect()}
    for s in set(range(n_shards)) - done:
        put_file(folder, f"raw-{s}", pack(*[np.zeros(0, _U)] * 3))
    types = {r["hot"]: r["n"] for r in built.where("hot >= 0").groupBy("hot").agg(F.sum("types").alias("n")).collect()}
    drop_path(spark, at)
    model.hot_types = np.array([types.get(int(h), 0) for h in model.hot], np.int64)
    shards.mapInArrow(lean(_build_levels(model)), "shard int").agg(F.count("*")).collect()
    for s in range(n_shards):
        drop_path(spark, f"{folder}/raw-{s}")
    return model


def shard_bits(texts: DataFrame) -> int:
    """Shards of 16 MB of input, 8 at least, from the planner's size of the files.

    Where the planner does not know the size, the texts are measured.
    """
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 50:
        size = texts.agg(F.coalesce(F.sum(F.octet_length(texts.columns[0])), F.lit(0))).first()[0]
    return max(3, math.ceil(math.log2(max(1, size / (16 << 20)))))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0, 6 << 20):
                unique, flat, starts = tokens(batch.column(0))
                known, base, score = model.score(unique, flat, starts)
                arrays = [batch.column(1), batch.column(2), pa.array(np.diff(starts)), pa.array(known), pa.array(np.full(len(known), model.n_tokens, np.int64)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, folds: int = 7, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all folds but one and score every row: held_out, token counts, base and model log10 probability."""
    small_batches(docs.sparkSession)
    fold = F.crc32(F.encode(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), "UTF-8")) % folds
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("words"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), (fold == held_fold).alias("held_out"))
    model = train(rows.where(~F.col("held_out")).select("words"), shared_path(docs.sparkSession, "lm"), shard_bits(rows.select("words")))
    return rows.mapInArrow(lean(_scorer(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
