"""Byte-level BPE by forced boundaries, from a tokenizer file that is a parameter.

Two neighbouring bytes that occur inside no vocabulary token can never be merged, so a text may
be cut between them without changing its tokens. Texts are first cut where white space follows
another character: such bytes are a pair of this kind, and the pre-tokenizer's pattern starts anew
there too, so each fragment is encoded on its own, once, and the results are joined. Inside a
fragment the pattern's pieces are cut at every forced pair before merging.

Defined cases: a null text is the empty text and has no tokens; the string of an added token in a
text becomes that token, as the tokenizers library has it; rows that repeat are each encoded;
other columns are kept whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightwell.llm.shared import map_rows, pieces

#: The pre-tokenizer's pattern, a fixed value of this kind of tokenizer file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's White_Space, which \s means in the pattern.
WIDE_SPACES = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = r"\t-\r " + WIDE_SPACES
ASCII_SPACES = "\t\n\x0b\x0c\r "
_CACHE_ITEMS, _CACHE_CHARS, _NEVER = 300_000, 64, 1 << 62


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the file: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if chr(b) not in table:
            table[chr(0x100 + extra)] = b
            extra += 1
    return table


class _Cache(dict):
    """Token bytes of each fragment; emptied when full, and long fragments are not kept.

    A word with one mark behind it is two pieces of the pattern, so only the word is kept.
    """

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, fragment: str) -> bytes:
        if fragment[-1] in ",.!?:;" and (fragment[1:-1] if fragment[0] == " " else fragment[:-1]).isalpha():
            return self[fragment[:-1]] + self[fragment[-1]]
        ids = self.encode(fragment)
        if len(fragment) <= _CACHE_CHARS:
            if len(self) >= _CACHE_ITEMS:
                self.clear()
            self[fragment] = ids
        return ids


class ForcedBPE:
    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        chars = byte_characters()
        raw = lambda s: bytes(chars[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in self.added.items():
            self.tokens[i] = t.encode()
        #: The place of each merge in the file, and the token that it makes.
        ranks: dict[tuple[int, int], int] = {}
        self.rank, self.made = ranks.get, []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = raw(a), raw(b)
            ranks[self.ids[a], self.ids[b]] = r
            self.made.append(self.ids[a + b])
        self.inside = np.zeros((256, 256), bool)
        for t in self.ids:
            if len(t) > 1:
                a = np.frombuffer(t, np.uint8)
                self.inside[a[:-1], a[1:]] = True
        self.pairs = set(zip(*(x.tolist() for x in np.nonzero(self.inside)), strict=True))
        # After an ASCII character, white space begins a fragment because no token holds such a pair;
        # after a wider character, because the pattern never joins a non-space with space behind it.
        spaces = [ord(c) for c in ASCII_SPACES]
        if any(self.inside[b, c] for b in range(128) if b not in spaces for c in spaces):
            raise ValueError("a token of this file holds white space after an ASCII character")
        self.fragments = re.compile(rf"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
        self.pattern = regex.compile(PATTERN.replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]").replace(rf"[^[{SPACES}]", rf"[^{SPACES}"))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.single = [self.ids[bytes((b,))] for b in range(256)]
        #: Tokens that their own bytes merge into: found once by merging, not assumed.
        self.known: set[bytes] = set()
        self.known = {t for t, i in self.ids.items() if self._merge(t) == [i]}
        self.cache = _Cache(self._fragment)

    def _fragment(self, fragment: str) -> bytes:
        # A fragment of letters, with or without a space before, is one piece of the pattern.
        letters = fragment[1:] if fragment[0] == " " else fragment
        if letters.isalpha():
            return self._piece(fragment)
        return b"".join(map(self._piece, self.pattern.findall(fragment)))

    def _piece(self, piece: str) -> bytes:
        data, inside, out, start = piece.encode("utf-8", "surrogatepass"), self.pairs, [], 0
        for i, pair in enumerate(zip(data, data[1:]), 1):
            if pair not in inside:
                out += self._merge(data[start:i])
                start = i
        out += self._merge(data[start:])
        return array("i", out).tobytes()

    def _merge(self, data: bytes) -> list[int]:
        if data in self.known:
            return [self.ids[data]]
        ids, rank, made = [self.single[b] for b in data], self.rank, self.made
        if len(ids) <= 64:
            ranks = [rank(p, _NEVER) for p in zip(ids, ids[1:])]
            while ranks and (least := min(ranks)) < _NEVER:
                i = ranks.index(least)
                ids[i] = made[least]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank((ids[i - 1], ids[i]), _NEVER)
                if i < len(ranks):
                    ranks[i] = rank((ids[i], ids[i + 1]), _NEVER)
            return ids
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]), _NEVER)) < _NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            new = made[r]
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((new, ids[k]), _NEVER)) < _NEVER:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (p := before[i]) >= 0 and (r := rank((ids[p], new), _NEVER)) < _NEVER:
                heapq.heappush(heap, (r, p, ids[p], new))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Token ids as bytes of native 32-bit integers."""
        get, cut = self.cache.__getitem__, self.fragments
        if self.split and any(t in text for t in self.added):
            return b"".join(array("i", [self.added[part]]).tobytes() if part in self.added else b"".join(map(get, cut(part))) for part in self.split(text))
        return b"".join(map(get, cut(text)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(2)
def _loaded(tokenizer_json: str) -> ForcedBPE:
    return ForcedBPE(tokenizer_json)


IDS, TEXT = T.StructType().add("ids", T.ArrayType(T.IntegerType())), T.StructType().add("decoded", T.StringType())


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(row, found.ids) for each row. The file is read on the driver and sent along; it is of fixed size."""
    with open(tokenizer_path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(held.value)
        for whole in batches:
            for batch in pieces(whole, 1, 1 << 20):
                found = [bpe.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays([ids], names=["ids"])], names=["row", "found"])

    return map_rows(docs, [F.col(text_col).cast("string").alias("words")], run, IDS)


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """(row, found.decoded) for each row with token ids; null ids decode to the empty text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column(1)
                values, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).tolist()
                text = pa.array([bpe.decode(values[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays([text], names=["decoded"])], names=["row", "found"])

    return map_rows(rows, [F.col(ids_col).cast("array<int>").alias("ids")], run, TEXT)
