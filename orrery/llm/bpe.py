"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are whole entries of it; the others are
merged by a heap of adjoining pairs over a linked list of their bytes, least rank first, then leftmost. Decoding looks
up each id's bytes.

Defined results: a null text gives null ids, an empty text no ids; characters that UTF-8 can't hold (lone surrogates)
are replaced as str.encode does. Texts of any length are encoded whole; of pairs of one rank the leftmost merges. Ids that the vocabulary lacks decode to nothing. Repeated rows and ids each stand for
themselves, other columns are not looked at, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from ._shared import doc_columns
from ._tokens import PATTERN, TOKENIZERS, file_bytes, read_ranks, sliced

LOAD = 2
LONGEST_KEPT, MOST_KEPT = 48, 700_000


class PerfectHash:
    """n keys to the places 0..n-1, by hash and displace: a key's bucket names the seed that sends all keys of that
    bucket to free places; buckets of one key name the place itself. Unknown keys are told by comparing."""

    def __init__(self, keys: Sequence[bytes]):
        n = len(keys)
        self.seeds = array("q", [0]) * max(1, (n + LOAD - 1) // LOAD)
        self.keys: list[bytes | None] = [None] * n
        buckets: dict[int, list[bytes]] = {}
        for k in keys:
            buckets.setdefault(xxhash.xxh3_64_intdigest(k) % len(self.seeds), []).append(k)
        free = n
        for b, own in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                while self.keys[free - 1] is not None:
                    free -= 1
                free -= 1
                self.keys[free], self.seeds[b] = own[0], -free - 1
                continue
            seed = 1
            while True:
                places = {xxhash.xxh3_64_intdigest(k, seed) % n for k in own}
                if len(places) == len(own) and all(self.keys[p] is None for p in places):
                    break
                seed += 1
            self.seeds[b] = seed
            for k in own:
                self.keys[xxhash.xxh3_64_intdigest(k, seed) % n] = k

    def place(self, key: bytes) -> int:
        """The key's place, -1 for a key that isn't one of them."""
        if not self.keys:
            return -1
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % len(self.seeds)]
        at = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % len(self.keys)
        return at if self.keys[at] == key else -1


class Coder:
    """Encodes and decodes by the ranks of a vocabulary, in which every byte has one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks))
        self.ids = array("i", [ranks[k] for k in self.hash.keys])
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for k, i in ranks.items():
            self.bytes[i] = k
        self.find = regex.compile(PATTERN).findall
        self.kept: dict[str, array] = {}

    def merged(self, word: bytes) -> array:
        """Pairs wait in a heap by rank and place; a pair that has changed since is passed over."""
        n, ranks = len(word), self.ranks
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # ends[i]: where the part that begins at i ends; 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or not ends[j] or ends[j] != stop:
                continue
            ends[i], ends[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : ends[stop]])) is not None:
                    heapq.heappush(heap, (r, i, ends[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = array("i"), 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    def pretoken(self, x: str) -> array:
        """Kept for later texts while there is room; then all are forgotten."""
        word = x.encode("utf-8", "replace")
        at = self.hash.place(word)
        ids = self.ids[at : at + 1] if at >= 0 else self.merged(word)
        if len(x) <= LONGEST_KEPT:
            if len(self.kept) >= MOST_KEPT:
                self.kept.clear()
            self.kept[x] = ids
        return ids

    def encode(self, text: str) -> array:
        out, kept, new = array("i"), self.kept.get, self.pretoken
        for x in self.find(text):
            out += kept(x) or new(x)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        known, n = self.bytes, len(self.bytes)
        return b"".join([known[i] if 0 <= i < n else b"" for i in ids]).decode("utf-8", "replace")


_made: dict[int, Coder] = {}


def coder(data: bytes) -> Coder:
    key = hash(data)
    if key not in _made:
        _made[key] = Coder(read_ranks(data))
    return _made[key]


def encoded(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding the ids gives the text again."""
    data = file_bytes(vocabulary, folder)

    def run(batches):
        c = coder(data)
        for b in batches:
            every = b["text"].to_pylist()
            for i, j in sliced([x or "" for x in every]):
                texts = every[i:j]
                ids = [None if x is None else c.encode(x) for x in texts]
                sizes = [len(x) if x else 0 for x in ids]
                flat = array("i")
                for x in ids:
                    flat += x or array("i")
                nulls = pa.array([x is None for x in texts], pa.bool_())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                same = [None if x is None else c.decode(y) == x for x, y in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b["doc_id"].slice(i, j - i),
                        pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)), mask=nulls),
                        pa.array([None if x is None else n for x, n in zip(texts, sizes, strict=True)], pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "ids", "n_tokens", "same_text"],
                )

    return doc_columns(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, same_text boolean")


def decoded(rows: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give null."""
    data = file_bytes(vocabulary, folder)

    def run(batches):
        c = coder(data)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([None if x is None else c.decode([i for i in x if i is not None]) for x in b["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
