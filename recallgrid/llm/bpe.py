"""Byte-level BPE encoding and decoding in numpy.

Pieces go to buckets by length; each bucket is a padded matrix of ids, one piece a row.  In each round every
row merges its leftmost pair of minimum rank: pair ranks come from a hashed pair table, the merged row closes
up, and rows without a pair left leave the matrix.  Decoding gathers each id's bytes.

A round of a matrix costs its width, so pieces over LONG bytes (a row each) are merged otherwise, to the same ids: ids are
a chain, pairs wait in one list a rank, and each round merges the pairs of the minimum rank from left to right, up to
the first merge that makes a pair of lower rank, which is then the next minimum.  That costs the pairs, not the width.

Tasks are independent and keep nothing between partitions but the vocabulary, so a lost executor costs its
running tasks only.  Defined cases: a null text counts as empty and has no ids; rows with one doc_id each get
their own row; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rounds, table, text_or_empty
from .pieces import PieceEncoder, spread

NONE = np.int32(2**31 - 1)
#: Pieces longer than this get a matrix of their own length; shorter ones share the next of these widths.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512)
#: Bytes from which a piece has a chain instead of a row.
LONG = 2048
#: Cells of one matrix.
CELLS = 4_000_000


class PairTable:
    """Rank of each pair of ids that may merge, in an open-addressed table of 64-bit keys."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, rest = self._slot(key), np.arange(len(key))
        while len(rest):
            free = rest[self.keys[slot[rest]] == -1]
            self.keys[slot[free]] = key[free]  # of several that want a slot one gets it
            won = self.keys[slot[rest]] == key[rest]
            self.ranks[slot[rest[won]]] = rank[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.ranks[slot], NONE)
        rest = np.flatnonzero((seen != key) & (seen != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            seen = self.keys[slot[rest]]
            hit = seen == key[rest]
            out[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (seen != -1)]
        return out


class Vocabulary:
    """Ranks of byte strings; a string's rank is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        left, right, rank = [], [], []
        for word, r in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        words = [b""] * (max(ranks.values()) + 1)
        for word, r in ranks.items():
            words[r] = word
        self.bytes_flat, self.bytes_at, self.bytes_n = self._table(words)
        self.digits_flat, self.digits_at, self.digits_n = self._table([b"%d," % i for i in range(len(words))])

    @staticmethod
    def _table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        return np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n, n

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)})

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces in any order, where each piece's begin and how many they are."""
        size, at = np.ones(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        whole = list(map(self.ranks.get, pieces))
        buckets: dict[int, list[int]] = {}
        parts = [(np.array([i for i, r in enumerate(whole) if r is not None], np.int64), None, np.array([r for r in whole if r is not None], np.int32))]
        for i, piece in enumerate(pieces):
            if whole[i] is None:
                n = len(piece)
                if n > LONG:
                    ids = self._chain(piece)
                    parts.append((np.array([i]), np.array([len(ids)]), ids))
                else:
                    buckets.setdefault(next((w for w in WIDTHS if w >= n), n), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                parts += self._merge(pieces, rows[k : k + step], width)
        used = 0
        for rows, n, ids in parts:
            n = np.ones(len(rows), np.int64) if n is None else n
            size[rows], at[rows] = n, used + np.cumsum(n) - n
            used += len(ids)
        return np.concatenate([ids for _, _, ids in parts]), at, size

    def _merge(self, pieces: list[bytes], rows: list[int], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, how many ids each has, the ids end to end) of the rows that are done after each round."""
        out = []
        n = np.fromiter((len(pieces[i]) for i in rows), np.int64, len(rows))
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < n[:, None], self.byte_ids[raw], -1).astype(np.int32)
        rank = np.full((len(rows), width), NONE, np.int32)  # of the pair that begins here
        if width > 1:
            pair = ids[:, 1:] >= 0
            rank[:, :-1][pair] = self.pairs.find(ids[:, :-1][pair], ids[:, 1:][pair])
        row = np.array(rows)
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                out.append((row[done], n[done], ids[done][np.arange(ids.shape[1]) < n[done][:, None]]))
                live = ~done
                if not live.any():
                    return out
                row, n, at, best = row[live], n[live], at[live], best[live]
                most = int(n.max())
                ids, rank = ids[live, :most], rank[live, :most]
            i, most = np.arange(len(row)), ids.shape[1]
            ids[i, at] = best  # a merged pair's id is its rank
            source = np.arange(most) + (np.arange(most) > at[:, None])
            np.minimum(source, most - 1, out=source)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            n = n - 1
            ids[:, -1] = np.where(n == most, ids[:, -1], -1)
            rank[:, -1] = NONE
            rank[i, at] = NONE
            right = np.flatnonzero(at + 1 < n)
            rank[right, at[right]] = self.pairs.find(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], ids[left, at[left]])

    def _chain(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece."""
        n = len(piece)
        ids = np.append(self.byte_ids[np.frombuffer(piece, np.uint8)], -1).astype(np.int32)  # no pair has -1
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # the last place stands for the end, also as place -1
        rank, live = np.full(n + 1, NONE, np.int32), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            found = rank[places]
            order = np.argsort(found, kind="stable")
            order = order[: np.searchsorted(found[order], NONE)]
            places, found = places[order], found[order]
            begins = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else found
            for r, some in zip(found[begins].tolist(), np.split(places, begins[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(some)

        rank[: n - 1] = self.pairs.find(ids[: n - 1], ids[1:n])
        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of pairs that overlap in a run, the leftmost and every second one from there
            run = np.append(True, after[at[:-1]] != at[1:])
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            chosen = at[(np.arange(len(at)) - first) % 2 == 0]
            second = after[chosen]
            right, left = after[second], before[chosen]
            # what each merge makes before the next one, as if one came after the other
            met = np.append(False, right[:-1] == chosen[1:])
            beside = np.where(met, r, ids[left])
            lower = (self.pairs.find(beside, np.full(len(chosen), r)) < r) | (self.pairs.find(np.full(len(chosen), r), ids[right]) < r)
            if lower.any():
                k = int(lower.argmax()) + 1
                waiting[r] = [at[at > chosen[k - 1]]]
                heapq.heappush(heap, r)
                chosen, second, right, left = chosen[:k], second[:k], right[:k], left[:k]
            ids[chosen], rank[second], live[second] = r, NONE, False
            after[chosen] = right
            before[right] = chosen
            left = before[chosen]
            left = left[left >= 0]
            rank[chosen] = self.pairs.find(ids[chosen], ids[after[chosen]])
            rank[left] = self.pairs.find(ids[left], ids[after[left]])
            wait(np.unique(np.concatenate([left, chosen])))
        return ids[:n][live]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``."""
        return spread(self.bytes_flat, self.bytes_at, self.bytes_n, ids)


_encoders: dict[str, tuple[Vocabulary, PieceEncoder]] = {}


def encoder(path: str) -> tuple[Vocabulary, PieceEncoder]:
    """The vocabulary of a ranks file with its piece store, read once in each worker."""
    if path not in _encoders:
        words = Vocabulary.from_file(path)
        _encoders[path] = words, PieceEncoder(words.encode)
    return _encoders[path]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, store = encoder(path)
        for batch in batches:
            for part in rounds(batch, "text"):
                ids, at = store.ids(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) for each row of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = encoder(path)
        for batch in batches:
            lists = batch.column(1)
            found = [b"" if x is None else words.decode(np.asarray(x, np.int64)).tobytes() for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids in decimal and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, store = encoder(path)
        for batch in batches:
            for part in rounds(batch, "text"):
                ids, at = store.ids(part.column("text").to_pylist())
                plain, decimal = words.decode(ids).tobytes(), spread(words.digits_flat, words.digits_at, words.digits_n, ids).tobytes()
                bytes_at = np.concatenate([[0], np.cumsum(words.bytes_n[ids])])[at].tolist()
                digits_at = np.concatenate([[0], np.cumsum(words.digits_n[ids])])[at].tolist()
                hexed = [[hashlib.sha256(x[i : max(i, j - less)]).hexdigest() for i, j in zip(k[:-1], k[1:])] for x, k, less in ((decimal, digits_at, 1), (plain, bytes_at, 0))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(hexed[0]), pa.array(hexed[1])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
