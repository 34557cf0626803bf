"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` tokens.  A packing depends on lengths alone, so the
instance is the histogram of piece lengths: at most ``capacity`` numbers however many documents there are.
The driver reduces that histogram (sets of one, two or three pieces that provably dominate every other filling
of a bin with the same largest piece are fixed for good), packs what is left by best fit decreasing, and gets a
table of slots: a range of ranks of one length, and where in which sequences those go.  Pieces are ranked within
their length by Spark, in shards, and meet their slots in a join with that bounded table.

Defined cases: a null text counts as empty and is one piece, the end id alone; rows with one doc_id are separate
documents; an empty table packs into no sequence; other columns of the input are ignored.  The table of pieces
is written to the checkpoint folder, so the two passes over it agree and a lost executor loses nothing.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, rounds, table, text_or_empty
from .pieces import PieceEncoder

CAPACITY = 1024
END_ID = 2
#: Rows ranked together, about.
SHARD_ROWS = 20_000
#: Bytes of text in one round of work, and distinct pieces that a worker keeps: some 100 MB besides the tokenizer, since an executor has several workers.
ROUND, STORED = 500_000, 400_000
SLOT_SCHEMA = "length int, low long, high long, base long, copies int, at int"


class WordIds:
    """Ids of pieces by a tokenizer of the ``tokenizers`` library.

    Pieces that begin with a space are encoded many at a time: set end to end they fall apart at those spaces again.
    """

    TOGETHER = 1000
    #: So many sets in one call.
    CALLS = 8

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [p.decode() for p in pieces]
        size, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        led = [i for i, w in enumerate(words) if w[0] == " " and len(w) > 1 and not w[1:].isspace()]
        some = [led[k : k + self.TOGETHER] for k in range(0, len(led), self.TOGETHER)]
        flat, used = [], 0
        for k in range(0, len(some), self.CALLS):  # the library's answer has some hundreds of bytes a token
            parts = some[k : k + self.CALLS]
            for part, found in zip(parts, self.tokenizer.encode_batch(["".join([words[i] for i in p]) for p in parts], add_special_tokens=False)):
                n = np.bincount(found.word_ids)
                if len(n) == len(part):
                    size[part], at[part] = n, used + np.cumsum(n) - n
                    flat.append(np.array(found.ids, np.int32))
                    used += len(flat[-1])
        rest = np.flatnonzero(size == 0).tolist()
        for k in range(0, len(rest), self.TOGETHER):
            part = rest[k : k + self.TOGETHER]
            for i, found in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
                ids = found.ids
                size[i], at[i] = len(ids), used
                flat.append(np.array(ids, np.int32))
                used += len(ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), at, size


_stores: dict[str, PieceEncoder] = {}


def store(path: str) -> PieceEncoder:
    if path not in _stores:
        _stores[path] = PieceEncoder(WordIds(path), STORED, ROUND)
    return _stores[path]


def token_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut into pieces.

    A document over ``capacity`` tokens has full pieces only, but for its first.
    """

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = store(path)
        for batch in batches:
            for part in rounds(batch, "text", ROUND):
                ids, at = encoder.ids(part.column("text").to_pylist())
                n = np.diff(at) + 1
                doc = np.arange(len(n))
                own = np.full(len(ids) + len(n), end_id, "<u4")  # all documents end to end, each with its end id
                own[np.arange(len(ids)) + np.repeat(doc, n - 1)] = ids
                pieces = -(-n // capacity)
                of = np.repeat(doc, pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = n - (pieces - 1) * capacity
                length = np.where(piece == 0, first[of], capacity)
                start = np.where(piece == 0, 0, first[of] + (piece - 1) * capacity)
                ends = np.cumsum(length)  # pieces stand end to end, as the documents do
                raw = memoryview(own.tobytes())
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(((ends - length) * 4).tolist(), (ends * 4).tolist())]
                arrays = [part.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(own.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


class _Bag:
    """Pieces left, by length."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.remove(size)

    def fitting(self, room: int) -> int | None:
        """Largest length up to ``room``."""
        i = bisect.bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else None

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.count[s])
            if len(out) == n:
                break
        return out


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """Bins fixed by dominance, as (how many, lengths), and the counts left.

    With largest piece j and room r: nothing else fits -> {j}; a piece of exactly r -> {j, r}; no two others fit
    -> {j, k}, k the largest that fits; no three others fit and no other pair beats k with the best third b ->
    {j, k, b}.  Each of these sets dominates whatever else could share a bin with j, so some best packing has it.
    """
    bag, fixed = _Bag(dict(counts)), []
    again = True
    while again:
        again = False
        for j in sorted(bag.sizes, reverse=True):
            while bag.count.get(j, 0):
                room, own = capacity - j, bag.count[j]
                bag.take(j, 1)  # j itself is not among those that may join it
                k, two = bag.fitting(room), bag.smallest(3)
                pick: list[int] | None = None
                if k is None:
                    pick = [j]
                elif k == room or sum(two[:2]) > room or len(two) < 2:
                    pick = [j, k]
                elif sum(two) > room or len(two) < 3:
                    bag.take(k, 1)
                    b = bag.fitting(room - k)
                    bag_sizes, bag_count = bag.sizes, bag.count
                    if b is not None:
                        # a pair (x, y), x >= y, is not dominated by (k, b) only if y > b and x + y > k
                        more = [s for s in bag_sizes if s > b and s <= room - s or s > b and s < k]
                        beaten = any(x + y <= room and x + y > k and (x != y or bag_count[x] > 1) for x in more for y in more if x >= y)
                        pick = None if beaten else [j, k, b]
                    bag.count[k] = bag.count.get(k, 0) + 1
                    if k not in bag.sizes:
                        bisect.insort(bag.sizes, k)
                bag.count[j] = bag.count.get(j, 0) + 1
                if j not in bag.sizes:
                    bisect.insort(bag.sizes, j)
                if pick is None:
                    break
                need = {s: pick.count(s) for s in pick}
                times = min(bag.count[s] // n for s, n in need.items()) if len(pick) > 1 else own
                times = max(1, times)
                for s, n in need.items():
                    bag.take(s, n * times)
                fixed.append((times, pick))
                again = True
    return fixed, bag.count


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit decreasing on a histogram: bins as (how many, lengths)."""
    open_bins: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, lengths: list[int]) -> None:
        if n:
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(rooms, room)
            open_bins[room].append((n, lengths))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                n, lengths = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            else:
                room, lengths = capacity, []
                n = -(-left // (capacity // size))
            each = room // size
            full = min(n, left // each)
            put(room - each * size, full, lengths + [size] * each)
            left -= full * each
            if full < n:
                rest = min(left, each)
                put(room - rest * size, 1 if rest else 0, lengths + [size] * rest)
                put(room, n - full - (1 if rest else 0), lengths)
                left -= rest
    return [b for r in rooms for b in open_bins[r]]


def slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: those of rank low..high-1 fill ``copies`` places each in sequences from base on."""
    fixed, left = reduced(counts, capacity)
    given, base, out = dict.fromkeys(counts, 0), 0, []
    for n, lengths in fixed + best_fit(left, capacity):
        at = 0
        for size in dict.fromkeys(lengths):
            copies = lengths.count(size)
            out.append((size, given[size], given[size] + n * copies, base, copies, at))
            given[size] += n * copies
            at += copies * size
        base += n
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to (doc_id, piece, length, ...)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    shards = min(4096, max(16, sum(counts.values()) // SHARD_ROWS))
    rows = pieces.withColumn("__s", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    sizes = rows.groupBy("length", "__s").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("length", "__s").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("__n", rank).join(sizes, ["length", "__s"]).withColumn("__n", F.col("__n") + F.col("__first"))
    where = F.broadcast(spark.createDataFrame(slots(counts, capacity), SLOT_SCHEMA).withColumnRenamed("length", "__length"))
    met = ranked.join(where, (F.col("length") == F.col("__length")) & (F.col("__n") >= F.col("low")) & (F.col("__n") < F.col("high")))
    index = F.col("__n") - F.col("low")
    return met.withColumns({
        "sequence_id": F.col("base") + F.floor(index / F.col("copies")).cast("long"),
        "offset": F.col("at").cast("long") + F.pmod(index, F.col("copies")) * F.col("length"),
    }).drop("__s", "__n", "__first", "__length", "low", "high", "base", "copies", "at")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document."""
    found = place(cut(token_pieces(documents, path, capacity, end_id)), capacity)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves."""
    found = place(cut(token_pieces(documents, path, capacity, end_id, with_ids=True)), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return found.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
