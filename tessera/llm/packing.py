"""Packing of documents into sequences of a fixed capacity.

Texts are encoded once; the pieces (whole documents, or cuts of the longer ones) are dealt at random
into shards of a bounded number of pieces. In a shard, best fit by falling length gives the first
bins; a local search then exchanges pieces between underfull bins, one for one or two for one, or
moves them, whenever that raises the sum of squared fills, until bins empty or nothing improves.
The bins that stay underfull (below `full_enough` of the capacity) are dealt out anew and packed once
more, so that what is left over in many shards meets.

Defined cases: a NULL text is an empty one and takes one token (the end id). NULL ids and repeated
rows are packed like others, each row once. Extra columns aren't read. An empty table gives no row.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.encoding import encoder

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cutting(path: str, end_id: int, capacity: int):
    """Arrow function: (uid, doc_id, text) rows to pieces of at most `capacity` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(e.each([t or "" for t in b.column(2).to_pylist()], end_id)):
                wide = ids.astype("<u4")
                for p, at in enumerate(range(0, len(wide), capacity)):
                    cut = wide[at : at + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling length, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin has r left
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            by_room[left].append(k)
            rooms |= 1 << left
    return bins


def _bits(numbers: list[int]) -> int:
    """A number with these bits set."""
    out = 0
    for n in numbers:
        out |= 1 << n
    return out


def _sums(numbers: list[int]) -> int:
    """The sums of any two items, as bits."""
    out, before = 0, 0
    for n in numbers:
        out |= before << n
        before |= 1 << n
    return out


class Offers:
    """Which lengths, and which sums of two lengths, single bins can give, and which bins those are."""

    def __init__(self, capacity: int):
        self.bins: tuple[list[set[int]], list[set[int]]] = tuple([set() for _ in range(capacity + 1)] for _ in range(2))
        self.have = [0, 0]  # singles and sums that some bin has, as bits
        self.of_bin: dict[int, tuple[int, int]] = {}

    def put(self, k: int, lengths: list[int]) -> None:
        """Bin k now holds items of these lengths; none takes it out."""
        new, old = (_bits(lengths), _sums(lengths)), self.of_bin.pop(k, (0, 0))
        for kind in (0, 1):
            changed = new[kind] ^ old[kind]
            while changed:
                bit = changed & -changed
                n = bit.bit_length() - 1
                holders = self.bins[kind][n]
                if new[kind] & bit:
                    holders.add(k)
                    self.have[kind] |= bit
                else:
                    holders.discard(k)
                    if not holders:
                        self.have[kind] ^= bit
                changed ^= bit
        if lengths:
            self.of_bin[k] = new

    def best(self, lengths: list[int], room: int) -> tuple[int, int, int, bool] | None:
        """For a bin of these lengths: the largest gain within its room, its giver, what it gives, and whether that is two items.

        A move, or an exchange of one for one, one for two or two for one.
        """
        single = 1 | _bits(lengths)
        takes = (single | _sums(lengths), single)
        for gain in range(room, 0, -1):
            for two in (False, True):
                if fit := takes[two] << gain & self.have[two]:
                    give = (fit & -fit).bit_length() - 1
                    return gain, min(self.bins[two][give]), give, two
        return None


def _pick(items: list[int], lengths: list[int], total: int, two: bool | None = None) -> list[int]:
    """One item, or else two, of this total length (or none for 0); `two` says which."""
    if total == 0:
        return []
    if two is not True:
        for i in items:
            if lengths[i] == total:
                return [i]
    seen: dict[int, int] = {}
    for i in items:
        if (other := seen.get(total - lengths[i])) is not None:
            return [other, i]
        seen[lengths[i]] = i
    raise ValueError("no items of that length")


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchange items between underfull bins while that raises the sum of squared fills; empty bins go.

    From the fullest underfull bin down, each takes the exchange with any emptier bin that fills it
    most: a move, one for one, one for two or two for one. Bit sets of the lengths (and sums of two)
    that bins can give find it without trying bins in turn, so none is left out. The sum of squares
    only rises, so no state comes twice; the search ends where a whole pass finds nothing, or where the
    number of bins is the least that can hold the total: no exchange can empty another.
    """
    least = -(-sum(lengths) // capacity)
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    of = lambda k: [lengths[i] for i in bins[k]]
    n, changed = len(bins), True
    while changed and n > least:
        changed, offers = False, Offers(capacity)
        heap = [(-fill[k], k) for k in range(len(bins)) if 0 < fill[k] < capacity]
        for _, k in heap:
            offers.put(k, of(k))
        heapq.heapify(heap)
        while heap and n > least:
            full, b = heapq.heappop(heap)
            if b not in offers.of_bin or -full != fill[b]:
                continue  # it has been filled already, or has given since
            offers.put(b, [])
            while fill[b] < capacity and (found := offers.best(of(b), capacity - fill[b])):
                gain, a, give, two = found
                out, back = _pick(bins[a], lengths, give, two), _pick(bins[b], lengths, give - gain)
                bins[a] = [i for i in bins[a] if i not in out] + back
                bins[b] = [j for j in bins[b] if j not in back] + out
                fill[a] -= gain
                fill[b] += gain
                offers.put(a, of(a))
                changed = True
                if fill[a]:
                    heapq.heappush(heap, (-fill[a], a))
                else:
                    n -= 1
    return [b for b in bins if b]


def packing_shard(capacity: int):
    """Arrow function of one shard's (uid, piece, length, shard): adds bin and offset, and the bin's fill."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("uid", "ascending"), ("piece", "ascending")])  # the same bins at every run
        lengths = table.column("length").to_pylist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        where, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        for k, items in enumerate(bins):
            at, total = 0, sum(lengths[i] for i in items)
            for i in sorted(items):
                where[i], offset[i], fill[i] = k, at, total
                at += lengths[i]
        names = ["uid", "piece", "length", "shard"]
        return pa.Table.from_arrays([*(table.column(n) for n in names), pa.array(where, pa.int64()), pa.array(offset, pa.int64()), pa.array(fill, pa.int64())], names=[*names, "bin", "offset", "fill"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int, shard_rows: int = 20_000, full_enough: float = 0.98) -> DataFrame:
    """uid, piece, sequence_id and offset for pieces (uid, piece, length); (uid, piece) names a piece.

    Shards get about `shard_rows` pieces by a hash of their key. Bins filled to `full_enough` or more
    are final; the pieces of the others go through a second deal.
    """
    schema = "uid long, piece int, length long, shard long, bin long, offset long, fill long"

    def once(rows: DataFrame, n: int, salt: int) -> DataFrame:
        shards = max(1, -(-n // shard_rows))
        dealt = rows.select("uid", "piece", "length", F.pmod(F.xxhash64(F.lit(salt), "uid", "piece"), F.lit(shards)).alias("shard"))
        packed = dealt.groupBy("shard").applyInArrow(packing_shard(capacity), schema)
        # a sequence's number: its deal, shard and bin
        return packed.withColumn("sequence_id", (F.col("shard") * 2 + salt) * (1 << 32) + F.col("bin"))

    first = stored(once(pieces, pieces.count(), 0), "packed")
    under = first.where(F.col("fill") < full_enough * capacity)
    second = once(under, under.count(), 1)
    final = first.where(F.col("fill") >= full_enough * capacity)
    return final.unionByName(second).select("uid", "piece", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t"))
    pieces = stored(rows.mapInArrow(cutting(tokenizer, end_id, capacity), PIECES), "pieces")
    where = pack_pieces(pieces.select("uid", "piece", "length"), capacity)
    return pieces.join(where, ["uid", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
