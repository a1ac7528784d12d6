"""Minimal perfect hashes over keys (p, q) in shards, with the keys stored, and arrays counted by slot.

Keys are dealt into shards by hash, of about SHARD keys each; a shard is one row: bit arrays level by level (a key
stands in the first level where it is alone at its place) and the keys themselves in slot order. A key's slot is
shard * CAP plus the number of set bits before its own, so the slots of a shard have no holes. Tasks read the rows
of a bounded group of shards from the shared folder at a time; what isn't a key meets another key's slot and is told
by the stored one. Counts by slot are numpy arrays in blocks; tasks add up their own, blocks are summed up a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import arrow_text as A
from lectern.llm.shared import written
from lectern.llm.warc import located

SHARD, CAP = 1 << 15, 1 << 16
#: Shards that a task holds at once.
GROUP = 64
#: Places per key in a level.
GAMMA = 2
BLOCK = 1 << 14
#: Arrays summed at each node of the tree.
ARITY = 64
_P, _Q, _SEED, _LEVEL = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9E3779B97F4A7C15))


def pair_hash(p: np.ndarray, q: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return A.mix(p.astype(np.int64).view(np.uint64) * _P + A.mix(q.astype(np.int64).view(np.uint64) + _Q + np.asarray(seed, np.uint64) * _SEED))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _place(h: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (A.mix(h + _LEVEL * np.uint64(level + 1)) % np.asarray(size, np.uint64)).astype(np.int64)


def perfect(h: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(places of each level, the levels' bits as 64-bit words, the slot of each hash) for distinct hashes."""
    sizes, levels = [], []
    at = np.full(len(h), -1, np.int64)
    rest, before = np.arange(len(h)), 0
    while len(rest):
        size = -(-GAMMA * len(rest) // 64) * 64
        place = _place(h[rest], len(sizes), size)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, bool)
        bits[place[alone]] = True
        at[rest[alone]] = before + place[alone]
        rest = rest[~alone]
        sizes.append(size)
        levels.append(bits)
        before += size
    flat = np.concatenate(levels) if levels else np.zeros(0, bool)
    return sizes, np.packbits(flat, bitorder="little").view(np.uint64), (np.cumsum(flat) - 1)[at] if len(h) else at


SHARDS = "shard int, seed int, sizes array<int>, bits binary, p array<bigint>, q array<bigint>"


def build(keys: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(the shards' rows as a written table, number of shards) of distinct keys (p, q); extra: string columns kept
    in slot order."""
    shards = max(1, -(-keys.count() // SHARD))
    kept = "".join(f", {c} string" for c in extra)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                shard = shard_of(pair_hash(A.column(b, "p").to_numpy(), A.column(b, "q").to_numpy()), shards)
                yield pa.RecordBatch.from_arrays([pa.array(shard), *(A.column(b, c) for c in ("p", "q", *extra))], ["shard", "p", "q", *extra])

    def make(group: pa.Table) -> pa.Table:
        p, q = group.column("p").to_numpy(), group.column("q").to_numpy()
        for seed in range(64):
            h = pair_hash(p, q, seed)
            if len(np.unique(h)) == len(h):
                break
        else:
            raise ValueError("keys repeat, or stand for different texts")
        sizes, bits, slot = perfect(h)
        order = pa.array(np.argsort(slot))
        columns = {c: pa.array([group.column(c).take(order).to_pylist()]) for c in ("p", "q", *extra)}
        return pa.table({"shard": group.column("shard").slice(0, 1), "seed": pa.array([seed], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": [bits.tobytes()], **columns})

    dealt = keys.select("p", "q", *extra).mapInArrow(deal, f"shard int, p bigint, q bigint{kept}")
    rows = dealt.groupBy("shard").applyInArrow(make, SHARDS + "".join(f", {c} array<string>" for c in extra))
    return written(rows, "shards"), shards


def keys_by_slot(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(slot, p, q, ..) of the shards' rows."""
    zipped = rows.select("shard", F.posexplode(F.arrays_zip("p", "q", *extra)).alias("i", "key"))
    return zipped.select((F.col("shard").cast("long") * CAP + F.col("i")).alias("slot"), *(F.col(f"key.{c}").alias(c) for c in ("p", "q", *extra)))


class Shards:
    """Shards `first` to `first + GROUP` of a built table, in a task."""

    def __init__(self, uri: str, first: int, extra: tuple[str, ...] = ()):
        at, path = located(uri)
        table = pads.dataset(path, filesystem=at, format="parquet").to_table(filter=(pads.field("shard") >= first) & (pads.field("shard") < first + GROUP)).sort_by("shard")
        self.first = first
        sizes = table.column("sizes").to_pylist()
        depth = max([1, *map(len, sizes)])
        self.size = np.zeros((GROUP, depth), np.int64)
        self.offset = np.zeros((GROUP, depth), np.int64)
        self.seed, self.start = np.zeros(GROUP, np.uint64), np.zeros(GROUP, np.int64)
        bits, base, held, n = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], 0, 64
        for i, (shard, seed, own, raw) in enumerate(zip(table.column("shard").to_pylist(), table.column("seed").to_pylist(), sizes, table.column("bits").to_pylist(), strict=True)):
            k = shard - first
            words = np.frombuffer(raw, np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.seed[k], self.start[k] = seed, held
            self.size[k, : len(own)] = own
            self.offset[k, : len(own)] = n + np.cumsum([0, *own[:-1]])
            bits.append(words)
            base.append(np.cumsum(ones) - ones)
            n += 64 * len(words)
            held += int(ones.sum())
        self.bits, self.base = np.concatenate(bits), np.concatenate(base)
        self.p, self.q = (table.column(name).combine_chunks().flatten().to_numpy() for name in ("p", "q"))
        self.extra = {c: table.column(c).combine_chunks().flatten() for c in extra}

    def find(self, p: np.ndarray, q: np.ndarray, h: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, place among the stored keys) of keys of these shards, -1 for what isn't one."""
        k = shard - self.first
        if self.seed.any():
            h = pair_hash(p, q, self.seed[k])
        place = np.full(len(h), -1, np.int64)
        rest = np.arange(len(h))
        for level in range(self.size.shape[1]):
            size = self.size[k[rest], level]
            if not size.all():
                rest, size = rest[size > 0], size[size > 0]
            if not len(rest):
                break
            at = self.offset[k[rest], level] + _place(h[rest], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            before = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            place[rest[hit]] = self.base[at[hit] >> 6] + before
            rest = rest[~hit]
        met = np.flatnonzero(place >= 0)
        own = self.start[k[met]] + place[met]
        good = (self.p[own] == p[met]) & (self.q[own] == q[met])
        slot, stored = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        slot[met[good]] = shard[met[good]].astype(np.int64) * CAP + place[met[good]]
        stored[met[good]] = own[good]
        return slot, stored


class Reader:
    """Looks up keys of all shards, a group at a time; the last group stays in memory."""

    def __init__(self, uri: str, shards: int, extra: tuple[str, ...] = ()):
        self.uri, self.shards, self.extra, self.held = uri, shards, extra, None

    def groups(self, shard: np.ndarray) -> Iterator[tuple[Shards, np.ndarray]]:
        """(group, which of the keys are in it)"""
        order = range(0, self.shards, GROUP)
        for first in sorted(order, key=lambda f: self.held is None or f != self.held.first):
            own = np.flatnonzero((shard >= first) & (shard < first + GROUP)) if self.shards > GROUP else np.arange(len(shard))
            if len(own):
                if self.held is None or self.held.first != first:
                    self.held = Shards(self.uri, first, self.extra)
                yield self.held, own

    def slots(self, p: np.ndarray, q: np.ndarray, h: np.ndarray) -> np.ndarray:
        shard = shard_of(h, self.shards)
        out = np.full(len(h), -1, np.int64)
        for group, own in self.groups(shard):
            out[own] = group.find(p[own], q[own], h[own], shard[own])[0]
        return out


class Tally:
    """Counts by slot in a task: arrays of BLOCK slots, handed on when they are too many."""

    def __init__(self, most: int = 512):
        self.blocks: dict[int, np.ndarray] = {}
        self.most = most

    def add(self, slots: np.ndarray) -> None:
        for first in np.unique(slots // (GROUP * CAP)).tolist():
            own = slots[slots // (GROUP * CAP) == first] - first * GROUP * CAP
            counts = np.bincount(own, minlength=-(-int(own.max() + 1) // BLOCK) * BLOCK).reshape(-1, BLOCK)
            for i in np.flatnonzero(counts.any(axis=1)).tolist():
                b = first * (GROUP * CAP // BLOCK) + i
                self.blocks[b] = self.blocks[b] + counts[i] if b in self.blocks else counts[i].copy()

    def full(self) -> bool:
        return len(self.blocks) > self.most

    def taken(self) -> Iterator[tuple[int, np.ndarray]]:
        yield from self.blocks.items()
        self.blocks = {}


def narrow(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes a value, values) of whole numbers from 0 on, or from -1 on if 4 or 8 bytes are taken."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    width = 1 if low >= 0 and high < 1 << 8 else 2 if low >= 0 and high < 1 << 16 else 4 if high < 1 << 31 else 8
    return width, x.astype({1: np.uint8, 2: np.uint16, 4: np.int32, 8: np.int64}[width]).tobytes()


def wide(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.int32, 8: np.int64}[width]).astype(np.int64)


ARRAYS = "id bigint, part int, width int, data binary"


def packed(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes a value, values compressed) of BLOCK counts."""
    width, data = narrow(x)
    return width, pa.compress(data, "zstd", asbytes=True)


def unpacked(width: int, data: bytes) -> np.ndarray:
    return wide(width, pa.decompress(data, BLOCK * width, "zstd", asbytes=True))


def tree_sum(arrays: DataFrame) -> DataFrame:
    """(id, part = 0, width, data): arrays (id, part, width, data) of one id added up, ARITY parts at a time."""
    most = arrays.agg(F.max("part")).first()[0] or 0
    arrays = arrays.select("id", "part", "width", "data")

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for width, data in zip(group.column("width").to_pylist(), group.column("data").to_pylist(), strict=True):
            total += unpacked(width, data)
        width, data = packed(total)
        return pa.table({"id": group.column("id").slice(0, 1), "part": group.column("part").slice(0, 1), "width": pa.array([width], pa.int32()), "data": pa.array([data], pa.binary())})

    while True:
        arrays = arrays.withColumn("part", F.floor(F.col("part") / ARITY).cast("int")).groupBy("id", "part").applyInArrow(add, ARRAYS)
        most //= ARITY
        if not most:
            return arrays


def each_count(sums: DataFrame, least: int) -> DataFrame:
    """(slot, a) of summed arrays, where a is `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, width, data in zip(A.column(b, "id").to_pylist(), A.column(b, "width").to_pylist(), A.column(b, "data").to_pylist(), strict=True):
                x = unpacked(width, data)
                at = np.flatnonzero(x >= least)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(i * BLOCK + at), pa.array(x[at])], ["slot", "a"])

    return sums.mapInArrow(run, "slot bigint, a bigint")
