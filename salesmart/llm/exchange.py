"""Name or count 64-bit keys of all documents, with the keys sorted and sent in packed blocks.

Documents are dealt into chunks by a hash, copies of one text that would fill a chunk over several. A chunk sorts its keys, drops repeated ones, cuts them at
fixed borders into buckets, and sends a packed block to each bucket. The bucket sorts the blocks of
all chunks together, so equal keys are adjacent, and answers each block with a mask of the keys that
occur twice or more and, for these, their rank or their total. A hot key is one entry of each chunk,
whatever its number of rows, and no row is made for a single key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.steps import column, settled, small

BLOCKS = "bucket long, chunk long, round int, keys binary, counts binary, places binary"
ANSWERS = "chunk long, round int, bucket long, mask binary, names binary"

CHUNK_LEAST, CHUNK_MOST = 4 << 20, 128 << 20
#: What a row takes beside its text, so that null and empty texts count too.
ROW_BYTES = 64
BUCKET_BYTES = 16 << 20


@dataclass(frozen=True)
class Layout:
    chunks: int
    buckets: int


def layout(docs: DataFrame, text: str, keys_per_byte: float, row_bytes: int = 0) -> Layout:
    """Chunks and buckets for the size of the input; both grow, so neither outgrows a task."""
    size = F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long") + row_bytes
    total = docs.agg(F.sum(size)).first()[0] or 0
    chunk = min(max(CHUNK_LEAST, int(150 * math.sqrt(total))), CHUNK_MOST)
    bucket = min(max(BUCKET_BYTES, chunk), CHUNK_MOST)
    return Layout(max(1, -(-total // chunk)), max(8, math.ceil(total * keys_per_byte * 8 / bucket)))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


@dataclass(frozen=True)
class Grouped:
    """Distinct (bucket, key), sorted, and which of them each item is."""

    buckets: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    group: np.ndarray


def grouped(keys: np.ndarray, buckets: np.ndarray) -> Grouped:
    order = np.argsort(keys, kind="stable")
    by_bucket = buckets[order].astype(np.uint32)
    order = order[np.argsort(by_bucket, kind="stable")]
    key, bucket = keys[order], buckets[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(key)))
    return Grouped(bucket[starts], key[starts], counts, group)


def pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers as differences, byte by byte, so that the high bytes cost nothing."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def plain(values: np.ndarray, kind: type = np.uint32) -> bytes:
    return zstandard.compress(values.astype(kind).tobytes(), 1)


def read_plain(data: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def blocks(chunk: int, turn: int, found: Grouped, places: np.ndarray | None = None) -> pa.Table:
    """Rows of BLOCKS for a chunk; ``places`` of the items go along, in the order of their keys."""
    edges = np.flatnonzero(np.diff(found.buckets, prepend=found.buckets[:1])) if len(found.keys) else []
    starts = [0, *map(int, edges)] if len(found.keys) else []
    ends = [*starts[1:], len(found.keys)]
    sent = [None] * len(starts)
    if places is not None and starts:
        listed = places[np.argsort(found.group, kind="stable")]
        upto = np.concatenate([[0], np.cumsum(found.counts)])
        sent = [plain(listed[upto[s] : upto[e]], np.int64) for s, e in zip(starts, ends, strict=True)]
    rows = {
        "bucket": pa.array([int(found.buckets[s]) for s in starts], pa.int64()),
        "chunk": pa.array([chunk] * len(starts), pa.int64()),
        "round": pa.array([turn] * len(starts), pa.int32()),
        "keys": pa.array([pack(found.keys[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary()),
        "counts": pa.array([plain(found.counts[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary()),
        "places": pa.array(sent, pa.binary()),
    }
    return pa.table(rows)


def answers(sent: DataFrame, *, totals: bool = False, named: bool = True) -> DataFrame:
    """Rows of ANSWERS. The name of a repeated key is its rank, or its total with ``totals``.

    Without ``named`` only the mask is told. Where places came along, the names are instead the
    places of the repeated keys, sorted.
    """

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        keys = [unpack(k) for k in rows["keys"]]
        sizes = [len(k) for k in keys]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        first = np.ones(len(every), bool)
        first[1:] = ordered[1:] != ordered[:-1]  # compare adjacent entries
        group = np.empty(len(every), np.int64)
        group[order] = np.cumsum(first) - 1
        total = np.bincount(group, np.concatenate([read_plain(c) for c in rows["counts"]])).astype(np.int64)
        repeated = total > 1
        rank = np.cumsum(repeated)
        mask, name = repeated[group], (total if totals else rank)[group]
        ends = np.cumsum(sizes)
        out = {"mask": [], "names": []}
        for end, size, counts, places in zip(ends, sizes, rows["counts"], rows["places"], strict=True):
            own = mask[end - size : end]
            out["mask"].append(np.packbits(own).tobytes())
            if places is not None:
                here = read_plain(places, np.int64)[np.repeat(own, read_plain(counts))]
                out["names"].append(pack(np.sort(here)))
                continue
            mine = name[end - size : end][own]
            out["names"].append((plain(mine) if totals else pack(mine)) if named else b"")
        return pd.DataFrame(
            {"chunk": rows["chunk"], "round": rows["round"], "bucket": rows["bucket"], **out}
        )

    return sent.groupBy("bucket").applyInPandas(settle, ANSWERS)


def answered(
    rows: pa.Table, turn: int, found: Grouped, *, totals: bool = False, named: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Mask and names of ``found`` from the answers to one round; a name is 0 for a single key."""
    mask = np.zeros(len(found.keys), bool)
    names = np.zeros(len(found.keys) if named else 0, np.uint64)
    rounds = np.array(rows.column("round").to_pylist(), np.int64)
    for at in np.flatnonzero(rounds == turn):
        row = {c: rows.column(c)[int(at)].as_py() for c in ("bucket", "mask", "names")}
        start, end = np.searchsorted(found.buckets, [row["bucket"], row["bucket"] + 1])
        own = np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=int(end - start)).astype(bool)
        mask[start:end] = own
        if not named:
            continue
        if totals:
            names[start:end][own] = read_plain(row["names"])
        else:  # ranks of two buckets differ by the bucket
            names[start:end][own] = unpack(row["names"]) + (np.uint64(row["bucket"] + 1) << np.uint64(32))
    return mask, names


def dealt(docs: DataFrame, key: str | None, text: str, chunks: int) -> DataFrame:
    """``docs`` with a ``__chunk``; rows with equal texts get the same, unless they are too many for one.

    Rows with equal hashes that hold more than a quarter of a mean chunk go to as many chunks, next to
    one another, as they hold quarters: by the values of all their columns, so a task that runs again deals
    them as before. There are at most four times as many such hashes as chunks. Rows that are alike in all columns have no
    value to be dealt by: where such rows are too many, the table is written and they are dealt by their place in it.
    """
    seeds = [column(text)] if key is None else [column(key), column(text)]
    placed = docs.withColumn("__hash", F.xxhash64(*seeds))
    size = F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long") + ROW_BYTES
    # Summed in the map tasks first, so copies are one row of each.
    groups = placed.select("__hash", size.alias("size")).groupBy("__hash").agg(F.sum("size").alias("size"))
    groups = settled(groups, "sizes")
    total = groups.agg(F.sum("size")).first()[0] or 0
    quarter = max(1, total // (4 * chunks))
    hot = groups.where(F.col("size") > quarter).select(
        F.col("__hash").alias("__hot"),
        F.least(F.ceil(F.col("size") / quarter), F.lit(chunks)).cast("long").alias("__over"),
    )
    start = F.pmod("__hash", F.lit(chunks))
    if chunks == 1 or hot.isEmpty():
        return placed.withColumn("__chunk", start).drop("__hash")
    hot = small(hot)
    met = F.col("__hash") == F.col("__hot")
    every = F.xxhash64(*map(column, docs.columns))
    # Of the hot texts alone: do rows alike in all columns fill more than their share of a chunk?
    alike = placed.join(hot, met).select(every.alias("row"), size.alias("size")).groupBy("row").agg(F.sum("size").alias("size"))
    if not alike.where(F.col("size") > quarter).isEmpty():
        placed = settled(placed, "placed")
        every = F.xxhash64(F.monotonically_increasing_id())
    spread = placed.withColumn("__place", every).join(hot, met, "left")
    chunk = F.pmod(start + F.coalesce(F.pmod("__place", F.col("__over")), F.lit(0)), F.lit(chunks))
    return spread.withColumn("__chunk", chunk).drop("__hash", "__hot", "__over", "__place")


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Rolling:
    """Hashes of all strings of a length, by sums of powers modulo 2**64."""

    STRETCH = 1 << 18

    def __init__(self, seed: int, longest: int = 512):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 60, 1 << 62)) * 4 + 3
        n = self.STRETCH + longest + 1
        self.powers, self.inverse = (_powers(b, n) for b in (base, pow(base, -1, 1 << 64)))

    def windows(self, data: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of each start in ``at`` (sorted), or of all."""
        last = len(data) - length + 1
        out: list[np.ndarray] = []
        for start in range(0, max(0, last), self.STRETCH):
            end = min(last, start + self.STRETCH)
            if at is None:
                own = np.arange(end - start)
            else:
                lo, hi = np.searchsorted(at, [start, end])
                own = at[lo:hi] - start
            if not len(own):
                continue
            part = self.values[data[start : end + length - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * self.inverse[: len(part)], out=sums[1:])
            out.append(mixed((sums[own + length] - sums[own]) * self.powers[own]))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & ((1 << 64) - 1), np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def texts(table: pa.Table, text: str) -> Iterator[bytes]:
    for value in table.column(text).cast(pa.binary()).to_pylist():
        yield value or b""


Send = Callable[[int, pa.Table, pa.Table | None], pa.Table]
