"""Suffix-array dedup: remove every byte that lies in a string of `width` bytes found elsewhere too.

Shards. Equal strings of `width` bytes have their least `SEED`-byte hash at the same place inside, so those
hashes deal the windows of all documents to groups without parting two equal ones. Windows in a row whose
least hash stands at one place make a tile; a tile is known by that hash and a hash of its bytes. No
two windows of one tile are equal, since the place is at another distance from each. Spark counts tiles
by least hash: where it occurs once, no window of the tile can be repeated; where it occurs
more than once but with the same bytes only, all of them are (copies are counted, not sorted: a departure
from sorting everything). Only tiles whose hash occurs with different bytes are read: each distinct one once.

Groups of more than `group` bytes, as at the edges of passages that very many documents share, are parted further:
their tiles are cut again by the least hashes under FINE orders at once, which equal windows share as well. What
is still larger is settled window by window, by counting 128-bit hashes. So no task gets an unbounded group.

Groups are packed into shards of about `shard` bytes. In a shard, the suffixes of its tiles are put in order with
their common prefixes by external induced sorting (module induced), whose queues and arrays are on disk. A window is
repeated where a common prefix with a neighbour reaches `width`, or where its whole tile occurs more than once.
Repeated windows go back to the documents, where they unite to the spans that are removed.

Documents are known by two 64-bit hashes of id and text, tiles by two 64-bit hashes. Defined cases: null text counts as
empty; texts below `width` bytes lose nothing; a repeated row loses everything that reaches `width`
bytes, in each copy; an empty table gives an empty result; of the other columns only doc_id is returned.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from quadrille.llm.common import cut, look_up, map_arrow, stored
from quadrille.llm.induced import Windows

SEED = 32
#: Low bits that name a place; the others compare hashes.
PLACE = 31
#: Orders of hashes by which large groups are parted.
FINE = 4
#: Bytes of text hashed at a time.
BLOCK = 2 << 20

SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def mixed_up(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each place, up to the last whole one."""
    base = 0x9E3779B97F4A7C15
    h, length = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    h ^= h >> np.uint64(29)
    while length < SEED:
        h = h[:-length] * np.uint64(pow(base, length, 1 << 64)) + h[length:]
        length *= 2
    return mixed_up(h)


def least_in_windows(h: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while 2 * have <= size:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = size - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def tiles(texts: list[bytes], width: int, orders: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with a window: its number, and the least hash (under several orders: of all of them, and how they lie), first window and number of windows of its tiles."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BLOCK):
            size += len(texts[upto])
            upto += 1
        some = [k for k in range(at, upto) if len(texts[k]) >= width]
        at = upto
        if not some:
            continue
        data = np.frombuffer(b"".join(texts[k] for k in some), np.uint8)
        seeds = seed_hashes(data)
        numbers = np.arange(len(seeds), dtype=np.uint64)
        places = []
        for order in range(orders):
            h = mixed_up(seeds ^ np.uint64(order * 0xA0761D6478BD642F % (1 << 64))) if order else seeds
            # the first place of those with the least hash
            least = least_in_windows(h >> np.uint64(PLACE) << np.uint64(PLACE) | numbers, width - SEED + 1)
            places.append((least & np.uint64((1 << PLACE) - 1)).astype(np.int64))
        name = seeds[places[0]]
        for place in places[1:]:
            name = mixed_up(name * np.uint64(0x9E3779B97F4A7C15) ^ seeds[place] + (place - places[0]).astype(np.uint64))
        begin = 0
        for k in some:
            own = slice(begin, begin + len(texts[k]) - width + 1)
            begin += len(texts[k])
            new = np.zeros(own.stop - own.start, bool)
            new[0] = True
            for place in places:
                new[1:] |= place[own][1:] != place[own][:-1]
            starts = np.flatnonzero(new)
            yield k, name[own][starts].view(np.int64), starts, np.diff(np.append(starts, len(new)))


def runs(flags: np.ndarray) -> np.ndarray:
    """Starts and lengths of the runs of true flags, a row each."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return np.stack([edges[::2], edges[1::2] - edges[::2]], 1)


def digests(raw: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    view = memoryview(raw)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)).view(np.int64)


def as_bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def columns_of(parts: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in parts.values()], list(parts))


#: A distinct tile, or a part of one that starts `off` windows into it, to be sorted with the others of its group g.
PIECE = StructType([*(StructField(f, LongType()) for f in ("g", "h", "c", "off", "n")), StructField("piece", BinaryType())])
REPEATED = "h long, c long, off long, windows long"


def sort_shards(pieces: DataFrame, width: int, shard: int, memory: int) -> DataFrame:
    """PIECE -> REPEATED, by suffix order in shards."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, last = Windows(width, memory), array("q"), None

        def close() -> Iterator[pa.RecordBatch]:
            of = np.frombuffer(held, np.int64).reshape(-1, 4)
            found, lengths, first = [], [], 0
            for k, flags in enumerate(windows.flags(), 1):
                found.append(runs(np.ones_like(flags) if of[k - 1, 3] > 1 else flags))
                lengths.append(len(found[-1]))
                if k == len(of) or len(found) == 100_000:
                    flat, owner = np.concatenate(found), np.repeat(of[first:k], lengths, axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owner[:, 0]), pa.array(owner[:, 1]), pa.array(owner[:, 2] + flat[:, 0]), pa.array(flat[:, 1])], ["h", "c", "off", "windows"]
                    )
                    found, lengths, first = [], [], k

        for batch in batches:
            for g, h, c, off, n, piece in zip(*(batch.column(f).to_pylist() for f in PIECE.names), strict=True):
                if windows.size >= shard and g != last:  # a group stays together
                    yield from close()
                    windows, held = Windows(width, memory), array("q")
                held.extend((h, c, off, n))
                windows.add(piece)
                last = g
        if len(held):
            yield from close()

    dealt = pieces.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g", "h", "c", "off")
    return map_arrow(dealt, sort, REPEATED)


def part_further(crowded: DataFrame, width: int, group: int) -> tuple[DataFrame, DataFrame]:
    """PIECE rows of groups that are too large -> (PIECE rows of smaller groups, REPEATED rows that are settled by counting)."""

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            h, c, n = (batch.column(f).to_numpy() for f in ("h", "c", "n"))
            parts: dict[str, list[np.ndarray]] = {f: [] for f in ("g", "d", "h", "c", "off", "n", "windows")}
            for k, name, starts, counts in tiles(texts, width, FINE):
                d = digests(texts[k], starts.tolist(), (starts + counts + (width - 1)).tolist())
                for f, v in zip(parts, (name, d, *(np.full(len(starts), x[k]) for x in (h, c)), starts, np.full(len(starts), n[k]), counts), strict=True):
                    parts[f].append(v)
            if parts["g"]:
                yield columns_of(parts)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, some in zip(batch.column("piece").to_pylist(), batch.column("some"), strict=True):
                items = some.values
                for off, windows, n, h, c in zip(*(items.field(f).to_pylist() for f in ("off", "windows", "n", "h", "c")), strict=True):
                    keys = [xxhash.xxh3_128_hexdigest(texts[a : a + width]) for a in range(off, off + windows)]
                    count = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), *(pa.array(np.full(count, v, np.int64)) for v in (h, c)), pa.array(np.arange(off, off + windows)), pa.array(np.full(count, n, np.int64))],
                        ["w", "h", "c", "off", "n"],
                    )

    fine = stored(map_arrow(crowded, finer, "g long, d long, h long, c long, off long, n long, windows long"))
    size = F.sum(F.col("windows") + (width - 1))
    counted = fine.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("times"), (F.min("d") == F.max("d")).alias("alike"), (size > group).alias("large"))
    judged = stored(look_up(fine, cut(counted), "g").select(*fine.columns, "found.times", "found.alike", "found.large").filter("times > 1"))
    settled = judged.filter("alike").select("h", "c", "off", "windows")
    part = F.expr(f"substring(piece, cast(off + 1 as int), cast(windows + {width - 1} as int))")
    of_piece = crowded.select("h", "c", "piece")
    small = judged.filter("NOT alike AND NOT large").select("g", "h", "c", "off", "n", "windows").join(of_piece, ["h", "c"]).select("g", "h", "c", "off", "n", part.alias("piece"))
    large = judged.filter("NOT alike AND large").groupBy("h", "c").agg(F.collect_list(F.struct("off", "windows", "n", "h", "c")).alias("some"))
    window = stored(map_arrow(large.join(of_piece, ["h", "c"]).select("piece", "some"), single, "w string, h long, c long, off long, n long"))
    times = cut(window.groupBy("w").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("times")).filter("times > 1").select("w", F.col("m").alias("n"), "times"))
    twice = look_up(window, times, "w").filter("found IS NOT NULL").select("h", "c", "off", F.lit(1).cast("long").alias("windows"))
    return small, settled.unionByName(twice)


def repeated_spans(keyed: DataFrame, width: int, shard: int, group: int, memory: int) -> DataFrame:
    """(k, k2, text) -> (k, k2, spans): where windows that are repeated stand, overlapping as they come."""

    def cut_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(f).to_numpy() for f in ("k", "k2")]
            for low in range(0, len(batch), 512):
                texts = [as_bytes(t) for t in batch.column("text").slice(low, 512)]
                parts: dict[str, list[np.ndarray]] = {f: [] for f in ("h", "c", "k", "k2", "p")}
                for i, least, starts, counts in tiles(texts, width):
                    c = digests(texts[i], starts.tolist(), (starts + counts + (width - 1)).tolist())
                    for f, v in zip(parts, (least, c, *(np.full(len(starts), key[low + i], np.int64) for key in keys), starts << 16 | counts), strict=True):
                        parts[f].append(v)
                if parts["h"]:
                    yield columns_of(parts)

    start, count = F.shiftright("p", 16), F.col("p").bitwiseAND(F.lit(0xFFFF))
    tile = stored(map_arrow(keyed.select("k", "k2", "text"), cut_tiles, "h long, c long, k long, k2 long, p long"))
    counted = tile.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.sum(count + (width - 1)).alias("bytes"))
    often = cut(counted.filter("n > 1").select("h", "n", (F.col("c0") == F.col("c1")).alias("alike"), (F.col("bytes") > group).alias("crowded")))
    found = stored(look_up(tile, often, "h").filter("found IS NOT NULL").select("h", "c", "k", "k2", "p", "found.alike", "found.crowded"))

    alike = found.filter("alike").select("k", "k2", start.alias("start"), (start + count + (width - 1)).alias("end"))
    mixed = found.filter("NOT alike")
    distinct = cut(mixed.groupBy("h", "c", "crowded").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "k2", "p")).alias("at")))
    wanted = distinct.groupBy(F.col("at.k").alias("k"), F.col("at.k2").alias("k2")).agg(F.collect_list(F.struct("h", "c", "n", "at.p", "crowded")).alias("tiles"))

    def read_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, some in zip(batch.column("text"), batch.column("tiles"), strict=True):
                raw, items = as_bytes(text), some.values
                h, c, n, p = (items.field(f).to_numpy() for f in ("h", "c", "n", "p"))
                pieces = [raw[a : a + b + width - 1] for a, b in zip((p >> 16).tolist(), (p & 0xFFFF).tolist(), strict=True)]
                columns = [pa.array(v) for v in (h, h, c, np.zeros_like(h), n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary()), items.field("crowded")], [*PIECE.names, "crowded"])

    texts = keyed.join(wanted, ["k", "k2"]).dropDuplicates(["k", "k2"]).select("text", "tiles")
    pieces = map_arrow(texts, read_tiles, StructType([*PIECE.fields, StructField("crowded", BooleanType())]))
    if distinct.filter("crowded").isEmpty():
        repeated = sort_shards(pieces.drop("crowded"), width, shard, memory)
    else:
        pieces = stored(pieces)
        small, settled = part_further(pieces.filter("crowded").drop("crowded"), width, group)
        repeated = sort_shards(pieces.filter("NOT crowded").drop("crowded").unionByName(small), width, shard, memory).unionByName(settled)
    of_tile = repeated.groupBy("h", "c").agg(F.collect_list(F.struct("off", "windows")).alias("repeats"))
    named = cut(of_tile.join(distinct.select("h", "c", "n"), ["h", "c"]))
    begin = start + F.col("repeat.off")
    others = (
        look_up(mixed, named, ["h", "c"]).select("k", "k2", "p", F.explode("found.repeats").alias("repeat"))
        .select("k", "k2", begin.alias("start"), (begin + F.col("repeat.windows") + (width - 1)).alias("end"))
    )
    # a set: rows with one id and text share a key, and each of them brings its spans
    return alike.unionByName(others).groupBy("k", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def united(spans: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch, as one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(first)
    return np.stack([spans[at, 0], reach[np.append(at[1:] - 1, len(spans) - 1)]], 1)


def remove_repeats(docs: DataFrame, width: int = 200, shard: int = 6 << 20, group: int = 2 << 20, memory: int = 32 << 20) -> DataFrame:
    """doc_id with n_bytes, n_removed, removed (spans in bytes), kept (the bytes that remain) and kept_sha256.

    memory: what a queue may hold before it writes to disk. A task has one shard at a time, of `shard` and `group` bytes at most.
    """
    key = [F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")]
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).select(*key, "doc_id", "text")
    spans = repeated_spans(keyed.select("k", "k2", "text"), width, shard, group, memory)
    joined = keyed.join(spans, ["k", "k2"], "left").select("doc_id", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, removed, kept, digest = [], [], [], [], []
            for text, some in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = as_bytes(text)
                items = some.values
                found = united(np.stack([items.field("start").to_numpy(), items.field("end").to_numpy()], 1)) if items is not None else np.zeros((0, 2), np.int64)
                left, at = [], 0
                for a, b in found.tolist():
                    left.append(raw[at:a])
                    at = b
                left = b"".join([*left, raw[at:]])
                size.append(len(raw))
                gone.append(len(raw) - len(left))
                removed.append([{"start": a, "end": b} for a, b in found.tolist()])
                kept.append(left)
                digest.append(hashlib.sha256(left).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "removed", "kept", "kept_sha256"])

    schema = StructType([docs.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("removed", SPANS), StructField("kept", BinaryType())])
    return map_arrow(joined, apply, schema.add("kept_sha256", "string"))
