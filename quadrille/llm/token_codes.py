"""Token ids in files of directly addressable codes.

An id is split into chunks of `CHUNK` bits, lowest first. Level k holds the k-th chunk of every id
that has one, as bytes, with a bitmap that says which of them go on, and a rank directory: the
number of ones before each 512th bit. Token i is read by following i through the levels; where it
goes on, its place in the next level is the rank of its bit. Nothing around it is decoded.

A file, little-endian throughout:

    8 bytes   magic "DACIDS01"
    5 x u64   tokens n, documents d, levels L, first token's number within the partition, 0
    L x u64   chunks in each level
    d bytes   1 where the document has an id
    d x i64   document ids;  (d + 1) x u64: where documents begin, in tokens of this file
    for each level: chunks as bytes; bitmap, lowest bit first, padded to 64 bytes; (ceil(m/512) + 1) x u64 ranks

Documents go to files in ascending order of id: Spark deals them to ranges and sorts them there,
each task encodes its range as it comes and begins another file at `file_tokens`, so memory is
bounded however large a range is. Every attempt of a task writes files of its own; the manifest, a table beside
them with a row for each file, names those of the attempts that Spark committed, and only those are read. A single
token takes a few reads of some bytes each, wherever the file is.

Defined cases: null text counts as empty and gives the end id alone; a null doc_id comes first; rows
with one id are ordered by a hash of their text; an empty table gives no file; other columns aren't used.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm.common import map_arrow

MAGIC = b"DACIDS01"
CHUNK = 8
RANK_BITS = 512
#: Marks that are taken off a word's end before it is looked up.
TAIL = ".,!?;:*#$%&|"
#: Distinct words whose ids a worker remembers at most.
REMEMBERED = 800_000


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Spark may write local URIs with one slash."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


# --- codes ---------------------------------------------------------------------------------------


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) for each level."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest >> CHUNK
        on = more > 0
        bitmap = np.packbits(on, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (RANK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bitmap.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(1)
        levels.append(((rest & 255).astype(np.uint8), bitmap, np.concatenate([[0], ones.cumsum()]).astype("<u8")))
        rest = more[on]
    return levels


class Codes:
    """Random access to a file's ids, given whole or as a function (offset, size), which is asked for the few bytes that a token needs."""

    def __init__(self, raw: bytes | memoryview | Callable[[int, int], bytes]) -> None:
        self.read = read = raw if callable(raw) else lambda at, size: raw[at : at + size]
        if bytes(read(0, 8)) != MAGIC:
            raise ValueError("not a file of token codes")
        self.n, self.documents, count, self.first, _ = map(int, self.numbers("<u8", 5, 8))
        sizes = list(map(int, self.numbers("<u8", count, 48)))
        self.names_at = 48 + 8 * count
        at = self.names_at + self.documents + 8 * self.documents + 8 * (self.documents + 1)
        #: where a level's chunks, bitmap and ranks begin
        self.levels = []
        for m in sizes:
            blocks = -(-m // RANK_BITS)
            self.levels.append((at, at + m, at + m + blocks * RANK_BITS // 8))
            at += m + blocks * RANK_BITS // 8 + 8 * (blocks + 1)

    @classmethod
    def open(cls, path: str) -> Codes:
        store, at = store_of(path)
        return cls(lambda offset, size, source=store.open_input_file(at): source.read_at(size, offset))

    def numbers(self, kind: str, count: int, at: int) -> np.ndarray:
        return np.frombuffer(self.read(at, np.dtype(kind).itemsize * count), kind, count) if count else np.zeros(0, kind)

    @property
    def named(self) -> np.ndarray:
        return self.numbers("u1", self.documents, self.names_at).astype(bool)

    @property
    def doc_ids(self) -> np.ndarray:
        return self.numbers("<i8", self.documents, self.names_at + self.documents)

    @property
    def starts(self) -> np.ndarray:
        return self.numbers("<u8", self.documents + 1, self.names_at + 9 * self.documents).astype(np.int64)

    def bits(self, level: int, start: int, end: int) -> np.ndarray:
        low = start // 8
        raw = self.numbers("u1", -(-end // 8) - low, self.levels[level][1] + low)
        return np.unpackbits(raw, bitorder="little")[start - 8 * low :][: end - start].astype(bool)

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i: those before its block, and those before it in the block."""
        block = i // RANK_BITS
        return int(self.numbers("<u8", 1, self.levels[level][2] + 8 * block)[0]) + int(self.bits(level, block * RANK_BITS, i).sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        found, level = 0, 0
        while True:
            found |= int(self.numbers("u1", 1, self.levels[level][0] + i)[0]) << CHUNK * level
            if not self.bits(level, i, i + 1)[0]:
                return found
            i = self.rank(level, i)
            level += 1

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids start to end: one slice of each level, placed by the rank of its first bit."""
        out, where = np.zeros(end - start, np.uint32), np.arange(end - start)
        for level, (chunks, _, _) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= self.numbers("u1", end - start, chunks + start).astype(np.uint32) << np.uint32(CHUNK * level)
            on = self.bits(level, start, end)
            where = where[on]
            if len(where):
                start = self.rank(level, start)
                end = start + len(where)
        return out


def file_bytes(ids: np.ndarray, doc_ids: list[int | None], starts: list[int], first: int) -> Iterator[bytes]:
    levels = encode_levels(ids)
    yield MAGIC
    yield np.array([len(ids), len(doc_ids), len(levels), first, 0], "<u8").tobytes()
    yield np.array([len(c) for c, _, _ in levels], "<u8").tobytes()
    yield np.array([i is not None for i in doc_ids], np.uint8).tobytes()
    yield np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    yield np.array([*starts, len(ids)], "<u8").tobytes()
    for parts in levels:
        for part in parts:
            yield part.tobytes()


# --- tokens --------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    return Tokenizer.from_file(path)


#: How a vocabulary must cut texts for `WordEncoder` to take them word by word (fixed values).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(path: str) -> bool:
    """Whether white space always parts tokens and is dropped, and case is dropped but in added tokens without white space."""
    with open(path, encoding="utf-8") as source:
        made = json.load(source)
    kinds = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])]
    first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    cut_up = (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": PATTERN}, "Removed", True)
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"])) for t in made.get("added_tokens", []))
    return kinds == NORMALIZERS and cut_up and plain


class WordEncoder:
    """Ids of whole texts. The vocabulary drops white space and never joins across it, so the library
    encodes each distinct word once and texts are put together from those. Many words go to
    the library as one text, with a mark between them that stands alone and has an id of its own.

    Of a word that ends in a letter and then marks, the marks are encoded apart and the rest without
    regard to case, as the vocabulary does, unless the word holds an added token in any case: those are
    looked for before the case is dropped. Words are told apart by Arrow, ids are gathered by numpy.

    A vocabulary that isn't made in this way (see `by_words`) gets whole texts instead."""

    MARK = "\x01"

    def __init__(self, path: str) -> None:
        self.library = tokenizer(path)
        self.by_words = by_words(path)
        self.added = sorted({t.content.lower() for t in self.library.get_added_tokens_decoder().values()})
        mark = self.library.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.known: dict[str, bytes] = {"": b""}

    def learn(self, words: list[str]) -> None:
        for w in [w for w in words if self.mark is None or self.MARK in w]:
            self.known[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
        rest = [w for w in words if self.MARK not in w] if self.mark is not None else []
        groups = [rest[k : k + 1000] for k in range(0, len(rest), 1000)]
        between = f" {self.MARK} "
        for group, found in zip(groups, self.library.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            if len(ends) != len(group):
                raise ValueError("the vocabulary doesn't keep the mark apart")
            raw, begin = ids.tobytes(), 0
            for word, end in zip(group, ends, strict=True):
                self.known[word] = raw[4 * begin : 4 * end]
                begin = end + 1

    def look_up(self, words: pa.Array) -> list[bytes]:
        words = words.to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {"": b""}
            new = words
        self.learn(new)
        return list(map(self.known.__getitem__, words))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text's."""
        if not self.by_words:
            found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        told = split.flatten().dictionary_encode()
        distinct = told.dictionary
        core = pc.ascii_rtrim(distinct, characters=TAIL)
        # the one letter whose lower case ends in a mark
        apart = pc.and_not(pc.match_substring_regex(core, r"\pL$"), pc.ends_with(core, "\u0130"))
        lower = pc.ascii_lower(core)
        for token in self.added:
            apart = pc.and_not(apart, pc.match_substring(lower, token))
        base = pc.if_else(apart, lower, distinct).dictionary_encode()
        marks = np.where(apart.to_numpy(zero_copy_only=False), pc.subtract(pc.binary_length(distinct), pc.binary_length(core)).to_numpy(), 0)
        with_marks = np.flatnonzero(marks)
        tail = pa.array([w[-n:] for w, n in zip(distinct.take(pa.array(with_marks)).to_pylist(), marks[with_marks].tolist(), strict=True)], pa.string()).dictionary_encode()
        pieces = self.look_up(base.dictionary)
        first_tail = len(pieces)
        pieces += self.look_up(tail.dictionary) + [b""]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(pieces), np.uint32)
        ends = np.full(len(distinct), len(pieces) - 1)
        ends[with_marks] = first_tail + tail.indices.to_numpy()
        both = np.stack([base.indices.to_numpy(), ends], 1)[told.indices.to_numpy()].ravel()
        lengths = sizes[both]
        total = np.cumsum(lengths)
        at = np.repeat(starts[both] - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)
        upto = np.concatenate([[0], total])[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]
        return ids[at], np.diff(upto)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for a worker process: its next task finds the words again."""
    return WordEncoder(path)


def slices(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about `size` bytes of text."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
    at = 0
    while at < len(batch):
        done = int(sizes[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, done + size, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


# --- Spark ---------------------------------------------------------------------------------------

MANIFEST = "partition int, file int, path string, tokens long, documents long, first long"


def write_codes(docs: DataFrame, directory: str, vocabulary: str = "", end_id: int = 1, file_tokens: int = 8 << 20, ranges: int = 0) -> DataFrame:
    """Write docs (doc_id, text) under directory, a folder that all executors share; the manifest, read back."""
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(ranges, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, words = TaskContext.get().partitionId(), encoder(path)
        store, root = store_of(directory)
        store.create_dir(root, recursive=True)
        ids, names, starts, held, file, first = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{partition:06d}-{file:06d}-{TaskContext.get().taskAttemptId()}.dac"
            with store.open_output_stream(f"{root}/{name}") as out:
                for part in file_bytes(np.concatenate(ids), names, starts, first):
                    out.write(part)
            row = [partition, file, f"{directory}/{name}", held, len(names), first]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["partition", "file", "path", "tokens", "documents", "first"])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part in slices(batch):
                found, counts = words.batch(part.column("text"))
                ends = np.cumsum(counts)
                for doc_id, upto, count in zip(part.column("doc_id").to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                    if held and held + count + 1 > file_tokens:
                        yield close()
                        ids, names, starts, held, file, first = [], [], [], 0, file + 1, first + held
                    names.append(doc_id)
                    starts.append(held)
                    ids += [found[upto - count : upto], end]
                    held += count + 1
        if names:
            yield close()

    table = f"{directory}/manifest"
    map_arrow(ordered, write, MANIFEST).write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)


def read_codes(spark: SparkSession, directory: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files under directory."""
    manifest = spark.read.parquet(f"{directory}/manifest")
    # one number for each range; there are as many as the writer had tasks
    totals = sorted((r["partition"], r["tokens"]) for r in manifest.groupBy("partition").agg(F.sum("tokens").alias("tokens")).collect())
    before, base = {}, 0
    for partition, tokens in totals:
        before[partition] = base
        base += tokens
    files = manifest.select("partition", "path").repartition(max(1, len(totals)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for partition, path in zip(batch.column("partition").to_pylist(), batch.column("path").to_pylist(), strict=True):
                store, at = store_of(path)
                with store.open_input_file(at) as source:
                    codes = Codes(source.read())  # every token is wanted, and a file is bounded
                starts = codes.starts
                sums = [zlib.crc32(codes.span(a, b).astype("<u4").tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(codes.doc_ids, pa.int64(), mask=~codes.named), pa.array(starts[:-1] + codes.first + before[partition], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return map_arrow(files, read, "doc_id long, start long, n_tokens long, ids_crc32 long")
