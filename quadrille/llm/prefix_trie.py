"""Conversation prefix trie: a burst trie over sequences of turns.

A conversation is the sequence of its turns' ids (MD5 of role and text, 16 bytes each, one after the other, so that
bytes sort as turns do). Equal sequences are made one row first, with their number and least id. All rows begin in one
container under the root. A container with over `capacity` turns in several rows bursts: the turns that all its rows
share, found as the common prefix of its least and greatest row, become heads with one child each, and every row goes on to
the container of its next turn id. What is left are containers of bounded size (or single rows); they are sorted by Spark, dealt to tasks by
their head, and swept into nodes with a stack. Totals of burst heads are summed from the containers below, round by round.

Rows of heads that hold over 1/4096 of all rows meet their head by broadcast (fewer than 4096 such heads), all others by a merge
join. Rounds go by branchings of oversized containers, not by turns; only whether there are any reaches the driver.
Checkpointed rows in the shared folder are what a lost executor's tasks start from.

Ids of members that end at a node are hashed in order: rows are dealt by ranges of (sequence, id), each range hashes what begins and ends
in it, and only runs that touch the edge of a range are passed on, as text of up to PIECE ids. SHA-256 has no way to be joined from parts, so the text of one
node's ids goes through one task at last, in pieces, with a running hash.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then role, then text, and repeated rows are turns of their own; rows
without a conv_id are left out; other columns don't matter; an empty table has no nodes, not even a root. A conversation must fit one
row, as in chat formatting. Sequences are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quadrille.llm.common import HEAVY, WORD, cut, map_arrow, meet

#: Turns (and rows) a container may hold before it bursts.
CAPACITY = 1024
#: Ids whose text is one piece of what is hashed.
PIECE = 1 << 16
ID = 16
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- conversations to sequences ------------------------------------------------------------------


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turns array<struct<id, words>>), in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), text.alias("text"),
            F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
        ).alias("t"),
    )
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    return told.groupBy("conv_id").agg(turns.alias("turns"))


def share_starts(seqs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % every (none if absent) in place of its own first h; h = crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    bases = seqs.filter(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_first"))
    own = seqs.withColumn("_base", F.col("conv_id") - F.pmod("conv_id", F.lit(every))).withColumn("_h", h)
    both = meet(own, bases, "_base", "left")
    start = F.slice(F.coalesce("_first", F.filter("turns", lambda t: F.lit(False))), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return both.select("conv_id", F.concat(start, rest).alias("turns"))


def keyed(seqs: DataFrame) -> DataFrame:
    """(conv_id, seq, words, key): ids as bytes and the hash that names the sequence."""
    out = seqs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))
    return out.withColumn("key", F.unhex(F.md5("seq")))


# --- hashes of ids in order ----------------------------------------------------------------------


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of runs of equal keys."""
    at = np.flatnonzero(key[1:] != key[:-1]) + 1
    bounds = [0, *at.tolist(), len(key)]
    return list(zip(bounds, bounds[1:], strict=False))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) -> (key, first, text, sha): sha where a key begins and ends inside this partition, else pieces of text."""
    names = ["key", "first", "text", "sha"]
    inner = None  # key, first id, text so far, and whether the partition began with it
    edge = True

    def row(key: bytes, first: int, text: str | None, sha: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([text], pa.string()), pa.array([sha], pa.string())], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = np.array(batch.column("key").to_pylist(), dtype=object), batch.column("conv_id").to_pylist()
        done: list[tuple[bytes, int, str]] = []
        for a, b in _runs(keys):
            if inner and inner[0] != keys[a]:
                if inner[3]:
                    yield row(inner[0], inner[1], ",".join(map(str, inner[2])), None)
                else:
                    done.append((inner[0], inner[1], hashlib.sha256(",".join(map(str, inner[2])).encode()).hexdigest()))
                inner, edge = None, False
            if inner is None:
                inner = [keys[a], ids[a], [], edge]
            inner[2] += ids[a:b]
            while len(inner[2]) > PIECE:  # a long run goes on as pieces, wherever it began
                yield row(inner[0], inner[1], ",".join(map(str, inner[2][:PIECE])), None)
                inner = [inner[0], inner[2][PIECE], inner[2][PIECE:], True]
        if done:
            key, first, sha = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(first, pa.int64()), pa.nulls(len(key), pa.string()), pa.array(sha, pa.string())], names)
    if inner:
        yield row(inner[0], inner[1], ",".join(map(str, inner[2])), None)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (key, first) -> (key, sha), with a running hash."""
    at, running = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["key", "sha"])

    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    yield row()
                at, running = key, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
    if at is not None:
        yield row()


def ends(convs: DataFrame) -> DataFrame:
    """(key, conv_id) -> (key, sha): of each sequence's ids in order, comma-joined."""
    dealt = convs.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = cut(map_arrow(dealt, _pieces, "key binary, first bigint, text string, sha string"))
    open_ones = found.filter("sha is null").select("key", "first", "text").repartition("key").sortWithinPartitions("key", "first")
    return found.filter("sha is not null").select("key", "sha").unionByName(map_arrow(open_ones, _joined, "key binary, sha string"))


# --- the trie ------------------------------------------------------------------------------------


def _share(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the start."""
    return len(os.path.commonprefix([a, b])) // ID


@F.udf(IntegerType())
def _shared(a, b):
    return _share(bytes(a), bytes(b))


def _head(depth: Column) -> Column:
    return F.unhex(F.md5(F.substring("seq", F.lit(1), depth * ID)))


def _with_heads(live: DataFrame, heads: DataFrame) -> DataFrame:
    """live with `of`, the struct of its burst head, null where its container didn't burst. heads: head, rows, ..."""
    total = live.count()
    values = heads.select("head", F.struct(*[c for c in heads.columns if c != "head"]).alias("of"))
    heavy, light = values.filter(F.col("of.rows") * HEAVY > total), values.filter(F.col("of.rows") * HEAVY <= total)
    marked = live.join(F.broadcast(heavy), "head", "left")
    rest = meet(marked.filter("of is null").drop("of"), light, "head", "left")
    return marked.filter("of is not null").select(*live.columns, "of").unionByName(rest.select(*live.columns, "of"))


def _nodes_of(rows: list[tuple], depth: int) -> tuple[list, ...]:
    """Rows (seq, words, n, least, sha) of a container in order -> its nodes as columns: depth, parent (its place), n, least, children, leaves, saved, sha."""
    at, parent, n, least, children, leaves, saved, words, sha = ([] for _ in range(9))
    stack: list[int] = []

    def close() -> None:
        k = stack.pop()
        leaves[k] = leaves[k] or 1
        saved[k] += (n[k] - 1) * words[k]
        up = parent[k]
        if up >= 0:
            n[up] += n[k]
            least[up] = min(least[up], least[k])
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]

    before = None
    for seq, turns, count, first, end in rows:
        length = len(seq) // ID
        common = depth - 1 if before is None else _share(before, seq)
        while len(stack) > common - depth + 1:
            close()
        for d in range(common + 1, length + 1):
            parent.append(stack[-1] if stack else -1)
            stack.append(len(at))
            at.append(d)
            words.append(turns[d - 1] if d else 0)
            for column, value in ((n, 0), (least, first), (children, 0), (leaves, 0), (saved, 0), (sha, NO_ENDS)):
                column.append(value)
        k = stack[-1]
        n[k], least[k], sha[k] = n[k] + count, min(least[k], first), end
        before = seq
    while stack:
        close()
    return at, parent, n, least, children, leaves, saved, sha


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (head, seq) -> nodes; the top one of each container with its head and the head above."""
    head, rows = None, []

    def out() -> pa.RecordBatch:
        name, above, depth, up = head
        at, parent, n, least, children, leaves, saved, sha = _nodes_of(rows, depth)
        parents = [up if p < 0 else least[p] for p in parent]
        top, over = [name if p < 0 else None for p in parent], [above if p < 0 else None for p in parent]
        columns = [least, at, parents, n, children, leaves, saved]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(sha, pa.string()), pa.array(top, pa.binary()), pa.array(over, pa.binary())], [f"c{k}" for k in range(10)])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("head", "above", "depth", "up", "seq", "words", "n", "least", "sha")], strict=True):
            if head is None or row[0] != head[0]:
                if rows:
                    yield out()
                head, rows = row[:4], []
            rows.append(row[4:])
    if rows:
        yield out()


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Burst heads with the totals from below -> the nodes of the turns that their rows share."""
    names = ("depth", "branch", "up", "words", "n", "least", "sha", "children", "leaves", "saved", "head", "above")
    for batch in batches:
        for depth, branch, up, words, n, least, sha, children, leaves, saved, head, above in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            size = branch - depth + 1
            own = np.array([words[d - 1] if d else 0 for d in range(depth, branch + 1)], np.int64) * (n - 1)
            first = lambda value, rest: [value, *[rest] * (size - 1)]
            columns = [[least] * size, range(depth, branch + 1), first(up, least), [n] * size, [1] * (size - 1) + [children], [leaves] * size, own[::-1].cumsum()[::-1] + saved]
            more = [pa.array([NO_ENDS] * (size - 1) + [sha], pa.string()), pa.array(first(head, None), pa.binary()), pa.array(first(above, None), pa.binary())]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], *more], [f"c{k}" for k in range(10)])


_SWEPT = ", ".join(f"c{k} bigint" for k in range(7)) + ", c7 string, c8 binary, c9 binary"


def build(convs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(conv_id, seq, words, key) as keyed() gives them -> nodes (see NODE)."""
    convs = cut(convs)
    one = convs.groupBy("key").agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    live = meet(one, ends(convs), "key").select(
        "seq", "words", "n", "least", "sha", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("up"), F.unhex(F.md5(F.lit(""))).alias("head"), F.lit(None).cast("binary").alias("above")
    )
    live, bursts, settled = cut(live), [], []
    while True:
        turns = F.octet_length("seq") / ID - F.col("depth") + 1
        over = live.groupBy("head").agg(F.count(F.lit(1)).alias("rows"), F.sum(turns).alias("turns")).filter((F.col("turns") > capacity) & (F.col("rows") > 1)).select("head", "rows")
        over = cut(over)
        if over.isEmpty():
            settled.append(live)
            break
        marked = cut(_with_heads(live, over))
        settled.append(marked.filter("of is null").drop("of"))
        burst = marked.filter("of is not null").drop("of")
        ends_of = burst.groupBy("head", "above", "depth", "up").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("least").alias("least"), F.min(F.struct("seq", "words", "sha")).alias("low"), F.max("seq").alias("high")
        )
        branch = _shared(F.col("low.seq"), F.col("high"))
        heads = cut(
            ends_of.withColumn("branch", branch).select(
                "head", "above", "depth", "up", "rows", "n", "least", "branch", F.slice("low.words", F.lit(1), F.col("branch")).alias("words"),
                F.when(F.octet_length("low.seq") == F.col("branch") * ID, F.col("low.sha")).otherwise(NO_ENDS).alias("sha"),
            )
        )
        bursts.append(heads)
        moved = _with_heads(burst, heads.select("head", "rows", "branch", F.col("least").alias("first"))).filter(F.octet_length("seq") > F.col("of.branch") * ID)
        deeper = F.col("of.branch") + 1
        live = cut(moved.select("seq", "words", "n", "least", "sha", deeper.alias("depth"), F.col("of.first").alias("up"), _head(deeper).alias("head"), F.col("head").alias("above")))
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    swept = cut(map_arrow(rows.repartition("head").sortWithinPartitions("head", "seq"), _sweep, _SWEPT))
    found, tops = swept, swept.filter("c8 is not null")
    for heads in reversed(bursts):  # a few rounds; each head gets the totals of what hangs below it
        below = tops.groupBy(F.col("c9").alias("head")).agg(F.count(F.lit(1)).alias("children"), F.sum("c5").alias("leaves"), F.sum("c6").alias("saved"))
        chains = cut(map_arrow(meet(heads, below, "head"), _chains, _SWEPT))
        found, tops = found.unionByName(chains), tops.unionByName(chains.filter("c8 is not null"))
    return found.select(*[F.col(f"c{k}").alias(f.split()[0]) for k, f in enumerate(NODE.split(", "))])
