"""Spelling variant grouping: words one edit apart, found by search schemes in FM-indexes of both directions.

Of two words one edit apart, one half of either stands unchanged in the other. So each word is searched twice: its
last half exactly from the end, then on to the left over the other half with one error; and its first half from the
start, on to the right. The first search runs in an index of the vocabulary, the second in one of the reversed vocabulary,
each word closed by a delimiter. A state is an interval of suffix ranks; one table look-up for each end extends it by a letter, and
one row of the table by all letters. States without an error and with one go left in step; inserted, replaced and left out letters turn the former into the latter.

Words are dealt to tasks by the half that has to match, so that a word meets all it can be near to; as a target it is dealt by the half lengths of
words one shorter and one longer too, two rows for each direction. A task takes halves together until their words have BLOCK letters and builds
an index of those; words of one half beyond that are cut into several indexes, each searched by all of that half. A pair that
both searches find is kept by the first alone. Forms are followed by doubling, on Spark.

Defined cases: a null text has no words, a null doc_id counts as an empty one; repeated rows count each; other columns don't matter; an empty table
has no words; texts are read whole. Words are counted in tasks first, REMEMBERED distinct ones at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import cut, map_arrow, meet

#: Letters of an index: its tables have a row for each.
BLOCK = 1 << 17
#: Distinct words a task counts before it passes them on.
REMEMBERED = 1 << 19
#: Steps to the left after which equal states are looked for: only long words with periods have many.
STEPS = 24

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, a byte for each letter."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _short(doc_id: str, word: bytes) -> bytes:
    """Without the letter that the checksum of the document's id and the word names."""
    at = crc32(word.decode("latin-1").encode(), crc32(f"{doc_id}:".encode())) % len(word)
    return word[:at] + word[at + 1 :]


def counts(docs: DataFrame, modulus: int = 0) -> DataFrame:
    """(doc_id, text) -> (word, n). With a modulus, runs whose checksum with the document's id it divides lose a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = words_of(text.as_py() or "")
                if modulus and found:
                    start = crc32(f"{doc_id}:".encode())
                    here = Counter(found)
                    changed = [w for w in here if not crc32(w if w.isascii() else w.decode("latin-1").encode(), start) % modulus]
                    for w, k in [(w, here.pop(w)) for w in changed]:
                        seen[_short(doc_id, w)] += k
                    seen.update(here)
                else:
                    seen.update(found)
                if len(seen) > REMEMBERED:
                    yield out()
                    seen = Counter()
        if seen:
            yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return map_arrow(rows, count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# --- the index of one direction ------------------------------------------------------------------


class Index:
    """Suffix ranks of words, each closed by a delimiter that sorts first; words: distinct, not empty."""

    def __init__(self, words: list[bytes]) -> None:
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        codes = np.zeros(256, np.int64)
        letters = np.unique(raw)
        codes[letters] = np.arange(len(letters))
        self.text = codes[raw]
        self.size = np.array([len(w) for w in words])
        self.start = np.concatenate([[0], (self.size + 1).cumsum()[:-1]])
        n, owner = len(self.text), np.repeat(np.arange(len(words)), self.size + 1)
        end = (self.start + self.size)[owner]
        rank, width, bits = self.text.copy(), 1, 7
        place = np.arange(n)

        def after(k: int) -> np.ndarray:
            """The rank k places on, 0 beyond the word's end."""
            ahead = np.zeros(n, np.int64)
            ahead[:-k or None] = rank[k:]
            return np.where(place + k <= end, ahead, 0)

        while width < 8:  # eight letters fit one number
            rank = rank << (bits * width) | after(width) if width < n else rank << (bits * width)
            width *= 2
        order = np.argsort(rank, kind="stable")
        while width < self.size.max(initial=0) + 1:
            rank = self._dense(rank, order) * (n + 1)
            rank += self._dense_after(rank // (n + 1), width, place, end)
            order = np.argsort(rank, kind="stable")
            width *= 2
        before = np.where(place == self.start[owner], 0, np.concatenate([[0], self.text[:-1]]))[order]
        table = np.zeros((n + 1, len(letters)), np.int32)
        table[place + 1, before] = 1
        np.cumsum(table, axis=0, out=table)
        first = np.concatenate([[0], np.bincount(before, minlength=len(letters)).cumsum()[:-1]])
        self.table = table + first.astype(np.int32)  # rank of the interval's end after one letter to the left
        self.whole = owner[order[before == 0]]  # words in the order of their ranks

    @staticmethod
    def _dense(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
        high = np.zeros(len(rank), np.int64)
        sorted_rank = rank[order]
        high[order] = np.concatenate([[0], (sorted_rank[1:] != sorted_rank[:-1]).cumsum()])
        return high

    @staticmethod
    def _dense_after(dense: np.ndarray, k: int, place: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Dense rank k places on, plus one; 0 beyond the word's end."""
        ahead = np.zeros(len(dense), np.int64)
        if k < len(dense):
            ahead[:-k] = dense[k:] + 1
        return np.where(place + k <= end, ahead, 0)

    def near(self, asked: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of this index by number, their last `fixed` letters exact, the others with one error: distinct pairs (place in asked, word)."""
        table, start, size = self.table, self.start[asked], self.size[asked]
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(self.size))
        for t in range(int(fixed.max(initial=0))):
            on = np.flatnonzero(fixed > t)
            c = self.text[start[on] + size[on] - 1 - t]
            low[on], high[on] = table[low[on], c], table[high[on], c]
        left = size - fixed
        exact = np.zeros(0, np.int64)  # queries on their way without an error; their intervals are in low and high
        q, a, b = (np.zeros(0, np.int64) for _ in range(3))  # states with one error
        for r in range(int(left.max(initial=0)), -1, -1):
            exact = np.concatenate([exact, np.flatnonzero(left == r)])
            lo, hi = table[low[exact]], table[high[exact]]
            row, c = np.nonzero(hi > lo)
            row_lo, row_hi, row_q = lo[row, c].astype(np.int64), hi[row, c].astype(np.int64), exact[row]
            letter = c > 0  # the delimiter can't be put in
            q, a, b = np.concatenate([q, row_q[letter]]), np.concatenate([a, row_lo[letter]]), np.concatenate([b, row_hi[letter]])
            if r == 0:
                break
            nxt = self.text[start[q] + r - 1]
            a, b = table[a, nxt].astype(np.int64), table[b, nxt].astype(np.int64)
            alive = b > a
            own = self.text[start[exact] + r - 1]
            other = letter & (c != own[row])
            q = np.concatenate([q[alive], row_q[other], exact])
            a, b = np.concatenate([a[alive], row_lo[other], low[exact]]), np.concatenate([b[alive], row_hi[other], high[exact]])
            low[exact], high[exact] = table[low[exact], own], table[high[exact], own]
            if r > STEPS or left.max() - r > STEPS:
                _, kept = np.unique(q * (len(self.text) + 1) + a, return_index=True)
                q, a, b = q[kept], a[kept], b[kept]
        first, last = table[a, 0], table[b, 0]
        hit = last > first
        pairs = np.unique(q[hit] * len(self.size) + self.whole[first[hit]])
        return pairs // len(self.size), pairs % len(self.size)


def _search(words: list[str], n: np.ndarray, asked: list[int], mirrored: bool) -> pa.RecordBatch:
    """For each asked word its near ones of this direction: their number and the most frequent."""
    spelled = [w.encode("latin-1") for w in words]
    if mirrored:
        spelled = [w[::-1] for w in spelled]
    size = np.array([len(w) for w in words])
    query = np.array(asked, np.int64)
    fixed = size[query] // 2 if mirrored else (size[query] + 1) // 2
    found_q, found_v = [], []
    chars = (size + 1).cumsum()
    blocks = np.searchsorted(chars, np.arange(BLOCK, chars[-1] + BLOCK, BLOCK)) if chars[-1] > 2 * BLOCK else [len(words)]
    begun = 0
    for ended in dict.fromkeys([*map(int, blocks), len(words)]):
        if ended <= begun:
            continue
        inside = list(range(begun, ended))
        lacking = [k for k in asked if not begun <= k < ended] if begun or ended < len(words) else []
        for at in range(0, max(len(lacking), 1), len(inside)):  # what is asked has to be in the index, to be spelled from it
            more = lacking[at : at + len(inside)]
            numbers = np.array(inside + more)
            index = Index([spelled[k] for k in numbers])
            here = np.array([*([k for k in asked if begun <= k < ended] if not at else []), *more], np.int64)
            place = {int(k): i for i, k in enumerate(numbers)}
            q, v = index.near(np.array([place[int(k)] for k in here], np.int64), size[here] // 2 if mirrored else (size[here] + 1) // 2)
            inner = v < len(inside)
            found_q.append(here[q[inner]])
            found_v.append(numbers[v[inner]])
        begun = ended
    q, v = np.concatenate(found_q), np.concatenate(found_v)
    if mirrored and len(q):  # what shares the last half was found from there
        kept = np.array([not words[b].endswith(words[a][len(words[a]) // 2 :]) for a, b in zip(q.tolist(), v.tolist(), strict=True)])
        q, v = q[kept], v[kept]
    by_name = np.zeros(len(words), np.int64)
    by_name[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((by_name[v], -n[v], q))
    q, v = q[order], v[order]
    near = np.bincount(q, minlength=len(words))
    best = np.full(len(words), -1)
    tops, at = np.unique(q, return_index=True)
    best[tops] = v[at]
    form = [words[best[k]] if best[k] >= 0 else None for k in asked]
    form_n = [int(n[best[k]]) if best[k] >= 0 else None for k in asked]
    columns = [pa.array([words[k] for k in asked], pa.string()), pa.array(n[query]), pa.array(near[query]), pa.array(form, pa.string()), pa.array(form_n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n", "n_near", "form", "form_n"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mirrored, half): halves together until their words fill an index."""
    held: dict[str, int] = {}
    asked: set[str] = set()
    letters, at, side = 0, None, False

    def out() -> pa.RecordBatch:
        words = sorted(held)
        return _search(words, np.array([held[w] for w in words], np.int64), [k for k, w in enumerate(words) if w in asked], side)

    for batch in batches:
        for mirrored, half, word, n, query in zip(*[batch.column(c).to_pylist() for c in ("mirrored", "half", "word", "n", "query")], strict=True):
            if (mirrored, half) != at:
                if asked and (letters >= BLOCK or mirrored != side):
                    yield out()
                    held, asked, letters = {}, set(), 0
                elif mirrored != side:
                    held, letters = {}, 0
                at, side = (mirrored, half), mirrored
            if word not in held:
                letters += len(word) + 1
            held[word] = n
            if query:
                asked.add(word)
    if asked:
        yield out()


def near(vocabulary: DataFrame) -> DataFrame:
    """(word, n) of distinct words -> each word with n_near, and the near word of largest n (ties: first by code points): form, form_n."""
    size = F.char_length("word")
    half = lambda mirrored, length: F.struct(
        F.lit(mirrored).alias("mirrored"),
        (F.substring("word", F.lit(1), length) if mirrored else F.substring("word", size - length + 1, length)).alias("half"),
        (length == (F.floor(size / 2) if mirrored else F.ceil(size / 2))).alias("query"),
    )
    whole = lambda c: c.cast("int")
    lengths = [(True, whole(F.floor((size - 1) / 2))), (True, whole(F.floor((size + 1) / 2))), (False, whole(F.ceil((size - 1) / 2))), (False, whole(F.ceil((size + 1) / 2)))]
    rows = vocabulary.select("word", "n", F.inline(F.array(*[half(m, k) for m, k in lengths])))
    letters = vocabulary.agg(F.sum(size + 1)).first()[0] or 0
    shards = max(1, int(4 * letters // (2 * BLOCK)))
    dealt = rows.repartition(shards, "mirrored", "half").sortWithinPartitions("mirrored", "half")
    found = map_arrow(dealt, _searched, "word string, n bigint, n_near bigint, form string, form_n bigint")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("rank"), "form")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, twice as far each round; forms never lead back."""
    done, going = None, cut(forms.select("word", F.col("form").alias("at")))
    steps = going
    while not going.isEmpty():
        ahead = steps.select(F.col("word").alias("at"), F.col("at").alias("further"))
        moved = cut(meet(going, ahead, "at", "left").select("word", "at", "further"))
        ended = moved.filter("further is null").select("word", "at")
        done = ended if done is None else done.unionByName(ended)
        going = moved.filter("further is not null").select("word", F.col("further").alias("at"))
        steps = done.unionByName(going)
    return (steps if done is None else done).withColumnRenamed("at", "root")


def group(docs: DataFrame, modulus: int = 0, least_letters: int = 5, least_n: int = 3, ratio: int = 2) -> DataFrame:
    """Words of the documents with form, root, n, n_near and form_n; a form is a near word at least `ratio` times as frequent."""
    vocabulary = cut(counts(docs, modulus).filter((F.col("n") >= least_n) & (F.char_length("word") >= least_letters)))
    found = near(vocabulary)
    close = F.col("form_n") >= ratio * F.col("n")
    told = cut(found.withColumns({"form": F.when(close, F.col("form")), "form_n": F.when(close, F.col("form_n"))}))
    follow = roots(told.filter("form is not null").select("word", "form"))
    return meet(told, follow, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
