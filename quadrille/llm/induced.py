"""Suffix sorting by induction, outside of memory.

The text is an integer array that ends in a unique least symbol. Suffixes are of type S or L; the
S suffixes that follow an L (LMS) are sorted first, the others follow from them in two passes. A
pass takes suffixes out of a priority queue in order and puts their left neighbours back in. Keys
that are put in are never below the one taken out, and equal first symbols keep the order of
arrival. What a queue holds beyond `memory` bytes goes to a file as a run, sorted by symbol, and each run is read
once from its start. What a pass took out is written to a file as well, which the second pass reads backwards.

LMS suffixes are sorted by naming their substrings, which are a few symbols long and sorted by those, and by sorting the shorter
text of names by another round of induction, until all names differ.

The text of bytes has few symbols: what waits under one of them is taken out in batches of numpy work. There
every suffix carries the length of its common prefix with its neighbour, capped at `cap`: what
a batch puts under a symbol has one more than the least value passed since that symbol was last served. Texts of
names have many symbols, go without prefixes, and are taken one suffix at a time where few wait under a symbol.

Texts, types, LMS places and orders are arrays in unnamed files, mapped where they are used. In memory are a
queue's `memory`, blocks of BLOCK entries, what waits under one symbol of a text of names, and whole arrays in two places: LMS substrings are
sorted by numpy over all LMS places at once (several numbers of 8 bytes for each), and a pass over names holds what follows from the
given suffixes. So memory goes with the shard, some tens of bytes for each of its bytes, and it is the shard's size that bounds it.
Orders and lengths of bytes hold for the first `cap` symbols.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np

#: Entries worked on at a time.
BLOCK = 1 << 18
#: Bytes that a suffix waiting in a list takes.
LISTED = 48
#: Symbols of a substring that are compared at once, at least.
STEP = 4
SEVEN = 7
#: What waits under a symbol is worked on as an array from this many on.
FEW = 64
ENTRY = np.dtype([("at", "<i8"), ("lcp", "<u2")])


class Tape:
    """Values written one after another to an unnamed file, which goes with the task."""

    def __init__(self, kind: np.dtype | str) -> None:
        self.kind, self.n = np.dtype(kind), 0
        self.file = tempfile.TemporaryFile()  # noqa: SIM115

    def add(self, values: np.ndarray | list[int]) -> None:
        if len(values):
            self.file.write(np.ascontiguousarray(values, self.kind).tobytes())
            self.n += len(values)

    def array(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, self.kind, "r+", shape=(self.n,)).view(np.ndarray) if self.n else np.zeros(0, self.kind)


def on_disk(n: int, kind: str) -> np.ndarray:
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,)).view(np.ndarray) if n else np.zeros(0, kind)


def order_on_disk(places: np.ndarray) -> np.ndarray:
    out = on_disk(len(places), "<i8")
    out[:] = places
    return out


def blocks(n: int) -> Iterator[tuple[int, int]]:
    for at in range(0, n, BLOCK):
        yield at, min(n, at + BLOCK)


class Run:
    """Entries (symbol, at, lcp) of a queue in the order in which they will be asked for."""

    ROW = np.dtype([("symbol", "<i8"), ("at", "<i8"), ("lcp", "<u2")])

    def __init__(self, rows: np.ndarray) -> None:
        self.tape = Tape(self.ROW)
        self.tape.add(rows)
        self.left, self.rows, self.k = self.tape.n, rows[:0], 0
        self.tape.file.seek(0)
        self.more()

    def more(self) -> None:
        if self.k == len(self.rows):
            some = min(self.left, BLOCK)
            self.rows, self.k = np.frombuffer(self.tape.file.read(some * self.ROW.itemsize), self.ROW), 0
            self.left -= some
            symbol = self.rows["symbol"]
            self.ends = iter([*(np.flatnonzero(symbol[1:] != symbol[:-1]) + 1).tolist(), len(symbol)])
        self.head = int(self.rows["symbol"][self.k]) if len(self.rows) else None

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        while self.head == symbol:
            upto = next(self.ends)
            yield self.rows[self.k : upto]
            self.k = upto
            self.more()


class Batches:
    """The queue of a text with few symbols: batches of ENTRY."""

    def __init__(self, memory: int, sign: int) -> None:
        self.memory, self.sign, self.held = memory, sign, 0
        self.parts: dict[int, list[np.ndarray]] = defaultdict(list)
        self.last: dict[int, int] = {}
        self.runs: list[Run] = []

    def put(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        entry = np.empty(len(at), ENTRY)
        entry["at"], entry["lcp"] = at, lcp
        self.parts[symbol].append(entry)
        self.last[symbol] = int(at[-1])
        self.held += entry.nbytes
        if self.held > self.memory:
            rows = []
            for symbol in sorted(self.parts, key=lambda c: self.sign * c):
                for entry in self.parts[symbol]:
                    row = np.empty(len(entry), Run.ROW)
                    row["symbol"], row["at"], row["lcp"] = symbol, entry["at"], entry["lcp"]
                    rows.append(row)
            self.runs.append(Run(np.concatenate(rows)))
            self.parts.clear()
            self.held = 0

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What waits under a symbol in order of arrival, with what is put there meanwhile."""
        k = 0
        while True:
            while k < len(self.runs):
                for rows in self.runs[k].take(symbol):
                    yield rows["at"].copy(), rows["lcp"].copy()
                k += 1
            waiting = self.parts.pop(symbol, [])
            if not waiting:
                return
            entry = np.concatenate(waiting)
            self.held -= entry.nbytes
            yield entry["at"].copy(), entry["lcp"].copy()


class Lists:
    """The queue of a text of names: places, one at a time."""

    def __init__(self, memory: int, sign: int) -> None:
        self.memory, self.sign, self.held = memory, sign, 0
        self.parts: dict[int, list[int]] = defaultdict(list)
        self.runs: list[Run] = []

    def count(self, put: int) -> None:
        """Told how many were put into parts since the last time."""
        self.held += put
        if self.held * LISTED > self.memory:
            symbols = sorted(self.parts, key=lambda c: self.sign * c)
            rows = np.zeros(sum(map(len, self.parts.values())), Run.ROW)
            rows["symbol"] = np.repeat(np.array(symbols, np.int64), [len(self.parts[c]) for c in symbols])
            rows["at"] = np.fromiter((i for c in symbols for i in self.parts[c]), np.int64, len(rows))
            self.runs.append(Run(rows))
            self.parts.clear()
            self.held = 0

    def take(self, symbol: int) -> list[int]:
        found: list[int] = []
        for run in self.runs:  # the older a run, the earlier its entries came
            if run.head == symbol:
                for rows in run.take(symbol):
                    found += rows["at"].tolist()
        here = self.parts.pop(symbol, None)
        if here is not None:
            self.held -= len(here)
            return found + here if found else here
        return found


class Induction:
    """A text on disk with its types and LMS places. What is done with it is counted in spent: runs written and rounds of recursion."""

    def __init__(self, text: np.ndarray, memory: int, spent: dict[str, int] | None = None) -> None:
        self.text, self.memory, self.n = text, memory, len(text)
        self.spent = spent if spent is not None else {"runs": 0, "rounds": 0}
        self.s = on_disk(self.n, "?")
        self.s[-1] = True
        places = Tape("<i8")
        for a in range((self.n - 2) // BLOCK * BLOCK, -1, -BLOCK):  # from the end, each block knowing what follows it
            b = min(a + BLOCK, self.n - 1)
            steps = np.sign(np.diff(text[a : b + 1].astype(np.int64)))
            following = np.minimum.accumulate(np.where(steps != 0, np.arange(b - a), b - a)[::-1])[::-1]
            self.s[a:b] = np.append(steps > 0, self.s[b])[following]
        for a, b in blocks(self.n):
            places.add(np.flatnonzero(self.s[max(a, 1) : b] & ~self.s[max(a, 1) - 1 : b - 1]) + max(a, 1))
        self.lms = places.array()

    def name(self, order: np.ndarray) -> tuple[np.ndarray, int]:
        """The name of each LMS substring, in text order, and how many there are; order: LMS places by their substrings."""
        text, m = self.text, len(self.lms)
        name, count = on_disk(m, "<i8"), 0
        before, before_length = -1, -1
        for lo, hi in blocks(m):
            at = order[lo:hi]
            number = np.searchsorted(self.lms, at)
            length = np.where(number + 1 < m, self.lms[np.minimum(number + 1, m - 1)], self.n) - at
            a, a_length = np.concatenate([[before], at[:-1]]), np.concatenate([[before_length], length[:-1]])
            new = np.ones(len(at), bool)
            same, k = np.flatnonzero((a_length == length) & (a != self.lms[-1]) & (at != self.lms[-1])), 0
            # an LMS substring reaches to the next LMS symbol, that symbol included
            while len(same):
                same = same[text[a[same] + k] == text[at[same] + k]]
                new[same[length[same] == k]] = False
                same = same[length[same] > k]
                k += 1
            rank = count + np.cumsum(new) - 1
            name[number] = rank
            count, before, before_length = int(rank[-1]) + 1, int(at[-1]), int(length[-1])
        return name, count

    def sorted_lms(self) -> np.ndarray:
        """LMS places in the order of their suffixes."""
        name, count = self.name(self.lms_by_substring())
        out = on_disk(len(name), "<i8")
        if count == len(name):
            for a, b in blocks(len(name)):
                out[name[a:b]] = self.lms[a:b]
            return out
        self.spent["rounds"] += 1
        order = Names(name, count, self.memory, self.spent).order()
        for a, b in blocks(len(name)):
            out[a:b] = self.lms[order[a:b]]
        return out

    def lms_by_substring(self) -> np.ndarray:
        """LMS places by their substrings, a few symbols with their types at once, packed into numbers; those that agree in them go on."""
        m, bits = len(self.lms), (2 * self.top + 2).bit_length()
        packed = max(1, 62 // bits)
        step = packed * max(1, -(-STEP // packed))
        length = np.append(np.diff(self.lms), 0)
        order, group = np.arange(m), np.zeros(m, np.int64)
        live, k = np.arange(m), 0
        while len(live):
            at, rest = self.lms[order[live]] + k, length[order[live]] - k
            keys = []
            for j in range(step):
                inside = rest >= j  # the next LMS symbol belongs to it
                here = np.where(inside, at + j, 0)
                symbol = np.where(inside, 2 * self.text[here].astype(np.int64) + self.s[here] + 1, 0)
                if j % packed:
                    keys[-1] = keys[-1] << bits | symbol
                else:
                    keys.append(symbol)
            by = np.lexsort((*keys[::-1], group[live])) if k or len(keys) > 1 else np.argsort(keys[0], kind="stable")
            order[live], rest = order[live][by], rest[by]
            new = group[live] != np.concatenate([[-1], group[live][:-1]])
            for key in keys:
                key = key[by]
                new[1:] |= key[1:] != key[:-1]
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(live)))
            group[live] = np.repeat(live[first], sizes)
            live, k = live[(np.repeat(sizes, sizes) > 1) & (rest >= step)], k + step
        return order_on_disk(self.lms[order])


class Names(Induction):
    """A text whose symbols are 0 to count - 1, each found at least once."""

    def __init__(self, text: np.ndarray, count: int, memory: int, spent: dict[str, int]) -> None:
        super().__init__(text, memory, spent)
        self.count, self.top = count, count - 1

    def passes(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """L suffixes in order, and S suffixes in reverse but for the last symbol, from the LMS suffixes in order."""
        larger = self.one_pass(1, False, seeds)
        return larger, self.one_pass(-1, True, larger[::-1])

    def one_pass(self, sign: int, want_s: bool, given: np.ndarray) -> np.ndarray:
        """The suffixes of one type in order of their symbols (reversed with sign -1); given: those of the other type that they follow from, in that order.

        What follows from a given suffix at once is known beforehand and sorted by symbol; the queue has what follows from those.
        """
        text, s = memoryview(self.text), memoryview(self.s)
        first = self.left_of(given, want_s)
        first = first[np.argsort(self.text[first], kind="stable")]
        begins = self.sums(first)
        ahead = np.flatnonzero((first > 0) & (self.s[first - 1] == want_s))
        ahead_begins = np.searchsorted(ahead, begins).tolist()
        next_at = first[ahead] - 1
        next_to, next_at = memoryview(self.text[next_at]), memoryview(next_at)
        queue, out, n = Lists(self.memory, sign), on_disk(int(np.count_nonzero(self.s == want_s)), "<i8"), 0
        for c in range(self.count) if sign > 0 else range(self.count - 1, -1, -1):
            a, b = begins[c], begins[c + 1]
            waiting, put, new = queue.take(c), queue.parts, 0
            if waiting:
                bucket = waiting
                if b > a:
                    # both are in the order of the symbol that follows; where it is the same, those of the wanted type go first
                    bucket = sorted(waiting + first[a:b].tolist(), key=lambda i: sign * text[i + 1])
            elif b > a:
                out[n : n + b - a] = first[a:b]
                n += b - a
                x, y = ahead_begins[c], ahead_begins[c + 1]
                bucket = []
                for j, d in zip(next_at[x:y], next_to[x:y], strict=True):
                    if d == c:
                        bucket.append(j)
                    else:
                        put[d].append(j)
                        new += 1
            else:
                continue
            if len(bucket) < FEW:
                for i in bucket:
                    j = i - 1
                    if i and s[j] == want_s:
                        d = text[j]
                        if d == c:
                            bucket.append(j)  # the loop comes to it
                        else:
                            put[d].append(j)
                            new += 1
                out[n : n + len(bucket)] = bucket
                n += len(bucket)
            else:
                at = np.array(bucket, np.int64)
                while len(at):
                    out[n : n + len(at)] = at
                    n += len(at)
                    left = self.left_of(at, want_s)
                    to = self.text[left]
                    at = left[to == c]
                    for d, j in zip(to.tolist(), left.tolist(), strict=True):
                        if d != c:
                            put[d].append(j)
                            new += 1
            queue.count(new)
        self.spent["runs"] += len(queue.runs)
        return out[:n]

    def left_of(self, at: np.ndarray, want_s: bool) -> np.ndarray:
        """Left neighbours of the wanted type."""
        left = at[at > 0] - 1
        return left[self.s[left] == want_s]

    def sums(self, places: np.ndarray) -> list[int]:
        """How many of the places have a symbol below each symbol."""
        found = np.zeros(self.count + 1, np.int64)
        for a, b in blocks(len(places)):
            found[1:] += np.bincount(self.text[places[a:b]], minlength=self.count)
        return np.cumsum(found).tolist()

    def order(self) -> np.ndarray:
        """All suffixes in order."""
        larger, smaller = self.passes(self.sorted_lms())
        of_l, of_s = (np.array(self.sums(places)) for places in (larger, smaller))
        out = on_disk(self.n, "<i8")
        out[0] = self.n - 1
        for a, b in blocks(len(larger)):
            at = larger[a:b]
            out[1 + np.arange(a, b) + of_s[self.text[at]]] = at
        for a, b in blocks(len(smaller)):
            at = smaller[len(smaller) - b : len(smaller) - a][::-1]
            out[1 + np.arange(a, b) + of_l[self.text[at] + 1]] = at
        return out


class Bytes(Induction):
    """A text of few symbols; its suffixes carry common prefixes of up to cap symbols."""

    def __init__(self, text: np.ndarray, cap: int, memory: int, spent: dict[str, int] | None = None) -> None:
        super().__init__(text, memory, spent)
        self.cap = cap
        self.symbols = np.unique(np.concatenate([np.unique(text[a:b]) for a, b in blocks(self.n)]))
        self.top = int(self.symbols[-1])

    def run(self, i: int) -> int:
        """How often the symbol at a place is repeated from there on, capped."""
        some = self.text[i : i + self.cap]
        apart = some != some[0]
        return int(apart.argmax()) if apart.any() else len(some)

    def serve(self, queue: Batches, at: np.ndarray, lcp: np.ndarray, want_s: bool, passed: dict[int, int]) -> None:
        """Put the left neighbours of a batch under their symbols. passed: least common prefix since a symbol was served."""
        some = np.flatnonzero((at > 0) & (self.s[at - 1] == want_s))
        low = int(lcp.min())
        before = dict(passed)
        for symbol in passed:
            passed[symbol] = min(passed[symbol], low)
        if not len(some):
            return
        left = at[some] - 1
        to = self.text[left]
        order = np.argsort(to, kind="stable")
        to = to[order]
        edges = np.flatnonzero(np.diff(to)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(to)], strict=True):
            symbol, inside = int(to[a]), order[a:b]
            idx = some[inside]
            least = np.minimum.reduceat(lcp[: idx[-1] + 1], np.concatenate([[0], idx[:-1] + 1]))
            found = np.minimum(least + 1, self.cap).astype(np.uint16)
            found[0] = min(min(before[symbol], int(least[0])) + 1, self.cap) if symbol in queue.last else 0
            queue.put(symbol, left[inside], found)
            rest = lcp[idx[-1] + 1 :]
            passed[symbol] = int(rest.min()) if len(rest) else self.cap

    def passes(self, seeds: np.ndarray, seed_lcp: np.ndarray) -> tuple[tuple, tuple]:
        """L suffixes in order, and S suffixes in reverse, as entries and where each symbol's begin and end, from the LMS suffixes in order."""
        first = self.text[seeds]
        ends = np.searchsorted(first, self.symbols, side="right")
        starts = np.searchsorted(first, self.symbols, side="left")
        queue, tape, larger_of = Batches(self.memory, 1), Tape(ENTRY), {}
        passed: dict[int, int] = {}
        for symbol, a, b in zip(self.symbols.tolist(), starts.tolist(), ends.tolist(), strict=True):
            begin = tape.n
            for at, lcp in queue.take(symbol):
                self.keep(tape, at, lcp)
                self.serve_split(queue, at, lcp, False, passed)
            larger_of[symbol] = (begin, tape.n)
            if a < b:
                lcp = seed_lcp[a:b].copy()
                lcp[0] = min(self.run(queue.last[symbol]), self.run(int(seeds[a]))) if symbol in queue.last else 0
                self.serve_split(queue, seeds[a:b], lcp, False, passed)
        self.spent["runs"] += len(queue.runs)
        larger, last_l = tape.array(), queue.last
        queue, tape, smaller_of = Batches(self.memory, -1), Tape(ENTRY), {}
        passed = {}
        for symbol in self.symbols[::-1].tolist():
            begin = tape.n
            for at, lcp in queue.take(symbol):
                self.keep(tape, at, lcp)
                self.serve_split(queue, at, lcp, True, passed)
            smaller_of[symbol] = (begin, tape.n)
            after = min(self.run(last_l[symbol]), self.run(queue.last[symbol])) if symbol in last_l and symbol in queue.last else 0
            a, b = larger_of[symbol]
            for hi in range(b, a, -BLOCK):
                some = larger[max(a, hi - BLOCK) : hi][::-1]
                shifted = np.concatenate([[after], some["lcp"][:-1]]).astype(np.uint16)
                after = int(some["lcp"][-1])
                self.serve_split(queue, some["at"].copy(), shifted, True, passed)
        self.spent["runs"] += len(queue.runs)
        self.last_of = last_l, queue.last
        return (larger, larger_of), (tape.array(), smaller_of)

    def keep(self, tape: Tape, at: np.ndarray, lcp: np.ndarray) -> None:
        entry = np.empty(len(at), ENTRY)
        entry["at"], entry["lcp"] = at, lcp
        tape.add(entry)

    def serve_split(self, queue: Batches, at: np.ndarray, lcp: np.ndarray, want_s: bool, passed: dict[int, int]) -> None:
        for a, b in blocks(len(at)):
            self.serve(queue, at[a:b], lcp[a:b], want_s, passed)

    def prefixes(self, seeds: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours among the LMS suffixes, SEVEN symbols of nine bits a step. The text has cap + 8 symbols behind its end."""
        many = on_disk(self.n + self.cap + 1, "<u8")
        for a, b in blocks(len(many)):
            for j in range(SEVEN):
                many[a:b] |= self.padded[a + j : b + j].astype(np.uint64) << np.uint64(9 * j)
        out = on_disk(len(seeds), "<u2")
        for lo, hi in blocks(len(seeds)):
            at = seeds[lo:hi]
            before = np.concatenate([[seeds[lo - 1] if lo else at[0]], at[:-1]])
            found = np.zeros(len(at), np.uint16)
            live = np.arange(0 if lo else 1, len(at))
            a, b, k = before[live], at[live], 0
            while len(live) and k < self.cap:
                apart = many[a + k] ^ many[b + k]
                on = apart == 0
                ended = apart[~on]
                low = ended & (~ended + np.uint64(1))
                found[live[~on]] = k + np.bitwise_count(low - np.uint64(1)) // 9
                live, a, b, k = live[on], a[on], b[on], k + SEVEN
            found[live] = self.cap
            out[lo:hi] = np.minimum(found, self.cap)
        return out

    def repeated(self, width: int) -> np.ndarray:
        """For each place, whether the `width` symbols from it start at another place too. width is cap at most."""
        flags = on_disk(self.n, "?")
        if len(self.lms) < 1:
            return flags
        seeds = self.sorted_lms()
        found = self.passes(seeds, self.prefixes(seeds))
        for tape, of in found:
            for begin, end in of.values():
                before = -1
                for a in range(begin, end, BLOCK):
                    some = tape[a : min(end, a + BLOCK)]
                    at, hit = some["at"], np.flatnonzero(some["lcp"] >= width)
                    flags[at[hit]] = True
                    flags[at[hit[hit > 0] - 1]] = True
                    if len(hit) and hit[0] == 0 and before >= 0:
                        flags[before] = True
                    before = int(at[-1])
        last_l, last_s = self.last_of
        for symbol in self.symbols.tolist():
            if symbol in last_l and symbol in last_s:
                x, y = last_l[symbol], last_s[symbol]
                if min(self.run(x), self.run(y)) >= width:
                    flags[[x, y]] = True
        return flags


class Windows:
    """Segments of bytes, added one by one, and which of their windows of `width` bytes start anywhere else in them."""

    def __init__(self, width: int, memory: int = 32 << 20) -> None:
        self.width, self.memory = width, memory
        self.tape, self.lengths = Tape("<u2"), Tape("<i8")
        self.spent = {"runs": 0, "rounds": 0}

    def add(self, segment: bytes) -> None:
        symbols = np.ones(len(segment) + 1, np.uint16)  # a segment ends in 1
        symbols[:-1] = np.frombuffer(segment, np.uint8).astype(np.uint16) + 2
        self.tape.add(symbols)
        self.lengths.add([len(segment)])

    @property
    def size(self) -> int:
        return self.tape.n

    def flags(self) -> Iterator[np.ndarray]:
        """For each segment, in the order of adding."""
        n = self.tape.n + 1
        self.tape.add(np.zeros(1 + self.width + 8, np.uint16))
        padded = self.tape.array()
        sorter = Bytes(padded[:n], self.width, self.memory, self.spent)
        sorter.padded = padded
        found, at = sorter.repeated(self.width), 0
        for length in self.lengths.array().tolist():
            yield found[at : at + max(length - self.width + 1, 0)]
            at += length + 1


def repeated_windows(segments: Iterable[bytes], width: int, memory: int = 32 << 20, spent: dict[str, int] | None = None) -> list[np.ndarray]:
    """For each segment, which of its windows of `width` bytes start anywhere else in the segments."""
    windows = Windows(width, memory)
    for segment in segments:
        windows.add(segment)
    out = list(windows.flags())
    if spent is not None:
        spent.update(windows.spent)
    return out
