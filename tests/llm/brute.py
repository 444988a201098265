"""Plain versions of the operators, one document at a time, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chat(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: (n, sha of turns, loss chars, sha of loss)}."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(told), len(loss), sha(loss))
    return out


def tokens(docs):
    """docs: (doc_id, text) -> {doc_id: (start, n, crc)}."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = {}, 0
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out[doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def repeats(docs, width):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = collections.Counter(r[i : i + width] for _, r in raw for i in range(len(r) - width + 1))
    out = []
    for d, r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fingerprint(text):
    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Component number for each fingerprint, by all pairs."""
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(k) for k in range(len(prints))]


def shingles(text, words):
    found = WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def similar_classes(sets, similar):
    """sets: {id: set} -> groups of ids that similar pairs connect; empty sets are alike."""
    ids, label = list(sets), {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            both = len(x | y)
            if len(x & y) >= similar * both:
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    groups = collections.defaultdict(set)
    for d in ids:
        groups[root(d)].add(d)
    return groups.values()


def drawn(rows, source_targets, offsets, unit):
    """rows: (source, size, id, hash) -> copies of each in order of source, size class, size, id, hash, by walking along the expected copies."""
    out = []
    for source, target in source_targets.items():
        size_class = lambda r: int(np.floor(np.log2(r[1] + 1) * 4))
        mine = sorted((r for r in rows if r[0] == source), key=lambda r: (size_class(r), r[1] * (-1) ** (size_class(r) % 2), *r[2:]))
        total = sum(r[1] for r in mine)
        step = min(3 * unit, round(target / total * unit)) if total else 0
        at = offsets[source]
        for r in mine:
            out.append((r[2], (at + step) // unit - at // unit if r[1] else 0))
            at += step
    return sorted(out)


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def targets(sizes, weights=(1, 2, 3), most=3):
    """sizes: {source: size} -> {source: target}, resharing the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


KINDS = ("assign", "access", "hex")


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def edit_in(item, text):
    """Least edit distance between item and any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def depth_of_shards(keys, limit):
    """keys: (128 bits as text, bytes) -> {bits: depth} by splitting oversized buckets."""
    out = {}

    def split(prefix, rows):
        if sum(b for _, b in rows) <= limit or len(rows) == 1 or len(prefix) == 128:
            out.update({k: len(prefix) for k, _ in rows})
            return
        for bit in "01":
            part = [r for r in rows if r[0].startswith(prefix + bit)]
            if part:
                split(prefix + bit, part)

    split("", keys)
    return out
