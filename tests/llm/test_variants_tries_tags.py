"""Spelling variants, prefix tries and toxic spans: odd input, and results against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import time
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import chat_format, decontaminate, exact_substr, prefix_trie, queries, secrets, spelling, toxic_crf
from tests.llm.test_operators import DOCS, LONG, ODD

CHAT = "conv_id long, turn long, role string, text string"


# --- 11 ------------------------------------------------------------------------------------------


def plain_marginals(e, moves):
    t01, t10, t11, start = moves
    total, toxic = 0.0, np.zeros(len(e))
    for tags in itertools.product((0, 1), repeat=len(e)):
        weight = start * tags[0] + sum(x for x, y in zip(e, tags, strict=True) if y)
        weight += sum({(0, 0): 0.0, (0, 1): t01, (1, 0): t10, (1, 1): t11}[p] for p in itertools.pairwise(tags))
        total += np.exp(weight)
        toxic += np.exp(weight) * np.array(tags)
    return toxic / total


def test_marginals_as_by_all_tag_sequences():
    rng = np.random.default_rng(5)
    sizes = [1, 7, 2, 9, 1, 5]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    field = toxic_crf.Field(np.zeros(1), rng.normal(0, 1, 4), np.zeros(3))
    e = rng.normal(0, 2, sum(sizes))
    want = np.concatenate([plain_marginals(e[a : a + n], field.moves) for a, n in zip(starts, sizes, strict=True)])
    assert np.allclose(field.marginals(e, starts), want)


def marked_docs(n, seed):
    """Texts of made-up words; a fifth of them with a few of three marked words, whose offsets are told too."""
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghiklmnoprstu", k=draw.randint(2, 8))) for _ in range(400)]
    out = []
    for k in range(n):
        text, spans = "", []
        for _ in range(draw.randint(20, 120)):
            if k % 5 == 0 and draw.random() < 0.06:
                word = draw.choice(("Grumblefex", "snarkwort", "oafishly"))
                spans.append((len(text), len(text) + len(word)))
            else:
                word = draw.choice(words)
            text += word + draw.choice((" ", ", ", ".\n"))
        out.append((k, text, spans))
    return out


def test_toxic_documents_and_spans_are_found(spark):
    made = marked_docs(1_000, 1)
    docs = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(bool(s))) for k, _, s in made], "doc_id long, quality int, toxic int")
    field = toxic_crf.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxic_crf.tag(docs, field).collect()}
    held = [(k, s) for k, _, s in made if crc32(str(k).encode()) % 5 == 0]
    right = sum(got[k]["predicted"] == int(bool(s)) for k, s in held)
    assert right >= 0.97 * len(held)
    inside = {k: {i for a, b in s for i in range(a, b)} for k, _, s in made}
    told = {k: {i for s in got[k]["spans"] for i in range(s["start"], s["end"])} for k in inside}
    text = {k: t for k, t, _ in made}
    letters = lambda k, at: {i for i in at if text[k][i].isalpha()}  # noqa: E731  a span of two words has what is between them
    missed = sum(len(inside[k] - told[k]) for k in inside)
    extra = sum(len(letters(k, told[k]) - inside[k]) for k in inside)
    assert missed <= 0.05 * sum(map(len, inside.values())) and extra <= 0.05 * sum(map(len, inside.values()))


def test_toxic_query_rows(spark, sf_dir):
    rows = queries.op11_toxic_crf(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_toxic_odd_input(spark):
    odd = spark.createDataFrame([*ODD, ODD[4], (None, None, None, None, None)], DOCS)
    odd = odd.withColumn("score", F.lit("x")).withColumn("Spans", F.lit(2)).withColumn("predicted", F.lit("p")).withColumn("a.b", F.lit(1))
    made = marked_docs(300, 2)
    docs = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(bool(s))) for k, _, s in made] + [(None, 1), (5, None)], "doc_id long, toxic int")
    field = toxic_crf.fit(docs, labels)
    got = toxic_crf.tag(odd, field)
    assert got.columns == [*odd.columns, "_score", "_spans", "_predicted"] and got.count() == odd.count()
    by_text = collections.defaultdict(set)
    for r in got.collect():
        by_text[r["text"] or ""].add(r["_score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert toxic_crf.tag(odd.limit(0), field).count() == 0
    for kind in (labels.filter("toxic = 0"), labels.limit(0)):  # nothing to learn: nothing is toxic
        assert toxic_crf.tag(odd, toxic_crf.fit(docs, kind)).filter("_predicted = 1").count() == 0


# --- 12 ------------------------------------------------------------------------------------------


def plain_variants(docs, least_n=3):
    c = collections.Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            c[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    v = {w: n for w, n in c.items() if len(w) >= 5 and n >= least_n}
    near = {w: set() for w in v}
    by = collections.defaultdict(set)
    for w in v:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            by[i, cut].add(w)
            if cut in v:
                near[w].add(cut)
                near[cut].add(w)
    for some in by.values():
        for w in some:
            near[w] |= some - {w}
    form = {w: min(s, key=lambda x: (-v[x], x)) for w, s in near.items() if s}
    form = {w: f for w, f in form.items() if v[f] >= 2 * v[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), v[form[w]] if w in form else 0) for w, n in v.items())


def variant_rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_variants_as_plain(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert variant_rows(queries.op12_spelling_variants(spark, sf_dir)) == plain_variants(docs)


def test_variants_of_odd_texts(spark):
    draw = random.Random(3)
    some = ["".join(draw.choices("aéz×", k=draw.randint(4, 9))) for _ in range(150)]
    texts = [" ".join(draw.choices(some, k=200)) for _ in range(20)]
    rows = [*[(k, t) for k, t in enumerate(texts)], (20, None), (21, ""), (None, texts[0]), (3, texts[3]), (22, "你好 ÀÉ_Zéro 😀 İstanbul naïve" * 3), (23, ("x" * 3_000 + " " + "x" * 3_001 + " ") * 3), (24, "Y" * 20_000)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n int, word string")
    assert variant_rows(spelling.group(docs, modulus=97)) == plain_variants(rows)
    assert spelling.group(docs.limit(0), modulus=97).count() == 0


@pytest.mark.parametrize("block", [1 << 17, 400])
def test_both_directions_find_each_pair_once(monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    draw = random.Random(block)
    words = {"".join(draw.choices("abé", k=draw.randint(5, 12))) for _ in range(150)} | {"a" * k for k in (5, 6, 40, 41)}
    words = sorted(words | {w[:-1] for w in words if len(w) > 5} | {w[1:] for w in words if len(w) > 5})
    n = np.arange(len(words)) % 7 + 3
    sides = [spelling._search(words, n, list(range(len(words))), m).to_pylist() for m in (False, True)]
    for w, a, b in zip(words, *sides, strict=True):
        near = [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and one_edit(w, v)]
        assert a["n_near"] + b["n_near"] == len(near)
        if near:
            best = min(near, key=lambda v: (-n[words.index(v)], v))
            assert min((-s["form_n"], s["form"]) for s in (a, b) if s["form"]) == (-n[words.index(best)], best)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [(f"leaf{k}", "w5") for k in range(500)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w37" for w, _ in chain}


# --- 13 ------------------------------------------------------------------------------------------


def plain_trie(rows, shared=True):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = crc32(str(c).encode()) % 4 if shared else 0
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    nodes, kids = collections.defaultdict(list), collections.Counter()
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = collections.Counter(), collections.Counter()
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if seqs[c] == p).encode()).hexdigest() for p, m in nodes.items()}
    return sorted(map(repr, ((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends[p]) for p, m in nodes.items())))


def trie_rows(convs, capacity=prefix_trie.CAPACITY, shared=True):
    seqs = prefix_trie.sequences(convs)
    nodes = prefix_trie.build(prefix_trie.keyed(prefix_trie.share_starts(seqs) if shared else seqs), capacity)
    assert nodes.dtypes == [tuple(f.split()) for f in prefix_trie.NODE.split(", ")]
    return sorted(repr(tuple(r)) for r in nodes.collect())


def test_trie_as_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(repr(tuple(r)) for r in queries.op13_prefix_trie(spark, sf_dir).collect()) == plain_trie(rows)


@pytest.mark.parametrize("capacity", [30, 10_000])
def test_trie_of_odd_conversations(spark, capacity):
    draw = random.Random(capacity)
    rows = [(c, t, draw.choice(("user", None)), draw.choice(("a b", "a", None))) for c in range(80) for t in range(draw.randint(1, 6))]
    rows += [(c, t, "user", f"shared {t}") for c in range(100, 140) for t in range(12)]  # one long way, many copies
    rows += [(c, t, "user", f"shared {min(t, c - 140)}") for c in range(140, 160) for t in range(12)]
    rows += [(200, None, None, None), (200, None, None, None), (200, 1, "x", "y"), (None, 1, "x", "y"), (-3, 0, "user", "a"), *rows[:3]]
    convs = spark.createDataFrame([(*r, "k", 1) for r in rows], CHAT + ", key string, head int").withColumn("seq", F.lit("s"))
    assert trie_rows(convs, capacity) == plain_trie(rows)
    assert trie_rows(convs.limit(0), capacity) == []


def test_trie_of_one_long_and_of_many_equal_conversations(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(3_000)] + [(c, 0, "user", "hello there") for c in range(1, 5_000)]
    assert trie_rows(spark.createDataFrame(rows, CHAT), shared=False) == plain_trie(rows, shared=False)


@pytest.mark.parametrize("piece", [1, 3, 1_000])
def test_ids_are_hashed_over_ranges_and_pieces(monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = [(b"a", k) for k in range(7)] + [(b"b", 3)] + [(b"c", k) for k in range(20)] + [(b"d", 1), (b"d", 2)]
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.binary()), pa.array([v for _, v in some], pa.int64())], ["key", "conv_id"])
    found = [r for a, b in ((0, 5), (5, 12), (12, 20), (20, 30)) for out in prefix_trie._pieces(iter([batch(rows[a : a + 2]), batch(rows[a + 2 : b])])) for r in out.to_pylist()]
    got = {r["key"]: r["sha"] for r in found if r["sha"]}
    pieces = sorted((r for r in found if not r["sha"]), key=lambda r: (r["key"], r["first"]))
    got |= {r["key"]: r["sha"] for out in prefix_trie._joined(iter([pa.RecordBatch.from_pylist(pieces)])) for r in out.to_pylist()}
    want = {k: hashlib.sha256(",".join(str(v) for x, v in rows if x == k).encode()).hexdigest() for k in (b"a", b"b", b"c", b"d")}
    assert got == want


def test_long_text_has_words(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG), (3, LONG)], "doc_id long, text string")
    assert spelling.group(docs).count() == 0 and spelling.counts(docs).filter("word = 'word'").first()["n"] == 120_000


# --- 3 -------------------------------------------------------------------------------------------


def test_thousands_of_equal_rows_lose_their_repeats(spark):
    text = " ".join("".join(random.Random(k).choices("abcdefgh", k=6)) for k in range(600))
    docs = spark.range(3_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = exact_substr.remove_repeats(docs).groupBy("n_bytes", "n_removed", F.size("removed").alias("spans")).count().collect()
    assert [tuple(r) for r in got] == [(len(text), len(text), 1, 3_000)]


# --- 1, 6, 10 ------------------------------------------------------------------------------------


def test_long_conversations_read_back(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é [SEP] </s> "), F.repeat(F.col("id").cast("string"), 20)).alias("text"))
    done = chat_format.format_conversations(rows).withColumn("loss", chat_format.masked_text(F.col("formatted"), F.col("loss_spans")))
    got = done.select("loss", F.size(chat_format.read_turns(F.col("formatted"))).alias("turns")).first()
    assert got["turns"] == n and got["loss"] == "".join(f"é [SEP] </s> {str(k) * 20}" for k in range(n) if k % 3)


def test_masks_over_page_borders(spark):
    text = "".join(chr(97 + k % 26) if k % 7 else "é" for k in range(9_000))
    spans = [(0, 1), (4_095, 4_097), (4_096, 4_096), (5_000, 8_999), (8_192, 9_000)]
    rows = spark.createDataFrame([(text, spans), ("", []), ("x", [])], "t string, s array<struct<start: bigint, end: bigint>>")
    assert [r[0] for r in rows.select(chat_format.masked_text(F.col("t"), F.col("s"))).collect()] == ["".join(text[a:b] for a, b in spans), "", ""]


def test_repeated_pieces_are_verified_once():
    matcher = decontaminate.Matcher(["ab" * 20], 0.08)
    begun = time.time()
    assert matcher.find("ab" * 300_000) == [(0, 0, 40)]
    assert time.time() - begun < 20
    item = "the quick brown fox jumps over the lazy dog again and again"
    matcher = decontaminate.Matcher([item], 0.08)
    assert [d for _, d, _ in matcher.find(f"{item[:20]} {item.replace('fox', 'fax')} {item[30:]}")] == [1]


def test_secrets_beside_base_spans_and_without_words():
    path = secrets.public_tokenizers.path("byte_bpe_50k.tiktoken")
    kinds = lambda text: [(k, text[a:b]) for k, a, b in secrets.spans_of(text, 2.3, path)]
    key, digest = "kJ8sQ2mZx9Lw4Rt7Vb1Nc6Yp", "0123456789abcdef" * 2
    assert kinds(f"see {key}/{digest} there") == [("token", f"{key}/"), ("hex", digest)]
    assert kinds(f"{digest}{key.upper()}G") == [("hex", digest), ("token", f"{key.upper()}G")]
    for text in ("xkqzvbtrwm-plkjhgfdsq-zxcvbnmtr", "QZXWV/KJPTR/BNMLS/DFGHY"):
        assert kinds(f"x {text} y") == [("token", text)]
    assert kinds("some-readable-name/of-things/here-and-there MAX_NUMBER_OF_RECORDS_PER_FILE") == []
