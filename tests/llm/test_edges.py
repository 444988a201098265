"""Names that clash, rows that repeat, sizes at the edge, and results against plain versions."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import chat_format, decontaminate, exact_substr, induced, labelled, mixing, near_copies, quality_fm, quality_trees, queries, secrets, sharding, simhash_dedup, token_codes
from quadrille.llm.common import fresh_dir, look_up, stored, unused
from tests.llm import brute
from tests.llm.test_operators import DOCS, LONG, ODD, pairs, rows_of

NAMES = """row key bytes shard shard_depth n_bytes fits depth prefix bits _key size source_size target copies copy class deal rank none id h k k2 p
spans score predicted label found _heavy _at _k s n bands fp component_id item_id distance match_end part run n_words kept base_failed h_a h_b a b a.b""".split()
BENCH = "item_id long, text string"
VOCABULARY = token_codes.public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def clashing(spark):
    """All odd rows, some repeated, and every working name as a column."""
    rows = spark.createDataFrame([*ODD, ODD[4], ODD[1], (None, None, None, None, None)], DOCS)
    return stored(rows.select("*", *[F.lit(f"is {name}").alias(name) for name in NAMES]))


def untouched(found, docs):
    names = [c for c in docs.columns if c in NAMES]
    rows = found.select(*[F.col(f"`{c}`") for c in names]).distinct().collect()
    return all(tuple(r) == tuple(f"is {c}" for c in names) for r in rows)


def test_operators_keep_columns_of_any_name(spark, clashing):
    n = clashing.count()
    shards = sharding.shard(clashing, 2_000)
    assert shards.columns[: len(clashing.columns)] == clashing.columns and shards.count() == n and untouched(shards, clashing)
    mixed = mixing.mix(clashing)
    assert mixed.columns[-4:] == ["_size", "_source_size", "_target", "_copies"] and mixed.count() == n and untouched(mixed, clashing)
    taken = mixing.take(mixed, clashing.columns)
    assert taken.count() == mixed.agg(F.sum("_copies")).first()[0] and untouched(taken, clashing)
    for kept in (simhash_dedup.dedup(clashing), near_copies.dedup(clashing)):
        assert kept.columns == clashing.columns and untouched(kept, clashing)
    scored = quality_fm.score(clashing, quality_fm.fit(clashing, spark.createDataFrame([], "doc_id long, quality int")))
    assert scored.columns[-2:] == ["_score", "_predicted"] and untouched(scored, clashing)
    assert exact_substr.remove_repeats(clashing).count() == n == secrets.scan(clashing).count()
    assert quality_trees.judge(clashing, quality_trees.grow(np.zeros((0, 14)), np.zeros(0))).count() == n
    bench = spark.createDataFrame([(1, "THE SAME words again and  again.")], BENCH)
    clean = decontaminate.clean(clashing, bench)
    assert clean.columns == clashing.columns and untouched(clean, clashing)
    assert {r[0] for r in decontaminate.matches(clashing, bench).select("doc_id").collect()} == {4, 5}
    where = fresh_dir(spark, "codes")
    token_codes.write_codes(clashing, where)
    assert token_codes.read_codes(spark, where).count() == n
    turns = clashing.select("*", F.lit(1).alias("conv_id"), F.lit(2).alias("turn"), F.lit("user").alias("role"))
    assert chat_format.format_conversations(turns).count() == 1


def test_stages_take_odd_and_empty_tables(spark, clashing, tmp_path):
    spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words again and again. The same")], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (clashing, clashing.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns and untouched(out, docs), name
            if not docs.take(1):
                assert out.count() == 0
    # without labels of both kinds nothing can be told apart, and nothing goes
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality(spark, clashing, str(tmp_path)).count() == clashing.count()


def test_look_up_finds_rows_of_heavy_keys(spark):
    rows = spark.range(9_000).select(F.when(F.col("id") < 5_000, -7).otherwise(F.col("id")).alias("key"), "id")
    unique = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("key <> 8999")
    got = look_up(rows, unique, "key").select("key", "id", "found.first").collect()
    assert len(got) == 9_000 and all(r["first"] == (0 if r["key"] == -7 else None if r["key"] == 8999 else r["id"]) for r in got)


# --- 2 -------------------------------------------------------------------------------------------


def test_words_have_the_ids_of_the_library():
    encoder, rng = token_codes.WordEncoder(VOCABULARY), random.Random(4)
    assert encoder.by_words
    bits = "<|endoftext|> <|ENDOFTEXT|> <|startoftext|> <|StartOfText|> x X ! ... é É İ K word Word's 'S don't 1 23 # | < á ß ſ 你好 😀 , ; İx i̇ ΑΣ".split() + list(" \n\t\x01\x00\x1c\x85　")
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(10_000)]
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    ids, counts = encoder.batch(pa.array(texts))
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_other_vocabularies_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"a": 0, "b": 1, "A": 2, "?": 3}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(f"{tmp_path}/t.json")
    encoder = token_codes.WordEncoder(f"{tmp_path}/t.json")
    ids, counts = encoder.batch(pa.array(["a b", "A c", ""]))
    assert not encoder.by_words and ids.tolist() == [0, 1, 2, 3] and counts.tolist() == [2, 2, 0]


def test_one_token_takes_few_bytes(tmp_path):
    ids = np.random.default_rng(2).integers(0, 1 << 20, 200_000).astype(np.uint32)
    with open(f"{tmp_path}/x.dac", "wb") as out:
        out.writelines(token_codes.file_bytes(ids, [5], [0], 0))
    codes = token_codes.Codes.open(f"file:{tmp_path}/x.dac")
    asked, read = [], codes.read
    codes.read = lambda at, size: asked.append(size) or read(at, size)
    assert codes[123_456] == ids[123_456] and sum(asked) < 400
    assert codes.span(511, 1_700).tolist() == ids[511:1_700].tolist()
    assert codes.doc_ids.tolist() == [5] and codes.starts.tolist() == [0, len(ids)]


def test_files_of_dead_attempts_are_not_read(spark):
    where = fresh_dir(spark, "codes")
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(20)], "doc_id long, text string")
    paths = [r["path"] for r in token_codes.write_codes(docs, where).collect()]
    store, at = token_codes.store_of(paths[0])
    store.copy_file(at, at.replace(".dac", "999.dac"))
    assert token_codes.read_codes(spark, where).count() == 20


# --- 3 -------------------------------------------------------------------------------------------


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(3)]
    return [(k, " ".join([*(word() for _ in range(rng.randrange(30))), rng.choice(shared), *(word() for _ in range(rng.randrange(30)))])) for k in range(60)]


@pytest.mark.parametrize(("shard", "group"), [(1, 1), (5_000, 1_500), (1 << 20, 40_000)])
def test_large_groups_are_parted(spark, shard, group):
    rows = passages(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(exact_substr.remove_repeats(docs, 200, shard, group, 2_000)) == brute.repeats(rows, 200)


def test_parts_settle_by_count_or_by_order(spark):
    docs = spark.createDataFrame(passages(4), "doc_id long, text string")
    pieces = [(1, k, k, 0, 1, bytearray(t.encode())) for k, t in docs.collect()]
    small, settled = exact_substr.part_further(spark.createDataFrame(pieces, exact_substr.PIECE), 200, 700)
    assert small.count() > 0 and settled.count() > 0


def test_sorting_spills_and_recurses():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(3, 12))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(400)).encode() for _ in range(60)]
    texts += [texts[k][: 900 + k] for k in range(20)]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    spent = {}
    got = induced.repeated_windows(texts, 200, memory=20_000, spent=spent)  # the text is over ten times that
    assert spent["runs"] > 20 and spent["rounds"] >= 2 and sum(map(len, texts)) > 10 * 20_000 // 2
    for t, flags in zip(texts, got, strict=True):
        assert flags.tolist() == [seen[t[i : i + 200]] > 1 for i in range(len(t) - 199)]


def test_long_text_with_repeats(spark):
    rows = [(8, LONG[:120_000] + LONG[40_000:90_000]), (9, LONG[60_000:61_000]), (9, LONG[60_000:61_000]), (None, "x" * 400)]
    assert rows_of(exact_substr.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.repeats(rows, 200)


# --- 5 and 8 -------------------------------------------------------------------------------------


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 2, f"text {k}") for k in range(1_000)] + [(5, "five")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, 2).collect()
    assert len(got) == 2 and len({r["doc_id"] for r in got}) == 2
    # ids without a document take no place in it
    assert {r["doc_id"] for r in labelled.sample(docs, labels, 40).collect()} <= {0, 1, 5}
    assert sorted(got) == sorted(labelled.sample(docs, labels, 2).collect())


@pytest.mark.parametrize("kind", [0, 1, None])
def test_labels_of_one_kind_reject_nothing(spark, kind):
    docs = spark.createDataFrame([(k, "good words in a row, " * 20 + str(k)) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, kind) for k in range(20)], "doc_id long, quality int")
    judged = quality_trees.judge(docs.withColumn("text", F.col("doc_id").cast("string")), quality_trees.fit(docs, labels))
    assert [r["score"] for r in judged.collect()] == [0.5] * 20
    assert [r["score"] for r in quality_fm.score(docs, quality_fm.fit(docs, labels)).collect()] == [0.5] * 20


def test_machine_and_trees_score_as_plain_versions(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = dict(pairs(docs))
    machine = quality_fm.fit(docs, labels)
    for r in quality_fm.score(docs, machine).filter("doc_id % 7 = 0").collect():
        index, value = quality_fm.inputs(texts[r["doc_id"]] or "")
        v = machine.factors[index] * value[:, None]
        every_pair = v @ v.T
        margin = machine.bias + machine.weights[index] @ value + (every_pair.sum() - np.trace(every_pair)) / 2
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
    trees = quality_trees.fit(docs, labels)
    for r in quality_trees.judge(docs, trees).filter("doc_id % 7 = 0").collect():
        text = texts[r["doc_id"]] or ""
        words = quality_trees.text_stats.split(text)
        x = quality_trees.text_stats.shape(text, words, quality_trees.text_stats.base(text, words))
        total = trees.start
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = trees.left[node] if x[trees.feature[node]] <= trees.cut[node] else trees.right[node]
            total += trees.value[node]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)))
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.5)


# --- 6 -------------------------------------------------------------------------------------------


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "x " + LONG[:9_000] + " the answer to this question is forty two, they say"), (2, None)], "doc_id long, text string")
    for kind, value in (("string", "q-1"), ("int", 4), ("binary", bytearray(b"ab")), ("decimal(9,2)", None)):
        bench = spark.createDataFrame([(value, "The answer to this question is forty-two, they say.")], f"item_id {kind}, text string")
        got = decontaminate.matches(docs, bench).collect()
        assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, value)]


def test_query_against_all_places(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op6_decontaminate(spark, sf_dir).collect()}
    items = {r["item_id"]: decontaminate.normal(r["text"]) for r in bench.collect()}
    want = {}
    # all items against the documents that were found and every tenth of the others
    looked_at = [(d, t) for d, t in pairs(docs) if d % 10 == 0 or d in {d for d, _ in got}]
    for d, text in looked_at:
        text = decontaminate.normal(text)
        for i, item in items.items():
            if item:
                far = fast_edit_in(item, text)
                if far <= int(len(item) * 0.08):
                    want[d, i] = far
    assert got == want and len(want) >= 3


def fast_edit_in(item, text):
    """brute.edit_in with numpy rows over the item, one step for each character of the text; stops at 0."""
    codes, steps = np.array([ord(c) for c in item]), np.arange(len(item) + 1)
    column, best = steps.copy(), len(item)
    for c in text:
        new = np.minimum(column[1:] + 1, column[:-1] + (codes != ord(c)))
        new = np.concatenate([[0], new])
        column = np.minimum.accumulate(new - steps) + steps
        best = min(best, int(column[-1]))
    return best


# --- 7 -------------------------------------------------------------------------------------------


def test_identical_rows_are_cut_into_runs(spark):
    rows = spark.range(3_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same " * 10).alias("text"), "id").repartition(5)
    got = sharding.shard(rows, 1_000)
    sizes = got.groupBy("shard").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    assert got.select("id").distinct().count() == 3_000 and all(r["bytes"] <= 1_000 for r in sizes) and len(sizes) <= 151


# --- 9 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [500_000, 60])
def test_draw_by_walking(spark, sf_dir, block_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, block_rows=block_rows, carry=("doc_id", "source"))
    got = mixed.collect()
    targets = {r["source"]: r["target"] for r in got}
    if block_rows > 1_000:
        hashes = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("text")).collect()}
        offsets = {r[0]: r[1] for r in docs.select("source", F.pmod(F.xxhash64(F.lit(17), F.lit("offset"), "source"), F.lit(mixing.UNIT))).distinct().collect()}
        want = brute.drawn([(r["source"], r["size"], r["doc_id"], hashes[r["doc_id"]]) for r in got], targets, offsets, mixing.UNIT)
        assert sorted((r["doc_id"], r["copies"]) for r in got) == want
    # whatever the blocks: one running sum for each source, so its copies are the expected ones, rounded
    for source, target in targets.items():
        mine = [r for r in got if r["source"] == source]
        step = target / sum(r["size"] for r in mine)
        assert abs(sum(r["copies"] for r in mine) - step * len(mine)) <= 1 + 1e-3 and all(int(step) <= r["copies"] <= int(step) + 1 for r in mine if r["size"])


# --- 10 ------------------------------------------------------------------------------------------


def test_token_spans_by_ratio(spark, sf_dir):
    """Runs that aren't made of words, against a plain count of characters for each token."""
    path = secrets.public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "token"] for r in secrets.scan(docs).collect()}
    for d, text in pairs(docs):
        base, _ = brute.secrets(text)
        want = []
        for m in secrets.RUN.finditer(text or ""):
            free = all(m.end() <= a or b <= m.start() for _, a, b in base)
            if free and secrets.looks_random(m[0], 2.3, path):
                want.append(m.span())
        assert found[d] == want
        for a, b in found[d]:
            parts = [p for p in secrets.MARKS.split(text[a:b]) if not secrets.is_word(p)]
            assert any(len(p) < 2.3 * len(secrets.encoding(path).encode_ordinary(p)) for p in parts)


@pytest.mark.parametrize("letters", ["a", "A", "7", "aB", "a1", "-", "a-", "Zq3", "0123456789abcdef"])
def test_long_runs_of_any_letters_end(letters):
    import time

    begun = time.time()
    secrets.spans_of((letters * 100_000)[:100_000] + "1Q", 2.3, secrets.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert time.time() - begun < 20


def test_long_numbers_are_tested():
    path = secrets.public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert [k for k, *_ in secrets.spans_of("a 7391846205518273649018265537 b 12345678901234567890", 2.3, path)] == ["token"]
    assert secrets.looks_random("qZxWvKjPtRbNmLsDfGhYuIoE", 2.3, path)


def test_unused_names_compare_without_case(spark):
    assert unused(spark.createDataFrame([], "Size long, _size long"), "size") == "__size"
