import collections
import glob
import itertools
import random
import time

from quadrille.llm import near_copies
from tests.llm import brute

DOCS = "doc_id long, text string"


def shingles(text):
    words = brute.WORD.findall((text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_drops_near_copies_and_nothing_else(spark):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"w{rng.randrange(5_000)}" for _ in range(400)]
    copies = []
    for k in range(8):
        changed = list(words)
        for at in rng.sample(range(0, 400, 20), 1 + k % 4):
            changed[at : at + 1] = [f"new{k}"] * (1 + k % 3)
        copies.append(" ".join(changed))
    # one repeated shingle makes up over half of each, the rest differs
    repeated = ["again " * 300 + " ".join(f"x{k}y{i}" for i in range(200)) for k in range(3)]
    rows = [(0, " ".join(words)), *enumerate(copies, 1), *enumerate(repeated, 20), (30, None), (31, " \n"), (32, "one"), (33, "ONE"), (None, "one"), (0, " ".join(words))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 20, 21, 22, 30, 32]
    assert near_copies.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_classes_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    held, common = collections.defaultdict(list), collections.Counter()
    for d, found in sorted(rows.items()):
        for s in found:
            held[s].append(d)
    for ids in held.values():
        common.update(itertools.combinations(ids, 2))
    label = {d: d for d in rows}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    empty = [d for d in rows if not rows[d]]
    near = [p for p, n in common.items() if n >= 0.8 * (len(rows[p[0]]) + len(rows[p[1]]) - n)]
    for a, b in [*near, *zip(empty, empty[1:], strict=False)]:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    assert sorted(r["doc_id"] for r in near_copies.dedup(docs).collect()) == sorted(d for d in rows if root(d) == d)


def test_no_shuffle_files_are_left_by_what_is_stored(spark):
    def held():
        return set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*", recursive=True))

    before = held()
    docs = spark.createDataFrame([(k, f"one two three four five six {k % 7}") for k in range(50)], DOCS)
    classes = near_copies.group(docs.withColumn("k", docs["doc_id"].cast("string")))
    end = time.time() + 20
    while held() - before and time.time() < end:  # they go in the background
        time.sleep(0.2)
    assert not held() - before
    assert classes.select("label").distinct().count() == 7
