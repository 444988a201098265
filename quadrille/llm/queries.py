"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import chat_format, decontaminate, exact_substr, mixing, prefix_trie, quality_fm, quality_trees, secrets, sharding, simhash_dedup, spelling, token_codes, toxic_crf
from quadrille.llm.common import fresh_dir, table
from quadrille.llm.labelled import held_out

#: Bytes of text a shard may hold.
SHARD_BYTES = 256 << 10


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat_format.format_conversations(rows)
    turns = chat_format.read_turns(F.col("formatted"))
    back = done.withColumn("turns", turns).withColumn("loss", chat_format.masked_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = fresh_dir(spark, "token-codes")
    token_codes.write_codes(table(spark, sf_dir, "documents"), directory)
    return token_codes.read_codes(spark, directory)


def op3_exact_substr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_substr.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_dedup.group(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash_dedup.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality_fm.fit(docs, labels)
    return quality_fm.score(docs.select("doc_id", "text"), machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).select("doc_id", "shard", "shard_depth", "n_bytes")


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = quality_trees.fit(docs, labels)
    return quality_trees.judge(docs, trees).select("doc_id", *quality_trees.BASE, "base_failed", "score", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, carry=("doc_id",))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    put = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "token")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(put(base), 256).alias("base_sha256"), put(F.col("spans")).alias("spans"),
    )


def op11_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxic_crf.tag(docs.select("doc_id", "text"), toxic_crf.fit(docs, table(spark, sf_dir, "labels")))
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", toxic_crf.held_out().alias("held_out"), "score", "predicted", told.alias("spans"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"), modulus=97)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.build(prefix_trie.keyed(prefix_trie.share_starts(seqs)))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_token_codes": op2_token_codes,
    "op3_exact_substr": op3_exact_substr,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_quality_fm": op5_quality_fm,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_quality_trees": op8_quality_trees,
    "op9_mixing": op9_mixing,
    "op10_secret_scan": op10_secret_scan,
    "op11_toxic_crf": op11_toxic_crf,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}

_CONTROL = r"[<\[]\\*(?:/?s>|/?INST\]|/?SYS\]|ANS\]|/?ROLE\]|SEP\]|/END\])"
_SAID = "</s>[INST] ok [/INST]"


def _escaped(column: str) -> str:
    """Length of a text with its control strings escaped."""
    return f"length({column}) + len(regexp_extract_all({column}, '{_CONTROL}'))"


#: CRC-32 of the decimal conv_id before its last complement, bit by bit.
_CRC32 = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

ORACLES: dict[str, str] = {
    "op1_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
placed AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS goes_on, lead(role) OVER w IS NOT DISTINCT FROM role AS stays
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, {_escaped("text")} + CASE WHEN goes_on THEN 5 WHEN role = 'user' THEN 6 WHEN role IN ('system', 'assistant') THEN 5 ELSE 13 + {_escaped("role")} END
    + CASE WHEN stays THEN 0 WHEN role = 'user' THEN 7 WHEN role = 'system' THEN 6 WHEN role = 'assistant' THEN 4 ELSE 6 END AS chars FROM placed),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined""",
    "op7_sharding": f"""
WITH keyed AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
d AS (SELECT doc_id, n_bytes, array_to_string(list_transform(range(1, 33), lambda i:
  substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(h, i, 1)) - 3, 4)), '') AS bits FROM keyed),
buckets AS (SELECT r.k AS k, substr(bits, 1, r.k) AS prefix FROM d, range(0, 65) r(k) GROUP BY 1, 2 HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
first AS (SELECT doc_id, n_bytes, bits, min(k) AS k FROM d, buckets WHERE substr(bits, 1, k) = prefix AND length(prefix) = k GROUP BY 1, 2, 3)
SELECT doc_id, substr(bits, 1, k) AS shard, CAST(k AS INTEGER) AS shard_depth, n_bytes FROM first""",
    "op13_prefix_trie": f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'id': md5(length(role) || ':' || role || text), 'w': len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))}} ORDER BY turn NULLS FIRST, role, text) AS s
  FROM turns GROUP BY conv_id),
asked AS (SELECT conv_id, s, conv_id - ((conv_id % 20) + 20) % 20 AS base, xor({_CRC32}, 4294967295) % 4 AS h FROM own),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(o.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM asked a LEFT JOIN own o ON o.conv_id = a.base),
parts AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT d, array_to_string(list_transform(s[1:d], lambda t: t.id), '') AS p, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w, min(conv_id) AS least, count(*) AS n,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len(s)), '')) AS ends
  FROM parts GROUP BY 1, 2, 3),
kids AS (SELECT substr(p, 1, 32 * (d - 1)) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
marked AS (SELECT nodes.*, coalesce(kids.n, 0) AS children FROM nodes LEFT JOIN kids USING (p)),
spread AS (SELECT p, unnest(range(0, d + 1)) AS k, children, (n - 1) * w AS saved FROM marked),
sums AS (SELECT substr(p, 1, 32 * k) AS p, count(*) FILTER (WHERE children = 0) AS leaves, CAST(sum(saved) AS BIGINT) AS saved FROM spread GROUP BY 1)
SELECT m.least AS conv_id, m.d AS depth, u.least AS parent_conv_id, m.n AS n_convs, m.children AS n_children, leaves AS n_leaves, saved AS saved_tokens, m.ends AS ends_sha256
FROM marked m JOIN sums USING (p) LEFT JOIN nodes u ON m.d > 0 AND u.p = substr(m.p, 1, 32 * (m.d - 1))""",
}
