"""One query for each numbered operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, embdedup, exactdedup, langid, lexical, minhash, mixing, packing, quality, toxicity, trie, urlfilter
from .shared import fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


#: The conversation that op2 adds: it speaks another template's control strings.
ADDED = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a chain of replies, formatted, and then read back from the formatted string and its mask."""
    added = spark.createDataFrame([(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    messages = chat.cut(chat.from_turns(turns), "chat-messages")
    told = chat.read_back(chat.format_paths(messages, chat.branches(messages, unique=True), unique=True))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        F.substring_index("root", "/", 1).try_cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("under_mask").cast("long").alias("loss_chars"), F.sha2("under_mask", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards: the output shard of each copy taken, as the splitting tree deals the source's blocks."""
    return mixing.amounts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, fold_of(F.col("doc_id")) != 2)
    return langid.identify(docs, model).select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "accepted")


#: Host, path prefix and verdict of op6's list.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of(F.col("doc_id")) == 2, stored=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id")) != 2)
    return toxicity.judge(docs, model).select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's best documents; only terms that some item holds are indexed."""
    items = table(spark, sf_dir, "benchmark")
    lists, n_docs = lexical.index(table(spark, sf_dir, "documents"), lexical.vocabulary_of(items))
    return lexical.search(lists, n_docs, items).select(F.col("id").alias("item_id"), "rank", "doc_id", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations rebuilt as forks of each hundred's first."""
    turns = trie.cut(trie.numbered(table(spark, sf_dir, "conversations")), "trie-turns")
    return trie.tree(trie.forked(turns)).drop("digest")


SQL: dict[str, str] = {
    "op2_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
             + 5 * (length(text) - length(replace(text, '[', ''))) AS body FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(role) + body + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op3_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
             ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)]) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, hash(unnest(shingles)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, min(r.reach) AS component_id, s.doc_id = min(r.reach) AS kept
FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, s.shingles""",
    "op6_url_filter": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, pre, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.page_id, p.host, p.path, arg_max(r.h || r.pre, length(r.h || r.pre)) AS rule, arg_max(r.verdict, length(r.h || r.pre)) AS verdict
      FROM p LEFT JOIN r ON (p.host = r.h OR p.host LIKE '%.' || r.h) AND starts_with(p.path, r.pre) GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m""",
    "op9_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
r(id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.id""",
    "op10_ann_search": r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[2] - p[1]) * (p[2] - p[1])))) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g ON g.x = t.x""",
    "op12_lexical_search": r"""
WITH x AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY doc_id, term), d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM b GROUP BY item_id, term),
w AS (SELECT q.item_id, q.term, q.qtf * CAST(floor(1000 * ln((2 * t.docs + 2)::DOUBLE / (2 * f.df + 1)::DOUBLE)) AS BIGINT) AS w FROM q JOIN f USING (term), t),
m AS (SELECT d.doc_id, 25 + (75 * d.n * t.docs) // t.terms AS m FROM d, t),
s AS (SELECT w.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
      FROM w JOIN p ON p.term = w.term JOIN m ON m.doc_id = p.doc_id GROUP BY w.item_id, p.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "op13_prefix_trie": r"""
WITH RECURSIVE r0 AS (SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, said, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(said)) AS pos FROM r0),
i AS (SELECT DISTINCT conv_id FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
             lambda crc, b: list_reduce(range(8), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)), CAST(4294967295 AS BIGINT))) % 6 AS h FROM i),
r AS (SELECT c.conv_id, 1 AS part, t.pos, t.said, t.chars FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, 2, t.pos, t.said, t.chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
s AS (SELECT conv_id, said, chars, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM r),
p(conv_id, d, key, up, chars) AS (
  SELECT conv_id, CAST(0 AS BIGINT), sha256(''), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM c
  UNION ALL SELECT p.conv_id, s.d, sha256(p.key || s.said), p.key, CAST(s.chars AS BIGINT) FROM p JOIN s ON s.conv_id = p.conv_id AND s.d = p.d + 1),
n0 AS (SELECT d AS depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(up) AS up, max(chars) AS chars FROM p GROUP BY d, key),
k AS (SELECT up AS key, count(*) AS n_children FROM n0 WHERE up IS NOT NULL GROUP BY up),
n AS (SELECT n0.*, coalesce(k.n_children, 0) AS n_children FROM n0 LEFT JOIN k ON k.key = n0.key),
u AS (SELECT a.key, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.depth GROUP BY a.key),
z AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
e AS (SELECT p.key, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN z ON z.conv_id = p.conv_id AND z.d = p.d GROUP BY p.key)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
       CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN u ON u.key = n.key LEFT JOIN n q ON q.key = n.up LEFT JOIN e ON e.key = n.key""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_url_filter": op6_url_filter,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_ann_search": op10_ann_search,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}
