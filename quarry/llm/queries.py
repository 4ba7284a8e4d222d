"""The queries of this subpackage: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, chat_format, hard_negatives, html_text, language_id, lz_fingerprint, mixing, ngram_join, substring_dedup, token_counts, toxicity, vector_search, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    rows = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), width=20)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_format(spark, sf_dir):
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op3_vector_search(spark, sf_dir):
    return vector_search.search(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_bpe(spark, sf_dir):
    import public_tokenizers

    coder = bpe.Bpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = _table(spark, sf_dir, "documents").select("doc_id", coder.coded(F.col("text")).alias("c"))
    return rows.select("doc_id", bpe.n_tokens(F.col("c.ids")).alias("n_tokens"), F.sha2("c.ids", 256).alias("ids_sha256"), F.sha2("c.decoded", 256).alias("decoded_sha256"))


def op5_mixing(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op6_language_id(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_lz_fingerprint(spark, sf_dir):
    return lz_fingerprint.with_neighbours(_table(spark, sf_dir, "documents"))


def op8_html_text(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark, sf_dir):
    return toxicity.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_join(spark, sf_dir):
    return ngram_join.join_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op11_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4)


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), every=100, positives=5, negatives=5)


def op13_token_counts(spark, sf_dir):
    import public_tokenizers

    counts = token_counts.TokenCounts(spark, public_tokenizers.path("word_bpe_49k.json"))
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counts.counted(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_chat_format, op3_vector_search, op4_bpe, op5_mixing, op6_language_id, op7_lz_fingerprint, op8_html_text, op9_toxicity, op10_ngram_join, op11_whitening, op12_hard_negatives, op13_token_counts)}

_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op1_substring_dedup": f"""
WITH docs AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM docs)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM later CROSS JOIN range(20) AS t(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS j FROM docs),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS text FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.j = gone.j GROUP BY words.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(counts.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "op3_vector_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND NOT list_has_any(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), [true])),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE list_inner_product(e, e) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (q.size * c.size) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op12_hard_negatives": """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND NOT list_has_any(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), [true])),
scores AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1]::HUGEINT * p[2]))::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM scores WHERE label = own) WHERE n <= 5),
ranked AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM ranked WHERE rank <= 5""",
    "op10_ngram_join": f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, least(len(w), 1)))) AS i FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT docs.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)""",
}
