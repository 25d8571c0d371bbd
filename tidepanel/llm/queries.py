"""Named queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    from tidepanel.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup", """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, p, list_slice(ws, p, p + 12) AS g FROM w, unnest(range(1, len(ws) - 11)) AS u(p)),
f AS (SELECT g, min(doc_id) AS low FROM s GROUP BY g),
c AS (SELECT DISTINCT doc_id, p + k AS pos FROM s JOIN f USING (g), unnest(range(0, 13)) AS o(k) WHERE low < doc_id),
t AS (SELECT w.doc_id, len(ws) AS n, u.pos, ws[u.pos] AS word, c.pos IS NOT NULL AS gone FROM w, unnest(range(1, len(ws) + 1)) AS u(pos)
  LEFT JOIN c ON c.doc_id = w.doc_id AND c.pos = u.pos)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM t GROUP BY doc_id) r USING (doc_id)
""")
def op3_substring_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from tidepanel.llm.substring import substring_dedup

    got = substring_dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op5_ngram_jaccard", """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE list_slice(ws, p, p + 2) END AS g FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS u(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n) GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = w.doc_id
""")
def op5_ngram_jaccard(spark, sf_dir):
    from tidepanel.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    from tidepanel.llm.bpe import read_ranks

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@query("op8_byte_bpe")
def op8_byte_bpe(spark, sf_dir):
    from tidepanel.llm.bpe import digests, encode

    return digests(encode(table(spark, sf_dir, "documents"), *vocabulary()))


@query("op9_packed_ids")
def op9_packed_ids(spark, sf_dir):
    from tidepanel.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), *vocabulary())


@query("op4_mix_sources")
def op4_mix_sources(spark, sf_dir):
    from tidepanel.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


@query("op7_shards")
def op7_shards(spark, sf_dir):
    from tidepanel.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    from tidepanel.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op1_near_vectors", """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND list_count(v) = len(v) AND len(list_filter(v, lambda x: isnan(x) OR isinf(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
""")
def op1_near_vectors(spark, sf_dir):
    from tidepanel.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def _licence_sql() -> str:
    from tidepanel.llm.licences import licence_sql

    return licence_sql()


@query("op10_licence_scan", _licence_sql())
def op10_licence_scan(spark, sf_dir):
    from tidepanel.llm.licences import licence_scan

    return licence_scan(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    from tidepanel.llm.spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"))


@query("op12_word_table_bpe")
def op12_word_table_bpe(spark, sf_dir):
    import public_tokenizers

    from tidepanel.llm.word_bpe import decode, digests, encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(decode(encode(table(spark, sf_dir, "documents"), path), path))


def _fim_sql() -> str:
    from tidepanel.llm.fim import FIM_SQL

    return FIM_SQL


@query("op13_fill_in_middle", _fim_sql())
def op13_fill_in_middle(spark, sf_dir):
    from tidepanel.llm.fim import digests, fill_in_middle

    return digests(fill_in_middle(table(spark, sf_dir, "documents")))
