"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunk_dedup, conversation_trie, html_text, inner_products, lexical_ranking, mixing, ngram_join
from . import permutation_index, quality, secrets, sharding, url_filter
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = permutation_index.search(spark, vectors, vectors.where("vec_id % 50 = 0"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(spark, table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(spark, docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_documents(spark, table(spark, sf_dir, "documents"))


def op9_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = inner_products.search(spark, vectors, vectors.where("vec_id % 50 = 0"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark, table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(spark, table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("number").cast("int").alias("number"), F.length("value").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(spark, table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("difference", 6).alias("difference"))


def op12_lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_ranking.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(spark, table(spark, sf_dir, "conversations")).drop("node")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_permutation_index": op1_permutation_index,
        "op2_ngram_join": op2_ngram_join,
        "op3_bpe": op3_bpe,
        "op4_quality": op4_quality,
        "op5_html_text": op5_html_text,
        "op6_mixing": op6_mixing,
        "op7_sharding": op7_sharding,
        "op8_chunk_dedup": op8_chunk_dedup,
        "op9_inner_products": op9_inner_products,
        "op10_secrets": op10_secrets,
        "op11_url_filter": op11_url_filter,
        "op12_lexical_ranking": op12_lexical_ranking,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6, "op9_inner_products": OP9, "op11_url_filter": OP11, "op12_lexical_ranking": OP12, "op13_conversation_trie": OP13}


OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash FROM documents),
cells AS (
  SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS bucket FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS lim FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
reached AS (
  SELECT arg_min(level, lim / weight) AS level FROM levels WHERE level < lim / weight),
targets AS (
  SELECT l.source, l.source_size, least(lim, coalesce(r.level * weight, lim)) AS target,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(l.source, chr(0))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM levels l LEFT JOIN reached r ON true),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, hash, size, doc_id NULLS LAST) AS k FROM cells),
rated AS (
  SELECT r.doc_id, r.size, r.k, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS f
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(u + f * k) - floor(u + f * (k - 1)), ceil(f)) AS BIGINT) * size AS taken FROM rated
"""

OP9 = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP11 = r"""
WITH u AS (
  SELECT page_id, url, coalesce(url, '') AS t, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
parts AS (SELECT *, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM rules),
judged AS (
  SELECT u.*, p.rule, p.verdict, row_number() OVER () AS id FROM u LEFT JOIN parts p ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY rank() OVER (PARTITION BY page_id, url ORDER BY length(p.rule) DESC NULLS LAST, length(rhost) DESC) = 1),
-- lower-cased bytes in hexadecimal; crc32 as Spark has it, bit by bit
b AS (SELECT id, verdict = 'allow' AS accepted, hex(encode(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS x, octet_length(encode(t)) AS n,
      xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || substr(hex(encode(t)), 2 * i - 1, 2) AS BIGINT) FOR i IN range(1, octet_length(encode(t)) + 1)]),
        lambda c, y: list_reduce(list_prepend(xor(c, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT) % 5 AS fold
      FROM judged),
pos AS (SELECT id, accepted, fold, x, unnest(range(1, n + 1)) AS i FROM b),
g AS (SELECT id, accepted, fold, i, k, substr(x, 2 * (i - k) - 1, 2 * k + 2) AS gram FROM pos, (SELECT unnest(range(0, 6)) AS k) WHERE i > k),
counts AS (SELECT accepted, k, gram, count(*) AS n FROM g WHERE accepted IS NOT NULL AND fold <> 0 GROUP BY ALL),
kept AS (SELECT * FROM counts QUALIFY n * 65536 >= sum(n) OVER (PARTITION BY accepted, k)),
ctx AS (SELECT accepted, k, left(gram, 2 * k) AS context, sum(n) AS n FROM kept GROUP BY ALL),
looked AS (SELECT g.id, g.i, g.k, m.accepted, coalesce(kept.n, 0)::DOUBLE AS n, coalesce(ctx.n, 0)::DOUBLE AS c FROM g CROSS JOIN (VALUES (true), (false)) m(accepted)
  LEFT JOIN kept ON kept.accepted = m.accepted AND kept.gram = g.gram LEFT JOIN ctx ON ctx.accepted = m.accepted AND ctx.k = g.k AND ctx.context = left(g.gram, 2 * g.k)),
p AS (SELECT id, i, accepted, list_reduce(list_prepend([1 / 256.0::DOUBLE, 0], list([n, c] ORDER BY k)), lambda a, y: [(y[1] + 4.0::DOUBLE * a[1]) / (y[2] + 4.0::DOUBLE), 0])[1] AS p FROM looked GROUP BY id, i, accepted),
s AS (SELECT b.id, b.accepted, b.fold, coalesce(round(sum(CASE WHEN p.accepted THEN ln(p) ELSE -ln(p) END) / max(b.n), 9), 0) AS difference FROM b LEFT JOIN p ON p.id = b.id GROUP BY b.id, b.accepted, b.fold),
steps AS (SELECT accepted, greatest(-1024, least(1024, CAST(floor(difference * 64) AS INT))) AS step FROM s WHERE accepted IS NOT NULL AND fold = 0),
size AS (SELECT count(*) FILTER (WHERE accepted) AS good, count(*) FILTER (WHERE NOT accepted) AS bad FROM steps),
best AS (SELECT t, count(*) FILTER (WHERE accepted AND step >= t) * max(bad) + count(*) FILTER (WHERE NOT accepted AND step < t) * max(good) AS won FROM (SELECT unnest(range(-1024, 1026)) AS t), steps, size GROUP BY t),
least_allowed AS (SELECT coalesce((SELECT t / 64.0::DOUBLE FROM best, size WHERE good > 0 AND bad > 0 ORDER BY won DESC, abs(t), t LIMIT 1), 0) AS t)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN difference >= least_allowed.t THEN 'allow' ELSE 'block' END) AS verdict, round(difference, 6) AS difference
FROM judged JOIN s USING (id), least_allowed
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
post AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
st AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM post, st GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN post USING (term) JOIN w USING (term), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

OP13 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS first, n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(y) AS BIGINT) FOR y IN string_split(CAST(conv_id AS VARCHAR), '')]),
      lambda c, y: list_reduce(list_prepend(xor(c, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY 1)),
r AS (
  SELECT c.conv_id, t.pos AS depth, role, text FROM c JOIN t ON t.conv_id = c.first AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(f.n, 0)), role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c f ON f.conv_id = c.first),
e AS (
  SELECT conv_id, depth, length(text) AS chars, list(sha256(role || chr(1) || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path, depth = count(*) OVER (PARTITION BY conv_id) AS ends FROM r
  UNION ALL
  SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]), conv_id NOT IN (SELECT conv_id FROM r) FROM c),
k AS (SELECT *, md5(array_to_string(path, ',')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(path[:len(path) - 1], ',')) END AS parent FROM e),
n AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM k GROUP BY node),
ch AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
under AS (SELECT DISTINCT a.node AS node, d.node AS below FROM k a JOIN k d ON a.conv_id = d.conv_id AND a.depth <= d.depth),
su AS (
  SELECT under.node, count(*) FILTER (WHERE ch.node IS NULL) AS n_leaves, CAST(sum(n.saved) AS BIGINT) AS saved_tokens
  FROM under JOIN n ON n.node = under.below LEFT JOIN ch ON ch.node = under.below GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children, su.n_leaves, su.saved_tokens, n.ends_sha256
FROM n JOIN su ON su.node = n.node LEFT JOIN ch ON ch.node = n.node LEFT JOIN n p ON p.node = n.parent
"""
