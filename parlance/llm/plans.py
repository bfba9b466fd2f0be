"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (brown, exact_dedup, merkle, mixing, near_dedup, packing, phrases, pii, pstable, quality, token_counts,
                          topk, toxicity)
from parlance.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum(table(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0)).cast("long").alias("position")
    return (mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", first)
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.class_scores(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.similar_vectors(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_checks(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, * FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)
), words AS (
  SELECT lang, piece, unnest(regexp_extract_all(t, '[^\x20\x09]+')) AS x, unnest(range(0, len(regexp_extract_all(t, '[^\x20\x09]+')))) AS pos FROM pieces
), runs AS (
  SELECT lang, x, lead(x, 1) OVER along AS y, lead(x, 2) OVER along AS z FROM words WINDOW along AS (PARTITION BY piece ORDER BY pos)
), f1 AS (
  SELECT lang, x, count(*) AS a FROM runs GROUP BY ALL
), f2 AS (
  SELECT lang, x, y, count(*) AS a FROM runs WHERE y IS NOT NULL GROUP BY ALL
), f3 AS (
  SELECT lang, x, y, z, count(*) AS a FROM runs WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), held AS (
  SELECT lang, x, y, max(a) AS a FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY ALL
), cuts AS (
  SELECT c.lang, concat_ws(' ', c.x, c.y) AS phrase, c.a, 1 AS k, l.a AS l, r.a AS r
  FROM f2 AS c JOIN f1 AS l ON l.lang = c.lang AND l.x = c.x JOIN f1 AS r ON r.lang = c.lang AND r.x = c.y
  LEFT JOIN held AS h ON h.lang = c.lang AND h.x = c.x AND h.y = c.y WHERE c.a >= 10 AND (h.a IS NULL OR 100 * h.a < 50 * c.a)
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.x, c.y, c.z), c.a, 1, l.a, r.a
  FROM f3 AS c JOIN f1 AS l ON l.lang = c.lang AND l.x = c.x JOIN f2 AS r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.x, c.y, c.z), c.a, 2, l.a, r.a
  FROM f3 AS c JOIN f2 AS l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 AS r ON r.lang = c.lang AND r.x = c.z
), scored AS (
  SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS far FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.far
), least AS (
  SELECT vec_id, min(far) AS component_id FROM reach GROUP BY vec_id
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id)
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1),
              lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
              lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 2 = 1 AS hit
  FROM documents
), e AS (
  SELECT doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS seen
  FROM d
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS seen FROM e
), sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM (SELECT DISTINCT source FROM leaves)
), placed AS (
  SELECT doc_id, s.place, leaf, seen, row_number() OVER (PARTITION BY s.place ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY s.place) AS n
  FROM leaves AS l JOIN sources AS s ON l.source IS NOT DISTINCT FROM s.source
), nodes AS (
  SELECT place, 0 AS level, rank, leaf AS digest, n FROM placed
  UNION ALL
  SELECT place, level + 1, rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), (n + 2) // 3 FROM nodes WHERE n > 1
  GROUP BY place, level, rank // 3, n
), tops AS (
  SELECT place AS rank, digest, (SELECT count(*) FROM sources) AS n FROM nodes WHERE n = 1
), above AS (
  SELECT -1 AS place, 0 AS level, rank, digest, n FROM tops
  UNION ALL
  SELECT place, level + 1, rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), (n + 2) // 3 FROM above WHERE n > 1
  GROUP BY place, level, rank // 3, n
), walk AS (
  SELECT row_number() OVER () AS id, place, 0 AS level, rank, n, seen AS acc, '' AS kept FROM placed
  UNION ALL
  SELECT w.id, w.place, w.level + 1, w.rank // 3, (w.n + 2) // 3,
         sha256(string_agg(CASE WHEN x.rank = w.rank THEN w.acc ELSE x.digest END, '' ORDER BY x.rank)),
         w.kept || coalesce(string_agg(x.digest, '' ORDER BY x.rank) FILTER (x.rank <> w.rank), '')
  FROM walk AS w JOIN nodes AS x ON x.place = w.place AND x.level = w.level AND x.rank // 3 = w.rank // 3 WHERE w.n > 1
  GROUP BY w.id, w.place, w.level, w.rank, w.n, w.kept
), climb AS (
  SELECT id, 0 AS level, place AS rank, (SELECT count(*) FROM sources) AS n, acc, kept FROM walk WHERE n = 1
  UNION ALL
  SELECT w.id, w.level + 1, w.rank // 3, (w.n + 2) // 3,
         sha256(string_agg(CASE WHEN x.rank = w.rank THEN w.acc ELSE x.digest END, '' ORDER BY x.rank)),
         w.kept || coalesce(string_agg(x.digest, '' ORDER BY x.rank) FILTER (x.rank <> w.rank), '')
  FROM climb AS w JOIN above AS x ON x.level = w.level AND x.rank // 3 = w.rank // 3 WHERE w.n > 1
  GROUP BY w.id, w.level, w.rank, w.n, w.kept
), root AS (
  SELECT digest AS root FROM above WHERE n = 1
)
SELECT p.doc_id, p.leaf, t.digest AS subroot, root, sha256(c.kept) AS proof_sha256, c.acc AS folded_root, c.acc = root AS verified
FROM (SELECT *, row_number() OVER () AS id FROM placed) AS p JOIN climb AS c USING (id) JOIN tops AS t ON t.rank = p.place, root WHERE c.n = 1
"""


def queries() -> dict[str, Query]:
    every = (op1_mix_sources, op2_toxicity, op3_quality, op4_exact_top_k, op5_class_lm, op6_exact_dedup, op7_near_dedup, op8_personal_data,
             op9_pack_sequences, op10_token_counts, op11_phrase_mining, op12_similar_vectors, op13_merkle_manifest)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_top_k": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op11_phrase_mining": OP11_SQL, "op12_similar_vectors": OP12_SQL,
            "op13_merkle_manifest": OP13_SQL}
