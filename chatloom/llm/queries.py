"""The registered queries of the operators in this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import change_points, decontaminate, jaccard_join, language_id, language_model, license_scan, line_dedup, mixing, nearest_vectors, token_counts, topk_search, toxicity, vector_codes
from chatloom.llm.store import fold, kept, read

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
LEVELS = ["domain", "lang", "source"]
#: Target weights of the mix by node; a node that isn't named weighs 1.
WEIGHTS = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0, "en": 5.0, "fr": 2.0, "de": 2.0, "es": 1.0}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def with_domain(docs: DataFrame) -> DataFrame:
    """Sources belong to four domains by the number that their name ends with; others to `other`."""
    number = F.regexp_extract("source", r"([0-9]{1,9})$", 1)
    return docs.withColumn("domain", F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), F.pmod(number.cast("int"), F.lit(4)))))


def weight(path: tuple) -> float:
    return WEIGHTS.get(path, WEIGHTS.get(path[-1], 1.0) if len(path) == 2 else 1.0)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang", "source"))
    taken = mixing.taken_units(docs, LEVELS, weight)
    return taken.select(F.col("_id").alias("doc_id"), *[F.col(f"_l{k}").alias(c) for k, c in enumerate(LEVELS)], "n_tokens", "copies")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang")
    train = (fold(F.col("id"), 5) != 0) & F.col("lang").isNotNull()
    profiles = language_id.learn(docs.where(train))
    out = language_id.judged(docs.select("id", "text"), profiles)
    return out.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic").where(fold(F.col("id"), 5) != 0)
    out = toxicity.scored(docs, toxicity.learn(docs, labels))
    return out.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return decontaminate.contamination(docs, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_components(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.license_report(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return token_counts.token_counts(docs, token_counts.vocabulary(tokenizer)).withColumnRenamed("id", "doc_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = nearest_vectors.nearest(vectors, F.col("id") % 50 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", (fold(F.col("doc_id"), 7) == 2).alias("held"))
    out = language_model.scored(docs, ~F.col("held"))
    return out.withColumnsRenamed({"id": "doc_id", "held": "held_out"})


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").where(topk_search.finite(F.col("embedding"))).select(F.col("vec_id").alias("id"), topk_search.scaled(F.col("embedding")).alias("vector"))
    out = topk_search.top_k(vectors, F.col("id") % 50 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "sale_lines").select(F.col("vendor_id").alias("key"), F.col("shipped_at").alias("at"), F.col("quantity").alias("value"))
    return change_points.segments(rows).withColumnRenamed("key", "vendor_id")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").where(topk_search.finite(F.col("embedding"))).select(F.col("vec_id").alias("id"), topk_search.scaled(F.col("embedding")).alias("vector"), "label")
    books = vector_codes.learn(vectors)
    codes = kept(vector_codes.encoded(vectors, books).select("id", "label", "code", "error"), "vector_codes")
    digits = F.lower(F.concat_ws("", F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0"))))
    out = with_total(codes, "label", "error", "label_error")
    return out.select(F.col("id").alias("vec_id"), F.when(F.col("code").isNotNull(), digits).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def with_total(rows: DataFrame, key: str, value: str, name: str, most: int = 1 << 16, salts: int = 64) -> DataFrame:
    """rows with the sum of value over the rows of an equal key, nulls together. Up to `most` keys are broadcast; more meet their rows by a shuffle in which each key has `salts` places."""
    totals = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(name))
    if totals.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(totals), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_place", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_place") == F.col("_salt"))).drop("_key", "_salt", "_place")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": op1, "op2_language_id": op2, "op3_line_dedup": op3, "op4_toxicity": op4, "op5_decontamination": op5, "op6_ngram_jaccard": op6,
        "op7_license_scan": op7, "op8_token_counts": op8, "op9_nearest_vectors": op9, "op10_language_model": op10, "op11_topk_inner_product": op11, "op12_change_points": op12,
        "op13_vector_codes": op13,
    }


LINE_DEDUP_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id < r.top, false) AS lost FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.node WHERE c.root < u.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS root FROM c GROUP BY node) r ON r.node = d.doc_id
"""


LICENSE_SQL = r"""
WITH tpl(tid, label, base, w) AS (VALUES {templates}),
q AS (SELECT tid, label, base, len(w) - 1 AS pairs, t, w[t + 1] AS a, w[t + 2] AS b FROM tpl, LATERAL (SELECT unnest(range(len(w) - 1)) AS t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, p, w[p + 1] AS a, w[p + 2] AS b FROM d, LATERAL (SELECT unnest(range(len(w) - 1)) AS p)),
v AS (SELECT doc_id, tid, label, base, pairs, p - t AS diagonal, bit_or(1::BIGINT << t) AS bits FROM x JOIN q USING (a, b) GROUP BY ALL),
n AS (SELECT *, bit_count(bit_or(bits) OVER (PARTITION BY doc_id, tid ORDER BY diagonal RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)) / pairs::DOUBLE AS near, bit_count(bits) / pairs::DOUBLE AS own FROM v),
s AS (SELECT doc_id, label, base, diagonal, CASE WHEN base THEN own ELSE near END AS covered FROM n WHERE CASE WHEN base THEN own = 1 ELSE near >= 0.6 END),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
        array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(covered) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n_base, 0)::BIGINT AS n_base, g.first_word::BIGINT AS first_word, g.last_word::BIGINT AS last_word,
       coalesce(g.base_labels, '') AS base_labels, coalesce(g.labels, '') AS labels, coalesce(g.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id)
"""


TOPK_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: State by vendor and day: the keys (cost times 100000, plus segments) and last starts of the best cuts of the days up to it.
CHANGE_POINTS_SQL = r"""
WITH RECURSIVE t AS (SELECT vendor_id, datediff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS day, sum(quantity) AS total
  FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
b AS (SELECT vendor_id, min(day) AS first, max(day) - min(day) + 1 AS days, map_from_entries(list((day, total))) AS by_day FROM t GROUP BY vendor_id),
l AS (SELECT *, list_transform(range(days), lambda i: CAST(coalesce(by_day[first + i], 0) AS BIGINT)) AS x FROM b),
c AS (SELECT vendor_id, first, days, list_transform(range(days + 1), lambda e: CAST(coalesce(list_sum(x[1:e]), 0) AS HUGEINT)) AS s,
        list_transform(range(days + 1), lambda e: CAST(coalesce(list_sum(list_transform(x[1:e], lambda y: y * y)), 0) AS HUGEINT)) AS q FROM l),
w AS (
  SELECT vendor_id, first, days, s, q, 0::BIGINT AS e, [-40000::BIGINT * 100000] AS k, [0::BIGINT] AS f FROM c
  UNION ALL
  SELECT vendor_id, first, days, s, q, e + 1, list_append(k, m.k), list_append(f, m.s)
  FROM (SELECT *, CASE WHEN e + 1 < 14 THEN {'k': 9000000000000000000::BIGINT, 's': 0::BIGINT} ELSE list_min(list_transform(
      list_filter(range(0, e + 1 - 13), lambda i: i = 0 OR i >= 14),
      lambda i: {'k': k[i + 1] + 100000 * (40000 + (e + 1 - i) * CAST(floor(1000 * ln(CAST(1 + ((e + 1 - i) * (q[e + 2] - q[i + 1]) - (s[e + 2] - s[i + 1]) * (s[e + 2] - s[i + 1])) // ((e + 1 - i) * (e + 1 - i)) AS DOUBLE))) AS BIGINT)) + 1, 's': i})) END AS m
    FROM w WHERE e < days)),
p AS (
  SELECT vendor_id, first, days, s, q, f, days AS till, CASE WHEN days < 14 THEN 0 ELSE f[days + 1] END AS since FROM w WHERE e = days
  UNION ALL
  SELECT vendor_id, first, days, s, q, f, since, f[since + 1] FROM p WHERE since > 0),
g AS (SELECT vendor_id, first + since AS first_day, till - since AS n, s[till + 1] - s[since + 1] AS total, q[till + 1] - q[since + 1] AS squares FROM p),
v AS (SELECT *, 1 + (n * squares - total * total) // (n * n) AS spread FROM g),
z AS (SELECT *, n * CAST(floor(1000 * ln(CAST(spread AS DOUBLE))) AS BIGINT) AS cost FROM v)
SELECT vendor_id, CAST(row_number() OVER o AS INT) AS segment_no, first_day, CAST(n AS BIGINT) AS n_days, CAST(total AS BIGINT) AS total, CAST(spread AS BIGINT) AS spread, cost,
       count(*) OVER a AS n_segments, CAST(sum(cost) OVER a + 40000 * (count(*) OVER a - 1) AS BIGINT) AS best_cost
FROM z WINDOW o AS (PARTITION BY vendor_id ORDER BY first_day), a AS (PARTITION BY vendor_id)
"""


def codes_sql(rounds: int = 2, entries: int = 64) -> str:
    """Parts by vector and position, a codebook a round, and the nearest entry by distance, then index."""
    sql = [
        "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "s AS (SELECT vec_id, label, p, x[p * len(x) // 16 + 1:(p + 1) * len(x) // 16] AS y FROM v, (SELECT unnest(range(16)) AS p))",
        f"b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, y AS c FROM s QUALIFY e < {entries})",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(range(1, len(y) + 1), lambda i: (y[i] - c[i]) * (y[i] - c[i])))"
        sql.append(f"a{r} AS (SELECT vec_id, label, p, any_value(y) AS y, min({{'d': {far}, 'e': e}}) AS m FROM s JOIN b{r} USING (p) GROUP BY vec_id, label, p)")
        if r < rounds:
            mean = "list_transform(range(1, any_value(len(y)) + 1), lambda i: CAST(floor(list_sum(list_transform(list(y), lambda z: z[i])) / count(*)) AS BIGINT))"
            sql.append(f"n{r} AS (SELECT p, m.e AS e, {mean} AS c FROM a{r} GROUP BY p, m.e)")
            sql.append(f"b{r + 1} AS (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN n{r} n ON n.p = b.p AND n.e = b.e)")
    sql.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    sql.append(f"d AS (SELECT vec_id, label, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)")
    return ",\n".join(sql) + "\nSELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM d, h"


def license_sql() -> str:
    rows = [f"({tid}, '{label}', {base}, {words!r})" for tid, (label, base, words) in enumerate(license_scan.templates(license_scan.BASE, license_scan.NOTICES))]
    return LICENSE_SQL.replace("{templates}", ", ".join(rows))


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP_SQL, "op6_ngram_jaccard": JACCARD_SQL, "op7_license_scan": license_sql(), "op11_topk_inner_product": TOPK_SQL, "op12_change_points": CHANGE_POINTS_SQL, "op13_vector_codes": codes_sql()}
