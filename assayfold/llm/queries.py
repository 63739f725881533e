"""The thirteen operators as queries over the tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ball_tree,
    bestfit_packing,
    compression_classifier,
    cost_packing,
    dimension_scan,
    entropy_mixing,
    license_scan,
    lm_scoring,
    nn_descent,
    parity_join,
    quality_rules,
    separator_scan,
    term_tries,
)
from .common import Kept, delete, new_path, table


def op1_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents scored with benchmark's texts as the target."""
    return lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of documents' flat token files: doc_id, part, ordinal, n_tokens; the files are deleted when they are counted."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "tokens")
    separator_scan.write_token_files(docs, path)
    counts = separator_scan.count_by_document(spark, path)
    part = F.regexp_extract("file", "part-([0-9]+)", 1).cast("long").alias("part")
    out = Kept(spark, "counts").put(counts.select("doc_id", part, "ordinal", "n_tokens"), "out")
    delete(spark, path)
    return out


def op5_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    exact = F.filter("spans", lambda s: s["exact"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(exact, lambda s: s["start"])
    return out.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(exact).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def op6_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op7_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) >= 8
), hashed AS (
  SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS w FROM windows
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM hashed) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_exclamations,
         CAST(length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(list_filter(words, lambda w: list_contains([STOPS], lower(w)))) AS BIGINT) AS n_stop_words,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid)
), v AS (
  SELECT *, n_words < 20 OR coalesce(100 * n_repeat_words > 30 * n_words, false) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(word_chars / nullif(n_words, 0) < 2.0 OR word_chars / nullif(n_words, 0) > 14.0
         OR n_symbols / nullif(n_words, 0) > 0.25 OR n_exclamations / nullif(n_words, 0) > 0.35 OR n_stop_words / nullif(n_words, 0) < 0.02, false)
         OR coalesce(n_capitals / nullif(word_chars, 0) > 0.5, false) OR coalesce(n_dup_lines / nullif(n_lines, 0) > 0.5, false)) AS kept
FROM v
""".replace("STOPS", ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS))))


def op8_bestfit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_matrix(table(spark, sf_dir, "documents"))


def op9_cost_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack(table(spark, sf_dir, "documents"))


def op10_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression_classifier.fit(docs, table(spark, sf_dir, "labels"))
    out = compression_classifier.score(docs, model)
    return out.select(
        "doc_id",
        compression_classifier.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op11_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_scan.search(table(spark, sf_dir, "embeddings"))


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """The rounds written out: a<k> assigns vectors to the centroids c<k-1>, c<k> are the new ones."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    pick = f"SELECT rid, min(struct_pack(d := CAST({far} AS BIGINT), k := k)) AS b FROM v, c%d GROUP BY rid"
    steps = []
    for k in range(1, 11):
        steps.append(f"a{k} AS MATERIALIZED ({pick % (k - 1)})")
        steps.append(f"t{k} AS (SELECT b.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{k} JOIN v USING (rid), range(1, 65) r(i) GROUP BY ALL)")
        steps.append(f"n{k} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM t{k} GROUP BY k)")
        steps.append(f"c{k} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{k - 1} LEFT JOIN n{k} USING (k))")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM v ORDER BY k LIMIT 8),
{", ".join(steps)}, a AS MATERIALIZED ({pick % 10})
SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
 FROM a JOIN v USING (rid) JOIN c10 ON c10.k = b.k"""


def op13_term_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_tries.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM o GROUP BY 1, 2 HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, sum(n) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, CAST(1 + (1000000000 * CAST(coalesce(c, 0) + 1 AS HUGEINT)) // (s.n + v.v) AS BIGINT) AS p,
  CAST(1 + (1000000000 * CAST(k.total + 1 AS HUGEINT)) // (v.n + v.v) AS BIGINT) AS q FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op7_threshold_table": OP7_SQL, "op12_ball_tree": _op12_sql(), "op13_term_tries": OP13_SQL}
