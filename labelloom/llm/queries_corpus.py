"""Registered queries of substring dedup, importance resampling and centroid clustering, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.llm import centroids, resampling, substrings
from labelloom.llm.registry import query

_BLANKS = r"[^\x20\x09-\x0D]+"


@query("op11_substring_dedup", rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANKS}') AS w FROM documents),
  p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
  k AS (SELECT r, i, n, array_to_string(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {substrings.WINDOW - 1} FOLLOWING), ' ') AS k FROM p),
  again AS (SELECT r, i FROM k WHERE i + {substrings.WINDOW - 1} <= n QUALIFY count(*) OVER (PARTITION BY md5(k)) > 1),
  gone AS (SELECT DISTINCT r, unnest(range(i, i + {substrings.WINDOW})) AS i FROM again),
  kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM p ANTI JOIN gone USING (r, i) GROUP BY r)
  SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
  FROM d LEFT JOIN kept USING (r)""")
def op11_substring_dedup(spark, d):
    """What is left of every document without the words of windows of 35 words that also start elsewhere."""
    out = substrings.remove_repeats(spark.read.parquet(f"{d}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    return out.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def _grams_sql(table: str, key: str) -> str:
    """Distinct features of a table's rows with their counts."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""(SELECT r, key, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f
    FROM (SELECT row_number() OVER () AS r, {key} AS key, {words} AS w FROM {table}))"""


# The checksum table by its rule; a feature's bytes come from its hexadecimal form.
_CRC_SQL = """crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], range(8)), lambda x, i:
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(b)))"""
_BUCKET_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(hex(encode(g))), 2), lambda i: ('0x' || hex(encode(g))[i + 1:i + 2])::BIGINT)),
    lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % """ + str(resampling.BUCKETS)

OP12_SQL = f"""WITH {_CRC_SQL},
  d AS {_grams_sql("documents", "doc_id")}, m AS {_grams_sql("benchmark", "item_id")},
  df AS (SELECT r, unnest(f) AS g FROM d), mf AS (SELECT unnest(f) AS g FROM m),
  names AS (SELECT g, {_BUCKET_SQL} AS bucket FROM (SELECT g FROM df UNION SELECT g FROM mf), crc),
  s AS (SELECT bucket, count(*) AS s FROM df JOIN names USING (g) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM mf JOIN names USING (g) GROUP BY bucket),
  gain AS (SELECT bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {resampling.BUCKETS})
      / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM mf) + {resampling.BUCKETS})))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
  weight AS (SELECT r, cast(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN names USING (g) JOIN gain USING (bucket) GROUP BY r),
  scored AS (SELECT r, key AS doc_id, n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || left(sha256('{resampling.SALT}' || coalesce(key::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM d LEFT JOIN weight USING (r)),
  able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {resampling.LEAST_WORDS})
  SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {resampling.SHARE} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (r)"""


@query("op12_importance_resampling", OP12_SQL)
def op12_importance_resampling(spark, d):
    """Importance weight, score and draw of every document, with the benchmark's texts as the target."""
    docs, target = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampling.resample(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def _lloyd_sql(rounds: int, k: int, dims: int) -> str:
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = []
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min((far, j)) AS best FROM (SELECT r, vec_id, v, j, {far} AS far FROM rows, c{i}) GROUP BY r)")
        if i < rounds:
            parts.append(f"""u{i} AS (SELECT j, list(m ORDER BY x) AS c FROM (SELECT j, x, sum(y)::HUGEINT AS s, count(*) AS n,
      cast(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS BIGINT) AS m
      FROM (SELECT best[2] AS j, unnest(v) AS y, generate_subscripts(v, 1) AS x FROM a{i}) GROUP BY j, x) GROUP BY j)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(u{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN u{i} USING (j))")
    return f"""WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: cast(floor({centroids.SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs({centroids.SCALE} * x::DOUBLE) < {centroids.LARGEST})) = {dims}),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS j, v AS c FROM rows QUALIFY j < {k}),
  {", ".join(parts)}
  SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, cast(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
    cast(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON j = best[2]"""


@query("op13_centroid_clustering", _lloyd_sql(3, 16, 64))
def op13_centroid_clustering(spark, d):
    """Cluster and squared distance of every kept vector after three rounds, inertias, and the digest of its centroid."""
    out = centroids.cluster(spark.read.parquet(f"{d}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                      F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
