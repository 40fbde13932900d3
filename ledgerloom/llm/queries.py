"""The operators of this folder as named queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


@named("op1_token_binary")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from .token_binary import token_binary

    return token_binary(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@named("op7_secrets")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, folder, "documents"))


@named(
    "op10_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(sha, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (sha)
""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, folder, "pages"))


@named("op6_language")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from . import language
    from .learning import remainder

    docs = table(spark, folder, "documents")
    found = language.predict(docs, language.fit(docs, remainder(4) != 2))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@named("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from . import toxicity
    from .learning import remainder

    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


@named(
    "op3_neighbours",
    """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.x, b.x) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .neighbours import nearest

    return nearest(table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


@named("op4_pieces")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from .pieces import encode

    return encode(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), roomy=True)


@named("op9_leaks")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from .leaks import find_leaks

    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@named("op2_near_copies")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from .near_copies import near_copies

    return near_copies(table(spark, folder, "documents"))


@named("op8_repeats")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, folder, "documents"))


def _squared_sql(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _floor_sql(total: str, many: str) -> str:
    """The floor of a quotient; the engine's own integer division goes towards zero."""
    return f"CAST(({total} - ((({total}) % {many} + {many}) % {many})) // {many} AS BIGINT)"


_FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def _codes_sql(rounds: int = 2) -> str:
    steps = [
        f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x,
  len(embedding) // 16 AS width FROM embeddings WHERE {_FINITE_SQL} AND len(embedding) > 0 AND len(embedding) % 16 = 0),
kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS n FROM v
  WHERE len(x) = (SELECT len(x) FROM v ORDER BY vec_id NULLS LAST, x LIMIT 1)),
parts AS MATERIALIZED (SELECT n, vec_id, label, part, x[part * width + 1:part * width + width] AS y FROM kept, range(16) AS r(part)),
c0 AS MATERIALIZED (SELECT part, n - 1 AS entry, y AS c FROM parts WHERE n <= 64)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT n, p.part, min(struct_pack(far := {_squared_sql("y", "c")}, entry := entry)) AS best
  FROM parts AS p JOIN c{k} AS c ON p.part = c.part GROUP BY n, p.part)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT d.part, d.best.entry AS entry, i, sum(y[i]) AS total, count(*) AS many
  FROM d{k} AS d JOIN parts AS p ON p.n = d.n AND p.part = d.part, unnest(generate_series(1, len(y))) AS g(i) GROUP BY ALL),
m{k} AS (SELECT part, entry, list({_floor_sql("total", "many")} ORDER BY i) AS c FROM s{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, o.c) AS c FROM c{k} AS o LEFT JOIN m{k} AS m USING (part, entry))""")
    steps.append(f"""seal AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT n, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM d{rounds} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (n), seal""")
    return ",\n".join(steps)


@named("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from .codes import vector_codes

    return vector_codes(table(spark, folder, "embeddings"))


def _clusters_sql(rounds: int = 10) -> str:
    steps = [
        f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE {_FINITE_SQL} AND len(embedding) = 64),
kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) AS n FROM v),
c0 AS MATERIALIZED (SELECT n - 1 AS cluster, x AS c FROM kept WHERE n <= 8)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT n, min(struct_pack(far := {_squared_sql("x", "c")}, cluster := cluster)) AS best
  FROM kept, c{k} GROUP BY n)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT best.cluster AS cluster, i, sum(x[i]) AS total, count(*) AS many
  FROM d{k} JOIN kept USING (n), range(1, 65) AS r(i) GROUP BY ALL),
m{k} AS (SELECT cluster, list({_floor_sql("total", "many")} ORDER BY i) AS c FROM s{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{k} AS o LEFT JOIN m{k} AS m USING (cluster))""")
    steps.append(f"""f AS (SELECT n, best.cluster AS cluster, best.far AS distance FROM d{rounds})
SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN kept USING (n) JOIN c{rounds} USING (cluster)""")
    return ",\n".join(steps)


@named("op12_vector_clusters", _clusters_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from .clusters import vector_clusters

    return vector_clusters(table(spark, folder, "embeddings"))


@named("op13_document_fingerprints")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from .simhash import document_fingerprints

    return document_fingerprints(table(spark, folder, "documents"))
