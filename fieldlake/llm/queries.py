"""The registered queries of the operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.llm import bpe, centroids, html_text, language, lexical, licences, lm, minhash, neighbours, pack, repeats, simhash, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the public 50k rank file."""
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document along the curve into sequences of 2048 tokens."""
    pieces = pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document from rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents.where(F.col("doc_id").isNotNull() & ~language.held_out()))
    found = language.identify(documents, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: three-word shingles, at most three differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes and more that an earlier document has."""
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document against all others."""
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the public 50k tokenizer JSON."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "n_whole")


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest-scoring documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


ORACLES["op12_lexical"] = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
total AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS terms FROM docs WHERE len(terms) > 0),
tf AS (
  SELECT doc_id, length, term, count(*) AS tf
  FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM docs)
  GROUP BY doc_id, length, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term),
gains AS (
  SELECT doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * length * total.docs) // total.terms))) AS gain
  FROM tf JOIN weights USING (term), total),
scores AS (
  SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score
  FROM items JOIN gains USING (term) GROUP BY item_id, doc_id HAVING sum(gain) > 0)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)
WHERE rank <= 10
"""


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings: 40 centroids, 5 rounds, 64 components."""
    placed = centroids.cluster(table(spark, sf_dir, "embeddings"), size=40, rounds=5, dimensions=64, scale=256, seed=2)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _centroids_sql(size: int = 40, rounds: int = 5) -> str:
    """All rounds written out; distances from inner products of doubles, which are exact for numbers of this size."""
    parts = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS cluster, x FROM v ORDER BY cluster LIMIT {size})"""
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
  SELECT r, arg_min(cluster, (d, cluster)) AS cluster, CAST(min(d) AS BIGINT) AS d
  FROM (SELECT r, cluster, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS d FROM v, c{k} c)
  GROUP BY r)""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(moved.x, c.x) AS x
  FROM c{k} c LEFT JOIN (
    SELECT cluster, list(y ORDER BY place) AS x
    FROM (SELECT cluster, place, floor(sum(y) / count(*)) AS y
          FROM (SELECT cluster, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM a{k} JOIN v USING (r)) GROUP BY cluster, place)
    GROUP BY cluster) moved USING (cluster))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c USING (cluster)
"""


ORACLES["op13_centroids"] = _centroids_sql()
