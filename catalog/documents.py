"""Text operators over ``documents``: near-duplicates, chunks, embeddings, the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.functions import text as X
from articleflow.operators import chunking, dedup, embedding, retrieval, tables
from articleflow.session import cut, scratch
from catalog import sql as S
from catalog.registry import doc_articles, query, table


def keyed_chunks(spark, sf_dir):
    """Fixed-window chunks of all documents with stable keys."""
    pieces = chunking.chunk_fixed(doc_articles(spark, sf_dir, heavy=True))
    return pieces.withColumn("chunk_key", X.chunk_key(F.col("url"), F.col("chunk_id")))


def stored_chunks(spark, sf_dir):
    """The chunk table without embeddings, written once per query."""
    return cut(keyed_chunks(spark, sf_dir).select("chunk_key", "chunk_id", "text", "article_id", "url"))


def micro(vector):
    """Embedding as millionths, a text that is equal wherever the floats are."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ",")


# ------------------------------------------------------------------------------------------ near-duplicates

@query("shingles", f"""WITH {S.DOCS},{S.SHINGLES}
SELECT doc_id, CAST(len(sh) AS INT) AS n_shingles, md5(array_to_string(list_sort(sh), '|')) AS digest FROM shingled""")
def shingles(spark, sf_dir):
    sets = dedup.shingles(doc_articles(spark, sf_dir, heavy=True))
    digest = F.md5(F.array_join(F.array_sort("shingles"), "|"))
    return sets.select("doc_id", F.size("shingles").alias("n_shingles"), digest.alias("digest"))


@query("minhash_signature", f"""WITH {S.DOCS},{S.SHINGLES},{S.SIGNATURES}
SELECT doc_id, array_to_string(sig, ',') AS signature FROM sigs""")
def minhash_signature(spark, sf_dir):
    signed = dedup.minhash_signature(doc_articles(spark, sf_dir, heavy=True))
    return signed.select("doc_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query("lsh_bands", f"""WITH {S.DOCS},{S.SHINGLES},{S.SIGNATURES},{S.SLOTS}
SELECT doc_id, bucket FROM slots""")
def lsh_bands(spark, sf_dir):
    return dedup.banded(doc_articles(spark, sf_dir, heavy=True), ["doc_id"]).select(
        "doc_id", F.explode("buckets").alias("bucket")
    )


@query("near_dup_filter", f"WITH {S.KEPT} SELECT doc_id, article_id FROM docs WHERE doc_id IN (FROM kept)")
def near_dup_filter(spark, sf_dir):
    return dedup.near_dup_filter(doc_articles(spark, sf_dir, heavy=True), ["doc_id"]).select("doc_id", "article_id")


@query("near_dup_pairs_verified", f"""WITH {S.KEPT},
pairs AS (SELECT DISTINCT d.doc_id, k.doc_id AS kept_id FROM slots d JOIN slots k USING (bucket)
  WHERE d.doc_id NOT IN (FROM kept) AND k.doc_id IN (FROM kept)),
sims AS (SELECT p.doc_id, kept_id, len(list_intersect(a.sh, b.sh)) AS n, len(a.sh) + len(b.sh) AS total
  FROM pairs p JOIN shingled a ON a.doc_id = p.doc_id JOIN shingled b ON b.doc_id = kept_id)
SELECT doc_id, kept_id, round(jaccard, 6) AS jaccard FROM (SELECT doc_id, kept_id,
  CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE n / (total - n) END AS jaccard FROM sims) WHERE jaccard > {C.LSH_THRESHOLD}""")
def near_dup_pairs_verified(spark, sf_dir):
    pairs = dedup.near_dup_pairs_verified(doc_articles(spark, sf_dir, heavy=True), "doc_id", ["doc_id"])
    return pairs.withColumn("jaccard", F.round("jaccard", 6))


# ---------------------------------------------------------------------------------------- chunks, embeddings

@query("chunk_recursive", f"WITH RECURSIVE {S.DOCS},{S.RECURSIVE_CHUNKS} SELECT doc_id, chunk_id, text FROM rchunks")
def chunk_recursive(spark, sf_dir):
    return chunking.chunk_recursive(doc_articles(spark, sf_dir, heavy=True)).select("doc_id", "chunk_id", "text")


@query("chunk_fixed", f"WITH {S.DOCS},{S.CHUNKS} SELECT doc_id, CAST(chunk_id AS INT) AS chunk_id, text FROM chunks")
def chunk_fixed(spark, sf_dir):
    return chunking.chunk_fixed(doc_articles(spark, sf_dir)).select("doc_id", "chunk_id", "text")


@query("explode_chunks", f"""WITH {S.DOCS},{S.CHUNKS}
SELECT doc_id, CAST(chunk_id AS INT) AS chunk_id, text, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS of_chunks
FROM chunks""")
def explode_chunks(spark, sf_dir):
    nested = chunking.nest_chunks(chunking.chunk_fixed(doc_articles(spark, sf_dir)), "doc_id", ["text"])
    sized = nested.select("doc_id", F.col("chunks.text").alias("texts"), F.size("chunks").alias("of_chunks"))
    return chunking.explode_chunks(sized, "texts")


@query("drop_unchunkable", f"""WITH {S.DOCS},
parts AS (SELECT doc_id, len({S.words('content')}) AS n FROM docs UNION ALL SELECT -1 - doc_id, 0 FROM labels)
SELECT doc_id, CAST(n AS INT) AS n_parts FROM parts WHERE n > 0""")
def drop_unchunkable(spark, sf_dir):
    # Split into words; further articles, one per label, yield nothing.
    listed = doc_articles(spark, sf_dir).select("doc_id", X.words(F.col("content")).alias("chunks"))
    barren = table(spark, sf_dir, "labels").select(
        (-1 - F.col("doc_id")).alias("doc_id"), F.array().cast("array<string>").alias("chunks")
    )
    listed = listed.unionByName(barren)
    return chunking.drop_unchunkable(listed).select("doc_id", F.size("chunks").alias("n_parts"))


@query("chunk_stats", f"WITH {S.DOCS},{S.CHUNKS} SELECT article_id, count(*) AS n_chunks FROM chunks GROUP BY 1")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(chunking.chunk_fixed(doc_articles(spark, sf_dir)))


@query("embed_chunks", f"""WITH {S.DOCS},{S.CHUNKS},{S.embed('cv', 'chunks', 'chunk_key', 'text', 64)},
grid AS (SELECT chunk_key, dim FROM chunks, (SELECT unnest(range(0, 64)) AS dim))
SELECT chunk_key, string_agg(CAST(round(coalesce(x, 0) * 1e6) AS BIGINT), ',' ORDER BY dim) AS embedding
FROM grid LEFT JOIN cv USING (chunk_key, dim) GROUP BY 1""")
def embed_chunks(spark, sf_dir):
    embedded = embedding.embed_chunks(keyed_chunks(spark, sf_dir), embedding.hash_embedder(64))
    return embedded.select("chunk_key", micro("embedding").alias("embedding"))


@query("mock_embeddings", f"""WITH {S.DOCS},{S.CHUNKS},{S.embed('cv', 'chunks', 'chunk_key', 'text', 64)},
norms AS (SELECT chunk_key, sqrt(sum(x * x)) AS norm FROM cv GROUP BY 1)
SELECT chunk_key, 64 AS dim, 0.0::DOUBLE AS norm, 0.0::DOUBLE AS mock_cosine,
  CASE WHEN norm > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS own_cosine FROM chunks LEFT JOIN norms USING (chunk_key)""")
def mock_embeddings(spark, sf_dir):
    """The stand-in vector of every chunk against the chunk's real one, and the real one against itself."""
    real = embedding.embed_chunks(keyed_chunks(spark, sf_dir), embedding.hash_embedder(64)).select("chunk_key", "embedding")
    both = real.withColumn("mock", embedding.embedding_or_mock(F.lit(None).cast("array<float>"), 64))
    squares = F.aggregate("mock", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return both.select(
        "chunk_key", F.size("mock").alias("dim"), F.sqrt(squares).alias("norm"),
        retrieval.cosine(F.col("mock"), F.col("embedding")).alias("mock_cosine"),
        F.round(retrieval.cosine(F.col("embedding"), F.col("embedding")), 6).alias("own_cosine"),
    )


@query("validate_embedding_dim", """SELECT vec_id, 'valid' AS verdict FROM embeddings WHERE len(embedding) = 64
UNION ALL SELECT vec_id, 'rejected' FROM embeddings WHERE label > 4""")
def validate_embedding_dim(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    # Vectors of a second model, one dimension short, arrive next to the good ones.
    short = vectors.filter("label > 4").withColumn("embedding", F.slice("embedding", 1, F.size("embedding") - 1))
    valid, rejected = embedding.validate_embedding_dim(vectors.unionByName(short), 64)
    return valid.select("vec_id", F.lit("valid").alias("verdict")).unionByName(
        rejected.select("vec_id", F.lit("rejected").alias("verdict"))
    )


# --------------------------------------------------------------------------------------------- chunk table

@query("upsert_chunks", f"""WITH {S.DOCS},{S.CHUNKS}
SELECT chunk_key, url, CASE WHEN title = 'en' THEN 'rev2: ' || text ELSE text END AS text,
  strftime(scraped_at, '%Y-%m-%d') AS day FROM chunks JOIN docs USING (doc_id, url, title)""")
def upsert_chunks(spark, sf_dir):
    path = scratch(spark, "chunks")
    first = keyed_chunks(spark, sf_dir).select(
        "chunk_key", "url", "title", "text", F.to_date("scraped_at").alias("day")
    )
    # The revision arrives a month later, twice; its chunks stay in the partitions of their first day.
    revised = first.filter("title = 'en'").withColumns({
        "text": F.concat(F.lit("rev2: "), "text"), "day": F.add_months("day", 1),
    })
    for batch in (first, revised, revised):
        tables.upsert_into(batch.drop("title"), path, "chunk_key", [F.col("text").asc()])
    return spark.read.parquet(path).select("chunk_key", "url", "text", F.date_format("day", "yyyy-MM-dd").alias("day"))
