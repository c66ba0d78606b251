"""The registered queries of the text operators; each reads whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import (
    alignment, centroids, chat, jaccard, language, licences, line_quality, mixing, neighbours, packing,
    toxicity, vectors, warc,
)
from quadrat.llm.common import crc_fold, table, written

Query = Callable[[SparkSession, str], DataFrame]

# The mix of the registered query: sources weigh 3, 1 and 2 in turn, at all times.
WEIGHTS = [[3.0, 3.0], [1.0, 1.0], [2.0, 2.0]]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page through an archive: payload size and digest, response or revisit."""
    place = warc.archive_folder(spark)
    files = warc.write(table(spark, folder, "pages"), place)
    found = warc.read(files, place).select(
        "record_id", "kind", "refers_to", "page_id", "digest", "payload_bytes"
    )
    found = warc.whole(written(found, "warc-records"), files)
    first = found.where("kind = 'response'").select(
        F.col("record_id").alias("refers_to"),
        F.col("page_id").alias("first_page"),
        F.col("payload_bytes").alias("first_bytes"),
    )
    return found.join(first, "refers_to", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("first_page").alias("refers_to"),
    )


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 tokens."""
    return packing.pack(table(spark, folder, "documents"), vocabulary())


def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence families of every document, with the best probability."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = licences.scan(docs, *licences.train(docs))
    return found.select("doc_id", F.concat_ws(",", "licences").alias("licences"), "n_hits", "score")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document, at most twice its size."""
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"), WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "positions")


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector, cosine 0.95."""
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels of four of five id folds are learned."""
    held_out = crc_fold("doc_id", 5) == 0
    rows = table(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"))
    scored = toxicity.score(rows, table(spark, folder, "labels"), ~held_out)
    return scored.select(
        "doc_id", "held_out", F.col("toxicity").alias("score"), F.col("is_toxic").alias("predicted")
    )


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests read back from the formatted windows of every conversation, and of one planted."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    planted = spark.sql(f"SELECT -1L conv_id, 0L turn, 'user' role, {said} text UNION ALL SELECT -1L, 1L, 'assistant', {said}")
    return chat.digest(chat.windows(rows.unionByName(planted)))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; learned from three of four id folds."""
    documents = table(spark, folder, "documents")
    held_out = crc_fold("doc_id", 4) == 2
    model = language.fit(documents, ~held_out)
    rows = documents.select("doc_id", held_out.alias("held_out"), "text")
    return language.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Group and number of links of every document: word 5-grams, Jaccard 0.8."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.similar_groups(docs).drop("text")


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after ten rounds with eight centroids."""
    found = centroids.cluster(table(spark, folder, "embeddings"))
    sums = found.vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()
    total = sum(int(row["n"]) for row in sums)
    ends = [
        (row["cluster"], int(row["n"]), hashlib.sha256(",".join(map(str, found.centroids[row["cluster"]])).encode()).hexdigest())
        for row in sums
    ]
    # At most as many rows as there are centroids.
    clusters = spark.createDataFrame(ends, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return found.vectors.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("bigint").alias("inertia"), "centroid_sha256"
    )


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of every document under a byte-level and a piece vocabulary."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found, _ = alignment.align(documents, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


def op13_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document from its lines; labels of three of four id folds are learned."""
    documents = table(spark, folder, "documents")
    held_out = crc_fold("doc_id", 4) == 2
    model = line_quality.fit(documents, table(spark, folder, "labels"), ~held_out)
    scored = line_quality.score(documents.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select(
        "doc_id", "held_out", F.col("quality").alias("score"), F.col("is_good").alias("predicted"),
        F.size("bad_lines").alias("n_bad_lines"),
    )


def _centroid_sql(k: int = 8, rounds: int = 10) -> str:
    """The same rounds as plain sums over all vectors and centroids."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, "
        "lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, p) - 1 AS k, p FROM (SELECT sha256('3:' || vec_id) AS h, p "
        f"FROM kept ORDER BY h, p LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'k': k}}) AS near FROM (SELECT r, k, list_sum(list_transform("
            f"list_zip(kept.p, c{n}.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{n}) GROUP BY r)"
        )
        if n < rounds:
            steps.append(
                f"s{n} AS MATERIALIZED (SELECT k, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS p FROM (SELECT near.k AS k, i, "
                f"CAST(sum(x) AS DOUBLE) AS s, count(*) AS n FROM (SELECT near, unnest(p) AS x, generate_subscripts(p, 1) AS i "
                f"FROM a{n} JOIN kept USING (r)) GROUP BY near.k, i) GROUP BY k)"
            )
            steps.append(
                f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(s{n}.p, c{n}.p) AS p FROM c{n} LEFT JOIN s{n} USING (k))"
            )
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(near.k AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance, "
        f"CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c{rounds}.p, ',')) AS centroid_sha256 "
        f"FROM {last} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.k = near.k"
    )


def queries() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_packing": op2_packing,
        "op3_licences": op3_licences,
        "op4_mixing": op4_mixing,
        "op5_neighbours": op5_neighbours,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_chat_format": op8_chat_format,
        "op9_language_id": op9_language_id,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_centroids": op11_centroids,
        "op12_alignment": op12_alignment,
        "op13_line_quality": op13_line_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_centroids": _centroid_sql()}
