"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import bpe, centroids, language, merkle, minhash, mixing, packing, pii, prefixes, quality, toxicity, vectors, warc
from pairlens.llm.common import held_out, read, settle

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Not a secret of anyone: a deployment passes its own.
SURROGATE_KEY = "surrogates of the registered query"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every token piece of every document in packed sequences."""
    cut = packing.pieces(read(spark, folder, "documents"), TOKENIZER)
    narrow = settle(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "packing-pieces")
    return packing.place(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op7_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    groups = minhash.near_duplicates(read(spark, folder, "documents"), 3, Fraction(85, 100))
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_streaming_transducer(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every document."""
    coded = bpe.encode(read(spark, folder, "documents").select("doc_id", "text"), TOKENIZER, decoded="decoded")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    documents = read(spark, folder, "documents")
    model = language.fit(language.learnable(documents, held_out("doc_id", 3, 1)))
    return language.identify(documents, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query
def op3_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    rows = merkle.with_next(read(spark, folder, "documents")).withColumn("n_chars", F.length("text").cast("long"))
    edited = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))"))
    digested = edited.withColumn("edited_sha256", F.sha2("edited", 256))
    marked = merkle.fingerprint(digested, {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": "next_fingerprint"})
    compared = merkle.likeness(marked, {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")})
    return compared.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op9_seekable_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages as WARC records into seekable bundles, and read them back."""
    archives = warc.archive_folder(spark)
    index = warc.write(warc.classify(read(spark, folder, "pages")), archives)
    records = warc.read(index, archives)
    own = F.col("payload").isNotNull()
    return records.select(
        "page_id",
        F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLES["op9_seekable_bundles"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages),
keep AS (SELECT html, max(page_id) AS top FROM p WHERE size >= 1000 GROUP BY html)
SELECT page_id, size AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN keep USING (html)
"""


@query
def op1_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    documents = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, read(spark, folder, "labels").where(~held_out("doc_id", 5, 0)))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_hierarchical_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Quality posterior of every document, with those of its path and host."""
    judged = quality.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return judged.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", "posterior", "rejected")


@query
def op6_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with personal data replaced by surrogates."""
    return pii.replace(read(spark, folder, "documents"), SURROGATE_KEY)


@query
def op8_subspace_pigeonhole(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings of equal label."""
    return vectors.near_vectors(read(spark, folder, "embeddings"), 0.98)


@query
def op11_count_min_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    return prefixes.trie(read(spark, folder, "conversations"))


ORACLES["op11_count_min_trie"] = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT k.conv_id, k.conv_id - k.conv_id % 20 AS base, coalesce(b.n, 0) AS n_base,
    xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(k.conv_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))),
      lambda a, d: list_reduce(list_concat([xor(a, d)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 4 AS lead
  FROM counts k LEFT JOIN counts b ON b.conv_id = k.conv_id - k.conv_id % 20),
r AS (SELECT c.conv_id, own AS depth, role, text FROM c JOIN t ON t.conv_id = c.base WHERE own <= lead
  UNION ALL SELECT c.conv_id, own - lead + least(lead, n_base), role, text FROM c JOIN t USING (conv_id) WHERE own > lead),
p AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, max(depth) OVER (PARTITION BY conv_id) AS size,
    string_agg('/' || md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT c.conv_id, 0, 0, coalesce(s.size, 0), '' FROM c LEFT JOIN (SELECT conv_id, max(depth) AS size FROM r GROUP BY conv_id) s USING (conv_id)),
n AS MATERIALIZED (SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = size), '')) AS ends_sha256 FROM p GROUP BY path),
f AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM n AS k WHERE k.depth = n.depth + 1 AND left(k.path, length(n.path)) = n.path) AS n_children FROM n)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f LEFT JOIN f AS up ON f.depth > 0 AND up.path = left(f.path, length(f.path) - 33)
JOIN (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens
  FROM f AS a JOIN f AS b ON b.depth >= a.depth AND left(b.path, length(a.path)) = a.path GROUP BY a.path) s ON s.path = f.path
"""


@query
def op12_jvm_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every embedding after five rounds from forty hashed starts."""
    clustered = centroids.cluster(read(spark, folder, "embeddings"))
    return clustered.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after another, on a row per vector and component."""
    steps = [
        """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (SELECT rid, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) AS r(i)),"""
        f"""
start AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT cluster, i, x FROM start JOIN parts USING (rid)),"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""
d{n} AS (SELECT rid, cluster, sum((p.x - c.x) * (p.x - c.x)) AS distance FROM parts p JOIN c{n} c USING (i) GROUP BY rid, cluster),
a{n} AS MATERIALIZED (SELECT rid, cluster, distance FROM d{n} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1),""")
        if n < rounds:
            steps.append(f"""
m{n} AS (SELECT cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM a{n} JOIN parts USING (rid) GROUP BY cluster, i),
c{n + 1} AS MATERIALIZED (SELECT cluster, i, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (cluster, i)),""")
    steps.append(f"""
named AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN named USING (cluster)
""")
    return "".join(steps)


ORACLES["op12_jvm_centroids"] = _centroid_sql()


@query
def op13_entropy_balancing(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document in a mix whose sources have target shares."""
    return mixing.mix(read(spark, folder, "documents"))
