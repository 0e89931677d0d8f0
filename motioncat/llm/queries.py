"""Registered queries of the operators in this folder, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncat.llm import bpe_tree, embed_dedup, frames, html_extract, packing, pair_index, pii, quality, resample, simhash, token_counts, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


ORACLE["op6_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

ORACLE["op7_embed_dedup"] = """
WITH RECURSIVE p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
  walk AS (SELECT vec_id AS root, vec_id AS id FROM p UNION SELECT w.root, n.b FROM walk w JOIN near n ON n.a = w.id),
  c AS (SELECT id, min(root) AS component_id FROM walk GROUP BY id), k AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT p.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, p.vec_id = c.component_id AS kept
FROM p JOIN c ON c.id = p.vec_id LEFT JOIN k ON k.a = p.vec_id"""

ORACLE["op11_fill_in_middle"] = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS h FROM documents),
  d AS (SELECT *, len(units) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM u),
  f AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
  p AS (SELECT *, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM p"""

ORACLE["op12_resample"] = """
WITH w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
    UNION ALL SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
  f AS (SELECT side, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
  k AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
  step AS (SELECT list(list_reduce(range(0, 9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, byte) ORDER BY byte) AS t FROM range(0, 256) r(byte)),
  x AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM k)),
  b AS (SELECT feature, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
    lambda c, byte: xor(t[xor(c & 255, byte) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM x, step),
  kb AS (SELECT k.side, k.id, k.n, b.bucket FROM k JOIN b USING (feature)),
  c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM kb GROUP BY bucket),
  z AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
  g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM c, z),
  m AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM kb JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
  d AS (SELECT w.id AS doc_id, len(words) >= 20 AS long_enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || w.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN m USING (id) WHERE side = 0),
  r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM d WHERE long_enough)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * r.n // 100 THEN place END AS rank FROM d LEFT JOIN r USING (doc_id)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    texts = html_extract.extract(table(spark, sf, "pages"), carry=("url",))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query
def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    def digest(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


@query
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"))


@query
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit_quality(docs, quality.grades(table(spark, sf, "labels")))
    return quality.rate_quality(docs, model)


@query
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


@query
def op6_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query
def op7_embed_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf, "embeddings"))


@query
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf, "documents"))
    return groups.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit_toxicity(docs, toxicity.severities(table(spark, sf, "labels")))
    return toxicity.rate_toxicity(docs, model)


@query
def op10_bpe_tree(spark: SparkSession, sf: str) -> DataFrame:
    coded = bpe_tree.encode_texts(table(spark, sf, "documents"), decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    moved = frames.fill_in_middle(frames.store_frames(table(spark, sf, "documents")))
    return frames.restore_texts(moved, keep=("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"))


@query
def op12_resample(spark: SparkSession, sf: str) -> DataFrame:
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_pair_index(spark: SparkSession, sf: str) -> DataFrame:
    coded = pair_index.encode_texts(table(spark, sf, "documents"), decode=True)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
