"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm import collocations, decontaminate, exact, lines, negatives, ngrams, packing, sharding, simhash, substrings, toxicity, vectornear, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(body):
        QUERIES[name] = body
        if sql:
            ORACLES[name] = sql
        return body

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    """The rank file of the 50k byte-level vocabulary; its ids are those of ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query(
    "op1_warc",
    """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS first FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
      CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to FROM d""",
)
def op1(spark, folder):
    back = warc.archive_pages(table(spark, folder, "pages"))
    return back.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op2_packing")
def op2(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary())


@query(
    "op3_exact_dedup",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)""",
)
def op3(spark, folder):
    return exact.exact_groups(table(spark, folder, "documents"))


def toxic_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.learn(docs, labels, training=toxicity.fold(F.col("doc_id"), 3) != 1)


@query("op5_toxicity")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxic_model(docs, table(spark, folder, "labels")))
    held = F.coalesce(toxicity.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


WORDS_4 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op4_decontaminate",
    f"""WITH d AS (SELECT doc_id, {WORDS_4} AS w FROM documents),
    i AS (SELECT item_id, {WORDS_4} AS w FROM benchmark),
    g AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, unnest(CASE WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 11), lambda s: array_to_string(w[s:s + 12], ' ')) END) AS gram FROM i WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT k FROM g),
    starts AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda s: {{'s': s, 'gram': array_to_string(w[s:s + k - 1], ' ')}})) AS x
      FROM d, sizes WHERE len(w) >= k),
    found AS (SELECT doc_id, starts.k, x.s AS s, item_id FROM starts JOIN g ON starts.k = g.k AND x.gram = g.gram),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM found)) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op4(spark, folder):
    hits = decontaminate.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    names = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), "contaminated")


@query("op6_lm_scoring")
def op6(spark, folder):
    held = F.coalesce(toxicity.fold(F.col("doc_id"), 5) == 1, F.lit(False))
    scored = ngrams.lm_scores(table(spark, folder, "documents"), ~held, least=1)  # statistics of all n-grams
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op7_substring_dedup",
    """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda s: {'s': s, 'gram': array_to_string(w[s:s + 19], ' ')})) AS x FROM d WHERE len(w) >= 20),
    late AS (SELECT doc_id, x.s AS s FROM starts QUALIFY row_number() OVER (PARTITION BY x.gram ORDER BY doc_id, x.s) > 1),
    gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM late) GROUP BY doc_id),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
    dropped AS (SELECT doc_id, unnest(ps) AS p FROM gone),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN dropped USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)""",
)
def op7(spark, folder):
    return substrings.remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op8_line_dedup",
    """WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    e AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM d),
    shared AS (SELECT trim(line) AS k FROM e WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 5),
    m AS (SELECT doc_id, line, p, k IS NOT NULL AS gone FROM e LEFT JOIN shared ON trim(line) = k),
    r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
    SELECT doc_id, n_lines, n_removed, (octet_length(encode(t)) - octet_length(encode(kept)))::BIGINT AS removed_bytes, sha256(kept) AS kept_sha256 FROM r JOIN d USING (doc_id)""",
)
def op8(spark, folder):
    return lines.drop_shared_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "removed_bytes", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_simhash")
def op9(spark, folder):
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query("op10_sharding")
def op10(spark, folder):
    body = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    placed = sharding.shard_rows(rows, ["doc_id", "text_crc32", "size"], shards=40, seed=42)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op11_collocations",
    """WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM d),
    n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda s: array_to_string(w[s:s + k - 1], ' '))) AS phrase FROM p, range(1, 6) AS r(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT * FROM f WHERE k >= 2 AND NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = f.lang AND x.k > f.k AND x.c >= f.c AND contains(' ' || x.phrase || ' ', ' ' || f.phrase || ' '))),
    s AS (SELECT c.lang, c.phrase, c.c AS a, unnest(range(1, c.k)) AS j, string_split(c.phrase, ' ') AS w FROM c),
    cuts AS (SELECT s.lang, s.phrase, a, j, x.c AS l, y.c AS r, n::BIGINT AS n, (1000::HUGEINT * a * n // (x.c::HUGEINT * y.c))::BIGINT AS score FROM s JOIN n USING (lang)
      JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
    low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low QUALIFY rank <= 2000""",
)
def op11(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


@query(
    "op12_vector_near",
    """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding) AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.least, e.vec_id) AS component_id, e.vec_id = coalesce(c.least, e.vec_id) AS kept
    FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
)
def op12(spark, folder):
    return vectornear.near_vectors(table(spark, folder, "embeddings"))


@query(
    "op13_hard_negatives",
    """WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY rank <= 3""",
)
def op13(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), anchor=F.col("vec_id") % 50 == 0)
