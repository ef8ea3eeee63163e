"""The registered queries of this subpackage and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentispark.llm import byte_bpe, chat_format, cotrain, decontaminate, html_text, jaccard_join, mtree, prefix_trie, sharding, suffix_dedup, token_counts, walsh, warc
from sentispark.llm.common import written
from sentispark.session import fresh_dir, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Rows with long texts: smaller batches keep the tasks' memory bounded.
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
            return build(use_utc(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(_file("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        F.col("id").alias("doc_id"),
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(
        _table(spark, folder, "documents"), "json", _file("byte_bpe_50k.json"), fresh_dir(spark, "token-cache")
    )
    return counts.withColumnRenamed("id", "doc_id")


@query(
    "op9_ngram_jaccard",
    """
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
    b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    r AS (SELECT u AS id, u AS c FROM b UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
    FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) ON id = doc_id
    """,
)
def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.near_duplicates(_table(spark, folder, "documents"), words=5, percent=75)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query(
    "op8_suffix_array_dedup",
    """
    WITH t AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
    -- In pieces first, as a substring is sought from the start of its string.
    q AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2098) AS piece FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1000)) AS o FROM t)),
    g AS (SELECT doc_id, o + p AS p, substr(piece, 2 * p + 1, 100) AS s
      FROM (SELECT *, unnest(range(0, least(1000, len(piece) // 2 - 49))) AS p FROM q)),
    f AS (SELECT s, min(doc_id) AS d FROM g GROUP BY 1),
    m AS (SELECT doc_id, p FROM g JOIN f USING (s) WHERE d < doc_id),
    i AS (SELECT doc_id, p, CAST(p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -51) + 50 AS INT) AS b FROM m),
    k AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM i) GROUP BY doc_id, r),
    x AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM k),
    c AS (SELECT doc_id, sum(z - a) AS n, count(*) AS spans, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS left_over
      FROM x JOIN t USING (doc_id) GROUP BY 1)
    SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
    FROM t LEFT JOIN c USING (doc_id)
    """,
)
def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, folder, "documents"), span=50)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.floor(F.octet_length("spans") / 16).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op1_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, p.payload_digest,
           CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
    """,
)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.write(_table(spark, folder, "pages"), fresh_dir(spark, "warc"), least=100)
    return warc.lookup(spark, index).select(
        F.col("id").alias("page_id"),
        F.col("length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").alias("refers_to"),
    )


@query(
    "op6_chat_format",
    """
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    e AS (SELECT *, replace(replace(replace(replace(text, '\\', '\\b'), '#', '\\h'), '<', '\\l'), ':', '\\c') AS escaped,
          replace(replace(replace(replace(role, '\\', '\\b'), '#', '\\h'), '<', '\\l'), ':', '\\c') AS name FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('### ' || name || ': ' || escaped || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
           -- The roles drive the automaton; a role it does not expect leads nowhere.
           coalesce(list_reduce(list(role ORDER BY turn NULLS FIRST, role, text), lambda state, role: CASE
             WHEN state IN ('start', 'system', 'assistant') AND role = 'user' THEN 'user'
             WHEN state = 'start' AND role = 'system' THEN 'system'
             WHEN state = 'user' AND role = 'assistant' THEN 'assistant' END, 'start') IN ('assistant', 'user'), false) AS valid
    FROM e WHERE conv_id IS NOT NULL GROUP BY conv_id
    """,
)
def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    tricky = F.lit("\\### Assistant: </turn> ok").alias("text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky
    )
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    template = chat_format.Template()
    done = chat_format.read_back(chat_format.format_chats(rows, template), template)
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return done.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


@query(
    "op7_mtree_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    -- Rows that repeat a query's id are one query, with the smallest of their vectors.
    q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op7_mtree_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    found = mtree.top_k(mtree.build_index(vectors), vectors.where("vec_id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op5_html_blocks")
def op5_html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract(_table(spark, folder, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance")


@query("op4_cotraining")
def op4_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    scored = cotrain.score(docs, cotrain.train(docs, _table(spark, folder, "labels")))
    return scored.select("doc_id", "quality_p", "toxic_p", "score", cotrain.accepted().alias("keep"))


def _centroid_rounds(rounds: int) -> str:
    """CTEs of the rounds: a<k> assigns every vector to the centroids c<k>, which move to make c<k + 1>."""
    parts = []
    for k in range(rounds + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (SELECT rn, cluster, d FROM (SELECT rn, number AS cluster, d, row_number() OVER (PARTITION BY rn ORDER BY d, number) AS best
              FROM (SELECT rn, number, CAST(list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c) AS BIGINT) AS d FROM v, c{k}))
              WHERE best = 1)"""
        )
        if k < rounds:
            parts.append(
                f"""m{k} AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, floor(sum(e[i]) / count(*)) AS m
                  FROM a{k} JOIN v USING (rn), (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i) GROUP BY cluster),
                c{k + 1} AS MATERIALIZED (SELECT number, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m ON cluster = number)"""
            )
    return ",\n".join(parts)


@query(
    "op11_walsh_clusters",
    f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS number, e AS c FROM v
      QUALIFY number < 16),
    {_centroid_rounds(3)},
    s AS (SELECT number, sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS digest FROM c3)
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
    FROM a3 JOIN v USING (rn) JOIN s ON number = cluster
    """,
)
def op11_walsh_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found, centroids = walsh.cluster(_table(spark, folder, "embeddings"), clusters=16, rounds=3, size=64, scale=64, seed=1)
    return walsh.with_inertia(found, centroids).withColumnRenamed("id", "vec_id")


#: CRC-32 of a short ASCII string, a bit at a time.
_CRC_OF_DIGITS = """xor(4294967295, list_reduce(list_transform(range(1, len({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT)),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295))"""


@query(
    "op12_prefix_trie",
    f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, s, {_CRC_OF_DIGITS.format('s')} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
    r AS (SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p < h
      UNION ALL SELECT conv_id, p, role, text FROM c JOIN t USING (conv_id) WHERE p >= h),
    q AS (SELECT conv_id, list(sha256(sha256(role) || text) ORDER BY p) AS turns, list(len(text) ORDER BY p) AS sizes FROM r GROUP BY conv_id
      UNION ALL SELECT conv_id, [], [] FROM c WHERE conv_id NOT IN (SELECT conv_id FROM r)),
    n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends
      FROM (SELECT *, array_to_string(turns[:d], ',') AS node, coalesce(sizes[d], 0) AS size
        FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM q)) GROUP BY node, d),
    k AS (SELECT n.*, CASE WHEN d > 0 THEN substr(node, 1, 65 * d - 66) END AS above FROM n),
    f AS (SELECT above AS node, count(*) AS n_children FROM k WHERE d > 0 GROUP BY above),
    a AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN f USING (node)),
    u AS (SELECT *, CASE WHEN o = 0 THEN '' ELSE substr(node, 1, 65 * o - 1) END AS top FROM (SELECT *, unnest(range(0, d + 1)) AS o FROM a)),
    z AS (SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens FROM u GROUP BY top)
    SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, a.ends AS ends_sha256
    FROM a JOIN z USING (node) LEFT JOIN k p ON p.node = a.above
    """,
)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    said = written(prefix_trie.sequences(_table(spark, folder, "conversations")), "conversations")
    return prefix_trie.build_trie(prefix_trie.grafted(said, group=100, most=6))


@query(
    "op13_sharding",
    """
    WITH d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, hex(coalesce(text, '')) AS h,
        md5('shards:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
    -- CRC-32 half a byte at a time, the low half first.
    c AS (SELECT * EXCLUDE (h), xor(4294967295, list_reduce(
        list_transform(range(0, len(h)), lambda i: strpos('123456789ABCDEF', h[xor(i, 1) + 1])),
        lambda c, b: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
          3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, b) & 15) + 1]), 4294967295)) AS text_crc32 FROM d),
    r AS (SELECT *, (2 * row_number() OVER s - 1) / (2 * count(*) OVER (PARTITION BY source)) AS share, row_number() OVER s AS rank FROM c
      WINDOW s AS (PARTITION BY source ORDER BY draw, text_crc32, size)),
    p AS (SELECT *, row_number() OVER (ORDER BY share, source NULLS FIRST, rank) - 1 AS place, count(*) OVER () AS n FROM r),
    x AS (SELECT *, CAST(place * 16 // n AS INTEGER) AS shard FROM p)
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, shard, CAST(place - (shard * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM x
    """,
)
def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.interleave(_table(spark, folder, "documents"), shards=16)
    return dealt.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("checksum").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
