"""The queries of this subpackage over the given tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import (
    centroids,
    decontamination,
    embedding_dedup,
    language,
    packing,
    prefix_trie,
    sharding,
    simhash_dedup,
    suffix_dedup,
    token_counts,
    token_files,
    tool_calls,
    toxicity,
)
from lorekeep.llm.ship import ship
from lorekeep.llm.tokens import tokenizer_path
from lorekeep.sources.shared import new_table_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"))


def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_texts(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_texts(table(spark, folder, "documents"), 8)


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table_path(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), path, tokenizer_path("word_bpe_49k.json"), 2)
    return token_files.digests(token_files.read_tokens(spark, path))


#: The tools of the derived calls, with the type of each argument and whether it is required.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "translate": {"query": ("string", True), "limit": ("number", False)},
}

#: Calls and results that the conversations stand for: each user turn calls a
#: tool and needs two earlier ones; each assistant turn answers the turn before.
#: Some calls lack an argument, have one of the wrong type or one too many.
CALLS = """
    SELECT conv_id, turn, concat('call-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS call_id,
           CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE 'other' END AS name,
           CASE WHEN length(text) % 11 = 0 THEN '{{"limit": 3}}'
                WHEN length(text) % 7 = 0 THEN to_json(named_struct('query', text, 'limit', 'few', 'a', true))
                ELSE to_json(named_struct('query', text, 'limit', length(text) % 5)) END AS arguments,
           CASE WHEN turn > 0 THEN array(concat('call-', CAST(conv_id AS STRING), '-', CAST(turn DIV 2 AS STRING)),
                                         concat('call-', CAST(conv_id AS STRING), '-', CAST(turn DIV 3 AS STRING)))
                ELSE CAST(array() AS array<string>) END AS depends_on
    FROM {conversations} WHERE role = 'user'"""
RESULTS = """
    SELECT concat('call-', CAST(conv_id AS STRING), '-', CAST(turn - 1 AS STRING)) AS call_id, turn, text AS content
    FROM {conversations} WHERE role = 'assistant'"""


def op6_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    calls, results = (spark.sql(sql, conversations=conversations) for sql in (CALLS, RESULTS))
    found = tool_calls.linked_calls(calls, results, TOOLS)
    return found.select(
        "conv_id", "turn", "call_id", "level", "place", F.array_join("errors", ",").alias("errors"), "linked",
        F.octet_length("line").cast("long").alias("line_bytes"), F.sha2("line", 256).alias("line_sha256"),
    )


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontamination.digests(found)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, folder, "documents"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.with_digests(*centroids.clusters(table(spark, folder, "embeddings")))


QUERIES: dict[str, Query] = {
    run.__name__: run
    for run in (
        op1_embedding_dedup,
        op2_simhash_dedup,
        op3_toxicity,
        op4_sharding,
        op5_token_files,
        op6_tool_calls,
        op7_decontamination,
        op8_token_counts,
        op9_packing,
        op10_language,
        op11_prefix_trie,
        op12_suffix_dedup,
        op13_centroids,
    )
}



def _centroids_check(rounds: int = 3) -> str:
    """Check SQL of the clustering: a step for each round over a row per vector and component."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""distances{i} AS (
            SELECT p.r, c.cluster, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS distance
            FROM parts AS p JOIN centroids{i} AS c ON p.i = c.i GROUP BY p.r, c.cluster
        ), assigned{i} AS (
            SELECT r, arg_min(cluster, distance * 1000 + cluster) AS cluster, min(distance) AS distance
            FROM distances{i} GROUP BY r
        )""")
        if i < rounds:
            steps.append(f"""means{i} AS (
            SELECT a.cluster, p.i, CAST(sum(p.x) AS BIGINT) AS total, count(*) AS n
            FROM assigned{i} AS a JOIN parts AS p ON a.r = p.r GROUP BY a.cluster, p.i
        ), centroids{i + 1} AS (
            SELECT c.cluster, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.total - ((m.total % m.n) + m.n) % m.n) // m.n END AS x
            FROM centroids{i} AS c LEFT JOIN means{i} AS m ON c.cluster = m.cluster AND c.i = m.i
        )""")
    return f"""
        WITH kept AS (
            SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT r, i, CAST(floor(64 * v[i]) AS BIGINT) AS x FROM (SELECT r, v, unnest(range(1, 65)) AS i FROM kept)
        ), firsts AS (
            SELECT r, row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), v) - 1 AS cluster FROM kept WHERE vec_id IS NOT NULL
            QUALIFY cluster < 16
        ), centroids0 AS (
            SELECT f.cluster, p.i, p.x FROM firsts AS f JOIN parts AS p ON f.r = p.r
        ), {", ".join(steps)}, digests AS (
            SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256
            FROM centroids{rounds} GROUP BY cluster
        )
        SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance,
               CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, d.centroid_sha256
        FROM assigned{rounds} AS a JOIN kept AS k ON a.r = k.r JOIN digests AS d ON a.cluster = d.cluster"""


#: Check SQL of those that a second engine can express.
CHECKS: dict[str, str] = {
    "op1_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
                   label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
            FROM embeddings
        ), links AS (
            SELECT a.vec_id AS one, b.vec_id AS other
            FROM vectors AS a JOIN vectors AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.usable AND b.usable
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98
        ), reached AS (
            SELECT vec_id AS one, vec_id AS other FROM vectors
            UNION
            SELECT r.one, l.other FROM reached AS r JOIN links AS l ON r.other = l.one
        ), components AS (
            SELECT one, min(other) AS component_id FROM reached GROUP BY one
        ), counts AS (
            SELECT one, count(*) AS n FROM links GROUP BY one
        )
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM vectors AS v JOIN components AS c ON v.vec_id = c.one LEFT JOIN counts AS n ON v.vec_id = n.one""",
    "op6_tool_calls": """
        WITH RECURSIVE calls AS (
            SELECT conv_id, turn, concat('call-', conv_id, '-', turn) AS call_id,
                   CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE 'other' END AS name,
                   CASE WHEN length(text) % 11 = 0 THEN '{"limit":3}'
                        WHEN length(text) % 7 = 0
                        THEN concat('{"a":true,"limit":"few","query":', CAST(to_json(text) AS VARCHAR), '}')
                        ELSE concat('{"limit":', length(text) % 5, ',"query":', CAST(to_json(text) AS VARCHAR), '}')
                   END AS arguments,
                   CASE WHEN length(text) % 11 = 0 THEN 'missing query'
                        WHEN length(text) % 7 = 0 THEN 'type of limit,unexpected a' ELSE '' END AS wrong
            FROM conversations WHERE role = 'user'
        ), needs AS (
            SELECT c.call_id, d.call_id AS needed
            FROM calls AS c JOIN calls AS d
              ON c.conv_id = d.conv_id AND c.turn > 0 AND d.turn IN (c.turn // 2, c.turn // 3)
        ), depths AS (
            SELECT call_id, 0 AS level FROM calls
            UNION
            SELECT n.call_id, d.level + 1 FROM depths AS d JOIN needs AS n ON d.call_id = n.needed
        ), ranked AS (
            SELECT call_id, max(level) AS level FROM depths GROUP BY call_id
        ), lines AS (
            SELECT c.conv_id, c.turn, c.call_id, CAST(r.level AS INTEGER) AS level,
                   row_number() OVER (PARTITION BY c.conv_id ORDER BY r.level, c.turn) - 1 AS place,
                   CASE WHEN c.name = 'other' THEN 'unknown tool' ELSE c.wrong END AS errors,
                   a.turn IS NOT NULL AS linked,
                   concat('{"arguments":', c.arguments, ',"id":"', c.call_id, '","name":"', c.name, '","result":',
                          coalesce(CAST(to_json(a.text) AS VARCHAR), 'null'), '}') AS line
            FROM calls AS c JOIN ranked AS r ON c.call_id = r.call_id
            LEFT JOIN conversations AS a ON a.role = 'assistant' AND a.conv_id = c.conv_id AND a.turn = c.turn + 1
        )
        SELECT conv_id, turn, call_id, level, place, errors, linked,
               CAST(strlen(line) AS BIGINT) AS line_bytes, sha256(line) AS line_sha256
        FROM lines""",
    "op11_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS spot
            FROM conversations WHERE conv_id IS NOT NULL
        ), bytes AS (
            -- CRC-32, bit by bit, of the decimal id.
            SELECT conv_id, list_transform(range(8 * length(CAST(conv_id AS VARCHAR))), lambda i:
                       CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1))
                            ELSE 0 END) AS steps
            FROM (SELECT DISTINCT conv_id FROM turns)
        ), taken AS (
            SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(steps, lambda s: CAST(s AS BIGINT))),
                       lambda c, s: CASE WHEN xor(c, s) % 2 = 1 THEN xor(xor(c, s) >> 1, 3988292384)
                                         ELSE xor(c, s) >> 1 END), 4294967295) % 9 AS h
            FROM bytes
        ), rebuilt AS (
            SELECT c.conv_id, t.spot, 0 AS own, t.role, t.text
            FROM taken AS c JOIN turns AS t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.spot <= c.h
            UNION ALL
            SELECT c.conv_id, t.spot, 1, t.role, t.text
            FROM taken AS c JOIN turns AS t ON t.conv_id = c.conv_id AND t.spot > c.h
        ), chained AS (
            SELECT conv_id, row_number() OVER turns AS depth, strlen(text) AS n,
                   string_agg(md5(concat(strlen(role), ':', role, text)), '') OVER turns AS path
            FROM rebuilt WINDOW turns AS (PARTITION BY conv_id ORDER BY own, spot ROWS UNBOUNDED PRECEDING)
        ), members AS (
            SELECT conv_id, depth, n, md5(path) AS node,
                   coalesce(md5(lag(path) OVER (PARTITION BY conv_id ORDER BY depth)), 'root') AS parent
            FROM chained
            UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM taken
        ), ends AS (
            SELECT t.conv_id, arg_max(m.node, m.depth) AS node FROM taken AS t JOIN members AS m ON t.conv_id = m.conv_id
            GROUP BY t.conv_id
        ), digests AS (
            SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM ends GROUP BY node
        ), nodes AS (
            SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth,
                   count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved
            FROM members GROUP BY node
        ), children AS (
            SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
        ), above AS (
            -- A node and each node on its way to the root.
            SELECT DISTINCT m.node, a.node AS top
            FROM members AS m JOIN members AS a ON a.conv_id = m.conv_id AND a.depth <= m.depth
        ), sums AS (
            SELECT a.top AS node, CAST(sum(n.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (c.n IS NULL) AS n_leaves
            FROM above AS a JOIN nodes AS n ON a.node = n.node LEFT JOIN children AS c ON c.node = n.node GROUP BY a.top
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
               s.n_leaves, s.saved_tokens, coalesce(d.digest, sha256('')) AS ends_sha256
        FROM nodes AS n JOIN sums AS s ON s.node = n.node LEFT JOIN nodes AS p ON p.node = n.parent
        LEFT JOIN children AS c ON c.node = n.node LEFT JOIN digests AS d ON d.node = n.node""",
    "op12_suffix_dedup": """
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
        ), starts AS (
            SELECT r, unnest(range(octet_length(b) - 399)) AS spot FROM texts WHERE octet_length(b) >= 400
        ), strings AS (
            SELECT s.r, s.spot, md5(b[s.spot + 1 : s.spot + 400]) AS d FROM starts AS s JOIN texts AS t ON s.r = t.r
        ), repeated AS (
            SELECT r, spot FROM strings WHERE d IN (SELECT d FROM strings GROUP BY d HAVING count(*) > 1)
        ), marked AS (
            SELECT r, spot, coalesce(spot > lag(spot) OVER (PARTITION BY r ORDER BY spot) + 400, true) AS new FROM repeated
        ), numbered AS (
            SELECT r, spot, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY spot) AS run FROM marked
        ), runs AS (
            SELECT r, min(spot) AS low, max(spot) + 400 AS high FROM numbered GROUP BY r, run
        ), sides AS (
            SELECT r, high AS low, lead(low) OVER (PARTITION BY r ORDER BY low) AS high FROM runs
            UNION ALL SELECT r, 0, min(low) FROM runs GROUP BY r
        ), parts AS (
            SELECT s.r, unhex(string_agg(hex(b[s.low + 1 : coalesce(s.high, octet_length(b))]), '' ORDER BY s.low)) AS kept
            FROM sides AS s JOIN texts AS t ON s.r = t.r GROUP BY s.r
        ), sums AS (
            SELECT r, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
        )
        SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(coalesce(kept, b)) AS kept_sha256
        FROM texts AS t LEFT JOIN sums AS s ON t.r = s.r LEFT JOIN parts AS p ON t.r = p.r""",
    "op13_centroids": _centroids_check(),
}
