"""One query for each operator of the subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import documents, new_path, table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Any secret will do; every query of one corpus must use the same.
PII_KEY = "a key that the owner of the corpus keeps"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.pii import replace_pii

    return replace_pii(documents(spark, sf_dir), PII_KEY)


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.media import MediaStore

    return MediaStore.write(documents(spark, sf_dir)).features()


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.packing import pack_documents

    packed = pack_documents(documents(spark, sf_dir), vocabulary_path(), capacity=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.debruijn import substring_dedup

    return substring_dedup(documents(spark, sf_dir), width=20)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.jaccard import jaccard_classes

    return jaccard_classes(documents(spark, sf_dir), k=4, percent=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.suffixes import suffix_dedup

    return suffix_dedup(documents(spark, sf_dir), width=100)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.topk import exact_topk, scaled, usable

    vectors = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding"))).select("vec_id", scaled(F.col("embedding")).alias("v"))
    return exact_topk(vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), vectors, k=5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.toxicity import fit, score

    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.codec import Codec

    docs = documents(spark, sf_dir)
    return Codec(docs, vocabulary_path()).digests(docs)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.tokenfile import read_tokens, write_tokens

    target = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), vocabulary_path(), target, length=1024, end_id=0)
    return read_tokens(spark, target).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.sharding import sharded

    return sharded(documents(spark, sf_dir), shards=16)


def op12_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.align import align_documents

    return align_documents(documents(spark, sf_dir), vocabulary_path(), pieces_path(), digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnlake.llm.trie import prefix_trie

    nodes = prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_media_chunks, op3_best_fit_packing, op4_substring_dedup, op5_jaccard_join, op6_suffix_dedup, op7_exact_topk, op8_toxicity, op9_bpe_codec, op10_token_files, op11_external_shuffle, op12_segment_alignment, op13_prefix_trie)}

_WORDS = """w AS (
            SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS pos
            FROM (SELECT doc_id, list_filter(string_split_regex({text}, '[ \t-\r]+'), lambda y: y <> '') AS x FROM documents)
        )"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What SQL can express: windows of words, set overlaps, all inner products.
ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": f"""
        WITH {_WORDS.format(text="coalesce(text, '')")}, g AS (
            SELECT doc_id, pos, word, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS gram FROM w
            WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
        ), l AS (
            SELECT doc_id, pos, word, n = 20 AND row_number() OVER (PARTITION BY gram, n ORDER BY doc_id, pos) > 1 AS later FROM g
        ), r AS (
            SELECT doc_id, pos, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM l
        )
        SELECT d.doc_id, count(r.pos) AS n_words, count(*) FILTER (WHERE coalesce(gone, false)) AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id
    """,
    "op5_jaccard_join": f"""
        WITH RECURSIVE {_WORDS.format(text=_LOWER)}, g AS (
            SELECT doc_id, pos, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS gram FROM w
            WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
        ), s AS (
            SELECT DISTINCT doc_id, gram FROM g WHERE n = 4 OR pos = 1
        ), c AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), e AS (
            SELECT x, y FROM p JOIN c ca ON ca.doc_id = x JOIN c cb ON cb.doc_id = y WHERE 100 * p.n >= 85 * (ca.n + cb.n - p.n)
        ), both_ways AS (
            SELECT x, y FROM e UNION ALL SELECT y, x FROM e
        ), reach AS (
            SELECT x AS node, x AS other FROM both_ways UNION SELECT reach.node, b.y FROM reach JOIN both_ways b ON reach.other = b.x
        ), m AS (
            SELECT node, min(other) AS component_id FROM reach GROUP BY node
        ), l AS (
            SELECT x AS node, count(*) AS n FROM both_ways GROUP BY x
        )
        SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(l.n, 0) AS n_links
        FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id LEFT JOIN l ON l.node = d.doc_id
    """,
    "op7_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
        QUALIFY rank <= 5
    """,
    "op13_prefix_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
            ) AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base, n, xor(list_reduce(
                list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda y: CAST(ord(y) AS BIGINT)),
                lambda crc, y: list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, y)),
                CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h
            FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)
        ), b AS (
            SELECT c.*, least(c.h, coalesce(o.n, 0)) AS taken FROM c LEFT JOIN c o ON o.conv_id = c.base
        ), rebuilt AS (
            SELECT b.conv_id, t.i AS d, r, x FROM b JOIN t ON t.conv_id = b.base AND t.i <= b.taken
            UNION ALL
            SELECT b.conv_id, b.taken + t.i - b.h, r, x FROM b JOIN t ON t.conv_id = b.conv_id AND t.i > b.h
        ), path AS (
            SELECT conv_id, d, length(x) AS len, string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER (PARTITION BY conv_id ORDER BY d) AS p FROM rebuilt
            UNION ALL
            SELECT conv_id, 0, 0, '' FROM c
        ), step AS (
            SELECT *, lag(p) OVER w AS parent, lead(p) OVER w IS NULL AS last FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY d)
        ), node AS (
            SELECT p, any_value(parent) AS parent, any_value(d) AS depth, any_value(len) AS len, min(conv_id) AS conv_id, count(*) AS n,
                   string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last) AS ends
            FROM step GROUP BY p
        ), child AS (
            SELECT parent AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY parent
        ), below AS (
            SELECT s.p, sum((u.n - 1) * u.len) AS saved, count(*) FILTER (k.p IS NULL) AS leaves
            FROM node u JOIN step s ON s.conv_id = u.conv_id AND s.d <= u.depth LEFT JOIN child k ON k.p = u.p GROUP BY s.p
        )
        SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children,
               below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
        FROM node v JOIN below ON below.p = v.p LEFT JOIN child k ON k.p = v.p LEFT JOIN node o ON v.depth > 0 AND o.p = v.parent
    """,
}
