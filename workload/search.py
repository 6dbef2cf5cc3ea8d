"""Search, ranking and picking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrove.operators import search
from workload.common import query, read

# DuckDB restatement of the term rule on text without Hangul.
_TERMS = (
    r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z]+|\d+(?:[.,]\d+)*')"
)
_BM25 = f"""
WITH d AS (
  SELECT doc_id, {_TERMS.format('text')} AS terms FROM documents WHERE trim(text) <> ''
), st AS (SELECT count(*) AS n, sum(len(terms)) / greatest(1, count(*)) AS avg_len FROM d),
q AS (SELECT item_id, unnest(list_distinct({_TERMS.format('text')})) AS term FROM benchmark),
p AS (SELECT doc_id, len, term, count(*) AS tf
      FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (
  SELECT q.item_id AS query_id, p.doc_id AS source_id,
         sum(CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
             / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) * 1e12) AS BIGINT)) AS units
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN st GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, source_id) AS rank
  FROM s WHERE units > 0
)
"""


def _passages(spark, folder):
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _blocks(spark, folder):
    return read(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), "text")


@query(
    "bm25_topk",
    _BM25
    + """SELECT query_id, source_id, round(units / 1e12, 6) AS score,
                CAST(rank AS BIGINT) AS rank
         FROM r WHERE rank <= 20""",
)
def bm25_topk(spark, folder):
    """Every benchmark passage against every document, best 20 each."""
    hits = search.bm25(_passages(spark, folder), _blocks(spark, folder))
    return hits.select(
        "query_id",
        "source_id",
        F.round("score", 6).alias("score"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "term_stats",
    f"""
    WITH d AS (SELECT source, {_TERMS.format('text')} AS terms FROM documents WHERE trim(text) <> ''),
    st AS (SELECT source, count(*) AS n_blocks,
                  round(sum(len(terms)) / greatest(1, count(*)), 6) AS avg_len FROM d GROUP BY 1),
    f AS (SELECT source, term, count(*) AS df
          FROM (SELECT source, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL)
    SELECT source, term, df, n_blocks, avg_len FROM f JOIN st USING (source)
    """,
)
def term_stats(spark, folder):
    """Document frequency of every term per source."""
    blocks = read(spark, folder, "documents").select(
        "source", F.col("doc_id").alias("source_id"), "text"
    )
    return search.term_stats(blocks, ["source"]).withColumn("avg_len", F.round("avg_len", 6))


@query(
    "rrf_fusion",
    _BM25
    + """, hits AS (
      SELECT query_id, 'lexical' AS route, source_id, rank AS position FROM r WHERE rank <= 20
      UNION ALL
      SELECT item_id, 'length', doc_id, position FROM (
        SELECT b.item_id, d.doc_id, row_number() OVER (
                 PARTITION BY b.item_id ORDER BY d.doc_id) AS position
        FROM benchmark b JOIN documents d ON d.n_chars = length(b.text)) WHERE position <= 20
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY position, source_id) AS rr
      FROM hits
    )
    SELECT query_id, source_id,
           round(coalesce(max(CASE WHEN route = 'lexical' THEN 1.0 / (60 + rr) END), 0)
               + coalesce(max(CASE WHEN route = 'length' THEN 1.0 / (60 + rr) END), 0), 9) AS rrf
    FROM ranked GROUP BY ALL""",
)
def rrf_fusion(spark, folder):
    """Lexical route fused with a same-length route."""
    passages, blocks = _passages(spark, folder), _blocks(spark, folder)
    lexical = search.bm25(passages, blocks).select(
        "query_id", F.lit("lexical").alias("route"), "source_id", F.col("rank").alias("position")
    )
    docs = read(spark, folder, "documents")
    same = passages.join(docs, F.length(passages["text"]) == docs["n_chars"]).select(
        "query_id", F.col("doc_id").alias("source_id")
    )
    length = search.top_k(same, ["query_id"], ["source_id"], 20, "position").select(
        "query_id", F.lit("length").alias("route"), "source_id", "position"
    )
    fused = search.rrf(search.union_routes(lexical, length), ["lexical", "length"])
    return fused.withColumn("rrf", F.round("rrf", 9))


@query(
    "vector_topk",
    """
    WITH u AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    ), s AS (
      SELECT a.label, a.vec_id AS query_id, b.vec_id AS source_id,
             round(list_cosine_similarity(a.e, b.e), 9) AS score
      FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY label, query_id
                                   ORDER BY score DESC, source_id) AS rank FROM s
    )
    SELECT label, query_id, source_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20
    """,
)
def vector_topk(spark, folder):
    """Every vector against all vectors of its own label, best 20 each."""
    e = read(spark, folder, "embeddings")
    hits = search.vector_search(
        e.select("label", F.col("vec_id").alias("query_id"), "embedding"),
        e.select("label", F.col("vec_id").alias("source_id"), "embedding"),
        ["label"],
        exclude_self=True,
    )
    return hits.select(
        "label",
        "query_id",
        "source_id",
        F.round("score", 6).alias("score"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "budgeted_pick",
    """
    WITH RECURSIVE o AS (
      SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS size,
             row_number() OVER (PARTITION BY o_custkey
                                ORDER BY o_totalprice DESC, o_orderkey) AS rn
      FROM orders
    ), f AS (
      SELECT o_custkey, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n,
             CAST(0 AS BIGINT) AS used, '' AS picked
      FROM (SELECT DISTINCT o_custkey FROM orders)
      UNION ALL
      SELECT f.o_custkey, o.rn,
             f.n + CASE WHEN size <= 1600 AND used + size <= 12000 AND n < 12 THEN 1 ELSE 0 END,
             used + CASE WHEN size <= 1600 AND used + size <= 12000 AND n < 12
                         THEN size ELSE 0 END,
             picked || CASE WHEN size <= 1600 AND used + size <= 12000 AND n < 12
                            THEN ',' || o_orderkey ELSE '' END
      FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.rn = f.rn + 1
    ), last AS (
      SELECT o_custkey, max(rn) AS n_items, arg_max(n, rn) AS n, arg_max(used, rn) AS used,
             arg_max(picked, rn) AS picked FROM f GROUP BY 1
    )
    SELECT o_custkey, substr(picked, 2) AS picked, used, n_items, n_items - n AS n_omitted FROM last
    """,
)
def budgeted_pick(spark, folder):
    """Orders of each customer by price under the evidence budget."""
    orders = read(spark, folder, "orders").select(
        "o_custkey",
        "o_orderkey",
        (-F.col("o_totalprice")).alias("by_price"),
        F.floor(F.col("o_totalprice") / 100).alias("size"),
    )
    picked = search.budgeted_pick(
        orders, ["o_custkey"], ["by_price", "o_orderkey"], "o_orderkey", "size"
    )
    return picked.withColumn("picked", F.array_join("picked", ","))


@query(
    "packing",
    """
    WITH RECURSIVE o AS (
      SELECT conv_id, turn, length(text) AS size,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations
    ), f AS (
      SELECT conv_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS turn, CAST(0 AS BIGINT) AS p,
             CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, FALSE AS big
      FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT f.conv_id, o.rn, o.turn,
             f.p + CASE WHEN f.n > 0 AND (f.n >= 3 OR f.used + size > 1200) THEN 1 ELSE 0 END,
             CASE WHEN size > 1200 AND f.n > 0 THEN 0
                  WHEN size > 1200 THEN f.n
                  WHEN f.n > 0 AND (f.n >= 3 OR f.used + size > 1200) THEN 1 ELSE f.n + 1 END,
             CASE WHEN size > 1200 AND f.n > 0 THEN 0
                  WHEN size > 1200 THEN f.used
                  WHEN f.n > 0 AND (f.n >= 3 OR f.used + size > 1200) THEN size
                  ELSE f.used + size END,
             size > 1200
      FROM f JOIN o ON o.conv_id = f.conv_id AND o.rn = f.rn + 1
    )
    SELECT conv_id, turn, CASE WHEN big THEN NULL ELSE p END AS packet,
           CASE WHEN big THEN 'packet_too_large' END AS reason
    FROM f WHERE rn > 0
    """,
)
def packing(spark, folder):
    """Turns of each conversation packed in order (3 turns, 1200 characters)."""
    turns = read(spark, folder, "conversations").select(
        "conv_id", "turn", F.length("text").alias("size")
    )
    return search.pack(
        turns, ["conv_id"], ["turn"], "turn", "size", 3, 1200, bucket=F.floor(F.col("turn") / 1000)
    )
