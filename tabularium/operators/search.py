"""Filters, lexical and dense search, fusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.text import bm25, dot, norm, tokens

FIELDS = ("ticker", "year", "report_type", "table_type")
#: Rank that stands for "not in this list" when ties are broken.
NO_RANK = 1_000_000_000
RRF = 60
#: Query vectors that are sent to the executors at once.
BLOCK = 4096
#: Vectors and query vectors that meet in a task, and queries that are scored at once.
MET_VECTORS, MET_QUERIES, TILE = 1 << 15, 1 << 13, 128
#: Two scores that are this close may be equal once they are rounded.
NEAR = 4e-9


def metadata_filter(filters: Mapping[str, Sequence]) -> Column:
    """All fields must have one of their values; an empty list asks nothing."""
    for name, values in filters.items():
        if name not in FIELDS:
            raise ValueError(f"no filter field: {name}")
        if isinstance(values, str):
            raise TypeError(f"{name} needs a list")
        if name == "year" and any(isinstance(v, bool) or not isinstance(v, int) for v in values):
            raise TypeError("years are integers")
    return reduce(lambda a, b: a & b, [F.col(k).isin(*v) for k, v in filters.items() if v], F.lit(True))


def relaxed(rows: DataFrame, report_types: Sequence[str]) -> DataFrame:
    """For each ticker the rows of these report types, or all its rows if it has none of them (relaxed).

    keeps_type: no ticker had to be relaxed, so the filter as a whole keeps its report types.
    """
    strict = F.col("report_type").isin(*report_types)
    any_strict = rows.groupBy("ticker").agg(F.max(strict.cast("int")).alias("any_strict"))
    whole = any_strict.agg((F.min("any_strict") == 1).alias("keeps_type"))  # one row
    kept = rows.join(any_strict, "ticker").where(strict | (F.col("any_strict") == 0))
    return kept.withColumn("relaxed", F.col("any_strict") == 0).drop("any_strict").join(F.broadcast(whole), F.lit(True))


#: Stands for a document itself among its terms; no term is empty.
SELF = ""


def postings(rows: DataFrame, wanted: DataFrame | None = None, scope: str = "ticker") -> DataFrame:
    """(scope, table_id, length, term, tf): how often each document of a scope has a term, and a row with SELF for each document.

    With wanted (term) only these terms: others are dropped before anything is shuffled, by a semi-join that Spark broadcasts
    if wanted is small enough for it.
    """
    each = rows.select(scope, "table_id", tokens(F.col("index_text")).alias("terms")).select(scope, "table_id", F.size("terms").alias("length"), F.explode(F.concat(F.array(F.lit(SELF)), "terms")).alias("term"))
    if wanted is not None:
        each = each.join(wanted.select("term").unionByName(wanted.sparkSession.range(1).select(F.lit(SELF).alias("term"))).distinct(), "term", "left_semi")
    return each.groupBy(scope, "table_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_scores(rows: DataFrame, questions: DataFrame, scope: str = "ticker") -> DataFrame:
    """(question_id, scope, table_id, score): documents with a word of the question; counts are those of the scope.

    Texts are cut into tokens once; documents' sizes come along as rows with SELF, and the branches of the plan share one
    exchange. Weights are dealt by document before they meet the questions, so pairs of both are summed where they arise.
    """
    terms = questions.select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    every = postings(rows, terms, scope)
    # all three branches take the same columns of every, and no filter of a branch goes below its exchange
    df = every.groupBy(scope, "term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"), F.sum("length").alias("words"))
    own = lambda c: F.max(F.when(F.col("term") == SELF, F.col(c)))
    sizes = df.groupBy(scope).agg(own("df").alias("n"), (own("words") / own("df")).alias("mean"))
    weighed = every.join(df.select(scope, "term", "df"), [scope, "term"]).join(sizes, scope)
    weighed = weighed.select(scope, "table_id", "term", bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("mean")).alias("weight"))
    dealt = weighed.repartition("table_id")
    return dealt.join(terms, "term").groupBy("question_id", scope, "table_id").agg(F.round(F.sum("weight"), 9).alias("score"))


def top(scores: DataFrame, k: int, by: Sequence[str] = ("question_id",), score: str = "score", rank: str = "rank") -> DataFrame:
    """The k best rows of each group, ties by table_id; Spark cuts each partition to k rows a group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), "table_id")
    return scores.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def cosine_scores(vectors: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(question_id, table_id, score) of each query vector (a stated set) with all vectors.

    Queries are sent to the executors in blocks of about so many; there is no limit on the number of blocks.
    """
    blocks = -(-queries.count() // block) or 1
    asked = queries.withColumn("query_norm", norm(F.col("query")))
    parts = [asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [asked]
    held = vectors.withColumn("norm", norm(F.col("embedding")))
    score = F.round(F.try_divide(dot(F.col("embedding"), F.col("query")), F.col("norm") * F.col("query_norm")), 9).alias("score")
    scored = [held.join(F.broadcast(part), F.lit(True)).select("question_id", "table_id", score) for part in parts]
    return reduce(DataFrame.unionByName, scored)


def _rows(arrays: pa.ChunkedArray, size: int) -> np.ndarray:
    return arrays.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows, added from the left as dot() does."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def least_ids(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least ids of each group and score: no other can be among the k best of its group."""
    order = np.lexsort((ids, score, group))
    new = np.append(True, (np.diff(group[order]) != 0) | (np.diff(score[order]) != 0))[: len(order)]
    first = np.flatnonzero(new)
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]


def nearest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the vector, cosine): for each query all vectors that can be among its k best once scores are rounded.

    A product of matrices finds what is near enough, and dot()'s sum gives the score. Of equal scores only the k least ids stay.
    """
    lengths, own = np.sqrt(_in_order(vectors * vectors)), np.sqrt(_in_order(queries * queries))
    unit, out = (vectors / lengths[:, None]).T, []
    for low in range(0, len(queries), TILE):
        part = (queries[low : low + TILE] / own[low : low + TILE, None]) @ unit
        if k < len(vectors):
            least = np.partition(part, len(vectors) - k, axis=1)[:, len(vectors) - k, None]
            q, v = np.nonzero(part >= least - NEAR)
        else:
            q, v = np.nonzero(np.ones_like(part, bool))
        q += low
        score = np.empty(len(q))
        for at in range(0, len(q), 1 << 15):
            a, b = q[at : at + (1 << 15)], v[at : at + (1 << 15)]
            score[at : at + (1 << 15)] = _in_order(vectors[b] * queries[a]) / (lengths[b] * own[a])
        few = least_ids(q, score, ids[v], k)
        out.append((q[few], v[few], score[few]))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, [int, int, float][i]) for i in range(3))


def best_cosine(vectors: DataFrame, queries: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """What top(cosine_scores(vectors, queries), k) gives, without a row for each pair.

    Vectors and queries are dealt to blocks of bounded size by hashes of their ids; each block of vectors meets each of queries in a task, which
    leaves the k best of a query. Vectors of another size than most, with nulls, not finite or without length go by cosine_scores().
    """
    spark = vectors.sparkSession
    widths = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").head()
    size = widths["size"] if widths else 0
    # cosines of very long or very short vectors could overflow
    plain = lambda c: F.coalesce((F.size(c) == size) & (norm(F.col(c)) > 1e-100) & (norm(F.col(c)) < 1e100), F.lit(False))
    n_vectors, n_plain = vectors.agg(F.count(F.lit(1)), F.count_if(plain("embedding"))).first()
    n_queries, n_asked = queries.agg(F.count(F.lit(1)), F.count_if(plain("query"))).first()
    v_blocks, q_blocks = -(-n_plain // MET_VECTORS) or 1, -(-n_asked // MET_QUERIES) or 1
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    held = vectors.where(plain("embedding")).select("table_id", "embedding", of("table_id", v_blocks).alias("v"), copies(q_blocks).alias("q"))
    asked = queries.where(plain("query")).select("question_id", "query", of("question_id", q_blocks).alias("q"), copies(v_blocks).alias("v"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["table_id"].combine_chunks()
        q, v, score = nearest(_rows(right["query"], size), _rows(left["embedding"], size), ids.to_numpy(zero_copy_only=False), k)
        return pa.table({"question_id": right["question_id"].combine_chunks().take(pa.array(q)), "table_id": ids.take(pa.array(v)), "score": pa.array(score)})

    kinds = f"question_id {queries.schema['question_id'].dataType.simpleString()}, table_id {vectors.schema['table_id'].dataType.simpleString()}, score double"
    cells = v_blocks * q_blocks
    deal = lambda df: df.repartition(min(cells, 1 << 12), "v", "q").groupBy("v", "q")
    found = [deal(held).cogroup(deal(asked)).applyInArrow(meet, kinds).withColumn("score", F.round("score", 9))]
    if n_plain < n_vectors:
        found.append(cosine_scores(vectors.where(~plain("embedding")), queries))
    if n_asked < n_queries:
        found.append(cosine_scores(vectors.where(plain("embedding")), queries.where(~plain("query"))))
    return top(reduce(DataFrame.unionByName, found), k, rank=rank)


def fused(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (question_id, table_id, dense_rank) and (.., bm25_rank), best first."""
    both = dense.join(lexical, ["question_id", "table_id"], "full")
    share = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf_score", F.round(share("dense_rank") + share("bm25_rank"), 12))
    best = F.least(F.coalesce("dense_rank", F.lit(NO_RANK)), F.coalesce("bm25_rank", F.lit(NO_RANK)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("rrf_score"), best, "table_id")))


def metadata_conflicts(dense: DataFrame, lexical: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(question_id, table_id, conflicts): of tables that both lists hold, the fields in which they differ; nulls are equal to nulls.

    Both lists describe a table by themselves; where they differ one of them is stale, and a fused row would be right for neither.
    """
    keys = ["question_id", "table_id"]
    other = lexical.select(*keys, *(F.col(f).alias(f"other_{f}") for f in fields))
    differ = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"other_{f}")), F.lit(f)) for f in fields)))
    return dense.select(*keys, *fields).join(other, keys).select(*keys, F.concat_ws(",", differ).alias("conflicts"))


def interleaved(rows: DataFrame, total: int, bucket: str = "ticker") -> DataFrame:
    """Takes one row of each bucket in turn: rows have question_id, the bucket, bucket_rank and table_id; a table counts once."""
    first = Window.partitionBy("question_id", "table_id").orderBy("bucket_rank", bucket)
    buckets = rows.groupBy("question_id").agg(F.ceil(F.lit(total) / F.count_distinct(bucket)).alias("quota"))
    kept = rows.join(buckets, "question_id").where(F.col("bucket_rank") <= F.col("quota")).withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy("question_id").orderBy("bucket_rank", bucket, "table_id")
    return kept.withColumn("position", F.row_number().over(order)).where(F.col("position") <= total).drop("n", "quota")
