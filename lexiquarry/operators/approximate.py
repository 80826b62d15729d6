"""Approximate nearest neighbours: two levels of clusters, and product-quantized codes with exact re-ranking.

Clusters are found branch by branch inside tasks: a few branches from a bounded sample of all vectors, then the
clusters of every branch from a bounded sample of its own. Centres are a table; vectors meet them by joins in bounded
blocks, so no number of centres is too many and none passes through the driver.

Codes hold a vector in a byte per few dimensions. Distances of a query to all codes are sums from one small lookup
table per query; the best ``k * multiplier`` are compared again by their exact distances.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..functions.vectors import l2sq
from ..params import BLOCK_ROWS, SEARCH_MULTIPLIER, TOP_K
from ..session import materialize
from .common import settled
from .search import _PAIR_SLICE, _blocked, _exact, _matrix, _named, _proposed, _ranked, _singles, clustered_search, knn

#: Vectors a centre is fitted on, at most; rounds of a fit; bytes of a code per dimension; centres of a codebook.
SAMPLE, ROUNDS, DIMENSIONS, CODES = 64, 12, 4, 256
#: Clusters a branch may have, as a multiple of the average.
MOST_CLUSTERS = 4
#: Vectors on which the number of probes is chosen.
TUNED_ON = 256
#: Distances held at a time when codes are compared.
_CELLS = 1 << 21
#: Queries whose lookup tables are held at a time.
_QUERIES = 64
#: Values of the vectors in a block that is compared again where it is searched, and the least rows of one.
BLOCK_VALUES, _LEAST_BLOCK = 1 << 22, 1024


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centres of a few points: seeded k-means++ and Lloyd's rounds; empty clusters go."""
    rng = np.random.default_rng(seed)
    points = points[np.lexsort(points.T)]
    centres = points[rng.integers(len(points))][None]
    nearest = np.square(points - centres[0]).sum(axis=1)
    while len(centres) < k and nearest.sum() > 0:
        centres = np.vstack([centres, points[rng.choice(len(points), p=nearest / nearest.sum())]])
        nearest = np.minimum(nearest, np.square(points - centres[-1]).sum(axis=1))
    for _ in range(rounds):
        owner = _owners(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        counts = np.bincount(owner, minlength=len(centres))
        centres = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def _owners(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    step = max(1, _CELLS // max(1, len(centres)))
    for at in range(0, len(points), step):
        some = points[at : at + step]
        cost = np.square(centres).sum(axis=1)[None] - 2 * some @ centres.T
        out[at : at + step] = cost.argmin(axis=1)
    return out


def _chosen(share: Column, key: str, seed: int) -> Column:
    """Whether a row is in a sample of a share of all rows; the same rows at any partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)


# ---- two levels of clusters ------------------------------------------------------------

def _fit_groups(sample: DataFrame, seed: int) -> DataFrame:
    """branch, cluster, center for rows of branch, clusters (how many are wanted), vector; a task per branch."""

    def fit(rows: pa.Table) -> pa.Table:
        branch, k = rows.column("branch")[0].as_py(), rows.column("clusters")[0].as_py()
        found = kmeans(_matrix(rows.column("vector")), k, seed)
        return pa.table({
            "branch": pa.array([branch] * len(found), pa.int64()), "cluster": pa.array(range(len(found)), pa.int64()),
            "center": pa.array(found.tolist(), pa.list_(pa.float64())),
        })

    return sample.groupBy("branch").applyInArrow(fit, "branch BIGINT, cluster BIGINT, center ARRAY<DOUBLE>")


def _with_nearest(rows: DataFrame, centers: DataFrame, group: str, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (key, vector, group) with the number of the nearest of their group's centres (group, number, center).

    The rows of a group are dealt out in blocks, and every block meets all centres of its group, which are few. Vectors
    pass through, so they travel once. Ties go to the lower number.
    """
    grid = settled(rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks")), "grid")
    left = rows.join(grid, group).withColumn("_block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"))
    right = centers.join(grid, group).select(group, "number", "center", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])
    kept = rows.columns

    def meet(some: pa.Table, few: pa.Table) -> pa.Table:
        few = few.sort_by("number")
        numbers = few.column("number").to_numpy()
        owner = numbers[_owners(_matrix(some.column("vector")), _matrix(few.column("center")))] if some.num_rows else np.zeros(0, np.int64)
        return some.select(kept).append_column(name, pa.array(owner, pa.int64()))

    cell = [group, "_block"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, schema)


def coarse_fit(
    corpus: DataFrame, nlist: int | None = None, doc_id: str = "doc_id", doc_vec: str = "embedding", seed: int = 7, sample: int = SAMPLE
) -> DataFrame:
    """A written table of centres: branch, cluster, center; the centre of a branch itself has a null cluster.

    ``nlist`` clusters are aimed at, by default the square root of the number of vectors, in about as many branches as
    a branch has clusters. A branch gets clusters by its share of the vectors, at most ``MOST_CLUSTERS`` times the
    average. Fits look at ``sample`` vectors per centre, chosen by the hash of their key. Vectors of null take no part.
    """
    rows = corpus.where(F.col(doc_vec).isNotNull()).select(F.col(doc_id).alias("key"), F.col(doc_vec).alias("vector"))
    n = rows.count()
    nlist = nlist or max(1, math.isqrt(n))
    branches = max(1, math.isqrt(nlist))
    first = rows.where(_chosen(F.lit(min(1.0, 1.1 * sample * branches / max(n, 1))), "key", seed))
    top = _fit_groups(first.select(F.lit(0).cast("bigint").alias("branch"), F.lit(branches).alias("clusters"), "vector"), seed)
    top = materialize(top.select(F.lit(0).alias("one"), F.col("cluster").alias("number"), "center"), "branches")
    second = rows.where(_chosen(F.lit(min(1.0, 1.1 * sample * nlist / max(n, 1))), "key", seed + 1)).withColumn("one", F.lit(0))
    placed = materialize(_with_nearest(second, top, "one", "branch").drop("one"), "placed")
    share = placed.groupBy("branch").agg(F.count(F.lit(1)).alias("n")).crossJoin(placed.agg(F.count(F.lit(1)).alias("all")))
    most = MOST_CLUSTERS * math.ceil(nlist / branches)
    share = share.select("branch", "n", F.greatest(F.lit(1), F.least(F.lit(most), F.round(F.col("n") / F.col("all") * nlist))).cast("int").alias("clusters"))
    picked = placed.join(settled(share, "share"), "branch").where(_chosen(1.1 * sample * F.col("clusters") / F.col("n"), "key", seed + 2))
    # A branch of which no vector is chosen keeps its own centre as its one cluster.
    fitted = _fit_groups(picked.select("branch", "clusters", "vector"), seed)
    none = top.join(fitted.select("branch").distinct(), F.col("number") == F.col("branch"), "left_anti").select(
        F.col("number").alias("branch"), F.lit(0).cast("bigint").alias("cluster"), "center"
    )
    centres = fitted.unionAll(none).select("branch", (F.col("branch") * (1 << 20) + F.col("cluster")).alias("cluster"), "center")
    return materialize(top.select(F.col("number").alias("branch"), F.lit(None).cast("bigint").alias("cluster"), "center").unionAll(centres), "centres")


def coarse_assign(corpus: DataFrame, centres: DataFrame, doc_id: str = "doc_id", doc_vec: str = "embedding") -> DataFrame:
    """``doc_id``, ``doc_vec``, branch, cluster of every vector: the nearest branch, and in it the nearest cluster."""
    rows = corpus.where(F.col(doc_vec).isNotNull()).select(F.col(doc_id).alias("key"), F.col(doc_vec).alias("vector"), F.lit(0).alias("one"))
    top = centres.where("cluster IS NULL").select(F.lit(0).alias("one"), F.col("branch").alias("number"), "center")
    placed = _with_nearest(rows, top, "one", "branch").drop("one")
    inner = centres.where("cluster IS NOT NULL").select("branch", F.col("cluster").alias("number"), "center")
    return _with_nearest(materialize(placed, "placed"), inner, "branch", "cluster").withColumnsRenamed({"key": doc_id, "vector": doc_vec})


def coarse_probes(
    queries: DataFrame, centres: DataFrame, branches: int, nprobe: int, query_id: str = "query_id", query_vec: str = "query_vec"
) -> DataFrame:
    """query, cluster, rank: the ``nprobe`` nearest clusters in the ``branches`` nearest branches of every query."""
    top = centres.where("cluster IS NULL").select("branch", "center")
    near = knn(queries, top, branches, "l2sq", query_id, "branch", query_vec, "center", way="blocked").select(query_id, F.col("branch").alias("_g"))
    sides = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("_q"), F.col(query_vec).alias("_qv"), F.col(query_id).alias("_k"))
    sides = sides.join(near.withColumnRenamed(query_id, "_k"), "_k").drop("_k")
    inner = centres.where("cluster IS NOT NULL").select(F.col("branch").alias("_g"), F.col("cluster").alias("_d"), F.col("center").alias("_dv"))
    schema = T.StructType([T.StructField("_q", sides.schema["_q"].dataType), T.StructField("_d", T.LongType()), T.StructField("_v", T.DoubleType())])
    pairs = _blocked(sides, inner, schema, nprobe, "l2sq", None, BLOCK_ROWS)
    return _ranked(_named(pairs, "l2sq", query_id, "cluster"), nprobe, "l2sq", query_id, "cluster").select(query_id, "cluster", "rank")


def tune_probes(
    assigned: DataFrame, centres: DataFrame, k: int = TOP_K, recall: float = 0.9, doc_id: str = "doc_id", doc_vec: str = "embedding", seed: int = 3
) -> tuple[int, int]:
    """How many branches and clusters to probe so that about ``recall`` of the k nearest vectors are found.

    About ``TUNED_ON`` vectors are searched exactly. Where their true neighbours' branches and clusters stand in the
    order of distance from them gives both numbers; each is to hold (1 + recall) / 2 of the neighbours.
    """
    n = assigned.count()
    share = (1 + recall) / 2
    asked = assigned.where(_chosen(F.lit(min(1.0, TUNED_ON / max(n, 1))), doc_id, seed)).select(F.col(doc_id).alias("query_id"), F.col(doc_vec).alias("query_vec"))
    asked = materialize(asked.limit(2 * TUNED_ON), "asked")
    true = knn(asked, assigned, k, "l2sq", "query_id", doc_id, "query_vec", doc_vec).select("query_id", F.col(doc_id).alias("near"))
    true = true.join(assigned.select(F.col(doc_id).alias("near"), "branch", "cluster"), "near")
    ranked = []
    for level, rows in (("branch", centres.where("cluster IS NULL")), ("cluster", centres.where("cluster IS NOT NULL"))):
        rows = rows.select(F.col(level).alias("number"), "center")
        order = knn(asked, rows, max(1, rows.count()), "l2sq", "query_id", "number", "query_vec", "center", way="blocked")
        ranks = true.join(order.select("query_id", F.col("number").alias(level), "rank"), ["query_id", level])
        ranked.append(ranks.agg(F.percentile("rank", F.lit(share))).scalar())
    found = asked.sparkSession.range(1).select(*[r.alias(f"p{i}") for i, r in enumerate(ranked)]).head()
    return tuple(max(1, math.ceil(p or 1)) for p in found)


def knn_coarse(
    queries: DataFrame, assigned: DataFrame, centres: DataFrame, k: int = TOP_K, branches: int | None = None, nprobe: int | None = None,
    recall: float = 0.9, query_id: str = "query_id", doc_id: str = "doc_id", query_vec: str = "query_vec", doc_vec: str = "embedding",
) -> DataFrame:
    """The k nearest among the rows of the probed clusters of each query; numbers of probes not given are tuned for ``recall``."""
    if branches is None or nprobe is None:
        tuned = tune_probes(assigned, centres, k, recall, doc_id, doc_vec)
        branches, nprobe = branches or tuned[0], nprobe or tuned[1]
    probes = materialize(coarse_probes(queries, centres, branches, nprobe, query_id, query_vec), "probes")
    return clustered_search(queries, assigned, probes, k, query_id, doc_id, query_vec, doc_vec)


def recall_of(found: DataFrame, exact: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """One row: queries, and the share of the exact hits that were found (ties by id count as given)."""
    both = exact.select(query_id, doc_id).join(found.select(query_id, doc_id).withColumn("_hit", F.lit(1)), [query_id, doc_id], "left")
    return both.agg(F.count_distinct(query_id).alias("queries"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


# ---- product quantization ----------------------------------------------------------------

def codebooks(corpus: DataFrame, doc_id: str = "doc_id", doc_vec: str = "embedding", dimensions: int = DIMENSIONS, codes: int = CODES, seed: int = 5) -> np.ndarray:
    """Centres of every part of ``dimensions`` dimensions: parts x codes x dimensions, fitted on a bounded sample, a task per part.

    The size depends on the width of the vectors alone (``codes`` times the vector), so it may go to every task.
    """
    rows = corpus.where(F.col(doc_vec).isNotNull()).select(F.col(doc_id).alias("key"), F.col(doc_vec).alias("vector"))
    n = rows.count()
    some = rows.where(_chosen(F.lit(min(1.0, 1.1 * SAMPLE * codes / max(n, 1))), "key", seed))
    parts = some.select("vector", F.explode(F.sequence(F.lit(0), F.ceil(F.size("vector") / dimensions).cast("int") - 1)).alias("branch"))
    cut = F.slice("vector", F.col("branch") * dimensions + 1, F.lit(dimensions))
    found = _fit_groups(parts.select(F.col("branch").cast("bigint").alias("branch"), F.lit(codes).alias("clusters"), cut.alias("vector")), seed).toArrow()
    width = max(found.column("branch").to_pylist(), default=-1) + 1
    out = np.full((width, codes, dimensions), np.inf)
    for part, code, centre in zip(*(found.column(c).to_pylist() for c in ("branch", "cluster", "center"))):
        out[part, code] = centre + [0.0] * (dimensions - len(centre))
    return out


def _padded(vectors: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Vectors as rows x parts x dimensions."""
    parts, _, dimensions = books.shape
    if vectors.shape[1] > parts * dimensions or vectors.shape[1] <= (parts - 1) * dimensions:
        raise ValueError("vectors do not have the width of the codebooks")
    return np.pad(vectors, ((0, 0), (0, parts * dimensions - vectors.shape[1]))).reshape(len(vectors), parts, dimensions)


def encode(corpus: DataFrame, books: np.ndarray, doc_vec: str = "embedding", code: str = "code") -> DataFrame:
    """``corpus`` with a byte per part of the vector: the nearest centre. Null vectors have null codes."""
    sent = corpus.sparkSession.sparkContext.broadcast(books)

    @arrow_udf(T.BinaryType())
    def coded(vectors: pa.Array) -> pa.Array:
        ok = np.nonzero(~np.asarray(vectors.is_null()))[0]
        out: list = [None] * len(vectors)
        if len(ok):
            cut = _padded(_matrix(vectors.take(pa.array(ok))), sent.value)
            code = np.empty(cut.shape[:2], np.uint8)
            for part, book in enumerate(sent.value):
                book = book[np.isfinite(book[:, 0])]
                code[:, part] = _owners(cut[:, part], book)
            for i, row in zip(ok, code):
                out[i] = row.tobytes()
        return pa.array(out, pa.binary())

    return corpus.withColumn(code, coded(F.col(doc_vec)))


def _tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances queries x parts x codes: from each part of a query to each centre of its codebook."""
    cut = _padded(queries, books)
    out = np.zeros((len(queries), *books.shape[:2]))
    for i in range(books.shape[2]):
        out += np.square(cut[:, :, None, i] - books[None, :, :, i])
    return out


def _decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, as wide as the codebooks. A sum from a query's lookup table is the squared distance to one."""
    return books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)


def _code_sums(queries: np.ndarray, codes: np.ndarray, books: np.ndarray):
    """First query, and sums of queries x codes from each query's lookup table, a bounded number of cells at a time."""
    step = max(1, min(_QUERIES, _CELLS // max(1, len(codes))))
    for at in range(0, len(queries), step):
        tables = _tables(queries[at : at + step], books)
        total = np.zeros((len(tables), len(codes)))
        for part in range(codes.shape[1]):
            total += tables[:, part][:, codes[:, part]]
        yield at, total


def _code_slices(queries: np.ndarray, codes: np.ndarray, order: np.ndarray, books: np.ndarray, k: int):
    """Rows (query, code, distance), a few queries at a time: the k least sums from each query's lookup table.

    Matrix products with the decoded vectors propose pairs, and only these are looked up; all are where products leave too many open.
    """
    singles = _singles(_decoded(codes, books)) if len(queries) and len(codes) > k else None
    for low in range(0, len(queries), _QUERIES):
        some = queries[low : low + _QUERIES]
        pairs = _proposed(_padded(some, books).reshape(len(some), -1), singles, k) if singles else None
        if pairs is not None:
            tables, (qi, xi) = _tables(some, books), pairs
            value = np.zeros(len(qi))
            for part in range(codes.shape[1]):
                value += tables[qi, part, codes[xi, part]]
            yield _first(low + qi, xi, value, order, k)
            continue
        for at, total in _code_sums(some, codes, books):
            for i, row in enumerate(total):
                # Codes are equal often; those as far as the last one stay until ties are decided.
                near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
                yield _first(np.full(len(near), low + at + i), near, row[near], order, k)


def _first(qi: np.ndarray, xi: np.ndarray, value: np.ndarray, order: np.ndarray, k: int):
    """The k pairs of least value of every query, ties by the order of the other side."""
    by = np.lexsort((order[xi], value, qi))
    qi, xi, value = qi[by], xi[by], value[by]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[best], xi[best], value[best]


def _joined(parts):
    parts = [*parts]
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _best_codes(queries: np.ndarray, codes: np.ndarray, order: np.ndarray, books: np.ndarray, k: int):
    """Rows (query, code, distance): the k least sums from each query's lookup table."""
    return _joined(_code_slices(queries, codes, order, books, k))


def _best_reranked(queries: np.ndarray, vectors: np.ndarray, codes: np.ndarray, order: np.ndarray, books: np.ndarray, most: int, k: int):
    """Rows (query, vector, distance): the k least exact distances among the ``most`` least sums from each query's lookup table."""

    def exact(qi, xi, _):
        value = np.empty(len(qi))
        for at in range(0, len(qi), _PAIR_SLICE):
            here = slice(at, at + _PAIR_SLICE)
            value[here] = _exact(queries[qi[here]], vectors[xi[here]], "l2sq")
        return _first(qi, xi, value, order, k)

    return _joined(exact(*rows) for rows in _code_slices(queries, codes, order, books, most))


def _raw_codes(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary column of equal widths to a rows x parts matrix of bytes."""
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)


def tune_multiplier(
    coded: DataFrame, books: np.ndarray, k: int = TOP_K, recall: float = 0.9, doc_id: str = "doc_id", doc_vec: str = "embedding", code: str = "code", seed: int = 3
) -> int:
    """How many times k candidates by code must be re-ranked so that about ``recall`` of the k nearest vectors are found.

    About ``TUNED_ON`` vectors are searched exactly. One pass over the codes counts for each of their true neighbours how
    many codes come before it; (1 + recall) / 2 of the neighbours are to be among the candidates.
    """
    usable = coded.where(F.col(code).isNotNull())
    n = usable.count()
    asked = usable.where(_chosen(F.lit(min(1.0, TUNED_ON / max(n, 1))), doc_id, seed)).select(F.col(doc_id).alias("query_id"), F.col(doc_vec).alias("query_vec"))
    asked = materialize(asked.limit(2 * TUNED_ON), "asked")
    true = knn(asked, usable, k, "l2sq", "query_id", doc_id, "query_vec", doc_vec).select("query_id", F.col(doc_id).alias("near"))
    true = true.join(usable.select(F.col(doc_id).alias("near"), F.col(code).alias("near_code")), "near").join(asked, "query_id")
    # At most 2 * TUNED_ON * k rows.
    found = true.select("query_vec", "near", "near_code").toArrow().combine_chunks()
    if not found.num_rows:
        return SEARCH_MULTIPLIER
    queries, near = _matrix(found.column("query_vec")), found.column("near").to_numpy()
    own = _raw_codes(found.column("near_code"))
    # The same sums in the same order as in the pass, so that equal codes are equal there.
    at = np.concatenate([np.diagonal(total[:, i : i + len(total)]) for i, total in _code_sums(queries, own, books)])
    sent = coded.sparkSession.sparkContext.broadcast((queries, near, at, books))

    def count(batches):
        queries, near, at, books = sent.value
        before = np.zeros(len(at), np.int64)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for i, total in _code_sums(queries, _raw_codes(batch.column(1)), books):
                    limit = at[i : i + len(total), None]
                    before[i : i + len(total)] += (total < limit).sum(axis=1)
                    q, d = np.nonzero(total == limit)
                    np.add.at(before, i + q, ids[d] < near[i + q])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at))), pa.array(before)], ["pair", "before"])

    ranks = usable.select(doc_id, code).mapInArrow(count, "pair BIGINT, before BIGINT").groupBy("pair").agg(F.sum("before").alias("before"))
    last = ranks.agg(F.percentile("before", F.lit((1 + recall) / 2))).head()[0]
    return max(SEARCH_MULTIPLIER, math.ceil((last + 1) / k))


def _cells(q: DataFrame, d: DataFrame, nq: int, nd: int, meet, schema: T.StructType) -> DataFrame:
    """Rows of q (_q, ...) and d (_d, ...) dealt out by hash; each of nq blocks meets each of nd blocks in one task."""
    nq, nd = F.lit(nq), F.lit(nd)
    left = q.select("*", F.pmod(F.xxhash64("_q"), nq).cast("int").alias("_qb"), F.explode(F.sequence(F.lit(0), nd - 1)).alias("_db"))
    right = d.select("*", F.explode(F.sequence(F.lit(0), nq - 1)).alias("_qb"), F.pmod(F.xxhash64("_d"), nd).cast("int").alias("_db"))
    cell = ["_qb", "_db"]

    def pairs(some: pa.Table, many: pa.Table) -> pa.Table:
        many = many.sort_by("_d")
        qi, di, value = meet(some, many) if some.num_rows and many.num_rows else _joined([])
        return pa.table([some.column("_q").take(pa.array(qi)), many.column("_d").take(pa.array(di)), pa.array(value)], names=["_q", "_d", "_v"])

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(pairs, schema)


def _pair_schema(q: DataFrame, d: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("_q", q.schema["_q"].dataType), T.StructField("_d", d.schema["_d"].dataType), T.StructField("_v", T.DoubleType())])


def code_candidates(
    queries: DataFrame, coded: DataFrame, books: np.ndarray, k: int, query_id: str = "query_id", doc_id: str = "doc_id",
    query_vec: str = "query_vec", code: str = "code", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query, doc, distance, rank: the k codes nearest to every query. Queries and codes meet in blocks; only codes travel."""
    q = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("_q"), F.col(query_vec).alias("_qv"))
    d = coded.where(F.col(code).isNotNull()).select(F.col(doc_id).alias("_d"), F.col(code).alias("_dv"))
    nq, nd = (max(1, -(-n // rows)) for n, rows in ((q.count(), block_rows), (d.count(), 16 * block_rows)))
    sent = queries.sparkSession.sparkContext.broadcast(books)

    def meet(some: pa.Table, many: pa.Table):
        return _best_codes(_matrix(some.column("_qv")), _raw_codes(many.column("_dv")), np.arange(many.num_rows), sent.value, k)

    pairs = _cells(q, d, nq, nd, meet, _pair_schema(q, d))
    return _ranked(_named(pairs, "l2sq", query_id, doc_id), k, "l2sq", query_id, doc_id)


def overfetch_coded(
    queries: DataFrame, coded: DataFrame, books: np.ndarray, k: int = TOP_K, multiplier: int | None = None, query_id: str = "query_id",
    doc_id: str = "doc_id", query_vec: str = "query_vec", doc_vec: str = "embedding", code: str = "code", block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """The best k by exact distance of the ``k * multiplier`` candidates that codes give; ties by doc id.

    A multiplier that is not given is tuned on a sample; it grows with the corpus. Few candidates are looked up in the
    corpus. Where that would move more vectors than all blocks of both sides hold, vectors travel with their codes
    instead, and candidates are compared again where they were found, so that no more than k of a block are ever rows.
    Then each block of the corpus gives ``k * multiplier`` candidates: all that codes give for the whole corpus, and more.
    """
    multiplier = multiplier or tune_multiplier(coded, books, k, doc_id=doc_id, doc_vec=doc_vec, code=code)
    most = k * multiplier
    q = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("_q"), F.col(query_vec).alias("_qv"))
    d = coded.where(F.col(code).isNotNull()).select(F.col(doc_id).alias("_d"), F.col(doc_vec).alias("_dv"), F.col(code).alias("_c"))
    asked, held = q.count(), d.count()
    rows = max(_LEAST_BLOCK, block_values // max(1, books.shape[0] * books.shape[2]))
    nq, nd = (max(1, -(-n // rows)) for n in (asked, held))
    if asked * most <= held * nq + asked * nd:
        near = code_candidates(queries, coded, books, most, query_id, doc_id, query_vec, code)
        near = settled(near.select(query_id, doc_id), "candidates")
        scored = near.join(coded.select(doc_id, doc_vec), doc_id).join(queries.select(query_id, query_vec), query_id)
        scored = scored.select(query_id, doc_id, l2sq(F.col(query_vec), F.col(doc_vec)).alias("distance"))
        return _ranked(scored, k, "l2sq", query_id, doc_id)
    context = queries.sparkSession.sparkContext
    # More blocks of queries, so that all cores have cells; these do not change what is found.
    nq = max(nq, min(-(-asked // _LEAST_BLOCK), -(-2 * context.defaultParallelism // nd)))
    sent = context.broadcast(books)

    def meet(some: pa.Table, many: pa.Table):
        vectors, codes = _matrix(many.column("_dv")), _raw_codes(many.column("_c"))
        return _best_reranked(_matrix(some.column("_qv")), vectors, codes, np.arange(many.num_rows), sent.value, most, k)

    pairs = _cells(q, d, nq, nd, meet, _pair_schema(q, d))
    return _ranked(_named(pairs, "l2sq", query_id, doc_id), k, "l2sq", query_id, doc_id)
