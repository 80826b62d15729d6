"""Exact and cluster-pruned nearest-neighbour search between two tables of vectors.

No plan here pairs rows with rows. Distances are computed block against block
with NumPy inside tasks, and a task hands on at most k rows per query. Spark
does the rest: it spreads the blocks, shuffles the survivors and ranks them.

Three ways, chosen by a size check on both sides:

* few queries: they go to every task, the corpus streams past them;
* small corpus (centroids, categories, aliases): it goes to every task, the
  queries stream past it and nothing is shuffled;
* both large: both sides are hashed into bounded blocks, and each pair of
  blocks meets in one cogroup task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..params import BLOCK_ROWS, DECAY_SCALE, MIN_SIMILARITY, NPROBE, SMALL_SIDE_BYTES, SMALL_SIDE_ROWS, TOP_K
from ..functions.vectors import l2sq, score_decay
from .common import settled

#: Queries compared with a block at a time, and pairs whose exact metric is computed at a time.
_QUERY_SLICE = 128
_PAIR_SLICE = 1 << 15
#: Corpus rows of one product in single precision, and rows of which only the least cost is looked at first.
_COLUMNS, _GROUP = 1 << 13, 16
METRICS = {"l2sq": "distance", "cosine": "similarity"}


# ---- block kernel ---------------------------------------------------------------

def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column to an n x d matrix of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(vectors) == 0:
        return np.zeros((0, 0))
    width, rest = divmod(len(flat), len(vectors))
    if rest or not (np.diff(vectors.offsets.to_numpy()) == width).all():
        raise ValueError("vectors of different lengths in one collection")
    return flat.reshape(len(vectors), width)


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Metric of matching rows; the same pair always gives the same bits."""
    if metric == "l2sq":
        return np.square(a - b).sum(axis=1)
    length = np.sqrt(np.square(a).sum(axis=1)) * np.sqrt(np.square(b).sum(axis=1))
    return np.divide((a * b).sum(axis=1), length, out=np.zeros(len(a)), where=length > 0)


def _bound(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Cost matrix by one matrix product, and how far each row of it may be off."""
    qq, xx = np.square(q).sum(axis=1), np.square(x).sum(axis=1)
    if metric == "l2sq":
        return qq[:, None] + xx[None, :] - 2.0 * (q @ x.T), 1e-9 * (qq + xx.max(initial=0.0))
    length = np.sqrt(qq)[:, None] * np.sqrt(xx)[None, :]
    return -np.divide(q @ x.T, length, out=np.zeros(length.shape), where=length > 0), np.full(len(q), 1e-9)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.square(x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros(x.shape), where=length > 0)


def _singles(x: np.ndarray, metric: str = "l2sq") -> tuple[np.ndarray, int, float] | None:
    """Corpus rows as ``_proposed`` takes them, their number and greatest squared length; nothing if single precision can't hold them.

    A row is -2x and its squared length (cosine: -2x of unit length), so that its product with a query and 1 is its
    cost but for a number that is the same for all rows. Groups are filled up with rows of endless cost.
    """
    x = _unit(x) if metric == "cosine" else x
    xx = np.square(x).sum(axis=1)
    if not (xx < 1e30).all():
        return None
    rows = np.zeros((-(-len(x) // _GROUP) * _GROUP, x.shape[1] + 1), np.float32)
    rows[: len(x), :-1] = -2 * x
    rows[: len(x), -1] = 0 if metric == "cosine" else xx
    rows[len(x) :, -1] = np.inf
    return rows, len(x), xx.max(initial=0.0)


def _proposed(q: np.ndarray, singles: tuple, k: int, metric: str = "l2sq") -> tuple[np.ndarray, np.ndarray] | None:
    """Row pairs (query, corpus), ordered by query, among them the k best of every query and all that may tie with these.

    Costs are products in single precision; how far these may be off is allowed for. Of each group of corpus rows only
    the least cost is looked at first. Nothing if single precision leaves too many pairs open.
    """
    rows, n, most = singles
    q = _unit(q) if metric == "cosine" else q
    qq = np.square(q).sum(axis=1)
    if not (qq < 1e30).all():
        return None
    width = q.shape[1]
    off = (width + 8) * 2.0**-23 * (qq + 2 * most) + width * 2.0**-120
    asked = np.ones((len(q), width + 1), np.float32)
    asked[:, :-1] = q
    best, limit = np.empty((len(q), 0), np.float32), np.full(len(q), np.inf, np.float32)
    parts, many = [], len(q) * (32 * k + n // 64)
    for at in range(0, len(rows), _COLUMNS):
        cost = asked @ rows[at : at + _COLUMNS].T
        least = cost.reshape(len(q), _GROUP, -1).min(axis=1)
        best = np.hstack([best, least])
        if best.shape[1] > k:
            best = np.partition(best, k - 1, axis=1)[:, :k]
        if best.shape[1] == k:
            limit = np.nextafter((best.max(axis=1) + 2 * off).astype(np.float32), np.float32(np.inf))
        qi, group = np.nonzero(least <= limit[:, None])
        if len(qi) > many:
            return None
        inside = group[:, None] + least.shape[1] * np.arange(_GROUP)
        value = cost[qi[:, None], inside]
        row, column = np.nonzero(value <= limit[qi][:, None])
        parts.append((qi[row], at + inside[row, column], value[row, column]))
        if sum(len(p[0]) for p in parts) > many:
            return None
    qi, xi, value = (np.concatenate(c) for c in zip(*parts))
    near = np.flatnonzero((value <= limit[qi]) & (xi < n))
    near = near[np.argsort(qi[near], kind="stable")]
    return qi[near], xi[near]


def _nearest_pairs(q, x, x_order, k, metric, floor=None):
    """Row pairs (query, corpus, value): the k best per query, ties by ``x_order``; or all that reach ``floor``.

    The matrix product only proposes pairs; those near the border are decided
    by the exact metric, so results do not depend on how rows are blocked. Single
    precision is tried first, and double where it leaves too many pairs open.
    """
    sign = 1.0 if metric == "l2sq" else -1.0
    parts = []
    if len(q) and len(x) and q.shape[1] != x.shape[1]:
        raise ValueError("queries and corpus have vectors of different lengths")
    singles = _singles(x, metric) if k is not None and len(q) and len(x) > k else None
    for at in range(0, len(q), _QUERY_SLICE):
        qs = q[at : at + _QUERY_SLICE]
        pairs = _proposed(qs, singles, k, metric) if singles else None
        if pairs is None:
            cost, slack = _bound(qs, x, metric)
            if k is None:
                limit = np.full(len(qs), sign * floor)
            elif len(x) > k:
                limit = np.partition(cost, k - 1, axis=1)[:, k - 1]
            else:
                limit = np.full(len(qs), np.inf)
            near = cost <= (limit + 2 * slack)[:, None]
            ends = np.cumsum(near.sum(axis=1))
        else:
            ends = np.cumsum(np.bincount(pairs[0], minlength=len(qs)))
        # Pairs are decided a bounded number at a time, even if very many tie.
        cut = 0
        while cut < len(qs):
            base = ends[cut - 1] if cut else 0
            upto = max(cut + 1, int(np.searchsorted(ends, base + _PAIR_SLICE, side="right")))
            if pairs is None:
                qi, xi = np.nonzero(near[cut:upto])
            else:
                qi, xi = (c[base : ends[upto - 1]] for c in pairs)
                qi = qi - cut
            value = _exact(qs[cut:upto][qi], x[xi], metric)
            if k is None:
                keep = sign * value <= sign * floor
                qi, xi, value = qi[keep], xi[keep], value[keep]
            else:
                order = np.lexsort((x_order[xi], sign * value, qi))
                qi, xi, value = qi[order], xi[order], value[order]
                first = np.searchsorted(qi, qi, side="left")
                keep = np.arange(len(qi)) - first < k
                qi, xi, value = qi[keep], xi[keep], value[keep]
            parts.append((qi + at + cut, xi, value))
            cut = upto
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*parts))


def _order_of(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    ranks = np.empty(len(ids), dtype=np.int64)
    ranks[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return ranks


def _pair_table(qids, dids, q, x, k, metric, floor):
    qi, xi, value = _nearest_pairs(q, x, _order_of(dids), k, metric, floor)
    return pa.table([qids.take(pa.array(qi)), dids.take(pa.array(xi)), pa.array(value)], names=["_q", "_d", "_v"])


# ---- the three ways ---------------------------------------------------------------

def _bounded(df: DataFrame, rows: int) -> pa.Table | None:
    """The whole of ``df`` if it has at most ``rows`` rows and is small in bytes, else nothing.

    The widest vector is found in the tasks first, so nothing comes to the driver that is too large for it.
    """
    vector = F.col(df.columns[1])
    about = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("width")).head()
    if about.n > rows or about.n * (8 * (about.width or 0) + 16) > SMALL_SIDE_BYTES:
        return None
    return df.toArrow()


def _stream_corpus(corpus, schema, small, k, metric, floor):
    qids, q = small.column(0).combine_chunks(), _matrix(small.column(1))
    sent = corpus.sparkSession.sparkContext.broadcast((qids, q))

    def scan(batches):
        ids, queries = sent.value
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _pair_table(ids, batch.column(0), queries, _matrix(batch.column(1)), k, metric, floor)
            if k is None:
                yield from found.to_batches()
                continue
            best = found if best is None else pa.concat_tables([best, found])
            if best.num_rows > 16 * k * max(1, len(ids)):
                best = _trim(best, k, metric)
        if best is not None:
            yield from _trim(best, k, metric).combine_chunks().to_batches()

    return corpus.mapInArrow(scan, schema)


def _trim(pairs: pa.Table, k: int, metric: str) -> pa.Table:
    way = "ascending" if metric == "l2sq" else "descending"
    pairs = pairs.sort_by([("_q", "ascending"), ("_v", way), ("_d", "ascending")]).combine_chunks()
    codes = pairs.column("_q").combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.searchsorted(codes, codes, side="left")
    return pairs.take(pa.array(np.nonzero(np.arange(len(codes)) - first < k)[0]))


def _stream_queries(queries, schema, small, k, metric, floor):
    dids, x = small.column(0).combine_chunks(), _matrix(small.column(1))
    sent = queries.sparkSession.sparkContext.broadcast((dids, x))

    def scan(batches):
        ids, corpus = sent.value
        for batch in batches:
            if batch.num_rows and len(ids):
                yield from _pair_table(
                    batch.column(0), ids, _matrix(batch.column(1)), corpus, k, metric, floor
                ).combine_chunks().to_batches()

    return queries.mapInArrow(scan, schema)


def _blocked(queries, corpus, schema, k, metric, floor, block_rows):
    """Both sides carry ``_g``; only rows of equal ``_g`` meet, block by block."""
    # One row per group: a constant, or the clusters, which may be too many to be sent to every task.
    grid = settled(
        queries.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_nq"))
        .join(
            corpus.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_nc")), "_g"
        ),
        "grid",
    )
    left = queries.join(grid, "_g").select(
        "_g", "_q", "_qv",
        F.pmod(F.xxhash64("_q"), F.col("_nq")).cast("int").alias("_qb"),
        F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)).alias("_cb"),
    )
    right = corpus.join(grid, "_g").select(
        "_g", "_d", "_dv",
        F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("_qb"),
        F.pmod(F.xxhash64("_d"), F.col("_nc")).cast("int").alias("_cb"),
    )

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([a.column("_q").slice(0, 0), b.column("_d").slice(0, 0), pa.array([], pa.float64())],
                            names=["_q", "_d", "_v"])
        return _pair_table(
            a.column("_q").combine_chunks(), b.column("_d").combine_chunks(),
            _matrix(a.column("_qv")), _matrix(b.column("_dv")), k, metric, floor,
        )

    cell = ["_g", "_qb", "_cb"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, schema)


def _search(queries, corpus, k, metric, floor, query_id, doc_id, query_vec, doc_vec, small_rows, block_rows, way):
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    q = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("_q"), F.col(query_vec).alias("_qv"))
    d = corpus.where(F.col(doc_vec).isNotNull()).select(F.col(doc_id).alias("_d"), F.col(doc_vec).alias("_dv"))
    schema = T.StructType([
        T.StructField("_q", q.schema["_q"].dataType),
        T.StructField("_d", d.schema["_d"].dataType),
        T.StructField("_v", T.DoubleType()),
    ])
    # Each side is tried at most once, in the order given; a side that fits is sent to every task.
    for name in {"auto": ("few_queries", "small_corpus"), "corpus_first": ("small_corpus", "few_queries")}.get(way, (way,)):
        small = _bounded({"few_queries": q, "small_corpus": d}[name], small_rows) if name != "blocked" else None
        if small is not None and name == "few_queries":
            return _stream_corpus(d, schema, small, k, metric, floor), False
        if small is not None:
            return _stream_queries(q, schema, small, k, metric, floor), True
    one = F.lit(0).alias("_g")
    return _blocked(q.select("*", one), d.select("*", one), schema, k, metric, floor, block_rows), False


def _named(pairs, metric, query_id, doc_id):
    return pairs.select(
        F.col("_q").alias(query_id), F.col("_d").alias(doc_id), F.col("_v").alias(METRICS[metric])
    )


def _ranked(hits: DataFrame, k: int, metric: str, query_id: str, doc_id: str) -> DataFrame:
    value = F.col(METRICS[metric])
    order = Window.partitionBy(query_id).orderBy(value.asc() if metric == "l2sq" else value.desc(), doc_id)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    metric: str = "l2sq",
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    query_vec: str = "query_vec",
    doc_vec: str = "embedding",
    small_rows: int = SMALL_SIDE_ROWS,
    block_rows: int = BLOCK_ROWS,
    way: str = "auto",
) -> DataFrame:
    """The k nearest corpus rows of every query: (query, doc, distance or similarity, rank); ties by doc id."""
    pairs, _ = _search(
        queries, corpus, k, metric, None, query_id, doc_id, query_vec, doc_vec, small_rows, block_rows, way
    )
    return _ranked(_named(pairs, metric, query_id, doc_id), k, metric, query_id, doc_id)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    metric: str = "cosine",
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    query_vec: str = "query_vec",
    doc_vec: str = "embedding",
    small_rows: int = SMALL_SIDE_ROWS,
    block_rows: int = BLOCK_ROWS,
    way: str = "corpus_first",
) -> DataFrame:
    """The one nearest corpus row of every query. A small corpus is tried first: then nothing shuffles."""
    pairs, complete = _search(
        queries, corpus, 1, metric, None, query_id, doc_id, query_vec, doc_vec, small_rows, block_rows, way
    )
    named = _named(pairs, metric, query_id, doc_id)
    return named if complete else _ranked(named, 1, metric, query_id, doc_id).drop("rank")


def within(
    queries: DataFrame,
    corpus: DataFrame,
    threshold: float,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    query_vec: str = "query_vec",
    doc_vec: str = "embedding",
    small_rows: int = SMALL_SIDE_ROWS,
    block_rows: int = BLOCK_ROWS,
    way: str = "auto",
) -> DataFrame:
    """All pairs with a cosine of at least ``threshold``."""
    pairs, _ = _search(
        queries, corpus, None, "cosine", threshold, query_id, doc_id, query_vec, doc_vec, small_rows, block_rows, way
    )
    return _named(pairs, "cosine", query_id, doc_id)


# ---- scores -----------------------------------------------------------------------

def with_score(hits: DataFrame, scale: float = DECAY_SCALE) -> DataFrame:
    return hits.withColumn("score", score_decay(F.col("distance"), scale))


def threshold_filter(
    hits: DataFrame,
    threshold: float = MIN_SIMILARITY,
    keep_best: bool = False,
    k: int | None = None,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Hits whose score reaches the threshold or is missing.

    ``keep_best``: a query that would lose all its hits keeps the best one.
    ``k``: then only the first k hits of each query, in their given ranks.
    """
    passes = F.col("score").isNull() | (F.col("score") >= threshold)
    if not keep_best and k is None:
        return hits.where(passes)
    order = [F.col("score").isNull().desc(), F.col("score").desc(), F.col(doc_id)]
    # Hits are at most a few per query, so a window over a query is bounded.
    marked = hits.withColumn("_pass", passes)
    if keep_best:
        by_query = Window.partitionBy(query_id)
        marked = (
            marked.withColumn("_any", F.max("_pass").over(by_query))
            .withColumn("_best", F.row_number().over(by_query.orderBy(F.coalesce("score", F.lit(0.0)).desc(), doc_id)))
            .where(F.col("_pass") | (~F.col("_any") & (F.col("_best") == 1)))
            .drop("_any", "_best")
        )
    else:
        marked = marked.where("_pass")
    marked = marked.drop("_pass")
    if k is None:
        return marked
    return (
        marked.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))
        .where(F.col("rank") <= k)
    )


def overfetch(queries: DataFrame, corpus: DataFrame, k: int, multiplier: int, exact, **names) -> DataFrame:
    """Fetch ``k * multiplier`` candidates with any search, re-rank them exactly, cut to k."""
    query_id, doc_id = names.get("query_id", "query_id"), names.get("doc_id", "doc_id")
    query_vec, doc_vec = names.get("query_vec", "query_vec"), names.get("doc_vec", "embedding")
    candidates = settled(exact(queries, corpus, int(k * multiplier), **names).select(query_id, doc_id), "candidates")
    scored = (
        candidates.join(queries.select(query_id, query_vec), query_id)
        .join(corpus.select(doc_id, doc_vec), doc_id)
        .select(query_id, doc_id, l2sq(F.col(query_vec), F.col(doc_vec)).alias("distance"))
    )
    return _ranked(scored, k, "l2sq", query_id, doc_id)


# ---- cluster-pruned search ----------------------------------------------------------

def ivf_fit(corpus: DataFrame, nlist: int | None = None, doc_vec: str = "embedding", seed: int = 7, max_iter: int = 10):
    """Centroids (cluster, center) of ``nlist`` clusters; by default the square root of the row count."""
    if nlist is None:
        nlist = max(1, int(math.sqrt(corpus.count())))
    points = corpus.where(F.col(doc_vec).isNotNull()).select(array_to_vector(doc_vec).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter).fit(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return corpus.sparkSession.createDataFrame(rows, "cluster int, center array<double>")


def ivf_assign(
    corpus: DataFrame, centroids: DataFrame, doc_vec: str = "embedding", small_rows: int = SMALL_SIDE_ROWS, doc_id: str = "doc_id"
) -> DataFrame:
    """Add the ``cluster`` of the nearest centroid; ties go to the lower number. No shuffle if the centroids are few."""
    small = _bounded(centroids.select("cluster", "center"), 16 * small_rows)
    if small is None:
        near = nearest(corpus, centroids, "l2sq", doc_id, "cluster", doc_vec, "center", way="blocked").select(F.col(doc_id).alias("_of"), "cluster")
        return corpus.join(near, F.col(doc_id) == F.col("_of"), "left").drop("_of")
    sent = corpus.sparkSession.sparkContext.broadcast(
        (small.column(0).combine_chunks(), _matrix(small.column(1)))
    )

    @arrow_udf(centroids.schema["cluster"].dataType)
    def assign(vectors: pa.Array) -> pa.Array:
        ids, centers = sent.value
        ok = np.nonzero(~np.asarray(vectors.is_null()))[0]
        picked = vectors.take(pa.array(ok))
        _, ci, _ = _nearest_pairs(_matrix(picked), centers, _order_of(ids), 1, "l2sq")
        out = np.full(len(vectors), -1)
        out[ok] = ci
        return ids.take(pa.array(out, mask=out < 0))

    return corpus.withColumn("cluster", assign(F.col(doc_vec)))


def knn_ivf(
    queries: DataFrame,
    assigned: DataFrame,
    centroids: DataFrame,
    k: int = TOP_K,
    nprobe: int = NPROBE,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    query_vec: str = "query_vec",
    doc_vec: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top k among the rows of the ``nprobe`` nearest clusters of each query.

    Queries meet corpus rows only inside their clusters, and a large cluster is
    split into blocks. With the corpus stored by ``cluster`` only probed
    folders are read. ``nprobe`` = all clusters gives the exact result.
    """
    probes = knn(queries, centroids, nprobe, "l2sq", query_id, "cluster", query_vec, "center").select(query_id, "cluster")
    return clustered_search(queries, assigned, probes, k, query_id, doc_id, query_vec, doc_vec, block_rows)


def clustered_search(
    queries: DataFrame,
    assigned: DataFrame,
    probes: DataFrame,
    k: int = TOP_K,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    query_vec: str = "query_vec",
    doc_vec: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top k of every query among the rows (``assigned``: doc, vector, cluster) of its clusters (``probes``: query, cluster)."""
    probes = probes.select(F.col(query_id).alias("_q"), F.col("cluster").alias("_g"))
    q = queries.select(F.col(query_id).alias("_q"), F.col(query_vec).alias("_qv")).join(probes, "_q")
    d = assigned.where(F.col(doc_vec).isNotNull()).select(
        F.col("cluster").alias("_g"), F.col(doc_id).alias("_d"), F.col(doc_vec).alias("_dv")
    )
    schema = T.StructType([
        T.StructField("_q", q.schema["_q"].dataType),
        T.StructField("_d", d.schema["_d"].dataType),
        T.StructField("_v", T.DoubleType()),
    ])
    pairs = _blocked(q.select("_q", "_qv", "_g"), d, schema, k, "l2sq", None, block_rows)
    return _ranked(_named(pairs, "l2sq", query_id, doc_id), k, "l2sq", query_id, doc_id)
