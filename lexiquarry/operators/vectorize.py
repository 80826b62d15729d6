"""Texts to vectors: TF-IDF, word vectors, plugged-in encoders, pooling."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..functions.text import ngrams, once, tokens
from ..params import BROADCAST_ROWS, EMBEDDING_DIM, ENCODE_BATCH, TFIDF_FEATURES, WORD2VEC
from ..session import materialize
from .common import spread
from .counting import gram_counts, term_counts, word_lists

#: Tokens of the shards that word vectors are trained on, weight of a word's negative samples, and samples drawn at a time.
SHARD_TOKENS, NEGATIVE, SAMPLES = 2_000_000, 5, 64
#: Words of one training step, and changes of one word in it.
_TOGETHER, _MOST = 512, 16


def english_stop_words() -> list[str]:
    """Spark's own English stop words."""
    return StopWordsRemover.loadDefaultStopWords("english")


# ---- TF-IDF -------------------------------------------------------------------------

def tfidf_fit(
    df: DataFrame,
    max_features: int = TFIDF_FEATURES,
    use_idf: bool = True,
    stop_words=(),
    ngram_range: tuple[int, int] = (1, 2),
    id_col: str = "doc_id",
    text_col: str = "content",
) -> DataFrame:
    """Vocabulary (idx, term, cf, df, idf): the ``max_features`` terms most frequent in the corpus.

    Grams are counted where texts are read, so one row of each run of texts and
    term is shuffled. Words are counted first: a run of words is not more
    frequent than any of its words, so if there are ``max_features`` words, runs
    of less frequent ones than those are not counted. The cut to the top terms
    is a distributed top-k, so only the kept terms meet in one task.
    """
    lists, (low, high), order = word_lists(df, id_col, text_col), ngram_range, [F.col("cf").desc(), "term"]
    if low == 1 < high:
        words = materialize(gram_counts(lists, stop_words, 1, 1), "words")
        first = words.orderBy(*order).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("least")).head()
        only = words.where(F.col("cf") >= first.least).select("term").limit(BROADCAST_ROWS + 1).collect() if first.n == max_features else []
        only = [r.term for r in only] if 0 < len(only) <= BROADCAST_ROWS else None
        counts = words.unionAll(gram_counts(lists, stop_words, 2, high, only))
    else:
        counts = gram_counts(lists, stop_words, low, high)
    top = counts.orderBy(*order).limit(max_features)
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.log((1 + total) / (1 + F.col("df"))) + 1 if use_idf else F.lit(1.0)
    return top.select(
        (F.row_number().over(Window.orderBy("term")) - 1).cast("bigint").alias("idx"), "term", "cf", "df",
        idf.alias("idf"),
    )


def tfidf_vocab(vocab: DataFrame) -> DataFrame:
    """Feature names in index order."""
    return vocab.select("idx", "term")


def tfidf_transform(
    df: DataFrame,
    vocab: DataFrame,
    stop_words=(),
    ngram_range: tuple[int, int] = (1, 2),
    id_col: str = "doc_id",
    text_col: str = "content",
) -> DataFrame:
    """Sparse rows (doc, idx, term, weight) of unit length; texts without known terms have no rows.

    ``vocab`` should be a stored table (see ``save_model``), not a fit still to run.
    Terms outside the vocabulary are dropped before the one shuffle, by
    document; counting and the length both use that partitioning. Terms of a
    vocabulary that every task can get are counted before it, text by text.
    """
    usable = vocab.select("term", "idx", "idf").where(F.size(F.split("term", " ")).between(*ngram_range))
    few = usable.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:
        found = term_counts(word_lists(df, id_col, text_col), [r.term for r in few], id_col, stop_words)
        numbered = df.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(few)], T.StructType([T.StructField("nth", T.IntegerType()), *usable.schema]))
        sums = found.repartition(id_col).groupBy(id_col, "nth").agg(F.sum("tf").alias("tf"))
        counted = sums.join(F.broadcast(numbered), "nth")
    else:
        texts = word_lists(df, id_col, text_col).select(id_col, ngrams(F.col("_words"), stop_words, *ngram_range).alias("_grams"))
        known = texts.select(id_col, F.explode(once(F.col("_grams"))).alias("term")).join(usable, "term").repartition(id_col)
        counted = known.groupBy(id_col, "idx", "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
    weighted = counted.withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "idx", "term", (F.col("w") / length).alias("weight"))


# ---- word vectors -------------------------------------------------------------------

def _add_rows(table: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """``table[rows] += change`` where rows repeat; a row moves as far as ``_MOST`` changes at most, or frequent words would run away."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    times = np.diff(np.append(starts, len(rows)))
    table[rows[starts]] += np.add.reduceat(change[order], starts, axis=0) * np.minimum(1, _MOST / times).astype(np.float32)[:, None]


def _first_vectors(words: pa.Array, dim: int, seed: int) -> np.ndarray:
    """Small vectors that depend on the word and the seed alone, so that every shard starts a word at the same place."""
    with np.errstate(over="ignore"):
        x = np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.uint64, len(words))[:, None] << np.uint64(16)
        x = x + np.arange(dim, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(40)).astype(np.float32) / (1 << 24) - 0.5) / dim


def _train_shard(codes: np.ndarray, text: np.ndarray, vectors: np.ndarray, window: int, passes: int, seed: int) -> None:
    """Passes of CBOW with negative samples over a shard, in place; codes: word of each token; text: number of its text."""
    rng = np.random.default_rng(seed)
    out = np.zeros_like(vectors)
    share = np.cumsum(np.bincount(codes, minlength=len(vectors)) ** 0.75)
    offsets = np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])
    n, done = len(codes), 0
    for _ in range(passes):
        for at in range(0, n, _TOGETHER):
            place = np.arange(at, min(n, at + _TOGETHER))
            near = place[:, None] + offsets
            # As in word2vec, a window is as wide as drawn for its word.
            used = (near >= 0) & (near < n) & (np.abs(offsets) <= rng.integers(1, window + 1, len(place))[:, None])
            near = np.clip(near, 0, n - 1)
            used &= text[near] == text[place][:, None]
            some = used.any(axis=1)
            place, near, used = place[some], near[some], used[some]
            rate = np.float32(max(1e-4, 0.025 * (1 - done / (passes * n))))
            done += _TOGETHER
            if not len(place):
                continue
            sizes = used.sum(axis=1)
            context = codes[near[used]]
            hidden = np.add.reduceat(vectors[context], np.cumsum(sizes) - sizes, axis=0) / sizes.astype(np.float32)[:, None]
            word = codes[place]
            guess = _sigmoid(np.einsum("bd,bd->b", hidden, out[word]))
            step = (1 - guess) * rate
            change = step[:, None] * out[word]
            # One draw of samples serves all words of a step; a sample that is the word itself teaches nothing.
            drawn = np.unique(np.minimum(np.searchsorted(share, rng.random(SAMPLES) * share[-1], side="right"), len(vectors) - 1))
            away = _sigmoid(hidden @ out[drawn].T) * (-rate * NEGATIVE / len(drawn))
            away[word[:, None] == drawn] = 0
            change += away @ out[drawn]
            _add_rows(out, word, step[:, None] * hidden)
            out[drawn] += away.T @ hidden
            _add_rows(vectors, context, np.repeat(change, sizes, axis=0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -6, 6)))


def _known_words(words: DataFrame, min_count: int) -> DataFrame:
    """Token lists without the words that occur fewer times than ``min_count`` in all texts."""
    placed = words.withColumn("text", F.monotonically_increasing_id())
    placed = materialize(placed, "tokens").select("text", F.posexplode("words").alias("place", "word"))
    kept = placed.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).select("word")
    lists = placed.join(kept, "word").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
    return lists.select(F.col("words.word").alias("words"))


def word2vec_fit(df: DataFrame, text_col: str = "content", seed: int = 7, partitions: int | None = None, max_iter: int = 1, **params) -> DataFrame:
    """Train word vectors (CBOW with negative samples); returns the written table of words (word, vec).

    Texts stay in their tasks. A task trains on shards of at most ``SHARD_TOKENS`` tokens, ``max_iter`` passes each, with
    the shard's words only; a word's vector is the mean of its vectors in all shards, weighted by its occurrences there.
    So neither the driver nor a task holds the vocabulary. Every shard starts a word at the same vector, given by word
    and seed. Texts are dealt out to ``partitions`` tasks if given; the same seed and tasks give the same vectors.
    """
    opts = {**WORD2VEC, **params}
    dim, window = opts["vector_size"], opts["window"]
    texts = df.select(text_col)
    texts = texts.repartition(partitions) if partitions else spread(texts)
    words = texts.select(tokens(F.col(text_col)).alias("words"))
    if opts["min_count"] > 1:
        words = _known_words(words, opts["min_count"])
        words = words.repartition(partitions) if partitions else words

    def shard_vectors(lists: list[pa.Array], number: int) -> Iterator[pa.RecordBatch]:
        lists = pa.concat_arrays(lists)
        text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        codes, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if not len(codes):
            return
        vectors = _first_vectors(known, dim, seed)
        _train_shard(codes, text, vectors, window, max_iter, seed + number)
        counts = np.bincount(codes, minlength=len(known))
        for at in range(0, len(known), _TOGETHER):
            some = vectors[at : at + _TOGETHER]
            yield pa.RecordBatch.from_arrays(
                [known.slice(at, len(some)), _lists(some), pa.array(counts[at : at + _TOGETHER], pa.int64())], ["word", "vec", "n"]
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, size, number = [], 0, 0
        for batch in batches:
            column = batch.column(0).fill_null([]) if batch.column(0).null_count else batch.column(0)
            ends = column.offsets.to_numpy()
            offset = 0
            # Rows are cut where the shard is full; a text longer than a shard goes on in the next one.
            while offset < ends[-1] - ends[0]:
                upto = min(ends[-1] - ends[0], offset + SHARD_TOKENS - size)
                inner = np.clip(ends - ends[0], offset, upto) - offset
                inner = inner[np.append(True, np.diff(inner) > 0)]
                values = column.values.slice(ends[0] + offset, upto - offset)
                lists.append(pa.ListArray.from_arrays(pa.array(inner, pa.int32()), values))
                size += int(upto - offset)
                offset = upto
                if size >= SHARD_TOKENS:
                    yield from shard_vectors(lists, number)
                    lists, size, number = [], 0, number + 1
        if lists:
            yield from shard_vectors(lists, number)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words come sorted; the last one of a batch may go on in the next."""
        word, total, weight = None, np.zeros(dim), 0

        def out(words: pa.Array, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([words, _lists((sums / counts[:, None]).astype(np.float32))], ["word", "vec"])

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column("word").dictionary_encode()
            starts = np.flatnonzero(np.append(True, np.diff(runs.indices.to_numpy()) != 0))
            n = batch.column("n").to_numpy()
            rows = batch.column("vec").flatten().to_numpy().reshape(len(n), dim).astype(np.float64) * n[:, None]
            sums, counts = np.add.reduceat(rows, starts, axis=0), np.add.reduceat(n, starts)
            names = runs.dictionary
            if word is not None and names[0].as_py() == word:
                sums[0] += total
                counts[0] += weight
            elif word is not None:
                yield out(pa.array([word], pa.string()), total[None], np.array([weight]))
            word, total, weight = names[len(names) - 1].as_py(), sums[-1], int(counts[-1])
            if len(names) > 1:
                yield out(names.slice(0, len(names) - 1), sums[:-1], counts[:-1])
        if word is not None:
            yield out(pa.array([word], pa.string()), total[None], np.array([weight]))

    shards = words.mapInArrow(train, "word STRING, vec ARRAY<FLOAT>, n BIGINT")
    return materialize(shards.repartition("word").sortWithinPartitions("word").mapInArrow(average, "word STRING, vec ARRAY<FLOAT>"), "word-vectors")


def _lists(rows: np.ndarray) -> pa.Array:
    """A list per row of a matrix of floats."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()))


def word_table(model) -> DataFrame:
    """word, vec of a table of word vectors or of an MLlib model."""
    if isinstance(model, DataFrame):
        return model.select("word", F.col("vec").cast("array<double>").alias("vec"))
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def mean_vectors(df: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
    """Mean vector per group; partial sums are merged, so a hot group costs one small buffer per task."""
    return df.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>")))).alias("vec")
    )


def mean_word_vectors(
    docs: DataFrame, words: DataFrame, dim: int, id_col: str = "doc_id", tokens_col: str = "tokens"
) -> DataFrame:
    """Mean vector of the known words of each text; zeros if it has none."""
    known = docs.select(id_col, F.explode(once(F.col(tokens_col))).alias("word")).join(words.select("word", "vec"), "word")
    means = mean_vectors(known, [id_col], "vec")
    return docs.select(id_col).join(means, id_col, "left").select(
        id_col, F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec")
    )


def most_similar(words: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most similar words (query, word, similarity, rank); unknown query words have no rows."""
    from .search import knn

    known = queries.select(F.col("word").alias("query")).distinct().join(
        words.select(F.col("word").alias("query"), F.col("vec").alias("query_vec")), "query"
    )
    hits = knn(known, words, n + 1, "cosine", "query", "word", "query_vec", "vec")
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "word")
    return (
        hits.where(F.col("query") != F.col("word"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
    )


# ---- encoders -----------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = EMBEDDING_DIM) -> Encoder:
    """Encoder without a model: hashed words and word pairs, signed, unit length."""
    import re

    word, crc = re.compile(r"\w+"), zlib.crc32

    def encode(texts: list[str]) -> np.ndarray:
        codes, sizes = [], []
        for text in texts:
            words = [w.encode() for w in word.findall(text.lower())]
            single = list(map(crc, words))
            codes += single
            # The code of a pair goes on from the code of its first word.
            codes += [crc(w, crc(b" ", c)) for c, w in zip(single, words[1:])]
            sizes.append(max(0, 2 * len(words) - 1))
        found = np.array(codes, np.int64)
        at = np.repeat(np.arange(len(texts)), sizes) * dim + found % dim
        out = np.bincount(at, np.where(found >> 31, -1.0, 1.0), len(texts) * dim).astype(np.float32).reshape(len(texts), dim)
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=out, where=lengths > 0)

    return encode


def embed(
    df: DataFrame,
    make_encoder: Callable[[], Encoder],
    text_col: str = "content",
    out_col: str = "embedding",
    batch_size: int = ENCODE_BATCH,
    on_error: str = "null",
    dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """Add ``out_col`` with the vector of ``text_col``.

    ``make_encoder`` runs once per task. If a batch fails, its texts are tried
    one by one; a text that fails gets null and an ``embed_error``, or with
    ``on_error="zero"`` a zero vector.
    """

    def one_batch(encode: Encoder, texts: list[str]) -> list[tuple[Any, str | None]]:
        try:
            return [(v, None) for v in np.asarray(encode(texts), dtype=np.float32)]
        except Exception as error:
            if len(texts) > 1:
                return [pair for t in texts for pair in one_batch(encode, [t])]
            return [(np.zeros(dim, np.float32) if on_error == "zero" else None, str(error))]

    vector = pa.list_(pa.float32())

    @arrow_udf("embedding array<float>, error string")
    def encode_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Vectors become Arrow lists ``batch_size`` texts at a time; as Python lists a batch of them would take ten times the memory."""
        encode = make_encoder()
        for texts in batches:
            vectors, errors = [pa.array([], vector)], [pa.array([], pa.string())]
            for at in range(0, len(texts), batch_size):
                rows = one_batch(encode, [t or "" for t in texts.slice(at, batch_size).to_pylist()])
                vectors.append(pa.array([v for v, _ in rows], vector))
                errors.append(pa.array([e for _, e in rows], pa.string()))
            yield pa.StructArray.from_arrays([pa.concat_arrays(vectors), pa.concat_arrays(errors)], ["embedding", "error"])

    # Marked so that a filter on the result is not a reason to encode every text twice.
    encode_all = encode_all.asNondeterministic()

    done = spread(df).withColumn("_e", encode_all(F.col(text_col)))
    out = done.withColumn(out_col, F.col("_e.embedding"))
    if on_error != "zero":
        out = out.withColumn("embed_error", F.col("_e.error"))
    return out.drop("_e")


def mean_pool(
    tokens_df: DataFrame, id_col: str = "doc_id", mask_col: str = "mask", vec_col: str = "vec"
) -> DataFrame:
    """Mean of the token vectors whose mask is 1."""
    return mean_vectors(tokens_df.where(F.col(mask_col) == 1), [id_col], vec_col)


def cls_pool(tokens_df: DataFrame, id_col: str = "doc_id", pos_col: str = "pos", vec_col: str = "vec") -> DataFrame:
    """Vector of the first token."""
    return tokens_df.groupBy(id_col).agg(F.min_by(vec_col, pos_col).alias("vec"))


# ---- registry -----------------------------------------------------------------------

@dataclass
class VectorizerSpec:
    """A named way to add an ``embedding`` column; ``build(df, **config)`` returns the DataFrame."""

    build: Callable[..., DataFrame]
    defaults: dict[str, Any] = field(default_factory=dict)


def _tfidf_vectors(df: DataFrame, max_features: int, use_idf: bool, id_col="doc_id", text_col="content") -> DataFrame:
    vocab = materialize(
        tfidf_fit(df, max_features, use_idf, english_stop_words(), id_col=id_col, text_col=text_col), "vocabulary"
    )
    rows = tfidf_transform(df, vocab, english_stop_words(), id_col=id_col, text_col=text_col)
    # A document has at most max_features entries.
    sparse = rows.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), "weight"))).alias("_m")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(max_features - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))
    )
    zero = F.array_repeat(F.lit(0.0), max_features)
    return df.join(sparse, id_col, "left").withColumn("embedding", F.coalesce(F.when(F.col("_m").isNotNull(), dense), zero)).drop("_m")


def _word2vec_vectors(df: DataFrame, vector_size, window, min_count, id_col="doc_id", text_col="content") -> DataFrame:
    model = word2vec_fit(df, text_col, vector_size=vector_size, window=window, min_count=min_count)
    toks = df.select(id_col, tokens(F.col(text_col)).alias("tokens"))
    means = mean_word_vectors(toks, word_table(model), vector_size, id_col)
    return df.join(means.withColumnRenamed("vec", "embedding"), id_col)


def _hashed_vectors(df: DataFrame, dim: int, id_col="doc_id", text_col="content") -> DataFrame:
    return embed(df, lambda: hashing_encoder(dim), text_col, dim=dim)


VECTORIZERS: dict[str, VectorizerSpec] = {
    "tfidf": VectorizerSpec(_tfidf_vectors, {"max_features": TFIDF_FEATURES, "use_idf": True}),
    "word2vec": VectorizerSpec(_word2vec_vectors, dict(WORD2VEC)),
    "hashing": VectorizerSpec(_hashed_vectors, {"dim": EMBEDDING_DIM}),
}


def register_vectorizer(name: str, build: Callable[..., DataFrame], **defaults: Any) -> None:
    VECTORIZERS[name] = VectorizerSpec(build, defaults)


def vectorize(df: DataFrame, method: str, **config: Any) -> DataFrame:
    """Add ``embedding`` by a registered method; unknown names raise."""
    if method not in VECTORIZERS:
        raise ValueError(f"unknown vectorizer {method!r}; known: {sorted(VECTORIZERS)}")
    spec = VECTORIZERS[method]
    return spec.build(df, **{**spec.defaults, **config})
