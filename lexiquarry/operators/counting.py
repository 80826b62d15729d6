"""Counting the words of texts inside the tasks that read them, so that counts travel and not words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.text import tokens
from .common import spread

#: Words whose arrays a task holds at a time.
TOGETHER = 1_000_000


def word_lists(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _words) of all texts; a null text has no list."""
    return spread(df.select(id_col, text_col)).select(id_col, tokens(F.col(text_col)).alias("_words"))


def word_runs(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """For runs of rows with about TOGETHER words: the first row, words per row, the code of each word, the different words."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        coded = lists.slice(low, high - low).flatten().dictionary_encode()
        yield low, sizes[low:high], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        low = high


def _usable(sizes: np.ndarray, codes: np.ndarray, names: pa.Array, stop_words) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each word that is no stop word."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    if not stop_words:
        return row, codes
    keep = ~pc.is_in(names, value_set=pa.array(list(stop_words), pa.string())).to_numpy(zero_copy_only=False)[codes]
    return row[keep], codes[keep]


def gram_counts(lists: DataFrame, stop_words, low: int, high: int, only: list[str] | None = None) -> DataFrame:
    """(term, cf, df): occurrences and rows of each run of ``low`` to ``high`` words; two words or more only of words in ``only``, if given.

    Runs of rows are counted in the tasks and summed by term.
    """
    allowed = None if only is None else lists.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sizes, codes, names in word_runs(batch.column("_words")):
                row, codes = _usable(sizes, codes, names, stop_words)
                at, gram, terms = np.arange(len(codes)), codes, names
                fit = None if allowed is None else pc.is_in(names, value_set=pa.array(allowed.value, pa.string())).to_numpy(zero_copy_only=False)[codes]
                for n in range(1, high + 1):
                    if n > 1:
                        # A gram goes on with the next word of its row.
                        on = at + n - 1 < len(codes)
                        on[on] = row[at[on]] == row[at[on] + n - 1]
                        if fit is not None:
                            on[on] = fit[at[on]] & fit[at[on] + n - 1]
                        at = at[on]
                        known, gram = np.unique(gram[on] * len(names) + codes[at + n - 1], return_inverse=True)
                        terms = pc.binary_join_element_wise(terms.take(pa.array(known // max(len(names), 1))), names.take(pa.array(known % max(len(names), 1))), " ")
                    if n >= low and len(at):
                        cf = np.bincount(gram, minlength=len(terms))
                        rows = np.bincount(np.unique(row[at] * len(terms) + gram) % len(terms), minlength=len(terms))
                        seen = np.flatnonzero(cf)
                        yield pa.RecordBatch.from_arrays([terms.take(pa.array(seen)), pa.array(cf[seen]), pa.array(rows[seen])], ["term", "cf", "df"])

    found = lists.select("_words").mapInArrow(run, "term STRING, cf BIGINT, df BIGINT")
    return found.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


class Terms:
    """Terms of one or more words, found in coded texts word by word: the prefixes of each length have numbers."""

    def __init__(self, terms: list[str]):
        parts = [t.split(" ") for t in terms]
        self.n, self.names = len(terms), sorted({w for p in parts for w in p})
        code = {w: i for i, w in enumerate(self.names)}
        state = np.array([code[p[0]] for p in parts], np.int64)
        #: For each length: sorted keys (prefix before, word) of the prefixes, and the term that ends there or -1.
        self.levels: list[tuple[np.ndarray | None, np.ndarray]] = []
        here, keys, size = np.arange(len(parts)), None, len(self.names)
        while len(here):
            length = len(self.levels) + 1
            done = np.array([len(parts[i]) == length for i in here])
            ends = np.full(size, -1, np.int64)
            ends[state[here[done]]] = here[done]
            self.levels.append((keys, ends))
            here = here[~done]
            keys, inverse = np.unique(state[here] * len(self.names) + [code[parts[i][length]] for i in here], return_inverse=True)
            state[here], size = inverse, len(keys)

    def find(self, row: np.ndarray, codes: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of every occurrence of a term."""
        word = pc.fill_null(pc.index_in(names, value_set=pa.array(self.names, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        at = np.flatnonzero(word >= 0)
        state, rows, found = word[at], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (keys, ends) in enumerate(self.levels):
            if keys is not None:
                on = at + n < len(word)
                on[on] = (row[at[on]] == row[at[on] + n]) & (word[at[on] + n] >= 0)
                at, key = at[on], state[on] * len(self.names) + word[at[on] + n]
                state = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                at, state = at[keys[state] == key], state[keys[state] == key]
            hit = ends[state] >= 0
            rows.append(row[at[hit]])
            found.append(ends[state[hit]])
        return np.concatenate(rows), np.concatenate(found)


def term_counts(lists: DataFrame, terms: list[str], id_col: str, stop_words=()) -> DataFrame:
    """(id, nth, tf): how often the nth of ``terms`` is in a text. A few terms, which every task gets."""
    kind = lists.schema[id_col].dataType.simpleString()
    model = lists.sparkSession.sparkContext.broadcast(Terms(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            for first, sizes, codes, names in word_runs(batch.column("_words")):
                row, which = known.find(*_usable(sizes, codes, names, stop_words), names)
                key, tf = np.unique(row * max(known.n, 1) + which, return_counts=True)
                row, which = key // max(known.n, 1), key % max(known.n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row + first)), pa.array(which, pa.int32()), pa.array(tf, pa.int64())], [id_col, "nth", "tf"])

    return lists.mapInArrow(run, f"`{id_col}` {kind}, nth INT, tf BIGINT")
