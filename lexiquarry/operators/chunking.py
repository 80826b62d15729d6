"""Cutting texts into chunks.

Every cutter works inside the row that holds the text, so chunking never
shuffles; ``split_documents`` turns the chunk arrays into rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import bind, once
from ..params import (
    CHUNK_PRESETS,
    CJK_SEPARATORS,
    CODE_SEPARATORS,
    PARAGRAPH_PATTERN,
    SENTENCE_PATTERN,
    ChunkPreset,
)
from .common import spread

# Windows cut from one stretch of text before the next stretch is taken.
_STRETCH = 64
# Texts that are Python objects at a time.
_ROWS = 64


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters that overlap; text that fits stays whole, empty text has none.

    Finding character i in UTF-8 means walking to it. Cutting windows out of
    stretches of 64 windows keeps that walk short even in very long texts.
    """
    _check(size, overlap)
    step = size - overlap

    def cut(n: Column) -> Column:
        total = F.ceil((n - overlap) / F.lit(step)).cast("int")

        def stretch(b: Column) -> Column:
            piece = F.substring(text, b * _STRETCH * step + 1, F.lit((_STRETCH - 1) * step + size))
            here = F.least(F.lit(_STRETCH), total - b * _STRETCH)
            return bind(
                piece,
                lambda p: F.transform(
                    F.sequence(F.lit(0), here - 1), lambda i: F.substring(p, i * step + 1, F.lit(size))
                ),
            )

        blocks = F.sequence(F.lit(0), F.floor((total - 1) / _STRETCH).cast("int"))
        return (
            F.when(n == 0, F.array().cast("array<string>"))
            .when(n <= size, F.array(text))
            .otherwise(F.flatten(F.transform(blocks, stretch)))
        )

    return bind(F.coalesce(F.length(text), F.lit(0)), cut)


# ---- cuts that depend on earlier cuts: one linear pass per text ---------------

def _separator_cuts(text: str, size: int, overlap: int, separators) -> list[str]:
    """Cut each window behind its last separator, by priority; step back by the overlap.

    A separator counts only where the next window would start further on.
    """
    chunks, start = [], 0
    while start + size < len(text):
        end = start + size
        for mark in separators:
            at = text.rfind(mark, max(start, start + overlap + 1 - len(mark)), end)
            if at >= 0:
                end = at + len(mark)
                break
        chunks.append(text[start:end])
        start = end - overlap
    return chunks + [text[start:]] if text else []


def _windows(text: str, size: int, overlap: int) -> list[str]:
    if len(text) <= size:
        return [text]
    return [text[i : i + size] for i in range(0, len(text) - overlap, size - overlap)]


def _packed_pieces(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Pieces as they are if all fit; otherwise neighbours joined by a blank while they fit."""
    if max(map(len, pieces), default=0) <= size:
        return pieces
    groups: list[list[str]] = []
    room = 0
    for piece in pieces:
        if len(piece) > size:
            groups.extend([w] for w in _windows(piece, size, overlap))
            room = 0
        elif len(piece) <= room:
            groups[-1].append(piece)
            room -= len(piece) + 1
        else:
            groups.append([piece])
            room = size - len(piece)
    return [" ".join(g) for g in groups]


def _per_text(cutter):
    """Arrow UDF (text, preset name) -> chunks; texts arrive and leave in batches.

    Only a slice of a batch is Python objects at a time: a text, its chunks and their list take several times its bytes.
    """
    kind_of = pa.list_(pa.string())

    @arrow_udf("array<string>")
    def run(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        parts = [pa.array([], kind_of)]
        for low in range(0, len(texts), _ROWS):
            rows = zip(texts.slice(low, _ROWS).to_pylist(), kinds.slice(low, _ROWS).to_pylist())
            parts.append(pa.array([cutter(t, k) if t else [] for t, k in rows], type=kind_of))
        return pa.concat_arrays(parts)

    # Marked so that a filter on the chunks is not a reason to cut every text twice.
    return run.asNondeterministic()


def separator_chunks(text: Column, size: int, overlap: int, separators) -> Column:
    _check(size, overlap)
    marks = tuple(s for s in separators if s)
    run = _per_text(lambda t, _: _separator_cuts(t, size, overlap, marks))
    return run(text, F.lit(""))


def preset_chunks(text: Column, preset: Column, presets: dict[str, ChunkPreset] | None = None) -> Column:
    """Separator chunks with size, overlap and separators chosen per row by preset name."""
    table = {k: tuple(v) for k, v in (presets or CHUNK_PRESETS).items()}
    for size, overlap, _ in table.values():
        _check(size, overlap)
    fallback = table["auto"]
    run = _per_text(lambda t, k: _separator_cuts(t, *table.get(k, fallback)))
    return run(text, preset)


def regex_chunks(text: Column, size: int, overlap: int, pattern: str) -> Column:
    """Pieces between matches, stripped; joined up to ``size`` if any piece is longer than that."""
    _check(size, overlap)
    splitter = re.compile(pattern)

    def cut(t: str, _) -> list[str]:
        pieces = [p for p in map(str.strip, splitter.split(t)) if p]
        return _packed_pieces(pieces, size, overlap)

    return _per_text(cut)(text, F.lit(""))


def paragraph_chunks(text: Column, size: int, overlap: int) -> Column:
    return regex_chunks(text, size, overlap, PARAGRAPH_PATTERN)


def sentence_chunks(text: Column, size: int, overlap: int) -> Column:
    return regex_chunks(text, size, overlap, SENTENCE_PATTERN)


def code_chunks(text: Column, size: int, overlap: int) -> Column:
    return separator_chunks(text, size, overlap, CODE_SEPARATORS)


def cjk_chunks(text: Column, size: int, overlap: int) -> Column:
    return separator_chunks(text, size, overlap, CJK_SEPARATORS)


# ---- rows ---------------------------------------------------------------------

def explode_chunks(df: DataFrame, chunks: Column, text_col: str = "content") -> DataFrame:
    """One row per chunk: the other columns, ``chunk``, ``total_chunks`` and the chunk as ``text_col``."""
    keep = [c for c in df.columns if c != text_col]
    cut = spread(df).select(*keep, chunks.alias("_chunks"))
    return cut.select(
        *keep,
        F.size("_chunks").alias("total_chunks"),
        F.posexplode(once(F.col("_chunks"))).alias("chunk", text_col),
    )


def chunk_fixed(df: DataFrame, size: int, overlap: int, text_col: str = "content") -> DataFrame:
    return explode_chunks(df, fixed_chunks(F.col(text_col), size, overlap), text_col)


def chunk_separator(df: DataFrame, size: int, overlap: int, separators, text_col: str = "content") -> DataFrame:
    return explode_chunks(df, separator_chunks(F.col(text_col), size, overlap, separators), text_col)


def chunk_regex(df: DataFrame, size: int, overlap: int, pattern: str, text_col: str = "content") -> DataFrame:
    return explode_chunks(df, regex_chunks(F.col(text_col), size, overlap, pattern), text_col)


def split_documents(
    df: DataFrame,
    preset: str | Column = "auto",
    size: int | None = None,
    overlap: int | None = None,
    separators=None,
    text_col: str = "content",
    vectorizer=None,
) -> DataFrame:
    """Documents to chunks with a preset (a name, or a column of names); given values win, also zero.

    ``vectorizer`` is a function DataFrame -> DataFrame that adds a vector to the chunks.
    """

    def override(p: ChunkPreset) -> ChunkPreset:
        return ChunkPreset(
            p.size if size is None else size,
            p.overlap if overlap is None else overlap,
            p.separators if separators is None else tuple(s for s in separators if s),
        )

    if isinstance(preset, str):
        chosen = override(CHUNK_PRESETS[preset])
        chunks = separator_chunks(F.col(text_col), *chosen)
    else:
        chunks = preset_chunks(F.col(text_col), preset, {k: override(p) for k, p in CHUNK_PRESETS.items()})
    out = explode_chunks(df, chunks, text_col)
    return vectorizer(out) if vectorizer else out
