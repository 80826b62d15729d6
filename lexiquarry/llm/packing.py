"""Best-fit packing of token sequences with a bounded number of open bins.

Documents become token ids, those longer than a sequence are cut, and every piece goes to the open bin that it fills
best. Open bins are kept in a bitset keyed by their free space, so the best bin is the lowest set bit at or above the
piece's length. When too many bins are open, the fullest closes. A packer looks ahead over as many pieces as it may
have open bins, and takes the longest of them first.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .words import span_hashes

#: Fixed: tokens of a sequence, and the id that ends a document.
SEQUENCE = 2048
END_ID = 0
#: Open bins of one packer.
OPEN_BINS = 1024
#: Pieces that one packer takes in the rounds that pack again what was left open.
ROUND_PIECES = 100_000
#: Distinct words whose ids a worker remembers.
REMEMBERED = 300_000
#: New words that go through the tokenizer at a time.
NEW_WORDS = 2_000
#: Characters of text that are tokenized together, and rows whose texts and ids a worker holds at a time.
TOGETHER, ROWS = 1 << 18, 64

# Classes of Latin-1 characters: 0 white space, 1 letter, 2 number, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
for _c in range(256):
    if chr(_c).isspace() and not 0x1C <= _c <= 0x1F:
        _CLASS[_c] = 0
    elif unicodedata.category(chr(_c)).startswith("L"):
        _CLASS[_c] = 1
        if len(chr(_c).lower()) == 1 and ord(chr(_c).lower()) < 256:
            _LOWER[_c] = ord(chr(_c).lower())
    elif unicodedata.category(chr(_c)).startswith("N"):
        _CLASS[_c] = 2
# Endings that stand alone after an apostrophe.
_SHORT = [ord(c) for c in "stmd"]
_LONG = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]


class WordIds:
    """Token ids of texts: whole words from memory, new ones by the tokenizer.

    White space always ends a token, and the tokenizer looks at one run of letters, one digit or one run of other
    characters at a time. So a text of Latin-1 characters is cut into those with NumPy, and each different one is
    tokenized once. Other texts, and those with a special token's name, go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        # One tokenizer serves whole texts and single words; a second one would take as much memory again.
        self.tokenizer = Tokenizer.from_file(path)
        self.names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ways = {
            "whole": (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer),
            "single": (None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)),
        }
        self.way = "whole"
        self.forget()

    def forget(self) -> None:
        """Words are held as sorted hashes with the place and number of their ids in one pool."""
        self.keys, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _tokenizer(self, way: str):
        if way != self.way:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.ways[way]
            self.way = way
        return self.tokenizer

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add the ids of new words; keys: their hashes, sorted."""
        found, sizes = [self.pool], np.zeros(len(words), np.int32)
        single = self._tokenizer("single")
        for low in range(0, len(words), NEW_WORDS):
            ids = [e.ids for e in single.encode_batch_fast(words[low : low + NEW_WORDS], add_special_tokens=False)]
            sizes[low : low + len(ids)] = [len(i) for i in ids]
            found.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32))
        at = np.searchsorted(self.keys, keys)
        self.place = np.insert(self.place, at, len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes)
        self.size = np.insert(self.size, at, sizes)
        self.keys = np.insert(self.keys, at, keys)
        self.pool = np.concatenate(found)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, the end id last."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, raw = [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.array([END_ID], np.uint32)
                continue
            try:
                code = text.encode("latin-1")
                if any(n in text for n in self.names):
                    raise ValueError
                plain.append(i)
                raw.append(code)
            except ValueError:  # also what encode raises
                ids = self._tokenizer("whole").encode(text, add_special_tokens=False).ids
                out[i] = np.array([*ids, END_ID], np.uint32)
        at = 0
        while at < len(plain):
            to, size = at, 0
            while to < len(plain) and (to == at or size + len(raw[to]) <= TOGETHER):
                size += len(raw[to]) + 1
                to += 1
            for i, ids in zip(plain[at:to], self._plain(raw[at:to])):
                out[i] = ids
            at = to
        return out

    def _plain(self, raw: list[bytes]) -> list[np.ndarray]:
        data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        kind = _CLASS[data]
        n = len(data)
        start = kind != 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        mark = np.flatnonzero((data[:-1] == 39) & start[:-1])
        if len(mark):
            padded = np.concatenate([data, np.zeros(3, np.uint8)])
            a, b = padded[mark + 1], padded[mark + 2]
            short = np.isin(a, _SHORT)
            long = np.zeros(len(mark), bool)
            for x, y in _LONG:
                long |= (a == x) & (b == y)
            for at, size in ((mark[short], 2), (mark[long], 3)):
                start[at + 1] = False
                follow = at + size
                follow = follow[follow < n]
                start[follow[kind[follow] == 1]] = True
        at = np.flatnonzero(start)
        # A span ends where the next one starts or at white space.
        space = np.flatnonzero(kind == 0)
        end = np.minimum(np.append(at[1:], n), space[np.searchsorted(space, at)])
        keys, first, which = np.unique(span_hashes(data, at, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
        if len(new):
            text = data.tobytes().decode("latin-1")
            self._learn(keys[new], [text[at[j] : end[j]] for j in first[new].tolist()])
        listed = np.searchsorted(self.keys, keys)[which]
        size, offset, pool = self.size[listed].astype(np.int64), self.place[listed], self.pool
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.arange(total) - np.repeat(ends - size - offset, size)] if total else np.zeros(0, np.uint32)
        borders = np.cumsum([len(r) + 1 for r in raw])
        cut = np.searchsorted(at, borders)
        cut = np.where(cut > 0, ends[np.maximum(cut, 1) - 1], 0) if len(ends) else np.zeros(len(raw), np.int64)
        last = np.array([END_ID], np.uint32)
        return [np.concatenate([part, last]) for part in np.split(ids, cut[:-1])]


_tokenizers: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", sequence: int = SEQUENCE) -> DataFrame:
    """key, piece, start, length, ids (binary, little-endian unsigned 32-bit): a document's ids in pieces.

    Null and empty texts are the end id alone. Only documents longer than ``sequence`` are cut.
    """
    kind = docs.schema[key].dataType.simpleString()

    def pieces_of(ids_of: WordIds, rows: pa.RecordBatch) -> pa.RecordBatch:
        found = ids_of(rows.column(text).to_pylist())
        owner, piece, start, length, ids = [], [], [], [], []
        for i, all_ids in enumerate(found):
            for p, at in enumerate(range(0, len(all_ids), sequence)):
                part = all_ids[at : at + sequence]
                owner.append(i)
                piece.append(p)
                start.append(at)
                length.append(len(part))
                ids.append(part.astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays(
            [rows.column(key).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
            [key, "piece", "start", "length", "ids"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = WordIds(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                yield pieces_of(_tokenizers[tokenizer], batch.slice(low, ROWS))
            del batch  # before the next one is read

    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, piece INT, start BIGINT, length BIGINT, ids BINARY")


class Packer:
    """Online best fit with at most ``bins`` open bins; a piece is placed in constant time."""

    def __init__(self, size: int, bins: int):
        self.size, self.bins = size, bins
        self.free = 0  # bit f: a bin with f tokens free is open
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = self.made = 0

    def place(self, length: int) -> int:
        """The bin of a piece, by number of opening."""
        fit = self.free >> length
        if fit:
            free = (fit & -fit).bit_length() - 1 + length
            number = self._take(free)
        else:
            if self.count >= self.bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            free, number = self.size, self.made
            self.made += 1
        if free > length:
            left = free - length
            self.open[left].append(number)
            self.free |= 1 << left
            self.count += 1
        return number

    def _take(self, free: int) -> int:
        number = self.open[free].pop()
        self.count -= 1
        if not self.open[free]:
            self.free &= ~(1 << free)
        return number

    def still_open(self) -> set[int]:
        return {n for bins in self.open for n in bins}


def _pack_round(pieces: DataFrame, sequence: int, bins: int, last: bool) -> DataFrame:
    """Pieces with _bin, _task, offset and _open: whether the bin was open at the end."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, packer, filled, held = TaskContext.get().partitionId(), Packer(sequence, bins), {}, None

        def out(table: pa.Table, is_open: bool) -> list[pa.RecordBatch]:
            return table.append_column("_open", pa.array(np.full(len(table), is_open))).to_batches()

        ahead = (b.slice(low, bins) for b in batches for low in range(0, b.num_rows, bins))
        for batch in ahead:
            # Within what the packer sees at once, the longest go first.
            batch = batch.take(np.argsort(-batch.column("length").to_numpy(), kind="stable"))
            numbers, offsets = [], []
            for length in batch.column("length").to_pylist():
                number = packer.place(length)
                numbers.append(number)
                offsets.append(filled.get(number, 0))
                filled[number] = offsets[-1] + length
            rows = pa.Table.from_batches([batch])
            for name, values in (("_bin", numbers), ("_task", [task] * len(numbers)), ("offset", offsets)):
                rows = rows.append_column(name, pa.array(values, pa.int64()))
            rows = rows if held is None else pa.concat_tables([held, rows])
            open_now = packer.still_open()
            waits = np.isin(rows["_bin"].to_numpy(), np.fromiter(open_now, np.int64, len(open_now)))
            filled = {n: filled[n] for n in open_now}
            held = rows.filter(pa.array(waits))
            yield from out(rows.filter(pa.array(~waits)), False)
        if held is not None:
            yield from out(held, not last)

    return pieces.mapInArrow(pack, f"{fields}, _bin BIGINT, _task BIGINT, offset BIGINT, _open BOOLEAN")


def pack(pieces: DataFrame, sequence: int = SEQUENCE, bins: int = OPEN_BINS, together: int = ROUND_PIECES) -> DataFrame:
    """``pieces`` (with length, at most ``sequence``) with sequence_id and offset.

    Pieces are written first, and every task packs what it reads of them: in one stage, each task would have a worker
    that makes pieces and another one that packs them, both in memory. The pieces of bins that are still open at its end are packed again in fewer tasks
    of about ``together`` pieces, until one task is left: each round keeps at most ``bins`` bins of a task, so the rows
    fall by a constant factor. Columns named sequence_id and offset are replaced; other columns stay. Equal rows are
    packed each on their own. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces.drop("sequence_id", "offset"), "pieces")
    names, done, level = pieces.columns, [], 0
    n = None
    while True:
        last = n is not None and n <= together
        if n is not None:
            pieces = pieces.repartition(max(1, -(-n // together)), F.xxhash64(*names)) if n > together else pieces.coalesce(1)
        packed = materialize(_pack_round(pieces, sequence, bins, last), "packed")
        number = (F.lit(level).cast("bigint") * (1 << 58)) + F.col("_task") * (1 << 34) + F.col("_bin")
        done.append(packed.where(~F.col("_open")).select(*names, number.alias("sequence_id"), "offset"))
        if last:
            break
        pieces = packed.where("_open").select(*names)
        n = pieces.count()
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out
