"""Prefix trie of conversations: which of them begin with the same turns, and what sharing these would save.

A conversation is a path of turn digests. Paths are sorted, dealt out in ranges, and within a range every pair of
neighbours is an edge as deep as the turns they have in common. Union-find takes the edges from the deepest up; where
components meet, a branching node arises, so a range becomes a contracted forest whose chains are runs of nodes with
the same members. Only nodes that hold the first or the last path of a range can go on in another one. These are few
(two paths a range); they are merged over all ranges, and what lies below them joins them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import bounded_broadcast

#: Characters of a turn in a path: an MD5 in hex.
DIGEST = 32
#: Conversation ids in one piece of a list that is to be hashed, and rows of a frame.
PIECE, FRAME = 512, 20_000
#: Conversations of which one is the base, and the most turns taken from it.
FAMILY, OPENINGS = 20, 4

CLOSED, OPEN, ENDS = 0, 1, 2
_FOREST = (
    "kind INT, depth BIGINT, key STRING, parent_key STRING, conv_id BIGINT, parent_conv_id BIGINT, n_convs BIGINT, "
    "n_children BIGINT, n_leaves BIGINT, saved_tokens BIGINT, words BIGINT, ends STRING"
)
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text: turns from 1 in the order of turn (null first), then role and text; null texts become empty.

    Rows with a null conv_id take no part. Rows that repeat each other are turns of their own.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", F.row_number().over(order).cast("bigint").alias("place"), "role", "text")


def with_openings(turns: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """conv_id, place, role, text of numbered turns, rebuilt: a conversation's first h turns are those of its family's base.

    h is the CRC-32 of the id modulo ``openings``, the base of c is c - c % family. A conversation with no turn left
    has one row whose place, role and text are null.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(openings))
    base = turns.where((F.col("conv_id") % family == 0) & (F.col("place") < openings)).select(
        F.col("conv_id").alias("base"), F.col("place").alias("at"), F.col("role").alias("base_role"), F.col("text").alias("base_text")
    )
    # Every conversation has a first turn, so first turns list the conversations.
    ids = turns.where("place = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("of"))
    taken = ids.join(base, (F.col("of") == F.col("base")) & (F.col("at") <= F.col("h")), "left").select(
        "conv_id", "at", F.col("base_role").alias("role"), F.col("base_text").alias("text")
    )
    own = turns.where(F.col("place") > h).select("conv_id", (F.col("place") + openings).alias("at"), "role", "text")
    return taken.unionAll(own).withColumnRenamed("at", "place")


def _paths(turns: DataFrame) -> DataFrame:
    """conv_id, path, words: one row per conversation."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    one = F.when(F.col("place").isNotNull(), F.struct("place", digest.alias("digest"), words.alias("words")))
    return turns.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all")).select(
        "conv_id", F.array_join("all.digest", "").alias("path"), F.col("all.words").alias("words")
    )


def _common(a: str, b: str) -> int:
    """How many digests two paths begin with alike."""
    most, n = min(len(a), len(b)) // DIGEST, 0
    if b.startswith(a):
        return most
    while n < most and a[n * DIGEST : (n + 1) * DIGEST] == b[n * DIGEST : (n + 1) * DIGEST]:
        n += 1
    return n


class _Forest:
    """The contracted forest of sorted paths; a node is a run of paths, low to high, that agree down to its depth."""

    def __init__(self, ids: list[int], paths: list[str]):
        n = len(ids)
        self.depth = [len(p) // DIGEST for p in paths]
        self.low, self.high = list(range(n)), list(range(n))
        self.least, self.ended = list(ids), [1] * n
        self.up, self.below = [-1] * n, [[] for _ in range(n)]
        self.dead: set[int] = set()
        leader, top = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        shared = [0] + [_common(a, b) for a, b in zip(paths, paths[1:])]
        for i in sorted(range(1, n), key=lambda i: -shared[i]):
            a, b = find(i - 1), find(i)
            leader[b] = a
            top[a] = self._meet(top[a], top[b], shared[i])
        root = top[find(0)]
        if self.depth[root]:
            root = self._branch(0, root)
        self.root = root

    def _branch(self, depth: int, first: int) -> int:
        self.depth.append(depth)
        self.low.append(self.low[first])
        self.high.append(self.high[first])
        self.least.append(self.least[first])
        self.ended.append(0)
        self.up.append(-1)
        self.below.append([first])
        self.up[first] = len(self.depth) - 1
        return len(self.depth) - 1

    def _meet(self, a: int, b: int, depth: int) -> int:
        """The node of two neighbouring components that agree down to ``depth``."""
        node = a if self.depth[a] == depth else self._branch(depth, a)
        if self.depth[b] == depth:
            # Only a path that ends here can be as deep already.
            self.ended[node] += self.ended[b]
            self.dead.add(b)
        else:
            self.below[node].append(b)
            self.up[b] = node
        self.high[node] = self.high[b]
        self.least[node] = min(self.least[node], self.least[b])
        return node


def _grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of a range of sorted paths: closed ones whole, the others with what lies closed below them."""
    ids, paths, words = [], [], []
    for frame in frames:
        ids += frame["conv_id"].tolist()
        paths += frame["path"].tolist()
        words += frame["words"].tolist()
    if not ids:
        return
    forest, rows = _Forest(ids, paths), []
    size = len(forest.depth)
    leaves, saved, last = [0] * size, [0] * size, len(ids) - 1
    is_open = [forest.low[v] == 0 or forest.high[v] == last for v in range(size)]
    keys: dict[int, list[str]] = {}

    def key_at(item: int, depth: int) -> str:
        if item not in keys:
            state = hashlib.md5()
            keys[item] = [state.hexdigest()]
            for d in range(forest.depth[item]):
                state.update(paths[item][d * DIGEST : (d + 1) * DIGEST].encode())
                keys[item].append(state.hexdigest())
        return keys[item][depth]

    def spine(v: int) -> int:
        """The first or last path, by which an open node is named."""
        return 0 if forest.low[v] == 0 else last

    for v in sorted((v for v in range(size) if v not in forest.dead), key=lambda v: -forest.depth[v]):
        n, low, least = forest.high[v] - forest.low[v] + 1, forest.low[v], forest.least[v]
        closed = [k for k in forest.below[v] if not is_open[k]]
        children, total, inside = len(closed), sum(saved[k] for k in closed), sum(leaves[k] for k in closed)
        top = forest.depth[forest.up[v]] if forest.up[v] >= 0 else -1
        ended = ids[low : low + forest.ended[v]]
        if not is_open[v]:
            leaves[v] = max(inside, 1)
            ends = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()
            for d in range(forest.depth[v], top, -1):
                total += (n - 1) * int(words[low][d - 1])
                above, name = (least, None) if d - 1 > top else (forest.least[forest.up[v]], None)
                if d - 1 == top and is_open[forest.up[v]]:
                    above, name = None, key_at(spine(forest.up[v]), top)
                rows.append((CLOSED, d, None, name, least, above, n, children, leaves[v], total, None, ends))
                children, ends = 1, _NO_ENDS
            saved[v] = total
        else:
            for i in range(0, len(ended), PIECE):
                piece = ended[i : i + PIECE]
                rows.append((ENDS, forest.depth[v], key_at(spine(v), forest.depth[v]), None, piece[0], *[None] * 6, ",".join(map(str, piece))))
            for d in range(forest.depth[v], top, -1):
                name, above = key_at(spine(v), d), key_at(spine(v), d - 1) if d else None
                rows.append((OPEN, d, name, above, least, None, n, children, inside, total, int(words[low][d - 1]) if d else 0, None))
                children = inside = total = 0
        if len(rows) >= FRAME:
            yield _framed(rows)
            rows = []
    yield _framed(rows)


def _framed(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in _FOREST.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    whole = [n for n in names if n not in ("key", "parent_key", "ends")]
    return frame.astype({n: "Int64" for n in whole})


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open nodes of all ranges, deepest first and those of one key together, as whole nodes.

    What reaches this task is bounded by the ranges, not by the conversations: two paths a range.
    """
    nodes: dict[str, list] = {}
    for frame in frames:
        for depth, key, above, least, n, children, leaves, saved, words in zip(
            *(frame[c].tolist() for c in ("depth", "key", "parent_key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words"))
        ):
            node = nodes.setdefault(key, [depth, above, least, 0, 0, 0, 0, words])
            node[2] = min(node[2], least)
            for i, more in enumerate((n, children, leaves, saved)):
                node[3 + i] += more
    rows = []
    for key, (depth, above, least, n, children, leaves, saved, words) in nodes.items():
        leaves, saved = leaves if children else 1, saved + (n - 1) * words
        up = nodes.get(above)
        if up:
            up[4] += 1
            up[5] += leaves
            up[6] += saved
        rows.append((OPEN, depth, key, above, least, up[2] if up else None, n, children, leaves, saved, words, None))
    if rows:
        yield _framed(rows)


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One SHA-256 per key of its pieces in order, joined by commas."""
    now, state = None, hashlib.sha256()
    for frame in frames:
        out = []
        for key, piece in zip(frame["key"], frame["ends"]):
            if key != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(f",{piece}".encode())
        if out:
            yield pd.DataFrame(out, columns=["at", "sha"])
    if now is not None:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["at", "sha"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node.

    turns: conv_id, place, role, text with one order of places in a conversation; a null place names a conversation
    without turns. The root has depth 0; a table without conversations has no nodes. Equal conversations are spread
    over ranges by their ids. Columns besides these four are not looked at.
    """
    items = _paths(turns).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    forest = materialize(items.mapInPandas(_grow, _FOREST), "forest")
    rims = forest.where(F.col("kind") == OPEN).repartition(1).sortWithinPartitions(F.desc("depth"), "key")
    merged = materialize(rims.mapInPandas(_merge, _FOREST), "merged")
    pieces = forest.where(F.col("kind") == ENDS).select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = pieces.mapInPandas(_digests, "at STRING, sha STRING")
    whole = merged.join(ends, F.col("key") == F.col("at"), "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_NO_ENDS)))
    above = bounded_broadcast(merged.select(F.col("key").alias("at"), F.col("conv_id").alias("above")))
    closed = forest.where(F.col("kind") == CLOSED).join(above, F.col("parent_key") == F.col("at"), "left")
    closed = closed.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).withColumnRenamed("ends", "ends_sha256")
    return closed.select(*_NODE).unionAll(whole.select(*_NODE))
