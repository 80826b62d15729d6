"""Set similarity join of documents by n-gram Jaccard, with set-relation skipping.

1. A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets form a class and go on
   as one; that is skipping at its simplest, and a class may be of any size.
2. Prefix lists. Two sets that link share a token among the first ``n - ceil(0.8 n) + 1`` of either, in any common
   order of tokens. Tokens in a fixed part of the hash space (the zone) come first, and rarer tokens before more
   frequent ones; only sets with too few tokens in the zone list others. Frequencies are counted in one shuffle.
3. Stars. Every set of a list is compared with the list's smallest and largest set, never with all. Linked sets form
   components; most lists then lie within one component and are done.
4. Blocks. Sets that lists with several components connect form groups, and only sets of different components and of
   fitting size are compared, block against block. There the index lists keep their entries by position in blocks, and
   a block whose positions cannot reach the overlap is skipped. The overlaps of a set are derived from those of a
   similar set in its component: minus what it lacks, plus what it adds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import bounded_broadcast, fresh, settle
from .graph import components
from .words import mixed, runs, shingle_sets

#: Words of a shingle, and the similarity in percent that links.
SHINGLE = 5
PERCENT = 80
#: Share of the hash space that comes first in the order.
ZONE = 0.4
#: Frequencies from here on count as equal in the order.
FREQUENT = 64
#: A token in more than this share of the documents is dealt out by document, not to one task.
HEAVY = 0.01
#: Sets of a block that meets another in one task, and entries of an index list that are skipped as a whole.
BLOCK = 256
SKIP = 16

_ZONE_END = np.uint64(int(ZONE * 2**63))


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, tokens (63 bits, ascending within a text), starts."""
    for texts in runs(column):
        value, start = shingle_sets(texts, n)
        yield texts.first, value >> np.uint64(1), start


def _nodes(token: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A number for each set, the same for equal sets."""
    total = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mixed(token + np.uint64(1)), out=total[1:])
    return mixed((total[start[1:]] - total[start[:-1]]) ^ mixed(np.diff(start).astype(np.uint64))).view(np.int64)


def _prefix(size: np.ndarray, percent: int) -> np.ndarray:
    return size + (-percent * size) // 100 + 1


def describe(docs: DataFrame, text: str, key: str, n: int = SHINGLE) -> DataFrame:
    """key, text_hash, size, in_zone, node (identifies the set; null if empty), often (tokens frequent nearby, and how often)."""
    kind = docs.schema[key].dataType.simpleString()
    often_kind = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, zone, node, often = [], [], [], []
            for _, token, start in _sets(batch.column(text), n):
                count = np.diff(start)
                inside = np.concatenate([[0], np.cumsum(token < _ZONE_END)])
                size.append(count)
                zone.append(inside[start[1:]] - inside[start[:-1]])
                node.append(pa.array(_nodes(token, start), mask=count == 0))
                value, times = np.unique(token, return_counts=True)
                many = times > max(3, HEAVY / 2 * len(count))
                found = [{"token": t, "n": k} for t, k in zip(value[many].tolist(), times[many].tolist())]
                often += [found or None] + [None] * (len(count) - 1)
            if size:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), batch.column("text_hash"), pa.array(np.concatenate(size)), pa.array(np.concatenate(zone)),
                     pa.concat_arrays(node), pa.array(often, often_kind)],
                    [key, "text_hash", "size", "in_zone", "node", "often"],
                )

    return docs.select(key, text, F.xxhash64(text).alias("text_hash")).mapInArrow(
        run, f"`{key}` {kind}, text_hash BIGINT, size BIGINT, in_zone BIGINT, node BIGINT, often ARRAY<STRUCT<token: BIGINT, n: BIGINT>>"
    )


def _tokens(docs: DataFrame, text: str, n: int, percent: int, only_listed: bool) -> DataFrame:
    """node and token of what is listed, or node and all its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, token, start in _sets(batch.column(text), n):
                nodes, count = _nodes(token, start), np.diff(start)
                if only_listed:
                    owner = np.repeat(np.arange(len(count)), count)
                    inside = token < _ZONE_END
                    enough = np.bincount(owner[inside], minlength=len(count)) >= _prefix(count, percent)
                    listed = inside | ~enough[owner]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[owner[listed]]), pa.array(token[listed].astype(np.int64))], ["node", "token"]
                    )
                else:
                    lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(token.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), lists], ["node", "tokens"])

    return docs.select(text).mapInArrow(run, "node BIGINT, token BIGINT" if only_listed else "node BIGINT, tokens ARRAY<BIGINT>")


def _frequencies(listed: DataFrame, heavy: DataFrame) -> DataFrame:
    """node, token, df (at most FREQUENT) of tokens that two or more nodes list."""
    heavy = bounded_broadcast(heavy)
    salted = listed.join(heavy.withColumn("is_heavy", F.lit(True)), "token", "left").select(
        "token", "node", F.when(F.col("is_heavy"), F.pmod(F.col("node"), F.lit(4096))).otherwise(-1).cast("int").alias("salt")
    )
    parts = int(salted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in itertools.chain(batches, [None]):
            rows = rest
            if batch is not None:
                rows = [np.concatenate([old, batch.column(i).to_numpy(zero_copy_only=False)]) for i, old in enumerate(rest)]
            token, node, salt = rows
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, salt = token[new], node[new], salt[new]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            count = np.diff(np.r_[first, len(token)])
            df = np.repeat(np.minimum(count, FREQUENT), count)
            df[salt >= 0] = FREQUENT
            # The last token may go on in the next batch. Of a long run enough stays for the rest to count the same.
            cut = len(token) if batch is None else len(token) - FREQUENT if count[-1] > 2 * FREQUENT else first[-1]
            rest = [token[cut:], node[cut:], salt[cut:]]
            many = np.flatnonzero(df[:cut] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(node[many]), pa.array(token[many]), pa.array(df[many].astype(np.int32))], ["node", "token", "df"])

    return (
        salted.repartition(parts, "token", "salt").sortWithinPartitions("token", "node").mapInArrow(run, "node BIGINT, token BIGINT, df INT")
    )


def _lists(frequent: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """token, node, size, position of the tokens in every set's prefix that another set has too."""
    inside = F.col("token") < F.lit(int(_ZONE_END))
    shared = frequent.groupBy("node").agg(
        F.sort_array(F.collect_list(F.when(inside, F.struct("df", "token")))).alias("zone"),
        F.sort_array(F.collect_list(F.when(~inside, F.struct("df", "token")))).alias("other"),
    )
    joined = shared.join(classes.select("node", "size", "in_zone"), "node")
    prefix = F.col("size") + F.floor(-F.lit(percent) * F.col("size") / 100) + 1
    # Tokens that nobody else has come first within the zone and within the rest.
    alone = F.col("in_zone") - F.size("zone")
    alone_other = F.col("size") - F.size("other")

    def taken(name: str, before: Column) -> Column:
        return F.transform(
            F.slice(name, F.lit(1), F.greatest(F.least(F.col("prefix") - before, F.size(name)), F.lit(0)).cast("int")),
            lambda x, i: F.struct(x["token"].alias("token"), (before + i).cast("int").alias("position")),
        )

    return (
        joined.withColumn("prefix", prefix)
        .select("node", "size", F.concat(taken("zone", alone), taken("other", alone_other)).alias("taken"))
        .select("node", F.col("size").cast("int").alias("size"), F.inline("taken"))
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("left")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("tokens").alias("right")), "b"
    )
    common = F.size(F.array_intersect("left", "right"))
    return joined.where(common * 100 >= (F.size("left") + F.size("right") - common) * percent).select("a", "b")


def _block_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components, each of ``left`` against ``right``."""
    sizes, comp, nodes = (right[c].to_numpy() for c in ("size", "component", "node"))
    tokens = np.concatenate(right["tokens"].to_list())
    owner = np.repeat(np.arange(len(right)), sizes)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((place, tokens))
    tokens, owner, place = tokens[order], owner[order], place[order]
    # Index lists hold the tokens of prefixes, by position; SKIP entries in a row are a block with bounds of its own.
    listed = np.flatnonzero(place < _prefix(sizes, percent)[owner])
    list_token, list_owner, list_place = tokens[listed], owner[listed], place[listed]
    edge = np.arange(0, len(listed), SKIP)
    low_place, high_place = np.minimum.reduceat(list_place, edge), np.maximum.reduceat(list_place, edge)
    low_size, high_size = np.minimum.reduceat(sizes[list_owner], edge), np.maximum.reduceat(sizes[list_owner], edge)

    def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every number of the ranges, and the range that it is from."""
        width = last - first
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
        return at, np.repeat(np.arange(len(first)), width)

    def candidates(own: np.ndarray) -> np.ndarray:
        size = len(own)
        head = own[: int(_prefix(np.array([size]), percent)[0])]
        first, last = np.searchsorted(list_token, head, "left"), np.searchsorted(list_token, head, "right")
        hit = np.flatnonzero(last > first)
        block, of = spread(first[hit] // SKIP, (last[hit] - 1) // SKIP + 1)
        at = hit[of]
        reach = np.minimum(at, high_place[block]) + 1 + np.minimum(size - at - 1, high_size[block] - low_place[block] - 1)
        open_ = (100 + percent) * reach >= percent * (size + low_size[block])
        block, at = block[open_], at[open_]
        entry, of = spread(np.maximum(first[at], block * SKIP), np.minimum(last[at], (block + 1) * SKIP))
        j, i, other = list_place[entry], at[of], sizes[list_owner[entry]]
        reach = np.minimum(i, j) + 1 + np.minimum(size - i - 1, other - j - 1)
        alive = np.zeros(len(right), bool)
        alive[list_owner[entry[(100 + percent) * reach >= percent * (size + other)]]] = True
        return alive

    def overlaps(some: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(tokens, some, "left"), np.searchsorted(tokens, some, "right")
        hit = last > first
        return np.bincount(owner[spread(first[hit], last[hit])[0]], minlength=len(right))

    found = []
    for group, members in left.groupby("component", sort=False):
        leader = leader_overlap = None
        for node, size, own in zip(members["node"], members["size"], members["tokens"]):
            alive = candidates(own) & (comp != group)
            if leader is not None and alive.any():
                adds = np.setdiff1d(own, leader, assume_unique=True)
                alive &= (100 + percent) * (leader_overlap + len(adds)) >= percent * (size + sizes)
            if not alive.any():
                continue
            if leader is None:
                leader, leader_overlap = own, overlaps(own)
                overlap = leader_overlap
            else:
                lacks = np.setdiff1d(leader, own, assume_unique=True)
                if len(lacks) + len(adds) < len(own):
                    overlap = leader_overlap - overlaps(lacks) + overlaps(adds)
                else:
                    overlap = overlaps(own)
            links = alive & ((100 + percent) * overlap >= percent * (size + sizes))
            found += [(int(node), int(x)) for x in nodes[links]]
    return found


def _cross_links(placed: DataFrame, sets: DataFrame, percent: int, count: int) -> DataFrame:
    """Links (a, b) between sets of different components within a group; placed: group, node, size, component; ``count`` documents.

    Sets of a group meet only if their sizes are in the same or the next band, a factor of the similarity wide. A
    component with more than BLOCK sets in a group has blocks of its own, which never meet each other; the other
    sets share mixed blocks. Every pair of blocks that has to meet is one task's work, at most 2 * BLOCK sets or so.
    """
    inside = placed.groupBy("group", "component").count()
    large = settle(inside.where(F.col("count") > BLOCK).select(F.col("group").alias("of"), F.col("component").alias("own")), "large", count)
    banded = placed.join(
        bounded_broadcast(large), (F.col("group") == F.col("of")) & (F.col("component") == F.col("own")), "left"
    ).select(*placed.columns, "own", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int").alias("band"))
    banded = settle(banded, "banded", count)
    counted = banded.groupBy("group", "own", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    counted = bounded_broadcast(settle(counted, "bands", count))
    cells = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    a = cells.select("group", F.struct(F.coalesce("own", F.lit(-1)).alias("own"), "band", "part").alias("cell_a"))
    b = cells.select(F.col("group").alias("group_b"), F.struct(F.coalesce("own", F.lit(-1)).alias("own"), "band", "part").alias("cell_b"))
    meet = a.join(b, F.col("group") == F.col("group_b")).where(
        (F.col("cell_a") <= F.col("cell_b")) & (F.abs(F.col("cell_a.band") - F.col("cell_b.band")) <= 1)
        & ((F.col("cell_a.own") == -1) | (F.col("cell_a.own") != F.col("cell_b.own")))
    )
    same = F.col("cell_a") == F.col("cell_b")
    sides = meet.select(F.col("group").alias("of"), F.xxhash64("group", "cell_a", "cell_b").alias("pair"), F.explode(
        F.when(same, F.array(F.struct(F.col("cell_a").alias("cell"), F.lit(2).alias("side")))).otherwise(
            F.array(F.struct(F.col("cell_a").alias("cell"), F.lit(0).alias("side")), F.struct(F.col("cell_b").alias("cell"), F.lit(1).alias("side"))))
    ).alias("s")).select("of", "pair", "s.side", F.col("s.cell").alias("cell_of"))
    sides = bounded_broadcast(settle(sides, "blocks", 4 * count))
    dealt = banded.join(
        counted.select(F.col("group").alias("g"), F.coalesce("own", F.lit(-1)).alias("o"), F.col("band").alias("d"), "parts"),
        (F.col("group") == F.col("g")) & (F.coalesce("own", F.lit(-1)) == F.col("o")) & (F.col("band") == F.col("d")),
    ).select("group", "node", "size", "component", F.struct(
        F.coalesce("own", F.lit(-1)).alias("own"), "band", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")
    ).alias("cell"))
    rows = dealt.join(sides, (F.col("group") == F.col("of")) & (F.col("cell") == F.col("cell_of"))).select(
        "pair", "side", "node", "size", "component"
    ).join(sets, "node")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] != 1], group[group["side"] != 0]
        if len(left) and len(right) and group["component"].nunique() > 1:
            found = [(min(x), max(x)) for x in _block_links(left, right, percent)]
        else:
            found = []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("pair").applyInPandas(links, "a BIGINT, b BIGINT")


def similarity_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id, text_hash (of the text as it is) for every row of ``docs``.

    Two rows link if their sets of distinct ``n``-word shingles (A-Z in lower case) have a Jaccard similarity of at
    least ``percent``; component_id is the smallest key reachable by links, itself included. Shorter texts are one
    shingle; null, empty and blank texts have none, link with nothing and keep their own key. Repeated rows and rows
    with equal sets are in one component; rows with a null key take part, and have a null component_id only if nothing
    with a key is reachable. No link is lost: all steps before the comparison of sets keep every pair that can link.
    """
    sizes = materialize(describe(docs, text, key, n), "sizes")
    count = sizes.count()
    classes = settle(
        sizes.where("node IS NOT NULL").groupBy("node").agg(
            F.min(key).alias("least"), F.first("size").alias("size"), F.first("in_zone").alias("in_zone"), F.count(F.lit(1)).alias("n"),
            F.min(F.struct(F.col(key), F.col("text_hash"))).alias("chosen"),
        ), "classes", count,
    )
    heavy = settle(
        sizes.where("often IS NOT NULL").select(F.inline("often")).groupBy("token").agg(F.sum("n").alias("n"))
        .where(F.col("n") > HEAVY * count).select("token"), "heavy", count,
    )
    # One text of each class goes on; the others are known by key and text.
    twin = fresh(docs, "_text_hash")
    copies = sizes.where("node IS NOT NULL").join(
        classes.where("n > 1").select("node", "chosen"), "node"
    ).where(~(F.col(key).eqNullSafe(F.col(f"chosen.{key}")) & (F.col("text_hash") == F.col("chosen.text_hash")))).select(
        F.col(key).alias("_copy_key"), F.col("text_hash").alias("_copy_hash")
    ).distinct()
    copies = bounded_broadcast(settle(copies, "copies", count))
    named = docs.select(F.col(key).alias("_key"), F.col(text).alias(text), F.xxhash64(text).alias(twin))
    single = named.join(copies, F.col("_key").eqNullSafe(F.col("_copy_key")) & (F.col(twin) == F.col("_copy_hash")), "left_anti")

    listed = _tokens(single, text, n, percent, only_listed=True)
    frequent = _frequencies(listed, heavy)
    lists = materialize(_lists(frequent, classes, percent), "lists")

    # Lists with the same sets in them are one list.
    about = lists.groupBy("token").agg(
        F.count(F.lit(1)).alias("n_list"), F.bit_xor(F.xxhash64("node")).alias("mark"), F.min("node").alias("low"), F.max("node").alias("high")
    ).where("n_list > 1")
    about = settle(about.groupBy("n_list", "mark", "low", "high").agg(F.min("token").alias("token")).select("token", "low", "high"), "about", count)
    lists = materialize(lists.join(about, "token"), "distinct_lists")

    nodes = lists.select("node").distinct()
    wanted = classes.join(nodes, "node", "left_semi").select(
        F.col("node"), F.col(f"chosen.{key}").alias("_want_key"), F.col("chosen.text_hash").alias("_want_hash")
    )
    wanted = bounded_broadcast(settle(wanted, "wanted", count))
    texts = named.join(wanted, F.col("_key").eqNullSafe(F.col("_want_key")) & (F.col(twin) == F.col("_want_hash")))
    sets = materialize(_tokens(texts, text, n, percent, only_listed=False).dropDuplicates(["node"]), "sets")

    size_of = F.col("size").cast("bigint")
    stars = lists.select(F.col("node").alias("a"), size_of.alias("size"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    known = materialize(_verified(stars, sets, percent), "stars")
    n_known = known.count()
    first = settle(components(known, n_known), "components", n_known)

    labelled = lists.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_lists = labelled.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("token", "c1")
    still = materialize(labelled.join(open_lists, "token").select("node", "size", "component", "c1"), "open")
    # Components that meet in open lists form groups; each set is sent to its group once, however many lists it is in.
    meet = settle(still.select("component", "c1").distinct(), "meet", count)
    groups = components(meet, meet.count(), "component", "c1").select(F.col("node").alias("component"), F.col("component").alias("group"))
    placed = settle(still.select("node", "size", "component").distinct().join(groups, "component"), "placed", count)
    cross = materialize(_cross_links(placed, sets, percent, count), "cross")
    links = known.unionAll(cross)
    found = components(links, links.count())
    by_component = found.join(classes.select("node", "least"), "node").select(
        "component", "node", "least"
    )
    lowest = by_component.groupBy("component").agg(F.min("least").alias("lowest"))
    joined = settle(by_component.join(lowest, "component").select("node", "lowest"), "joined", count)
    of_class = classes.join(joined, "node", "left").select("node", F.coalesce("lowest", "least").alias("component_id"))
    return sizes.join(of_class, "node", "left").select(
        F.col(key), F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"), "text_hash",
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest key. Rows with the same key and text stay together."""
    gone = similarity_classes(docs, text, key, n, percent).where(F.col(key) != F.col("component_id")).select(
        F.col(key).alias("_gone_key"), F.col("text_hash").alias("_gone_hash")
    ).distinct()
    gone = bounded_broadcast(materialize(gone, "gone"))
    return docs.join(gone, (F.col(key) == F.col("_gone_key")) & (F.xxhash64(text) == F.col("_gone_hash")), "left_anti")
