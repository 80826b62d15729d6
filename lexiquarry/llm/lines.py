"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one occurrence per connected group.

Lines are compared in a normal form: lower case, and a blank for every run of anything but letters and digits. Equal
lines are one line with many occurrences, so a line that a third of all documents hold is one row from each task.

A line is cut into five parts of words (of characters, if it is short or its script has no blanks), two of them counted
from its begin and two from its end. A part's SimHash, the majority of the hashed runs it consists of, is one block of
the line's signature. A SimHash over a whole line changes in many of its bits with every edit (one word of thirty
replaced: 5 of 64), and few near copies would have blocks in common; here an edit changes the blocks of the parts it is
in. Edits that leave any two of the five parts alone leave two blocks alone, so such lines share one of ten keys: an edit
anywhere, inserted or lost text in one place, replacements in up to three parts. Pairs that share a key are compared
by their edit distance. Everything is built from SQL functions; no line is looked at twice before the pairs are known,
and no key is sent to the driver.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import bounded_broadcast, fresh, settle, with_chance
from .graph import components

#: Edit similarity in percent of the longer line from which lines link.
PERCENT = 90
#: Blocks of a line, and how many of them two lines have in common to become candidates.
BLOCKS, SHARED = 5, 2
#: Characters from which lines have blocks of words, and below which blocks of characters; lines in between have both.
WORDS_FROM, CHARACTERS_BELOW = 72, 88
#: Characters per word up to which a line has blocks of words, and from which (or in scripts without blanks) blocks of characters.
WORDS_UP_TO, CHARACTERS_FROM = 16, 8
#: Words of the shortest line with blocks of words.
WORDS_LEAST = 10
#: Runs of a part, whose hashes its SimHash is the majority of.
RUNS = 3
#: Lines longer than LONG are compared stretch by stretch first.
STRETCH, LONG = 1_000, 10_000
#: Lines of one open key that meet in one cell.
CELL = 512


def normal_form(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def stripped(line: Column) -> Column:
    """A line without the blanks around it: the compared form of lines without letters and digits."""
    return F.regexp_replace(line, r"^(?U:\s)+|(?U:\s)+$", "")


def compared_form(line: Column) -> Column:
    normal = normal_form(line)
    return F.when(normal != "", normal).otherwise(stripped(line))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; in a lambda, an expression would be computed wherever it stands."""
    return F.transform(F.array(value), use)[0]


def _majority(a: Column, b: Column, c: Column) -> Column:
    """The bits that at least two of three numbers have."""
    return a.bitwiseAND(b).bitwiseOR(b.bitwiseAND(c)).bitwiseOR(a.bitwiseAND(c))


def _size_below(x: Column, power: Column) -> Column:
    """The largest of 0, 1, 2, 3, 4, 6, 8, 12, 16 and so on that is not above x; ``power``: the largest power of two that is not."""
    return F.when(x < 2, x.cast("int")).when(x * 2 >= power * 3, (power * 3 / 2).cast("int")).otherwise(power)


def with_signatures(lines: DataFrame) -> DataFrame:
    """A row for every signature of a line (form): nth, kind (0 words, 1 characters), size (units of a part), block0 to block4 (SimHashes).

    Lines that are similar enough differ in their number of units by a tenth or so. A line whose tenth more would make
    parts of the next size has signatures for both, so two such lines always have parts of one size. Units beyond four
    parts are the middle part. A line that is too short to differ from another one by a tenth has one row, whose kind is
    null. Runs are cut out of the text by their counts of blanks or characters, so no array of words is made.
    """
    form, kept = F.col("form"), lines.columns
    known = lines.select(
        *kept, F.length(form).alias("_size"), (F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit(""))) + 1).alias("_words"), F.octet_length(form).alias("_octets")
    )
    size, words, octets = F.col("_size"), F.col("_words"), F.col("_octets")
    # Scripts without blanks have three bytes or more a character.
    has_words = (size >= WORDS_FROM) & (words >= WORDS_LEAST) & (words * WORDS_UP_TO >= size) & (octets * 10 <= size * 22)
    has_characters = (size >= 100 // (100 - PERCENT)) & (
        (size < CHARACTERS_BELOW) | (words < WORDS_LEAST + 2) | (words * CHARACTERS_FROM < size) | (octets > size * 2)
    )
    # Columns of their own, so that each is computed once.
    known = known.select("*", *[F.floor(x / BLOCKS).alias(f"_x{i}") for i, x in enumerate((words, words * 1.15, size, size * 1.15))])
    known = known.select("*", *[F.call_function("shiftleft", F.lit(1), F.length(F.bin(f"_x{i}")) - 1).alias(f"_power{i}") for i in range(4)])
    known = known.select("*", *[_size_below(F.col(f"_x{i}"), F.col(f"_power{i}")).alias(f"_part{i}") for i in range(4)])
    either = []
    for kind, has, n in ((0, has_words, words), (1, has_characters, size)):
        small, large = F.col(f"_part{2 * kind}"), F.col(f"_part{2 * kind + 1}")
        for use, part in ((has, small), (has & (large != small) & (large * 4 <= n), large)):
            either.append(F.when(use, F.struct(F.lit(kind).alias("kind"), n.alias("n"), part.cast("int").alias("size"))))
    cut = known.select(*kept, F.posexplode_outer(F.array_compact(F.array(*either))).alias("_nth", "_s")).select(
        *kept, F.coalesce("_nth", F.lit(0)).alias("nth"), "_s.kind", "_s.size", F.col("_s.n").alias("_n")
    )
    n, part = F.col("_n"), F.col("size")
    # Each run is cut off the begin of what is left, so a line is walked through once or twice, not for every run. Four parts
    # have runs of the same sizes. The blank between two runs of words is the first character of the second one.
    blank = F.when(F.col("kind") == 0, 1).otherwise(0)
    ends = cut.select(*kept, "nth", "kind", "size", form.alias("_rest"), blank.alias("_blank"), *[
        F.floor(of * r / RUNS).cast("int").alias(f"_{name}{r}") for name, of in (("s", part), ("m", n - part * 4)) for r in range(1, RUNS + 1)
    ])
    counts = {f"_{k}{r}": F.col(f"_{k}{r + 1}") - (F.col(f"_{k}{r}") if r else 0) for k in "sm" for r in range(RUNS)}
    placed = ends.select(
        *kept, "nth", "kind", "size", "_rest", *[F.when(c > 0, c + F.col("_blank")).otherwise(0).alias(f"_c{name}") for name, c in counts.items()],
        F.col("_s1").alias("_c_f0"), (counts["_s1"] + F.when(F.col("_s1") > 0, F.col("_blank")).otherwise(0)).alias("_c_f1"),
    )
    rest, last = F.col("_rest"), RUNS * BLOCKS - 1
    sizes = ["_c_f0", "_c_f1", "_c_s2", *[f"_c_{k}{r}" for k in "sms" for r in range(RUNS)], "_c_s0", "_c_s1"]
    for i, size in enumerate(sizes):
        done, left = [f"_h{j}" for j in range(i)], sorted(set(sizes[i + 1 :]))
        run = F.when(F.col("kind") == 1, F.left(rest, F.col(size))).otherwise(F.call_function("substring_index", rest, F.lit(" "), F.col(size)))
        placed = placed.select(*kept, "nth", "kind", "size", *done, *left, "_rest", run.alias("_run"))
        placed = placed.select(*kept, "nth", "kind", "size", *done, F.xxhash64("_run").alias(f"_h{i}"), *left, F.substr(rest, F.length("_run") + 1).alias("_rest"))
    runs = [*[F.col(f"_h{i}") for i in range(last)], F.xxhash64("_rest").alias(f"_h{last}")]
    hashed = placed.select(*kept, "nth", "kind", "size", *runs)
    blocks = [_majority(*[F.col(f"_h{RUNS * j + r}") for r in range(RUNS)]).alias(f"block{j}") for j in range(BLOCKS)]
    return hashed.select(*kept, "nth", "kind", "size", *blocks)


def near_keys(signed: DataFrame) -> DataFrame:
    """key, line, length of signatures (line, length, kind, size, block0 to block4): lines that share a key are candidates."""
    keys = F.array(*[
        F.xxhash64(F.lit(n), "kind", "size", *[f"block{i}" for i in chosen]) for n, chosen in enumerate(itertools.combinations(range(BLOCKS), SHARED))
    ])
    return signed.where("kind IS NOT NULL").select(F.explode(keys).alias("key"), "line", "length")


def _near(a: str, b: str) -> Column:
    """Whether the lengths of two lines (line, length in a struct) allow them to be similar enough."""
    longer, shorter = F.greatest(f"{a}.length", f"{b}.length"), F.least(f"{a}.length", f"{b}.length")
    return (longer - shorter) * 100 <= longer * (100 - PERCENT)


def _within(a: Column, b: Column, most: Column) -> Column:
    """Whether the edit distance is at most ``most``. Only a band of the table is computed, a narrow one first: most similar lines differ in a few places."""
    found = F.lit(False)
    for band in (None, 512, 32, 4):
        width = most if band is None else F.least(F.lit(band), most)
        near = F.call_function("levenshtein", a, b, width) >= 0
        found = near if band is None else F.when(near, True).when(most <= band, False).otherwise(found)
    return found


def _alike(a: Column, b: Column, most: Column, part) -> Column:
    """How many characters, ``most`` at most, two texts have in common at one end; ``part`` gives that many of a text."""
    steps = F.array(*[F.lit(1 << k) for k in range(13, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= most) & (part(a, n + step) == part(b, n + step)), n + step).otherwise(n))


def _trimmed(a: Column, b: Column, most: Column) -> Column:
    """As ``_within``, for the texts without what they begin and end with alike, which does not change their distance."""
    shorter = F.least(F.length(a), F.length(b))

    def rest(begin: Column, end: Column) -> Column:
        x, y = (F.substr(t, begin + 1, F.length(t) - begin - end) for t in (a, b))
        return _let(F.struct(x.alias("x"), y.alias("y")), lambda p: _within(p["x"], p["y"], most))

    begins = _alike(a, b, shorter, lambda t, n: F.substr(t, F.lit(1), n))
    return _let(begins, lambda p: _let(_alike(a, b, shorter - p, F.right), lambda q: rest(p, q)))


def similar(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Whether the edit distance is at most (100 - percent) % of the longer text.

    Texts beyond LONG characters are first cut into as many stretches each, and the distances of the stretches are added
    up; that is never less than the edit distance, so texts it finds similar are. The others are decided by the edit
    distance itself, in a band that grows up to the distance allowed.
    """
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    most = F.floor(longer * (100 - percent) / 100).cast("int")
    parts = F.ceil(longer / STRETCH).cast("int")

    def stretches(text: Column) -> Column:
        share = F.ceil(F.length(text) / parts).cast("int")
        return _let(F.split(text, ""), lambda units: F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.array_join(F.slice(units, i * share + 1, share), "")))

    apart = F.aggregate(F.zip_with(stretches(a), stretches(b), lambda x, y: F.levenshtein(x, y)), F.lit(0), lambda s, x: s + x)
    near = F.when((longer > LONG) & (apart <= most), True).otherwise(_trimmed(a, b, most))
    return F.when(longer - shorter > most, False).otherwise(near)


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    joined = pairs.join(texts.select(F.col("line").alias("a"), F.col("form").alias("text_a")), "a").join(
        texts.select(F.col("line").alias("b"), F.col("form").alias("text_b")), "b"
    )
    return joined.where(similar(F.col("text_a"), F.col("text_b"), percent)).select("a", "b")


def _open_links(still: DataFrame, forms, percent: int) -> DataFrame:
    """a, b: links between lines of different components that share an open key; still: key, x (line, length), component, cells.

    The texts travel with the lines and are compared where these meet, so pairs are neither written nor shuffled. Lines
    that share several keys are compared under the smallest one.
    """
    texts = forms(still.select(F.col("x.line").alias("a"), F.col("x.line").alias("b")))
    under = still.groupBy(F.col("x.line").alias("under")).agg(F.collect_set("key").alias("keys"))
    known = texts.join(under, F.col("line") == F.col("under")).select("line", "form", "keys")
    still = materialize(still.join(known, F.col("x.line") == F.col("line")).select("key", "x", "component", "cells", "form", "keys"), "texts")
    tasks = int(still.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, every = F.pmod(F.xxhash64("x.line"), F.col("cells")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    left = still.select("key", "x", "component", "form", "keys", own.alias("row"), every.alias("column"))
    right = still.select(
        "key", F.col("x").alias("y"), F.col("component").alias("other"), F.col("form").alias("text"), F.col("keys").alias("others"), own.alias("column"), every.alias("row")
    )
    # Cells are small and take long, so Spark must not put many of them into one task.
    met = left.repartition(tasks, "key", "row", "column").join(right.repartition(tasks, "key", "row", "column").hint("merge"), ["key", "row", "column"])
    once = F.array_min(F.array_intersect("keys", "others")) == F.col("key")
    met = met.where((F.col("x.line") < F.col("y.line")) & (F.col("component") != F.col("other")) & _near("x", "y") & once & similar(F.col("form"), F.col("text"), percent))
    return met.select(F.col("x.line").alias("a"), F.col("y.line").alias("b"))


def fuzzy_groups(signed: DataFrame, rows: int, forms, percent: int = PERCENT) -> DataFrame:
    """line, component for all lines that are linked; signed: as ``near_keys`` takes it; forms: gives the texts of pairs' lines.

    Keys meet once: their smallest and largest lines come from a sum over the same partitioning that the lines of a key
    are joined in. All lines of a key are compared with these two. Keys whose lines are then in one component are done;
    in the others, only lines of different components are compared, in cells of bounded size.
    """
    keyed = near_keys(signed).repartition("key")
    one = F.struct("line", "length")
    # With all columns of the other side in use, both sides are one exchange.
    ends = keyed.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.max("length").alias("longest")).where("low <> high AND longest > 0")
    # Few keys have several lines, so their ends fit a hash table for each partition, and no row is sorted.
    keyed = materialize(keyed.join(ends.hint("shuffle_hash"), "key").select("key", one.alias("x"), "low", "high"), "candidates")
    leads = keyed.where("x.line = low OR x.line = high").select("key", F.col("x").alias("y"))
    stars = keyed.select("key", "x").join(leads, "key").where((F.col("x.line") != F.col("y.line")) & _near("x", "y"))
    stars = stars.select(F.least("x.line", "y.line").alias("a"), F.greatest("x.line", "y.line").alias("b")).distinct()
    stars = materialize(stars, "stars")
    known = materialize(_links(stars, forms(stars), percent), "links")
    n_known = known.count()
    first = settle(components(known, n_known), "components", n_known).withColumnRenamed("node", "line_of")
    labelled = keyed.select("key", "x").join(bounded_broadcast(first), F.col("x.line") == F.col("line_of"), "left").select(
        "key", "x", F.coalesce("component", "x.line").alias("component")
    )
    mixed = labelled.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.where("c1 <> c2").select("key", F.ceil(F.col("n") / CELL).cast("int").alias("cells"))
    still = materialize(labelled.join(mixed, "key"), "open")
    links = known.unionAll(materialize(_open_links(still, forms, percent), "links"))
    return components(links, links.count())


def drop_near_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and n_lines and n_removed.

    Of every group of lines that are equal in compared form or connected by links, the occurrence in the document with
    the smallest key stays (a null key comes first), there the first. Two lines are linked if two of the five
    blocks of their signatures are equal, and their edit similarity is at least ``percent``. Blank lines stay everywhere.
    Rows with the same key and text are one document and get the same text. A null text stays null; a text of which
    nothing is left becomes empty, its row stays. Lines may be of any length. Columns named n_lines or n_removed are
    replaced.
    """
    docs = docs.drop(*[c for c in ("n_lines", "n_removed") if c in docs.columns])
    mark = F.xxhash64(F.col(text), F.col(key))
    split = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), mark.alias("mark"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("place", "raw"))
    # A generated column is computed once, however often it is used.
    normal = split.select("key", "mark", "place", "raw", F.explode(F.array(normal_form(F.col("raw")))).alias("normal"))
    formed = normal.select("key", "mark", "place", F.when(F.col("normal") != "", F.col("normal")).otherwise(stripped(F.col("raw"))).alias("form")).where("form <> ''")
    formed = formed.select("key", "mark", "place", F.xxhash64("form").alias("line"), F.length("form").alias("length"), "form")
    signed = materialize(with_signatures(formed).drop("form"), "lines")
    seen = signed.where("nth = 0").select("key", "mark", "place", "line")
    lines = materialize(seen.groupBy("line").agg(F.min(F.struct("key", "mark", "place")).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    signed = signed.where("kind IS NOT NULL").groupBy("line", "kind", "size").agg(*[F.first(c).alias(c) for c in ("length", *[f"block{i}" for i in range(BLOCKS)])])
    rows = lines.count()

    def forms(pairs: DataFrame) -> DataFrame:
        """The texts of the lines of some pairs, read again at their first occurrence."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
        at = lines.select("line", "first").join(wanted, F.col("line") == F.col("wanted"), "left_semi")
        at = at.groupBy(F.col("first.mark").alias("at_mark")).agg(F.collect_set(F.struct(F.col("first.place").alias("place"), "line")).alias("places"))
        at = materialize(at, "wanted")
        near, source = bounded_broadcast(at), docs.where(F.col(text).isNotNull()).select(mark.alias("mark"), F.col(text).alias("whole"))
        if near is at:
            source = with_chance(source, "mark", at, "at_mark", "chance").where("chance")
        source = source.join(near, F.col("mark") == F.col("at_mark")).select("places", F.split("whole", "\n", -1).alias("whole"))
        raw = source.select(F.explode(F.transform("places", lambda p: F.struct(p["line"].alias("line"), F.get("whole", p["place"]).alias("raw")))).alias("p"))
        return materialize(raw.select("p.line", compared_form(F.col("p.raw")).alias("form")).dropDuplicates(["line"]), "forms")

    groups = settle(fuzzy_groups(signed, rows, forms, percent), "groups", rows).withColumnRenamed("node", "line_of")
    return _without_repeats(docs, text, mark, seen, lines, groups, rows)


def _without_repeats(docs: DataFrame, text: str, mark: Column, seen: DataFrame, lines: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """``docs`` with one occurrence of each group; seen: mark, place, line; lines: line, n, first; groups: line_of, component."""
    linked = lines.join(groups, F.col("line") == F.col("line_of"), "left").select("line", "n", "first", F.coalesce("component", "line").alias("component"))
    kept = linked.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("all"))
    again = linked.join(kept, "component").where("all > 1").select(F.col("line").alias("again"), F.col("kept.mark").alias("keep_mark"), F.col("kept.place").alias("keep_place"))
    again = bounded_broadcast(settle(again, "again", rows))
    gone = seen.join(again, F.col("line") == F.col("again")).where((F.col("mark") != F.col("keep_mark")) | (F.col("place") != F.col("keep_place")))
    gone = settle(gone.groupBy("mark").agg(F.collect_set("place").alias("places")), "gone", rows)

    row, lost, chance = fresh(docs, "_line_mark"), fresh(docs, "_lost"), fresh(docs, "_chance")
    gone = gone.select(F.col("mark").alias("_gone_mark"), F.col("places").alias(lost))
    near, marked = bounded_broadcast(gone), docs.withColumn(row, mark)
    if near is gone:
        # Only texts that may lose a line are shuffled.
        marked = with_chance(marked, row, gone, "_gone_mark", chance)
        whole = marked.where(~F.col(chance)).withColumn("_gone_mark", F.lit(None).cast("bigint")).withColumn(lost, F.lit(None).cast("array<int>"))
        joined = marked.where(chance).join(gone, F.col(row) == F.col("_gone_mark"), "left").unionByName(whole)
    else:
        joined = marked.join(near, F.col(row) == F.col("_gone_mark"), "left")
    left = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col(lost), i))
    return joined.select(
        *[F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.size(F.split(F.col(text), "\n", -1)), F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).cast("bigint").alias("n_removed"),
    )
