"""Prefix trie and structure repair of conversations, and main texts of pages, against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import extract, queries, repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, lost string"


def made_conversations(rng, n=60):
    """Few different turns, so that many conversations share openings; ties, repeats, gaps and nulls."""
    texts = ["Yes.", "No", "  ", "", "Why?\n", "a b c.", "tell me more", None, "wort " * 300 + "."]
    rows = []
    for c in [*range(n), -7, 1000]:
        for turn in range(rng.choice([1, 2, 2, 3, 4, 7])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            row = (c, rng.choice([turn, turn, turn + 2, None]), role, rng.choice(texts), "own", "column")
            rows += [row] * rng.choice([1, 1, 1, 2])
    rows.append((None, 1, "user", "x", "", ""))
    return rows


def order(row):
    return (row[1] is not None, row[1] or 0)


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for path, of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ended = sorted(c for c in of if len(built[c]) == len(path))
        out.append((
            min(of), len(path), min(members[path[:-1]]) if path else None, len(of), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p),
            hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 3, 25])
def test_trie_against_plain_version(spark, ranges):
    rows = made_conversations(random.Random(ranges))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie.prefix_trie(trie.with_openings(trie.number_turns(frame))).select(*trie._NODE).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_of_equal_conversations(spark, monkeypatch):
    """One conversation that most have, over many ranges; lists of ids in several pieces."""
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(20 * i, t, r, x, "", "") for i in range(120) for t, (r, x) in enumerate([("user", "hi there"), ("assistant", "hello")][: 1 if i % 10 == 9 else 2])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = trie.prefix_trie(trie.with_openings(trie.number_turns(frame))).select(*trie._NODE).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.with_openings(trie.number_turns(none))).count() == 0
    assert repair.report(repair.repair(repair.damage(none))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.with_main_text(pages).count() == 0


def plain_repair(rows):
    """Every sequence of edits that could be cheapest, tried in full."""
    out = []
    for c in dict.fromkeys(r[0] for r in rows):
        turns = []
        for _, turn, role, text, *_ in (r for r in rows if r[0] == c):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t[0] for t in turns if t[0] is not None]
        best = (0, "", []) if not turns else None
        ways = {"": [(0, "", [])]}
        for (_, role, text), fault in zip(turns, faults):
            more = defaultdict(list)
            for shape, found in ways.items():
                for cost, letters, lines in found:
                    for added in ("", *"ua", "ua", "au"):
                        extra = [f"{'user' if x == 'u' else 'assistant'}:" for x in added]
                        base = (cost + 2 * len(added), letters + "I" * len(added), lines + extra, shape + added)
                        cut = int(fault == "truncated")
                        nexts = [(3, "D", [], "")]
                        if fault not in ("blank", "duplicate"):
                            nexts += [(cut, "K", [f"{role}:{text}"], role[:1] or "?")]
                            nexts += [(2 + cut, "R", [f"{name}:{text}"], name[0]) for name in ("user", "assistant")]
                        for price, letter, line, initial in nexts:
                            whole = base[3] + initial
                            if re.fullmatch(r"s?(ua)*u?", whole):
                                more[whole].append((base[0] + price, base[1] + letter, base[2] + line))
            # Of one shape, only the best way can go on: all have taken the same rows.
            ways = {shape: [min(found)] for shape, found in more.items()}
        ends = []
        for shape, found in ways.items():
            for added in ("", "a", "ua"):
                if re.fullmatch(r"(s?(ua)+)?", shape + added):
                    extra = [f"{'user' if x == 'u' else 'assistant'}:" for x in added]
                    ends += [(cost + 2 * len(added), letters + "I" * len(added), lines + extra) for cost, letters, lines in found]
        cost, audit, lines = best or min(ends)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out.append((
            c, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_against_every_way(spark, monkeypatch, seed):
    rows = made_conversations(random.Random(seed))
    # A base table, so that all edits that undo its damage are needed somewhere.
    got = repair.report(repair.repair(repair.damage(spark.createDataFrame(rows, SCHEMA).repartition(4)))).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_repair(rows)


def test_repair_of_a_long_conversation():
    """Rows and pointers that do not fit in memory give the same edits, without Spark in between."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c!"]), rng.choice([None, None, "truncated", "blank"])) for i in range(5000)]
    results = []
    for spool, block in ((1 << 20, 1 << 16), (100, 64), (1 << 20, 5000)):
        old = repair.SPOOL, repair.BLOCK
        repair.SPOOL, repair.BLOCK = spool, block
        try:
            one = repair._Conversation(1, repair._Steps())
            for row in rows:
                one.add(*row)
            results.append((list(one.edits()), one.count))
        finally:
            repair.SPOOL, repair.BLOCK = old
    assert results[0] == results[1] == results[2]
    edits, count = results[0]
    shape = "".join(role[:1] for op, _, role, _, _ in edits if op != "D")
    assert re.fullmatch("s?(ua)+", shape) and sum(op != "I" for op, *_ in edits) == 5000
    price = sum(repair.COST[op] + (op in "KR" and fault == "truncated") for op, *_, fault in edits)
    assert price == count["cost"] and all(op == "D" for op, *_, fault in edits if fault == "blank")


def test_edits_are_the_repaired_conversation(spark):
    rows = [(1, 0, "user", "Hi.", "", ""), (1, 1, "user", "Hi.", "", ""), (1, 3, "assistant", "So", "", "")]
    frame = spark.createDataFrame(rows, SCHEMA).drop("lost").withColumn("lost", F.lit(False))
    got = [(r.edit, r.turn, r.role, r.text, r.fault) for r in repair.repair(frame).collect()]
    assert got[:-1] == [("K", 0, "user", "Hi.", None), ("D", 1, "user", "Hi.", "duplicate"), ("K", 3, "assistant", "So", "truncated")]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_repair_conversations"])
def test_sql_on_ties_and_nulls(spark, tmp_path, name):
    rows = made_conversations(random.Random(8), 30)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    mine = queries.QUERIES[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(map(str, (tuple(r) for r in mine.select(*columns).collect()))) == sorted(map(str, theirs.fetchall()))


WORDS = "Lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore".split()


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).replace(" sed ", ", sed ") + "."


MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(9)) + "</ul>"


def made_pages(rng):
    """html and the text to be found."""
    for parts in (1, 2, 5, 12):
        body = [prose(rng, rng.choice([4, 25, 90])) for _ in range(parts)]
        title, note = "A title, with words", prose(rng, 14)
        marked = "".join(f"<p>{p}</p>" for p in body)
        want = "\n\n".join([title, *body])
        yield f"<html><body><nav>{MENU}</nav><article><h1>{title}</h1>{marked}</article><footer><p>{note}</p></footer></body></html>", want
        yield f"<body class='has-sidebar'><div id=top-menu>{MENU}</div><div class=content><h1>{title}</h1>{marked}</div><div class='side sidebar'><p>{note}</p></div><div id=comments><p>{note} {note} {note}</p></div></body>", want
        yield f"<form action=/><div class='cookie-notice'><p>{note}</p></div><main><header><h1>{title}</h1></header><section>{marked}</section><form><p>{note}<input></form></main></form>", want
        unclosed = "".join(f"<p>{p}" for p in body)
        yield f"<TITLE>x</TITLE><script>if (a < b) document.write('<p>{note}</p>')</script><style>p > b {{}}</style><div><h1>{title}</h1>{unclosed}<!-- <p>{note}</p> --></div><div>{MENU}</div>", want
        yield f"<article><h1>{title}</h1><div><div>{marked}</div></div><div class='share'><p>{note}</p></div><aside>{note}</aside>{MENU}<section class='reader-comments'><article><p>{note}</p></article></section></article>", want


def test_main_text_of_many_layouts(spark):
    pages = list(made_pages(random.Random(3)))
    frame = spark.createDataFrame([(i, h, "mine", 1) for i, (h, _) in enumerate(pages)], "page_id long, html string, text string, n_chars int").repartition(3)
    got = {r.page_id: r.text for r in extract.with_main_text(frame).collect()}
    for i, (page, want) in enumerate(pages):
        assert got[i] == want, page


def test_main_text_edges(spark):
    long = prose(random.Random(1), 200_000)
    cases = [
        (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<a href='x", ""), ("no markup, at all", "no markup, at all"), ("<nav><p>Only a menu</p></nav>", ""),
        ("<p>a &amp; b&nbsp;\n\t c &lt;p&gt; &#233; &bogus;</p>", "a & b c <p> é &bogus;"), ("<p>one<br>two<b>three</b></p>text", "one twothree\n\ntext"),
        (f"<p>{long}</p>", long), ("<div>" * 30_000 + "<p>deep</p>", "deep"), ("<table><tr><td>one<td>two<tr><td>three</table>", "one\n\ntwo\n\nthree"),
        ("<p>cut &am", "cut &am"), ("<p>cut <b", "cut"), ("<ul><li>one, more<li>two, more</ul>", "one, more\n\ntwo, more"), ("<p>퟿\U0001f600</p>", "퟿\U0001f600"),
    ]
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)] * 2, "page_id long, html string")
    for r in extract.with_main_text(frame).collect():
        assert (r.text, r.n_chars) == (cases[r.page_id][1], len(cases[r.page_id][1])), str(cases[r.page_id][0])[:200]


class _Plain(HTMLParser):
    """The blocks of a well-formed page and the path of elements to each, without scores."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.pieces, self.n = [], [], [], itertools.count()

    def flush(self):
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append((list(self.stack), text))
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        if tag in extract.BLOCKS:
            self.flush()
            self.stack.append((next(self.n), tag))
        elif tag == "br":
            self.pieces.append(" ")

    def handle_endtag(self, tag):
        if tag in extract.BLOCKS:
            self.flush()
            while self.stack and self.stack.pop()[1] != tag:
                pass

    def handle_data(self, data):
        self.pieces.append(data)


def test_best_container_by_plain_scores():
    """Nested boxes without names: points of every block are handed up one by one, and the best box and its like are kept."""
    rng = random.Random(5)
    for _ in range(60):
        boxes = []
        for _ in range(rng.randrange(2, 6)):
            inner = "".join(f"<p>{prose(rng, rng.choice([3, 20, 60]))}</p>" for _ in range(rng.randrange(1, 6)))
            boxes.append(f"<div>{inner}</div>" if rng.random() < 0.7 else f"<div><div>{inner}</div></div>")
        page = f"<html><body>{''.join(boxes)}</body></html>"
        plain = _Plain()
        plain.feed(page)
        score, children = defaultdict(float), defaultdict(list)
        for path, text in plain.blocks:
            points = 1 + text.count(",") + len(text) / 100
            for up, element in enumerate(reversed(path[:-1])):
                score[element] += points * extract.PASSED ** up
            for above, element in zip([None, *path], path):
                if element not in children[above]:
                    children[above].append(element)
        best = max(score, key=lambda e: (score[e], -e[0]))
        above = next(a for a, c in children.items() if best in c)
        kept = {best} | {e for e in children[above] if score[e] >= extract.SIBLING * score[best] or e[1] == "p"}
        want = "\n\n".join(text for path, text in plain.blocks if kept & set(path))
        assert extract.main_text(page) == want
