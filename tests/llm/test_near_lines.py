"""Fuzzy lines against brute-force versions of signatures and links, and what share of near copies they find."""

import random
import re
import string
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lexiquarry.llm import lines, queries

from test_pair_operators import distance, reach

SCHEMA = "doc_id long, text string, source string, n long"
SIZES = sorted({0, 1, *(1 << k for k in range(1, 20)), *(3 << k for k in range(19))})


def form_of(line):
    normal = re.sub(r"[^\w]+|_", " ", line.lower()).strip()
    return normal or line.strip()


def plain_simhash(runs):
    votes = [xxhash.xxh64_intdigest(run.encode(), seed=42) for run in runs]
    bits = sum(1 << k for k in range(64) if sum(v >> k & 1 for v in votes) >= 2)
    return bits - (1 << 64) if bits >> 63 else bits


def plain_signatures(form):
    """kind, size -> five SimHashes."""
    words, size, out = form.split(" "), len(form), {}
    octets = len(form.encode())
    kinds = []
    if size >= 72 and len(words) >= 10 and len(words) * 16 >= size and octets * 10 <= size * 22:
        kinds.append((0, words))
    if size >= 10 and (size < 88 or len(words) < 12 or len(words) * 8 < size or octets > size * 2):
        kinds.append((1, list(form)))
    for kind, units in kinds:
        n = len(units)
        for share in (n // 5, int(n * 1.15 / 5)):
            b = max(s for s in SIZES if s <= share)
            if 4 * b <= n:
                cut = lambda x, y: "".join(units[x:y]) if kind else (" " if 0 < x < y else "") + " ".join(units[x:y])
                out[kind, b] = []
                for start, part in ((0, b), (b, b), (2 * b, n - 4 * b), (n - 2 * b, b), (n - b, b)):
                    ends = [start + part * r // 3 for r in range(4)]
                    out[kind, b].append(plain_simhash([cut(x, y) for x, y in zip(ends, ends[1:])]))
    return out


def plain_link(a, b, of):
    most = max(len(a), len(b)) * 10 // 100
    if abs(len(a) - len(b)) * 100 > max(len(a), len(b)) * 10:
        return False
    for shared in of[a].keys() & of[b].keys():
        x, y = of[a][shared], of[b][shared]
        if sum(p == q for p, q in zip(x, y)) >= 2:
            return distance(a, b) <= most
    return False


def test_signatures(spark):
    rng = random.Random(3)
    made = ["x", "abcdefghi", "abcdefghij", "words " * 13 + "end", "漢字" * 40, "a" * 500, "lo ng " * 300]
    made += [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(1, 9))) for _ in range(n)) for n in (3, 8, 14, 15, 16, 17, 40, 90, 700)]
    made = [form_of(m) for m in made]
    got = defaultdict(dict)
    for r in lines.with_signatures(spark.createDataFrame([(m,) for m in made], "form string")).collect():
        assert got[r.form].setdefault("nth", set()).isdisjoint({r.nth})
        got[r.form]["nth"].add(r.nth)
        if r.kind is not None:
            got[r.form][r.kind, r["size"]] = [r[f"block{i}"] for i in range(5)]
    for m in made:
        assert 0 in got[m].pop("nth") and got[m] == plain_signatures(m), m


def test_short_lines_and_scripts(spark):
    passage = "".join(chr(0x4E00 + 37 * i % 2000) for i in range(60))
    edited = passage[:30] + "口" + passage[31:]
    texts = ["Short\nshort line\n---", "short\nSHORT  line!\n ---\t", passage, edited, "\n \n", "a\nb\nA", "abcdef ghij\nabcdef ghijk\nabcdex ghij"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    out = {r.doc_id: (r.text, r.n_removed) for r in lines.drop_near_lines(docs).collect()}
    assert out == {0: (texts[0], 0), 1: ("", 3), 2: (passage, 0), 3: ("", 1), 4: ("\n \n", 0), 5: ("a\nb", 1), 6: ("abcdef ghij", 2)}


def planted(rng):
    """Kinds of edits, and pairs of lines at 90 % edit similarity or more."""
    word = lambda n: "".join(rng.choices(string.ascii_lowercase, k=n))
    for n in (10, 11, 14, 20, 30, 100):
        for kind in ("replaced", "lost", "added"):
            for _ in range(30):
                old = [word(rng.randrange(3, 8)) for _ in range(n)]
                new, at = list(old), rng.randrange(n)
                new[at : at + 1] = {"replaced": [word(len(old[at]))], "lost": [], "added": [old[at], word(5)]}[kind]
                yield f"a word of {n} {kind}", " ".join(old), " ".join(new)
    for n, k in ((40, 3), (100, 3)):
        for _ in range(30):
            old = [word(5) for _ in range(n)]
            new = list(old)
            for at in rng.sample(range(n), k):
                new[at] = word(5)
            yield f"{k} words of {n} replaced", " ".join(old), " ".join(new)
    for size, edits in ((12, 1), (30, 1), (30, 3), (60, 3), (80, 2)):
        for _ in range(30):
            old = [rng.choice(string.ascii_lowercase + " ") if 0 < i < size - 1 else "x" for i in range(size)]
            new = list(old)
            for at in rng.sample(range(1, size - 1), edits):
                new[at] = rng.choice("0123")
            yield f"{edits} of {size} characters", form_of("".join(old)), form_of("".join(new))
    for size, edits in ((200, 10), (200, 20)):
        for _ in range(30):
            old = " ".join(word(5) for _ in range(size // 6))
            new = list(old)
            for at in rng.sample(range(len(old)), edits):
                new[at] = rng.choice("0123")
            yield f"{edits} of {size} characters", old, "".join(new)


def test_recall_of_planted_edits(spark):
    """Pairs whose edit similarity is 90 % or more, by the edit distance alone, and how many of them are candidates."""
    pairs = [(kind, a, b) for kind, a, b in planted(random.Random(9)) if distance(a, b) <= max(len(a), len(b)) * 10 // 100]
    forms = spark.createDataFrame([(2 * i + j, p[1 + j]) for i, p in enumerate(pairs) for j in (0, 1)], "line long, form string")
    keyed = lines.near_keys(lines.with_signatures(forms.select("line", F.length("form").alias("length"), "form")))
    both = keyed.select("key", F.struct("line", "length").alias("x")).join(keyed.select("key", F.struct("line", "length").alias("y")), "key")
    both = both.where((F.col("x.line") + 1 == F.col("y.line")) & (F.col("x.line") % 2 == 0) & lines._near("x", "y"))
    found = {r.line // 2 for r in both.select("x.line").distinct().collect()}
    recall = {}
    for kind in dict.fromkeys(p[0] for p in pairs):
        of = [i for i, p in enumerate(pairs) if p[0] == kind]
        recall[kind] = round(len(found & set(of)) / len(of), 2)
    print(recall)
    # Edits all over a line leave no two blocks alone; that kind is outside what links.
    scattered = {"10 of 200 characters", "20 of 200 characters"}
    assert all(r >= 0.9 for kind, r in recall.items() if kind not in scattered), recall


@pytest.mark.parametrize("cell", [512, 2])
def test_against_brute_force(spark, monkeypatch, cell):
    """All near copies in a small corpus go, and nothing else, with extra columns and repeated rows."""
    monkeypatch.setattr(lines, "CELL", cell)
    rng = random.Random(10)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    pool = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 5, 8, 20, 60) for _ in range(3)]
    # Lines that share much and are no near copies: their keys stay open.
    pool += [pool[-1][:200] + " " + " ".join(word() for _ in range(30)) for _ in range(6)]
    texts = []
    for _ in range(60):
        chosen = []
        for _ in range(rng.randrange(1, 5)):
            text = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 1, 3])):
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice(["x", "y", "", " z "]) + text[at + 1 :]
            chosen.append(text)
        texts.append("\n".join(chosen))
    # A null key comes first.
    texts = [texts[6], *texts[:6], *texts[7:]]
    key = lambda i: i or None
    docs = spark.createDataFrame([(key(i), t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "again", 2)], SCHEMA).repartition(4)
    distinct = sorted({form_of(line) for t in texts for line in t.split("\n") if form_of(line)})
    of = {form: plain_signatures(form) for form in distinct}
    groups = reach(len(distinct), lambda x, y: plain_link(distinct[x], distinct[y], of))
    group_of, seen = {form: min(groups[i]) for i, form in enumerate(distinct)}, set()
    want = {}
    for i, t in enumerate(texts):
        left = []
        for line in t.split("\n"):
            group = group_of.get(form_of(line))
            if group is None or group not in seen:
                left.append(line)
            seen.add(group)
        want[key(i)] = "\n".join(left)
    out = lines.drop_near_lines(docs).collect()
    assert len(out) == len(texts) + 1 and {r.doc_id: r.text for r in out} == want
    assert all(r.n_lines == len(texts[r.doc_id or 0].split("\n")) for r in out)


def test_very_long_lines(spark):
    rng = random.Random(12)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randrange(1000)) for _ in range(12_000)]
    near = base[:6000] + ["changed"] * 20 + base[6020:]
    other = rng.sample(base, len(base))
    texts = [" ".join(base), " ".join(near), " ".join(other), None, "", "one line"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    out = {r.doc_id: r.text for r in lines.drop_near_lines(docs).collect()}
    assert out == {0: texts[0], 1: "", 2: texts[2], 3: None, 4: "", 5: "one line"}


def test_query_takes_all_lines():
    assert "drop_near_lines" in queries.QUERIES["op4_fuzzy_lines"].__code__.co_names
