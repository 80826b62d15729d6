"""Licence scans: tags and notices found by one Aho-Corasick pass, licence expressions evaluated by shunting yard.

The automaton runs over a text's words in lower case, one blank between them, so a phrase matches whatever stands
between its words. Where it meets the name of an identifier tag, the expression after the tag is read from the line and
evaluated: which licences it names, and whether permissive ones alone can satisfy it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed: notices of the base rules.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices that the scan adds.
MORE_PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
}
#: Names of tags before a licence expression.
TAGS = ("spdx license identifier", "license expression")
#: Fixed: identifiers of licences in expressions, by the label they get; versions are added below.
IDENTIFIERS = {
    "mit": "mit x11 mit-0", "apache-1.1": "apache-1.1", "apache-2": "apache-2 apache-2.0", "isc": "isc", "zlib": "zlib libpng", "unlicense": "unlicense",
    "0bsd": "0bsd", "bsd-2-clause": "bsd-2-clause", "bsd-3-clause": "bsd-3-clause", "bsd-4-clause": "bsd-4-clause", "bsl-1": "bsl-1.0",
    "mpl-1": "mpl-1.0 mpl-1.1", "mpl-2": "mpl-2.0", "epl-1": "epl-1.0", "epl-2": "epl-2.0", "cddl-1": "cddl-1.0 cddl-1.1", "eupl-1": "eupl-1.1 eupl-1.2",
    "artistic-2": "artistic-2.0", "wtfpl": "wtfpl", "cc0": "cc0-1.0", "ofl-1": "ofl-1.1", "python-2": "python-2.0 psf-2.0", "postgresql": "postgresql", "ncsa": "ncsa",
}
_LABEL_OF = {identifier: label for label, identifiers in IDENTIFIERS.items() for identifier in identifiers.split()}
for _family, _versions in (("gpl", "1 2 3"), ("lgpl", "2 2.1 3"), ("agpl", "3")):
    for _version in _versions.split():
        _label = f"{_family}-{_version}" if _family == "gpl" else _family
        _point = _version if "." in _version else f"{_version}.0"
        _LABEL_OF |= {f"{_family}-{_point}{ending}": _label for ending in ("", "+", "-only", "-or-later")}
for _kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
    _LABEL_OF |= {f"cc-{_kind}-{version}": f"cc-{_kind}" for version in ("1.0", "2.0", "2.5", "3.0", "4.0")} | {f"cc-{_kind}": f"cc-{_kind}"}
#: Fixed: exceptions that may follow ``with``.
EXCEPTIONS = frozenset("classpath-exception-2.0 gcc-exception-3.1 gcc-exception-2.0 llvm-exception bison-exception-2.2 font-exception-2.0 linux-syscall-note openssl-exception".split())
#: Licences that allow any use; an exception may make another licence one of them.
PERMISSIVE = frozenset("mit apache-1.1 apache-2 bsd bsd-2-clause bsd-3-clause bsd-4-clause isc zlib unlicense cc0 cc-by 0bsd bsl-1 python-2 postgresql ncsa wtfpl".split())
PERMISSIVE_WITH = frozenset({("gpl-2", "classpath-exception-2.0"), ("gpl-3", "gcc-exception-3.1"), ("apache-2", "llvm-exception")})

#: How sure a finding is: a well-formed expression, a notice, an expression that cannot be parsed.
SURE_EXPRESSION, SURE_NOTICE, SURE_BROKEN = 1.0, 0.9, 0.5

# Anything but ASCII letters, digits and bytes of other characters separates words.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_TAG_LINE = re.compile(r"(?:spdx[ -]license[ -]identifier|license[ -]expression)[ \t]*[:=]?[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def to_rpn(expression: str) -> list[str]:
    """Postfix order by shunting yard; ``with`` binds before ``and``, ``and`` before ``or``.

    Identifiers become their labels; a token that is none of the known licences or exceptions, where one has to stand,
    is no expression. Reading stops at the first token that cannot continue the expression, so that prose after it does
    no harm. Raises ValueError if nothing sound has been read by then.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for match in _TOKEN.finditer(expression):
        token = match.group().lower().rstrip(".:")
        if token == "(":
            if not operand_next:
                break
            waiting.append(token)
        elif token == ")":
            if operand_next or "(" not in waiting:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in _RANK:
            if operand_next:
                raise ValueError("operator without operand")
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next:
                break
            excepted = bool(waiting) and waiting[-1] == "with"
            if token not in (EXCEPTIONS if excepted else _LABEL_OF) and not token.startswith("licenseref-"):
                raise ValueError("unknown licence")
            out.append(token if excepted else _LABEL_OF.get(token, token))
            operand_next = False
    if operand_next or "(" in waiting:
        raise ValueError("unfinished expression")
    return out + waiting[::-1]


def evaluate(rpn: list[str]) -> tuple[set[str], bool]:
    """Licences named, and whether permissive licences alone satisfy the expression."""
    stack: list[tuple[set[str], bool, str]] = []
    for token in rpn:
        if token not in _RANK:
            stack.append(({token}, token in PERMISSIVE, token))
            continue
        (right, right_free, right_name), (left, left_free, left_name) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, left_free or (left_name, right_name) in PERMISSIVE_WITH, left_name))
        else:
            stack.append((left | right, left_free and right_free if token == "and" else left_free or right_free, ""))
    names, free, _ = stack.pop()
    return names, free


@functools.lru_cache(maxsize=4)
def _automaton(phrases: tuple[tuple[str, str, bool], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label, base in phrases:
        found.add_word(f" {phrase} ", (label, base, len(phrase) + 2))
    for tag in TAGS:
        found.add_word(f" {tag} ", (None, False, len(tag) + 2))
    found.make_automaton()
    return found


def scan_text(text: str | None, phrases: tuple[tuple[str, str, bool], ...]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive of one text."""
    words = (text or "").encode().translate(_TO_WORDS).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, [], None
    line = b" ".join([b"", *words, b""]).decode()
    starts, base, longest, tagged = [], set(), {}, False
    for end, (label, is_base, size) in _automaton(phrases).iter(line):
        if label is None:
            tagged = True
        elif is_base:
            base.add(label)
            starts.append(end - size + 1)
        else:
            # Of notices that begin at one place, the longest says which licence is meant; it ends last.
            longest[end - size + 1] = label
    notices = base | set(longest.values())
    labels = set(notices)
    score = SURE_NOTICE if notices else 0.0
    permissive = all(x in PERMISSIVE for x in notices) if notices else None
    expressions = []
    if tagged:
        for match in _TAG_LINE.finditer(text):
            try:
                names, free = evaluate(to_rpn(match.group(1)))
            except ValueError:
                score = max(score, SURE_BROKEN)
                continue
            expressions.append(match.group(1).strip())
            labels |= names
            score = SURE_EXPRESSION
            permissive = free if permissive is None else permissive and free
    first = line.count(" ", 0, min(starts) + 1) - 1 if starts else None
    last = line.count(" ", 0, max(starts) + 1) - 1 if starts else None
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, permissive


_OUT = [
    ("n_words", "BIGINT", pa.int64()), ("n_base", "BIGINT", pa.int64()), ("first_word", "BIGINT", pa.int64()),
    ("last_word", "BIGINT", pa.int64()), ("base_labels", "STRING", pa.string()), ("labels", "STRING", pa.string()),
    ("score", "DOUBLE", pa.float64()), ("expressions", "ARRAY<STRING>", pa.list_(pa.string())), ("permissive", "BOOLEAN", pa.bool_()),
]


def scan(
    docs: DataFrame, text: str = "text", base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES
) -> DataFrame:
    """``docs`` without the text, with what its text says about licences.

    ``n_base`` counts every place of a base phrase, first_word and last_word are the smallest and largest of their
    first words (null if none). ``labels`` has the labels of all phrases and the licences of all expressions, sorted.
    ``score`` is how sure the surest finding is, 0 without one. ``permissive`` tells whether permissive licences
    satisfy everything found, null if nothing is. Each text is scanned whole in one pass; null and empty texts have no
    words. Columns of ``docs`` with one of the new names are replaced.
    """
    names = [n for n, _, _ in _OUT]
    rest = docs.drop(*[n for n in names if n in docs.columns and n != text])
    phrases = tuple((p, x, True) for p, x in base.items()) + tuple((p, x, False) for p, x in more.items() if p not in base)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(x.as_py(), phrases) for x in batch.column(text)]
            kept = [n for n in batch.schema.names if n != text]
            columns = [pa.array([row[i] for row in found], kind) for i, (_, _, kind) in enumerate(_OUT)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + columns, kept + names)

    return rest.mapInArrow(run, ", ".join(fields + [f"{n} {kind}" for n, kind, _ in _OUT]))
