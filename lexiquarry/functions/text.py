"""Text expressions: every function takes and returns columns."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..params import BLANKS, FORMAT_PREFIXES, RETRIEVAL_INSTRUCTION

NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_FLOAT = rf"^({NUMBER}|[+-]?(?i:inf|infinity|nan))$"
_DATE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2})"
_BOOLEANS = ("true", "false", "yes", "no", "y", "n")
_WORD = r"([\p{L}\p{N}_]+)"
_CJK = r"[一-鿿]"
_CJK_OR_WORD = r"([一-鿿]+|[[\p{L}\p{N}_]&&[^一-鿿]]+)"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def once(values: Column) -> Column:
    """An array to be exploded that is computed only once.

    Exploding a plain column makes Spark infer a filter on its size and push
    it down, often below a shuffle, where the column is computed again.
    """
    return bind(values, lambda v: v)


def strip(text: Column) -> Column:
    """Cut blanks of any kind off both ends."""
    return F.btrim(text, F.lit(BLANKS))


def count_of(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def preview(text: Column, size: int = 200) -> Column:
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def with_instruction(text: Column, instruction: str = RETRIEVAL_INSTRUCTION) -> Column:
    """Put the retrieval instruction in front, unless it is already there."""
    return F.when(text.startswith(instruction), text).otherwise(F.concat(F.lit(instruction + " "), text))


# ---- tokens -----------------------------------------------------------------

def tokens(text: Column) -> Column:
    """Lower-case words; runs of CJK characters become overlapping pairs."""
    low = F.lower(text)

    def pairs(run: Column) -> Column:
        return F.when(
            run.rlike(_CJK) & (F.length(run) > 1),
            F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))),
        ).otherwise(F.array(run))

    mixed = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(_CJK_OR_WORD), F.lit(1)), pairs))
    return F.when(low.rlike(_CJK), mixed).otherwise(F.regexp_extract_all(low, F.lit(_WORD), F.lit(1)))


def ngrams(words: Column, stop_words=(), low: int = 1, high: int = 2) -> Column:
    """Drop stop words, then list all runs of ``low`` to ``high`` words joined by a blank."""
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))

    def runs(ws: Column, n: int) -> Column:
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(n)]))

    def grams(ws: Column) -> Column:
        return F.concat(*[ws if n == 1 else runs(ws, n) for n in range(low, high + 1)])

    return bind(words, grams)


# ---- recognizing shapes -----------------------------------------------------

def is_table_text(text: Column) -> Column:
    """Two or more lines with equally many pipes, and a separator line or equal cell counts above one."""

    def check(lines: Column) -> Column:
        pipes = F.array_distinct(F.transform(lines, lambda l: count_of(l, "|")))
        ruled = F.exists(lines, lambda l: strip(l).rlike(r"^[-+|]+$"))
        cells = F.array_distinct(
            F.transform(lines, lambda l: count_of(F.btrim(strip(l), F.lit("|")), "|") + 1)
        )
        return (F.size(lines) >= 2) & (F.size(pipes) == 1) & (ruled | ((F.size(cells) == 1) & (cells[0] > 1)))

    return bind(F.split(strip(text), "\n", -1), check)


def detect_format(text: Column) -> Column:
    """table, json, markup, list or text; the first that fits."""
    bare = strip(text)
    table = text.rlike(r"\|[\s-]*\|") & (text.contains("---") | text.contains("==="))
    as_json = bare.startswith("{") & bare.endswith("}") & F.try_parse_json(text).isNotNull()
    # A closing tag after the first opening tag; two linear scans instead of one backtracking pattern.
    opening = F.regexp_instr(text, F.lit(r"<[\p{L}\p{N}_]+>"))
    closed = F.substring(text, opening, F.length(text)).rlike(r"</[\p{L}\p{N}_]+>")
    markup = bare.startswith("<") | ((opening > 0) & closed)
    listed = text.rlike(r"(?md)^\s*[-*•]\s+") | text.rlike(r"(?md)^\s*[0-9]+\.\s+")
    return (
        F.when(table, "table").when(as_json, "json").when(markup, "markup").when(listed, "list").otherwise("text")
    )


@arrow_udf(T.StringType())
def _indent_json(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False) for t in texts.to_pylist()],
        type=pa.string(),
    )


def pretty_json(text: Column, kind: Column | None = None) -> Column:
    """Re-serialize JSON objects with an indent of two; other text is unchanged.

    Spark's own pretty printer reorders keys or turns values into strings, so
    rows already known to be JSON (and only those) go through Python's.
    """
    kind = detect_format(text) if kind is None else kind
    return F.coalesce(_indent_json(F.when(kind == "json", text)), text)


def format_prefix(kind: Column) -> Column:
    prefix = F.lit("")
    for name, value in FORMAT_PREFIXES.items():
        prefix = F.when(kind == name, value).otherwise(prefix)
    return prefix


def guess_type(value: Column) -> Column:
    """NUMERIC, DATETIME, BOOLEAN or TEXT, in that order."""
    return (
        F.when(strip(value).rlike(_FLOAT), "NUMERIC")
        .when(value.rlike(_DATE), "DATETIME")
        .when(F.lower(value).isin(*_BOOLEANS), "BOOLEAN")
        .otherwise("TEXT")
    )


def to_number(value: Column, unit_suffix: bool = False) -> Column:
    """The value as a double, or null; with ``unit_suffix`` the number in front of a unit counts."""
    bare = strip(value)
    if unit_suffix:
        lead = F.regexp_extract(bare, rf"^({NUMBER})", 1)
        return F.when(lead != "", lead.try_cast("double"))
    return F.when(bare.rlike(_FLOAT), bare.try_cast("double"))


# ---- key/value text ---------------------------------------------------------

def alias_map(aliases) -> dict[str, str]:
    """Lower-case alias to standard name; the first registration wins."""
    table: dict[str, str] = {}
    for name, _, others in aliases:
        table.setdefault(name.lower(), name)
    for name, _, others in aliases:
        for other in others:
            table.setdefault(other.lower().strip(), name)
    return table


def standard_name(key: Column, aliases: dict[str, str] | None = None) -> Column:
    low = strip(F.lower(key))
    if not aliases:
        return low
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.get(F.array(F.try_element_at(table, low)), F.lit(0)), low)


def _last_wins(pairs: Column) -> Column:
    """Array of (key, value) to a map in which the last value of a key counts."""
    numbered = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value")))

    def keep(ordered: Column) -> Column:
        last = F.filter(
            ordered,
            lambda p, i: F.coalesce(F.get(ordered, i + 1)["key"] != p["key"], F.lit(True)),
        )
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))

    return bind(F.array_sort(numbered), keep)


def parse_kv(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """``key: value`` lines, pieces between `` | ``, or a pipe table with one data row, as a map."""

    def pairs(pieces: Column) -> Column:
        return F.transform(
            F.filter(pieces, lambda p: p.contains(": ")),
            lambda p: F.struct(
                standard_name(F.substring_index(p, ": ", 1), aliases).alias("key"),
                strip(F.substring(p, F.instr(p, ": ") + 2, F.length(p))).alias("value"),
            ),
        )

    def cells(line: Column) -> Column:
        return F.filter(F.transform(F.split(line, r"\|", -1), strip), lambda c: c != "")

    def table(lines: Column) -> Column:
        fits = (
            (F.size(lines) >= 3)
            & F.forall(lines, lambda l: l.contains("|"))
            & (F.size(cells(F.get(lines, F.lit(0)))) == F.size(cells(F.get(lines, F.lit(2)))))
        )
        row = F.transform(
            F.arrays_zip(
                cells(F.get(lines, F.lit(0))).alias("k"), cells(F.get(lines, F.lit(2))).alias("v")
            ),
            lambda z: F.struct(standard_name(z["k"], aliases).alias("key"), z["v"].alias("value")),
        )
        return F.when(fits, row)

    lines = F.split(text, "\n", -1)
    full = F.filter(F.transform(lines, strip), lambda l: l != "")
    by_line = bind(
        pairs(lines),
        lambda found: F.when(F.size(found) > 0, found).otherwise(bind(full, table)),
    )
    found = F.when(text.contains("\n"), by_line).when(text.contains(" | "), pairs(F.split(text, r" \| ", -1)))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return _last_wins(F.coalesce(found.cast("array<struct<key:string,value:string>>"), empty))


def document_identity(doc_id: Column, source: Column, chunk: Column, content: Column) -> Column:
    """The id, else source and chunk, else a hash of the content."""
    return F.coalesce(
        doc_id.cast("string"),
        F.when(source.isNotNull(), F.concat(source, F.lit("#"), F.coalesce(chunk.cast("string"), F.lit("0")))),
        F.md5(content),
    )
