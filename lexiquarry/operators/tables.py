"""Tables as pipe-separated text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bind, once, strip
from ..params import DELIMITERS, ROWS_PER_CHUNK
from .numbering import number_rows


def _row_line(columns: list[str], preserve_empty: bool) -> Column:
    blank = F.lit("nan" if preserve_empty else "")
    cells = [F.coalesce(F.col(c).cast("string"), blank) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _head_lines(columns: list[str]) -> tuple[str, str]:
    return "| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |"


def table_to_markdown(
    df: DataFrame, order_by: str, columns: list[str] | None = None, preserve_empty: bool = False
) -> DataFrame:
    """The lines of the pipe table of ``df``: (line_no, line), with header and rule as lines 0 and 1.

    A table of any size stays distributed; writing the lines in order gives the text.
    """
    columns = columns or df.columns
    header, rule = _head_lines(columns)
    body = number_rows(df, order_by, name="_rn").select(
        (F.col("_rn") + 1).alias("line_no"), _row_line(columns, preserve_empty).alias("line")
    )
    head = df.sparkSession.range(2).select(
        F.col("id").alias("line_no"), F.when(F.col("id") == 0, header).otherwise(rule).alias("line")
    )
    return head.unionByName(body)


def chunk_rows(
    df: DataFrame,
    order_by: str,
    n: int = ROWS_PER_CHUNK,
    source_col: str | None = None,
    columns: list[str] | None = None,
    preserve_empty: bool = False,
) -> DataFrame:
    """Blocks of ``n`` rows per source as pipe tables, with their place in the source."""
    columns = columns or [c for c in df.columns if c != source_col]
    keys = [source_col] if source_col else []
    header, rule = _head_lines(columns)
    numbered = number_rows(df, order_by, keys, name="_rn", total="_total")
    lines = numbered.select(
        *keys,
        F.floor((F.col("_rn") - 1) / n).alias("chunk_index"),
        "_rn",
        "_total",
        _row_line(columns, preserve_empty).alias("_line"),
    )
    # A block has at most n rows, so its list is bounded.
    blocks = lines.groupBy(*keys, "chunk_index").agg(
        F.sort_array(F.collect_list(F.struct("_rn", "_line"))).alias("_lines"),
        F.max("_total").alias("_total"),
    )
    return blocks.select(
        *keys,
        "chunk_index",
        F.ceil(F.col("_total") / n).alias("total_chunks"),
        (F.col("chunk_index") * n).alias("row_start"),
        F.least((F.col("chunk_index") + 1) * n, F.col("_total")).alias("row_end"),
        F.array(*map(F.lit, columns)).alias("columns"),
        F.concat_ws("\n", F.lit(header), F.lit(rule), F.col("_lines._line")).alias("content"),
    )


def _cells(line: Column) -> Column:
    bare = F.btrim(strip(line), F.lit("|"))
    return F.transform(F.split(bare, r"\|", -1), strip)


def _fitted(cells: Column, width: Column) -> Column:
    """Padded with empty cells or cut to the width of the header."""
    return bind(
        cells,
        lambda cs: F.slice(
            F.concat(cs, F.array_repeat(F.lit(""), F.greatest(width - F.size(cs), F.lit(0)))), F.lit(1), width
        ),
    )


def is_rule(line: Column) -> Column:
    """A line of dashes, pluses, pipes, colons and blanks with at least one dash."""
    return strip(line).rlike(r"^[-+|:\s]*-[-+|:\s]*$")


def read_markdown_table(
    df: DataFrame, text_col: str = "content", columns: list[str] | None = None
) -> DataFrame:
    """Rows of the pipe tables in ``text_col``: other columns, ``row_no`` and the cells.

    Short rows are padded with empty cells and long rows cut. Cells come as a
    map from header to text, or as one string column per name in ``columns``.
    """
    keep = [c for c in df.columns if c != text_col]
    lines = F.filter(F.split(strip(F.col(text_col)), "\n", -1), lambda l: strip(l) != "")
    parsed = df.select(*keep, lines.alias("_lines")).where(F.size("_lines") >= 2)
    body_at = F.when(is_rule(F.get("_lines", F.lit(1))), 3).otherwise(2)
    parsed = parsed.select(
        *keep,
        _cells(F.get("_lines", F.lit(0))).alias("_header"),
        F.slice("_lines", body_at, F.greatest(F.size("_lines") - body_at + 1, F.lit(0))).alias("_body"),
    )
    rows = parsed.select(*keep, "_header", F.posexplode(once(F.col("_body"))).alias("row_no", "_line"))
    rows = rows.select(*keep, "row_no", "_header", _fitted(_cells(F.col("_line")), F.size("_header")).alias("_cells"))
    if columns is None:
        # A repeated header keeps its first column.
        pairs = F.filter(
            F.arrays_zip(F.col("_header").alias("key"), F.col("_cells").alias("value")),
            lambda p, i: F.array_position(F.col("_header"), p["key"]) == i + 1,
        )
        return rows.select(*keep, "row_no", F.map_from_entries(pairs).alias("cells"))
    picked = [
        F.get("_cells", (F.array_position("_header", F.lit(c)) - 1).cast("int")).alias(c) for c in columns
    ]
    return rows.select(*keep, "row_no", *picked)


def _table_lines(text: Column) -> Column:
    return F.filter(F.split(strip(text), "\n", -1), lambda l: strip(l) != "")


def _body_start(lines: Column) -> Column:
    return F.when(is_rule(F.get(lines, F.lit(1))), 3).otherwise(2)


def markdown_rows(text: Column) -> Column:
    """How many rows a pipe table has below its header; 0 for a text that is none."""
    lines = _table_lines(text)
    return F.coalesce(F.greatest(F.size(lines) - _body_start(lines) + 1, F.lit(0)), F.lit(0))


#: A record of a delimited text: line breaks within quotes belong to it.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"?'
_RECORD = rf'(?:[^"\r\n]++|{_QUOTED})++'


def delimited_records(text: Column) -> Column:
    """The records of a delimited text that hold something, the header first."""
    return F.filter(F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0)), lambda r: strip(r) != "")


def header_delimiter(header: Column) -> Column:
    """The delimiter most frequent in the header, the first of them in a tie; a comma if there is none."""
    counts = F.array(*[F.struct(F.length(header) - F.length(F.replace(header, F.lit(d), F.lit(""))), F.lit(-i), F.lit(d).alias("d"))
                       for i, d in enumerate(DELIMITERS)])
    return F.array_max(counts)["d"]


def _delimited_cells(record: Column, delimiter: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    pattern = F.concat(quoted, F.lit(f"({_QUOTED}|[^"), F.concat(F.lit("\\"), F.when(delimiter == "\t", "t").otherwise(delimiter)), F.lit("]*+)"))
    cells = F.regexp_extract_all(F.concat(delimiter, record), pattern, F.lit(1))
    return F.transform(cells, lambda c: strip(F.when(
        c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))
    ).otherwise(c)))


def _row_blocks(parsed: DataFrame, keep: list[str], n: int, text_col: str, cells_of) -> DataFrame:
    """Blocks of ``n`` rows with the header again; parsed: keep, columns, _body (and what ``cells_of`` needs)."""

    def bars(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    width, rows = F.size("columns"), F.size("_body")
    head = F.array(bars(F.col("columns")), bars(F.array_repeat(F.lit("---"), width)))

    def block(b: Column) -> Column:
        body = F.transform(F.slice("_body", b * n + 1, F.lit(n)), lambda l: bars(_fitted(cells_of(l), width)))
        return F.struct(
            b.alias("chunk_index"), (b * n).alias("row_start"), F.least((b + 1) * n, rows).alias("row_end"),
            F.array_join(F.concat(head, body), "\n").alias("content"),
        )

    total = F.ceil(rows / F.lit(n)).cast("int")
    blocks = F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1), block))
    return parsed.select(*keep, "columns", total.alias("total_chunks"), F.explode(once(blocks)).alias("_b")).select(
        *keep, "columns", "total_chunks", "_b.chunk_index", "_b.row_start", "_b.row_end", F.col("_b.content").alias(text_col)
    )


def markdown_blocks(df: DataFrame, n: int = ROWS_PER_CHUNK, text_col: str = "content") -> DataFrame:
    """Pipe tables cut into blocks of ``n`` rows, each with the header again.

    Like ``chunk_rows``, but for tables that arrive as texts: everything
    happens inside the row that holds the text, and headers may differ.
    """
    keep = [c for c in df.columns if c != text_col]
    parsed = df.select(*keep, _table_lines(F.col(text_col)).alias("_lines")).where(F.size("_lines") >= 2)
    start = _body_start(F.col("_lines"))
    parsed = parsed.select(
        *keep,
        _cells(F.get("_lines", F.lit(0))).alias("columns"),
        F.slice("_lines", start, F.greatest(F.size("_lines") - start + 1, F.lit(0))).alias("_body"),
    )
    return _row_blocks(parsed, keep, n, text_col, _cells)


def delimited_blocks(df: DataFrame, n: int = ROWS_PER_CHUNK, text_col: str = "content") -> DataFrame:
    """Delimited texts cut into blocks of ``n`` rows as pipe tables, each with the header again."""
    keep = [c for c in df.columns if c != text_col]
    parsed = df.select(*keep, F.explode(F.array(delimited_records(F.col(text_col)))).alias("_lines")).where(F.size("_lines") >= 2)
    parsed = parsed.select(*keep, "_lines", header_delimiter(F.get("_lines", F.lit(0))).alias("_sep"))
    parsed = parsed.select(
        *keep, "_sep", _delimited_cells(F.get("_lines", F.lit(0)), F.col("_sep")).alias("columns"),
        F.slice("_lines", F.lit(2), F.size("_lines") - 1).alias("_body"),
    )
    return _row_blocks(parsed, keep, n, text_col, lambda l: _delimited_cells(l, F.col("_sep")))


def markdown_fallback(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Texts with no row below a header; they stay plain documents."""
    return df.where(markdown_rows(F.col(text_col)) == 0)
