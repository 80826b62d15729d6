"""Pieces of SQL shared by the equivalents of several queries."""

from __future__ import annotations

from ..params import BLANKS, FORMAT_PREFIXES

NL = "chr(10)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def strip(expr: str) -> str:
    return f"trim({expr}, {text(BLANKS)})"


def tokens(expr: str) -> str:
    return rf"regexp_extract_all(lower({expr}), '([\p{{L}}\p{{N}}_]+)')"


def is_table(expr: str) -> str:
    lines = f"string_split({strip(expr)}, {NL})"
    pipes = f"list_distinct(list_transform({lines}, lambda l: length(l) - length(replace(l, '|', ''))))"
    ruled = f"len(list_filter({lines}, lambda l: regexp_matches({strip('l')}, '^[-+|]+$'))) > 0"
    bare = f"trim({strip('l')}, '|')"
    cells = f"list_distinct(list_transform({lines}, lambda l: length({bare}) - length(replace({bare}, '|', '')) + 1))"
    return f"(len({lines}) >= 2 AND len({pipes}) = 1 AND ({ruled} OR (len({cells}) = 1 AND ({cells})[1] > 1)))"


def text_format(expr: str) -> str:
    bare = strip(expr)
    return rf"""CASE
      WHEN regexp_matches({expr}, '\|[\s-]*\|') AND (contains({expr}, '---') OR contains({expr}, '===')) THEN 'table'
      WHEN starts_with({bare}, '{{') AND ends_with({bare}, '}}') AND json_valid({expr}) THEN 'json'
      WHEN regexp_matches({expr}, '(?s)<[\p{{L}}\p{{N}}_]+>.*</[\p{{L}}\p{{N}}_]+>') OR starts_with({bare}, '<') THEN 'markup'
      WHEN regexp_matches({expr}, '(?m)^\s*[-*•]\s+') OR regexp_matches({expr}, '(?m)^\s*[0-9]+\.\s+') THEN 'list'
      ELSE 'text' END"""


def format_prefix(kind: str) -> str:
    cases = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in FORMAT_PREFIXES.items())
    return f"CASE {kind} {cases} ELSE '' END"


def separator_chunks(docs: str) -> str:
    """CTEs ending in ``chunks(id, chunk, total_chunks, content)``; ``docs`` selects (id, txt, size, overlap, seps)."""
    end = "len(w) - strpos(reverse(w), reverse(s)) + 1"
    usable = f"list_filter(seps, lambda s: strpos(reverse(w), reverse(s)) > 0 AND {end} > overlap)"
    return f"""
    src AS ({docs}),
    cut AS (
      SELECT id, -1::BIGINT AS chunk, 0::BIGINT AS start, 0::BIGINT AS stop, 0::BIGINT AS follow, false AS done
      FROM src WHERE length(txt) > 0
      UNION ALL
      SELECT id, chunk, start, stop, stop - overlap, done FROM (
        SELECT id, chunk + 1 AS chunk, start, overlap, last AS done,
               CASE WHEN last THEN n ELSE start + coalesce(list_transform(({usable})[1:1], lambda s: {end})[1], size) END AS stop
        FROM (
          SELECT c.id, c.chunk, c.follow AS start, s.overlap, s.size, s.seps, length(s.txt) AS n,
                 c.follow + s.size >= length(s.txt) AS last, substring(s.txt, c.follow + 1, s.size) AS w
          FROM cut c JOIN src s ON c.id = s.id WHERE NOT c.done
        )
      )
    ),
    chunks AS (
      SELECT c.id, c.chunk, count(*) OVER (PARTITION BY c.id) AS total_chunks,
             substring(d.txt, c.start + 1, c.stop - c.start) AS content
      FROM cut c JOIN src d ON c.id = d.id WHERE c.chunk >= 0
    )"""


def regex_chunks(docs: str, pattern: str, size: int, overlap: int) -> str:
    """CTEs ending in ``chunks(id, chunk, total_chunks, content)``; ``docs`` selects (id, txt)."""
    step = size - overlap
    windows = (
        f"list_transform(range(0, (length(seg) - {overlap})::BIGINT, {step}), "
        f"lambda i: substring(seg, i + 1, {size}))"
    )
    return f"""
    src AS (
      SELECT id, list_filter(list_transform(string_split_regex(txt, '{pattern}'), lambda p: {strip('p')}), lambda p: p <> '') AS segs
      FROM ({docs}) WHERE txt <> ''
    ),
    big AS (SELECT id, segs FROM src WHERE len(list_filter(segs, lambda p: length(p) > {size})) > 0),
    walk AS (
      SELECT id, 0::BIGINT AS i, '' AS cur, []::VARCHAR[] AS outp FROM big
      UNION ALL
      SELECT id, i + 1,
        CASE WHEN i = n THEN '' WHEN length(cur) + length(seg) <= {size} THEN CASE WHEN cur = '' THEN seg ELSE cur || ' ' || seg END
             WHEN length(seg) > {size} THEN '' ELSE seg END,
        list_concat(
          CASE WHEN cur <> '' AND (i = n OR length(cur) + length(seg) > {size}) THEN [cur] ELSE []::VARCHAR[] END,
          CASE WHEN i < n AND length(seg) > {size} THEN {windows} ELSE []::VARCHAR[] END)
      FROM (SELECT w.id, w.i, w.cur, len(b.segs) AS n, coalesce(b.segs[w.i + 1], '') AS seg
            FROM walk w JOIN big b ON w.id = b.id WHERE w.i <= len(b.segs))
    ),
    pieces AS (
      SELECT id, i, unnest(outp) AS content, generate_subscripts(outp, 1) AS j FROM walk
      UNION ALL
      SELECT id, generate_subscripts(segs, 1)::BIGINT, unnest(segs), 0 FROM src WHERE id NOT IN (SELECT id FROM big)
    ),
    chunks AS (
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) - 1 AS chunk,
             count(*) OVER (PARTITION BY id) AS total_chunks, content
      FROM pieces
    )"""


def bm25(name: str, k: int, k1: float = 1.2, b: float = 0.75, prefix: str = "") -> str:
    """CTEs ending in ``<name>(query_id, doc_id, score, rank)`` for benchmark over documents."""
    p = prefix or name
    return f"""
    {p}_tok AS (SELECT doc_id, {tokens('text')} AS ts FROM documents),
    {p}_terms AS (SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark),
    {p}_post AS (
      SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM {p}_tok)
      WHERE term IN (SELECT term FROM {p}_terms) GROUP BY ALL
    ),
    {p}_df AS (
      SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
      FROM {p}_post GROUP BY term
    ),
    {p}_score AS (
      SELECT query_id, doc_id, round(sum(idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / (SELECT avg(len(ts)) FROM {p}_tok)))), 9) AS score
      FROM {p}_post JOIN {p}_terms USING (term) JOIN {p}_df USING (term) GROUP BY query_id, doc_id
    ),
    {name} AS (
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
      FROM {p}_score QUALIFY rank <= {k}
    )"""


def knn(name: str, k: int, keep: str = "true") -> str:
    """CTE ``<name>(query_id, doc_id, distance, rank)``: every vector against all vectors."""
    return f"""
    {name} AS (
      SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
             list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) ** 2 AS distance,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 12), d.vec_id) AS rank
      FROM embeddings q, embeddings d WHERE {keep} QUALIFY rank <= {k}
    )"""


LABEL_CENTERS = """
    elements AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    means AS (SELECT label, pos, avg(x) AS x FROM elements GROUP BY label, pos),
    centers AS (SELECT label, list(x ORDER BY pos) AS vec FROM means GROUP BY label)"""
