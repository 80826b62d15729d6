"""SQL equivalents of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

import math

from . import licenses, mixing, quality, repair

#: ASCII white space ends a word.
WORD = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SIMILAR = f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORD}) AS ws FROM documents
    ),
    sets AS (
      SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws)::BIGINT - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w
    ),
    tokens AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS t FROM sets),
    shared AS (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1),
    few AS (SELECT doc_id, n, t FROM tokens SEMI JOIN shared USING (t)),
    links AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM few a JOIN few b ON a.t = b.t AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ),
    reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
    SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
    FROM sets s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s"""


ARCHIVES = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, h, octet_length(encode(h))::BIGINT AS n, min(page_id) OVER (PARTITION BY h) AS lead FROM p)
    SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> lead THEN lead END AS refers_to
    FROM q"""


def _places(phrase: str) -> str:
    words = phrase.split(" ")
    here = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"list_filter(range(1, len(ws)::BIGINT + 1), lambda i: {here})"


def _stands(phrase: str) -> str:
    """Whether a phrase stands somewhere and not only as the begin of a longer one."""
    line = "line"
    for longer in licenses.MORE_PHRASES:
        if longer.startswith(f"{phrase} ") and phrase in licenses.MORE_PHRASES:
            line = f"replace(replace({line}, ' {longer} ', ' | '), ' {longer} ', ' | ')"
    return f"contains({line}, ' {phrase} ')"


_EVERY = {**licenses.MORE_PHRASES, **licenses.BASE_PHRASES}
#: Licence expressions after tags are beyond SQL; the tables that this is compared on have no such tags.
LICENSES = f"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
    ),
    j AS (
      SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS line,
             list_sort(list_concat({", ".join(_places(p) for p in licenses.BASE_PHRASES)})) AS places FROM w
    ),
    k AS (
      SELECT *, list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN contains(line, ' {p} ') THEN '{x}' END" for p, x in licenses.BASE_PHRASES.items())}], lambda x: x IS NOT NULL))) AS base,
             list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN {_stands(p)} THEN '{x}' END" for p, x in _EVERY.items())}], lambda x: x IS NOT NULL))) AS every
      FROM j
    )
    SELECT doc_id, len(ws)::BIGINT AS n_words, len(places)::BIGINT AS n_base, places[1] - 1 AS first_word, places[len(places)] - 1 AS last_word,
           array_to_string(base, ',') AS base_labels, array_to_string(every, ',') AS labels,
           CASE WHEN len(every) > 0 THEN {licenses.SURE_NOTICE} ELSE 0.0 END::DOUBLE AS score,
           CASE WHEN len(every) > 0 THEN len(list_filter(every, lambda x: NOT list_contains({_list(sorted(licenses.PERMISSIVE))}, x))) = 0 END AS permissive
    FROM k"""


_GROWTH = math.log((1 + quality.ACCURACY) / (1 - quality.ACCURACY))
_LOW = math.floor(math.log(quality.LEAST) / _GROWTH) - 1
_RATIOS = {
    "symbol_ratio": "n_symbols / greatest(n_words, 1)::DOUBLE", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)::DOUBLE",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)::DOUBLE", "word_length": "word_chars / greatest(n_words, 1)::DOUBLE",
}


def _far() -> str:
    parts = []
    for name, column in _RATIOS.items():
        limit = f"(SELECT {'q3' if name in quality.TWO_SIDED else 'q2'} + width FROM fences f WHERE f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source AND f.measure = '{name}')"
        parts.append(f"coalesce({column} > {limit}, false)")
        if name in quality.TWO_SIDED:
            parts.append(f"coalesce({column} < {limit.replace('q3 + width', 'q1 - width')}, false)")
    return " OR ".join(parts)


QUALITY = f"""
    WITH w AS (
      SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents
    ),
    windows AS (
      SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws)::BIGINT - 3)) AS i FROM w WHERE len(ws) >= 5)
    ),
    again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
    dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, {WORD}) GROUP BY doc_id),
    m AS (
      SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n_lines, 0)::BIGINT AS n_lines, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id
    ),
    v AS (
      SELECT lang, source, {_list(_RATIOS)}[k] AS measure, [{", ".join(_RATIOS.values())}][k] AS v
      FROM m, (SELECT unnest(range(1, {len(_RATIOS) + 1})) AS k)
      WHERE n_words >= {quality.MIN_WORDS} AND 100 * n_repeat_words <= {quality.MAX_REPEAT_PERCENT} * n_words
    ),
    sketch AS (
      SELECT lang, source, measure, CASE WHEN v <= {quality.LEAST} THEN {_LOW} ELSE ceil(ln(v) / {_GROWTH!r})::INT END AS bucket, count(*) AS n
      FROM v GROUP BY ALL
    ),
    run AS (
      SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY lang, source, measure) AS total,
             CASE WHEN bucket = {_LOW} THEN 0.0 ELSE exp(bucket * {_GROWTH!r}) * (1 - {quality.ACCURACY}) END AS middle FROM sketch
    ),
    quartiles AS (
      SELECT lang, source, measure, min(middle) FILTER (seen >= total * 0.25) AS q1, min(middle) FILTER (seen >= total * 0.5) AS q2, min(middle) FILTER (seen >= total * 0.75) AS q3
      FROM run GROUP BY ALL
    ),
    fences AS (
      SELECT *, CASE measure {" ".join(f"WHEN '{k}' THEN greatest({'q3 - q1' if k in quality.TWO_SIDED else f'least(q3 - q1, {x} * {quality.MOST_SPREAD})'}, {x})" for k, x in quality.SPREAD.items())} END * {quality.FENCE} AS width
      FROM quartiles
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ({_far()}) AS kept
    FROM m"""


MIX = f"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size,
             ('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT >> 2 AS bits FROM documents
    ),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
          FROM d GROUP BY source),
    f AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS full_at FROM s),
    l AS (
      SELECT *, row_number() OVER o AS place,
             ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM f WINDOW o AS (ORDER BY full_at, source NULLS LAST)
    ),
    first AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM l WHERE level <= full_at),
    t AS (
      SELECT source, source_size, CASE WHEN l.place >= first.place THEN least(first.level * weight, cap) ELSE cap END AS target FROM l, first
    ),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
    cells AS (SELECT source, bits, sum(size)::BIGINT AS inside FROM d GROUP BY source, bits),
    runs AS (SELECT *, (sum(inside) OVER (PARTITION BY source ORDER BY bits))::BIGINT - inside AS start FROM cells),
    cuts AS (
      SELECT p.source, arg_max(bits + CASE WHEN abs(start + inside - (target - times * source_size)) <= abs(start - (target - times * source_size)) THEN 1 ELSE 0 END, bits) AS cut
      FROM runs r JOIN p ON p.source IS NOT DISTINCT FROM r.source WHERE target - times * source_size > 0 AND start < target - times * source_size GROUP BY p.source
    )
    SELECT doc_id, size, p.source_size, p.target, size * (times + CASE WHEN bits < coalesce(cut, 0) THEN 1 ELSE 0 END) AS taken
    FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source LEFT JOIN cuts c ON c.source IS NOT DISTINCT FROM d.source"""


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by its polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def _crc(text: str) -> str:
    """CRC-32 of ASCII text."""
    steps = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({steps}, lambda a, b: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


TRIE = f"""
    WITH t AS (
      SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
      FROM conversations WHERE conv_id IS NOT NULL
    ),
    ids AS (SELECT c, {_crc("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
    built AS (
      SELECT i.c, 0 AS part, place, role, text FROM ids i JOIN t ON t.c = i.c - i.c % 20 AND place <= h
      UNION ALL SELECT i.c, 1, place, role, text FROM ids i JOIN t ON t.c = i.c AND place > h
    ),
    paths AS (
      SELECT i.c, coalesce(list({{'role': role, 'text': text}} ORDER BY part, place) FILTER (text IS NOT NULL), []) AS p
      FROM ids i LEFT JOIN built b ON b.c = i.c GROUP BY i.c
    ),
    members AS (SELECT c, d, p[1:d] AS k, len(p) = d AS ended FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM paths)),
    nodes AS (
      SELECT d, k, min(c) AS least, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '') AS ends,
             CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(k[d].text, {WORD})) END AS saved
      FROM members GROUP BY d, k
    ),
    kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
    below AS (
      SELECT a AS d, k[1:a] AS k, sum(saved) AS saved, sum(leaf) AS leaves
      FROM (SELECT n.k, n.saved, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, n.d + 1)) AS a
            FROM nodes n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k) GROUP BY ALL
    )
    SELECT n.least AS conv_id, n.d AS depth, up.least AS parent_conv_id, n.n AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
           below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM nodes n JOIN below ON below.d = n.d AND below.k = n.k LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k
    LEFT JOIN nodes up ON up.d = n.d - 1 AND up.k = n.k[1:n.d - 1]"""


def _ways(to: int) -> str:
    """The ways of one row to a position of the role pattern, as a list of cost, edits and repaired lines."""
    out = []
    line = "|| chr(10) || {} || ':' || {}"
    for x in range(4):
        y, added, lines = x, "", ""
        for k in range(3):
            for op in "DKR":
                ends = [y] if op == "D" else [v for (u, _), v in repair._KEEP.items() if u == y and v == to] if op == "K" else [repair._NEXT[y]]
                if to not in ends:
                    continue
                when, more, cost = f"s[{x + 1}] IS NOT NULL", "", str(k * repair.COST["I"] + repair.COST[op])
                if op != "D":
                    initial = next((i for (u, i), v in repair._KEEP.items() if (u, v) == (y, to)), "")
                    when += " AND fault NOT IN ('blank', 'duplicate')" + (f" AND role[1] = '{initial}'" if op == "K" else "")
                    more = line.format("role" if op == "K" else f"'{repair._NAME[to]}'", "text")
                    cost += " + (fault = 'truncated')::INT"
                out.append(
                    f"CASE WHEN {when} THEN {{'cost': s[{x + 1}].cost + {cost}, 'edits': s[{x + 1}].edits || '{added}{op}', 'lines': s[{x + 1}].lines {lines} {more}}} END"
                )
            y, added = repair._NEXT[y], added + "I"
            lines += line.format(f"'{repair._NAME[y]}'", "''")
    return f"list_sort(list_filter([{', '.join(out) or 'NULL'}], lambda w: w IS NOT NULL))[1]"


def _last_ways() -> str:
    out = []
    for x in range(4):
        y, added, lines = x, "", ""
        for k in range(3):
            if y in repair._DONE:
                out.append(
                    f"CASE WHEN s[{x + 1}] IS NOT NULL THEN {{'cost': s[{x + 1}].cost + {k * repair.COST['I']}, 'edits': s[{x + 1}].edits || '{added}', 'lines': s[{x + 1}].lines {lines}}} END"
                )
            y, added = repair._NEXT[y], added + "I"
            lines += f"|| chr(10) || '{repair._NAME[y]}:'"
    return f"list_sort(list_filter([{', '.join(out)}], lambda w: w IS NOT NULL))[1]"


_WAY = "STRUCT(cost BIGINT, edits VARCHAR, lines VARCHAR)"
REPAIR = f"""
    WITH RECURSIVE k AS (
      SELECT conv_id::BIGINT AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations
    ),
    damaged AS (
      SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM k)
    ),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth
      FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)
    ),
    rows AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
             lag(role[1]) OVER (PARTITION BY c ORDER BY i) || role[1] AS pair FROM placed
    ),
    ways AS (
      SELECT c, 0::BIGINT AS i, [{{'cost': 0, 'edits': '', 'lines': ''}}, NULL, NULL, NULL]::{_WAY}[] AS s FROM (SELECT DISTINCT c FROM k)
      UNION ALL
      SELECT w.c, w.i + 1, [{", ".join(_ways(to) for to in range(4))}]::{_WAY}[] FROM ways w JOIN rows r ON r.c IS NOT DISTINCT FROM w.c AND r.i = w.i + 1
    ),
    ended AS (SELECT c, {_last_ways()} AS best FROM ways QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1),
    counts AS (
      SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c
    )
    SELECT e.c AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.edits AS audit,
           sha256(best.lines[2:]) AS repaired_sha256
    FROM ended e LEFT JOIN counts n ON n.c IS NOT DISTINCT FROM e.c"""
