"""Queries that assemble answers: routes, prompts, lists, chats."""

from pyspark.sql import functions as F

from ..operators import answers as A, documents as D, hits as H, retrieval as R, search
from ..params import (
    EMPTY_MESSAGES, GENERAL_INTENT, INTENT_GUIDANCE, LIST_EMPTY, LIST_INTRO, LIST_UNSUPPORTED, PROMPT_CLOSING, PROMPT_DOCUMENTS, PROMPT_QUESTION, PROMPT_TASK,
    SYSTEM_PROMPT,
)
from . import sql as S
from ..plans import flows
from .registry import documents, query, query_vectors, table, vectors
from .tables import aliases, kv_line_docs
from .text import questions

# Questions of every kind: an opening by turn, then the text of the turn.
OPENINGS = ["最贵的", "有哪些", "推荐", "建议", "总结一下", "你好", "价格", ""]
ROUTES = ["comparison", "list", "list", "recommendation", "summary", "chat", "qa", "qa"]


def _opening_sql(values):
    return "CASE turn % 8 " + " ".join(f"WHEN {i} THEN {S.text(v)}" for i, v in enumerate(values)) + " END"


@query("route_question", f"SELECT conv_id, turn, {_opening_sql(ROUTES)} AS route FROM conversations")
def route_question(spark, folder):
    asked = F.concat(F.expr(_opening_sql(OPENINGS)), F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", D.route_question(asked).alias("route"))


@query("empty_result_message", f"""
    WITH hits AS (SELECT doc_id AS conv_id, count(*) AS n FROM labels WHERE quality = 1 GROUP BY 1)
    SELECT conv_id::VARCHAR || '-' || turn AS query_id, {_opening_sql(ROUTES)} AS route, coalesce(n, 0)::BIGINT AS n_hits,
      CASE WHEN n IS NULL THEN CASE {_opening_sql(ROUTES)} {' '.join(f"WHEN {S.text(k)} THEN {S.text(v)}" for k, v in EMPTY_MESSAGES.items())} END END AS answer
    FROM conversations LEFT JOIN hits USING (conv_id)""")
def empty_result_message(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id", F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        D.route_question(F.concat(F.expr(_opening_sql(OPENINGS)), F.col("text"))).alias("route"),
    )
    hits = table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id"), "doc_id")
    found = turns.join(hits, "conv_id").select("query_id", "doc_id")
    return D.empty_result_message(turns.drop("conv_id"), found).select("query_id", "route", "n_hits", "answer")


@query("build_prompt", f"""
    WITH {S.bm25('hits', 3)},
    docs AS (
      SELECT query_id, doc_id, rank, '文档 ' || rank || ' [source: ' || source || ', title: ' || lang || ']' || chr(10)
             || {S.format_prefix('kind')} || chr(10) || text AS body
      FROM hits JOIN (SELECT *, {S.text_format('text')} AS kind FROM documents) USING (doc_id)
    ),
    packed AS (SELECT query_id, string_agg(body, chr(10) || chr(10) ORDER BY rank) AS bodies, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS sources FROM docs GROUP BY query_id),
    asked AS (SELECT item_id AS query_id, text AS query, CASE item_id % 3 WHEN 0 THEN '概念解释' WHEN 1 THEN '数据统计' ELSE {S.text(GENERAL_INTENT)} END AS intent FROM benchmark)
    SELECT query_id, sources, {S.text(SYSTEM_PROMPT)} || chr(10) || chr(10) || {S.text(PROMPT_QUESTION)} || query || chr(10) || chr(10)
      || {S.text(PROMPT_TASK)} || intent || chr(10)
      || CASE intent {' '.join(f"WHEN {S.text(k)} THEN {S.text(v)}" for k, v in INTENT_GUIDANCE.items())} END
      || chr(10) || chr(10) || {S.text(PROMPT_DOCUMENTS)} || chr(10) || bodies || chr(10) || chr(10) || {S.text(PROMPT_CLOSING)} AS prompt
    FROM asked JOIN packed USING (query_id)""")
def build_prompt(spark, folder):
    asked, docs = questions(spark, folder), documents(spark, folder)
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("id"), F.col("doc_id").cast("string"), F.lit("title"), F.col("lang"))
    hits = R.bm25(asked, docs, 3)
    n = F.col("query_id") % 3
    intent = F.when(n == 0, "概念解释").when(n == 1, "数据统计").otherwise(GENERAL_INTENT)
    intents = asked.select("query_id", intent.alias("intent"))
    prompts = A.build_prompt(asked, hits, docs.withColumn("metadata", meta), intents)
    return prompts.select("query_id", F.array_join("sources", ",").alias("sources"), "prompt")


# ---- chat ---------------------------------------------------------------------------

MESSAGES = """
    messages AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, text AS content FROM conversations
      UNION ALL SELECT DISTINCT conv_id, 0, 'system', 'Be brief.' FROM conversations
    )"""


@query("chat_messages", f"WITH {MESSAGES} SELECT conv_id, pos::BIGINT AS pos, role, content FROM messages")
def chat_messages(spark, folder):
    return A.chat_messages(table(spark, folder, "conversations"), "Be brief.")


@query("chat_prompt", f"""
    WITH {MESSAGES}
    SELECT conv_id, 0::BIGINT AS segment,
      string_agg(upper(role[1]) || role[2:] || ': ' || content || chr(10) || chr(10), '' ORDER BY pos) || 'Assistant: ' AS prompt
    FROM messages GROUP BY conv_id""")
def chat_prompt(spark, folder):
    return A.chat_prompt(A.chat_messages(table(spark, folder, "conversations"), "Be brief."))


# ---- answers from fields ---------------------------------------------------------------

EXTREMUM = """
    asked AS (
      SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'product_id' ELSE 'price' END AS field, item_id % 2 = 0 AS descending FROM benchmark
    ),
    vals AS (SELECT p_partkey AS doc_id, 'price' AS field, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 'product_id', p_partkey FROM part),
    ranked AS (
      SELECT field, d.descending, doc_id, value, row_number() OVER (
        PARTITION BY field, d.descending ORDER BY CASE WHEN d.descending THEN -value ELSE value END, doc_id) AS rank
      FROM vals, (SELECT unnest([true, false]) AS descending) d
    ),
    hits AS (SELECT query_id, field, doc_id, value::DOUBLE AS value, rank::BIGINT AS rank FROM asked JOIN ranked USING (field, descending) WHERE rank <= 3)"""


def _extremum(spark, folder):
    i = F.col("query_id")
    opening = F.when(i % 2 == 0, "最贵的").otherwise("最便宜的")
    asked = questions(spark, folder).select(
        "query_id", F.concat(opening, "query").alias("query"), F.when(i % 3 == 0, "product_id").alias("field")
    )
    return A.extremum_topk(asked, kv_line_docs(spark, folder), aliases=aliases())


@query("extremum_topk", f"WITH {EXTREMUM} SELECT * FROM hits")
def extremum_topk(spark, folder):
    hits, _ = _extremum(spark, folder)
    return hits.withColumn("rank", F.col("rank").cast("bigint"))


@query("extremum_context", f"""
    WITH {EXTREMUM} SELECT query_id, string_agg('product_id: ' || p_partkey || chr(10) || 'product_name: ' || p_name || chr(10)
      || 'category: ' || p_type || chr(10) || 'price: ' || p_retailprice, chr(10) ORDER BY rank) AS context
    FROM hits JOIN part ON p_partkey = doc_id GROUP BY query_id""")
def extremum_context(spark, folder):
    return _extremum(spark, folder)[1]


def _laptops(spark, folder):
    """``part`` as product texts with features and graphics."""
    size = F.col("p_size").cast("string")
    text = F.concat_ws(
        "\n", F.concat(F.lit("产品名称: "), "p_name"), F.concat(F.lit("价格："), "p_retailprice", F.lit("元")),
        F.when(F.col("p_size") > 20, F.concat(F.lit("处理器: i"), size)),
        F.concat(F.lit("显卡: "), F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("RTX "), size)).otherwise("none")),
        F.concat(F.lit("特点："), F.when(F.col("p_name").contains("ring"), "适合游戏").otherwise("办公: 轻薄")),
    )
    return table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("content"))


@query("list_answer", f"""
    SELECT conv_id::VARCHAR || '-' || turn AS query_id, CASE WHEN turn % 2 = 0 THEN {S.text(LIST_INTRO)} ELSE {S.text(LIST_UNSUPPORTED)} END AS answer
    FROM conversations""")
def list_answer(spark, folder):
    asked = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        F.concat(F.when(F.col("turn") % 2 == 0, "推荐游戏本").otherwise("推荐"), F.col("text")).alias("query"),
    )
    return A.list_answer(asked, A.filter_list(_laptops(spark, folder))).select("query_id", "answer")


@query("filter_list", """
    WITH kept AS (
      SELECT *, row_number() OVER (ORDER BY p_partkey) AS item_no FROM part WHERE contains(p_name, 'ring') OR p_type = 'ECONOMY'
    )
    SELECT item_no, p_partkey AS doc_id, item_no || '. ' || p_name || chr(10) || '   价格：' || p_retailprice || '元' || chr(10) || '   配置：'
      || CASE WHEN p_size > 20 THEN chr(10) || '   - 处理器：i' || p_size ELSE '' END
      || chr(10) || '   - 显卡：' || CASE WHEN p_type = 'ECONOMY' THEN 'RTX ' || p_size ELSE 'none' END
      || chr(10) || '   特点：' || CASE WHEN contains(p_name, 'ring') THEN '适合游戏' ELSE '办公: 轻薄' END AS item
    FROM kept""")
def filter_list(spark, folder):
    return A.filter_list(_laptops(spark, folder))


# ---- answers from a question's own hits ---------------------------------------------------

# Every vector asks; its nearest vectors stand for the parts of the same number.
OWN = f"""
    {S.knn('near', 9)},
    hits AS (SELECT n.query_id, n.doc_id, n.rank, p.* FROM near n JOIN part p ON p_partkey = doc_id + 1)"""
OWN_EXTREMES = """
    asked AS (
      SELECT vec_id AS query_id, CASE WHEN vec_id % 3 = 0 THEN 'product_id' ELSE 'price' END AS field, vec_id % 2 = 0 AS descending FROM embeddings
    ),
    valued AS (SELECT query_id, field, doc_id, descending, (CASE field WHEN 'price' THEN p_retailprice ELSE p_partkey END)::DOUBLE AS value FROM hits JOIN asked USING (query_id)),
    extremes AS (
      SELECT query_id, field, doc_id, value, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN descending THEN -value ELSE value END, doc_id)::BIGINT AS rank
      FROM valued QUALIFY rank <= 3
    )"""
OWN_CATEGORIES = """
    cats AS (
      SELECT p_type AS category, embedding::DOUBLE[] AS vec
      FROM (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS n FROM (SELECT DISTINCT p_type FROM part)) JOIN embeddings ON vec_id = n
    ),
    own AS (SELECT DISTINCT query_id, p_type AS category FROM hits),
    fit AS (
      SELECT o.query_id, o.category, list_cosine_similarity(e.embedding::DOUBLE[], c.vec) AS s
      FROM own o JOIN cats c USING (category) JOIN embeddings e ON e.vec_id = o.query_id
    ),
    best AS (SELECT query_id, category AS chosen FROM fit WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, category) = 1),
    alike AS (
      SELECT o.query_id, o.category, chosen FROM own o JOIN best USING (query_id) JOIN cats a ON a.category = o.category JOIN cats b ON b.category = chosen
      WHERE o.category = chosen OR list_cosine_similarity(a.vec, b.vec) >= 0.7
    ),
    fitting AS (
      SELECT h.query_id, chosen AS category, doc_id, row_number() OVER (PARTITION BY h.query_id ORDER BY rank, doc_id)::BIGINT AS rank
      FROM hits h JOIN alike a ON a.query_id = h.query_id AND a.category = h.p_type
    )"""


def _parts(spark, folder, content):
    """The parts as documents of the vectors' numbers."""
    part = table(spark, folder, "part").select((F.col("p_partkey") - 1).alias("doc_id"), F.col("p_type").alias("category"))
    texts = content(spark, folder).select((F.col("doc_id") - 1).alias("doc_id"), "content")
    return part.join(texts, "doc_id")


def _own(spark, folder, content):
    return H.documents_of(search.knn(query_vectors(spark, folder), vectors(spark, folder), 9), _parts(spark, folder, content))


def _category_vectors(spark, folder):
    names = table(spark, folder, "part").select(F.col("p_type").alias("category")).distinct()
    rank = A.number_rows(names, "category", name="n").select("category", (F.col("n") - 1).alias("doc_id"))
    return rank.join(vectors(spark, folder), "doc_id").select("category", F.col("embedding").alias("category_vec"))


@query("extremum_of_hits", f"WITH {OWN}, {OWN_EXTREMES} SELECT * FROM extremes")
def extremum_of_hits(spark, folder):
    i = F.col("query_id")
    asked = query_vectors(spark, folder).select(
        "query_id", F.when(i % 2 == 0, "最贵的").otherwise("最便宜的").alias("query"), F.when(i % 3 == 0, "product_id").alias("field")
    )
    out = H.extremum_of_hits(asked, _own(spark, folder, kv_line_docs), aliases=aliases())
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("category_of_hits", f"WITH {OWN}, {OWN_CATEGORIES} SELECT * FROM fitting")
def category_of_hits(spark, folder):
    words = query_vectors(spark, folder).select("query_id", F.col("query_vec").alias("word_vec"))
    out = H.category_of_hits(words, _own(spark, folder, kv_line_docs), _category_vectors(spark, folder))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


OWN_LISTS = """
    kept AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS item_no FROM hits WHERE contains(p_name, 'ring') OR p_type = 'ECONOMY'
    ),
    items AS (
      SELECT query_id, item_no, doc_id, item_no || '. ' || p_name || chr(10) || '   价格：' || p_retailprice || '元' || chr(10) || '   配置：'
        || CASE WHEN p_size > 20 THEN chr(10) || '   - 处理器：i' || p_size ELSE '' END
        || chr(10) || '   - 显卡：' || CASE WHEN p_type = 'ECONOMY' THEN 'RTX ' || p_size ELSE 'none' END
        || chr(10) || '   特点：' || CASE WHEN contains(p_name, 'ring') THEN '适合游戏' ELSE '办公: 轻薄' END AS item FROM kept
    )"""


@query("list_of_hits", f"WITH {OWN}, {OWN_LISTS} SELECT * FROM items")
def list_of_hits(spark, folder):
    return H.list_of_hits(_own(spark, folder, _laptops)).withColumn("item_no", F.col("item_no").cast("bigint"))


def _cases(values):
    return "CASE vec_id % 8 " + " ".join(f"WHEN {i} THEN {S.text(v)}" for i, v in enumerate(values)) + " END"


@query("ask_by_route", f"""
    WITH {OWN.replace('JOIN part', 'LEFT JOIN part')}, {OWN_CATEGORIES}, {OWN_LISTS},
    asked AS (SELECT vec_id AS query_id, {_cases(ROUTES)} AS route, vec_id % 16 IN (1, 2) AS gaming FROM embeddings),
    dear AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY -p_retailprice, doc_id) AS rank FROM hits WHERE p_retailprice IS NOT NULL),
    picked AS (
      SELECT query_id, doc_id, d.rank FROM dear d JOIN asked USING (query_id) WHERE route = 'comparison' AND d.rank <= 3
      UNION ALL SELECT query_id, doc_id, f.rank FROM fitting f JOIN asked USING (query_id) WHERE route = 'recommendation' AND f.rank <= 3
    ),
    chosen AS (
      SELECT * FROM picked
      UNION ALL SELECT query_id, doc_id, rank FROM hits WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM picked)
    ),
    sources AS (SELECT query_id, count(*) AS n_hits, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS sources FROM chosen GROUP BY query_id),
    lists AS (SELECT query_id, string_agg(item, chr(10) ORDER BY item_no) AS list FROM items GROUP BY query_id)
    SELECT query_id, route, coalesce(n_hits, 0)::BIGINT AS n_hits, sources,
      CASE WHEN n_hits IS NULL THEN CASE route {' '.join(f"WHEN {S.text(k)} THEN {S.text(v)}" for k, v in EMPTY_MESSAGES.items())} END
           WHEN route <> 'list' THEN NULL WHEN NOT gaming THEN {S.text(LIST_UNSUPPORTED)}
           ELSE coalesce({S.text(LIST_INTRO)} || chr(10) || list, {S.text(LIST_EMPTY)}) END AS answer
    FROM asked LEFT JOIN sources USING (query_id) LEFT JOIN lists USING (query_id)""")
def ask_by_route(spark, folder):
    """Every vector as a question of one of the routes, over texts of parts; list questions ask for a game machine or for others."""
    i = F.col("query_id")
    opening = F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), (i % 8 + 1).cast("int"))
    asked = query_vectors(spark, folder).select("query_id", F.concat(opening, F.when((i % 16).isin(1, 2), "游戏本").otherwise("")).alias("query"), "query_vec")
    laptops = _laptops(spark, folder).withColumnRenamed("content", "laptop")
    both = lambda *_: kv_line_docs(spark, folder).join(laptops, "doc_id").withColumn("content", F.concat_ws("\n", "content", "laptop"))
    docs = _parts(spark, folder, both).withColumn("metadata", F.create_map(F.lit("source"), F.col("doc_id").cast("string")))
    docs = docs.join(vectors(spark, folder).drop("label"), "doc_id", "right")
    out = flows.ask_by_route(asked, docs, _category_vectors(spark, folder), 3, 3, aliases=aliases())
    return out.select("query_id", "route", F.col("n_hits").cast("bigint").alias("n_hits"), F.array_join("sources", ",").alias("sources"), "answer")


@query("messages_as_of", """
    WITH placed AS (
      SELECT conv_id, turn, role, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS at FROM conversations
    )
    SELECT u.conv_id, u.turn, (m.at - greatest(u.at - 50, 1) + 1)::BIGINT AS pos, m.role, m.content
    FROM placed u JOIN placed m ON m.conv_id = u.conv_id AND m.at BETWEEN u.at - 50 AND u.at WHERE u.role = 'user'
    UNION ALL SELECT conv_id, turn, 0, 'system', 'Be brief.' FROM placed WHERE role = 'user'""")
def messages_as_of(spark, folder):
    return H.messages_as_of(table(spark, folder, "conversations"), system="Be brief.")
