"""Presets, keyword rules, messages, formats, bounds and limits."""

from __future__ import annotations

from typing import NamedTuple


class ChunkPreset(NamedTuple):
    size: int
    overlap: int
    separators: tuple[str, ...]


# Chunk presets per kind of text (size, overlap, separators by priority).
CHUNK_PRESETS = {
    "auto": ChunkPreset(1024, 200, ("\n\n", "\n", ". ", "。", " ")),
    "short_text": ChunkPreset(384, 40, ("\n", ". ", "。", " ")),
    "normal_text": ChunkPreset(768, 120, ("\n\n", "\n", ". ", "。", " ")),
    "long_text": ChunkPreset(1536, 300, ("\n\n", "\n", ". ", "。", " ")),
    "code": ChunkPreset(512, 50, ("\n\n", "\n", ";", "{", "}")),
    "legal": ChunkPreset(2048, 500, ("\n\n", "\n", ". ", "。", " ")),
    "medical": ChunkPreset(1024, 200, ("\n\n", "\n", ". ", "。", " ")),
    "chinese": ChunkPreset(1024, 200, ("\n\n", "\n", "。", "！", "？", " ")),
    "english": ChunkPreset(512, 80, ("\n\n", "\n", ". ", "! ", "? ", " ")),
}

# Separators and split patterns of the special chunkers.
CODE_SEPARATORS = ("\n\n", "\n", ";", "{", "}", "class ", "def ", "function ", "//", "/*", "*/", "#")
CJK_SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ")
PARAGRAPH_PATTERN = r"\n\s*\n"
SENTENCE_PATTERN = r"[.!?。！？]\s+"

# File kinds the loader accepts.
MIME_KINDS = {
    "text/plain": "text",
    "text/markdown": "text",
    "text/csv": "csv",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "excel",
    "application/vnd.ms-excel": "excel",
    "application/vnd.ms-excel.sheet.macroEnabled.12": "excel",
    "application/pdf": "text",
}
SUFFIX_KINDS = {
    ".csv": "csv",
    ".xls": "excel",
    ".xlsx": "excel",
    ".xlsm": "excel",
    ".xlsb": "excel",
}

# Question routes in order of priority, with their keywords.
ROUTE_KEYWORDS = (
    ("comparison", ("最贵的", "最高的", "最多的", "最大的", "最便宜的", "最低的", "最少的", "最小的")),
    ("list", ("推荐", "有哪些", "列表", "清单")),
    ("recommendation", ("推荐", "建议", "介绍", "选择", "合适", "适合")),
    ("summary", ("总结", "概述", "摘要", "简述", "归纳", "概括")),
    ("chat", ("你", "您", "我", "聊天", "对话")),
)
DEFAULT_ROUTE = "qa"

# Wordings that ask for the largest or the smallest value.
MAX_WORDS = ("最贵的", "最高的", "最多的", "最大的")
MIN_WORDS = ("最便宜的", "最低的", "最少的", "最小的")

# Answers given when nothing was retrieved.
EMPTY_MESSAGES = {
    "qa": "抱歉，没有找到相关信息。",
    "list": "抱歉，没有找到相关信息。",
    "comparison": "抱歉，没有找到可以比较的信息。",
    "recommendation": "抱歉，没有找到可以推荐的信息。",
    "summary": "抱歉，没有找到可以总结的信息。",
    "chat": "抱歉，我不太理解您的问题。能否换个方式描述？",
}

# Example questions per intent, and the intent of everything else.
INTENT_EXAMPLES = {
    "比较分析": ("A和B有什么区别", "比较一下X和Y的优缺点", "哪个更好"),
    "因果解释": ("为什么会出现这种情况", "产生这个问题的原因是什么", "如何解决这个问题"),
    "列举信息": ("有哪些类型", "列举常见的方法", "包含哪些步骤"),
    "概念解释": ("什么是机器学习", "人工智能的定义是什么", "这个术语是什么意思"),
    "数据统计": ("共有多少人", "平均值是多少", "增长率是多少"),
    "操作指导": ("如何操作这个功能", "使用步骤是什么", "怎么实现这个效果"),
}
GENERAL_INTENT = "一般信息查询"

# Guidance added to the prompt for each intent.
INTENT_GUIDANCE = {
    "比较分析": "请系统性地比较相关实体之间的异同点，包括核心特征、优缺点等方面。使用对比结构组织回答。",
    "因果解释": "请详细解释原因和机制，说明因果关系，并尽可能提供具体的例证。",
    "列举信息": "请以清晰的列表形式提供所有相关项目，并简要说明每项的关键特征。",
    "概念解释": "请提供准确、全面但简洁的定义或解释，包含必要的背景信息和相关联系。",
    "数据统计": "请提供准确的数字和统计信息，如有必要可以简单解释这些数据的含义和背景。",
    "操作指导": "请以步骤形式提供清晰、具体的操作指南，确保用户能够依照指导完成操作。",
    "一般信息查询": "请提供全面、准确的信息，以清晰的结构组织回答，确保覆盖问题的各个方面。",
}

# Formats of documents and prompts.
DOCUMENT_LABEL = "文档"
METADATA_KEYS = ("source", "title", "page", "filename")
FORMAT_PREFIXES = {
    "table": "表格数据: ",
    "json": "JSON数据: ",
    "markup": "结构化标记: ",
    "list": "列表数据: ",
}
PROMPT_QUESTION = "问题: "
PROMPT_TASK = "任务类型: "
PROMPT_DOCUMENTS = "提供的参考文档:"
PROMPT_CLOSING = "请基于以上文档回答问题。"
SYSTEM_PROMPT = """你是一个专业的信息分析助手。请根据提供的文档内容回答用户的问题。

文档处理指南:
- 文档可能包含多种格式：纯文本、表格(Markdown/CSV等)、JSON、XML、HTML等
- 对于表格数据，理解其结构、表头和内容的关系
- 对于结构化数据(如JSON/XML)，理解其层次和字段含义
- 对于列表和枚举，注意其层次关系

回答要求:
1. 仅使用提供文档中的信息，不要编造不存在的内容
2. 如果文档中没有相关信息，清晰说明"文档中未提供相关信息"
3. 回答应准确、全面且以用户容易理解的方式组织
4. 如涉及多个文档的信息，需要综合分析并避免矛盾
5. 针对不同类型的用户查询(比较、统计、具体信息等)采用适当的回答结构
6. 使用专业、客观的语气"""
RETRIEVAL_INSTRUCTION = "为这个句子生成表示以用于检索相关文章："

# Product fields, their types and aliases, in order of registration.
FIELD_ALIASES = (
    ("product_id", "TEXT", ("id", "商品ID", "编号", "产品序列号", "序列号", "产品唯一标识符")),
    ("product_name", "TEXT", ("name", "商品名称", "名称", "产品", "产品名称")),
    ("category", "CATEGORY", ("分类", "种类", "商品类别", "产品类别", "产品类型", "类型")),
    ("price", "NUMERIC", ("售价", "单价", "金额", "产品价格", "价格")),
    ("stock", "NUMERIC", ("库存量", "存货", "产品库存", "库存")),
    ("description", "TEXT", ("商品描述", "详情", "介绍", "产品描述", "描述")),
)

# Labels and keywords of the gaming-laptop list.
GAMING_QUESTION_WORD = "游戏本"
GAMING_FEATURE_WORDS = ("游戏", "gaming")
GAMING_GRAPHICS_WORDS = ("rtx", "gtx")
LIST_FIELDS = {
    "name": "产品名称",
    "price": "价格",
    "processor": "处理器",
    "memory": "内存",
    "storage": "硬盘",
    "graphics": "显卡",
    "features": "特点",
}
LIST_INTRO = "以下是推荐的游戏本："
LIST_EMPTY = "抱歉，没有找到游戏本的信息。"
LIST_UNSUPPORTED = "抱歉，目前不支持这种类型的列表查询。"
LIST_UNKNOWN_NAME = "未知型号"
LIST_UNKNOWN_PRICE = "未知"

# Histogram bounds in seconds.
RESPONSE_BOUNDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, float("inf"))
RETRIEVAL_BOUNDS = (0.01, 0.05, 0.1, 0.5, 1.0, float("inf"))

# Default parameters.
TOP_K = 3
SEARCH_MULTIPLIER = 3
MIN_SIMILARITY = 0.05
FIELD_SIMILARITY = 0.7
INTENT_THRESHOLD = 0.5
ROWS_PER_CHUNK = 5
TFIDF_FEATURES = 5000
WORD2VEC = {"vector_size": 100, "window": 5, "min_count": 1}
ENCODE_BATCH = 16
EMBEDDING_DIM = 384
NPROBE = 10
DECAY_SCALE = 10.0
RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75
SAMPLE_VALUES = 10

# Characters that count as blank when text is stripped.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)

# Largest number of rows of a narrow join side that is broadcast.
BROADCAST_ROWS = 200_000
# Largest number of vectors a side may have to be sent whole to every task.
SMALL_SIDE_ROWS = 4096
SMALL_SIDE_BYTES = 128 << 20
# Rows of either side handled by one task in a blocked search.
BLOCK_ROWS = 16384

#: Delimiters that are looked for in a header line; earlier ones win ties.
DELIMITERS = (",", "\t", ";", "|")

#: Most bytes of a side that is broadcast.
BROADCAST_BYTES = 64 << 20
