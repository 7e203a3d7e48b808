"""Dialogue sessions: trimmed histories, prompts and chat training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# History sizes, message markers and the fixed answer texts.
MAX_TURNS = 8
PROMPT_TURNS = 3
MAX_SESSIONS = 200
SAMPLE_TURNS = 5
SAMPLE_LENGTH = 1500
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"
EMPTY_THOUGHT = "<think>\n\n</think>\n\n"
NOTHING_FOUND = "知识库里没有找到相关内容，请先上传相关资料，或换个说法再问一次。"
NO_ANSWERER = "（尚未配置大模型 API Key，当前只做了知识检索，下面是资料原文）"
MATERIALS_HEAD, QUESTION_HEAD = "《知识库资料》\n", "用户问题："
SNIPPET_CHARS = 200
PREVIEW_CHARS = 160
TERMS_PREAMBLE = (
    "请结合上下文信息，更加准确地完成语音转写任务。如果没有相关信息，我们会留空。"
    "\n\n\n**上下文信息：**\n\n\n"
)
TRANSCRIBE, INTO, AS_SPOKEN = "语音转写", "成", "，不进行文本规整"

KEY = "session_id"


def session_history(turns: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """The last ``2 * max_turns`` messages of every session; empty ones were never stored.

    Each task keeps only its own last messages per session before the shuffle, so a session with
    very many turns costs no more than any other.
    """
    stored = turns.filter(F.coalesce(F.length("content"), F.lit(0)) > 0)
    w = Window.partitionBy(KEY).orderBy(F.desc("turn"))
    return stored.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= 2 * max_turns)


def prompt_history(turns: DataFrame, n: int = PROMPT_TURNS) -> DataFrame:
    """What enters the prompt: of the last ``2 n`` messages, visible user and assistant ones."""
    recent = session_history(turns, n)
    spoken = F.col("role").isin("user", "assistant") & ~T.is_blank("content")
    return recent.filter(spoken).withColumn("content", T.strip("content"))


def evict_sessions(turns: DataFrame, max_sessions: int = MAX_SESSIONS, created: list[str] | None = None) -> DataFrame:
    """Sessions that survive: the ``max_sessions`` created last (first in, first out).

    ``created`` lists columns that order sessions by their first message.
    """
    first = F.struct(*(created or ["turn", KEY]))
    sessions = turns.groupBy(KEY).agg(F.min(first).alias("_born"), F.count("*").alias("messages"))
    return (
        sessions.orderBy(F.desc("_born"), F.desc(KEY)).limit(max_sessions).select(KEY, "messages")
    )


def role_counts(turns: DataFrame) -> DataFrame:
    """Messages and prompt-worthy messages per role."""
    spoken = F.col("role").isin("user", "assistant") & ~T.is_blank("content")
    return turns.groupBy("role").agg(F.count("*").alias("messages"), F.count_if(spoken).alias("usable"))


def _numbered_role(turns: DataFrame, role: str, limit: int, name: str) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy("turn")
    return (
        turns.filter(F.col("role") == role)
        .withColumn("i", F.row_number().over(w))
        .filter(F.col("i") <= limit)
        .select(KEY, "i", F.col("content").alias(name))
    )


def chat_samples(
    turns: DataFrame, max_turns: int = SAMPLE_TURNS, max_length: int = SAMPLE_LENGTH,
    think: bool = True,
) -> DataFrame:
    """Prompt and target of every training turn of a session.

    The i-th user message pairs with the i-th assistant message and with the system messages in
    rotation; a session without a system message yields nothing. At most ``max_turns`` turns, and
    none after the text so far exceeds ``max_length`` characters. Pairing is a join on the turn
    number over the first few messages per role, so no session is collected.
    """
    users = _numbered_role(turns, "user", max_turns, "user")
    answers = _numbered_role(turns, "assistant", max_turns, "answer")
    systems = _numbered_role(turns, "system", max_turns, "system")
    n_sys = turns.filter("role = 'system'").groupBy(KEY).agg(F.count("*").alias("_n"))
    slot = (F.col("i") - 1) % F.col("_n") + 1
    rows = (
        users.join(answers, [KEY, "i"])
        .join(n_sys, KEY)
        .withColumn("_slot", slot.cast("int"))
        .join(systems.withColumnRenamed("i", "_slot"), [KEY, "_slot"])
    )

    def said(role: str, text: Column) -> Column:
        return F.concat(F.lit(f"{TURN_OPEN}{role}\n"), text, F.lit(f"{TURN_CLOSE}\n"))

    opening = F.when(F.col("i") == 1, said("system", F.col("system"))).otherwise("")
    thought = F.lit("" if think else EMPTY_THOUGHT)
    prompt = F.concat(
        opening, said("user", F.col("user")), F.lit(f"{TURN_OPEN}assistant\n"), thought
    )
    rows = rows.withColumn("prompt", prompt).withColumn(
        "target", F.concat("answer", F.lit(TURN_CLOSE))
    )
    before = Window.partitionBy(KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("prompt") + F.length("target")).over(before), F.lit(0))
    return (
        rows.withColumn("used", used)
        .filter(F.col("used") <= max_length)
        .select(KEY, F.col("i").alias("turn_no"), "prompt", "target", "used")
    )


def instruction_prompt(hotwords: Column, language: Column, normalise: Column) -> Column:
    """The transcription instruction: optional term list, target language, number style."""
    listed = F.concat(
        F.lit(TERMS_PREAMBLE + "热词列表：["), F.array_join(hotwords, ", "), F.lit("]\n")
    )
    head = F.when(F.size(hotwords) > 0, listed).otherwise("")
    task = F.when(language.isNull(), F.lit(TRANSCRIBE)).otherwise(
        F.concat(F.lit(TRANSCRIBE + INTO), language)
    )
    tail = F.when(normalise, F.lit("")).otherwise(AS_SPOKEN)
    return F.concat(head, task, tail, F.lit("："))


def _by_rank(fields: list[str]) -> Column:
    return F.array_sort(F.collect_list(F.struct("rank", *fields)))


def _sources() -> Column:
    return F.array_distinct(F.transform(_by_rank(["source"]), lambda h: h["source"])).alias("sources")


def _joined(piece: Column, name: str) -> Column:
    pieces = F.array_sort(F.collect_list(F.struct("rank", piece.alias("_p"))))
    return F.array_join(F.transform(pieces, lambda h: h["_p"]), "\n\n").alias(name)


def _snippets(limit: int = SNIPPET_CHARS) -> Column:
    return _joined(F.concat(F.lit("【"), F.col("source"), F.lit("】"), T.clip("text", limit)), "snippets")


def _materials() -> Column:
    return _joined(
        F.concat(
            F.lit("【资料"), F.col("rank").cast("string"), F.lit("｜来源："), F.col("source"),
            F.lit("｜相似度"), F.col("score").cast("string"), F.lit("】\n"), F.col("text"),
        ),
        "materials",
    )


def ordered_sources(hits: DataFrame) -> DataFrame:
    """Sources of each query in first-hit order (a query has at most twenty hits)."""
    return hits.groupBy("query_id").agg(_sources())


def snippets(hits: DataFrame, limit: int = SNIPPET_CHARS) -> DataFrame:
    """Clipped materials of each query, best first, separated by a blank line."""
    return hits.groupBy("query_id").agg(_snippets(limit))


def materials(hits: DataFrame) -> DataFrame:
    """Numbered, source-tagged materials of each query."""
    return hits.groupBy("query_id").agg(_materials())


def context_prompt(
    questions: DataFrame, hits: DataFrame, history: DataFrame | None = None,
    system_prompt: str | None = None, has_answerer: bool = True,
) -> DataFrame:
    """questions(query_id, question[, session_id]) to answers or message lists.

    No hits: the fixed text and no sources. Hits but no answerer: a hint and clipped snippets.
    Otherwise a messages array of system prompt, recent history and the materials with the
    question; ``answer`` is then NULL.
    """
    # One aggregate: the search behind the hits runs once.
    per = hits.groupBy("query_id").agg(_sources(), _snippets(), _materials())
    rows = questions.join(per, "query_id", "left")
    ask = F.concat(
        F.lit(MATERIALS_HEAD), F.col("materials"), F.lit("\n\n" + QUESTION_HEAD), F.col("question")
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    nothing = F.array().cast("array<struct<role:string,content:string>>")
    past = nothing
    if history is not None:
        recent = prompt_history(history)  # at most six messages per session
        packed = recent.groupBy(KEY).agg(
            F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_h")
        )
        rows = rows.join(packed, KEY, "left")
        past = F.coalesce(
            F.transform(
                "_h", lambda h: F.struct(h["role"].alias("role"), h["content"].alias("content"))
            ),
            nothing,
        )
    first = F.array(message("system", F.lit(system_prompt))) if system_prompt else nothing
    found = F.col("materials").isNotNull()
    fallback = F.concat(F.lit(NO_ANSWERER + "\n\n"), F.col("snippets"))
    answer = F.when(~found, F.lit(NOTHING_FOUND))
    if not has_answerer:
        answer = answer.otherwise(fallback)
    messages = F.when(
        found & F.lit(has_answerer), F.concat(first, past, F.array(message("user", ask)))
    )
    return rows.select(
        "query_id",
        answer.alias("answer"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        messages.alias("messages"),
    )


def hit_previews(hits: DataFrame) -> DataFrame:
    """Hits as shown to the user: the first 160 characters of each text."""
    return hits.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW_CHARS))
