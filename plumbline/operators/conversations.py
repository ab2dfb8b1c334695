"""Conversations: export, titles, chunks and lists, all turn by turn.

One conversation may hold a large part of all turns, so no operator gathers its turns
into one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER_HEADING = "## 🧑 You"
ASSISTANT_HEADING = "## 🤖 Assistant"
CHART_MARK = "\n_[chart visualization]_"
EXPORT_NOTE = "_Exported conversation_"
TITLE_LENGTH = 60


def title_text(question: Column) -> Column:
    return F.when(F.length(question) > TITLE_LENGTH, F.concat(F.left(question, F.lit(TITLE_LENGTH)), F.lit("…"))).otherwise(question)


def conversation_titles(turns: DataFrame, chat: str = "conv_id") -> DataFrame:
    """Rows ``(chat, title)`` from the first question of each conversation.

    The text is cut before the shuffle: only the start of a question can reach a title.
    """
    questions = turns.filter(F.col("role") == "user").select(chat, "turn", title_text(F.col("text")).alias("title"))
    return questions.groupBy(chat).agg(F.min_by("title", "turn").alias("title"))


def conversation_markdown(
    turns: DataFrame, chat: str = "conv_id", assistant_heading: str = ASSISTANT_HEADING, chart: str | None = None
) -> DataFrame:
    """Rows ``(chat, position, markdown)``: a title, then one block per turn.

    The blocks of a conversation in order of ``position``, joined by line feeds, are its
    document. ``chart`` names an optional boolean column that marks replies with a chart.
    """
    titles = conversation_titles(turns, chat)
    title = F.concat(F.lit("# "), F.col("title"), F.lit(f"\n\n{EXPORT_NOTE}\n"))
    heads = titles.select(chat, F.lit(0).cast("bigint").alias("position"), title.alias("markdown"))
    heading = F.when(F.col("role") == "user", USER_HEADING).otherwise(assistant_heading)
    mark = F.when(F.col(chart), F.lit(f"\n{CHART_MARK}")).otherwise(F.lit("")) if chart else F.lit("")
    block = F.concat(heading, F.lit("\n\n"), F.col("text"), mark, F.lit("\n"))
    blocks = turns.select(chat, (F.col("turn") + 1).cast("bigint").alias("position"), block.alias("markdown"))
    return heads.unionByName(blocks)


def write_markdown(document: DataFrame, path: str, chat: str = "conv_id") -> None:
    """Write the blocks as text, in order within and across files."""
    order = [chat, "position"]
    document.repartitionByRange(*order).sortWithinPartitions(*order).select("markdown").write.text(path)


def chunk_words(texts: DataFrame, key: Sequence[str], text: str = "text", size: int = 4) -> DataFrame:
    """Rows ``(key, ordinal, chunk)``: groups of words that join back to the whole text."""
    # Split in its own projection: inside the transform it would run again for every chunk.
    split = texts.filter(F.col(text).isNotNull()).select(*key, F.split(F.col(text), " ", -1).alias("words"))
    starts = F.sequence(F.lit(1), F.size("words"), F.lit(size))
    chunk = split.select(*key, "words", F.posexplode(starts).alias("ordinal", "start"))
    is_last = F.col("start") + size > F.size("words")
    joined = F.array_join(F.slice("words", F.col("start"), F.lit(size)), " ")
    return chunk.select(*key, "ordinal", F.concat(joined, F.when(is_last, "").otherwise(" ")).alias("chunk"))


def pinned_split(chats: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """Adds ``is_pinned``: whether the chat is in the list of pinned ids."""
    ids = pinned.select(key).distinct().withColumn("is_pinned", F.lit(True))
    return chats.join(ids, key, "left").withColumn("is_pinned", F.coalesce("is_pinned", F.lit(False)))
