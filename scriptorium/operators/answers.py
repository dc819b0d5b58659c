"""Retrieved chunks to cited context and prompts; conversations to their last turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import preview, strip_tags
from scriptorium.sources.ranges import in_ranges, several_parts

RULES = "只根据编号片段回答，每个结论标注来源，例如：[片段2，第7页]。\n\n参考片段：\n"
REWRITE = "把最新问题改写成完整的检索问题，只输出问题。\n\n对话历史：\n"


def context_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, context): a query's hits in order of rank, tags stripped, joined by blank lines.

    hits: query_id, rank, source, page, text, distance.
    """
    name = F.element_at(F.split("source", r"[\\/]"), -1)
    block = F.concat(F.lit("[片段 "), F.col("rank").cast("string"), F.lit("] 来源: "), name, F.lit(", 页码: "), F.col("page").cast("string"), F.lit(", distance: "), F.format_string("%.4f", F.round("distance", 4)), F.lit("\n片段内容: "), strip_tags(F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n")
    return hits.groupBy("query_id").agg(joined.alias("context"))


def answer_prompts(contexts: DataFrame, rules: str = RULES) -> DataFrame:
    return contexts.select("query_id", F.concat(F.lit(rules), F.col("context")).alias("system_prompt"))


def hit_previews(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", preview(F.col("text")).alias("preview"))


def chat_history(turns: DataFrame, most: int = 6) -> DataFrame:
    """(conv_id, turn, question, history): for each user turn, the last ``most`` answered messages before it.

    A user turn whose next row is no answer is not part of later histories; system rows
    are left out. turns: conv_id, turn, role, text.

    Turns lie in ranges of (conv_id, turn), and a range's frames see that range alone. What
    a conversation brings from earlier ranges is a few rows a range: the role of the next
    range's first turn, and the last ``most`` messages of those before. So a conversation
    of any length is several tasks'.
    """
    spoken = turns.where("role IN ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    dealt = in_ranges(spoken, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"))
    here = Window.partitionBy("conv_id", "part")
    conv, turn = Window.partitionBy("conv_id"), here.orderBy("turn")
    firsts = several_parts(dealt.groupBy("conv_id", "part").agg(F.min_by("role", F.struct("turn")).alias("first")), "conv_id")
    following = firsts.select("conv_id", "part", F.lead("first").over(conv.orderBy("part")).alias("following"))
    joined = _with(dealt, F.broadcast(following))
    answered = (F.col("role") == "assistant") | (F.coalesce(F.lead("role").over(turn), "following") == "assistant")
    marked = joined.withColumn("message", F.when(answered, F.struct("role", "text"))).drop("following")
    # the last messages of each part of a conversation that goes on; two parts a range at most begin or end within it
    ends = marked.where("message IS NOT NULL").join(F.broadcast(firsts.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"))), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left_semi")
    tails = ends.withColumn("r", F.row_number().over(here.orderBy(F.desc("turn")))).where(F.col("r") <= most)
    events = tails.select("conv_id", "part", "r", "message").unionByName(firsts.select("conv_id", "part", F.lit(None).cast("int").alias("r"), F.lit(None).cast(tails.schema["message"].dataType).alias("message")))
    # within a part, the row that asks stands before the messages, which go from the earliest
    in_order = conv.orderBy("part", F.coalesce(-F.col("r"), F.lit(-most - 1)))
    numbered = events.withColumn("n", F.count("message").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    earlier = F.collect_list("message").over(conv.orderBy("n").rangeBetween(-most, -1))
    carried = numbered.withColumn("earlier", earlier).where("r IS NULL").select("conv_id", "part", "earlier")
    # messages count from 0; a row sees those with the last numbers before its own, not the whole past
    counted = marked.withColumn("n", F.count("message").over(turn.rowsBetween(Window.unboundedPreceding, -1)))
    own = counted.withColumn("own", F.collect_list("message").over(here.orderBy("n").rangeBetween(-most, -1))).where("role = 'user'")
    both = _with(own, carried).select("conv_id", "turn", F.col("text").alias("question"), F.concat(F.coalesce("earlier", F.array().cast(own.schema["own"].dataType)), "own").alias("h"))
    return both.select("conv_id", "turn", "question", F.slice("h", F.greatest(F.size("h") - most + 1, F.lit(1)), F.lit(most)).alias("history"))


def _with(rows: DataFrame, other: DataFrame) -> DataFrame:
    """``rows`` and what ``other`` says of their part of a conversation, null conv_ids too."""
    named = other.withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
    return rows.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left").drop("_conv", "_part")


def spoken_lines(history: Column) -> Column:
    who = lambda m: F.when(m["role"] == "user", F.lit("用户: ")).otherwise(F.lit("助手: "))
    return F.array_join(F.transform(history, lambda m: F.concat(who(m), m["text"], F.lit("\n"))), "")


def rewrite_requests(history: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt): what to ask for a complete question; null where there is no history."""
    prompt = F.concat(F.lit(REWRITE), spoken_lines(F.col("history")), F.lit("\n最新问题："), F.col("question"))
    return history.select("conv_id", "turn", F.when(F.size("history") > 0, prompt).alias("prompt"), "question")


def rewritten(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(conv_id, turn, question): the answer to each request, or the question as it was."""
    return requests.join(responses.select("conv_id", "turn", "response"), ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(F.trim("response"), "question").alias("question"))


def chat_messages(history: DataFrame, system: str) -> DataFrame:
    """(conv_id, turn, messages): system, history and the question, in order."""
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("text")))
    return history.select("conv_id", "turn", F.concat(one("system", F.lit(system)), F.col("history"), one("user", F.col("question"))).alias("messages"))
