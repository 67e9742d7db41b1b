"""Conversation turns to trajectories with tool calls, summary and case text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.scalars import clip_text
from clickloom.schemas import ANSWER_ROLES, CALL_ROLES, HUMAN_ROLES, RESULT_ROLES

RESULT_CHARS = 500
QUESTION_CHARS = 100
ANSWER_CHARS = 150
CHUNK = 1_000
CALLS = "array<struct<name: string, args: string, result: string, ts: bigint>>"
STORED = (
    "chunk long, timestamp long, conversations array<struct<`from`: string, value: string>>, "
    f"tool_calls {CALLS}, reward double, skill_extracted string, summary string, case_document string"
)

# fixed values: speaker names and the texts of summaries and case documents
SPEAKERS = {"user": "human", "assistant": "gpt", "tool_call": "function_call", "tool": "observation"}
QUESTION = "用户问题："
TOOLS = "使用工具："
ANSWER = "最终回答摘要："
SEPARATOR = "；"
CASE_HEAD = "## 诊断案例\n\n**摘要：** "
CASE_TOOLS = "\n\n**调用工具：**\n"
CASE_SESSION = "\n\n**会话ID：** "
NO_TOOLS = "(无工具调用)"


def speaker(role: Column | str = "role") -> Column:
    role = F.col(role) if isinstance(role, str) else role
    out = None
    for name, spoken in SPEAKERS.items():
        out = F.when(role == name, spoken) if out is None else out.when(role == name, spoken)
    return out.otherwise(role)


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column where the table has it, else null."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def tool_calls(turns: DataFrame) -> DataFrame:
    """(session_id, turn, name, args, result, ts): each call with the observation of the next turn.

    ``args`` is JSON text; ``ts`` is null where ``turns`` has none.
    """
    calls = turns.where(F.col("role").isin(*CALL_ROLES)).select(
        "session_id", "turn",
        F.get_json_object("text", "$.name").alias("name"),
        F.get_json_object("text", "$.args").alias("args"),
        _optional(turns, "ts", "long").alias("ts"),
    )
    seen = turns.where(F.col("role").isin(*RESULT_ROLES)).select(
        "session_id", (F.col("turn") - 1).alias("turn"), clip_text("text", RESULT_CHARS).alias("result")
    )
    return calls.join(seen, ["session_id", "turn"], "left").select("session_id", "turn", "name", "args", "result", "ts")


def call_chunks(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(session_id, chunk, tool_calls): the calls in order, those of at most ``chunk`` turns per row."""
    call = F.struct("turn", "name", "args", "result", "ts")
    return (
        tool_calls(turns)
        .groupBy("session_id", F.floor(F.col("turn") / chunk).alias("chunk"))
        .agg(F.array_sort(F.collect_list(call)).alias("_c"))
        .select("session_id", "chunk", F.transform("_c", lambda c: c.dropFields("turn")).alias("tool_calls"))
    )


def session_summaries(turns: DataFrame) -> DataFrame:
    """(session_id, timestamp, summary) from the first question, the tools and the last answer.

    The tool list holds distinct names, a small vocabulary. ``timestamp`` is the first
    stamp of the session.
    """
    human, gpt = F.col("role").isin(*HUMAN_ROLES), F.col("role").isin(*ANSWER_ROLES)
    ends = turns.groupBy("session_id").agg(
        F.min_by(clip_text("text", QUESTION_CHARS), F.when(human, F.col("turn"))).alias("_q"),
        F.max_by(clip_text("text", ANSWER_CHARS), F.when(gpt, F.col("turn"))).alias("_a"),
        F.min(_optional(turns, "ts", "long")).alias("timestamp"),
    )
    named = tool_calls(turns).groupBy("session_id").agg(F.array_sort(F.collect_set("name")).alias("_tools"))
    summary = F.concat_ws(
        SEPARATOR,
        F.concat(F.lit(QUESTION), "_q"),
        F.concat(F.lit(TOOLS), F.when(F.size("_tools") > 0, F.array_join("_tools", ", "))),
        F.concat(F.lit(ANSWER), "_a"),
    )
    return ends.join(named, "session_id", "left").select("session_id", "timestamp", summary.alias("summary"))


def case_document(summary: Column, calls: Column, session_id: Column) -> Column:
    """The text kept for later search: the summary and a line per call with its arguments."""
    lines = F.transform(
        calls,
        lambda c: F.concat(F.lit("- "), F.coalesce(c["name"], F.lit("")), F.lit("("), F.coalesce(c["args"], F.lit("")), F.lit(")")),
    )
    listed = F.when(F.size(calls) > 0, F.array_join(lines, "\n")).otherwise(NO_TOOLS)
    return F.concat(
        F.lit(CASE_HEAD), summary, F.lit(CASE_TOOLS), listed, F.lit(CASE_SESSION), session_id.cast("string"), F.lit("\n")
    )


def conversation_chunks(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(session_id, chunk, conversations): the turns in order, at most ``chunk`` per row."""
    value = F.when(F.col("role").isin(*RESULT_ROLES), clip_text("text", RESULT_CHARS)).otherwise(F.col("text"))
    entry = F.struct("turn", speaker().alias("from"), value.alias("value"))
    return (
        turns.groupBy("session_id", F.floor(F.col("turn") / chunk).alias("chunk"))
        .agg(F.array_sort(F.collect_list(entry)).alias("_c"))
        .select(
            "session_id", "chunk",
            F.transform("_c", lambda e: F.struct(e["from"].alias("from"), e["value"].alias("value"))).alias("conversations"),
        )
    )


def build_trajectories(
    turns: DataFrame, chunk: int = CHUNK, rewards: DataFrame | None = None, skills: DataFrame | None = None
) -> DataFrame:
    """One row per session and chunk of turns: its turns and calls, with the session's summary.

    ``rewards`` is (session_id, reward), ``skills`` (session_id, skill_extracted), one row
    per session; both columns are null without them. A session of one chunk is one whole
    trajectory; the case document of a longer one lists the calls of its chunk.
    """
    out = conversation_chunks(turns, chunk).join(session_summaries(turns), "session_id")
    out = out.join(call_chunks(turns, chunk), ["session_id", "chunk"], "left")
    for extra, name, kind in ((rewards, "reward", "double"), (skills, "skill_extracted", "string")):
        if extra is None:
            out = out.withColumn(name, F.lit(None).cast(kind))
        else:
            out = out.join(extra.select("session_id", F.col(name).cast(kind)), "session_id", "left")
    out = out.withColumn("tool_calls", F.coalesce("tool_calls", F.array().cast(CALLS)))
    case = case_document(F.col("summary"), F.col("tool_calls"), F.col("session_id"))
    return out.select(
        "session_id", "chunk", "timestamp", "conversations", "tool_calls", "reward", "skill_extracted", "summary",
        case.alias("case_document"),
    )


def write_trajectories(trajectories: DataFrame, path: str) -> None:
    """Append JSON lines in one folder per user; ``trajectories`` brings ``user_id``."""
    trajectories.write.mode("append").partitionBy("user_id").json(path)


def read_trajectories(spark: SparkSession, path: str, session_type: str = "string") -> DataFrame:
    """The JSON lines of ``write_trajectories``."""
    return spark.read.schema(f"user_id string, session_id {session_type}, {STORED}").json(path)
