r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it are context and only its reply carries loss. A turn is
written ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside a text or role get one backslash after their
first character (and one more for every such backslash that was there), which the reader takes out again, so no
text can forge a turn and every text comes back exactly.

Defined results: a null text or role counts as empty; turns are ordered by turn, role, text (a null turn first), so
ties and repeated rows have one order and all stay; a null conv_id is a conversation of its own; turns after the last
assistant turn (or all, if there is none) come in one more example without loss, so nothing is lost; an empty table
gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_REST = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])"
_ESCAPE, _UNESCAPE = r"([<\[])(\\*)" + _REST, r"([<\[])\\(\\*)" + _REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per example: conv_id, example, text, loss_start (0-based), loss_len.

    One shuffle by conv_id. Positions are exploded before the text is built, so a long conversation is never held as
    an array of all its examples.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    t = t.select(
        "conv_id",
        F.transform("ts", lambda x: F.struct(
            F.concat(F.lit(OPEN), _escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"),
            (x["role"] == "assistant").alias("reply"))).alias("segs"))
    at = F.filter(F.sequence(F.lit(1), F.size("segs")), lambda i: F.element_at("segs", i)["reply"])
    last = F.size("segs")
    at = F.when(F.element_at("segs", last)["reply"], at).otherwise(F.concat(at, F.array(last)))
    t = t.select("conv_id", "segs", F.posexplode(at).alias("example", "i"))
    whole = lambda s: F.concat(s["head"], s["body"], F.lit(CLOSE + "\n"))
    seg = F.element_at("segs", F.col("i"))
    t = t.select("conv_id", "example", F.array_join(F.transform(F.slice("segs", 1, F.col("i") - 1), whole), "").alias("context"), seg.alias("seg"))
    return t.select(
        "conv_id", F.col("example").cast("long"),
        F.concat("context", whole(F.col("seg"))).alias("text"),
        (F.length("context") + F.length("seg.head")).cast("long").alias("loss_start"),
        F.when(F.col("seg.reply"), F.length("seg.body")).otherwise(0).cast("long").alias("loss_len"))


def read_back(examples: DataFrame) -> DataFrame:
    """The digests of each conversation, from the formatted text and the loss mask alone. No further shuffle."""
    reply = unescape(F.expr("substring(text, cast(loss_start as int) + 1, cast(loss_len as int))"))
    e = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("full"), F.sum(F.length("text")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("loss_len") > 0, F.struct("example", reply.alias("r"))))).alias("replies"))
    loss = F.array_join(F.transform("replies", lambda x: x["r"]), "")
    segs = F.slice(F.split("full", r"<\|im_start\|>", -1), 2, 1 << 30)
    turn = lambda s: F.concat(
        _unescape_role(F.substring_index(s, "\n", 1)), F.lit("\n"),
        unescape(F.substr(F.left(s, F.length(s) - len(CLOSE) - 1), F.length(F.substring_index(s, "\n", 1)) + 2)), F.lit("\n"))
    e = e.select("conv_id", "formatted_chars", loss.alias("loss"), F.transform(segs, turn).alias("turns"))
    return e.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


PROBE = r"</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_conversations(turns.union(probe)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    12 + length(role) + 1 + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')) + 11 AS seg
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (SELECT *, sum(seg) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
