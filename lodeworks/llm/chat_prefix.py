r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that reply is
trainable. A turn is written ``[INST]role[/INST]text</s>``. Inside roles and texts ``\`` is written ``\b`` and the
control strings ``</s>``, ``[INST]`` and ``[/INST]`` are written ``\e``, ``\i`` and ``\c``, so control strings stand at
turn marks alone and every text can be read back.

Defined results: rows go by turn, ties by role and text; a null turn comes first; a null role or text counts as empty;
turns after the last reply make one further row without trainable characters (``trained`` false), so that the output
holds every turn; a repeated row is a turn of its own; rows with a null conv_id are one conversation; empty tables give
empty tables; other columns are not read. A context is repeated in each later example, as the method asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The template's control strings and how texts spell them.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
SPELLED = ((END, "\\e"), (OPEN, "\\i"), (CLOSE, "\\c"))
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    for control, spelling in SPELLED:
        out = F.replace(out, F.lit(control), F.lit(spelling))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for control, spelling in SPELLED:
        out = F.replace(out, F.lit(spelling), F.lit(control))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0, by turn), text, trained, loss_at and loss_chars (the reply's span in the text, in code points)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(CLOSE), escaped(t["text"]), F.lit(END)).alias("all"), F.length(escaped(t["text"])).alias("body"), (t["role"] == TRAINED).alias("reply")),
    )
    chats = chats.select("conv_id", parts.alias("parts"))
    rows = chats.select("conv_id", "parts", F.posexplode("parts").alias("k", "part"))
    rows = rows.where(F.col("part.reply") | (F.col("k") == F.size("parts") - 1))
    text = F.array_join(F.slice(F.col("parts.all"), F.lit(1), F.col("k") + 1), "")
    rows = rows.select("conv_id", F.col("k").cast("long").alias("example"), text.alias("text"), F.col("part.reply").alias("trained"), F.when(F.col("part.reply"), F.col("part.body")).otherwise(0).cast("long").alias("loss_chars"))
    return rows.select("conv_id", "example", "text", "trained", (F.length("text") - len(END) - F.col("loss_chars")).cast("long").alias("loss_at"), "loss_chars")


def turns_of(text: Column) -> Column:
    """array<struct<role, text>> that a formatted text holds."""
    pieces = F.split(text, END)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def read(x: Column) -> Column:
        halves = F.split(x, r"\[/INST\]")
        return F.struct(unescaped(F.substring(F.get(halves, F.lit(0)), len(OPEN) + 1, 2**31 - 1)).alias("role"), unescaped(F.get(halves, F.lit(1))).alias("text"))

    return F.transform(whole, read)


def read_digests(rows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted rows: counts and digests of its turns and of the text under the loss mask."""
    loss = unescaped(F.substring("text", F.col("loss_at").cast("int") + 1, F.col("loss_chars").cast("int")))
    told = rows.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct("example", loss.alias("loss"))))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    told = told.select("conv_id", turns_of(F.col("last")).alias("turns"), "loss", "formatted_chars")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The contract's conversation -1, whose texts hold control strings."""
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    probe = F.lit(END + OPEN + " ok " + CLOSE)
    rows = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), probe.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


def op7_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(expand(with_probe(table(spark, sf_dir, "conversations"))))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length('[INST]' || replace(replace(replace(replace(role, '\', '\b'), '</s>', '\e'), '[INST]', '\i'), '[/INST]', '\c') || '[/INST]'
      || replace(replace(replace(replace(text, '\', '\b'), '</s>', '\e'), '[INST]', '\i'), '[/INST]', '\c') || '</s>') AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), x AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""
