"""Chat formatting of typed content parts.

A message holds parts: text, image, audio or document. A visitor (one branch a part type)
flattens the parts of a message in order: text is escaped, any other part becomes a
placeholder that names its type and attachment number, with the attachment's reference and
its expanded token count recorded beside the text. Messages are then joined by a template.

Template of a turn: `<|turn|>` role `<|says|>` content `<|end|>`. Inside content and role every
`&` is written `&amp;` and every `<` is written `&lt;`, so no control string of this or another
template that begins with `<` can appear there, and `[` is written `&lsqb;` for templates that
begin with `[`. Undoing the three replacements gives the text back, so the output can be read
back without loss.

The loss mask is the list of spans (begin, length in code points) of assistant contents in the
formatted text.

Defined results: a null text is an empty text; a null role is the role ''; null turns come
first; turns that tie are ordered by role and text; repeated rows are repeated turns; rows of a
null conversation form one conversation; an empty table gives no rows; only the named columns
are read, so others cannot clash. A conversation is one training record and is assembled by one
task; nothing is gathered across conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
LEARNED_ROLE = "assistant"

#: Tokens that a part of a type expands to: fixed, and for each unit of its size.
EXPANSION = {"image": (2, 1.0), "audio": (2, 25.0), "document": (2, 1.0)}


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit("["), F.lit("&lsqb;"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("&lsqb;"), F.lit("["))
    text = F.replace(text, F.lit("&lt;"), F.lit("<"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def visit_parts(parts: Column) -> tuple[Column, Column]:
    """Content and attachments of a message.

    `parts` is an array of structs (type, text, ref, units). Attachments carry their number,
    type, reference and expanded token count, in order. An unknown type is taken as text.
    """
    is_other = lambda part: F.coalesce(part["type"], F.lit("text")).isin(*EXPANSION)
    others = F.filter(parts, is_other)

    def tokens(part: Column) -> Column:
        count = F.lit(0).cast("long")
        for kind, (fixed, each) in EXPANSION.items():
            grown = F.lit(fixed) + F.ceil(F.coalesce(part["units"], F.lit(0)) * F.lit(each))
            count = F.when(part["type"] == kind, grown.cast("long")).otherwise(count)
        return count

    def placeholder(part: Column, at: Column) -> Column:
        number = F.size(F.filter(F.slice(parts, F.lit(1), at + 1), is_other))
        return F.concat(F.lit("<|"), part["type"], F.lit(":"), number.cast("string"), F.lit("|>"))

    content = F.array_join(
        F.transform(
            parts,
            lambda part, at: F.when(is_other(part), placeholder(part, at)).otherwise(
                escape(F.coalesce(part["text"], F.lit("")))
            ),
        ),
        "",
    )
    attachments = F.transform(
        others,
        lambda part, at: F.struct(
            (at + 1).alias("number"), part["type"].alias("type"), part["ref"].alias("ref"), tokens(part).alias("tokens")
        ),
    )
    return content, attachments


def text_part(text: Column) -> Column:
    """The parts of a message that is text alone."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"),
        )
    )


def format_chat(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """conv_id, n_messages, formatted, loss_spans, attachments, n_attachment_tokens."""
    content, attachments = visit_parts(F.col(parts))
    flat = messages.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("content"), attachments.alias("attachments"),
        F.array_join(F.transform(parts, lambda part: F.coalesce(part["text"], F.lit(""))), "").alias("plain"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    block = F.concat(head, F.col("content"), F.lit(END))
    # rows that tie in all of these are equal, so any order among them gives the same text
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain", "content", "attachments")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = flat.withColumn("block", block).withColumn("head", F.length(head)).select(
        "conv_id", "block", "attachments",
        F.row_number().over(order).alias("nth"),
        (F.sum(F.length("block")).over(upto) - F.length("block") + F.col("head")).cast("long").alias("begin"),
        F.length("content").cast("long").alias("length"),
        (F.col("role") == LEARNED_ROLE).alias("learned"),
    )
    turns = F.sort_array(F.collect_list(F.struct("nth", "block", "attachments", "begin", "length", "learned")))
    learned = F.filter("turns", lambda x: x["learned"])
    every = F.flatten(F.transform("turns", lambda x: x["attachments"]))
    return placed.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_messages"),
        F.array_join(F.transform("turns", lambda x: x["block"]), "").alias("formatted"),
        F.transform(learned, lambda x: F.struct(x["begin"].alias("begin"), x["length"].alias("length"))).alias("loss_spans"),
        every.alias("attachments"),
        F.aggregate(every, F.lit(0).cast("long"), lambda total, x: total + x["tokens"]).alias("n_attachment_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, read from `formatted` and `loss_spans` alone."""
    blocks = F.filter(F.split(F.col("formatted"), r"<\|turn\|>"), lambda x: x != "")
    turns = F.transform(
        blocks,
        lambda x: F.struct(
            unescape(F.substring_index(x, SAYS, 1)).alias("role"),
            unescape(
                F.substring(x, F.length(F.substring_index(x, SAYS, 1)) + len(SAYS) + 1, F.length(x))
            ).alias("tail"),
        ),
    )
    # the end mark holds `<`, which unescaping cannot bring into the mark's place: it is last
    turns = F.transform(
        turns,
        lambda x: F.struct(x["role"].alias("role"), F.substring(x["tail"], F.lit(1), F.length(x["tail"]) - len(END)).alias("text")),
    )
    learned = F.transform(
        "loss_spans", lambda x: F.substring("formatted", (x["begin"] + 1).cast("int"), x["length"].cast("int"))
    )
    return formatted.select("*", turns.alias("turns"), unescape(F.array_join(learned, "")).alias("loss_text"))


def digest(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, role || chr(10) || text || chr(10) AS said,
         length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'))
         + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'))
         + {len(TURN + SAYS + END)} AS chars
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
