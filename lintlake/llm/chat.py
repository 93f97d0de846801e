"""Chat formatting [native]: prefix-target expansion of conversations.

A turn is written as <|turn|>role<|text|>text<|end|>.  Every assistant turn becomes an example of its own: all turns before
it as context, then the reply, whose text alone is trainable (`loss_start` to `loss_end`, code points).  As nothing that
follows changes how a turn is written, each example is a prefix of its conversation's whole text, so an example costs one
substring.  Turns after the last reply, or all turns where there is none, go into a last example without target, so that
every turn can be read back from the examples.

Control strings inside roles and texts, those of this template and those of other common ones, get a backslash after
their first character, behind any backslashes that stand there; reading back takes one away.

Nulls in role or text count as empty; rows of a null id are one conversation; turns are ordered by turn (null first), then
role, then text; repeated rows are turns of their own; an empty table gives no examples; other columns are ignored.  An
example holds all that precedes its reply, so examples grow with the square of a conversation's turns, and a conversation
must fit into one row: that is the method's own size.  Examples are made row by row, never gathered as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm._common import running_sum

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What begins a control string, and what follows it.  No tail holds a head, so matches can't overlap.
HEAD, TAIL = r"[<\[]", r"(?:/?s>|/?INST\]|/?SYS>>|\|[a-z_]+\|>)"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"({HEAD})(\\*)({TAIL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"({HEAD})\\(\\*)({TAIL})", "$1$2$3")


def chat_examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example (from 1), text, loss_start, loss_end (null if nothing is trainable), is_last."""
    string = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(""))
    rows = conversations.select(conversations[conv_col].alias("conv_id"), conversations[turn_col].alias("turn"), string(role_col).alias("role"), escaped(string(text_col)).alias("body"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body"))).alias("turns"))
    written = lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT), t["body"], F.lit(END))
    turns = turns.withColumn("pieces", F.transform("turns", written)).withColumn("whole", F.array_join("pieces", ""))
    turns = turns.withColumn("starts", running_sum(F.transform("pieces", lambda p: F.length(p).cast("bigint"))))
    cut = F.transform("turns", lambda t, i: F.struct((F.get("starts", i) + F.length(F.get("pieces", i))).cast("int").alias("end"), F.when(t["role"] == TRAINED, F.length(t["body"])).alias("size"), (i == F.size("turns") - 1).alias("is_last")))
    each = turns.select("conv_id", "whole", F.posexplode(F.filter(cut, lambda c: c["size"].isNotNull() | c["is_last"])).alias("at", "cut"))
    close = F.col("cut.end") - len(END)
    return each.select(
        "conv_id", (F.col("at") + 1).alias("example"), F.substring(F.col("whole"), F.lit(1), F.col("cut.end")).alias("text"),
        (close - F.col("cut.size")).alias("loss_start"), F.when(F.col("cut.size").isNotNull(), close).alias("loss_end"), F.col("cut.is_last").alias("is_last"),
    )


def read_back(text: Column) -> Column:
    """The turns of an example's text, as an array of role and text."""
    piece = lambda p: F.struct(unescaped(F.substring_index(p, TEXT, 1)).alias("role"), unescaped(F.regexp_replace(p, rf"(?s)^.*?{_quoted(TEXT)}|{_quoted(END)}\z", "")).alias("text"))
    return F.transform(F.slice(F.split(text, _quoted(TURN), -1), 2, F.length(text) + 1), piece)


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def trained_text(examples: DataFrame) -> Column:
    """What the mask leaves trainable, as it was before it was escaped; null without a target."""
    return F.when(examples["loss_end"].isNotNull(), unescaped(F.substring(examples["text"], examples["loss_start"] + 1, examples["loss_end"] - examples["loss_start"])))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and one more that speaks control strings, read back from their examples."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    examples = chat_examples(told.unionByName(more))
    digest = F.array_join(F.transform(read_back(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", "example", trained_text(examples).alias("trained"), F.length("text").cast("bigint").alias("size"),
        F.when(F.col("is_last"), F.sha2(digest, 256)).alias("digest"), F.when(F.col("is_last"), F.size(read_back(F.col("text"))).cast("bigint")).alias("turns"),
    )
    whole = read.groupBy("conv_id").agg(F.max("turns").alias("n_turns"), F.max("digest").alias("turns_sha256"), F.sum("size").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("example", "trained"))).alias("parts"))
    trained = F.array_join(F.transform("parts", lambda p: p["trained"]), "")
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length(trained).cast("bigint").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), "formatted_chars")
