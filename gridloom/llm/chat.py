r"""Chat formatting by a grammar round trip, in SQL functions only.

Grammar of a formatted conversation, one after another for each turn::

    ### <role>:\n<text>\n</turn>\n

The parser cuts at every closing line, reads the role from the head line, and takes one backslash from each run of backslashes before
a control string (``### `` or ``</turn>``). A conversation is rendered with its texts as they are, parsed again and compared with its
source; if a turn differs, or a text holds a control string, it is rendered anew with one backslash added before each control string
in its texts, and if that differs too (odd roles), with its roles percent-encoded behind ``%``. The last form always comes back.

Null texts and roles are empty. Turns are ordered by (turn, role, text), a null turn first; repeated rows are turns of their own. Null
conv_id is a conversation. An empty table gives no conversations. Other columns are not looked at. All steps are linear in the text, long
runs of backslashes and conversations of many turns included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(### |</turn>)"
CLOSE = "\n</turn>\n"
HEAD = r"^(?s)### ([^\n:]*):\n(.*)$"


def escape(text: Column) -> Column:
    # a match starts at the head of a run of backslashes only and never gives one back: linear in the text
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + CONTROL, "$1$2")


def _role(role: Column, encoded: bool) -> Column:
    return F.concat(F.lit("%"), F.url_encode(role)) if encoded else role


def render(turns: Column, texts_escaped: bool = False, roles_encoded: bool = False) -> Column:
    """Formatted text of an ``array<struct<role,text>>``."""
    parts = F.transform(turns, lambda t: F.concat(F.lit("### "), _role(t["role"], roles_encoded), F.lit(":\n"), escape(t["text"]) if texts_escaped else t["text"], F.lit(CLOSE)))
    return F.array_join(parts, "")


def _segments(formatted: Column) -> Column:
    """What stands before each closing line, without the empty end."""
    cut = F.split(formatted, r"\n</turn>\n", -1)
    return F.slice(cut, 1, F.size(cut) - 1)


def parse(formatted: Column) -> Column:
    """Turns (role, text, raw) of a formatted text; raw is the text still escaped."""

    def turn(segment: Column) -> Column:
        role, raw = F.regexp_extract(segment, HEAD, 1), F.regexp_extract(segment, HEAD, 2)
        plain = F.when(role.startswith("%"), F.try_url_decode(F.substr(role, F.lit(2)))).otherwise(role)
        return F.struct(plain.alias("role"), unescape(raw).alias("text"), raw.alias("raw"))

    return F.transform(_segments(formatted), turn)


def _same(formatted: Column, turns: Column) -> Column:
    """Does the parser give back the source, with no bare control string in any text?"""
    got = parse(formatted)
    bare = F.exists(got, lambda t: F.regexp_like(t["raw"], F.lit(r"(?<!\\)" + CONTROL)))
    back = F.transform(got, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce((back == turns) & ~bare, F.lit(False))


def conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation: (conv_id, turns)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_chat(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted, attempt): the first form of 0, 1, 2 that parses back to the source."""
    talks = conversations(rows)
    tried = talks.withColumn("plain", render(F.col("turns"))).withColumn("plain_ok", _same(F.col("plain"), F.col("turns")))
    tried = tried.withColumn("escaped", F.when(~F.col("plain_ok"), render(F.col("turns"), True)))
    tried = tried.withColumn("escaped_ok", F.when(~F.col("plain_ok"), _same(F.col("escaped"), F.col("turns"))))
    form = F.when(F.col("plain_ok"), F.col("plain")).when(F.col("escaped_ok"), F.col("escaped")).otherwise(render(F.col("turns"), True, True))
    attempt = F.when(F.col("plain_ok"), 0).when(F.col("escaped_ok"), 1).otherwise(2)
    return tried.select("conv_id", "turns", form.alias("formatted"), attempt.alias("attempt"))


def loss_mask(formatted: Column, role: str = "assistant") -> Column:
    """An entry for each turn: (start, length) of its text if that is under the loss mask, else null; in code points from the turn's first one.

    Counted from its turn, a span is found and read without a walk over the whole conversation, however many turns that has."""

    def span(segment: Column) -> Column:
        head, raw = F.regexp_extract(segment, HEAD, 1), F.regexp_extract(segment, HEAD, 2)
        is_loss = F.when(head.startswith("%"), F.try_url_decode(F.substr(head, F.lit(2)))).otherwise(head) == role
        return F.when(is_loss, F.struct((F.length(head) + 6).alias("start"), F.length(raw).alias("length")))

    return F.transform(_segments(formatted), span)


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped turn by turn."""
    return F.array_join(F.zip_with(_segments(formatted), mask, lambda s, m: unescape(F.substr(s, m["start"] + 1, m["length"]))), "")


def digest(rows: DataFrame) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    spark = rows.sparkSession
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    made = format_chat(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra))
    made = made.select("conv_id", "formatted", "attempt", loss_mask(F.col("formatted")).alias("mask"))
    back = made.select("*", parse(F.col("formatted")).alias("got"), under_mask(F.col("formatted"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("got", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select(
        "conv_id", F.size("got").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.col("attempt").cast("int").alias("attempt"), F.size(F.filter("mask", lambda m: m.isNotNull())).cast("long").alias("loss_spans"),
    )
