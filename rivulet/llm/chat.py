"""Chat formatting with a grammar round trip; only DataFrame functions run.

    conversation := turn*
    turn         := "### " role "\n" text "\n</turn>\n"

Control strings inside a text are "### " and "</turn>". A text is rendered as it is; the
rendering is parsed back and compared with the source. In the turns that come back
otherwise each control string, with the backslashes just before it, gets one backslash
more, until the conversation comes back identical. The parser always takes one backslash
off in front of control strings, so it needs no mark of which turns were escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import table

OPEN, CLOSE = "### ", "</turn>"
END = f"\n{CLOSE}\n"
#: A run of backslashes is looked at from its first one only, so its length counts once.
CONTROL = r"(?<!\\)(\\*+(?:### |</turn>))"
ESCAPED = r"(?<!\\)\\(\\*+(?:### |</turn>))"
#: Roles whose texts are learned from.
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    """One backslash more in front of each control string and the backslashes before it."""
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"\\$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1"))


def escape_role(role: Column) -> Column:
    """Backslashes doubled, then line ends as backslash n: a role stays on its line."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a doubled backslash stands as backslash b meanwhile, which escape_role never writes
    hidden = F.replace(F.replace(role, F.lit("\\\\"), F.lit("\\b")), F.lit("\\n"), F.lit("\n"))
    return F.replace(hidden, F.lit("\\b"), F.lit("\\"))


def render(turns: Column) -> Column:
    """turns: an array of structs role, text (as they are to stand in the output)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), t["text"], F.lit(END))), "")


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation: an array of structs role, text, raw.

    raw is the text as it stands in the output. Text after the last turn's end is no turn.
    """
    found = F.filter(F.split(rendered, END), lambda x: F.startswith(x, F.lit(OPEN)))

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        raw = F.substring(x, cut + 1, F.length(x))
        return F.struct(unescape_role(F.substring(x, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"), unescape(raw).alias("text"), raw.alias("raw"))

    return F.transform(found, turn)


def format_chat(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (as read back: role, text, raw), escaped_turns.

    Null role or text: the empty string. Rows of a conversation stand by turn, null
    first; equal turns by role, then text; repeated rows are turns of their own. Rows
    with a null conv_id make one conversation. Other columns are not looked at. An empty
    table has no conversations. A conversation that would not come back identical fails
    the job; escaping rules that out.

    A conversation is one string, so its turns meet in one task; conversations are dealt
    by their id.
    """
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    x = df.select(F.col(f"`{conv_id}`").alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("source"))
    x = x.withColumn("plain", render(F.col("source")))
    x = x.withColumn("back", parse(F.col("plain")))
    same = lambda s, t: s["role"].eqNullSafe(t["role"]) & s["text"].eqNullSafe(t["text"])
    whole = (F.size("back") == F.size("source")) & F.forall(F.zip_with("source", "back", same), lambda ok: ok)
    # a turn conflicts if it holds the end mark or doesn't come back by itself
    clean = lambda t: (unescape(t["text"]) == t["text"]) & ~F.contains(t["text"], F.lit(CLOSE))
    x = x.withColumn("identical", whole & F.forall("source", clean)).drop("back")
    mended = F.transform("source", lambda t: F.struct(t["role"].alias("role"), F.when(clean(t), t["text"]).otherwise(escape(t["text"])).alias("text")))
    x = x.withColumn("formatted", F.when(F.col("identical"), F.col("plain")).otherwise(render(mended)))
    x = x.withColumn("escaped_turns", F.when(F.col("identical"), 0).otherwise(F.size(F.filter("source", lambda t: ~clean(t)))).cast("long")).drop("plain", "identical")
    x = x.withColumn("turns", parse(F.col("formatted")))
    fine = (F.size("turns") == F.size("source")) & F.forall(F.zip_with("source", "turns", same), lambda ok: ok)
    checked = F.when(fine, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't come back from its rendering")))
    return x.select("conv_id", checked.alias("formatted"), "turns", "escaped_turns")


def chat_digests(chats: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """Counts and digests of what was read back; the loss mask covers the texts of learned roles."""
    masked = F.filter("turns", lambda t: t["role"].isin(*learned))
    x = chats.withColumn("loss", F.array_join(F.transform(masked, lambda t: t["text"]), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "escaped_turns",
    )


PROBE = r"\### Assistant: </turn> ok"


def op3(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat_digests(format_chat(rows.unionByName(probe), "conv_id", "turn", "role", "text"))


OP3_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, contains(text, '</turn>') OR regexp_matches(text, '\\(### |</turn>)') AS odd FROM said
), convs AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(4 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + 1 + 9
      + length(CASE WHEN odd THEN regexp_replace(text, '(\\*(?:### |</turn>))', '\\\1', 'g') ELSE text END)) AS formatted_chars,
    count(*) FILTER (WHERE odd) AS escaped_turns
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, escaped_turns
FROM convs
"""
