"""Multi-party chat rendering from every speaker's side, by DataFrame functions alone.

Each participant of a conversation gets a rendering of the dialogue in which its
own turns are the assistant's and the others' are those of named users; the mask
lists the character spans that this assistant has to learn. What speakers say and
are called cannot forge a turn: marks in it are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

UNNAMED = "unknown"
SYSTEM = "system"
START, TAIL = "<|im_start|>", "<|im_end|>\n"
#: Line ends and other control characters, which a speaker's name is shown without.
_CONTROLS = r"[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]+"


def escaped(text: Column) -> Column:
    """text without marks: every <| becomes <\\|, and where backslashes stand between the two, there is one more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """What escaped() was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _rendered(turns: Column, speaker: Column) -> Column:
    """The turns as (head, body, is own)."""
    def one(t: Column) -> Column:
        own = t["who"] == speaker
        role = F.when(own, "assistant").when(t["who"] == SYSTEM, "system").otherwise(F.concat(F.lit("user name="), t["name"]))
        return F.struct(F.concat(F.lit(START), role, F.lit("\n")).alias("head"), t["said"].alias("body"), own.alias("own"))

    return F.transform(turns, one)


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", who_col: str = "role", text_col: str = "text", part_turns: int | None = None) -> DataFrame:
    """One row for each conversation and participant: (conversation, participant, part, n_turns, n_own_turns, text, mask).

    Participants are the distinct speakers of the whole conversation, without the system, whose turns stay the
    system's in every rendering. mask is an array of (start, end), character offsets into the text, end excluded:
    each covers what the participant said and the closing mark, not the head of the turn.
    - A null or empty speaker is "unknown". A null text is an empty one and still a turn.
    - Turns follow their numbers, ties the speaker and the text, so repeated rows stay, side by side; null
      numbers come last. A null conversation id is a conversation of its own.
    - A conversation of system turns alone has no participant, hence no rows.
    - Texts are escaped(), and so are names, whose control characters are shown as one space. Speakers whose names
      look alike then are still two participants.
    A dialogue is rendered whole, as part 0, however many turns it has; a row has to hold it. part_turns, if given, cuts
    the ordered turns into parts of so many, each a rendering; a participant silent in a part has an empty mask there.
    Other columns are not looked at.
    """
    who = F.when(F.coalesce(F.col(who_col), F.lit("")) == "", UNNAMED).otherwise(F.col(who_col))
    rows = turns.select(
        F.col(conv_col).alias("_conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(2**62)).alias("nr"),
        who.alias("who"),
        escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("said"),
    ).withColumn("name", escaped(F.regexp_replace("who", _CONTROLS, " ")))
    whole = rows.groupBy("_conv").agg(
        F.array_sort(F.collect_list(F.struct("nr", "who", "said", "name"))).alias("_turns"), F.array_sort(F.collect_set("who")).alias("_who")
    ).withColumn("_part", F.lit(0))
    if part_turns:
        last = F.floor((F.size("_turns") - 1) / part_turns).cast("int")
        whole = whole.withColumn("_part", F.explode(F.sequence(F.lit(0), last))).withColumn(
            "_turns", F.slice("_turns", F.col("_part") * part_turns + 1, F.lit(part_turns))
        )
    each = whole.select("_conv", "_part", "_turns", F.explode(F.filter("_who", lambda w: w != SYSTEM)).alias("participant"))
    drawn = each.select("_conv", "_part", "participant", _rendered(F.col("_turns"), F.col("participant")).alias("_t"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(TAIL)
    spans = F.aggregate(
        "_t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + size(x)).alias("at"),
            F.when(
                x["own"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), (acc["at"] + size(x) - 1).alias("end")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return drawn.select(
        F.col("_conv").alias(conv_col),
        "participant",
        F.col("_part").alias("part"),
        F.size("_t").alias("n_turns"),
        F.size(F.filter("_t", lambda x: x["own"])).alias("n_own_turns"),
        F.array_join(F.transform("_t", lambda x: F.concat(x["head"], x["body"], F.lit(TAIL))), "").alias("text"),
        spans["spans"].alias("mask"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select(
        "conv_id", "participant", F.col("n_turns").cast("long").alias("n_turns"),
        F.col("n_own_turns").cast("long").alias("n_own_turns"), "text", spans.alias("mask"),
    )


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, 4611686018427387904) AS nr, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS who,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS said
  FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS participant FROM t WHERE who <> 'system'),
m AS (
  SELECT t.conv_id, p.participant, nr, who, said, who = participant AS own,
         '<|im_start|>' || CASE WHEN who = participant THEN 'assistant' WHEN who = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(regexp_replace(who, '[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]+', ' ', 'g'), '<(\\*)\|', '<\\\1|', 'g') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, sum(length(head) + length(said) + 11) OVER w AS stop, row_number() OVER w AS nth
  FROM m WINDOW w AS (PARTITION BY conv_id, participant ORDER BY nr, who, said ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, count(*) AS n_turns, count(*) FILTER (own) AS n_own_turns,
       string_agg(head || said || '<|im_end|>' || chr(10), '' ORDER BY nth) AS text,
       coalesce(string_agg(CAST(stop - length(said) - 11 AS VARCHAR) || '-' || CAST(stop - 1 AS VARCHAR), ',' ORDER BY nth) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, participant
"""
