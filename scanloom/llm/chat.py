"""Dialogues rendered from the view of each participant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import ranked, running, same, settled

#: Fixed marks of the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, ASSISTANT, USER = "system", "assistant", "user"
#: Turn numbers ordered together; a longer dialogue has more parts.
PART = 256
_LAST = (1 << 62) - 1


def rotated(turns: DataFrame) -> DataFrame:
    """Columns ``conv_id``, ``speaker``, ``position``, ``role``, ``name``, ``rendered``, ``start``, ``stop``, ``trained``.

    ``turns`` has conv_id, turn, role (who speaks) and text. For every speaker of a dialogue but the system,
    all its turns are listed in order, rendered with that speaker as ``assistant`` and every other one as
    ``user`` with the speaker's name; system turns stay system turns. ``start`` and ``stop`` are the
    characters of the whole rendered dialogue that hold the turn's text and its closing mark, and
    ``trained`` tells whether they count for the loss: they do for the assistant's turns alone.
    The ``rendered`` texts of a (conv_id, speaker) in the order of ``position`` are the dialogue.

    Order is (turn, role, text), nulls last; repeated turns stay. A null role is a speaker without a name
    (name ``""``), a null text is empty, turns with a null conv_id form one dialogue. A dialogue with only
    system turns has no view. No dialogue meets in one task: positions and lengths are summed by part of
    the ordered table, and views are joined by (dialogue, part of it).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"),
        F.col("role").isNull().alias("unnamed"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("by"),
        F.col("text").isNull().alias("silent"),
        text.alias("said"),
        F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)) / PART).alias("part"),
    )
    order = ["turn", "unnamed", "by", "silent", "said"]
    placed = settled(ranked(rows, ["conv_id"], "part", order, "position"), "turns")
    speakers = placed.where(F.col("by") != SYSTEM).groupBy("conv_id", "by").agg(F.count(F.lit(1)).alias("n"))
    speakers = speakers.select("conv_id", F.col("by").alias("speaker"))
    parts = placed.select("conv_id", "part").distinct()
    views = parts.join(speakers, same(parts, speakers, ["conv_id"])).select(parts["conv_id"], "part", "speaker")
    views = views.withColumnsRenamed({"conv_id": "view_conv", "part": "view_part"})
    seen = placed.join(views, placed["conv_id"].eqNullSafe(views["view_conv"]) & (placed["part"] == views["view_part"]))
    own = F.col("by") == F.col("speaker")
    role = F.when(F.col("by") == SYSTEM, SYSTEM).when(own, ASSISTANT).otherwise(USER)
    name = F.when(F.col("by") == SYSTEM, F.lit(None)).when(own, F.lit(None)).otherwise(F.col("by"))
    head = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    shown = (
        seen.select("conv_id", "speaker", "part", "position", role.alias("role"), name.alias("name"), "said")
        .withColumn("head", F.length(head))
        .withColumn("rendered", F.concat(head, "said", F.lit(CLOSE)))
        .drop("said")
    )
    shown = running(shown, ["conv_id", "speaker"], "part", ["position"], F.length("rendered"), "before")
    return shown.select(
        "conv_id",
        "speaker",
        "position",
        "role",
        "name",
        "rendered",
        (F.col("before") + F.col("head")).alias("start"),
        (F.col("before") + F.length("rendered")).alias("stop"),
        (F.col("role") == ASSISTANT).alias("trained"),
    )
