"""Chat formatting: every dialogue rendered once per participant, seen from that speaker's side.

In the rendering for participant P the turns of P are the assistant's, those of other speakers are users' turns
that carry the speaker's name, and turns of a narrator role (system prompts) stay what they are. A rendering is the
concatenation of its segments by ``position``; segments are rows, so a dialogue of any length stays
distributed, and each row knows where it stands in the rendered text: ``start``, ``end``, and the part to
learn from, ``mask_start`` to ``mask_end`` (content and end mark of the assistant's turns; null elsewhere),
in code points.

Defined results: turns are ordered by turn number, role, then text, nulls first; equal rows are all kept. A null text is
an empty turn. A null role is a speaker without a name. Rows without conversation id form one dialogue. A
dialogue of narrators only has no participant and no rendering. Control marks inside texts get a backslash
after their ``<``, so that no text can end a turn. A very long text is one row's segment; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.llm.common import running, text_of

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NARRATORS = ("system",)


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<\\" + OPEN[1:])), F.lit(CLOSE), F.lit("<\\" + CLOSE[1:]))


def _name(speaker: Column) -> Column:
    return F.translate(_safe(F.coalesce(speaker, F.lit(""))), "\n\r", "  ")


def rotations(turns: DataFrame, narrators: Sequence[str] = NARRATORS) -> DataFrame:
    """Segments of every rendering: ``conv_id, perspective, position, role, name, segment, start, end, mask_start, mask_end``."""
    rows = turns.select("conv_id", F.col("turn").alias("turn"), F.col("role").alias("speaker"), text_of().alias("content"))
    narrates = F.coalesce(F.col("speaker").isin(*narrators), F.lit(False))
    sides = rows.where(~narrates).select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(sides, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(narrates, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") != "assistant", _name(F.col("speaker"))))
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.col("name"))).otherwise(F.lit("")), F.lit("\n"))
    seen = seen.withColumn("__head", F.length(head)).withColumn("segment", F.concat(head, _safe(F.col("content")), F.lit(CLOSE + "\n")))
    placed = running(seen, ["conv_id", "perspective"], ["turn", "speaker", "content"], {"__earlier": F.lit(1), "start": F.length("segment")})
    mine = F.col("role") == "assistant"
    end = F.col("start") + F.length("segment")
    return placed.select(
        "conv_id", "perspective", (F.col("__earlier") + 1).alias("position"), "role", "name", "segment", "start", end.alias("end"),
        F.when(mine, F.col("start") + F.col("__head")).alias("mask_start"), F.when(mine, end - 1).alias("mask_end"))
