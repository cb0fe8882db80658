"""Chat examples from multi-party dialogues, one perspective per participant.

The project keeps no dialogues, so this operator is general: any table of turns will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlens.operators.ordered import positions

#: Turns rendered into one row.
PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate_perspectives(turns: DataFrame, dialogue_id: str = "dialogue_id", turn: str = "turn", speaker: str = "speaker", text: str = "text") -> DataFrame:
    """Every dialogue rendered once for each of its participants, with that speaker as the assistant.

    The speaker's own turns read ``<|im_start|>assistant``, all others ``<|im_start|>user name=<speaker>``, each
    followed by the text and ``<|im_end|>``. A row holds up to ``PART_TURNS`` consecutive turns: ``dialogue_id``,
    ``perspective``, ``part`` (bigint, from 0), ``start`` (bigint: code points of the dialogue before the part),
    ``rendered``, and ``mask`` (array of ``(first, past)``: the code points within the part that the assistant is trained
    on, text and end mark of its own turns). The parts of a perspective joined in order are its dialogue.

    Turns are ordered by ``turn`` (nulls first), equal ones by speaker and text; repeated rows are repeated turns. A
    null speaker is the participant ``unknown``, a null text is empty; marks within a text or name are
    broken up by a zero-width space, so a text cannot forge a turn. Rows with a null id form one dialogue.
    Speakers that merely differ by these replacements stay apart. An empty table gives an empty result.

    A dialogue is never gathered in one task: turns are ranked by slices of the turn number, parts are bounded, and
    starts are sums over parts.
    """
    def shown(c):
        return F.regexp_replace(c, r"<\|", "<​|")

    plain = turns.select(
        F.col(dialogue_id).alias("dialogue_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("_key", F.struct(F.col("dialogue_id").alias("id")))
    ranked = positions(plain, ["_key"], ["turn", "speaker", "text"], F.coalesce(F.shiftright("turn", 6), F.lit(-(2**62))))
    placed = ranked.withColumn("part", F.shiftright("pos", PART_TURNS.bit_length() - 1))
    people = plain.select("_key", F.col("speaker").alias("perspective")).distinct()
    heads = {"own": F.lit(f"{OPEN}assistant\n"), "other": F.concat(F.lit(f"{OPEN}user name="), shown(F.col("speaker")), F.lit("\n"))}
    body = F.concat(shown(F.col("text")), F.lit(CLOSE))
    said = F.struct("pos", "speaker", F.concat(heads["own"], body).alias("own"), F.concat(heads["other"], body).alias("other"), F.char_length(body).alias("trained"))
    parts = placed.groupBy("_key", "part").agg(F.sort_array(F.collect_list(said)).alias("said"))

    seen = parts.join(people, "_key")
    mine = lambda s: s["speaker"] == F.col("perspective")
    lines = F.transform("said", lambda s: F.when(mine(s), s["own"]).otherwise(s["other"]))
    seen = seen.select("_key", "part", "perspective", lines.alias("lines"), F.transform("said", lambda s: F.when(mine(s), s["trained"]).otherwise(0)).alias("trained"))
    ends = F.transform("lines", lambda x, i: F.aggregate(F.slice("lines", 1, i + 1), F.lit(0), lambda n, y: n + F.char_length(y)))
    spans = F.filter(F.transform(F.arrays_zip(ends.alias("past"), F.col("trained")), lambda z: F.struct((z["past"] - z["trained"]).alias("first"), z["past"].alias("past"))), lambda z: z["first"] < z["past"])
    rendered = seen.select("_key", "perspective", "part", F.array_join("lines", "").alias("rendered"), spans.alias("mask"))
    # one short row per part meets in a window, not its text
    lengths = rendered.select("_key", "perspective", "part", F.char_length("rendered").cast("bigint").alias("_n"))
    before = Window.partitionBy("_key", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("_key", "perspective", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("start"))
    return rendered.join(starts, ["_key", "perspective", "part"]).select(F.col("_key.id").alias("dialogue_id"), "perspective", "part", "start", "rendered", "mask")
