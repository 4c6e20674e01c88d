"""Chat formatting: logged conversations that a longer one continues are dropped before the rest is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a rendered turn is: the usual mark-up of role and text.
TURN = "concat('<|im_start|>', coalesce(t.role, ''), '\\n', coalesce(t.text, ''), '<|im_end|>\\n')"

#: A turn t with the last of the hashes of all before it; lengths part role from text, and null differs from empty.
STEP = """md5(concat(element_at(all, -1), ':', coalesce(concat(length(t.role), '=', t.role), '-'), ':',
               coalesce(concat(length(t.text), '=', t.text), '-')))"""

#: Turns of a block: a list of hashes is only ever added to within one, so that many turns take no square of steps.
BLOCK = 256


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (sorted by turn, then role and text; repeated rows once), prefixes (a hash for each turn, of
    all up to it)."""
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    # Each block's list begins with the last hash of the block before it.
    block = f"aggregate(slice(turns, int(b) * {BLOCK} + 1, {BLOCK}), array(element_at(element_at(done, -1), -1)), (all, t) -> concat(all, array({STEP})))"
    blocks = f"aggregate(sequence(0, (size(turns) - 1) div {BLOCK}), array(array('')), (done, b) -> concat(done, array({block})))"
    rolling = f"flatten(transform(slice({blocks}, 2, size(turns)), x -> slice(x, 2, {BLOCK})))"
    return whole.withColumn("prefixes", F.expr(rolling))


def maximal(convs: DataFrame) -> DataFrame:
    """conv_id, n_copies of the conversations that no other one continues; of equal ones the least id stays."""
    light = convs.select("conv_id", "prefixes", F.element_at("prefixes", -1).alias("full"))
    heads = light.groupBy("full").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("head"), F.count("*").alias("n_copies"))
    # A popular first turn opens many conversations: equal prefixes come together before the shuffle.
    proper = light.select(F.explode(F.expr("slice(prefixes, 1, size(prefixes) - 1)")).alias("full")).distinct()
    return heads.join(proper, "full", "left_anti").select(F.col("head.conv_id").alias("conv_id"), "n_copies")


def render(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies, text: each conversation that no other continues, rendered.

    One that is the beginning of a longer one goes, of equal ones the least id stays and n_copies counts them.
    Null role and text render as empty but differ from empty; turns with equal number go by role and text; rows
    without conv_id are one conversation; no rows give no rows. A conversation is a row of the result, and so fits
    in one. Other columns aren't read.
    """
    convs = conversations(turns, id_col, turn_col, role_col, text_col)
    kept = maximal(convs).select(F.col("conv_id").alias("kept"), "n_copies")
    text = f"array_join(transform(turns, t -> {TURN}), '')"
    rendered = convs.join(kept, F.col("conv_id").eqNullSafe(F.col("kept")))
    return rendered.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.expr(text).alias("text"))
