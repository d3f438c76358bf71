"""Chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation again and again, each time with more turns. Every conversation gets rolling hashes of its
first 1, 2, ... turns; one whose whole hash is a proper prefix of a longer one is dropped by an anti join, of equal ones
the smallest id stays, and only the retained conversations are gathered and rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = ["turn", "role", "text"]


def _clean(turns: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.lower(F.trim(F.col("role").cast("string"))), F.lit("unknown"))
    return turns.where("conv_id is not null").select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, k1, k2, whole) for each prefix of each conversation; no text is gathered.

    The hash of a prefix rolls on from turn to turn: it is the exclusive or of the hashes of its turns, each of which takes in
    the turn's place, so one pass over the ordered turns gives the hashes of all prefixes.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = _clean(turns).select("conv_id", *TURN, F.row_number().over(order).cast("bigint").alias("n_turns"))
    one, two = F.xxhash64("n_turns", "role", "text"), F.xxhash64(F.lit("second"), "text", "n_turns", "role")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = [F.bit_xor(x).over(so_far).alias(k) for x, k in ((one, "k1"), (two, "k2"))]
    return placed.select("conv_id", "n_turns", *rolled, F.lead("n_turns").over(order).isNull().alias("whole"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that begin no longer one; of equal ones the smallest conv_id."""
    all_ = prefixes(turns)
    inner = all_.where("not whole").select("k1", "k2").distinct()
    ends = all_.where("whole").groupBy("k1", "k2", "n_turns").agg(F.min("conv_id").alias("conv_id"))
    return ends.join(inner, ["k1", "k2"], "left_anti").select("conv_id", "n_turns")


def escaped(text: Column) -> Column:
    r"""Text without ``<|``, so that it can't begin a marker: ``<\`` becomes ``<\\`` and ``<|`` becomes ``<\|``."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    r"""A role without a bare ``|``, so that it can't end its marker: ``\`` becomes ``\\`` and ``|`` becomes ``\|``."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def chat_format(turns: DataFrame) -> DataFrame:
    r"""(conv_id, n_turns, rendered): one row for each retained conversation.

    Takes conv_id, turn, role and text; other columns are ignored. Turns are ordered by turn (null first), then role and
    text; repeated rows are turns of their own. Roles are trimmed and lower-cased, a null role is ``unknown`` and a null text
    empty. Rows without conv_id belong to no conversation. Rendered: ``<|role|>``, a new line, the text and ``<|end|>`` with
    a new line for each turn; what looks like a marker in a text or role is escaped (``<|`` in a text becomes ``<\|``).
    A conversation has to fit a row.
    """
    kept = maximal(turns)
    rows = _clean(turns).join(kept, "conv_id")
    listed = rows.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct(*TURN))).alias("turns"))
    line = lambda t: F.concat(F.lit("<|"), escaped_role(t["role"]), F.lit("|>\n"), escaped(t["text"]), F.lit("\n<|end|>\n"))
    return listed.select("conv_id", "n_turns", F.array_join(F.transform("turns", line), "").alias("rendered"))
