"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example of its own: all earlier turns are its context and its reply
is the one span under the loss mask. A conversation that does not end with an assistant turn also
gives one example without a target, so that no turn is lost.

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n            per turn

Inside roles and texts a backslash is put behind the ``<`` of every ``<|``, ``<\\|``, ``<\\\\|`` and so
on, which leaves no ``<|`` there; taking one backslash away undoes it. A line feed in a role is
written ``<|nl|>``.

Turns are ordered by turn, role, text. Null role or text: empty. Null turn: before the others. Rows
that repeat are turns of their own. Rows without conv_id form one conversation with a null id. An
empty table gives no examples. Other columns are not read.

All turns of one conversation meet in one row, as its formatted text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE, TARGET_ROLE = "<|im_start|>", "<|im_end|>", "<|nl|>", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def examples(turns: DataFrame) -> DataFrame:
    """``conv_id, target, n_turns, formatted, loss_start, loss_end, is_last`` from ``conv_id, turn, role, text``.

    ``target`` is the place (from 1) of the reply among the turns, null without one; the mask covers
    the code points from ``loss_start`` up to ``loss_end`` of ``formatted``. ``is_last`` marks the
    example that holds the whole conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct("turn", role.alias("role"), text.alias("text"))
    rows = turns.select("conv_id", one.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    segments = F.transform("rows", lambda row: F.concat(F.lit(START), _escape_role(row["role"]), F.lit("\n"), escape(row["text"]), F.lit(END + "\n")))
    places = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda place: F.element_at("rows", place)["role"] == TARGET_ROLE)
    wanted = F.when(F.element_at("rows", -1)["role"] == TARGET_ROLE, places).otherwise(F.concat(places, F.array(F.size("rows"))))
    prepared = rows.select("conv_id", segments.alias("segments"), F.size("rows").alias("size"), F.element_at("rows", -1)["role"].alias("last_role"), F.explode(wanted).alias("place"))
    is_last = F.col("place") == F.col("size")
    without = is_last & (F.col("last_role") != TARGET_ROLE)
    formatted = F.array_join(F.slice("segments", F.lit(1), F.col("place")), "")
    shown = prepared.select("conv_id", "place", without.alias("without"), is_last.alias("is_last"), F.length(F.element_at("segments", F.col("place"))).alias("tail"), formatted.alias("formatted"))
    start = F.length("formatted") - F.col("tail") + len(START) + len(TARGET_ROLE) + 1
    return shown.select(
        "conv_id",
        F.when(~F.col("without"), F.col("place")).alias("target"),
        F.col("place").alias("n_turns"),
        "formatted",
        F.when(~F.col("without"), start).alias("loss_start"),
        F.when(~F.col("without"), F.length("formatted") - len(END) - 1).alias("loss_end"),
        "is_last",
    )


def loss_text() -> Column:
    """The unescaped text under the mask of an example; null without a target."""
    return unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as ``array<struct<role, text>>``."""
    pieces = F.filter(F.split(formatted, F.lit(r"<\|im_start\|>")), lambda piece: F.length(piece) > 0)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        body = F.substring(piece, cut + 1, F.length(piece) - cut - F.lit(len(END) + 1))
        return F.struct(_unescape_role(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def digests(expanded: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: what they say, what is trained on and how long they are."""
    spoken = F.array_join(F.transform(parse(F.max(F.when(F.col("is_last"), F.col("formatted")))), lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))), "")
    read = expanded.withColumn("loss", F.struct("target", loss_text().alias("text")))
    gathered = read.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        spoken.alias("spoken"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.col("loss")))), lambda loss: loss["text"]), "").alias("trained"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return gathered.select(
        "conv_id",
        "n_turns",
        F.sha2("spoken", 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
