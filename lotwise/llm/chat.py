"""Chat formatting: typed content parts become one marked string with a loss mask.

A visitor flattens the parts of every turn in order. Text is escaped and kept; images, audio and
documents become placeholders, and their references and expanded token counts are recorded beside
the text. Control strings inside texts and roles are escaped reversibly, so a formatted
conversation can always be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
START, SEP, END, JOINT = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|part|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER_PLACEHOLDER = "<|attachment|>"

#: Turns whose numbers share this quotient are gathered first, so a long conversation is put together from short pieces.
TURNS_PER_PIECE = 64


def escape(text: Column) -> Column:
    r"""Adds one backslash to every ``<``, backslashes, ``|`` run; nothing that looks like a mark is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Takes the backslash of :func:`escape` away again."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def text_part(text: Column) -> Column:
    """A part that holds text only."""
    return F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("width"),
        F.lit(None).cast("bigint").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("bigint").alias("pages"),
    )


def _is_text(part: Column) -> Column:
    return part.isNull() | F.coalesce(part["kind"] == "text", F.lit(True))


def _placeholder(kind: Column) -> Column:
    chosen = F.lit(OTHER_PLACEHOLDER)
    for name, mark in PLACEHOLDERS.items():
        chosen = F.when(kind == name, F.lit(mark)).otherwise(chosen)
    return chosen


def _expanded(part: Column, patch: int, default_side: int, tokens_per_second: float, tokens_per_page: int) -> Column:
    def side(length: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(length, F.lit(default_side)), F.lit(0)) / F.lit(patch))

    return (
        F.when(part["kind"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * F.lit(tokens_per_second)))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(0)) * F.lit(tokens_per_page))
        .otherwise(F.lit(1))
        .cast("bigint")
    )


def format_turns(
    turns: DataFrame,
    loss_roles: tuple[str, ...] = ("assistant",),
    patch: int = 28,
    default_side: int = 448,
    tokens_per_second: float = 25.0,
    tokens_per_page: int = 512,
) -> DataFrame:
    """One row per turn: the formatted block, where the loss applies in it, and its attachments.

    ``turns`` has conv_id, turn, role and ``parts``: an array of structs with kind, text, ref, width,
    height, seconds and pages. The block is START role SEP content END. ``loss_start`` and
    ``loss_length`` count code points from the start of the block; the length is 0 outside
    ``loss_roles``. ``attachments`` keeps order, kind, ref and expanded tokens of every placeholder.

    A null role or text is empty, a null or empty ``parts`` an empty text, a null part or kind a text
    part; unknown kinds become a general placeholder of one token. Neighbouring text parts are set apart
    by a mark of their own. Repeated rows stay repeated; extra columns are not read; no rows give none.
    """

    def visit(part: Column, i: Column) -> Column:
        follows_text = (i > 0) & _is_text(F.get(F.col("parts"), i - 1))
        joint = F.when(follows_text, F.lit(JOINT)).otherwise(F.lit(""))
        return F.when(_is_text(part), F.concat(joint, escape(F.coalesce(part["text"], F.lit(""))))).otherwise(_placeholder(part["kind"]))

    def attachment(part: Column, i: Column) -> Column:
        tokens = _expanded(part, patch, default_side, tokens_per_second, tokens_per_page)
        return F.struct(i.alias("position"), part["kind"].alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"), _is_text(part).alias("is_text"))

    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), escape(role), F.lit(SEP))
    parts = F.coalesce(F.col("parts"), F.expr("filter(parts, p -> false)"))
    content = F.coalesce(F.concat_ws("", F.transform(parts, visit)), F.lit(""))
    kept = F.filter(F.transform(parts, attachment), lambda a: ~a["is_text"])
    attachments = F.coalesce(F.transform(kept, lambda a: F.struct(a["position"], a["kind"], a["ref"], a["tokens"])), F.array().cast("array<struct<position:int,kind:string,ref:string,tokens:bigint>>"))
    return (
        turns.select("conv_id", "turn", head.alias("head"), content.alias("content"), role.isin(*loss_roles).alias("in_loss"), attachments.alias("attachments"))
        .select(
            "conv_id", "turn", F.concat("head", "content", F.lit(END)).alias("formatted"),
            F.char_length("head").cast("bigint").alias("loss_start"), F.when(F.col("in_loss"), F.char_length("content")).otherwise(0).cast("bigint").alias("loss_length"),
            "attachments", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
        )
    )


def _gathered(formatted_turns: DataFrame) -> DataFrame:
    """Pieces of a conversation: its blocks in order of turn, then of text."""
    piece = F.floor(F.col("turn") / TURNS_PER_PIECE)
    rows = F.sort_array(F.collect_list(F.struct("turn", "formatted", "loss_start", "loss_length", "attachments", "expanded_tokens")))
    return formatted_turns.groupBy("conv_id", piece.alias("piece")).agg(rows.alias("rows"))


def assemble(formatted_turns: DataFrame) -> DataFrame:
    """One row per conversation: text, loss mask, attachments and expanded tokens.

    Blocks stand in order of turn (null first), equal turns in order of their blocks. ``loss_mask``
    has one (start, length) per turn, counted in its block. A conversation's text is one value, so
    its size is bounded by what a row may hold; pieces of neighbouring turns are put together first.
    """
    pieces = _gathered(formatted_turns).select(
        "conv_id", "piece", F.concat_ws("", "rows.formatted").alias("formatted"), F.size("rows").cast("bigint").alias("n_turns"),
        F.transform("rows", lambda r: F.struct(r["loss_start"].alias("start"), r["loss_length"].alias("length"))).alias("loss_mask"),
        F.flatten("rows.attachments").alias("attachments"), F.aggregate("rows.expanded_tokens", F.lit(0).cast("bigint"), lambda s, n: s + n).alias("expanded_tokens"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("piece", "formatted", "loss_mask", "attachments")))
    return (
        pieces.groupBy("conv_id")
        .agg(ordered.alias("pieces"), F.sum("n_turns").alias("n_turns"), F.sum("expanded_tokens").alias("expanded_tokens"))
        .select(
            "conv_id", "n_turns", F.concat_ws("", "pieces.formatted").alias("formatted"), F.flatten("pieces.loss_mask").alias("loss_mask"),
            F.flatten("pieces.attachments").alias("attachments"), "expanded_tokens",
        )
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Parses formatted conversations: role and text of every turn, and the text under the loss mask.

    Returns conv_id, ``turns`` (array of role, text, loss_text; placeholders and part marks stay in
    the text) and formatted. Linear in the text: a block is cut out once.
    """
    blocks = F.slice(F.split("formatted", F.lit(START.replace("|", r"\|"))), 2, F.size("loss_mask"))

    def parsed(block: Column, mask: Column) -> Column:
        content = F.split_part(F.split_part(block, F.lit(SEP), F.lit(2)), F.lit(END), F.lit(1))
        under = F.substring(block, mask["start"].cast("int") - len(START) + 1, mask["length"].cast("int"))
        return F.struct(
            unescape(F.split_part(block, F.lit(SEP), F.lit(1))).alias("role"), unescape(content).alias("text"),
            F.when(mask["length"] > 0, unescape(under)).otherwise(F.lit("")).alias("loss_text"),
        )

    return conversations.withColumn("turns", F.zip_with(blocks, F.col("loss_mask"), parsed))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """Digests of what :func:`read_back` finds in each conversation."""
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    under = F.concat_ws("", "turns.loss_text")
    return (
        read_back(conversations)
        .select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), said.alias("said"), under.alias("under"), F.char_length("formatted").cast("bigint").alias("formatted_chars"), F.size("attachments").cast("bigint").alias("n_attachments"), "expanded_tokens")
        .select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("under").cast("bigint").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), "formatted_chars", "n_attachments", "expanded_tokens")
    )
