"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a role and a list of parts (text, image, audio, document). The visitor has one
method per type, each a column expression; parts become text or placeholders in order, and each
attachment is recorded with its reference, its place and its number of expanded tokens.

Template: <|im_start|>ROLE<|im_sep|>CONTENT<|im_end|>, turn after turn. Inside roles and texts a
backslash is doubled, and one is put behind the first character of whatever could open a control
string (of this or another common template): <|, <s>, </s>, [INST], [/INST], also where it begins at
the end of a part and would end in the next. So no control string is left in what users wrote, and dropping the escapes
gives it back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: First characters of control strings, with what must follow; and those that end a part with the rest still to come.
OPENERS = r"<(?=\||/?s>)|\[(?=/?INST\])"
LAST_OPENERS = r"<(?=/?s?\z)|\[(?=/?(?:I(?:N(?:ST?)?)?)?\z)"
PART = "type string, text string, ref string, width int, height int, duration_ms bigint, n_pages int"
MESSAGE = f"array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, OPENERS, r"$0\\")


def unescape(text: Column) -> Column:
    """Undoes escape(): each backslash goes and what follows it stays. Texts without one pass as they are."""
    first = F.regexp_replace(text, r"(?s)\\(.)", "$1")
    return F.when(F.contains(text, F.lit("\\")), first).otherwise(text)


class PartVisitor:
    """Turns parts into struct<rendered, ref, kind, tokens>. Add a method visit_<type> for a new type."""

    def __init__(self, patch: int = 14, audio_tokens_per_s: int = 25, tokens_per_page: int = 512):
        self.patch, self.audio_tokens_per_s, self.tokens_per_page = patch, audio_tokens_per_s, tokens_per_page

    @staticmethod
    def _made(rendered: Column, ref: Column, kind: Column, tokens: Column) -> Column:
        return F.struct(rendered.alias("rendered"), ref.cast("string").alias("ref"), kind.cast("string").alias("kind"), tokens.cast("long").alias("tokens"))

    def visit_text(self, part: Column) -> Column:
        return self._made(escape(F.coalesce(part["text"], F.lit(""))), F.lit(None), F.lit(None), F.lit(0))

    def _attached(self, part: Column, kind: str, tokens: Column) -> Column:
        return self._made(F.lit(f"<|{kind}|>"), F.coalesce(part["ref"], F.lit("")), F.lit(kind), F.coalesce(tokens, F.lit(0)))

    def visit_image(self, part: Column) -> Column:
        return self._attached(part, "image", F.ceil(part["width"] / self.patch) * F.ceil(part["height"] / self.patch))

    def visit_audio(self, part: Column) -> Column:
        return self._attached(part, "audio", F.ceil(part["duration_ms"] * self.audio_tokens_per_s / 1000))

    def visit_document(self, part: Column) -> Column:
        return self._attached(part, "document", part["n_pages"] * self.tokens_per_page)

    def visit(self, part: Column) -> Column:
        """Null parts and unknown types count as texts."""
        out = None
        for kind in sorted(name[6:] for name in dir(self) if name.startswith("visit_") and name != "visit_text"):
            out = (F if out is None else out).when(part["type"] == kind, getattr(self, f"visit_{kind}")(part))
        return out.otherwise(self.visit_text(part))


def text_message(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in PART.split(", ")[2:])))).cast(MESSAGE)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant", visitor: PartVisitor | None = None) -> DataFrame:
    """One row per conversation: conv_col, n_turns, formatted, loss_mask, attachments, n_expanded_tokens.

    loss_mask: for each turn (start, length) in code points of the turn's block, which begins with its
    control string: the content of turns of loss_role; null for other turns. attachments: array of (turn, part, kind, ref, tokens) in order.
    Turns are ordered by turn, then role, then content; null turns come first; null roles and texts are
    empty; messages without parts have empty content; repeated rows are repeated turns; null conversation
    ids form one conversation; an empty table gives an empty table; other columns are not read. Texts are
    escaped and rendered before rows move, and one shuffle brings a conversation together, which must fit
    a task as it is one row of the result."""
    visit = (visitor or PartVisitor()).visit
    role = F.coalesce(F.col(role_col), F.lit(""))
    seen = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.transform(F.coalesce(F.col(parts_col), F.array().cast(MESSAGE)), visit).alias("seen"))
    attached = F.filter(F.transform("seen", lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))), lambda a: a["kind"].isNotNull())
    # no control string may come about where two parts meet
    closed = F.transform("seen", lambda p, i: F.when(p["kind"].isNull() & (i < F.size("seen") - 1), F.regexp_replace(p["rendered"], LAST_OPENERS, r"$0\\")).otherwise(p["rendered"]))
    content = F.array_join(closed, "")
    header = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SEP))
    rows = seen.select(
        "conv",
        F.struct("turn", "role", content.alias("content"), header.alias("header"), attached.alias("attached")).alias("t"),
    )
    told = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    mask = F.transform("turns", lambda t: F.when(t["role"] == loss_role, F.struct(F.length(t["header"]).alias("start"), F.length(t["content"]).alias("length"))))
    spread = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return told.select(
        F.col("conv").alias(conv_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["header"], t["content"], F.lit(END))), "").alias("formatted"),
        mask.alias("loss_mask"),
        spread.alias("attachments"),
    ).withColumn("n_expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read from a formatted conversation; placeholders stay as they are."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b, i: i > 0)
    return F.transform(blocks, lambda b: F.struct(
        unescape(F.substring_index(b, SEP, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(b, SEP, -1), END, 1)).alias("text"),
    ))


def read_masked(formatted: Column, mask: Column) -> Column:
    """array<string>: what a loss mask covers, unescaped, in order."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b, i: i > 0)
    parts = F.zip_with(blocks, mask, lambda b, m: unescape(F.substr(F.concat(F.lit(TURN), b), m["start"] + 1, m["length"])))
    return F.filter(parts, lambda p: p.isNotNull())
