"""Chat formatting: role order checked by a state machine, text segments with loss flags, reversible escapes.

Built-in DataFrame functions only. A declarative ``Template`` names each role's
label and whether its text is trained on; the machine's transitions say which role
may follow which. Control strings cannot occur inside a text, since the
characters they need are escaped there: backslash, ``<``, ``#`` and line ends stay readable
otherwise.

One conversation becomes one row, as a training sample is one row; nothing else
is gathered.

Defined results: a null text or role counts as empty; roles the template doesn't name are
formatted with their own escaped name, without loss, and make the order invalid; turns with
equal numbers are ordered by role, then text, and null numbers come first;
repeated rows are repeated turns; rows with a null conversation id form one conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Role -> (label, loss flag); role -> roles that may follow ("" is the start); closing string of a turn."""

    roles: dict[str, tuple[str, bool]] = field(default_factory=lambda: {
        "system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True)})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)
    head: str = "### "
    colon: str = ": "
    close: str = "</turn>\n"


TEMPLATE = Template()


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    # After an escape every backslash is followed by one of b, l, h; the backslash itself comes back last.
    out = F.replace(text, F.lit("\\h"), F.lit("#"))
    out = F.replace(out, F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _label(role: Column, t: Template) -> Column:
    out = None
    for name, (label, _) in t.roles.items():
        out = F.when(role == name, label) if out is None else out.when(role == name, label)
    return out.otherwise(F.concat(F.lit("\\r"), F.replace(escape(role), F.lit(":"), F.lit("\\c"))))


def _role(label: Column, t: Template) -> Column:
    out = None
    for name, (shown, _) in t.roles.items():
        out = F.when(label == shown, name) if out is None else out.when(label == shown, name)
    return out.otherwise(unescape(F.replace(F.substr(label, F.lit(3)), F.lit("\\c"), F.lit(":"))))


def format_chats(rows: DataFrame, conv="conv_id", turn="turn", role="role", text="text",
                 template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation: formatted string, segments (text, loss), valid turn order, first bad position."""
    t = template
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Escapes and labels are put on while rows are spread out; the group only sorts and joins.
    ready = rows.select(F.col(conv).alias("conv"), said.alias("s")).select(
        "conv", F.struct("s.turn", "s.role", "s.text",
                         F.concat(F.lit(t.head), _label(F.col("s.role"), t), F.lit(t.colon)).alias("head"),
                         escape(F.col("s.text")).alias("body")).alias("s"))
    chats = ready.groupBy("conv").agg(F.sort_array(F.collect_list("s")).alias("turns"))
    trained = [r for r, (_, loss) in t.roles.items() if loss]
    segments = F.flatten(F.transform("turns", lambda s: F.array(
        F.struct(s["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(s["body"].alias("text"), s["role"].isin(*trained).alias("loss")),
        F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")))))
    # The machine's state is the role before; a step is legal if the table lists it.
    legal = F.lit(False)
    steps = [f"{a}>{b}" for a, nexts in t.follows.items() for b in nexts]
    moves = F.transform("turns", lambda s, i: F.concat(
        F.when(i == 0, "").otherwise(F.get(F.col("turns.role"), i - 1)), F.lit(">"), s["role"]).isin(*steps))
    bad = F.array_position(moves, F.lit(False))
    ends = F.element_at(F.col("turns.role"), -1).isin(*t.last)
    return chats.select(
        F.col("conv").alias(conv), segments.alias("segments"), moves.alias("moves"),
        ((bad == 0) & ends).alias("valid_order"), F.when(bad > 0, bad - 1).alias("first_bad"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).drop("moves")


def read_chats(formatted: Column, template: Template = TEMPLATE) -> Column:
    """Array of (role, text) read back from a formatted string."""
    t = template
    pieces = F.split(formatted, t.close, -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(piece):
        head = F.substring_index(piece, t.colon, 1)
        body = F.substr(piece, F.length(head) + 1 + len(t.colon))
        return F.struct(_role(F.substr(head, F.lit(1 + len(t.head))), t).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, one)


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
