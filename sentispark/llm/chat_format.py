"""Chat formatting with DataFrame functions only.

A template declares the mark that opens a turn, the one that closes it and the roles whose text is learned.
Control strings begin with characters that are escaped wherever a text or role holds them, so a text can
never open or close a turn and unescaping gives it back.

The order of roles is checked by a finite-state machine, a table (state, role) -> state folded over
the turns; a conversation that leaves it is formatted all the same and marked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``opening`` has one ``{role}``; both marks consist of control strings and plain text."""

    opening: str = "### {role}: "
    closing: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    #: Characters that begin control strings, and the letters that stand for them after a backslash.
    escapes: dict[str, str] = field(default_factory=lambda: {"#": "h", "<": "l", ":": "c"})
    #: (state, role) -> state; the machine starts in ``start`` and may end in ``final``.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    start: str = "start"
    final: tuple[str, ...] = ("assistant", "user")

    def __post_init__(self):
        before, after = self.opening.split("{role}")
        if not before or before[0] not in self.escapes or after[:1] not in self.escapes or self.closing[:1] not in self.escapes:
            raise ValueError("every control string must begin with an escaped character")


def escaped(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for character, letter in template.escapes.items():
        out = F.replace(out, F.lit(character), F.lit("\\" + letter))
    return out


def unescaped(text: Column, template: Template) -> Column:
    # Every backslash begins an escape; the one of the backslash itself is undone last.
    out = text
    for character, letter in template.escapes.items():
        out = F.replace(out, F.lit("\\" + letter), F.lit(character))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _final_state(roles: Column, template: Template) -> Column:
    """State after the last turn; null once a move is not in the table."""
    table = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\0{role}", to)])
    step = lambda state, role: F.try_element_at(table, F.concat(state, F.lit("\0"), role))
    return F.aggregate(roles, F.lit(template.start), step)


def format_chats(
    turns: DataFrame, template: Template, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(id, valid, segments, formatted) of every conversation.

    ``segments``: array of (text, loss) whose texts, joined, are ``formatted``; loss is true for the escaped
    text of a turn by a learned role and false for marks and other turns. Null texts and roles are
    empty. Turns are ordered by number (null first), then role, then text; repeated rows stay. Rows without
    a conversation are left out. A conversation is one row, so it has to fit a task.
    """
    rows = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("row"),
    )
    grouped = rows.groupBy("id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    before, after = template.opening.split("{role}")

    def segments_of(row: Column) -> Column:
        mark = F.concat(F.lit(before), escaped(row["role"], template), F.lit(after))
        segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        return F.array(
            segment(mark, F.lit(False)),
            segment(escaped(row["text"], template), row["role"].isin(*template.learned)),
            segment(F.lit(template.closing), F.lit(False)),
        )

    state = _final_state(F.transform("rows", lambda r: r["role"]), template)
    laid = grouped.select(
        "id",
        F.coalesce(state.isin(*template.final), F.lit(False)).alias("valid"),
        F.flatten(F.transform("rows", segments_of)).alias("segments"),
    )
    return laid.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template) -> DataFrame:
    """Add ``turns`` (array of role, text), read from ``formatted``, and ``learned``, the unescaped text under the loss flags."""
    before, after = template.opening.split("{role}")

    def turn_of(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(before) + 1))
        at = F.locate(after, body)
        return F.struct(
            unescaped(F.substr(body, F.lit(1), at - 1), template).alias("role"),
            unescaped(F.substr(body, at + F.lit(len(after))), template).alias("text"),
        )

    # The text after the last closing mark is empty.
    pieces = F.split(F.col("formatted"), "\\Q" + template.closing + "\\E")
    flagged = F.filter("segments", lambda s: s["loss"])
    return formatted.withColumns(
        {
            "turns": F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn_of),
            "learned": F.array_join(F.transform(flagged, lambda s: unescaped(s["text"], template)), ""),
        }
    )
