"""Markdown text of messages and threads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.text import html_escape

# The layout of the Markdown export.
DASH = " — "
BOT = " (bot)"
UNKNOWN_USER = "Unknown"
REACTIONS = "Reactions: "
ATTACHMENT = "> [Attachment] "
ATTACHMENT_CUT = 100
REPLY_INDENT = "> "
RULE = "---"
OTHER_HEADING = "### Other Messages"


def _user(m: Column) -> Column:
    return F.coalesce(m["user"], F.lit(UNKNOWN_USER))


def _text(m: Column) -> Column:
    return F.coalesce(m["text"], F.lit(""))


def message(m: Column, indent: str = "") -> Column:
    """Text block of a message struct: header, text lines, reactions, attachments, each closed by a blank line."""
    pad = F.lit(indent)
    header = F.concat(
        pad,
        F.lit("**"),
        _user(m),
        F.lit("**"),
        F.when(m["datetime"] != "", F.concat(F.lit(DASH), m["datetime"])).otherwise(""),
        F.when(m["is_bot"], F.lit(BOT)).otherwise(""),
    )
    body = F.replace(_text(m), F.lit("\n"), F.lit(f"\n{indent}")) if indent else _text(m)
    emojis = F.transform(
        m["reactions"], lambda r: F.concat(F.lit(":"), r["emoji"], F.lit(": ("), r["count"].cast("string"), F.lit(")"))
    )
    reacted = F.when(
        F.size(m["reactions"]) > 0, F.concat(F.lit(f"\n{indent}{REACTIONS}"), F.array_join(emojis, " "), F.lit("\n"))
    ).otherwise("")
    shown = F.transform(
        m["attachments"], lambda a: F.concat(F.lit(indent + ATTACHMENT), F.substring(a, 1, ATTACHMENT_CUT))
    )
    attached = F.when(
        F.size(m["attachments"]) > 0, F.concat(F.lit("\n"), F.array_join(shown, "\n"), F.lit("\n"))
    ).otherwise("")
    return F.concat(header, F.lit("\n\n"), pad, body, F.lit("\n"), reacted, attached)


def replies_line(count: Column) -> Column:
    """Heading above the replies of a thread, with the number found, not the declared one."""
    return F.concat(F.lit("  *"), count.cast("string"), F.lit(" replies:*\n"))


def thread(parent: Column, replies: Column) -> Column:
    """Text of a thread held in one row (a page of :func:`palaver.operators.threads.nest`)."""
    nested = F.when(
        F.size(replies) > 0,
        F.concat(
            F.lit("\n"),
            replies_line(F.size(replies)),
            F.lit("\n"),
            F.array_join(F.transform(replies, lambda r: message(r, REPLY_INDENT)), "\n"),
        ),
    ).otherwise("")
    return F.concat(message(parent), nested, F.lit(f"\n{RULE}\n"))


def html_message(m: Column) -> Column:
    """A message as HTML paragraphs."""
    emojis = F.transform(
        m["reactions"], lambda r: F.concat(F.lit(":"), r["emoji"], F.lit(": ("), r["count"].cast("string"), F.lit(")"))
    )
    files = F.transform(m["attachments"], lambda a: F.concat(F.lit("<li>"), html_escape(a), F.lit("</li>")))
    return F.concat(
        F.lit("<p><b>"),
        html_escape(_user(m)),
        F.lit("</b>"),
        F.when(m["datetime"] != "", F.concat(F.lit(DASH), html_escape(m["datetime"]))).otherwise(""),
        F.when(m["is_bot"], F.lit(BOT)).otherwise(""),
        F.lit("</p><p>"),
        F.replace(html_escape(_text(m)), F.lit("\n"), F.lit("<br>")),
        F.lit("</p>"),
        F.when(
            F.size(m["reactions"]) > 0,
            F.concat(F.lit(f"<p>{REACTIONS}"), html_escape(F.array_join(emojis, " ")), F.lit("</p>")),
        ).otherwise(""),
        F.when(
            F.size(m["attachments"]) > 0, F.concat(F.lit("<ul>"), F.array_join(files, ""), F.lit("</ul>"))
        ).otherwise(""),
    )


def plain_message(m: Column, indent: str = "") -> Column:
    """A message as ``user [time] (bot): text``, further lines indented."""
    return F.concat(
        F.lit(indent),
        _user(m),
        F.when(m["datetime"] != "", F.concat(F.lit(" ["), m["datetime"], F.lit("]"))).otherwise(""),
        F.when(m["is_bot"], F.lit(BOT)).otherwise(""),
        F.lit(": "),
        F.replace(_text(m), F.lit("\n"), F.lit(f"\n{indent}  ")),
    )
