"""Indented JSON text of messages, piece by piece."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.text import json_quote


def message(m: Column, indent: int) -> Column:
    """Members of a message object, without its braces, one per line, indented by ``indent`` spaces."""
    pad = " " * indent
    reactions = F.transform(
        m["reactions"],
        lambda r: F.concat(
            F.lit(f'{pad}  {{\n{pad}    "emoji": '),
            json_quote(r["emoji"]),
            F.lit(f',\n{pad}    "count": '),
            r["count"].cast("string"),
            F.lit(f"\n{pad}  }}"),
        ),
    )
    attachments = F.transform(m["attachments"], lambda a: F.concat(F.lit(f"{pad}  "), json_quote(a)))
    members = [
        ("user", json_quote(m["user"])),
        ("text", json_quote(m["text"])),
        ("timestamp", json_quote(m["timestamp"])),
        ("datetime", json_quote(m["datetime"])),
        ("reactions", listing(reactions, pad)),
        ("is_bot", m["is_bot"].cast("string")),
        ("attachments", listing(attachments, pad)),
    ]
    return lines([F.concat(F.lit(f'{pad}"{name}": '), value) for name, value in members])


def listing(items: Column, pad: str) -> Column:
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit(f"\n{pad}]"))
    )


def lines(members: list[Column]) -> Column:
    return F.concat_ws(",\n", *members)
