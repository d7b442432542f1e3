"""Documents as ordered text files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palaver.functions.times import year_of
from palaver.plans import layout as lay
from palaver.plans.export import Export


def write_markdown(
    export: Export,
    path: str,
    split_by: str | None = None,
    template: str = "{channel}_{date}",
    date: str | None = None,
    title: str = "Export",
    mode: str = "overwrite",
) -> bool:
    """Markdown below ``path``; returns whether a document was written.

    Documents of the same name are replaced, others below ``path`` stay. The other writers do the same.
    """
    laid = lay.lay_out(export, split_by)
    return write_blocks(lay.markdown_blocks(export, laid, title), laid, path, template, date, ".md", mode)


def write_json(
    export: Export,
    path: str,
    split_by: str | None = None,
    template: str = "{channel}_{date}",
    date: str | None = None,
    mode: str = "overwrite",
) -> bool:
    """The nested JSON document(s), two spaces per level, non-ASCII kept."""
    laid = lay.lay_out(export, split_by)
    return write_blocks(lay.json_blocks(export, laid), laid, path, template, date, ".json", mode)


def write_html(
    export: Export,
    path: str,
    split_by: str | None = None,
    template: str = "{channel}_{date}",
    date: str | None = None,
    title: str = "Export",
    mode: str = "overwrite",
) -> bool:
    """A static page per document."""
    laid = lay.lay_out(export, split_by)
    return write_blocks(lay.html_blocks(export, laid, title), laid, path, template, date, ".html", mode)


def write_plain(
    export: Export,
    path: str,
    split_by: str | None = None,
    template: str = "{channel}_{date}",
    date: str | None = None,
    title: str = "Export",
    mode: str = "overwrite",
) -> bool:
    """Plain text, a line per message."""
    laid = lay.lay_out(export, split_by)
    return write_blocks(lay.plain_blocks(export, laid, title), laid, path, template, date, ".txt", mode)


def write_blocks(
    blocks: DataFrame, laid: lay.Layout, path: str, template: str, date: str | None, suffix: str, mode: str
) -> bool:
    """Write blocks as ``[year=Y/]stem=<file name>/part-*``.

    Blocks are range-partitioned by the whole sort key, so one large month or
    channel is cut into several tasks and part files; the parts of a stem by part
    number, one after the other, are the document. ``date`` is today by default; in a
    split export the month takes its place.
    """
    date = datetime.now().strftime("%Y%m%d") if date is None else date
    folders = ["year", "stem"]
    named = blocks.join(lay.stems(laid.documents, template, date, suffix), "month").withColumn(
        "year", year_of(F.col("month"))
    )
    if laid.split_by is None:
        folders = ["stem"]
        named = named.drop("year")
    order = [*folders, *lay.SORT_KEY]
    written = Observation()
    (
        named.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*folders, "text")
        .observe(written, F.count(F.lit(1)).alias("blocks"))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")  # of this write alone: other documents stay
        .partitionBy(*folders)
        .text(path)
    )
    return written.get["blocks"] > 0
