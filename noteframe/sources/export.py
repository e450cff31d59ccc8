"""Notes as files: plain text and HTML, one partition a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.functions import text as T
from noteframe.operators.library import display_body


def export_text() -> Column:
    return T.plain_lines(display_body())


def export_page(font: str = "Georgia", spacing: str = "1.75") -> Column:
    """A fixed page around title and body."""
    title, heading = F.coalesce(T.first_filled("title"), F.lit("Note")), F.coalesce(T.first_filled("title"), F.lit("Untitled Note"))
    return F.concat(
        F.lit("<!DOCTYPE html>\n<html>\n<head>\n  <title>"), title,
        F.lit(f"</title>\n  <style>\n    body {{ font-family: {font}, serif; max-width: 800px; margin: 40px auto; padding: 20px; line-height: {spacing}; }}\n    h1 {{ color: #5D4037; }}\n  </style>\n</head>\n<body>\n  <h1>"),
        heading, F.lit("</h1>\n  <div>"), display_body(), F.lit("</div>\n</body>\n</html>"),
    )


def named(notes: DataFrame, content: Column) -> DataFrame:
    return notes.select(F.col("id").alias("note_id"), F.coalesce(T.first_filled("title"), F.lit("note")).alias("name"), content.alias("value"))


def export_txt(notes: DataFrame, path: str) -> None:
    named(notes, export_text()).drop("name").write.partitionBy("note_id").text(path)


def export_html(notes: DataFrame, path: str) -> None:
    named(notes, export_page()).drop("name").write.partitionBy("note_id").text(path)
