"""From the regions of a page to its HTML: cleaning, order, bands, columns, assembly.

Elements are rows: page_id, ord (place in the page's list), type, content, container, region, x_percent, y_percent,
width_percent, height_percent, shape, and optionally children, is_bold, is_large, description, labels. All windows and
groups are by page, which holds few elements, so one exchange by page_id serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.functions import text as T

OPTIONAL = {"children": "array<string>", "is_bold": "boolean", "is_large": "boolean", "description": "string", "labels": "array<string>"}
#: What marks an element as a date or page number, in lower case.
METADATA = r"\bdate\b|\bpage\b|\bpg\b|\bpage\s*[0-9]+\b|^[0-9]+\s*(/|of)\s*[0-9]+$|^[0-9]+$|\b[0-9]{1,2}[-/][0-9]{1,2}([-/][0-9]{2,4})?\b"
#: Styles of the HTML.
BOX = "border: 2px solid #5D4037; border-radius: 4px; padding: 12px 16px; background: #fff; margin: 10px 0; display: inline-block; max-width: 100%;"
CIRCLED = "border: 2px solid #FF9800; border-radius: 50px; padding: 4px 16px; display: inline-block; margin: 6px 0;"
UNDERLINED = "border-bottom: 2px solid #FF9800; padding-bottom: 3px;"
HEADER = "color: #FF9800; margin: 20px 0 10px; text-transform: uppercase; letter-spacing: 0.06em;"
BULLET = '<div style="display:flex;gap:10px;margin-bottom:6px;line-height:1.75;"><span style="color:#FF9800;font-weight:bold;flex-shrink:0;">◆</span><span>'
KEY = "color:#FF9800;font-weight:bold;text-transform:uppercase;letter-spacing:0.05em;"
DIAGRAM = "border:2px dashed #FFB74D;border-radius:8px;padding:16px;margin:12px 0;background:#FFF8E1;font-style:italic;color:#5D4037;"
LABELS = "margin-top:6px;color:#FF9800;font-size:0.9em;"
#: Stands for the content in a template; no template holds it otherwise.
MARK = "\u0001"
META_BLOCK = '<div style="text-align:right;margin:4px 0 10px;opacity:0.92;">'
GRID_THREE = '<div style="display:grid;grid-template-columns:1fr 2fr 1fr;gap:16px;margin:12px 0;align-items:start;"><div>'


def complete(elements: DataFrame) -> DataFrame:
    """The optional columns as nulls where a table lacks them."""
    return elements.withColumns({c: F.lit(None).cast(k) for c, k in OPTIONAL.items() if c not in elements.columns})


def y_of() -> Column:
    return F.coalesce(F.col("y_percent"), F.lit(0.0))


def x_of() -> Column:
    return F.coalesce(F.col("x_percent"), F.lit(0.0))


def region_of() -> Column:
    return T.filled("region")


def is_diagram() -> Column:
    return T.filled("type") == "diagram"


# order


def reading_order(elements: DataFrame) -> DataFrame:
    """Add `ord`: by y, then x, then place in the list; missing coordinates count as 0. The old place stays as `listed`."""
    order = W.partitionBy("page_id").orderBy(y_of(), x_of(), "ord")
    return elements.withColumn("_new", F.row_number().over(order) - 1).withColumnsRenamed({"ord": "listed", "_new": "ord"})


def first_phrase_position(raw: Column, content: Column) -> Column:
    """Where the first five words of the content stand in the transcript, else the first four, ... one; from 1; null if nowhere."""
    words = F.filter(F.split(F.lower(content), r"\s+"), lambda w: w != "")
    tries = [F.when(F.size(words) >= n, F.nullif(F.instr(F.lower(raw), F.array_join(F.slice(words, 1, n), " ")), F.lit(0))) for n in (5, 4, 3, 2, 1)]
    return F.coalesce(*tries)


def raw_text_order(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """On single-column pages that have a transcript, order by where it holds an element's first words; unmatched last, stable."""
    known = pages.select("page_id", F.col("page_layout").alias("_layout"), T.trim_ws("raw_text").alias("_raw"))
    rows = complete(elements).join(known, "page_id", "left")
    content = F.coalesce(T.first_filled("content"), F.try_element_at("children", F.lit(1)), F.lit(""))
    at = F.when((F.col("_layout") == "single_column") & (F.col("_raw") != ""), first_phrase_position(F.col("_raw"), content))
    order = W.partitionBy("page_id").orderBy(F.col("_at").asc_nulls_last(), "ord")
    rows = rows.withColumn("_at", at).withColumn("_new", F.row_number().over(order) - 1)
    return rows.drop("_layout", "_raw", "_at", "ord").withColumnRenamed("_new", "ord")


# cleaning


def drop_connector_shapes(elements: DataFrame) -> DataFrame:
    """Without triangles, arrows and shapeless diagrams that lie within 20 by 25 of a box: an anti join by page with a range."""
    boxes = elements.where((T.filled("container") == "box") & ~is_diagram()).select(F.col("page_id").alias("_page"), x_of().alias("_x"), y_of().alias("_y"))
    connector = is_diagram() & F.coalesce("shape", F.lit("none")).isin("triangle", "arrow", "none")
    near = (F.col("page_id") == F.col("_page")) & connector & (F.abs(x_of() - F.col("_x")) < 20) & (F.abs(y_of() - F.col("_y")) < 25)
    return elements.join(boxes, near, "left_anti")


def drop_duplicate_region_diagrams(elements: DataFrame) -> DataFrame:
    """Without diagrams in whose region something else stands too; a missing region is a region."""
    taken = elements.where(~is_diagram()).select(F.col("page_id").alias("_page"), region_of().alias("_region")).distinct()
    same = (F.col("page_id") == F.col("_page")) & (region_of() == F.col("_region")) & is_diagram()
    return elements.join(taken, same, "left_anti")


def clean_elements(elements: DataFrame) -> DataFrame:
    """Both rules judge the page as it came: what one drops still counts for the other."""
    keys = ["page_id", "ord"]
    kept = drop_connector_shapes(elements).select(*keys)
    return drop_duplicate_region_diagrams(elements).join(kept, keys, "left_semi")


# element text and HTML


def described(elements: DataFrame) -> DataFrame:
    """The elements with `_words` and `_meta`, computed once for all that need them."""
    return complete(elements).withColumns({"_words": element_word_count(), "_meta": is_metadata_element()})


def element_text() -> Column:
    children = F.filter(F.transform(F.coalesce("children", F.array().cast("array<string>")), T.clean_ws), lambda x: x != "")
    content = T.clean_ws("content")
    return F.when(content != "", content).otherwise(F.array_join(children, " "))


def element_word_count() -> Column:
    return T.word_count(element_text())


def is_metadata_element() -> Column:
    """Dates and page numbers, or up to three words in a narrow region at the top right; an element without text is neither."""
    text = element_text()
    corner = F.contains(region_of(), F.lit("right")) & (F.coalesce("y_percent", F.lit(100.0)) <= 22) & (F.coalesce("width_percent", F.lit(100.0)) <= 18) & (element_word_count() <= 3)
    return (text != "") & (F.lower(text).rlike(METADATA) | corner)


def key_value_split(c: Column) -> Column:
    return F.split(c, ":", 2)


def _div(style: Column | str, inner: Column) -> Column:
    return F.concat(F.lit('<div style="'), F.lit(style) if isinstance(style, str) else style, F.lit('">'), inner, F.lit("</div>"))


def element_to_html(escape: bool = False) -> Column:
    """An element's HTML by its type, container and style. Texts stand as they are unless `escape` is set."""
    safe = T.escape_html if escape else (lambda c: c)
    # every template holds the content once; a mark stands for it until the template is chosen
    text, container = safe(T.clean_ws("content")), F.coalesce("container", F.lit("none"))
    content = F.lit(MARK)
    box, circled, underlined = container == "box", container == "circled", container == "underlined"
    size = F.when(F.coalesce("is_large", F.lit(False)), "1.5em").otherwise("1.2em")
    base = F.concat(F.lit("font-size: "), size, F.lit(f"; {HEADER}"))
    h2 = lambda more: F.concat(F.lit('<h2 style="'), base, F.lit(f'{more}">'), content, F.lit("</h2>"))
    header = F.when(box, _div(BOX, h2(" margin:0;"))).when(circled, _div(CIRCLED, h2(" margin:0;"))).when(underlined, h2(f" {UNDERLINED}")).otherwise(h2(""))
    items = F.transform(F.coalesce("children", F.array().cast("array<string>")), lambda c: F.concat(F.lit(BULLET), safe(T.clean_ws(c)), F.lit("</span></div>")))
    bullets = F.array_join(items, "")
    bullet_list = F.when(box, _div(BOX, bullets)).when(circled, _div(CIRCLED, bullets)).otherwise(_div("margin:12px 0;", bullets))
    parts = key_value_split(text)
    pair = F.concat(F.lit(f'<span style="{KEY}">'), parts[0], F.lit(":</span> "), F.get(parts, F.lit(1)))
    inner = F.when(F.size(parts) == 2, pair).otherwise(text)
    key_value = F.when(box, _div(BOX, inner)).otherwise(_div("margin:8px 0;line-height:1.75;", inner))
    labels = F.array_join(F.transform("labels", lambda c: safe(T.clean_ws(c))), ", ")
    labelled = F.when(F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0, _div(LABELS, F.concat(F.lit("Labels: "), labels))).otherwise("")
    described = F.when(F.col("description").isNotNull(), safe(T.clean_ws("description"))).otherwise(text)
    diagram = _div(DIAGRAM, F.concat(F.lit("📊 "), described, labelled))
    weight = F.when(F.coalesce("is_bold", F.lit(False)), "bold").otherwise("normal")
    framed = lambda css: _div(F.concat(F.lit(f"{css} font-weight:"), weight, F.lit(";line-height:1.75;")), content)
    p = lambda more: F.concat(F.lit('<p style="margin:10px 0;line-height:1.75;font-weight:'), weight, F.lit(f';{more}">'), content, F.lit("</p>"))
    other = F.when(box, framed(BOX)).when(circled, framed(CIRCLED)).when(underlined, p(UNDERLINED)).otherwise(p(""))
    kind = T.filled("type")
    chosen = F.when(kind == "header", header).otherwise(other)
    filled = F.concat(F.substring_index(chosen, MARK, 1), text, F.substring_index(chosen, MARK, -1))
    return F.when(kind == "bullet_list", bullet_list).when(kind == "key_value", key_value).when(kind == "diagram", diagram).otherwise(filled)


# bands


def assign_bands(elements: DataFrame) -> DataFrame:
    """Add `band`, from 0: in order, an element that starts 5 or more below the lowest edge so far opens the next band.

    The lowest edge of all earlier elements is that of the current band, as a band opens only below all of them.
    """
    order = W.partitionBy("page_id").orderBy("ord")
    edge = F.max(y_of() + F.coalesce("height_percent", F.lit(5.0))).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(y_of() >= edge + 5, 1).otherwise(0)
    return elements.withColumn("_opens", opens).withColumn("band", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")).drop("_opens")


def _sides() -> tuple[Column, Column]:
    return F.contains(region_of(), F.lit("left")), F.contains(region_of(), F.lit("right"))


def _sided(banded: DataFrame) -> DataFrame:
    left, right = _sides()
    rows = banded if "_meta" in banded.columns else described(banded)
    return rows.withColumns({"_left": left, "_right": right})


def _band_aggregates() -> list[Column]:
    words = lambda side: F.coalesce(F.sum(F.when(F.col(side) & ~F.col("_meta"), F.col("_words"))), F.lit(0))
    return [
        F.count(F.lit(1)).alias("elements"),
        F.count_if("_left").alias("left_elements"),
        F.count_if("_right").alias("right_elements"),
        F.count_if(F.col("_left") & ~F.col("_meta")).alias("left_content"),
        F.count_if(F.col("_right") & ~F.col("_meta")).alias("right_content"),
        words("_left").alias("left_words"),
        words("_right").alias("right_words"),
        (F.max(y_of()) - F.min(y_of())).alias("y_span"),
        F.count_if(~F.col("_left") & ~F.col("_right")).alias("centre_elements"),
        F.min(F.when(F.col("_left"), F.coalesce("x_percent", F.lit(0.0)))).alias("left_x"),
        F.min(F.when(F.col("_right"), F.coalesce("x_percent", F.lit(50.0)))).alias("right_x"),
    ]


def band_stats(banded: DataFrame) -> DataFrame:
    """Per band: elements, words and elements left and right without metadata, span of y, elements at neither side, least x."""
    return _sided(banded).groupBy("page_id", "band").agg(*_band_aggregates())


def should_render_as_columns(layout: Column) -> Column:
    """Of a band's statistics: whether its sides stand beside each other."""
    both = (F.col("left_content") > 0) & (F.col("right_content") > 0) & (F.col("elements") > 1)
    least = F.least("left_words", "right_words")
    single = (least >= 6) & (F.col("y_span") <= 10) & (F.col("centre_elements") <= 1)
    return both & F.when(layout == "single_column", single).otherwise((least >= 4) & (F.col("y_span") <= 14))


# assembly


def build_page_html(elements: DataFrame, pages: DataFrame, escape: bool = False) -> DataFrame:
    """page_id and html of every page that has elements, which come in their final order `ord`.

    A band's elements and what decides about its columns come out of one aggregate; bands, and then pages, are put together
    where the windows by page left them, so the elements cross the network once.
    """
    rows = _sided(assign_bands(described(elements)))
    item = F.struct("ord", element_to_html(escape).alias("html"), F.col("_meta").alias("meta"), F.col("_left").alias("left"), F.col("_right").alias("right"), y_of().alias("y"), (T.filled("type") == "header").alias("header"))
    bands = rows.groupBy("page_id", "band").agg(F.array_sort(F.collect_list(item)).alias("items"), *_band_aggregates())
    layout = pages.select("page_id", F.coalesce("page_layout", F.lit("unknown")).alias("page_layout"))
    bands = bands.join(layout, "page_id", "left").withColumn("columns", F.coalesce(should_render_as_columns(F.col("page_layout")), F.lit(False)))
    joined = lambda c: F.array_join(F.transform(c, lambda e: e["html"]), "")
    side = lambda keep: joined(F.filter("items", keep))
    middle = F.transform(F.filter("items", lambda e: ~e["left"] & ~e["right"]), lambda e: F.struct(e["y"].alias("y"), e["ord"].alias("ord"), e["html"].alias("html")))
    bands = bands.withColumns({"meta": F.filter("items", lambda e: e["meta"]), "content": F.filter("items", lambda e: ~e["meta"])})
    bands = bands.withColumns(
        {
            "block": F.when(F.size("meta") > 0, F.concat(F.lit(META_BLOCK), joined("meta"), F.lit("</div>"))).otherwise(""),
            "head": F.get("content", F.lit(0)),
            "lefts": F.when(F.col("columns"), side(lambda e: e["left"])),
            "rights": F.when(F.col("columns"), side(lambda e: e["right"])),
            "centre": F.when(F.col("columns"), joined(F.array_sort(middle))),
            "widths": T.grid_fractions(F.col("left_x"), F.col("right_x")),
        }
    )
    headed = (F.size("meta") > 0) & F.coalesce(F.col("head.header"), F.lit(False))
    linear = F.when(headed, F.concat("head.html", "block", joined(F.slice("content", 2, F.size("content") + 1)))).otherwise(F.concat("block", joined("content")))
    three = F.concat(F.lit(GRID_THREE), "lefts", F.lit('</div><div style="text-align:center;">'), "centre", F.lit('</div><div style="text-align:right;">'), "rights", F.lit("</div></div>"))
    two = F.concat(
        F.lit('<div style="display:grid;grid-template-columns:'), F.col("widths.left_fr").cast("string"), F.lit("fr "), F.col("widths.right_fr").cast("string"),
        F.lit('fr;gap:24px;margin:12px 0;"><div>'), "lefts", F.lit("</div><div>"), "rights", F.lit("</div></div>"),
    )
    html = F.when(~F.col("columns"), linear).when(F.exists("items", lambda e: ~e["left"] & ~e["right"]), three).otherwise(two)
    rendered = bands.select("page_id", F.struct("band", html.alias("html")).alias("part"))
    return rendered.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["html"]), "").alias("html"))
