"""Rule tables: literal rows in, literal results out, at every edge of a rule."""

import random

import pytest
from pyspark.sql import functions as F

from noteframe.functions import modeljson as J
from noteframe.functions import text as T
from noteframe.operators import enrich, extract, layout, library
from noteframe.sources import export, media, pages, schemas


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, c {kind}")
    return [r.v for r in df.select("k", expr.alias("v")).orderBy("k").collect()]


def test_words_and_white_space(spark):
    c = ["it's", "-- 'a' b-c x_1", "é ' -", "naïve café", None, "", "a b  c\n"]
    assert values(spark, c, T.word_count("c")) == [1, 3, 1, 2, 0, 0, 3]
    assert values(spark, c, T.clean_ws("c")) == ["it's", "-- 'a' b-c x_1", "é ' -", "naïve café", "", "", "a b c"]
    assert values(spark, ["a  b\nc", " ", None], T.token_count("c")) == [3, 0, 0]
    assert values(spark, ["naïve café"], T.ascii_word_count("c")) == [3]


def test_html(spark):
    assert values(spark, ["<p>a<br>b</p>&nbsp;c", "<BR/>x"], T.html_to_text("c")) == ["a b c", "x"]
    assert values(spark, ["<P>a</P>&NBSP;b"], T.strip_html("c")) == ["a b"]
    assert values(spark, ["a<b & \"c\" 'd'>"], T.escape_html("c")) == ["a&lt;b &amp; &quot;c&quot; &#039;d&#039;&gt;"]
    assert values(spark, ["<p>a</p>b<br/>c"], T.plain_lines("c")) == ["a\nb\nc"]
    spans = '<span style="background: yellow"> a </span><span style="background-color:transparent">b</span><span style="background-color: rgba(0, 0, 0, 0)">c</span><span style=\'background-color:#ff0\'>a</span><span style="background:red">d<b>e</b></span>'
    assert values(spark, [spans], T.extract_highlights("c")) == [["a", "d e"]]
    assert values(spark, ["$$ x $$ and $y$ and $$z$$ cost \\$5", "none"], T.extract_formulas("c")) == [["x", "z", "y"], []]


def test_small_texts(spark):
    assert values(spark, ["a, b ,,c", None, ""], T.split_tags("c")) == [["a", "b", "c"], [], []]
    assert values(spark, ["a,b , c"], T.tag_preview("c")) == [["a", "b"]]
    assert values(spark, ["a.b.PNG", "none", None], T.file_ext("c")) == ["PNG", "jpg", "jpg"]
    assert values(spark, ["abcdef", "ab"], T.ellipsis("c", 3)) == ["abc...", "ab"]
    assert values(spark, ["x" * 400 + "Key" + "y" * 400, "short"], T.highlight_context("c", F.lit("kEY"), 3)) == ["xxxKeyyyy", "short"]
    assert values(spark, ["Ann Lee", "", None], T.username_slug("c", F.lit("Bob.X@y.z"))) == ["ann_lee", "bob.x", "bob.x"]
    df = spark.sql("select timestamp_ntz '2024-01-05 15:04:00' as t")
    assert df.select(*(T.fmt_date("t", s) for s in T.DATES)).first() == ("Jan 5, 2024", "Jan 5, 2024, 3:04 PM", "January 5, 2024")


@pytest.mark.parametrize("words,threshold", [(10, 15), (50, 60), (0, 5)])
def test_thresholds(spark, words, threshold):
    assert spark.range(1).select(T.scaled_threshold(F.lit(words), 1.2, F.lit(words + 5))).first()[0] == threshold


def test_grid_fractions_round_halves_to_even(spark):
    df = spark.createDataFrame([(0.0, 52.5), (0.0, 10.0), (60.0, 30.0), (4.0, 90.0)], "l double, r double")
    got = [tuple(r[0]) for r in df.select(T.grid_fractions(F.col("l"), F.col("r"))).collect()]
    assert got == [(52, 48), (20, 80), (50, 70), (76, 20)]


def python_repair(s):
    s = s.strip()
    for fence in ("```json", "```"):
        if s.startswith(fence):
            s = s[len(fence) :]
            break
    s = s.strip()
    if s.endswith("```"):
        s = s[:-3]
    s = s.strip()
    if s.startswith("[") and not s.endswith("]"):
        at = s.rfind("}")
        return s[: at + 1] + "]" if at >= 0 else "[]"
    if s.startswith("{") and not s.endswith("}"):
        return s.rstrip(", \n") + "}"
    return s


def test_repair_of_every_prefix(spark):
    whole = '```json\n[{"question": "a", "answer": "b"}, {"question": "c", "answer": "d"}, {"question": "e", "answer": "f"}]\n```'
    one = '{"subject": "x", "topic": "y", "tags": ["a", "b"]}'
    cuts = [t[:n] for t in (whole, one) for n in range(3, len(t) + 1) if not t[:n].rstrip().endswith(("`", "``")) or n == len(t)]
    assert values(spark, cuts, J.repair_json("c")) == [python_repair(c) for c in cuts]


def test_flashcard_shapes(spark):
    card, other = '{"question": "q", "answer": "a"}', '{"question": "r"}'
    rows = [f"[{card}, {other}]", "[]", f'{{"cards": [{card}]}}', f'{{"x": 1, "data": [], "list": [{card}]}}', f'{{"x": "y", "later": [{card}], "z": [{other}]}}', '{"a": 1}', "no cards", f"[{card}] trailing"]
    got = values(spark, rows, J.parse_flashcards("c"))
    as_pairs = [None if g is None else [tuple(x) for x in g] for g in got]
    assert as_pairs == [[("q", "a"), ("r", "")], None, [("q", "a")], [], [("q", "a")], None, None, None]


def test_responses_and_categories(spark):
    assert values(spark, ['["a", "b"]', "[]", '[{"a": 1}]', "text"], J.join_response("c")) == ["ab", "", '[{"a": 1}]', "text"]
    got = values(spark, ['{"subject": "s", "tags": ["a", "b"]}', "[]", "x"], J.parse_categories("c"))
    assert [g and tuple(g) for g in got] == [("s", "", "a, b"), None, None]


def test_ocr_pages_and_html_of_every_kind(spark):
    kinds, containers = ("header", "bullet_list", "key_value", "diagram", "paragraph"), ("box", "circled", "underlined", "none")
    items = [f'{{"type": "{k}", "container": "{c}", "content": "K: v", "children": ["one", " two "], "position": {{"x_percent": "5", "y_percent": {n}}}, "style": {{"is_bold": true, "is_large": true}}, "diagram": {{"labels": ["l"]}}}}' for n, (k, c) in enumerate((k, c) for k in kinds for c in containers)]
    rows = [(1, "```json\n{\"page_layout\": \"mixed\", \"elements\": [" + ",".join(items) + "]}\n```"), (2, "{'bad': 1}"), (3, '{"elements": [{"type": "label", "content": null, "children": ["kid"]}]}')]
    parsed = spark.createDataFrame(rows, "page_id long, value string").select("page_id", J.parse_ocr("value").alias("page"))
    listed = {r.page_id: r for r in pages.pages_of(parsed, "page_id").collect()}
    assert listed[2].error and listed[2].raw_text == "{'bad': 1}" and listed[1].error is None and listed[3].page_layout == "unknown"
    elements = pages.elements_of(parsed, "page_id")
    assert elements.where("page_id = 1 and x_percent = 5").count() == 20
    html = {r.ord: r.h for r in elements.where("page_id = 1").select("ord", layout.element_to_html().alias("h")).collect()}
    assert html[0] == f'<div style="{layout.BOX}"><h2 style="font-size: 1.5em; {layout.HEADER} margin:0;">K: v</h2></div>'
    assert html[7].count("◆") == 2 and "<span>two</span>" in html[7]
    assert html[11] == f'<div style="margin:8px 0;line-height:1.75;"><span style="{layout.KEY}">K:</span>  v</div>'
    assert html[15].endswith(f'📊 K: v<div style="{layout.LABELS}">Labels: l</div></div>')
    assert html[18] == f'<p style="margin:10px 0;line-height:1.75;font-weight:bold;{layout.UNDERLINED}">K: v</p>'
    assert [r.t for r in elements.where("page_id = 3").select(layout.element_text().alias("t")).collect()] == ["kid"]


META = [("Date: 1/2/24", True), ("pg 3", True), ("Page12", True), ("page 12", True), ("3 of 9", True), ("7", True), ("update", False), ("12-3", True), ("two small words", False)]


def test_metadata_elements(spark):
    rows = [(1, k, t, "label", "none", "left", 5.0, 50.0, 50.0, 1.0) for k, (t, _) in enumerate(META)]
    rows += [(1, 100, "one two three", "label", "none", "top-right", 80.0, 22.0, 18.0, 1.0), (1, 101, "one two three four", "label", "none", "top-right", 80.0, 22.0, 18.0, 1.0), (1, 102, "", "label", "none", "top-right", 80.0, 2.0, 8.0, 1.0)]
    df = spark.createDataFrame(rows, "page_id long, ord int, content string, type string, container string, region string, x_percent double, y_percent double, width_percent double, height_percent double")
    got = [r.m for r in layout.complete(df).orderBy("ord").select(layout.is_metadata_element().alias("m")).collect()]
    assert got == [m for _, m in META] + [True, False, False]


def elements_frame(spark, rows):
    return layout.complete(spark.createDataFrame(rows, "page_id long, ord int, content string, type string, container string, region string, x_percent double, y_percent double, width_percent double, height_percent double, shape string"))


def test_bands_against_a_walk(spark):
    rng, rows, want = random.Random(3), [], {}
    for page in range(60):
        edge, band = None, 0
        for k in range(rng.randrange(1, 25)):
            y, h = rng.choice([None, float(rng.randrange(0, 100))]), rng.choice([None, float(rng.randrange(0, 12))])
            rows.append((page, k, "t", "label", "none", "left", 1.0, y, 1.0, h, None))
            if edge is not None and (y or 0.0) >= edge + 5:
                band, edge = band + 1, None
            bottom = (y or 0.0) + (5.0 if h is None else h)
            edge = bottom if edge is None else max(edge, bottom)
            want[page, k] = band
    got = {(r.page_id, r.ord): r.band for r in layout.assign_bands(elements_frame(spark, rows)).collect()}
    assert got == want


def test_connector_distances(spark):
    box = (0, "box text", "paragraph", "box", "left", 50.0, 50.0)
    cases = [("triangle", 69.9, 74.9, True), ("triangle", 70.0, 50.0, False), ("arrow", 50.0, 75.0, False), ("rectangle", 50.0, 50.0, False), (None, 31.0, 26.0, True)]
    rows = []
    for page, (shape, x, y, _) in enumerate(cases):
        rows += [(page, *box, 5.0, 5.0, None), (page, 1, "d", "diagram", "none", "right", x, y, 5.0, 5.0, shape)]
    kept = {(r.page_id, r.ord) for r in layout.drop_connector_shapes(elements_frame(spark, rows)).collect()}
    assert [(p, 1) not in kept for p in range(len(cases))] == [dropped for *_, dropped in cases]


def test_page_assembly(spark):
    words = "alpha beta gamma delta epsilon zeta"
    rows = [
        (1, 0, "Title", "header", "none", "top-left", 0.0, 0.0, 50.0, 5.0, None), (1, 1, "Date 1/2", "label", "none", "top-right", 80.0, 1.0, 10.0, 5.0, None), (1, 2, "Body text", "paragraph", "none", "left", 0.0, 8.0, 50.0, 5.0, None),
        (2, 0, words, "paragraph", "none", "left", 4.0, 10.0, 40.0, 9.0, None), (2, 1, words, "paragraph", "none", "right", 52.5, 12.0, 40.0, 9.0, None), (2, 2, "far below", "paragraph", "none", "left", 4.0, 90.0, 40.0, 5.0, None),
        (3, 0, words, "paragraph", "none", "left", 4.0, 10.0, 40.0, 9.0, None), (3, 1, "mid", "paragraph", "none", "center", 40.0, 11.0, 9.0, 9.0, None), (3, 2, words, "paragraph", "none", "right", 55.0, 12.0, 40.0, 9.0, None),
    ]
    known = spark.createDataFrame([(1, "mixed"), (2, "two_column"), (3, "mixed")], "page_id long, page_layout string")
    html = {r.page_id: r.html for r in layout.build_page_html(elements_frame(spark, rows), known).collect()}
    p = lambda t: f'<p style="margin:10px 0;line-height:1.75;font-weight:normal;">{t}</p>'
    head = f'<h2 style="font-size: 1.2em; {layout.HEADER}">Title</h2>'
    assert html[1] == head + layout.META_BLOCK + p("Date 1/2") + "</div>" + p("Body text")
    grid = '<div style="display:grid;grid-template-columns:48fr 48fr;gap:24px;margin:12px 0;"><div>'
    assert html[2] == grid + p(words) + "</div><div>" + p(words) + "</div></div>" + p("far below")
    assert html[3] == layout.GRID_THREE + p(words) + '</div><div style="text-align:center;">' + p("mid") + '</div><div style="text-align:right;">' + p(words) + "</div></div>"


def n_words(n):
    return " ".join(f"w{k}" for k in range(n))


def test_fallback_edges(spark):
    rows = [(n_words(24), 9, None), (n_words(25), 3, None), (n_words(44), 2, None), (n_words(44), 3, None), (n_words(45), 0, None), (n_words(99), 9, "timeout"), ("  ", 9, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, raw_text string, n_elements int, error string")
    assert [r.v for r in df.orderBy("k").select(extract.needs_fallback().alias("v")).collect()] == [True, False, True, False, False, True, True]


def test_pass_selection(spark):
    cases = {
        1: [(n_words(50), 5, None), ("", 0, "timeout"), ("", 0, "timeout")], 2: [(n_words(10), 5, None), (n_words(50), 5, None), (n_words(90), 5, None)],
        3: [(n_words(10), 1, None), (n_words(14), 1, None), (n_words(14), 1, None)], 4: [(n_words(10), 1, None), (n_words(15), 1, None), (n_words(12), 1, None)],
        5: [("", 0, "timeout"), ("", 0, "timeout"), (n_words(1), 0, None)], 6: [(n_words(3), 0, None), ("", 0, "timeout"), ("", 0, "timeout")],
    }
    rows = [(p, k + 1, *x) for p, xs in cases.items() for k, x in enumerate(xs)]
    got = {r.page_id: (r["pass"], r.source_pass) for r in extract.select_pass(spark.createDataFrame(rows, "page_id long, pass int, raw_text string, n_elements int, error string")).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 1), 4: (3, 2), 5: (3, 3), 6: (1, 1)}


def test_choice_of_transcript(spark):
    raw = "important " + n_words(19)
    rows = [(1, raw, "mixed", None), (2, None, "mixed", "<p>x</p>"), (3, raw, "mixed", "<p>" + n_words(11) + "</p>"), (4, raw, "mixed", "<p>" + n_words(12) + "</p>"), (5, raw, "mixed", "<p>" + n_words(16) + " important</p>"), (6, raw, "single_column", "<p>important " + n_words(16) + "</p>")]
    got = {r.page_id: r.reason for r in extract.select_structured(spark.createDataFrame(rows, "page_id long, raw_text string, page_layout string, html string")).collect()}
    assert got == {1: "no_layout", 2: "no_transcript", 3: "few_words", 4: "layout", 5: "scrambled", 6: "layout"}


def test_merged_notes_keep_their_quirk(spark):
    rows = [(1, 2, "b", "<p>b</p>", None), (1, 1, "a", "<p>a</p>", None), (2, 1, None, None, "timeout"), (2, 2, "x", "x", None), (3, 1, None, None, "timeout")]
    df = spark.createDataFrame(rows, "note_id long, page_no int, raw_text string, structured_text string, error string")
    got = {r.note_id: r for r in extract.merge_pages(df).collect()}
    assert got[1].raw_text == "a\n\nb" and got[1].error_message is None
    assert got[2].status == "completed" and got[2].error_message == "Pages 1 failed" and got[2].raw_text.startswith("[Page 1 failed: timeout]\n\nx")
    assert got[3].status == "failed"
    merged = extract.merge_pages(df).where("note_id = 3").withColumn("status", F.lit("failed"))
    assert merged.select(library.public_status()).first()[0] == "needs_review"


def test_search_wildcards(spark):
    rows = [(1, "100% sure"), (2, "100 sure"), (3, "a_b"), (4, "axb"), (5, None), (6, "back\\slash")]
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], "id long, title string, raw_text string, subject string, topic string, tags string, created_at timestamp_ntz")
    ids = lambda q: {r.id for r in library.search_notes(df, q).collect()}
    assert ids("0% S") == {1, 2} and ids("a_b") == {3, 4} and ids("A\\_B") == {3} and ids("") == {1, 2, 3, 4, 5, 6} and ids("k\\\\s") == {6}


def test_model_calls_are_tried_again(spark):
    rows = spark.createDataFrame([(1, "s", "fine"), (2, "s", "never"), (3, "s", "refused")], "id long, system string, user string")

    def model(system, user):
        if user == "never":
            raise ValueError("down")
        return user

    got = {r.id: (r.response, r.attempts, r.error) for r in enrich.enrich(rows, model, wait=0.0, accept=lambda a: a != "refused").collect()}
    assert got == {1: ("fine", 1, None), 2: (None, 3, "down"), 3: (None, 3, "answer not accepted")}


def test_media_and_export(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(media.PNG + b"rest")
    (tmp_path / "b.heic").write_bytes(b"\0\0\0\x18ftypheic....")
    df = media.read_images(spark, str(tmp_path)).select(F.col("path"), media.sniff_media_type(F.col("content")).alias("kind"), media.is_heic(F.col("content")).alias("heic"))
    assert {(r.path[-5:], r.kind, r.heic) for r in df.collect()} == {("a.png", "image/png", False), (".heic", "image/jpeg", True)}
    edges = spark.createDataFrame([(204799, 9999), (204800, 1500), (511999, 1500), (512000, 1500), (204800, 1501)], "length long, width int")
    assert [r.v for r in edges.select(media.route(F.col("length"), F.col("width")).alias("v")).collect()] == ["keep", "keep", "keep", "compress", "compress"]
    notes = spark.createDataFrame([(7, None, "a\nb", None), (8, "T", None, "<p>x</p>")], "id long, title string, raw_text string, structured_text string")
    export.export_txt(notes, str(tmp_path / "txt"))
    export.export_html(notes, str(tmp_path / "html"))
    assert spark.read.text(str(tmp_path / "txt/note_id=7"), wholetext=True).first()[0].strip() == "a\nb"
    assert "<h1>T</h1>\n  <div><p>x</p></div>" in spark.read.text(str(tmp_path / "html/note_id=8"), wholetext=True).first()[0]


def test_schemas(spark, tmp_path):
    old = spark.createDataFrame([(1, "n", "more")], "id long, name string, extra string")
    new = schemas.evolve_schema(old, schemas.schema_of("notebooks"))
    assert new.columns == [*schemas.schema_of("notebooks").fieldNames(), "extra"] and new.first().color is None
    new.drop("extra").write.parquet(str(tmp_path / "notebooks"))
    assert schemas.read_tables(spark, str(tmp_path), ("notebooks",))["notebooks"].first().name == "n"
