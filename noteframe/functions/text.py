"""Column functions over texts: words, white space, HTML, tags, titles, formulas and highlights. Null texts count as empty."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of letters, digits, underscore, apostrophe and hyphen with at least one of the first three; means the same in RE2.
WORD = r"[\p{L}\p{N}_'-]*[\p{L}\p{N}_][\p{L}\p{N}_'-]*"
ASCII_WORD = r"[A-Za-z0-9_'-]*[A-Za-z0-9_][A-Za-z0-9_'-]*"
#: The same words for engines that backtrack: a run of marks without a letter is given up at once, and not from each of its marks again.
FAST_WORD = r"(?<!['-])['-]*+[\p{L}\p{N}_][\p{L}\p{N}_'-]*+"
FAST_ASCII_WORD = r"(?<!['-])['-]*+[A-Za-z0-9_][A-Za-z0-9_'-]*+"
#: All characters that count as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: HTML escapes in the order in which they apply.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once. An expression that stands inside another's lambda is computed anew at every step."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_filled(*columns: Column | str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.when(col(c) != "", col(c)) for c in columns))


def trim_ws(c: Column | str) -> Column:
    return F.btrim(filled(c), F.lit(WHITE))


def clean_ws(c: Column | str) -> Column:
    """White space of any kind becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(filled(c), r"(?U)\s+", " "))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(filled(c), F.lit(FAST_WORD))


def ascii_word_count(c: Column | str) -> Column:
    return F.regexp_count(filled(c), F.lit(FAST_ASCII_WORD))


def token_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(filled(c), r"\s+"), lambda x: x != ""))


def char_count(c: Column | str) -> Column:
    return F.length(filled(c))


def newline_to_br(c: Column | str) -> Column:
    return F.replace(filled(c), F.lit("\n"), F.lit("<br>"))


def without_tags(c: Column, instead: str) -> Column:
    """Every tag, from a < to the next > with something between, gives way to `instead`.

    The text is split at >, and each part looks for its first <, so the work is proportional to the text, whatever it holds.
    """

    def replaced(parts: Column) -> Column:
        opens = lambda p: F.instr(p, "<")
        is_tag = lambda p: (opens(p) > 0) & (opens(p) < F.length(p))
        closed = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.when(is_tag(p), F.concat(F.substring_index(p, "<", 1), F.lit(instead))).otherwise(F.concat(p, F.lit(">"))))
        return F.concat(F.array_join(closed, ""), F.element_at(parts, -1))

    return F.when(F.contains(c, F.lit("<")) & F.contains(c, F.lit(">")), bound(F.split(c, ">", -1), replaced)).otherwise(c)


def html_to_text(c: Column | str) -> Column:
    """Breaks and hard blanks, then all tags, become blanks; only these spellings of a break count."""
    out = filled(c)
    for x in ("<br>", "<br/>", "<br />", "&nbsp;"):
        out = F.replace(out, F.lit(x), F.lit(" "))
    return clean_ws(without_tags(out, " "))


def strip_html(c: Column | str) -> Column:
    """As html_to_text, without regard to case and with any spelling of a break."""
    return clean_ws(F.regexp_replace(without_tags(filled(c), " "), "(?i)&nbsp;", " "))


def plain_lines(c: Column | str) -> Column:
    """The text of HTML as a page shows it: breaks and ends of blocks are new lines, tags go."""
    out = F.regexp_replace(filled(c), r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr)>", "\n")
    return F.regexp_replace(without_tags(out, ""), "(?i)&nbsp;", " ")


def escape_html(c: Column | str) -> Column:
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, filled(c))


def split_tags(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(filled(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def join_tags(c: Column | str) -> Column:
    return F.array_join(col(c), ", ")


def tag_preview(c: Column | str, k: int = 2) -> Column:
    return F.transform(F.slice(F.split(filled(c), ","), 1, k), lambda x: F.trim(x))


def highlight_context(raw: Column | str, highlight: Column | str, around: int = 300) -> Column:
    """The text around the first place of the highlight, without regard to case; else the text's first 2 * around characters."""
    raw, highlight = filled(raw), filled(highlight)
    at = F.instr(F.lower(raw), F.lower(highlight))
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(raw, start, at + F.length(highlight) + around - start)).otherwise(F.substring(raw, 1, 2 * around))


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def ellipsis(c: Column | str, n: int) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def file_ext(c: Column | str) -> Column:
    return F.when(F.instr(filled(c), ".") > 0, F.substring_index(col(c), ".", -1)).otherwise("jpg")


def note_title(title: Column | str, filename: Column | str, pages: Column | None = None) -> Column:
    many = F.concat(col(filename), F.lit(" (+"), (pages - 1).cast("string"), F.lit(" pages)")) if pages is not None else None
    name = F.when(pages > 1, many).otherwise(col(filename)) if pages is not None else col(filename)
    return F.coalesce(first_filled(title), name)


def set_title(title: Column | str) -> Column:
    return F.concat(F.lit("Flashcards for "), F.coalesce(col(title), F.lit("None")))


def username_slug(name: Column | str, email: Column | str) -> Column:
    return F.lower(F.replace(F.coalesce(first_filled(name), F.substring_index(col(email), "@", 1)), F.lit(" "), F.lit("_")))


#: What highlights look like.
HIGHLIGHT = r"""(?is)<span[^>]*style=["'][^"'>]*background(?:-color)?:\s*+(?!transparent|rgba\(0,\s*0,\s*0,\s*0\))[^"'>]*["'][^>]*>(.*?)</span>"""
#: What ends a line within a formula; a backslash before one of these escapes nothing.
LINE_ENDS = "\n\r\u2028\u2029"
#: Codes of the formula scanner: \x01 itself, an escaped dollar sign, the backslash of an escape, an escaped backslash.
CODE_MARK, CODE_DOLLAR, CODE_SLASH, CODE_PAIR = "\x01a", "\x01b", "\x01c", "\x01d"


def _decoded(c: Column) -> Column:
    for code, plain in ((CODE_PAIR, "\\\\"), (CODE_SLASH, "\\"), (CODE_DOLLAR, "$"), (CODE_MARK, "\x01")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _inline_formulas(rest: Column) -> Column:
    """Formulas between single dollar signs, without line ends after backslashes, in one pass over the parts of the text.

    Split at its dollar signs, a text has parts; a sign after an odd number of backslashes is escaped and closes nothing. The
    others cut it into segments (escapes in code). A segment can be a formula between the sign before and the one after it,
    or from an escaped sign within it on. It is (A) one if the sign before did not close another, (M) one in any case, from its
    escaped sign on, (N) one in any case, whole if the sign before is free, or (x) none. Which As follow a closing sign is told
    by pairs in the string of these letters.
    """
    escapes = lambda p: (F.length(p) - F.length(F.rtrim(p, F.lit("\\")))) % 2 == 1
    parts = F.split(F.replace(rest, F.lit("\x01"), F.lit(CODE_MARK)), r"\$", -1)
    coded = F.array_join(F.transform(parts, lambda p: F.concat(p, F.when(escapes(p), CODE_DOLLAR).otherwise("$"))), "")
    # the last part's own sign ends the text; a backslash before it would have taken that sign
    coded = F.when(F.endswith(coded, F.lit("$")), F.substring(coded, F.lit(1), F.length(coded) - 1)).otherwise(F.substring(coded, F.lit(1), F.length(coded) - len(CODE_DOLLAR)))
    coded = F.replace(coded, F.lit("\\\\"), F.lit(CODE_PAIR))
    segments = F.split(F.regexp_replace(coded, rf"\\([^{LINE_ENDS}])", rf"{CODE_SLASH}$1"), r"\$", -1)

    def scanned(s: Column) -> Column:
        n = F.size(s) - 1
        bad = lambda x: F.contains(x, F.lit("\\"))
        late = lambda x: F.substring_index(x, "\\", -1)  # noqa: E731  behind the last backslash that escapes nothing
        inner = lambda x: F.when(F.contains(late(x), F.lit(CODE_DOLLAR)), F.substring(late(x), F.instr(late(x), CODE_DOLLAR) + len(CODE_DOLLAR), F.length(x))).otherwise("")

        def letter(x: Column, i: Column) -> Column:
            closes = (F.get(s, i + 1) != "") | (i + 1 == n)
            whole = (i > 0) & (x != "") & ((i == 1) | (F.get(s, i - 1) != "")) & ~F.endswith(F.get(s, i - 1), F.lit(CODE_DOLLAR)) & ~bad(x)
            within = inner(x) != ""
            return F.when(~closes, "x").when(within & whole, "N").when(within, "M").when(whole, "A").otherwise("x")

        letters = F.array_join(F.transform(F.slice(s, 1, n), letter), "")
        settled = F.replace(F.regexp_replace(letters, "([MN])A", "$1x"), F.lit("AA"), F.lit("Ax"))

        def taken(found: Column) -> Column:
            texts = F.transform(
                F.slice(s, 1, n),
                lambda x, i: F.when((F.get(found, i) == "A") | ((F.get(found, i) == "N") & (F.get(found, i - 1) == "x")), x).when(F.get(found, i) != "x", inner(x)),
            )
            return F.transform(F.filter(texts, lambda x: x.isNotNull()), _decoded)

        return F.when(n > 0, bound(F.split(settled, ""), taken)).otherwise(F.array().cast("array<string>"))

    return F.when(F.contains(rest, F.lit("$")), bound(segments, scanned)).otherwise(F.array().cast("array<string>"))


def extract_formulas(c: Column | str) -> Column:
    """Display formulas ($$...$$) and then inline ones ($...$), trimmed. The work is proportional to the text."""

    def found(parts: Column) -> Column:
        n = F.size(parts)
        shown = F.filter(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), lambda p, i: i % 2 == 1)
        others = F.filter(parts, lambda p, i: (i % 2 == 0) | (i == n - 1))
        # a last double sign without a partner stays
        rest = F.when(n % 2 == 0, F.concat(F.array_join(F.slice(others, 1, F.size(others) - 1), ""), F.lit("$$"), F.element_at(parts, -1))).otherwise(F.array_join(others, ""))
        return F.transform(F.concat(shown, bound(rest, _inline_formulas)), lambda x: F.btrim(x, F.lit(WHITE)))

    return bound(F.split(filled(c), r"\$\$", -1), found)


def extract_highlights(c: Column | str) -> Column:
    """Texts of spans with a background that is not transparent: trimmed, not empty, each once, in their order."""
    texts = F.transform(F.regexp_extract_all(filled(c), F.lit(HIGHLIGHT), F.lit(1)), strip_html)
    return F.array_distinct(F.filter(texts, lambda x: x != ""))


def like_pattern(q: str) -> str:
    """The user's % and _ stay wildcards."""
    return f"%{q}%"


def grid_fractions(left: Column, right: Column) -> Column:
    """Widths of two columns from their least x: the right one clamped to 20..80, halves to even, 50 where nothing is left."""
    clamped = F.greatest(F.lit(20.0), F.least(F.lit(80.0), right))
    part = lambda x: F.when(F.bround(x) <= 0, 50).otherwise(F.bround(x)).cast("int")
    return F.struct(part(clamped - left).alias("left_fr"), part(100 - clamped).alias("right_fr"))


def scaled_threshold(words: Column, factor: float, least: Column | int) -> Column:
    return F.greatest(F.lit(least) if isinstance(least, int) else least, F.floor(words * F.lit(factor)).cast("int"))


def anchor_ratio(text: Column, anchor: Column) -> Column:
    """Where the anchor first stands in the text, from 0 to 1; null if it does not."""
    at = F.instr(text, anchor)
    return F.when(at > 0, (at - 1) / F.length(text))


def score_ratio(know: Column, total: Column) -> Column:
    return F.try_divide(know, total)


def score_tier(know: Column, total: Column) -> Column:
    ratio = score_ratio(know, total)
    return F.when(total == 0, "none").when(know == total, "all").when(ratio >= 0.7, "most").otherwise("some")


#: Date styles.
DATES = {"short": "MMM d, yyyy", "time": "MMM d, yyyy, h:mm a", "long": "MMMM d, yyyy"}


def fmt_date(c: Column | str, style: str = "short") -> Column:
    return F.date_format(col(c), DATES[style])


def patched(patch: Column, field: str, old: Column) -> Column:
    """The patch's value if it names the field, null included, else the old one."""
    return F.when(F.map_contains_key(patch, field), F.try_element_at(patch, F.lit(field))).otherwise(old)
