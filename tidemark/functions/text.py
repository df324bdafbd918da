"""Text functions.

White space is Unicode white space as browsers have it, word boundaries are ASCII.
Entity decoding and accent folding, which Spark lacks, are vectorised helpers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class: white space of browsers.
SPACE = r"\s\u000B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The same without the line feed.
BLANK = r" \t\u000B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: ASCII word boundaries before and behind a word.
AT = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
OFF = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# Named character references that are decoded.
ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": "\u00a0",
    "ndash": "–",
    "mdash": "—",
    "hellip": "…",
    "rsquo": "’",
    "lsquo": "‘",
    "rdquo": "”",
    "ldquo": "“",
    "bull": "•",
    "middot": "·",
    "euro": "€",
    "pound": "£",
    "copy": "©",
    "reg": "®",
    "trade": "™",
}
# Tags that begin and end a block of text.
BLOCK_TAGS = "address article aside blockquote div dl dt dd fieldset figure footer form h[1-6] header hr main nav ol p pre section table tr ul".split()


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with value computed once, however often make uses it: plans stay as small as they read."""
    return F.element_at(F.transform(F.array(value), make), 1)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_ws(s: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return trim(F.regexp_replace(s, rf"[{SPACE}]+", " "))


def null_if_empty(s: Column) -> Column:
    return F.when(s != "", s)


def clean_line(s: Column) -> Column:
    return null_if_empty(collapse_ws(s))


def clean_lines(s: Column) -> Column:
    """Each line trimmed, at most one blank line between two."""
    lines = F.transform(F.split(s, "\n"), lambda x: trim(F.regexp_replace(x, rf"[{BLANK}]+", " ")))
    return trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def clean_block(s: Column) -> Column:
    """Text of several lines: each trimmed, at most one blank line between two, empty as null."""
    return null_if_empty(clean_lines(F.regexp_replace(s, r"\r\n?", "\n")))


def _character(body: Column) -> Column:
    """The character of a reference without & and ;, null if there is none."""
    named = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    digits = F.regexp_replace(F.substring(body, 3, 1 << 20), "^0+", "")
    code = F.when(body.rlike("(?i)^#x[0-9a-f]+$"), F.when(F.length(digits) <= 6, F.conv(digits, 16, 10).try_cast("int"))).when(body.rlike(r"^#\d+$"), F.substring(body, 2, 1 << 20).try_cast("int"))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.coalesce(F.try_element_at(named, F.lower(body)), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")))


def decode_entities(s: Column) -> Column:
    """Character references decoded once; unknown ones stay."""

    def decoded(piece: Column) -> Column:
        body = F.regexp_extract(piece, "(?i)^(#x[0-9a-f]+|#[0-9]+|[a-z][a-z0-9]*);", 1)
        return let(F.struct(body.alias("body"), F.when(body != "", _character(body)).alias("made")), lambda x: F.when(x["made"].isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(x["made"], F.substring(piece, F.length(x["body"]) + 2, F.length(piece)))))

    # each piece but the first stood behind an &
    split = let(F.split(s, "&"), lambda p: F.concat(F.element_at(p, 1), F.array_join(F.transform(F.slice(p, 2, F.size(p)), decoded), "")))
    return F.when(s.contains("&"), split).otherwise(s)


def strip_tags(html: Column) -> Column:
    """Text of an HTML fragment with its references as they are: blocks and <br> break lines, list items get a dash."""
    blocks = "|".join(BLOCK_TAGS)
    for pattern, by in (
        (r"(?s)<!--.*?-->", ""),
        (r"(?is)<(script|style)\b.*?</\1\s*>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)<li\b[^>]*>", "\n- "),
        (rf"(?i)</?(?:{blocks})\b[^>]*>", "\n"),
        (r"<[^>]+>", ""),
    ):
        html = F.regexp_replace(html, pattern, by)
    return html


def html_to_text(html: Column) -> Column:
    return clean_lines(decode_entities(strip_tags(html)))


def _plain(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c)[0] != "M")


#: Letters up to the end of the Latin and Greek extensions that are one letter and marks, and that letter.
_MARKED = {c: p for c in map(chr, range(0xC0, 0x2000)) if len(p := _plain(c)) == 1 and p != c}


def folded(t: str) -> str:
    """What fold_accents makes of a text."""
    return "".join(_MARKED.get(c, c) for c in t.lower() if unicodedata.category(c)[0] != "M")


def fold_accents(s: Column) -> Column:
    """Lower case without diacritics, of alphabets; syllables of Hangul and the like stay whole."""
    return F.translate(F.regexp_replace(F.lower(s), r"\p{M}+", ""), "".join(_MARKED), "".join(_MARKED.values()))


def regex_extract_first(s: Column, pattern: str) -> Column:
    """Group 1 where it took part in the match, else all of the match; null without one."""
    whole = F.regexp_extract(s, pattern, 0)
    if re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groups:
        group = F.regexp_extract(s, pattern, 1)
        whole = F.when(group != "", group).otherwise(whole)
    return F.when(s.rlike(pattern), whole)


def words(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def text_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of words; 0 if either has none."""
    x, y = words(F.coalesce(a, F.lit(""))), words(F.coalesce(b, F.lit("")))
    total = F.size(x) + F.size(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / total)


def resembles(known_tag: Column, known_text: Column, tag: Column, text: Column, least: float = 0.6) -> Column:
    """Whether an element is like the one known: same tag, or similar text; anything is if nothing is known."""
    return F.coalesce((known_tag.isNull() & known_text.isNull()) | F.coalesce(known_tag == tag, F.lit(False)) | (text_similarity(known_text, text) >= least), F.lit(True))


def hyphen_case(s: Column) -> Column:
    """FullTime as Full-time."""
    parts = F.split(s, r"(?<=[a-z])(?=[A-Z])")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.when(s.isNotNull(), F.concat_ws("-", F.slice(parts, 1, 1), rest))


def number_text(x: Column) -> Column:
    """Whole numbers without decimals, others in full."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def csv_cell(s: Column) -> Column:
    """A cell that no spreadsheet runs as a formula, quoted where it must be; null as nothing."""
    guarded = F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(guarded.rlike(r'[",\n\r]'), quoted).otherwise(guarded), F.lit(""))


#: Why a run ended, in words.
REASONS = {
    "auth_expired": "Login needed again",
    "bot_wall": "Stopped by a bot check",
    "robots_disallowed": "Closed to robots by the site",
    "locator_not_found": "An expected element was missing from the page",
    "navigation_failed": "The page did not load",
    "item_errors": "Not all postings were readable",
    "run_cancelled": "Cancelled",
    "run_timeout": "Ran out of time",
    "interrupted": "Cut off by a restart",
    "required_field_missing": "A needed field was blank",
    "not_found": "No such board",
    "internal_error": "Internal fault",
}


def reason_text(reason: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, reason), F.replace(reason, F.lit("_"), F.lit(" ")), F.lit(""))


_EDITABLE = re.compile(r"""\scontenteditable(?:\s*=\s*(?:"(?:true|plaintext-only|)"|'(?:true|plaintext-only|)'|(?:true|plaintext-only)(?=[\s>/])))?(?=[\s>/])""", re.I)
_TAGS = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())


def _without_typed(html: str) -> str:
    """The source without what is inside elements that someone may edit: from such an element's start tag to its own end tag, however tags nest in it; to the end of the page if it has none."""
    kept, at, depth, tag = [], 0, 0, ""
    for m in _TAGS.finditer(html):
        name = (m[2] or "").lower()
        if not name or name in _VOID:
            continue
        if depth:
            if name == tag:
                depth += -1 if m[1] else 1
                if not depth:
                    at = m.start()
        elif not m[1] and _EDITABLE.search(f"{m[3]}>"):
            kept.append(html[at : m.end()])
            depth, tag = 1, name
    return "".join(kept) + ("" if depth else html[at:])


def _scrubbed(html: pd.Series) -> pd.Series:
    return html.map(_without_typed, na_action="ignore")


def scrub_html(html: Column, limit: int = 60_000) -> Column:
    """Page source that may be shown: no scripts or styles, nothing that someone typed, cut at a length."""
    for pattern, by in (
        (r"(?is)<(script|style|noscript|svg|template)\b[^>]*>.*?</\1\s*>", ""),
        (r"(?is)<(?:link|meta)\b[^>]*>", ""),
        (r"(?is)(<textarea\b[^>]*>).*?(</textarea\s*>|\z)", "$1$2"),
    ):
        html = F.regexp_replace(html, pattern, by)
    # the helper gets only what has such an element
    editable = html.rlike(r"(?i)\scontenteditable")
    html = F.coalesce(F.pandas_udf(_scrubbed, "string")(F.when(editable, html)), html)
    field = r"""(?is)(<(?:input|option|select|textarea|button)\b[^>]*?)\s(?:value|selected|checked)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>])"""
    for _ in range(3):
        html = F.regexp_replace(html, field, "$1")
    return F.substring(html, 1, limit)
