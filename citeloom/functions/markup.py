"""Column functions on marked-up text. Tag names are exact: ``b`` matches neither ``body`` nor ``br``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

TAGS = ("bibl", "quote", "cit")
#: The marker tokens of a tag's boundaries.
MARKERS = {"bibl": ("[BIBL_START]", "[BIBL_END]"), "quote": ("[QUOTE_START]", "[QUOTE_END]"), "cit": ("[CIT_START]", "[CIT_END]")}
BLANK = r"[\x20\x09-\x0D]"


def names(tags: Sequence[str]) -> str:
    return "(?:" + "|".join(tags) + ")"


def strip_tags(text: Column, tags: Sequence[str] = TAGS, prefix_match: bool = False) -> Column:
    """text without the tags of these elements; content and other tags stay. prefix_match: opening
    tags of all elements whose names begin so go too, closing ones by exact name."""
    if prefix_match:
        return F.regexp_replace(text, rf"<{names(tags)}[^>]*>|</{names(tags)}>", "")
    return F.regexp_replace(text, rf"</?{names(tags)}(?:\s[^>]*)?/?>", "")


def contents(text: Column, tag: str) -> Column:
    """Inner text of every element of this name, shortest first match, across lines."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def extract_citations(text: Column, first: str = "bibl", second: str = "quote") -> Column:
    return F.struct(contents(text, first).alias("bibl"), contents(text, second).alias("quote"))


def drop_attributes(text: Column, tags: Sequence[str] = TAGS) -> Column:
    return F.regexp_replace(text, rf"<({'|'.join(tags)})\s[^>]*?(/?)>", "<$1$2>")


def to_markers(text: Column, markers: dict[str, tuple[str, str]] = MARKERS) -> Column:
    """Tags become marker tokens, attributes are dropped, a self-closing tag goes."""
    out = F.regexp_replace(text, rf"<{names(list(markers))}(?:\s[^>]*)?/>", "")
    out = F.regexp_replace(out, rf"<({'|'.join(markers)})\s[^>]*>", "<$1>")
    for tag, (start, end) in markers.items():
        out = F.replace(F.replace(out, F.lit(f"<{tag}>"), F.lit(start)), F.lit(f"</{tag}>"), F.lit(end))
    return out


def preamble(text: Column) -> Column:
    """The leading run of processing instructions and declarations, with blanks between."""
    return F.regexp_extract(text, r"(?s)^((?:\s*<[?!][^>]*>)*\s*)", 1)


def after_preamble(text: Column) -> Column:
    return F.substring(text, F.length(preamble(text)) + 1, F.length(text))


def attributes(tag: Column) -> Column:
    """The attributes of an opening tag with a leading space, '' if none."""
    return F.regexp_extract(tag, r"(?s)^<[A-Za-z_][A-Za-z0-9_.:-]*(\s.*?)?\s*/?>$", 1)


def trimmed_start(text: Column, start: Column, end: Column) -> Column:
    """start moved past blanks; end, if all is blank."""
    inner = F.substring(text, start + 1, end - start)
    return start + F.length(inner) - F.length(F.regexp_replace(inner, rf"^{BLANK}+", ""))


def trimmed_end(text: Column, start: Column, end: Column) -> Column:
    inner = F.substring(text, start + 1, end - start)
    kept = F.length(F.regexp_replace(inner, rf"{BLANK}+$", ""))
    return F.when(kept == 0, end).otherwise(start + kept)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points."""
    return F.substring(text, start + 1, end - start)
