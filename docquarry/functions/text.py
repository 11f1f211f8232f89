"""Column functions on text: tokens, sentences, breadcrumbs, slugs, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters as Unicode has them; Java's and RE2's \w are ASCII only.
TERM = r"[\p{L}\p{N}_]+"
#: White space as Python's str.strip and \s have it, in Java's dialect.
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"
#: Spaces alone, without tabs and line breaks, as SQL's trim has them.
BLANK = r"\p{Zs}"
#: A mark between sentences that texts don't contain.
MARK = "\x1f"


def stripped(c: Column) -> Column:
    """c without leading and trailing white space."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def trimmed(c: Column) -> Column:
    """c without leading and trailing spaces."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def terms(c: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def token_estimate(c: Column) -> Column:
    """Estimated tokens: 0 for an empty or null text, else characters / 3.8, at least 1."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(3.8)))).cast("int")


def sentences(c: Column) -> Column:
    """Sentences: a text is cut at white space after . ! ? and before a capital, a digit, a mark or a dash; parts are
    stripped and empty ones dropped. A text without others is its own sentence."""
    cut = F.regexp_replace(c, rf"([.!?]){SPACE}+(?=[A-Z0-9✓✗•\-])", f"$1{MARK}")
    parts = F.filter(F.transform(F.split(cut, MARK), stripped), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def title_case(c: Column) -> Column:
    """Every letter that follows no letter in upper case, others in lower case (v2x gives V2X)."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def breadcrumb(doc_name: Column, section: Column, page: Column) -> Column:
    """[Document: Title | Section: s or Overview | Page: n]"""
    name = title_case(F.regexp_replace(F.regexp_replace(doc_name, r"\.pdf", ""), "_", " "))
    sec = F.when(F.coalesce(section, F.lit("")) == "", "Overview").otherwise(stripped(section))
    return F.format_string("[Document: %s | Section: %s | Page: %d]", name, sec, page)


def stem(doc_name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(doc_name, r"(?<=.)\.[^.]*$", "")


def parent_id(doc_name: Column, section: Column) -> Column:
    """Stem of the document and a slug of the section: lower case, 40 characters, other than word characters and - as _."""
    slug = F.btrim(F.substring(F.regexp_replace(F.lower(section), r"[^\p{L}\p{N}_\-]", "_"), 1, 40), F.lit("_"))
    return F.concat(stem(doc_name), F.lit("_s_"), slug)


def concise_section(path: Column, bare: Callable[[Column], Column] = stripped) -> Column:
    """The last two levels of a section path, without tables of contents; General if none is left. bare: what a level is
    without the white space around it."""
    parts = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), ">"), lambda p: bare(p)), lambda p: (p != "") & ~F.lower(p).isin("table of contents", "document"))
    return F.when(F.size(parts) == 0, "General").otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), " > "))


def concise_snippet(raw: Column, most: int = 160) -> Column:
    """A text without leading breadcrumbs, white space collapsed, cut at the last space within `most` characters and ..."""
    # The two patterns of breadcrumbs, with white space as Python has it.
    text = F.regexp_replace(stripped(raw), rf"^\([^)]*?>[^)]*?\){SPACE}*", "")
    text = F.regexp_replace(text, rf"^([A-Za-z0-9_.\s\x1C-\x1F\x85\p{{Z}}-]+{SPACE}*>{SPACE}*)+", "")
    text = stripped(F.regexp_replace(text, rf"{SPACE}+", " "))
    head = F.substring(text, 1, most)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def citation_label(doc_name: Column, page: Column, section: Column) -> Column:
    """[doc, p.N - section]"""
    return F.format_string("[%s, p.%d - %s]", doc_name, page, section)


def keywords(question: Column, n: int = 5) -> Column:
    """The first n words of over three characters, the plain rewrite of a question."""
    words = F.filter(F.split(stripped(question), rf"{SPACE}+"), lambda w: F.length(w) > 3)
    return F.array_join(F.slice(words, 1, n), " ")
