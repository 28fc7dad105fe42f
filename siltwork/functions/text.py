"""Column expressions over text: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The boilerplate of newsletters. (?d) keeps \n the only line end, (?m) makes ^ and $ match at lines.
VIEW_ON_WEB = r"(?imd)^.*view this (?:post|email) (?:on the web|in your browser).*$"
CANONICAL = r"(?i)view this (?:post|email) on the web at\s+(\S+)"
REDIRECT = r"(?i)\s*\[\s*https?://[^\]]*?(?:/redirect/|redirect\?|/CL0/|list-manage|click\.|/track|utm_)[^\]]*\]"
UNSUBSCRIBE = r"(?imd)^.*(?:unsubscribe|manage your subscription|update your preferences|©\s*\d{4}).*$"
TITLE_CHARS = 120


#: White space that is stripped: what ``\\s`` stands for.
BLANKS = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.btrim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """Null in place of an empty text, for fallback chains in which both count as missing."""
    return F.nullif(c, F.lit(""))


def canonical_url(c: Column) -> Column:
    """The link that a "view on the web" line gives, or null."""
    return filled(F.regexp_extract(c, CANONICAL, 1))


def without_boilerplate(c: Column) -> Column:
    """A newsletter without its web-view, redirect and unsubscribe boilerplate, with at most one blank line in a row."""
    # Looking back keeps a long run of blanks from being tried from each of its places; a text without the words of a
    # pattern is not searched for its lines.
    for pattern, words in ((VIEW_ON_WEB, "view this"), (REDIRECT.replace(r"\s*", r"(?<!\s)\s*", 1), "http"), (UNSUBSCRIBE, None)):
        hint = F.contains(F.lower(c), F.lit(words)) if words else c.rlike(r"(?i)unsubscribe|manage your subscription|update your preferences|©")
        c = F.when(hint, F.regexp_replace(c, pattern, "")).otherwise(c)
    c = F.regexp_replace(c, r"(?<![ \t])[ \t]+\n", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def lines(c: Column) -> Column:
    """The stripped lines of a text that are not blank."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def title(text: Column, url: Column | None = None) -> Column:
    """The first line that is not blank, else the link, cut to 120 characters."""
    first = F.try_element_at(lines(text), F.lit(1))
    return F.substring(F.coalesce(first, url) if url is not None else first, 1, TITLE_CHARS)


def html_to_text(c: Column) -> Column:
    """The text of simple markup: scripts and tags removed, references resolved, runs of blanks joined."""
    for pattern, new in (
        (r"(?is)<script.*?</script>", ""),
        (r"(?is)<style.*?</style>", ""),
        (r"(?i)</?(?:p|div|br|li|tr|h[1-6]|blockquote|hr)\b[^>]*>", "\n"),
        (r"<[^>]*>", ""),
        ("&nbsp;", " "),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&amp;", "&"),
        (r"[ \t]+", " "),
        (r" ?\n[ \n]*", "\n"),
    ):
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def body(text: Column, html: Column) -> Column:
    """The plain part of a message, else the text of its markup, else an empty text."""
    return F.coalesce(filled(strip(text)), html_to_text(html), F.lit(""))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever the case of its name, also if it stands there in two cases."""
    values = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(F.try_element_at(values, F.lit(1))["value"], F.lit(1))


def slug(c: Column) -> Column:
    """Lower-case letters and digits with single hyphens between them; 'entity' if none is left."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.coalesce(filled(F.regexp_replace(s, "^-+|-+$", "")), F.lit("entity"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def raw_key(digest: Column, filename: str) -> Column:
    """Where an artifact's file lies in the content-addressed store."""
    return F.concat_ws("/", F.lit("sha256"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest, F.lit(filename))


def decoded(c: Column) -> Column:
    """Bytes as text, bad sequences replaced."""
    return F.make_valid_utf8(c.cast("string"))
