"""What descriptions, pages and messages say, as Column expressions."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of DOIs, journal names and page metadata; keywords of collections; suffixes of script links.
DOI = r"(?U)10\.\d{4,}/[^\s]+"
JOURNALS = (
    r"(?U)journal of [\w\s&]+", r"(?U)proceedings of [\w\s&]+", r"(?U)nature[\w\s]*", r"(?U)science[\w\s]*", r"(?U)cell[\w\s]*", r"(?U)plos [\w\s]+", r"(?U)jama[\w\s]*",
    "nejm", "psychological science", "american economic review", "quarterly journal of economics", "journal of political economy", "review of economic studies", "econometrica",
)
PUBLISHED_IN = r"published in ([^.;,\n]+)"
COLLECTION_WORDS = ("journal", "publication", "manuscript", "article", "review", "proceedings", "conference", "society", "press", "publisher")
AUTHOR = r"(?iU)author[s]?[:\s]+([^<>\n]+)"
JOURNAL = r"(?iU)journal[:\s]+([^<>\n]+)"
LINK_SUFFIXES = (".r", ".py", ".do", ".ipynb", ".m", ".sas")


def dois(*texts: Column) -> Column:
    """Distinct DOIs, in order; nulls count as empty."""
    return F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)), F.lit(DOI), F.lit(0)))


def title_case(text: Column) -> Column:
    """Upper case after every character that isn't a letter."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")


def journal_names(text: Column) -> Column:
    """Distinct journal names that a text may mention."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tidy = lambda x: title_case(F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))
    named = F.filter(F.transform(F.concat(*(F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in JOURNALS)), tidy), lambda x: F.length(x) > 5)
    published = F.filter(F.transform(F.regexp_extract_all(low, F.lit(PUBLISHED_IN), F.lit(1)), tidy), lambda x: (F.length(x) > 5) & (F.length(x) < 100))
    return F.array_distinct(F.concat(named, published))


def is_journal_collection(title: Column, description: Column) -> Column:
    words = "|".join(COLLECTION_WORDS)
    return F.coalesce(F.lower(title).rlike(words), F.lit(False)) | F.coalesce(F.lower(description).rlike(words), F.lit(False))


def error_status(message: Column) -> Column:
    """First hit wins."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *some: F.greatest(*(F.contains(low, F.lit(s)) for s in some))
    return F.when(has("403", "forbidden"), "forbidden").when(has("404", "not found"), "not_found").when(has("timeout", "connection"), "connection_error").otherwise("error")


def unlisted(text: Column) -> Column:
    """A stringified list without brackets and without the quotes at its ends."""
    return F.regexp_replace(F.translate(text, "[]", ""), "^'+|'+$", "")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_author(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, AUTHOR, 1))


def page_journal(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, JOURNAL, 1))


def page_links(html: Column) -> Column:
    """Targets of all links, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def download_count(links: Column) -> Column:
    return F.size(F.filter(links, lambda x: F.contains(x, F.lit("download"))))


def script_links(links: Column, compat: bool = False) -> Column:
    """Links to scripts, by suffix. compat: one entry for each suffix that occurs anywhere in the link."""
    ends = F.array(*(F.lit(e) for e in LINK_SUFFIXES))
    if compat:
        return F.flatten(F.transform(ends, lambda e: F.filter(links, lambda x: F.contains(F.lower(x), e))))
    return F.filter(links, lambda x: F.exists(ends, lambda e: F.endswith(F.lower(F.regexp_replace(x, r"[?#].*$", "")), e)))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


#: Stands after an ampersand that begins no whole reference; no character, by Unicode.
_MARK = "\ufdd0"
_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z0-9]+;)?")


def plain_text(html: str | None, strict: bool = False) -> str | None:
    """The text content of HTML. A reference without its semicolon is read as browsers read it; strict: it stays as written."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(_REFERENCE.sub(lambda m: m[0] if m[1] in html5 else f"&{_MARK}{m[1] or ''}", html) if strict else html)
    parser.close()
    found = "".join(parser.parts)
    return found.replace(f"&{_MARK}", "&") if strict else found


def html_text(html: Column, strict: bool = False) -> Column:
    """Text content of a piece of HTML; a parser is needed for entities and broken tags."""

    @F.pandas_udf(T.StringType())
    def parsed(h: pd.Series) -> pd.Series:
        return h.map(lambda x: plain_text(x, strict), na_action="ignore")

    return parsed(html)
