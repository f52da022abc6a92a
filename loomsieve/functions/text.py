"""Text expressions: titles, identifiers, markup, token sets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unwrapped(text: Column) -> Column:
    """Without outer braces and double quotes, however many there are around one another."""
    once = lambda t, _: F.trim(F.regexp_replace(t, r'(?s)^\{(.*)\}$|^"(.*)"$', "$1$2"))
    # Each layer has an opening sign, so there are no more layers than such signs at the start.
    signs = F.length(F.regexp_extract(text, r'^[\s{"]+', 0))
    return F.when(text.rlike(r'^\s*[{"]'), F.aggregate(F.sequence(F.lit(1), signs), F.trim(text), once)).otherwise(F.trim(text))


#: TeX escapes and signs with a fixed spelling in normalized titles, replaced in this order.
TEX_SPELLING = ((r"\&", " and "), (r"\%", " percent "), (r"\_", " "), (r"\#", " "), (r"\$", " "), (r"\{", ""), (r"\}", ""), ("~", " "), ("@", " at "), ("&", " and "))


def normalized_title(text: Column, fold: bool = False) -> Column:
    """Lower-case ASCII words between single spaces; null counts as empty.

    ``fold`` first decomposes accented letters (by a vectorised function, since there is no built-in one); without it
    they separate words.
    """
    out = unwrapped(F.coalesce(text, F.lit("")))
    for needle, spelling in TEX_SPELLING:
        out = F.replace(out, F.lit(needle), F.lit(spelling))
    out = F.regexp_replace(out, r"\\[a-zA-Z]+\*?(\[[^\]]*\])?", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\$", " "), r"[{}]", "")
    if fold:
        out = ascii_folded()(out)
    return F.trim(F.regexp_replace(F.lower(out), "[^a-z0-9]+", " "))


def ascii_folded():
    def fold(batch: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in batch.to_pylist()], pa.string())

    return F.arrow_udf(fold, "string")


def main_title(text: Column, least: int = 12) -> Column:
    """What stands before the first colon or spaced dash, where that is long enough."""
    head = F.trim(F.regexp_extract(text, r"^(.*?)(:| - | – | — )", 1))
    return F.when(F.length(head) >= least, head).otherwise(text)


def key_slug(text: Column, keep_case: bool = False) -> Column:
    out = text if keep_case else F.lower(text)
    return F.regexp_replace(F.regexp_replace(out, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def normalized_key(text: Column) -> Column:
    """Letters and digits only, for lookups that tolerate spelling of keys."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def doi(text: Column) -> Column:
    """The first DOI of a text, lower-case and without trailing punctuation; null if there is none."""
    found = F.regexp_extract(F.lower(text), r"(10\.\d{4,9}/[^\s\"<>{}]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"[.,;:)\]]+$", ""))


def arxiv_id(text: Column) -> Column:
    """``YYMM.number`` of an arXiv URL or mention, without version; null if there is none."""
    found = F.regexp_extract(F.lower(text), r"arxiv(?:\.org/(?:abs|pdf)/|:\s*)(\d{4}\.\d{4,5})", 1)
    return F.when(found != "", found)


def last_year(text: Column) -> Column:
    """The last 19xx or 20xx of a text, also inside longer numbers."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"((?:19|20)\d{2})"), 1), F.lit(-1)).cast("int")


def stripped_tags(html: Column) -> Column:
    """Without tags, the five common entities resolved, white space squeezed."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return squeeze(out)


def first_match(text: Column, patterns: Iterable[str], accept=lambda found: found != "") -> Column:
    """The first group of the first pattern whose match is accepted."""
    found = [F.regexp_extract(text, p, 1) for p in patterns]
    return F.coalesce(*(F.when(accept(f), f) for f in found))


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct normalized words of at least so many letters."""
    return F.array_distinct(F.filter(F.split(normalized_title(text), " "), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / either)


def tokens_agree(a: Column, b: Column, least: int = 2) -> Column:
    """Enough shared tokens; texts with fewer than three expected tokens agree with anything."""
    return (F.size(a) < 3) | (F.size(F.array_intersect(a, b)) >= least)


def head_tail(text: Column, head: int, tail: int, marker: str = "\n...\n") -> Column:
    return F.when(F.length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail)))).otherwise(text)


REFERENCES = r"(?mi)^[ \t]*(references|bibliography):*[ \t]*$"


def before_references(text: Column) -> Column:
    """The text before the first line that is only a references heading."""
    at = F.regexp_instr(text, F.lit(REFERENCES))
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def filled(template: str, values: dict[str, Column]) -> Column:
    """``{{NAME}}`` placeholders replaced; a null value gives an empty text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def missing_placeholders(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{([A-Z_]+)\}\}"), 1)))


def from_inverted_index(index: Column) -> Column:
    """Words put back to their positions, from map<word, array<position>>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def printable_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\p{C}", "")) / F.nullif(F.length(text), F.lit(0))


def collapsed_blank_lines(text: Column) -> Column:
    """LF line ends, no trailing white space in lines, runs of blank lines as one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t]+(?=\n|$)", ""), "\n{3,}", "\n\n")


def without_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*\n|\n?```$", ""))


def substituted(text: Column, changes: dict[str, str]) -> Column:
    """All of the spellings replaced, in the order given; what a change puts in is seen by those after it."""
    for old, new in changes.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def surname(author: Column) -> Column:
    """Before a comma, else the last word."""
    a = squeeze(author)
    return F.when(a.contains(","), F.trim(F.substring_index(a, ",", 1))).otherwise(F.substring_index(a, " ", -1))


def _attribute(tag: Column, names: str) -> Column:
    """The value of a tag's attribute, in quotes of either kind; null where it has none."""
    pattern = rf"(?is)\b(?:{names})\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return F.when(tag.rlike(pattern), F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2)))


def meta_tags(html: Column) -> Column:
    """map<name, array<content>> of a page's meta tags, in order of appearance; names and contents squeezed. Attributes
    may stand in any order and in quotes of either kind."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0)
    pairs = F.transform(tags, lambda t: F.struct(squeeze(_attribute(t, "name|property")).alias("k"), stripped_tags(_attribute(t, "content")).alias("v")))
    clean = F.filter(pairs, lambda p: (F.coalesce(p["k"], F.lit("")) != "") & p["v"].isNotNull())
    names = F.array_distinct(F.transform(clean, lambda p: p["k"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.transform(F.filter(clean, lambda p: p["k"] == n), lambda p: p["v"]))))


def _named(tags: Column, names: tuple[str, ...]) -> list[Column]:
    """The first content of each of the names, whatever their case."""
    lower = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.map_keys(tags), F.lower)), lambda k: F.struct(k, F.filter(F.map_entries(tags), lambda e: F.lower(e["key"]) == k)[0]["value"][0])))
    return [F.try_element_at(lower, F.lit(n)) for n in names]


#: Where pages say their abstract and their title (fixed names and marks), best first.
ABSTRACT_NAMES = ("citation_abstract", "og:description", "description", "dc.description", "dc.description.abstract")
ABSTRACT_MARKS = (
    r'(?is)<div[^>]*id="Abst"[^>]*>(.*?)</div>\s*</div>',
    r'(?is)<(?:section|div)[^>]*id="abstract"[^>]*>(.*?)</(?:section|div)>',
    r'(?is)<(?:section|div)[^>]*class="[^"]*abstract[^"]*"[^>]*>(.*?)</(?:section|div)>',
)
TITLE_NAMES = ("citation_title", "og:title")


def page_abstract(html: Column, least: int = 30) -> Column:
    """The first long enough description of a page: a meta tag's, else an element marked as the abstract. Where none is
    long enough, the last one that isn't empty."""
    found = [*_named(meta_tags(html), ABSTRACT_NAMES), *(stripped_tags(F.regexp_extract(html, p, 1)) for p in ABSTRACT_MARKS)]
    fit = [F.when((F.length(c) >= least) & ~F.lower(c).startswith("no abstract"), c) for c in found]
    return F.coalesce(*fit, *(F.nullif(c, F.lit("")) for c in reversed(found)))


def page_title(html: Column) -> Column:
    """A page's title: a meta tag's, else the title element's; null where all are empty."""
    found = [*_named(meta_tags(html), TITLE_NAMES), stripped_tags(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))]
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in found))
