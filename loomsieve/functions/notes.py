"""Free-text bibliography notes to fields: a vectorised function, since the order of a note's parts has to be guessed.

A note is cut into sentences. Each is judged as authors, title, venue or metadata by its shape; the title is the first
sentence after the authors that is none of the others, and the reason says how it was found.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("title", "reason", "author", "journal", "volume", "number", "pages", "year")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)
LONGEST_TITLE = 180

_BRACKETS = re.compile(r"\[[^\]]*\]")
_URL = re.compile(r"(?:https?://|www\.)\S+|\bdoi:\s*\S+", re.I)
_YEAR = re.compile(r"(?:19|20)\d{2}")
_ET_AL = re.compile(r"\bet\s+al\b\.?[\s,;:]*", re.I)
_INITIALS = re.compile(r"^(?:[A-Z]\.[- ]?)+$")
_NAME = re.compile(r"^(?:(?:van|von|de|der|den|di|da|la|le)\s+)*[A-ZÀ-Þ][\w'’-]+(?:\s+(?:[A-Z]\.?[- ]?)+|,?\s+[A-ZÀ-Þ][\w'’-]+)?$")
#: Surnames with initials, one after the other, at the head of a note.
_LEAD = re.compile(r"(?:[A-ZÀ-Þ][\w'’-]+,?\s+(?:(?:[A-Z]\.[- ]?){1,3}|[A-Z]{1,3}\b[.]?)\s*(?:[,;]\s*)?(?:(?:and|&)\s+)?)+(?=[A-ZÀ-Þ\"“(])")
_VENUE = re.compile(r"\b(?:journal|proceedings|proc|transactions|trans|conference|symposium|workshop|letters|review|press|arxiv|preprint|magazine|annals)\b", re.I)
_LOCATOR = re.compile(r"(?P<volume>\d+)\s*(?:\((?P<number>[\w-]+)\))?\s*[:,]\s*(?:pp?\.?\s*)?(?P<pages>\d+\s*[-–—]+\s*\d+)")
_PAGES = re.compile(r"\bpp?\.?\s*(\d+\s*[-–—]+\s*\d+)", re.I)
_NO_TITLE = re.compile(r"^(?:pp?\.?|pages?|vol\.?|no\.?|accessed|available|retrieved|pmid|doi|in:)\b|^[\d\s().,:;–—-]*$", re.I)


def _sentences(note: str) -> list[str]:
    """Cut at full stops that end a word of more than one letter, so that initials hold together."""
    parts = re.split(r"(?:(?<=[^\s.]{2})|(?<=\d))[.?!]\s+(?=[A-ZÀ-Þ0-9\"“]|arXiv)|(?<=\))[.]\s+", note)
    return [p.strip(" .;") for p in parts if p and p.strip(" .;")]


def _is_author_list(part: str) -> bool:
    names = [n.strip(" .") for n in re.split(r",\s+and\s+|,?\s+&\s+|\s+and\s+|;\s*|,\s+", part) if n.strip(" .")]
    if not names or len(part) > 300 or _VENUE.search(part):
        return False
    fits = sum(bool(_NAME.match(n) or _INITIALS.match(n + ".") or _INITIALS.match(n)) and len(n.split()) <= 4 for n in names)
    many = len(names) > 1 or any(_INITIALS.match(w if w.endswith(".") else w + ".") for w in part.split()[1:])
    return many and fits / len(names) > 0.7


def parse(note: str | None) -> dict[str, str]:
    out = dict.fromkeys(FIELDS, "")
    if not note or not note.strip():
        return out | {"reason": "missing_note"}
    text = " ".join(_URL.sub(" ", _BRACKETS.sub(" ", note)).split())
    if not text.strip(" ."):
        return out | {"reason": "empty_after_cleanup"}
    if years := _YEAR.findall(text):
        out["year"] = years[-1]
    if m := _LOCATOR.search(text):
        out |= {k: re.sub(r"\s*[-–—]+\s*", "-", v) for k, v in m.groupdict("").items()}
    elif m := _PAGES.search(text):
        out["pages"] = re.sub(r"\s*[-–—]+\s*", "-", m[1])
    head = re.split(r"\b[Ii]n:\s+", text, maxsplit=1)[0]
    if m := _ET_AL.search(head):
        authors, rest = head[: m.end()].strip(" ,;:"), _sentences(head[m.end() :])
    elif m := _LEAD.match(head):
        authors, rest = m[0].strip(" ,;"), _sentences(head[m.end() :])
    else:
        rest = _sentences(head)
        led = bool(rest) and _is_author_list(rest[0])
        authors = rest.pop(0) if led and len(rest) > 1 else ""
    out["author"] = authors
    for k, part in enumerate(rest):
        title = re.sub(r"\s*\(?\b(?:19|20)\d{2}\)?$", "", part).strip(" .,\"“”")
        if len(title) < 4 or _NO_TITLE.match(title) or (k and _VENUE.search(title)) or (_is_author_list(title) and k + 1 < len(rest)):
            continue
        out["title"] = title[:LONGEST_TITLE]
        out["reason"] = "from_after_authors" if authors else "from_first_segment" if k == 0 else "from_later_weak"
        for venue in rest[k + 1 :]:
            if not _NO_TITLE.match(venue):
                out["journal"] = re.sub(r"[\s,]*(?:\(?\b(?:19|20)\d{2}\)?|\d+\s*(?:\([^)]*\))?\s*[:,].*|vol\..*|pp?\..*)$", "", re.split(r",?\s+\d", venue)[0]).strip(" ,.;")
                break
        return out
    return out | {"reason": "fallback_prefix"}


def parsed(note: Column) -> Column:
    """struct of title, reason, author, journal, volume, number, pages and year; empty texts where nothing was found."""

    def run(batch: pa.Array) -> pa.Array:
        rows = [parse(t) for t in batch.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[f] for r in rows], pa.string()) for f in FIELDS], list(FIELDS))

    return F.arrow_udf(run, SCHEMA)(note)


def confidence(title: Column, author: Column, reason: Column, looked_up: Column) -> Column:
    """struct(title, author, review) of two confidences and whether a person should look.

    A looked-up title whose reason says it came from a segment counts as a local one of that kind; that is intended.
    """
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    base = F.when(looked_up, 0.9).otherwise(0.65)
    t = F.when(~has(title), 0.0).when(reason.isin("from_after_authors", "from_title_repair"), F.greatest(F.lit(0.75), base)).when(reason.startswith("from_"), 0.6).otherwise(base)
    a = F.when(~has(author), 0.2).when(looked_up, 0.85).otherwise(0.55)
    review = (~looked_up & ((t < 0.6) | (a < 0.5))) | (~has(title) & ~has(author))
    return F.struct(t.alias("title"), a.alias("author"), review.alias("review"))
