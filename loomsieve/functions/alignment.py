"""Whether a text read from a page belongs to a record's metadata."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F


def _clean(t: str | None) -> str:
    return re.sub(r"\s+", " ", (t or "").strip().strip("{}\"' "))


def _plain(t: str | None) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", _clean(t)).lower()).split())


def _main(title: str | None) -> str:
    t = _clean(title)
    heads = (t.split(sep, 1)[0].strip() for sep in (":", " - ", " – ", " — ") if sep in t)
    return next((h for h in heads if len(h) >= 12), t)


def judged(title: str | None, abstract: str | None, page_title: str | None, page_text: str | None) -> tuple[str, str]:
    """Verdict (match, uncertain, mismatch) and its reason, by containment of titles only."""
    full, main, head, page = _plain(title), _plain(_main(title)), _plain(page_title), _plain(page_text)
    if full and full in page:
        note = "full_title_found_in_first_page"
    elif len(main) >= 12 and main in page:
        note = "main_title_found_in_first_page"
    elif full and head and (full in head or head in full):
        note = "title_header_consistent"
    elif main and head and (main in head or head in main):
        note = "main_title_header_consistent"
    else:
        return "mismatch", "title_not_consistent_with_metadata"
    if _clean(abstract) and len(page) < 60:
        return "uncertain", "first_page_text_too_short_for_topic_check"
    return "match", note


def compatible(t: str | None) -> str:
    """Compatibility forms, lower case, single spaces; signs stay."""
    return " ".join(unicodedata.normalize("NFKC", t or "").lower().split())


def likeness(a: str | None, b: str | None) -> float:
    """Half the ratio of matching blocks, half the share of a's words that b has; 0 where either is empty."""
    a, b = compatible(a), compatible(b)
    if not a or not b:
        return 0.0
    words = set(a.split())
    return 0.5 * SequenceMatcher(None, a, b).ratio() + 0.5 * len(words & set(b.split())) / len(words)


def judge_match():
    """A function of title, abstract, page title and page text."""

    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (a, b, c, d)), strict=True)
        return pa.array([dict(zip(("verdict", "reason"), judged(*r))) for r in rows], pa.struct([("verdict", pa.string()), ("reason", pa.string())]))

    return F.arrow_udf(run, "struct<verdict:string,reason:string>")


def abstract_similarity():
    """A function of the metadata's abstract and the page's."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([likeness(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")


def compatible_text():
    """A function of a text: ``compatible`` of it; null stays."""

    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if t is None else compatible(t) for t in a.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def compared(prefix: int):
    """A function of the metadata's title and abstract and the page's: whether the titles are equal, whether the page's
    abstract holds the first ``prefix`` letters of the other, and how alike the abstracts are. Null titles give null."""

    def one(title: str | None, abstract: str | None, page_title: str | None, page_abstract: str | None):
        if title is None:
            return None
        own, other = compatible(abstract), compatible(page_abstract)
        return {"title": compatible(title) == compatible(page_title), "prefix": bool(own) and own[:prefix] in other, "similarity": likeness(abstract, page_abstract)}

    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        rows = [one(*r) for r in zip(*(x.to_pylist() for x in (a, b, c, d)), strict=True)]
        return pa.array(rows, pa.struct([("title", pa.bool_()), ("prefix", pa.bool_()), ("similarity", pa.float64())]))

    return F.arrow_udf(run, "struct<title:boolean,prefix:boolean,similarity:double>")
