"""Expressions over candidate records: states, identifiers, titles and authors under their several names, nested fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsieve.functions import text

#: Sources that stand for no source at all.
NO_SOURCE = ("", "missing", "none", "null")


def filled(value: Column) -> Column:
    """Squeezed text; null for blank text."""
    return F.nullif(text.squeeze(value.cast("string")), F.lit(""))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*map(filled, values))


def record_key(key: Column, nested: Column | None = None) -> Column:
    """A row's own key, else that of its nested record, trimmed; null where both are blank."""
    own = F.nullif(F.trim(key.cast("string")), F.lit(""))
    return own if nested is None else F.coalesce(own, F.nullif(F.trim(nested.cast("string")), F.lit("")))


def is_missing(present: Column, source: Column, match_status: Column) -> Column:
    """Whether a record is absent, was found nowhere, or names no source."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return ~present | (low(match_status) == "missing") | low(source).isin(*NO_SOURCE)


def source_token(source: Column) -> Column:
    return F.replace(F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lit("-"), F.lit("_"))


def allowed_source(source: Column, wanted: str | None) -> Column:
    """Whether a source is on a comma-separated list (all are where there is none). A blank source always is; ``manual``
    only if it is named."""
    names = {n.strip().lower().replace("-", "_") for n in (wanted or "").split(",") if n.strip()}
    return F.lit(True) if wanted is None else source_token(source).isin("", *names)


def without_version(arxiv_id: Column) -> Column:
    return F.regexp_replace(arxiv_id, r"(?i)v\d+$", "")


_ARXIV = r"(?:\d{4}\.\d{4,5}|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?"


def arxiv_of(*values: Column) -> Column:
    """The arXiv identifier of the first value that has one: in an address, after the word, standing alone, or anywhere in a text
    that names arXiv; no version."""

    def one(value: Column) -> Column:
        t = F.coalesce(text.squeeze(value), F.lit(""))
        found = [F.regexp_extract(t, p, 1) for p in (rf"(?i)arxiv\.org/(?:abs|pdf)/({_ARXIV})", rf"(?i)arxiv\s*:?\s*({_ARXIV})", rf"(?i)^({_ARXIV})$")]
        found.append(F.when(F.lower(t).contains("arxiv"), F.regexp_extract(t, rf"(?i)({_ARXIV})", 1)))
        return F.coalesce(*(F.nullif(f, F.lit("")) for f in found))

    return without_version(F.coalesce(*map(one, values)))


def doi_of(value: Column) -> Column:
    """The DOI of a value without resolver, prefix, brackets and closing punctuation, lower-case; null if it has none."""
    found = F.regexp_extract(F.regexp_replace(text.squeeze(value), r"^[{}()\[\]]+|[{}()\[\]]+$", ""), r"(?i)(10\.\d{4,9}/[^\s\"'<>]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"[.,;: ]+$", "")), F.lit(""))


def ids_of(values: list[Column], extract) -> Column:
    """The distinct identifiers that ``extract`` finds in several places of a record, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*map(extract, values)))))


def published_year(value: Column, latest: Column) -> Column:
    """The year of a published date, which is ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``; null for other texts, for a month or day
    that no calendar has, and for years before 1800 or after ``latest``."""
    t = F.coalesce(text.squeeze(value.cast("string")), F.lit(""))
    part = lambda k: F.regexp_extract(t, r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$", k)
    within = lambda c, low, high: (c == "") | c.try_cast("int").between(low, high)
    return F.when(part(1).try_cast("int").between(F.lit(1800), latest) & within(part(2), 1, 12) & within(part(3), 1, 31), part(1))


def year_of(value: Column) -> Column:
    """The first 19xx or 20xx; null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"((?:19|20)\d{2})", 1), F.lit(""))


#: The entities that a title, name or key is likely to hold (fixed values); the ampersand comes last.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def tex_cleaned(value: Column, brace: str = "") -> Column:
    """Plain text of a TeX one: commands give their argument or a space, braces ``brace``, no quotes at the ends."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for entity, sign in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    out = F.replace(out, F.lit('\\"'), F.lit('"'))
    out = F.regexp_replace(F.regexp_replace(out, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1"), r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " ")
    out = F.replace(F.replace(F.regexp_replace(out, r"[{}]", brace), F.lit("\\_"), F.lit("_")), F.lit("\\"), F.lit(" "))
    return F.trim(F.regexp_replace(text.squeeze(out), '^"+|"+$', ""))


def first_surname(authors: Column) -> Column:
    """The lower-case surname of the first of several authors (between semicolons or the word and), without TeX."""
    first = F.trim(F.get(F.split(tex_cleaned(authors), r"(?i);|\band\b", 2), F.lit(0)))
    last = F.when(first.contains(","), F.trim(F.substring_index(first, ",", 1))).otherwise(F.substring_index(text.squeeze(first), " ", -1))
    return F.nullif(F.lower(last), F.lit(""))


def emitted_key(source_file: Column, key: Column) -> Column:
    """A key that is unique over files: the file's stem and the key without TeX, each of letters, digits and ``. _ -`` only."""
    stem = F.regexp_replace(F.regexp_extract(source_file, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    safe = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(tex_cleaned(c), "[^A-Za-z0-9._-]+", "_"), "_+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit("unknown"))
    return F.concat(safe(stem), F.lit("__"), safe(key))


def entry_title(query_title: Column, local_title: Column) -> Column:
    """An entry's query title, else that of its raw record; empty where both are."""
    return F.coalesce(F.nullif(query_title, F.lit("")), F.nullif(local_title, F.lit("")), F.lit(""))


#: Fields of a raw record in which identifiers may stand (fixed names).
CANDIDATE_FIELDS = ("journal", "note", "howpublished", "url", "doi")


def candidate_strings(local: Column) -> Column:
    """What a raw record (a struct with those fields) has in them, in that order."""
    return F.array_compact(F.array(*(local.getField(n) for n in CANDIDATE_FIELDS)))


def raw_title(blob: Column) -> Column:
    """The title that a raw entry states: a marked article title, a ``title = `` line, or such a pair anywhere."""
    b = F.replace(F.replace(blob, F.lit("\\{"), F.lit("{")), F.lit("\\}"), F.lit("}"))
    line = F.regexp_replace(F.regexp_extract(b, r"(?im)^\s*title\s*=\s*(.+?)\s*(?:,|$)", 1), r'^"(.*)"$', "$1")
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[{}]", ""), r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", ""), r"^,+|,+$", "")
    pair = F.concat(F.regexp_extract(b, r'(?is)\btitle\s*=\s*(?:\{(.*?)\}|"(.*?)")', 1), F.regexp_extract(b, r'(?is)\btitle\s*=\s*(?:\{(.*?)\}|"(.*?)")', 2))
    return first_filled(F.regexp_extract(b, r"(?is)showarticletitle\s*\{([^}]*)\}", 1), plain(line), F.regexp_replace(pair, r'^"|"$', ""))


def pick_title(candidates: list[Column], fallback: Column, least: int = 3) -> Column:
    """The first candidate of at least so many letters, TeX cleaned away; else the fallback."""
    clean = lambda c: filled(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1"), r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " "), r'[{}\\"]', ""))
    found = F.array_compact(F.array(*map(clean, candidates)))
    return F.coalesce(F.get(F.filter(found, lambda c: F.length(c) >= least), F.lit(0)), clean(fallback), fallback)


# --- nested records --------------------------------------------------------------------------------------------


def pruned(value: Column, kind: T.DataType, drop: str = "reference") -> Column:
    """The value without list-valued fields of that name, at any depth; its type says where they are."""
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if not (f.name == drop and isinstance(f.dataType, T.ArrayType))]
        return F.when(value.isNotNull(), F.struct(*(pruned(value.getField(f.name), f.dataType, drop).alias(f.name) for f in kept)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda x: pruned(x, kind.elementType, drop))
    return value


#: Fields that are left out of what a source says (fixed names).
HEAVY_FIELDS = {"openalex": ("abstract_inverted_index", "referenced_works"), "crossref": ("assertion", "link", "license")}


def light(source: Column, metadata: Column, kind: T.StructType) -> Column:
    """Metadata without reference lists, and without the heavy fields of its source, which become null."""
    slim = pruned(metadata, kind)
    names = [f.name for f in kind.fields if not (f.name == "reference" and isinstance(f.dataType, T.ArrayType))]
    low = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    heavy = lambda name: low.isin(*(s for s, fields in HEAVY_FIELDS.items() if name in fields)) if any(name in f for f in HEAVY_FIELDS.values()) else F.lit(False)
    return F.when(metadata.isNotNull(), F.struct(*(F.when(~heavy(n), slim.getField(n)).alias(n) for n in names)))


def contract(fields: dict[str, Column | None], columns: list[str]) -> list[Column]:
    """A fixed list of columns: what is given under its name, null for what isn't."""
    return [(fields[c] if fields.get(c) is not None else F.lit(None).cast("string")).alias(c) for c in columns]


def forbidden(payload: Column, names: list[str]) -> Column:
    """Which of the names are keys of a JSON object, sorted."""
    return F.array_sort(F.array_intersect(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*map(F.lit, names))))


def with_steps(steps: Column, new: list[str]) -> Column:
    """A list of steps with each of the new ones at its end, if it isn't there yet."""
    return F.array_distinct(F.concat(F.coalesce(steps, F.array().cast("array<string>")), F.array(*map(F.lit, new))))
