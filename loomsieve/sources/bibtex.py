"""BibTeX files: a parser, a Python data source ``bibtex``, and the serializer's text.

Entries give (entry_type, key, fields). Field names are lower-cased and a repeated field's last value counts; ``@string``
macros hold for their file, ``#`` joins parts, an unknown macro stands for its own name; comments and preambles are
skipped, entries without a key are dropped, an unbalanced delimiter is an error.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "entry_type string, key string, fields map<string,string>, path string"

_OPEN = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")
_NAME = re.compile(r"\s*([^\s=,#{}()\"]+)\s*=\s*")
_PART = re.compile(r'\s*(?:(?P<number>\d+)|(?P<macro>[^\s,#{}()"=]+)|(?P<quote>")|(?P<brace>\{))')


class BibTexError(ValueError):
    pass


def _closing(text: str, at: int, opened: str) -> int:
    """Place of the delimiter that closes the one before ``at``. A backslash escapes the sign after it, and braces nest."""
    close = {"{": "}", "(": ")", '"': '"'}[opened]
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == close and depth == 0:
            return at
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        at += 1
    raise BibTexError(f"unbalanced {opened}")


def _value(text: str, at: int, macros: dict[str, str]) -> tuple[str, int]:
    """A field's value: parts joined by ``#``; and where it ends."""
    out = []
    while True:
        m = _PART.match(text, at)
        if not m:
            return "".join(out), at
        at = m.end()
        if m["quote"] or m["brace"]:
            end = _closing(text, at, '"' if m["quote"] else "{")
            out.append(text[at:end])
            at = end + 1
        else:
            out.append(m["number"] or macros.get(m["macro"].lower(), m["macro"]))
        rest = re.compile(r"\s*#").match(text, at)
        if not rest:
            return "".join(out), at
        at = rest.end()


def _fields(body: str, macros: dict[str, str]) -> dict[str, str]:
    out, at = {}, 0
    while m := _NAME.search(body, at):
        value, at = _value(body, m.end(), macros)
        out[m[1].lower()] = re.sub(r"\s+", " ", value).strip()
        comma = body.find(",", at)
        if comma < 0:
            break
        at = comma + 1
    return out


def parse(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(entry type, key, fields) of all entries, in order."""
    macros: dict[str, str] = {}
    out, at = [], 0
    text = text.removeprefix("﻿")
    while m := _OPEN.search(text, at):
        end = _closing(text, m.end(), m[2])
        body, at = text[m.end() : end], end + 1
        kind = m[1].lower()
        if kind in ("comment", "preamble"):
            continue
        if kind == "string":
            macros |= _fields(body, macros)
            continue
        key, comma, rest = body.partition(",")
        if comma and key.strip():
            out.append((kind, key.strip(), _fields(rest, macros)))
    return out


def entries():
    """From a text column to array<struct<entry_type, key, fields>>, as ``parse`` has them."""
    pair = pa.struct([("entry_type", pa.string()), ("key", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(texts: pa.Array) -> pa.Array:
        rows = [[{"entry_type": a, "key": b, "fields": list(c.items())} for a, b, c in parse(t or "")] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pair))

    return F.arrow_udf(run, "array<struct<entry_type:string,key:string,fields:map<string,string>>>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all files under a path or glob that Spark can read; one file is one row until it is parsed."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(F.explode(entries()("value")).alias("e"), "path").select("e.*", "path")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BibTexSource(DataSource):
    """``spark.read.format("bibtex").load(path)`` for a file, a folder or a glob of ``.bib`` files in any store that Arrow
    opens by its address (a plain path is local); ``read`` takes whatever Spark reads.

    ``df.write.format("bibtex").mode(...).save(folder)`` writes rows (entry_type, key, fields; a path is ignored), a file for
    each task. Files appear when all tasks are done: until then they lie in a hidden folder beside their place, which goes
    when the job fails. ``overwrite`` replaces the folder's ``.bib`` files then and not before.
    """

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"entry_type", "key", "fields"} - set(schema.fieldNames())
        if missing:
            raise BibTexError(f"entries need the columns {sorted(missing)}")
        return _Writer(self.options["path"].rstrip("/"), overwrite)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]
    entries: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _places(self):
        store, at = _store(self.path)
        return store, at, f"{at}/_writing-{self.job}"

    def write(self, rows: Iterator) -> _Written:
        """A task's file. Another attempt at the task has a file of its own, and only the attempt that counts is named."""
        from pyspark import TaskContext

        store, _, beside = self._places()
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.job[:8]}.bib"
        store.create_dir(beside, recursive=True)
        n = 0
        with store.open_output_stream(f"{beside}/{name}.tmp") as out:
            for row in rows:
                out.write((written(row["entry_type"], row["key"], dict(row["fields"] or {})) + "\n\n").encode())
                n += 1
        if not n:
            store.delete_file(f"{beside}/{name}.tmp")
        return _Written([name] if n else [], n)

    def commit(self, messages: list) -> None:
        store, at, beside = self._places()
        store.create_dir(at, recursive=True)
        old = _bib_files(store, at) if self.overwrite else []
        for message in messages:
            for name in message.names if message else ():
                store.move(f"{beside}/{name}.tmp", f"{at}/{name}")
        for name in old:
            store.delete_file(f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, _, beside = self._places()
        if store.get_file_info(beside).type == fs.FileType.Directory:
            store.delete_dir(beside)


def _bib_files(store, folder: str) -> list[str]:
    from pyarrow import fs

    inside = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in inside if f.type == fs.FileType.File and f.base_name.endswith(".bib"))


def written(entry_type: str, key: str, fields: dict[str, str | None]) -> str:
    """An entry's text, as ``entry_text`` has it."""
    named = {"organization" if k == "publisher" else k: v for k, v in fields.items()}
    escaped = {k: re.sub(r"([{}])", r"\\\1", v.replace("\\", "\\\\")) for k, v in sorted(named.items()) if v is not None and v.strip(" ")}
    return f"@{entry_type}{{{key},\n" + ",\n".join(f"  {k} = {{{v}}}" for k, v in escaped.items()) + "\n}"


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        import fnmatch

        from pyarrow import fs

        store, path = _store(self.path)
        folder, _, pattern = path.rpartition("/")
        found = store.get_file_info(path) if "*" not in path else None
        if found is not None and found.type == fs.FileType.File:
            return [_File(self.path)]
        folder, pattern = (path, "*.bib") if found is not None else (folder, pattern)
        inside = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted(f.base_name for f in inside if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))
        base = self.path.rpartition("/")[0] if found is None else self.path.rstrip("/")
        return [_File(f"{base}/{n}") for n in names]

    def read(self, partition: _File) -> Iterator[tuple]:
        store, path = _store(partition.path)
        with store.open_input_stream(path) as f:
            for kind, key, fields in parse(f.read().decode("utf-8-sig")):
                yield kind, key, fields, partition.path


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BibTexSource)


def entry_text(entry_type: Column, key: Column, fields: Column) -> Column:
    """One entry as BibTeX: sorted fields, empty ones left out, publisher written as organization, braces escaped."""
    named = F.transform_keys(fields, lambda k, _: F.when(k == "publisher", "organization").otherwise(k))
    kept = F.filter(F.array_sort(F.map_entries(named)), lambda e: F.coalesce(F.trim(e["value"]), F.lit("")) != "")
    safe = lambda v: F.regexp_replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), r"([{}])", r"\\$1")
    lines = F.transform(kept, lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = {"), safe(e["value"]), F.lit("}")))
    return F.concat(F.lit("@"), entry_type, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
