"""Readers: files and packages to relations with fixed schemas.

Files come through Spark's ``binaryFile`` reader, so any store works; archives
and foreign tools are opened on the executors, a file at a time. Limits reject,
they never cut.
"""

from __future__ import annotations

import contextlib
import io
import json
import math
import os
import posixpath
import re
import shutil
import subprocess
import threading
import tomllib
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.records import labelled
from foliant.operators.extract import detect_format

#: Bytes that a source may have.
MAX_SOURCE_BYTES = 100 * 1024 * 1024
#: What an unpacked archive may have in all, and how often its packed size.
MAX_UNPACKED_BYTES, MAX_RATIO = 512 * 1024 * 1024, 200


def files(spark: SparkSession, path: str, most: int = MAX_SOURCE_BYTES) -> DataFrame:
    """path, name, format, n_bytes, sha256, modified, content of files; a larger one is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fine = F.when(F.col("length") > most, F.raise_error(F.concat(F.col("path"), F.lit(" is too large")))).otherwise(F.col("content"))
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), detect_format(F.col("path")).alias("format"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"), fine.alias("content"))


def texts(spark: SparkSession, path: str, most: int = MAX_SOURCE_BYTES) -> DataFrame:
    """The same with text, decoded strictly from UTF-8 (anything else is an error)."""
    return files(spark, path, most).withColumn("text", F.expr("decode(content, 'UTF-8')")).drop("content")


def changed_since(now: DataFrame, before: DataFrame) -> DataFrame:
    """Names whose fingerprint moved between two reads."""
    old = before.select("name", F.col("sha256").alias("_sha"), F.col("n_bytes").alias("_n"))
    return now.join(old, "name").where((F.col("sha256") != F.col("_sha")) | (F.col("n_bytes") != F.col("_n"))).select("name")


# --- EPUB ---------------------------------------------------------------

_EPUB = "path string, title string, ordinal int, href string, heading_pos int, level int, heading string, text string, error string"


def _epub_rows(path: str, content: bytes) -> Iterator[tuple]:
    def safe(name: str) -> str:
        clean = posixpath.normpath(name)
        if clean.startswith(("/", "..")) or "\\" in name:
            raise ValueError(f"unsafe member {name}")
        return clean

    def xml(data: bytes) -> ElementTree.Element:
        if re.search(rb"<!(DOCTYPE|ENTITY)", data[:4096], re.IGNORECASE) and b"<!ENTITY" in data:
            raise ValueError("declares entities")
        return ElementTree.fromstring(re.sub(rb"<!DOCTYPE[^>\[]*>", b"", data))

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        names = [safe(x.filename) for x in infos]
        if len(set(names)) != len(names):
            raise ValueError("repeated member")
        if sum(x.file_size for x in infos) > min(MAX_UNPACKED_BYTES, max(1 << 20, MAX_RATIO * len(content))):
            raise ValueError("unpacks to too much")
        if {"META-INF/encryption.xml", "META-INF/rights.xml"} & set(names):
            raise ValueError("is protected")
        if z.read("mimetype").strip() != b"application/epub+zip":
            raise ValueError("isn't an EPUB")
        local = lambda e: e.tag.rpartition("}")[2]
        root = next(e.get("full-path") for e in xml(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
        package = xml(z.read(safe(root)))
        title = next(("".join(e.itertext()).strip() for e in package.iter() if local(e) == "title"), "")
        manifest = {e.get("id"): e for e in package.iter() if local(e) == "item"}
        spine = [e.get("idref") for e in package.iter() if local(e) == "itemref"]
        for ordinal, ref in enumerate(spine):
            item = manifest[ref]
            if item.get("media-type") != "application/xhtml+xml":
                continue
            href = safe(posixpath.join(posixpath.dirname(root), item.get("href").split("#")[0]))
            page = xml(z.read(href))
            body = next((e for e in page.iter() if local(e) == "body"), page)
            text = "\n".join(filter(None, (" ".join(x.split()) for x in body.itertext())))
            headings = [(int(local(e)[1]), " ".join("".join(e.itertext()).split())) for e in body.iter() if re.fullmatch("h[1-6]", local(e))]
            for k, (level, heading) in enumerate(headings or [(None, None)]):
                yield path, title, ordinal, href, k, level, heading, text if k == 0 else None, None


def epub(spark: SparkSession, path: str) -> DataFrame:
    """Headings and texts of EPUB files in reading order; a file that must not be read has ``error``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple] = []
            for name, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows += list(_epub_rows(name, content))
                except (ValueError, KeyError, StopIteration, RuntimeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((name, None, None, None, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _EPUB.split(", ")])

    return files(spark, path).where("format = 'epub'").select("path", "content").mapInPandas(run, _EPUB)


# --- tools and adapters ---------------------------------------------------


class ToolError(RuntimeError):
    """A tool that failed, took too long or gave too much; the message is one of a few."""


def _output(command: list[str], given: bytes, seconds: float, most: int, env: dict[str, str] | None = None) -> bytes:
    """What a command writes for some input, read as it comes: beyond the limits the command is killed."""
    process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, start_new_session=True)
    out, late = bytearray(), threading.Event()

    def stop() -> None:
        late.set()
        process.kill()

    def feed() -> None:
        with contextlib.suppress(BrokenPipeError, OSError):
            process.stdin.write(given)
            process.stdin.close()

    clock, feeder = threading.Timer(seconds, stop), threading.Thread(target=feed, daemon=True)
    clock.start()
    feeder.start()
    try:
        while part := process.stdout.read1(1 << 16):
            out += part
            if len(out) > most:
                raise ToolError("too much output")
        if process.wait() and not late.is_set():
            raise ToolError(f"exit {process.returncode}")
    finally:
        clock.cancel()
        process.kill()
        process.wait()
        process.stdout.close()
        feeder.join(1)
        with contextlib.suppress(BrokenPipeError, OSError):
            process.stdin.close()
    if late.is_set():
        raise ToolError("timeout")
    return bytes(out)


_PDF = "path string, title string, pages int, text string, error string"


def pdf_text(spark: SparkSession, path: str, tool: str = "pdftotext", info: str = "pdfinfo", seconds: float = 60.0, most: int = 64 << 20, most_pages: int = 5_000) -> DataFrame:
    """path, title, pages, text and error of PDF files through the local Poppler tools, on the executors.

    Encrypted files, files of too many pages or with too much text, and texts
    that don't have a form feed a page or are no UTF-8 have an error and no text.
    """
    for name in (tool, info):
        if shutil.which(name) is None:
            raise RuntimeError(f"reading PDF needs the tool {name}, which isn't installed")

    def one(content: bytes) -> tuple[str | None, int | None, str | None, str | None]:
        try:
            said = dict(line.split(":", 1) for line in _output([info, "-"], content, seconds, 1 << 20).decode("utf-8", "replace").splitlines() if ":" in line)
            title, pages = said.get("Title", "").strip() or None, int(said.get("Pages", "0").strip() or 0)
            if not said.get("Encrypted", "no").strip().startswith("no"):
                return None, pages, None, "encrypted"
            if not 0 < pages <= most_pages:
                return title, pages, None, "no pages" if not pages else "too many pages"
            text = _output([tool, "-raw", "-enc", "UTF-8", "-", "-"], content, seconds, most).decode("utf-8")
        except ToolError as e:
            return None, None, None, str(e)
        except ValueError:
            return None, None, None, "output can't be read"
        if title and (len(title) > 500 or any(ord(x) < 32 for x in title)):
            title = None
        return (title, pages, text, None) if text.count("\f") <= pages else (title, pages, None, "pages don't fit")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(name, *one(content)) for name, content in zip(part["path"], part["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "title", "pages", "text", "error"]).astype({"pages": "Int32"})

    return files(spark, path).where("format = 'pdf'").select("path", "content").mapInPandas(run, _PDF)


def adapter(requests: DataFrame, command: list[str], column: str = "request", seconds: float = 60.0, most: int = 2 << 20, keep_env: tuple[str, ...] = ("PATH", "LANG")) -> DataFrame:
    """Add ``response`` and ``error``: one JSON in, one JSON out of a local command per row.

    The command gets an empty environment but for some names; its output is read
    as it comes, and it is ended when it takes too long or writes too much.
    """
    kind = T.StructType([*requests.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def one(request: str) -> tuple[str | None, str | None]:
        try:
            text = _output(command, request.encode(), seconds, most, {k: os.environ[k] for k in keep_env if k in os.environ}).decode("utf-8", "replace")
        except ToolError as e:
            return None, str(e)
        return (text, None) if strict_json_error(text) is None else (None, "invalid JSON")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [one(x) for x in part[column]]
            yield part.assign(response=[x for x, _ in got], error=[x for _, x in got])

    return requests.mapInPandas(run, kind)


def resources(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("md", "json", "txt"), most: int = 1 << 20) -> DataFrame:
    """name, kind, text and sha256 of packaged prompts, templates and schemas below a folder."""
    found = texts(spark, path, most).withColumn("kind", F.lower(F.element_at(F.split("name", r"\."), -1)))
    return found.where(F.col("kind").isin(*suffixes)).select("name", "kind", "text", "sha256")


# --- JSON -----------------------------------------------------------------


def strict_json_error(text: str | None, most: int = 8 << 20) -> str | None:
    """Why a text isn't strict JSON: too long, repeated keys, numbers that aren't finite; None if it is."""
    if text is None or len(text.encode()) > most:
        return "too large" if text is not None else "missing"

    def pairs(found: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in found}) != len(found):
            raise ValueError("repeated key")
        return dict(found)

    def number(x: str) -> float:
        if not math.isfinite(float(x)):
            raise ValueError("number isn't finite")
        return float(x)

    def constant(x: str) -> None:
        raise ValueError("number isn't finite")

    try:
        json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
    except ValueError as e:
        return str(e) if str(e) in ("repeated key", "number isn't finite") else "invalid JSON"
    except RecursionError:
        return "nested too deeply"
    return None


@F.pandas_udf(T.StringType())
def json_error(values: pd.Series) -> pd.Series:
    """``strict_json_error`` of each value."""
    return values.map(strict_json_error)


_LEAF = T.StructType([T.StructField("pointer", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("leaves", T.ArrayType(_LEAF))]))
def string_view(values: pd.Series) -> pd.DataFrame:
    """A JSON text's keys and string values as one text, and where each stands, by pointer."""

    def walk(x: object, pointer: str) -> Iterator[tuple[str, str, str]]:
        if isinstance(x, dict):
            for k, v in x.items():
                at = f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}"
                yield at, "key", k
                yield from walk(v, at)
        elif isinstance(x, list):
            for k, v in enumerate(x):
                yield from walk(v, f"{pointer}/{k}")
        elif isinstance(x, str):
            yield pointer, "value", x

    def one(text: str | None) -> dict:
        if text is None:
            return {"text": None, "leaves": None}
        shown, at, leaves = [], 0, []
        for pointer, kind, value in walk(json.loads(text), ""):
            value = " ".join(value.split())
            leaves.append({"pointer": pointer, "kind": kind, "char_start": at, "char_end": at + len(value)})
            shown.append(value)
            at += len(value) + 1
        return {"text": "\n".join(shown), "leaves": leaves}

    return pd.DataFrame([one(x) for x in values], columns=["text", "leaves"])


# --- packs, packages, maps --------------------------------------------------

_S, _L = T.StringType(), T.ArrayType(T.StringType())


def _record(**extra: T.DataType) -> T.ArrayType:
    base = {"id": _S, "status": _S, "source_id": _S, "source_hash": _S, "translation_status": _S, "provenance_source_id": _S, "provenance_source_hash": _S, "review_notes": _S, "source_locations": _L}
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in (base | extra).items()]))


#: A language's records by collection; the schema is fixed, nothing is inferred.
COLLECTIONS = {
    "chapters": _record(kind=_S, title=_S, pages=_S, sections=_L, summary=_S, terms=_L, contributors=_L, aliases=_L, learning_objectives=_L, prerequisites=_L, spoiler_scope=_S),
    "certainty": _record(label=_S, definition=_S),
    "claims": _record(layer=_S, kind=_S, statement=_S, chapter_ids=_L, certainty_id=_S, falsifiability=_S, revision_conditions=_S, reader_note=_S),
    "misreadings": _record(kind=_S, issue=_S, misreading=_S, response=_S, impact=_S, remaining_uncertainty=_S, chapter_ids=_L, claim_ids=_L, anchor=_S),
    "policies": _record(kind=_S, statement=_S),
    "names": _record(name=_S, aliases=_L, chapter_id=_S, book_context=_S),
    "glossary": _record(term=_S, aliases=_L, chapter_id=_S, book_meaning=_S),
    "references": _record(label=_S, url=_S, relation=_S, url_scope=_S, retrieval_policy=_S),
}
PACK = T.StructType([T.StructField("language", _S), T.StructField("book", T.MapType(_S, _S)), *[T.StructField(k, v) for k, v in COLLECTIONS.items()]])


def packs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Collections of language packs (a JSON file each): project file, language, pos and the record's fields."""
    raw = spark.read.schema(PACK).option("mode", "FAILFAST").json(path, multiLine=True).withColumn("path", F.input_file_name())
    return {k: raw.select("path", "language", F.posexplode(k).alias("pos", "r")).select("path", "language", "pos", "r.*") for k in COLLECTIONS}


def project(spark: SparkSession, path: str) -> dict:
    """A project's TOML settings (one small file, read through Spark's reader)."""
    return tomllib.loads(spark.read.text(path, wholetext=True).first()[0])


def list_csv(spark: SparkSession, path: str, columns: dict[str, str], legacy: dict[str, str] | None = None) -> DataFrame:
    """A module's CSV: ``columns`` gives "text" or "list" by name; ``legacy`` renames old headers.

    A header that is missing or unknown is an error.
    """
    from foliant.functions.text import list_cell

    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for old, new in (legacy or {}).items():
        raw = raw.withColumnRenamed(old, new) if old in raw.columns else raw
    if set(raw.columns) != set(columns):
        raise ValueError(f"headers {sorted(raw.columns)} aren't {sorted(columns)}")
    return raw.select(*[(list_cell(F.coalesce(c, F.lit(""))) if kind == "list" else F.coalesce(F.trim(c), F.lit(""))).alias(c) for c, kind in columns.items()])


def qa_items(rows: DataFrame, column: str = "text") -> DataFrame:
    """Question and answer items of JSON texts: item, facet, value, pointer, position."""
    kind = "struct<items:array<map<string,string>>>"
    items = rows.select("path", F.posexplode(F.from_json(column, kind)["items"]).alias("pos", "item"))
    return items.select("path", "pos", F.explode("item").alias("facet", "value")).withColumn("pointer", F.concat(F.lit("/items/"), "pos", F.lit("/"), "facet"))


def qa_outline(rows: DataFrame, column: str = "text", kinds: dict[str, str] | None = None, kind: str = "unclassified") -> DataFrame:
    """The same of star outlines: level-2 headings with a CUSTOM_ID, facets as definition lists up to a footnote or keyword.

    ``char_start`` and ``char_end`` are the facet's place in the text, as it stands
    there; ``kinds`` gives items a kind by their key, the others have ``kind``.
    """
    pieces = rows.select("path", F.posexplode(F.split(column, r"(?m)^(?=\*\* )")).alias("pos", "block"))
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.withColumn("begin", F.coalesce(F.sum(F.length("block")).over(before), F.lit(0))).where("block LIKE '** %'")
    body = F.regexp_replace("block", r"(?ms)^(\[fn:|#\+).*", "")
    key = F.regexp_extract("block", r"(?m)^\s*:CUSTOM_ID:\s*(\S+)\s*$", 1)
    pattern = r"(?ms)^- ([^\n:]+?) ::[ \t]*(.*?)(?=^- |\z)"
    zipped = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("f"), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)).alias("v"))
    found = blocks.select("path", "pos", "block", "begin", key.alias("source_key"), F.regexp_extract("block", r"^\*\* (.*)", 1).alias("title"), F.explode(zipped).alias("e"))
    said = F.regexp_replace("e.v", r"\s+$", "")
    mark = F.concat(F.lit("\n- "), "e.f", F.lit(" ::"))
    at = F.call_function("locate", mark, F.col("block"))
    start = F.col("begin") + F.call_function("locate", said, F.col("block"), at + F.length(mark)) - 1
    placed = found.withColumn("char_start", start.cast("long")).withColumn("char_end", (start + F.length(said)).cast("long"))
    named = labelled(F.col("source_key"), dict(kinds or {}), kind)
    return placed.select("path", "pos", "source_key", "title", named.alias("kind"), F.lower(F.trim("e.f")).alias("facet"), F.trim(F.regexp_replace("e.v", r"\s+", " ")).alias("value"), "char_start", "char_end")


def author_package(spark: SparkSession, folder: str, columns: dict[str, dict[str, str]], legacy: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """An author's package: its modules (module, mode, file, reason) and records (module, pos, id, fields as a map of texts, lists joined by " | ").

    The manifest names a JSON or CSV file for each module that it supplies.
    ``columns`` has each module's columns as "text" or "list"; other columns are an error, as is a module that isn't known.
    """
    base = folder.rstrip("/")
    held = json.loads(spark.read.text(f"{base}/manifest.json", wholetext=True).first()[0])
    rows = [(name, x.get("mode"), x.get("file"), x.get("reason")) for name, x in sorted(held.get("modules", {}).items())]
    strange = sorted({name for name, *_ in rows} - set(columns))
    if strange:
        raise ValueError(f"unknown modules: {', '.join(strange)}")
    modules = spark.createDataFrame(rows, "module string, mode string, file string, reason string")
    parts = []
    for name, _, file, _ in rows:
        if not file:
            continue
        if posixpath.isabs(file) or ".." in file.split("/"):
            raise ValueError(f"{file} lies outside the package")
        kinds = columns[name]
        if file.endswith(".csv"):
            table = list_csv(spark, f"{base}/{file}", kinds, legacy)
        else:
            schema = T.StructType([T.StructField(c, T.ArrayType(_S) if k == "list" else _S) for c, k in kinds.items()])
            table = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{base}/{file}", multiLine=True)
        values = [F.concat_ws(" | ", c) if k == "list" else F.col(c) for c, k in kinds.items()]
        fields = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in kinds]), F.array(*values)), lambda k, v: v.isNotNull() & (v != ""))
        # One small file a module: its rows come in their order.
        parts.append(table.select(F.lit(name).alias("module"), F.monotonically_increasing_id().alias("pos"), F.col("id"), fields.alias("fields")))
    empty = spark.createDataFrame([], "module string, pos long, id string, fields map<string,string>")
    return modules, reduce(DataFrame.unionByName, parts, empty)


def chapter_map(spark: SparkSession, path: str) -> DataFrame:
    """Explicit chapter spans: chapter_id, char_start, char_end, span_sha256."""
    kind = "spans array<struct<chapter_id:string,char_start:int,char_end:int,span_sha256:string>>"
    return spark.read.schema(kind).option("mode", "FAILFAST").json(path, multiLine=True).select(F.inline("spans"))


def registered(sources: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Sources by id with "current", "changed" or "missing", by name, hash and size."""
    f = fingerprints.select("name", F.col("sha256").alias("_sha"), F.col("n_bytes").alias("_n"))
    state = F.when(F.col("_sha").isNull(), "missing").when((F.col("_sha") == F.col("sha256")) & (F.col("_n") == F.col("size_bytes")), "current").otherwise("changed")
    return sources.join(f, "name", "left").withColumn("state", state).drop("_sha", "_n")


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
