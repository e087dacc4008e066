"""Sinks: files written whole or not at all."""

from __future__ import annotations

import hashlib
import io
import json
import os
import posixpath
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import escape


def replace_text(path: str, text: str) -> None:
    """Replace a file in one step."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def replace_json(path: str, value: object) -> None:
    replace_text(path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def create_text(path: str, text: str) -> None:
    """Create a private file; one that is there is an error."""
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())


def write_packs(rendered: DataFrame, path: str, most: int) -> None:
    """One text a language (columns language, text); one above ``most`` characters is an error."""
    fine = F.when(F.length("text") > most, F.raise_error(F.concat(F.lit("pack too large: "), F.col("language")))).otherwise(F.col("text"))
    # The writer ends a row with a newline, the pack's own last one.
    rendered.select("language", F.regexp_replace(fine, r"\n\z", "").alias("value")).repartition("language").write.mode("errorifexists").partitionBy("language").text(path)


def publish(files: DataFrame, folder: str) -> str:
    """Write files (path, content) below a folder named by their content; the same again is a no-op."""
    digest = files.select(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", F.sha2("content", 256)))), "\n"), 256).alias("d")).first()["d"]
    target = f"{folder.rstrip('/')}/{digest}"
    spark: SparkSession = files.sparkSession
    try:
        there = spark.read.parquet(target)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files.write.mode("errorifexists").parquet(target)
        return digest
    if there.select("path", "content").exceptAll(files.select("path", "content")).limit(1).count():
        raise RuntimeError(f"{target} holds other files")
    return digest


def archive(files: dict[str, bytes]) -> bytes:
    """A ZIP that depends on names and contents alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in sorted(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr = 0o644 << 16
            z.writestr(info, files[name])
    return out.getvalue()


def review_page(findings: DataFrame, title: str) -> DataFrame:
    """A read-only page of findings: one row, html."""
    cells = F.concat(*[F.concat(F.lit("<td>"), escape(F.coalesce(F.col(c), F.lit(""))), F.lit("</td>")) for c in ("severity", "code", "path", "message")])
    rows = F.transform(F.sort_array(F.collect_list(F.struct("severity", "code", "path", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("h")))), lambda x: x["h"])
    return findings.agg(F.concat(F.lit(f"<!doctype html><title>{title}</title><table>"), F.array_join(rows, "\n"), F.lit("</table>")).alias("html"))


def probes(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """Texts of exact sizes with marks at both ends: size, body, sha256."""
    rows = spark.createDataFrame([(n,) for n in sizes], "size int")
    middle = F.repeat(F.lit("."), F.col("size") - 12)
    body = F.concat(F.lit("BEGIN\n"), middle, F.lit("\nEND.\n"))
    return rows.select("size", body.alias("body")).withColumn("sha256", F.sha2("body", 256))


def transaction(folder: str, changes: dict[str, tuple[bytes | None, bytes]], allowed: Callable[[str], bool] | None = None, check: Callable[[str], None] | None = None) -> None:
    """Replace several files or none: name to (what is there now, what shall be).

    A record of the change is written first. What a crash leaves is settled by
    ``recover``. ``allowed`` says which names may be changed at all; ``check``
    is called with the folder once all files are written, and if it raises, they
    are put back.
    """
    for name in changes:
        if posixpath.isabs(name) or ".." in name.split("/") or allowed is not None and not allowed(name):
            raise PermissionError(f"{name} may not be changed")
    for name, (before, _) in changes.items():
        if _read(f"{folder}/{name}") != before:
            raise RuntimeError(f"{name} isn't what the change was made from")
    record = {name: {"before": None if b is None else b.hex(), "after": a.hex()} for name, (b, a) in changes.items()}
    replace_json(f"{folder}/PREPARED.json", record)
    for name, (_, after) in changes.items():
        _write(f"{folder}/{name}", after)
    try:
        if check is not None:
            check(folder)
    except BaseException:
        _put_back(folder, {name: before for name, (before, _) in changes.items()})
        raise
    finally:
        os.unlink(f"{folder}/PREPARED.json")


def _put_back(folder: str, contents: dict[str, bytes | None]) -> None:
    for name, before in contents.items():
        if before is not None:
            _write(f"{folder}/{name}", before)
        elif os.path.exists(f"{folder}/{name}"):
            os.unlink(f"{folder}/{name}")


def scaffold(folder: str, language: str, modules: dict[str, list[str]], authority: str) -> list[str]:
    """An empty package to fill in: a manifest, and a table with its columns' names for each module. Nothing that is there is overwritten."""
    manifest = {"version": 1, "language": language, "authority": authority, "modules": {name: {"mode": "provided", "file": f"{name}.csv"} for name in sorted(modules)}}
    files = {"manifest.json": json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True) + "\n"}
    files |= {f"{name}.csv": ",".join(columns) + "\n" for name, columns in modules.items()}
    os.makedirs(folder, exist_ok=True)
    for name in sorted(files):
        create_text(f"{folder}/{name}", files[name])
    return sorted(files)


def recover(folder: str) -> str:
    """"clean", "committed" if all files were changed, "undone" if some were; other content is an error."""
    try:
        with open(f"{folder}/PREPARED.json", encoding="utf-8") as f:
            record = json.load(f)
    except FileNotFoundError:
        return "clean"
    states = []
    for name, change in record.items():
        now = _read(f"{folder}/{name}")
        before = None if change["before"] is None else bytes.fromhex(change["before"])
        states.append("after" if now == bytes.fromhex(change["after"]) else "before" if now == before else "other")
    if "other" in states:
        raise RuntimeError("a file was changed by something else")
    done = set(states) == {"after"}
    if not done:
        _put_back(folder, {name: None if change["before"] is None else bytes.fromhex(change["before"]) for name, change in record.items()})
    os.unlink(f"{folder}/PREPARED.json")
    return "committed" if done else "undone"


def _read(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return None


def _write(path: str, data: bytes) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def fingerprint(data: bytes) -> dict[str, object]:
    return {"sha256": hashlib.sha256(data).hexdigest(), "size": len(data)}
