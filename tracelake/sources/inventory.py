"""Scans of document roots and loaders of manifests."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import text as X
from tracelake.runtime import spread

# Suffixes of documents.
EXTENSIONS = (".md", ".txt", ".html", ".htm", ".json", ".yaml", ".yml", ".docx", ".pdf")
# Folders that hold no documents.
EXCLUDED_PARTS = (".git", ".idea", ".vscode", "node_modules", "vendor", "dist", "build", "target", "coverage", "__pycache__")
# File names that are no design documents.
EXCLUDED_NAMES = (
    "license.md", "manifest.json", "package-lock.json", "package.json",
    "pnpm-lock.yaml", "yarn.lock", "composer.json", "composer.lock",
)

MANIFEST = T.StructType([
    T.StructField("documents", T.ArrayType(T.StructType([
        T.StructField(n, T.LongType() if n == "size" else T.StringType())
        for n in ("root", "path", "relative_path", "extension", "size", "modified_at", "sha256", "possible_version")
    ]))),
])
DECISIONS = T.StructType([
    T.StructField("documents", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "sha256", "classification", "reason", "reviewed_at", "reviewer")]))),
])


def extensions(given: list[str] | None) -> list[str]:
    """Suffixes in lower case with their dot; the usual ones where none are given."""
    return [e if e.startswith(".") else f".{e}" for e in (x.lower() for x in given)] if given else list(EXTENSIONS)


def not_excluded(relative_path: Column, patterns: list[str]) -> Column:
    """True where no glob matches the relative path; * crosses folders."""
    keep = F.lit(True)
    path = F.regexp_replace(relative_path, r"\\", "/")
    for pattern in patterns:
        # Java knows the same syntax but for the closing \z
        keep = keep & ~path.rlike("^" + fnmatch.translate(pattern).replace(r"\Z", r"\z"))
    return keep


def in_workspace(relative_path: Column, roots_given: bool, more_parts: tuple[str, ...] = ()) -> Column:
    """True for paths without an excluded folder and, in a search without given roots, without an excluded name."""
    parts = F.split(F.lower(relative_path), r"[/\\]")
    keep = ~F.arrays_overlap(parts, F.array(*[F.lit(p) for p in (*EXCLUDED_PARTS, *more_parts)]))
    return keep if roots_given else keep & ~F.lower(X.file_name(relative_path)).isin(*EXCLUDED_NAMES)


#: Bytes a task holds of a file at once.
CHUNK = 1 << 20


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each file, read piece by piece, or why it cannot be read."""
    for batch in batches:
        digests, errors = [], []
        for uri in batch["uri"]:
            digest, error = hashlib.sha256(), None
            try:
                with _opened(uri) as f:
                    while piece := f.read(CHUNK):
                        digest.update(piece)
            except (OSError, ValueError) as e:
                error = f"cannot be read: {e}"
            digests.append(None if error else digest.hexdigest())
            errors.append(error)
        yield batch.assign(sha256=digests, error=errors)


def _opened(uri: str):
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    where, _, path = rest.lstrip("/").partition("/")
    fs, base = pyarrow.fs.FileSystem.from_uri(f"{scheme}://{where}")
    return fs.open_input_stream(f"{base.rstrip('/')}/{path}")


def scan_files(spark: SparkSession, root: str, suffixes: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame | None, list[str]]:
    """(files, errors) of one root, a local folder or a URI. A missing root gives an error and no files.

    Paths are listed first and filtered; then tasks read what is left, piece by piece, and
    only digests leave them. A file that cannot be read has no digest, and its error.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root if "://" in root else f"file://{os.path.realpath(root)}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        return None, [f"no folder at {root}"]
    home = fs.resolvePath(path).toString()
    # without the content column nothing is opened
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(home).select(F.col("path").alias("uri"), "length", "modificationTime")
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    folder = re.sub("^file:/*", "/", home).rstrip("/")
    full = plain(F.col("uri"))
    relative = F.substring(full, F.lit(len(folder) + 2), F.length(full))
    rows = listed.select(
        "uri", F.lit(folder).alias("root"), full.alias("path"), relative.alias("relative_path"), X.extension(full).alias("extension"),
        F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("modified_at"), X.possible_version(full).alias("possible_version"),
    )
    rows = rows.where(F.col("extension").isin(*extensions(suffixes)) & not_excluded(F.col("relative_path"), exclude or []))
    read = spread(rows).mapInPandas(_digests, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, sha256 string, error string")
    return read.select("root", "path", "relative_path", "extension", "size", "modified_at", "sha256", "possible_version", "error"), []


def scan_root(spark: SparkSession, root: str, suffixes: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame | None, list[str]]:
    """(documents, errors): the files of scan_files that could be read."""
    files, errors = scan_files(spark, root, suffixes, exclude)
    return (files.where("error IS NULL").drop("error") if files is not None else None), errors


def union_roots(scans: list[DataFrame], fold_case: bool = False) -> DataFrame:
    """Documents of several roots; of one path, the first root's row counts. fold_case: letter case makes no other path."""
    rows = None
    for n, scan in enumerate(scans):
        scan = scan.withColumn("_root", F.lit(n))
        rows = scan if rows is None else rows.unionByName(scan)
    return first_root_wins(rows, F.lower("path") if fold_case else F.col("path"), "_root").drop("_root")


def first_root_wins(rows: DataFrame, key: Column, root_order: str) -> DataFrame:
    """One row per key: that of the first root (ties: the least path)."""
    best = rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(root_order, "path")).alias("x"))
    return best.select("x.*")


def load_manifest(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Documents of a manifest file. A file that is missing or no manifest gives none, or an error if strict."""
    return _documents(spark, path, MANIFEST, strict)


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions that documents are no design; other classifications are left out."""
    return _documents(spark, path, DECISIONS, False).where("classification = 'non-design' AND path IS NOT NULL AND sha256 IS NOT NULL")


def _documents(spark: SparkSession, path: str, schema: T.StructType, strict: bool) -> DataFrame:
    if not os.path.exists(path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema["documents"].dataType.elementType)
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    rows = raw.select(F.from_json("value", schema).alias("m")).select(F.explode("m.documents").alias("d")).select("d.*")
    return rows.where("path IS NOT NULL")


def active_map(documents: DataFrame) -> DataFrame:
    """(path_key, sha256) of documents with both."""
    return documents.where("path IS NOT NULL AND sha256 IS NOT NULL").select(X.path_key("path").alias("path_key"), F.lower("sha256").alias("sha256"))
