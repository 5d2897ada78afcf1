"""Which files a run reads: listed by git where it can, else from the disk, or taken from a diff.

Listing is the driver's work, as it is for any file source; contents are read by the executors. Paths
are shown relative to the root where they lie in it.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable
from fnmatch import fnmatch
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.profiles import Config, included
from .extract import LANGUAGES, MARKDOWN, MAX_BYTES, NAMED, supported


def _git(args: list[str], where: Path) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=where, capture_output=True, check=True)
    except (subprocess.CalledProcessError, OSError):
        return None
    return done.stdout.decode("utf-8", "surrogateescape")


def git_files(folder: Path) -> list[Path] | None:
    """Tracked and untracked files that git doesn't ignore; None outside a repository."""
    out = _git(["ls-files", "-z", "--cached", "--others", "--exclude-standard"], folder)
    return None if out is None else [folder / name for name in out.split("\0") if name]


def walk(folder: Path, config: Config) -> list[Path]:
    listed = git_files(folder) if config.respect_gitignore else None
    return sorted(p for p in folder.rglob("*") if p.is_file()) if listed is None else listed


def shown(path: Path, root: Path) -> str:
    full, top = path.resolve(), root.resolve()
    return full.relative_to(top).as_posix() if full.is_relative_to(top) else path.as_posix()


def wanted(name: str, config: Config) -> bool:
    """Not excluded, included where an include list is given, and of a kind that has an extractor."""
    if any(fnmatch(name, g) for g in config.exclude) or config.include and not any(fnmatch(name, g) for g in config.include):
        return False
    return supported(name)


def discover(paths: Iterable[str], config: Config, root: Path) -> list[Path]:
    """Files of the named files and folders, each once; names that are neither are left out."""
    found: dict[Path, None] = {}
    for raw in paths:
        p = Path(raw)
        for f in walk(p, config) if p.is_dir() else [p] if p.is_file() else []:
            found.setdefault(f)
    return [f for f in found if wanted(shown(f, root), config)]


def changed_files(root: Path, rev_range: str | None = None, staged: bool = False) -> list[Path]:
    """Added, copied, modified or renamed files of a git diff; whole files are scanned."""
    out = _git(["diff", "-z", "--name-only", "--diff-filter=ACMR", *(["--cached"] if staged else [rev_range] if rev_range else [])], root)
    return [root / name for name in (out or "").split("\0") if name]


def commit_log(spark: SparkSession, root: Path, rev_range: str) -> DataFrame:
    """(sha, message) of a range, for ``extract.commits``."""
    out = _git(["log", "--format=%x1e%H%x1f%B", rev_range], root) or ""
    rows = [tuple(r.split("\x1f", 1)) for r in out.split("\x1e") if "\x1f" in r]
    return spark.createDataFrame(rows, "sha string, message string")


def load(spark: SparkSession, files: list[Path], root: Path, at_once: int = 64) -> DataFrame:
    """(path, source) of files on a disk that the executors share; files that are too large, gone or not
    UTF-8 are left out. ``at_once`` files make a partition."""
    names = [(str(f), shown(f, root)) for f in files]
    table = spark.createDataFrame(names, "file string, path string").repartition(max(1, -(-len(names) // at_once)))

    def read(batches):
        for batch in batches:
            paths, sources = [], []
            for file, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    p = Path(file)
                    if p.stat().st_size <= MAX_BYTES:
                        sources.append(p.read_bytes().decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"))
                        paths.append(name)
                except (OSError, UnicodeDecodeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sources, pa.string())], names=["path", "source"])

    return table.mapInArrow(read, "path string, source string")


def read_files(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, source) of the UTF-8 files under a folder of any file system. Paths are chosen from a
    listing that reads no content, so excluded trees are never read."""
    config = config or Config()
    base = root.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    known = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1)).isin(*LANGUAGES, *MARKDOWN) | F.substring_index("name", "/", -1).isin(*NAMED)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MAX_BYTES).select("path", path.alias("name"))
    chosen = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in listed.where(known & included(F.col("name"), config)).collect()]
    if not chosen:
        return spark.createDataFrame([], "path string, source string")
    files = spark.read.format("binaryFile").load(chosen).select(path.alias("path"), "content").where(F.is_valid_utf8("content"))
    return files.select("path", F.col("content").cast("string").alias("source"))
