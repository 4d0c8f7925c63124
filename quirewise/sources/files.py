"""Checks of input files, and their digests."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """An input that cannot be read, with a reason for people."""


class UnsupportedFile(SourceError):
    """An input of a kind that is not read."""


def check_docx(path: str) -> Path:
    """S2. The path of an existing .docx file, or an error that says what is wrong."""
    p = Path(path)
    if not p.exists():
        raise SourceError(f"file not found: {p}")
    if not p.is_file():
        raise SourceError(f"not a file: {p}")
    if p.suffix.lower() != ".docx":
        more = "; convert it to .docx first" if p.suffix.lower() == ".doc" else ""
        raise UnsupportedFile(f"{p.name}: only .docx is read{more}")
    return p


def confine(path: str, root: str | None = None) -> Path:
    """S18. The resolved path, which must lie under `root` if one is given."""
    p = Path(path).expanduser().resolve()
    if root is not None and not p.is_relative_to(Path(root).expanduser().resolve()):
        raise SourceError(f"{path} lies outside {root}")
    return p


def safe_write(path: str, text: str, inputs: tuple[str, ...] = ()) -> None:
    """K10. Write a text, never over one of the inputs."""
    p = Path(path).resolve()
    if any(p == Path(i).resolve() for i in inputs):
        raise SourceError(f"{path} is an input and is not overwritten")
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")


def read_binary(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """path, length, content of the files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def digests(files: DataFrame) -> DataFrame:
    """S17. path, sha256, size of each file."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
