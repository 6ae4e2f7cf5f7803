"""Readers for a corpus tree ``root/split/{img,box,entities}/stem.ext``."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote, urlparse

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafscore.operators.audit import parse_box_lines, parse_entities

# Accepted file name endings by kind.
EXTENSIONS = {
    "img": ["jpg", "jpeg", "png", "bmp", "tif", "tiff"],
    "box": ["txt"],
    "entities": ["txt", "json"],
}
TREE = r"/(train|test)/(img|box|entities)/([^/]+)\.([^./]+)$"


#: Names of a folder that are looked at to find the bounds of its parts.
SAMPLED_NAMES = 4096


@dataclass
class NameRange(InputPartition):
    """The files of one folder whose names lie in ``[low, high)``; ``None`` is open."""

    split: str
    kind: str
    folder: str
    low: str | None
    high: str | None

    def holds(self, name: str) -> bool:
        return (self.low is None or name >= self.low) and (self.high is None or name < self.high)


class _Store:
    """Folder listings of a local path or of any store that has a URI scheme."""

    def __init__(self, root: str) -> None:
        self.local = "://" not in root or root.startswith("file:")
        self.scheme = "" if self.local or "://" not in root else root.split("://", 1)[0] + "://"
        self.base = unquote(urlparse(root).path) if self.local and root.startswith("file:") else root

    def entries(self, folder: str) -> Iterator[tuple[str, str, int | None]]:
        """(name, path, size) of each entry, size being null for folders; a local listing is read as it goes."""
        if self.local:
            if os.path.isdir(folder):
                with os.scandir(folder) as found:
                    for e in found:
                        yield e.name, e.path, e.stat().st_size if e.is_file() else None
            return
        store, path = FileSystem.from_uri(folder)
        for i in store.get_file_info(FileSelector(path, allow_not_found=True)):
            yield i.base_name, self.scheme + i.path, i.size if i.type == FileType.File else None

    def folders(self, folder: str) -> dict[str, str]:
        return {name: path for name, path, size in self.entries(folder) if size is None}


class CorpusTreeReader(DataSourceReader):
    """Lists the ``img``, ``box`` and ``entities`` folders of each split, one task per range of file names."""

    def __init__(self, root: str, parts: int) -> None:
        self.root, self.parts = root, parts

    def partitions(self) -> list[NameRange]:
        store = _Store(self.root)
        if store.local and not os.path.isdir(store.base):
            raise FileNotFoundError(f"no corpus at {self.root}")
        top = store.folders(store.base)
        if not top.keys() & {"train", "test"}:
            nested = [store.folders(path) for _, path in sorted(top.items())]
            top = next((t for t in nested if t.keys() & {"train", "test"}), {})
        out = []
        for split in ("train", "test"):
            for kind, folder in sorted(store.folders(top[split]).items() if split in top else ()):
                if kind in EXTENSIONS:
                    names = sorted(e[0] for e in islice(store.entries(folder), SAMPLED_NAMES))
                    cuts = sorted({names[len(names) * k // self.parts] for k in range(1, self.parts)} if names else ())
                    out += [NameRange(split, kind, folder, a, b) for a, b in zip([None, *cuts], [*cuts, None])]
        return out or [NameRange("", "", "", "", "")]

    def read(self, partition: NameRange) -> Iterator[tuple]:
        if not partition.folder:
            return
        for name, path, size in _Store(self.root).entries(partition.folder):
            if size is not None and partition.holds(name):
                yield partition.split, partition.kind, name, size, path


class CorpusTree(DataSource):
    """``spark.read.format("corpus_tree").option("parts", 8).load(root)``: file metadata of a corpus tree.

    Contents are never read and zero-length files are kept, which Spark's own file sources leave out of a scan and
    which are what the audit looks for. A folder is split into ``parts`` ranges of names, with bounds from a bounded
    look at its names, so its rows spread over tasks. A root that holds neither split may hold them one folder down.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return "split string, kind string, name string, size bigint, path string"

    def reader(self, schema) -> CorpusTreeReader:
        return CorpusTreeReader(self.options["path"], int(self.options.get("parts", 8)))


def _listing(spark: SparkSession, root: str, parts: int = 8) -> DataFrame:
    """File metadata of the tree with stems and lower-case endings; other files and hidden ones are left out."""
    spark.dataSource.register(CorpusTree)
    rows = spark.read.format("corpus_tree").option("parts", parts).load(root)
    part = lambda k: F.regexp_extract("name", r"^(.+)\.([^.]+)$", k)
    out = rows.select("split", "kind", part(1).alias("stem"), F.lower(part(2)).alias("ext"), "size", "path")
    known = F.lit(False)
    for kind, endings in EXTENSIONS.items():
        known = known | ((F.col("kind") == kind) & F.col("ext").isin(endings))
    return out.where(known & ~F.col("stem").startswith("."))


def write_corpus_tree(files: DataFrame, root: str) -> int:
    """Write ``files (split, kind, name, size)`` as files of blanks under ``root``, by the tasks; how many there are."""
    def write(batches):
        store, base = FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for files in batches:
            for split, kind, name, size in files.itertuples(index=False):
                store.create_dir(f"{base}/{split}/{kind}", recursive=True)
                with store.open_output_stream(f"{base}/{split}/{kind}/{name}") as out:
                    for at in range(0, int(size), 1 << 20):
                        out.write(b" " * min(1 << 20, int(size) - at))
            yield pd.DataFrame({"n": [len(files)]})

    written = files.select("split", "kind", "name", "size").mapInPandas(write, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """(split, kind, stem, size): the form the audits take."""
    return _listing(spark, root).select("split", "kind", "stem", "size")


def read_corpus_index(spark: SparkSession, root: str) -> DataFrame:
    """One row per (split, stem) with the path of each kind and whether it counts as a document.

    Documents are the stems with an image, or all stems of a split that has no images.
    """
    rows = _listing(spark, root)
    wide = rows.groupBy("split", "stem").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(f"{k}_path") for k in EXTENSIONS]
    )
    pictured = rows.where("kind = 'img'").select("split").distinct().withColumn("_img", F.lit(True))
    return wide.join(F.broadcast(pictured), "split", "left").select(
        "split",
        "stem",
        *[f"{k}_path" for k in EXTENSIONS],
        (F.col("img_path").isNotNull() | F.col("_img").isNull()).alias("is_document"),
    )


def read_box_lines(spark: SparkSession, root: str) -> DataFrame:
    """Parsed box lines of every file with their line number and rejection reason.

    Each annotation file is one text value split into lines, so line order is the file's own.
    """
    raw = (
        spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
        .text(root)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    part = lambda k: F.regexp_extract("_path", TREE, k)
    lines = raw.where(part(2) == "box").select(
        part(1).alias("split"),
        F.url_decode(part(3)).alias("document_id"),
        F.posexplode(F.split("value", r"\R")).alias("line_no", "line"),
    )
    return parse_box_lines(lines)


def full_text(parsed: DataFrame) -> DataFrame:
    """Ground-truth text per document: valid transcripts in line order. A file's lines bound the gathered list."""
    rows = parsed.where("reason IS NULL")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "transcript")))
    return rows.groupBy("split", "document_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["transcript"]), "\n").alias("full_text")
    )


def read_entities(spark: SparkSession, root: str) -> DataFrame:
    """Parsed entity files with rejection reasons; values verbatim, extra keys kept as metadata."""
    raw = (
        spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    part = lambda k: F.regexp_extract("_path", TREE, k)
    files = raw.where((part(2) == "entities") & F.lower(part(4)).isin(EXTENSIONS["entities"])).select(
        part(1).alias("split"), F.url_decode(part(3)).alias("document_id"), F.col("value").alias("body")
    )
    return parse_entities(files)
