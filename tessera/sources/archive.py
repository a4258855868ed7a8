"""Zip archives as a Python data source: one partition for each range of members, wanted sections only."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_SCHEMA = "section string, source_rel string, content binary"


def section_prefix(names: list[str], sections: tuple[str, ...]) -> str:
    """The shortest member prefix under which all sections are; the alphabetically first of equally short ones."""
    seen: dict[str, set[str]] = {}
    for name in names:
        parts = name.split("/")
        for k, p in enumerate(parts[:-1]):
            if p in sections:
                seen.setdefault("".join(x + "/" for x in parts[:k]), set()).add(p)
    whole = [p for p, s in seen.items() if len(s) == len(set(sections))]
    if not whole:
        raise ValueError("the archive doesn't have all sections")
    return min(whole, key=lambda p: (len(p), p))


def members(path: str, sections: tuple[str, ...], extra: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """``(member, relative path)`` of the wanted files; raises where a path leaves its root or two differ in case only."""
    with zipfile.ZipFile(path) as z:
        names = [i.filename for i in z.infolist() if not i.is_dir()]
    prefix = section_prefix(names, sections)
    out, targets = [], set()
    for name in names:
        rel = name[len(prefix) :] if name.startswith(prefix) else ""
        if not rel or not (rel.split("/", 1)[0] in sections or rel in extra):
            continue
        if "\\" in rel or rel.startswith("/") or any(p in ("", ".", "..") for p in rel.split("/")):
            raise ValueError(f"unsafe member {name}")
        if rel.lower() in targets:
            raise ValueError(f"member {name} comes twice")
        targets.add(rel.lower())
        out.append((name, rel))
    return out


class _Range(InputPartition):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.sections = tuple(options["sections"].split(","))
        self.size = int(options.get("members", "500"))

    def partitions(self) -> list[InputPartition]:
        m = members(self.path, self.sections)
        return [_Range(m[i : i + self.size]) for i in range(0, len(m), self.size)] or [_Range([])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z:
            for name, rel in partition.names:
                yield rel.split("/", 1)[0], rel, z.read(name)


class SectionArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "section_archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_zip(spark: SparkSession, path: str, sections: tuple[str, ...]) -> DataFrame:
    """``(section, source_rel, content)`` of the members of the sections."""
    spark.dataSource.register(SectionArchive)
    return spark.read.format("section_archive").option("path", os.path.abspath(path)).option("sections", ",".join(sections)).load()


def check_relative(rel: str) -> None:
    if not rel or rel.startswith("/") or "\\" in rel or any(p in ("", ".", "..") for p in rel.split("/")):
        raise ValueError(f"unsafe path {rel!r}")


def source_html(tree: DataFrame | None, archive: DataFrame | None, rel: str) -> bytes:
    """Bytes of one page, from the extracted tree or else from the archive."""
    check_relative(rel)
    for df in (tree, archive):
        if df is not None and (row := df.where(df["source_rel"] == rel).select("content").first()):
            return bytes(row["content"])
    raise FileNotFoundError(rel)


def read_member(path: str, sections: tuple[str, ...], rel: str) -> bytes:
    """Bytes of one member by its relative path, without a look at the others' contents."""
    check_relative(rel)
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            if name == rel or name.endswith("/" + rel):
                if name == section_prefix([i.filename for i in z.infolist()], sections) + rel:
                    return z.read(name)
    raise FileNotFoundError(rel)
