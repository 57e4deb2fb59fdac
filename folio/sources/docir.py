"""The "folio" data source: a folder of documents in any known container, a partition a group of files."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from glob import glob

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per = options["path"], int(options.get("filesPerPartition", "16"))

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file://")
        found = sorted(p for p in glob(f"{path}/**", recursive=True) if os.path.isfile(p)) if os.path.isdir(path) else sorted(glob(path))
        return [_Files(found[i : i + self.per]) for i in range(0, len(found), self.per)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from .frames import READERS, sniff

        for path in partition.paths:
            with open(path, "rb") as f:
                data = f.read()
            kind = sniff(data)
            try:
                rows = READERS[kind](data) if kind else []
            except Exception as e:
                yield path, kind, None, None, str(e)[:200]
                continue
            if not kind:
                yield path, None, None, None, "unknown format"
            for i, text in enumerate(rows):
                yield path, kind, i, text, None


class _Commit(WriterCommitMessage):
    def __init__(self, staged: list[tuple[str, str]]):
        self.staged = staged


class _Writer(DataSourceWriter):
    """Files are staged beside their place and renamed when the job commits; an aborted job leaves none."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"].removeprefix("file://"), options.get("kind", "hwpx")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from .frames import READERS, WRITERS

        os.makedirs(self.path, exist_ok=True)
        staged = []
        for r in rows:
            texts = list(r["paragraphs"] or [])
            data = WRITERS[self.kind](texts)
            if READERS[self.kind](data) != texts:
                raise ValueError(f"{r['name']} does not read back")
            final = os.path.join(self.path, f"{r['name']}.{self.kind}")
            temporary = f"{final}.{hashlib.sha256(os.urandom(8)).hexdigest()[:12]}.part"
            with open(temporary, "wb") as f:
                f.write(data)
            staged.append((temporary, final))
        return _Commit(staged)

    def commit(self, messages: list) -> None:
        for m in messages:
            for temporary, final in m.staged if m else []:
                os.replace(temporary, final)

    def abort(self, messages: list) -> None:
        for m in messages:
            for temporary, _ in m.staged if m else []:
                if os.path.exists(temporary):
                    os.remove(temporary)


class FolioSource(DataSource):
    """spark.read.format("folio").load(folder) gives path, format, para_idx, text, error; writing takes name and paragraphs.

    Options: filesPerPartition (16); kind when writing (hwpx, hwp5, docx, odt). Files are opened by path on the executors:
    the folder must be mounted there. Elsewhere read binaryFile and use frames.read_files, which needs no path.
    """

    @classmethod
    def name(cls) -> str:
        return "folio"

    def schema(self) -> str:
        return "path string, format string, para_idx int, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)
