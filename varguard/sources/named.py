"""Trial files named by their cell: a Spark data source that writes one CSV file for each result row.

``results.write.format("named_trials").mode("append").save(path)`` leaves ``data_frac_<f>_trial_<i>.csv`` files
(fraction in 4 decimals), one row each, that ``read_trials(layout="named")`` reads back.
Tasks write under ``<path>/_pending/<job>`` with names of their own attempt; the job's commit moves the files of the attempts
that succeeded to their cells' names, so a lost executor or a repeated task leaves no file behind and none twice.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections import Counter
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .results import TRIAL_FILE_SCHEMA, encode_gvec

COLUMNS = [f.name for f in TRIAL_FILE_SCHEMA.fields]


def cell_name(data_frac: float, trial_i: int) -> str:
    return f"data_frac_{data_frac:.4f}_trial_{trial_i}.csv"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it; ``file:/x`` and plain paths are the shared mount."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: (pending name, cell name)."""

    files: list


class NamedTrialsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    def _pending(self, root: str) -> str:
        return f"{root}/_pending/{self.job}"

    def write(self, rows) -> Written:
        system, root = open_folder(self.path)
        context, files = TaskContext.get(), []
        for n, row in enumerate(rows):
            if row["data_frac"] is None or row["trial_i"] is None:
                raise ValueError("a trial file needs data_frac and trial_i")
            text = io.StringIO()
            out = csv.writer(text, lineterminator="\n")
            out.writerow(COLUMNS)
            out.writerow(["" if row[c] is None else repr(row[c]) if isinstance(row[c], float) else row[c] for c in COLUMNS])
            pending = f"{self._pending(root)}/{context.partitionId()}-{context.taskAttemptId()}-{n}.csv"
            system.create_dir(self._pending(root), recursive=True)
            with system.open_output_stream(pending) as stream:
                stream.write(text.getvalue().encode())
            files.append((pending, cell_name(row["data_frac"], row["trial_i"])))
        return Written(files)

    def commit(self, messages) -> None:
        system, root = open_folder(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        twice = [name for name, n in Counter(name for _, name in files).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"cells that share a file name: {sorted(twice)[:5]}")
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.is_file and old.base_name.startswith("data_frac_"):
                    system.delete_file(old.path)
        for pending, name in files:
            if not self.overwrite and system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/{name}")  # a cell computed again
            system.move(pending, f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages) -> None:
        self._clear(*open_folder(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        for folder in (self._pending(root), f"{root}/_pending"):
            info = system.get_file_info(folder)
            if info.type == fs.FileType.Directory and (folder != f"{root}/_pending" or not system.get_file_info(fs.FileSelector(folder))):
                system.delete_dir(folder)


class NamedTrials(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_trials"

    def schema(self):
        return TRIAL_FILE_SCHEMA

    def writer(self, schema, overwrite: bool) -> NamedTrialsWriter:
        missing = [c for c in COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"columns missing from the trials: {missing}")
        return NamedTrialsWriter(self.options["path"], overwrite)


def write_named_trials(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file per cell under the name of its cell; ``append`` replaces the files of the cells that are written again."""
    results.sparkSession.dataSource.register(NamedTrials)
    results.withColumn("gvec", encode_gvec(results["gvec"])).select(*COLUMNS).write.format("named_trials").mode(mode).save(path)
