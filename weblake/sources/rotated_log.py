"""The ``rotated_log`` data source: log groups as a table or a stream, each file from where it was left.

Options: ``groups``, a JSON list of main log paths; ``states``, JSON states of files already read (batch); ``force``, to read
everything; ``slices``, JSON slices planned before.  Files must be at paths that the driver and all executors see.  A range of
a plain file and a compressed file are one input partition each."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import files

SCHEMA = "raw string, offset long, file_path string, main_log_path string, fingerprint string, position long, rewritten boolean"
_NAMES = ["raw", "offset", "file_path", "main_log_path", "fingerprint", "position", "rewritten"]


class LogSlice(InputPartition):
    def __init__(self, piece: dict):
        self.piece = piece


def _text(lines: list[bytes]) -> pa.Array:
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())


def _batches(piece: files.Slice) -> Iterator[pa.RecordBatch]:
    for lines, offsets in files.lines(piece):
        n = len(lines)
        same = [pa.repeat(pa.scalar(x, t), n) for x, t in ((piece.path, pa.string()), (piece.main_log_path, pa.string()), (piece.fingerprint, pa.string()), (piece.whole, pa.int64()), (piece.purge, pa.bool_()))]
        yield pa.RecordBatch.from_arrays([_text(lines), pa.array(offsets, pa.int64()), *same], _NAMES)


def _partitions(pieces: list[files.Slice]) -> list[LogSlice]:
    return [LogSlice(asdict(part)) for piece in pieces for part in files.parts(piece)]


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.groups = json.loads(options.get("groups", "[]"))
        self.states = {s["path"]: files.FileState(**s) for s in json.loads(options.get("states", "[]"))}
        self.slices = json.loads(options["slices"]) if "slices" in options else None
        self.force = options.get("force", "false").lower() == "true"

    def partitions(self):
        if self.slices is not None:
            return _partitions([files.Slice(**s) for s in self.slices])
        return _partitions([s for g in self.groups for s in files.plan(g, {p: s for p, s in self.states.items() if s.main_log_path == g}, self.force)])

    def read(self, partition):
        # Spark asks once without a partition where there is none.
        if partition is not None:
            yield from _batches(files.Slice(**partition.piece))


class _Stream(DataSourceStreamReader):
    """The offset is the state of every file; a round reads what lies between two of them."""

    def __init__(self, options):
        self.groups = json.loads(options.get("groups", "[]"))
        self.sizes: dict[tuple, int] = {}

    def _measure(self, path: str) -> int:
        """A compressed file is measured once as long as it stays what it is."""
        info = os.stat(path)
        key = (path, info.st_size, info.st_mtime)
        if key not in self.sizes:
            self.sizes[key] = files.content_size(path)
        return self.sizes[key]

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        # Spark asks for the latest offset without the current one; what each file holds now is enough to tell the rest.
        return {"files": {piece.path: asdict(piece) for group in self.groups for piece in files.plan(group, {}, force=True, measure=self._measure)}}

    def partitions(self, start: dict, end: dict):
        out = []
        for path, piece in end["files"].items():
            before = start["files"].get(path)
            same = [s for s in start["files"].values() if s["fingerprint"] and s["fingerprint"] == piece["fingerprint"]]
            begin, rewritten = 0, False
            if before and before["fingerprint"] == piece["fingerprint"]:
                rewritten = piece["end"] < before["end"] and not piece["compressed"]
                begin = 0 if rewritten else before["end"]
            elif same:
                begin = min(max(s["end"] for s in same), piece["end"])
            if piece["end"] > begin:
                out.append(files.Slice(**piece | {"start": begin, "purge": rewritten}))
        return _partitions(out)

    def read(self, partition):
        # Spark asks once without a partition where there is none.
        if partition is not None:
            yield from _batches(files.Slice(**partition.piece))

    def commit(self, end: dict) -> None:
        pass


class RotatedLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rotated_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
