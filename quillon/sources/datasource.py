"""A Python data source for frame directories: ``spark.read.format("quillon_frames")``.

Each file is one input partition.  Filters on ``stream``, ``label`` and
``kind`` are taken over and applied before a frame is handed on.  Files are
opened by the executors, so the path must be one that they share; for stores
that only Spark reads, use ``quillon.sources.frames``.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from quillon.operators.session import KINDS

PUSHED = ("stream", "label", "kind")


class FrameFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        found = sorted(glob.glob(f"{self.path}/*")) if os.path.isdir(self.path) else [self.path]
        return [FrameFile(p) for p in found if not os.path.basename(p).startswith(("_", "."))]

    def read(self, partition):
        with open(partition.path) as lines:
            for line in lines:
                stream, label, text = line.rstrip("\n").split("|")
                raw = bytes.fromhex(text)
                row = {"stream": stream, "label": label, "kind": KINDS[raw[0]] if raw and raw[0] < len(KINDS) else None}
                if all(row[k] == v for k, v in self.wanted.items()):
                    yield stream, label, row["kind"], raw


class FrameSource(DataSource):
    @classmethod
    def name(cls):
        return "quillon_frames"

    def schema(self):
        return "stream string, label string, kind string, frame binary"

    def reader(self, schema):
        return FrameReader(self.options["path"])


def register(spark) -> None:
    """Makes the format known; its filters need the session's pushdown switch."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
