"""Tensor files as a data source: spark.read.format("tensor_headers").load(folder) gives the tensors that their headers name.

A partition is at most FILES files, fewer where there are few, and only their headers are read. Options: path, a folder or a file, as a
URI or a local path that all executors see; suffix (.safetensors); limit, the most files, by name. A file without a whole header is an error that names it."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: The most files of a partition, and how many partitions there are before one has several.
FILES, PARTS = 512, 64


class Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.suffix, self.limit = options["path"], options.get("suffix", ".safetensors"), options.get("limit")

    def system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self.system()
        found = system.get_file_info(root)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in files if f.is_file and f.path.endswith(self.suffix))
        paths = paths[: None if self.limit is None else int(self.limit)]
        size = min(FILES, -(-len(paths) // PARTS)) or 1
        return [Part(paths[k : k + size]) for k in range(0, len(paths), size)]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, _ = self.system()
        for path in partition.paths:
            try:
                with system.open_input_file(path) as f:
                    head = json.loads(f.read(int.from_bytes(f.read(8), "little")))
            except (ValueError, OverflowError) as e:
                raise ValueError(f"{path} has no header") from e
            for name, x in head.items():
                if name != "__metadata__":
                    yield path, name, x.get("dtype", "unknown"), [int(n) for n in x.get("shape", [])]


class TensorHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensor_headers"

    def schema(self) -> str:
        return "path string, name string, dtype string, shape array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TensorHeaders)
