"""Data sources: rule packs as rows (``spark.read.format("rulepacks")``) and deliveries of a folder as a stream (``readStream.format("deliveries")``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

RULES = (
    "pack_id string, pack_version string, rule_id string, name string, type string, mode string, severity string, enabled boolean, skip_tests boolean, message string, fix_hint string, "
    "languages array<string>, patterns array<string>, exclude_patterns array<string>, query string, prompt string, checks array<struct<package:string,language:string,max_version:string,reason:string>>, tags array<string>, file string"
)
DELIVERIES = "name string, value string, ts timestamp"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class PackFile(InputPartition):
    path: str


class PackReader(DataSourceReader):
    """One partition a file; a pack that cannot be used fails the read with the author's error, or is left out with ``mode`` = permissive."""

    def __init__(self, options: dict):
        self.path, self.permissive = options["path"], options.get("mode", "").lower() == "permissive"

    def partitions(self) -> list[PackFile]:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [PackFile(root)]
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".yml") and f.base_name != "_pack.yml")
        return [PackFile(n) for n in names]

    def read(self, partition: PackFile):
        from ..operators.rules import RuleLoadError, pack_of_text

        if partition is None:  # there are no files
            return
        store, _ = _store(self.path)
        with store.open_input_stream(partition.path) as f:
            data = f.read()
        try:
            pack = pack_of_text(data.decode("utf-8", "replace"), partition.path)
        except RuleLoadError:
            if self.permissive:
                return
            raise
        for r in pack.rules:
            checks = [(str(c.get("package")), c.get("language"), None if c.get("max_version") is None else str(c["max_version"]), c.get("reason")) for c in r.checks]
            yield (pack.id, pack.version, pack.full_id(r), r.name, r.type, r.mode, r.severity, r.enabled, r.skip_tests, r.message, r.fix_hint, list(r.languages), list(r.patterns), list(r.exclude_patterns), r.query, r.prompt, checks, list(r.tags), partition.path)


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rulepacks"

    def schema(self) -> str:
        return RULES

    def reader(self, schema) -> PackReader:
        return PackReader(dict(self.options))


class DeliveryReader(SimpleDataSourceStreamReader):
    """Files of a folder in the order of their names, ``files_a_batch`` at a time; the offset is the last name that was read. A receiver writes a
    delivery under another suffix first and then renames it, with names that ascend (a time and a number)."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("files_a_batch", 1000))

    def initialOffset(self) -> dict:
        return {"last": ""}

    def _names(self, after: str) -> list:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((f for f in found if f.base_name.endswith(".json") and f.base_name > after), key=lambda f: f.base_name)

    def _rows(self, files: list):
        store, _ = _store(self.path)
        out = []
        for f in files:
            with store.open_input_stream(f.path) as data:
                out.append((f.base_name, data.read().decode("utf-8", "replace"), f.mtime))
        return iter(out)  # Spark copies it, which a generator does not allow

    def read(self, start: dict):
        files = self._names(start["last"])[: self.size]
        return self._rows(files), {"last": files[-1].base_name if files else start["last"]}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._rows([f for f in self._names(start["last"]) if f.base_name <= end["last"]])

    def commit(self, end: dict) -> None:
        """Nothing is to be done: files stay, and the offset is in the checkpoint."""


class DeliverySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "deliveries"

    def schema(self) -> str:
        return DELIVERIES

    def simpleStreamReader(self, schema) -> DeliveryReader:
        return DeliveryReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackSource)
    spark.dataSource.register(DeliverySource)
