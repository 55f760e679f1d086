"""One document (JSON, SARIF, a baseline, a table of lines) from rows in order, written by the tasks and not by the driver.

``document`` is a data source: each task writes the rows of its partition as one piece under a name of its own attempt, and the commit writes a manifest
that lists the pieces that count, in order, with what stands before, between and after them. Pieces of attempts that failed are not in it. The
document is what the manifest's pieces give one after the other; ``stitch`` makes a single file of them, copying blocks of bytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "_manifest.json"
BLOCK = 1 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Piece(WriterCommitMessage):
    part: int
    name: str
    rows: int
    size: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.between, self.overwrite = options["path"], options.get("between", ", "), overwrite
        self.before, self.after = options.get("before", ""), options.get("after", "")

    def write(self, iterator) -> Piece:
        from pyspark import TaskContext

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, rows, size = f"piece-{part:06d}-{uuid.uuid4().hex}", 0, 0
        with store.open_output_stream(f"{root}/{name}") as out:
            for row in iterator:
                data = (self.between if rows else "").encode() + row[0].encode()
                out.write(data)
                rows, size = rows + 1, size + len(data)
        return Piece(part, name, rows, size)

    def commit(self, messages: list[Piece | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        pieces = sorted((m for m in messages if m), key=lambda m: m.part)
        manifest = {"before": self.before, "between": self.between, "after": self.after, "pieces": [[m.name, m.rows, m.size] for m in pieces if m.rows]}
        # the manifest takes the place of an older one in one step; until then that one's pieces are all there
        with store.open_output_stream(f"{root}/{MANIFEST}.new") as out:
            out.write(json.dumps(manifest).encode())
        store.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
        kept = {m.name for m in pieces}
        self._drop(lambda name: name not in kept)

    def abort(self, messages: list[Piece | None]) -> None:
        mine = {m.name for m in messages if m}
        self._drop(lambda name: name in mine)

    def _drop(self, which) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith("piece-") and which(f.base_name):
                store.delete_file(f.path)


class DocumentSource(DataSource):
    """Write only: one string column, in the order of its partitions and rows."""

    @classmethod
    def name(cls) -> str:
        return "document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if len(schema.fields) != 1:
            raise ValueError("a document is written from one column of strings")
        return DocumentWriter(dict(self.options), overwrite)


def write(rows: DataFrame, line: str, order: list[str], path: str, before: str = "", after: str = "", between: str = ", ") -> dict:
    """Write ``line`` of all rows, in order, as the document of ``path``; returns its manifest."""
    rows.sparkSession.dataSource.register(DocumentSource)
    sorted_ = rows.orderBy(*order).select(line)
    sorted_.write.format("document").options(path=path, before=before, after=after, between=between).mode("overwrite").save()
    return manifest(path)


def manifest(path: str) -> dict:
    store, root = _store(path)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def pieces(path: str) -> Iterator[bytes]:
    """The document in blocks of bounded size."""
    store, root = _store(path)
    m = manifest(path)
    yield m["before"].encode()
    for i, (name, _, _) in enumerate(m["pieces"]):
        if i:
            yield m["between"].encode()
        with store.open_input_stream(f"{root}/{name}") as f:
            while block := f.read(BLOCK):
                yield block
    yield m["after"].encode()


def stitch(path: str, out: str) -> int:
    """One file of the document's pieces; returns its size."""
    size = 0
    store, target = _store(out)
    with store.open_output_stream(target) as f:
        for block in pieces(path):
            f.write(block)
            size += len(block)
    return size


def save(rows: DataFrame, line: str, order: list[str], out: str, before: str = "", after: str = "", between: str = ", ") -> int:
    """One file of ``line`` of all rows, by way of a folder of pieces beside it that is gone afterwards; returns its size."""
    folder = f"{out}.{uuid.uuid4().hex}"
    write(rows, line, order, folder, before, after, between)
    size = stitch(folder, out)
    store, root = _store(folder)
    store.delete_dir(root)
    return size


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
