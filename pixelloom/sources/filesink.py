"""Files as results: a relation of (name, content) as files of a folder, and features as one GeoJSON document that many tasks write.

Both are Python data sources. Tasks write under a folder of the run, and only what successful attempts have told the driver is put in place at commit, so a task that is
tried again, or tried twice at the same time, leaves nothing behind. Files are written through Arrow's file systems.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .rasters import uri


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri(path))


@dataclass
class _Wrote(WriterCommitMessage):
    """What a task's attempt has written: (key, temporary path, final name)."""

    files: list


class _Writer(DataSourceWriter):
    """Temporary files of a run lie in a folder beside the results, which goes at the end of the run, well or not."""

    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), f"_run-{uuid.uuid4().hex}"

    def _temporary(self) -> str:
        system, at = _system(self.path)
        folder = f"{at}/{self.run}"
        system.create_dir(folder, recursive=True)
        return f"{folder}/{uuid.uuid4().hex}"

    def _clear(self) -> None:
        system, at = _system(self.path)
        from pyarrow import fs

        if system.get_file_info(f"{at}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.run}")

    def abort(self, messages) -> None:
        self._clear()


class _NamedWriter(_Writer):
    def write(self, iterator):
        system, _ = _system(self.path)
        files = []
        for row in iterator:
            at = self._temporary()
            with system.open_output_stream(at) as out:
                out.write(bytes(row.content))
            files.append((row.name, at, row.name))
        return _Wrote(files)

    def commit(self, messages) -> None:
        system, at = _system(self.path)
        for m in messages:
            for _, temporary, name in m.files:
                folder = f"{at}/{name}".rsplit("/", 1)[0]
                system.create_dir(folder, recursive=True)
                system.move(temporary, f"{at}/{name}")
        self._clear()


class NamedFiles(DataSource):
    """df.write.format("named_files").mode("append").save(folder): a file for each row (name string, content binary); names may have folders."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _NamedWriter(self.options["path"])


HEAD, TAIL = '{"type": "FeatureCollection", "features": [\n', "]}\n"


class _GeoJsonWriter(_Writer):
    """Rows come in ranges of (tile_id, comp_id), sorted inside a task; each task writes the lines of its range, and commit puts the ranges behind each other."""

    def write(self, iterator):
        system, _ = _system(self.path)
        first, at, out = None, None, None
        for row in iterator:
            if out is None:
                first, at = (row.tile_id or "", row.comp_id if row.comp_id is not None else -1), self._temporary()
                out = system.open_output_stream(at)
                out.write(row.feature.encode() + b"\n")
            else:
                out.write(b"," + row.feature.encode() + b"\n")
        if out is None:
            return _Wrote([])
        out.close()
        return _Wrote([(first, at, None)])

    def commit(self, messages) -> None:
        system, at = _system(self.path)
        whole = self._temporary()
        with system.open_output_stream(whole) as out:
            out.write(HEAD.encode())
            for k, (_, part, _) in enumerate(sorted(f for m in messages for f in m.files)):
                if k:
                    out.write(b",")
                with system.open_input_stream(part) as lines:
                    while data := lines.read(1 << 22):
                        out.write(data)
            out.write(TAIL.encode())
        system.move(whole, f"{at}/part-00000.json")
        self._clear()


class GeoJsonDocument(DataSource):
    """Rows (tile_id, comp_id, feature) as one document, part-00000.json of a folder."""

    @classmethod
    def name(cls) -> str:
        return "geojson_document"

    def schema(self) -> str:
        return "tile_id string, comp_id long, feature string"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _GeoJsonWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """rows: name, content. Existing files of the same names are replaced."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode("append").save(folder)


def write_document(feats: DataFrame, folder: str) -> None:
    """feats: tile_id, comp_id, feature. Ranges of keys go to tasks, which sort and write their own."""
    feats.sparkSession.dataSource.register(GeoJsonDocument)
    x = feats.selectExpr("tile_id", "cast(comp_id as long) as comp_id", "feature")
    x.repartitionByRange("tile_id", "comp_id").sortWithinPartitions("tile_id", "comp_id").write.format("geojson_document").mode("append").save(folder)
