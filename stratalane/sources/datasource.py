"""Python data source "stratalane": reads folders of frames as rows, writes frames, skips by pushed filters.

    spark.dataSource.register(FramesSource)
    frames.write.format("stratalane").mode("append").save(path)
    spark.read.format("stratalane").option("skip", "true").load(path).where("col = 'ts' and lane between 1 and 9")

A folder holds Parquet files of frames. Filters on col, pos and lane are used to leave out whole frames by
their bounds; Spark still applies them to the rows. Any folder that pyarrow's file systems reach will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators import frames as _frames

ROWS = "col string, kind string, pos long, lane long, value double"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


def _system(path: str):
    """The file system of a folder. A path without a scheme must be one that the driver and all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


class FramesSource(DataSource):
    """Rows of encoded columns."""

    @classmethod
    def name(cls) -> str:
        return "stratalane"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> FramesReader:
        skip = self.options.get("skip", "false").lower() == "true"
        return (SkippingReader if skip else FramesReader)(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FramesWriter:
        return FramesWriter(self.options["path"], overwrite)


class FramesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.cols: set | None = None
        self.bounds = {"lane": [-(2**63), 2**63 - 1], "pos": [0, 2**63 - 1]}

    def partitions(self):
        from pyarrow import fs

        system, path = _system(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".parquet")]

    def wanted(self, f: dict) -> bool:
        if self.cols is not None and f["col"] not in self.cols:
            return False
        (lo, hi), (first, last) = self.bounds["lane"], self.bounds["pos"]
        narrow = lo > -(2**63) or hi < 2**63 - 1
        if narrow and (f["lo"] is None or f["hi"] < lo or f["lo"] > hi):
            return False
        return f["first"] <= last and f["first"] + f["n"] + f["nulls"] > first

    def read(self, partition):
        import pyarrow.parquet as pq

        if partition is None or not partition.path:
            return
        system, _ = _system(self.path)
        for batch in pq.ParquetFile(system.open_input_file(partition.path)).iter_batches(64):
            for f in batch.to_pylist():
                if self.wanted(f):
                    yield _frames.rows_of(f).select(["col", "kind", "pos", "lane", "value"])


class SkippingReader(FramesReader):
    """Takes filters from Spark; asked for by option("skip", "true") where spark.sql.python.filterPushdown.enabled is on."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo) and name == "col":
                self.cols = {f.value} if self.cols is None else self.cols & {f.value}
            elif name in self.bounds and isinstance(getattr(f, "value", None), int):
                b = self.bounds[name]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    b[0] = max(b[0], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    b[1] = min(b[1], f.value - isinstance(f, LessThan))
            yield f


class FramesWriter(DataSourceArrowWriter):
    """Writes frames as they come, into a staging folder of the job. Its files move into place on commit; with
    overwrite those of before go first. A job that fails takes its staging folder away, whatever its tasks left there."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite
        self.stage = f"_stage-{uuid.uuid4().hex}"

    def write(self, iterator):
        import pyarrow.parquet as pq

        system, path = _system(self.path)
        system.create_dir(f"{path}/{self.stage}", recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if out is None:
                sink = system.open_output_stream(f"{path}/{self.stage}/{name}")
                out = pq.ParquetWriter(sink, batch.schema)
            out.write_batch(batch)
        if out is None:
            return _Done("")
        out.close()
        sink.close()
        return _Done(name)

    def commit(self, messages):
        from pyarrow import fs

        system, path = _system(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path)):
                if x.type == fs.FileType.File and x.path.endswith(".parquet"):
                    system.delete_file(x.path)
        for m in messages:
            if m is not None and m.path:
                system.move(f"{path}/{self.stage}/{m.path}", f"{path}/{m.path}")
        self.clear()

    def abort(self, messages):
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        system, path = _system(self.path)
        if system.get_file_info(f"{path}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.stage}")
