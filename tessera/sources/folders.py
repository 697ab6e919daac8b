"""Document folders as a data source: read in part by insurer and product, and as a stream that goes on where it stopped."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith

SCHEMA = "insurer string, product string, file_name string, path string, size long, modified timestamp, content binary"
#: Bytes of files that one task reads, about.
PARTITION_BYTES = 64 << 20


class Files(InputPartition):
    def __init__(self, root: str, files: list):
        self.root, self.files = root, files


def opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def listed(root: str, keep: list) -> list[tuple[int, str, int, str, str]]:
    """(modified in microseconds, path, size, insurer, product) of the files in root/insurer/product/, of the folders that pass keep's (column, test) pairs only."""
    from pyarrow import fs

    store, base = opened(root)
    passes = lambda column, name: all(test(name) for c, test in keep if c == column)
    below = lambda p: sorted(store.get_file_info(fs.FileSelector(p, allow_not_found=True)), key=lambda i: i.path)
    out = []
    for a in below(base):
        if a.type != fs.FileType.Directory or not passes("insurer", a.base_name):
            continue
        for b in below(a.path):
            if b.type != fs.FileType.Directory or not passes("product", b.base_name):
                continue
            out += [(f.mtime_ns // 1000, f.path, f.size, a.base_name, b.base_name) for f in below(b.path) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return out


def grouped(root: str, files: list) -> list[Files]:
    """Files in stretches of about PARTITION_BYTES; a larger file is a stretch of its own."""
    out, size = [], 0
    for f in files:
        if not out or size + f[2] > PARTITION_BYTES:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f[2]
    return [Files(root, g) for g in out]


def rows_of(part: Files):
    """A missing file is left out: it went after it was listed."""
    import datetime

    store, _ = opened(part.root)
    for modified, path, size, insurer, product in part.files:
        try:
            with store.open_input_stream(path) as f:
                content = f.read()
        except FileNotFoundError:
            continue
        yield insurer, product, path.rsplit("/", 1)[-1], path, size, datetime.datetime.fromtimestamp(modified / 1e6, datetime.timezone.utc).replace(tzinfo=None), content


class DocumentFolder(DataSource):
    """format("document_folder").load(root): the files in root/insurer/product/.

    Conditions on insurer and product are pushed down, so other folders are not even listed. As
    a stream, files come in order of (modification time, path); the offset is the last of them,
    so a stream goes on where it stopped. root is a path or an address that pyarrow can open; in
    a store that only Spark reads, use sources.tables.read_files.
    """

    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(self.options["path"])


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.keep = root, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column in ("insurer", "product") and isinstance(f, EqualTo):
                self.keep.append((column, lambda name, v=f.value: name == v))
            elif column in ("insurer", "product") and isinstance(f, In):
                self.keep.append((column, lambda name, v=frozenset(f.value): name in v))
            elif column in ("insurer", "product") and isinstance(f, StringStartsWith):
                self.keep.append((column, lambda name, v=f.value: name.startswith(v)))
            else:
                yield f

    def partitions(self):
        return grouped(self.root, listed(self.root, self.keep)) or [Files(self.root, [])]

    def read(self, partition):
        yield from rows_of(partition)


class FolderStream(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max((f[:2] for f in listed(self.root, [])), default=(-1, ""))
        return {"modified": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict):
        after, upto = (start["modified"], start["path"]), (end["modified"], end["path"])
        return grouped(self.root, sorted(f for f in listed(self.root, []) if after < f[:2] <= upto))

    def read(self, partition):
        yield from rows_of(partition)

    def commit(self, end: dict) -> None:
        pass


def read_folder(spark, root: str):
    """The folder as a table, with conditions on insurer and product pushed to its listing."""
    spark.dataSource.register(DocumentFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("document_folder").load(root)


def stream_folder(spark, root: str):
    spark.dataSource.register(DocumentFolder)
    return spark.readStream.format("document_folder").load(root)
