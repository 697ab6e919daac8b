"""A table that commits: data and deletion lists are written first, then one manifest names what a version holds."""

from __future__ import annotations

import json
import uuid

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from tessera.operators import ingest as I

SEQ, PART = "store_seq", "store_part"


class Conflict(Exception):
    """Another commit came first and this one had read what it changed."""


class Store:
    """A table under path. Readers see whole versions; whatever fails before the manifest is written leaves the last version as it is.

    A version lists folders of rows and folders of keys to leave out: a key hides the rows that
    were committed before it, so deleting and changing rows rewrites nothing but those rows.
    Every commit has a batch name; a name that is already in the history changes nothing, so a
    batch may be tried again. Folders that no version names are left-overs (vacuum).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.hadoop.Path("/".join([self.path, *parts]))

    def _list(self, *parts: str) -> list[str]:
        where = self._path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._list("versions") if n.startswith("v") and n.endswith(".json")]

    def state(self, version: int | None = None) -> dict:
        """The manifest of a version, the latest unless named; an empty one before the first commit."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "rows": [], "gone": [], "batches": []}
        stream = self.fs.open(self._path("versions", f"v{known[-1] if version is None else version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        s = self.state(version)
        if s["schema"] is None:
            raise ValueError("nothing was committed yet")
        if not s["rows"]:
            return self.spark.createDataFrame([], s["schema"])
        df = self.spark.read.schema(f"{s['schema']}, {SEQ} long, {PART} string").option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/{r}" for r in s["rows"]])
        for columns in sorted({tuple(g["columns"]) for g in s["gone"]}):
            lists = [f"{self.path}/gone/{g['folder']}" for g in s["gone"] if tuple(g["columns"]) == columns]
            keys = self.spark.read.option("basePath", f"{self.path}/gone").parquet(*lists)
            last = keys.groupBy(*columns).agg(F.max(SEQ).alias("hidden"))
            last = last.select(*[F.col(c).alias(f"gone_{c}") for c in columns], "hidden")
            same = [F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in columns]
            on = F.col(SEQ) < F.col("hidden")
            for c in same:
                on = on & c
            df = df.join(last, on, "left_anti")
        return df.drop(SEQ, PART)

    def commit(self, batch: str, add: DataFrame | None = None, remove: DataFrame | None = None, seen: dict | None = None, replace: bool = False) -> int:
        """A new version with the rows of add and without the earlier rows whose columns equal a row of remove.

        seen: the state that add and remove were worked out from; if another commit came in
        between, Conflict is raised. A plain append needs none and goes after it. replace: add
        is all there is.
        """
        while True:
            s = self.state()
            if batch in s["batches"]:
                return s["version"]
            if seen is not None and seen["version"] != s["version"]:
                raise Conflict(f"version {s['version']} came after version {seen['version']}, on which batch {batch} rests")
            n, name = s["version"] + 1, uuid.uuid4().hex
            new = {**s, "version": n, "batches": [*s["batches"], batch]}
            if replace:
                new |= {"rows": [], "gone": []}
            if add is not None:
                if s["schema"] is None:
                    new["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in add.schema.fields)
                else:
                    add = add.select(*[F.col(f"`{c}`") for c in self.spark.createDataFrame([], s["schema"]).columns])
                add.write.parquet(f"{self.path}/rows/{SEQ}={n}/{PART}={name}")
                new["rows"] = [*new["rows"], f"{SEQ}={n}/{PART}={name}"]
            if remove is not None:
                remove.distinct().write.parquet(f"{self.path}/gone/{SEQ}={n}/{PART}={name}")
                new["gone"] = [*new["gone"], {"columns": remove.columns, "folder": f"{SEQ}={n}/{PART}={name}"}]
            if self._claim(n, new):
                return n
            if seen is not None or remove is not None:
                raise Conflict(f"version {n} was taken while batch {batch} was written")

    def _claim(self, n: int, manifest: dict) -> bool:
        """Writes version n's manifest unless there is one: whoever makes the file first has the version."""
        try:
            out = self.fs.create(self._path("versions", f"v{n:010d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        except CapturedException as e:
            if "already exists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return True

    def compact(self, batch: str) -> int:
        """The rows of the latest version in one folder, without deletion lists. Earlier versions stay readable."""
        seen = self.state()
        return self.commit(batch, add=self.read(seen["version"]), seen=seen, replace=True)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what none of the last `keep` versions names, those of failed commits included; returns how many folders went."""
        known = self.versions()
        held = [self.state(v) for v in known[-keep:]]
        used = {f"rows/{r}" for s in held for r in s["rows"]} | {f"gone/{g['folder']}" for s in held for g in s["gone"]}
        for v in known[:-keep]:
            self.fs.delete(self._path("versions", f"v{v:010d}.json"), False)
        found = [f"{k}/{a}/{b}" for k in ("rows", "gone") for a in self._list(k) for b in self._list(k, a)]
        dead = [f for f in found if f not in used]
        for f in dead:
            self.fs.delete(self._path(f), True)
        return len(dead)


def upsert(store: Store, incoming: DataFrame, batch: str, key: str = "doc_id") -> int:
    """S3: new keys are inserted, known ones get the new version (ingest.upsert_registry); only rows of incoming keys are written."""
    seen = store.state()
    keys = incoming.select(key).distinct()
    known = store.read(seen["version"]).join(keys, key, "left_semi") if seen["schema"] else incoming.limit(0)
    return store.commit(batch, add=I.upsert_registry(known, incoming, key), remove=keys if seen["schema"] else None, seen=seen)


def append_chunks(store: Store, chunks: DataFrame, batch: str) -> int:
    """Rows are added, once a batch."""
    return store.commit(batch, add=chunks)


def invalidate(store: Store, incoming: DataFrame, batch: str, key: str = "doc_id") -> int:
    """Rows of an incoming (insurer, product_code) with another version become invalid; those rows alone are written again."""
    seen = store.state()
    now = store.read(seen["version"])
    after = I.invalidate_versions(now, incoming).where("not is_valid").join(now.where("is_valid").select(key), key, "left_semi")
    return store.commit(batch, add=after.select(now.columns), remove=after.select(key), seen=seen)


def delete(store: Store, keys: DataFrame, batch: str) -> int:
    """Rows whose columns equal one of keys go, by a deletion list."""
    return store.commit(batch, remove=keys)
