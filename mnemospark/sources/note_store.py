"""Notes, chunks and edges as stored tables that writes change in place, and notes as files.

The tables are Parquet, parted by a hash of the note's id. A write finds the notes that differ from what is
stored, rewrites the parts these fall into and leaves all others as they are. Chunks and edges are written
before the notes, whose hashes tell what is done: a write that breaks off is made whole by the same write."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.graph import checkpointed
from mnemospark.operators.records import carried_embeddings

TABLES = ("chunks", "edges", "notes")


@dataclass(frozen=True)
class NoteStore:
    """A store at a path that all machines share. buckets is fixed with the first write: about one for 100 MB
    of chunks, so that a write of few notes rewrites little."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, store = self._folder(name)
        return store.exists(path) and any(s.getPath().getName().startswith("bucket=") for s in store.listStatus(path))

    def _rows(self, name: str, like: DataFrame) -> DataFrame:
        """The stored rows, with their bucket; none before the first write."""
        schema = like.withColumn("bucket", F.lit(0)).schema
        if self.exists(name):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").drop("bucket")

    def _bucket(self, note_id: Column) -> Column:
        return F.pmod(F.xxhash64(note_id.cast("string")), F.lit(self.buckets)).cast("int")

    def write(self, notes: DataFrame, chunks: DataFrame, edges: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
        """Puts notes (note_id, content_hash, ...) with their chunks (note_id, chunk_index, content_hash,
        embedding, ...) and edges (note_id, ...) in place of what is stored of them, takes out the notes of
        removed (note_id) with all they have, and tells how many notes were written and removed and how
        many buckets that took.

        Notes whose content_hash is stored already are passed over with their chunks and edges. A chunk
        without an embedding keeps the one stored for its note, index and content. Null ids are left
        out; of notes that come twice one is taken; a note that is both new and removed is removed."""
        given = {"notes": notes.where("note_id is not null").dropDuplicates(["note_id"]), "chunks": chunks.where("note_id is not null"), "edges": edges.where("note_id is not null")}
        old = {name: self._rows(name, given[name]) for name in TABLES}
        gone = old["notes"].select("note_id").limit(0) if removed is None else removed.select("note_id").where("note_id is not null").distinct()
        known = old["notes"].select("note_id", F.col("content_hash").alias("_old"))
        differs = F.col("_old").isNull() | (F.col("_old") != F.col("content_hash"))
        changed = given["notes"].join(gone, "note_id", "left_anti").join(known, "note_id", "left").where(differs).select("note_id", F.lit(True).alias("_new"))
        lost = known.select("note_id").join(gone, "note_id", "left_semi").select("note_id", F.lit(False).alias("_new"))
        touched = checkpointed(changed.union(lost).withColumn("bucket", self._bucket(F.col("note_id"))))
        buckets = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())  # as many as the store has at most
        if not buckets:
            return {"written": 0, "removed": 0, "buckets": 0}
        for name in TABLES:
            stays = old[name].where(F.col("bucket").isin(buckets)).join(touched.select("note_id"), "note_id", "left_anti")
            fresh = given[name].join(touched.where("_new").select("note_id"), "note_id", "left_semi")
            if name == "chunks":
                carried = carried_embeddings(fresh, old[name].where(F.col("bucket").isin(buckets))).withColumnRenamed("embedding", "_carried")
                keys = ["note_id", "chunk_index", "content_hash"]
                fresh = fresh.join(carried.select(*keys, "_carried").dropDuplicates(keys), keys, "left").withColumn("embedding", F.coalesce("embedding", "_carried")).drop("_carried")
            fresh = fresh.withColumn("bucket", self._bucket(F.col("note_id"))).select(old[name].columns)
            self._replace(name, checkpointed(stays.select(old[name].columns).unionByName(fresh)), buckets)
        counts = {r["_new"]: r["n"] for r in touched.groupBy("_new").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"written": counts.get(True, 0), "removed": counts.get(False, 0), "buckets": len(buckets)}

    def _replace(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """Buckets of a table are what rows has of them; those without rows go."""
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
        left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        for bucket in buckets:
            if bucket not in left:
                path, store = self._folder(f"{name}/bucket={bucket}")
                store.delete(path, True)


def safe_path(path: str | None) -> bool:
    """Whether a path names a file below the root it is put under."""
    return bool(path) and not path.startswith("/") and "\\" not in path and not any(p in ("", ".", "..") for p in path.split("/"))


def write_files(notes: DataFrame, root: str) -> DataFrame:
    """A receipt (relative_path, size, sha256, error) of each of notes (relative_path, text), written as files below
    root, a folder that all machines see. Files are written beside their place and moved there, so that a
    task that is run again leaves what it left before. Paths that lead elsewhere are not written and say so;
    null texts are empty. Writing happens as the receipt is read: store it, and read it once."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)
        made: set[str] = set()
        for f in frames:
            out = []
            for path, text in zip(f["relative_path"], f["text"], strict=True):
                raw = (text or "").encode()
                if safe_path(path):
                    place = posixpath.join(base, path)
                    if (folder := posixpath.dirname(place)) not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    beside = f"{place}.{hashlib.sha256(raw).hexdigest()[:16]}.part"
                    with store.open_output_stream(beside) as file:
                        file.write(raw)
                    store.move(beside, place)
                out.append((path, len(raw), hashlib.sha256(raw).hexdigest(), None if safe_path(path) else "UNSAFE_PATH"))
            yield pd.DataFrame(out, columns=["relative_path", "size", "sha256", "error"])

    return notes.select("relative_path", "text").mapInPandas(put, "relative_path string, size long, sha256 string, error string")
