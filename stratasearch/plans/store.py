"""Tables of the engine on shared storage.

Data is append-only: an indexing run writes one new segment of chunks, vectors, postings and statistics, for one repository or for many, and then
one manifest that lists each table's segments and, for each repository, the version of its rows that counts. Manifests are numbered, and a number is
given out once: a manifest is written beside the others and renamed only if nobody has that number yet. Readers take the newest one
and see either all of a run or nothing, also while another is being written or after a crash. A writer whose number is taken reads the
newest manifest and makes its change again, so no update is lost. Rows of older versions are left out by a join with the repositories
until ``compact`` drops them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.layout import BUCKET, BUCKETS, in_scopes, write_by_repository
from ..operators.lookups import only_in

TABLES = {
    "chunks": schema.CHUNKS,
    "vectors": schema.VECTORS,
    "postings": schema.POSTINGS,
    "doc_stats": schema.DOC_STATS,
}
#: The column of each table that names the repository.
REPO_COLUMN = {"chunks": "repo_id", "vectors": "namespace", "postings": "repo_id", "doc_stats": "repo_id"}
#: Tables that are laid out by buckets of repositories, in segments whose names end so.
BY_REPOSITORY, BUCKETED = ("chunks", "vectors"), f"-b{BUCKETS}"


#: Manifests that stay beside the newest one, for readers that have just listed them.
KEPT_MANIFESTS = 8
ATTEMPTS = 100


class RepoNotIndexedError(LookupError):
    """Asked for a repository that the store doesn't hold."""

    def __init__(self, repo_id: str, source: str | None = None):
        super().__init__(f"not indexed: {source or repo_id}")
        self.repo_id = repo_id
        self.source = source


class Store:
    """The tables below one path, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._read: dict = _empty()

    # the manifest ---------------------------------------------------------------------------------------------

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        """The numbers of the manifests that are there, in order."""
        fs, folder = self._file("")
        if not fs.exists(folder):
            return []
        names = (str(status.getPath().getName()) for status in fs.listStatus(folder))
        return sorted(int(name[9:-5]) for name in names if name.startswith("MANIFEST-") and name.endswith(".json"))

    def manifest(self) -> dict:
        """The newest manifest."""
        numbers = self._numbers()
        if not numbers:
            return _migrated(self._json(SINGLE_MANIFEST))
        if numbers[-1] != self._read["number"]:
            self._read = self._json(f"MANIFEST-{numbers[-1]:012d}.json") or _empty()
        return json.loads(json.dumps(self._read))

    def _json(self, name: str) -> dict | None:
        """A file's object, or None where there is no such file."""
        fs, path = self._file(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _claimed(self, manifest: dict) -> bool:
        """Write a manifest under its number; False where another writer has taken the number."""
        fs, path = self._file(f"MANIFEST-{manifest['number']:012d}.json")
        _, new = self._file(f"_new-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest, default=str).encode()))
        stream.close()
        try:
            jvm = self.spark._jvm
            if fs.getScheme() == "file":  # a rename would replace the other's file here, a link doesn't
                local = [jvm.java.nio.file.Paths.get(fs.makeQualified(x).toUri()) for x in (path, new)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(new, path, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(new, False)
        return True

    def update(self, change: Callable[[dict], dict | None]) -> dict:
        """Apply a change to the newest manifest and make the result the newest; made again where another writer came first.

        ``change`` gets a copy and returns the manifest to write, or None where there is nothing to change.
        """
        for _ in range(ATTEMPTS):
            before = self.manifest()
            after = change(before)
            if after is None:
                return before
            after = after | {"number": before["number"] + 1}
            if self._claimed(after):
                for number in self._numbers()[: -KEPT_MANIFESTS - 1]:
                    fs, path = self._file(f"MANIFEST-{number:012d}.json")
                    fs.delete(path, False)
                return after
        raise OSError("other writers were always first")

    # reading --------------------------------------------------------------------------------------------------

    def repos(self) -> DataFrame:
        """The repositories that count."""
        rows = list(self.manifest()["repos"].values())
        for row in rows:
            row["indexed_at"] = datetime.fromisoformat(row["indexed_at"])
        return self.spark.createDataFrame([[r.get(f.name) for f in schema.REPOS.fields] for r in rows], schema.REPOS)

    def table(self, name: str, scopes: DataFrame | None = None) -> DataFrame:
        """The rows of a table that belong to the repositories' current versions. With ``scopes`` (scope, null for all), chunks and vectors
        are read only from the buckets of those repositories; others in the same buckets come along."""
        segments = self.manifest()["segments"][name]
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        stored = schema.T.StructType([*TABLES[name].fields, schema.T.StructField("version", schema.L)])
        rows = self._rows(name, [s for s in segments if not s.endswith(BUCKETED)], stored)
        laid_out = [s for s in segments if s.endswith(BUCKETED)]
        if name in BY_REPOSITORY and laid_out:
            new = self._rows(name, laid_out, schema.T.StructType([*stored.fields, schema.T.StructField(BUCKET, schema.I)]))
            rows = rows.unionByName((new if scopes is None else in_scopes(new, scopes)).drop(BUCKET))
        elif laid_out:
            rows = rows.unionByName(self._rows(name, laid_out, stored))
        current = self.repos().select(F.col("repo_id").alias(REPO_COLUMN[name]), "version")
        return rows.join(F.broadcast(current), [REPO_COLUMN[name], "version"]).select(*TABLES[name].fieldNames())

    def _rows(self, name: str, segments: list[str], kind: schema.T.StructType) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], kind)
        base = f"{self.path}/{name}"
        rows = self.spark.read.schema(kind).option("basePath", base).parquet(*[f"{base}/{self._folder(name, s)}" for s in segments])
        return rows.select(*kind.fieldNames())

    @staticmethod
    def _folder(name: str, segment: str) -> str:
        """A segment's folder; as a partition where folders of buckets lie in it."""
        return f"segment={segment}" if name in BY_REPOSITORY and segment.endswith(BUCKETED) else segment

    def segment(self, name: str, segment: str) -> DataFrame:
        """The rows of one segment, whether they count or not."""
        return self._rows(name, [segment], TABLES[name])

    def repo_chunks(self, repo_id: str) -> DataFrame:
        """The chunks of one repository, in the order of files and lines; the repository reaches the scan as a filter."""
        return self.ordered_chunks(self.table("chunks", self._only(repo_id)).where(F.col("repo_id") == repo_id))

    def _only(self, repo_id: str) -> DataFrame:
        return self.spark.createDataFrame([(repo_id,)], "scope string")

    def ordered_chunks(self, chunks: DataFrame | None = None) -> DataFrame:
        """All chunks (or the given ones) ordered by repository, file and place."""
        chunks = self.table("chunks") if chunks is None else chunks
        return chunks.orderBy("repo_id", "file_path", "start_line", "end_line", "chunk_id")

    def chunk_ids(self, repo_id: str) -> DataFrame:
        """(chunk_id) of one repository."""
        return self.table("chunks", self._only(repo_id)).where(F.col("repo_id") == repo_id).select("chunk_id")

    def repo_sources(self) -> dict[str, str]:
        """repo_id -> source."""
        return {k: r["source"] for k, r in self.manifest()["repos"].items()}

    def repo_source_paths(self) -> dict[str, str]:
        """repo_id -> the directory that was indexed."""
        return {k: r.get("source_path") or "" for k, r in self.manifest()["repos"].items()}

    def repo(self, repo_id: str) -> dict | None:
        """One repository's row."""
        return self.manifest()["repos"].get(repo_id)

    def has_repo(self, repo_id: str) -> bool:
        return self.repo(repo_id) is not None

    def chunk_count(self, repo_id: str) -> int:
        """The stored number of chunks, 0 for an unknown repository."""
        return int((self.repo(repo_id) or {}).get("chunk_count") or 0)

    def repo_ids_of(self, source: str) -> list[str]:
        return sorted(k for k, r in self.manifest()["repos"].items() if r["source"] == source)

    def status(self) -> DataFrame:
        """One row: repositories, chunks, sorted sources."""
        return status(self.repos())

    # writing --------------------------------------------------------------------------------------------------

    def write_segment(self, tables: dict[str, DataFrame], versions: DataFrame | int) -> str:
        """Write one segment; nobody sees it before a commit. ``versions``: the rows' version, or (repo_id, version) of each repository. Postings are
        sorted by token so a token's row groups can be skipped; chunks and vectors have a folder for each bucket of repositories."""
        segment = uuid.uuid4().hex + BUCKETED
        for name, rows in tables.items():
            out = rows.select(*TABLES[name].fieldNames())
            if isinstance(versions, int):
                out = out.withColumn("version", F.lit(versions).cast("long"))
            else:
                out = out.join(F.broadcast(versions.withColumnRenamed("repo_id", REPO_COLUMN[name])), REPO_COLUMN[name])
            out = out.select(*TABLES[name].fieldNames(), "version")
            if name == "postings":
                out = out.repartitionByRange("token").sortWithinPartitions("token", "chunk_id")
            if name in BY_REPOSITORY:
                write_by_repository(out, f"{self.path}/{name}/{self._folder(name, segment)}", REPO_COLUMN[name])
            else:
                out.write.parquet(f"{self.path}/{name}/{segment}")
        return segment

    def put_repos(self, rows: list[dict], segment: str) -> None:
        """Commit a segment and the rows of its repositories together."""
        stamp = datetime.now(timezone.utc).replace(tzinfo=None).isoformat()

        def change(manifest: dict) -> dict:
            for name in TABLES:
                manifest["segments"][name].append(segment)
            manifest["repos"] |= {row["repo_id"]: row | {"indexed_at": stamp} for row in rows}
            return manifest

        self.update(change)

    def remove_repo(self, repo_id: str) -> None:
        """Forget a repository; its rows no longer count."""

        def change(manifest: dict) -> dict | None:
            return manifest if manifest["repos"].pop(repo_id, None) is not None else None

        self.update(change)

    def new_version(self) -> int:
        """A version that no other run has."""
        return uuid.uuid4().int >> 66

    def replace_tables(self, tables: dict[str, DataFrame]) -> None:
        """Write tables anew from rows that count, as one segment (versions stay), and list that in place of the segments it was made from."""
        before = self.manifest()
        segment = self.write_segment(tables, self.repos().select("repo_id", "version"))

        def change(manifest: dict) -> dict:
            for name in tables:
                since = [s for s in manifest["segments"][name] if s not in before["segments"][name]]
                manifest["segments"][name] = [segment, *since]
            return manifest

        self.update(change)

    def compact(self) -> None:
        """Rewrite the rows that count as one segment and list only that."""
        if any(self.manifest()["segments"].values()):
            self.replace_tables({name: self.table(name) for name in TABLES})


#: The one manifest of stores from before manifests were numbered; the first update of such a store writes a numbered one.
SINGLE_MANIFEST = "MANIFEST.json"


def _migrated(old: dict | None) -> dict:
    """The manifest of a store without numbered ones: empty, or the single one of old, whose segments held every table."""
    if old is None:
        return _empty()
    return {"segments": {name: list(old["segments"]) for name in TABLES}, "repos": old["repos"], "number": 0}


def _empty() -> dict:
    return {"segments": {name: [] for name in TABLES}, "repos": {}, "number": 0}


def status(repos: DataFrame) -> DataFrame:
    """Summary of repositories: their number, the chunks in them, and the sorted sources."""
    return repos.agg(
        F.count(F.lit(1)).alias("repos"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"),
        F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"),
    )


def upsert(table: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The table after rows replaced those with the same key."""
    return only_in(table, rows, key).unionByName(rows)


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The table without the rows of some ids."""
    return only_in(table, ids, key)
