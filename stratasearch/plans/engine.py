"""The engine: index repositories into a store, search it, find related chunks."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import Languages
from ..operators import bm25, dense
from ..operators.chunking import Splitter, structural_chunks, syntax_splitter, with_chunk_ids
from ..operators.lookups import chunk_at_line, containing_repo, only_in
from ..sources import git
from ..sources.config import Config
from ..sources.walker import scan_files, walk
from . import search as plans
from .store import RepoNotIndexedError, Store

CHUNKER_VERSION = "v2"


@dataclass(frozen=True)
class IndexOutcome:
    """What indexing a repository did."""

    repo_id: str
    chunk_count: int
    indexed: bool


class Engine:
    """Retrieval over the repositories of one store. Results are DataFrames."""

    def __init__(
        self,
        spark: SparkSession,
        config: Config | None = None,
        encoder: dense.Encoder | None = None,
        languages: Languages | None = None,
        splitter: Splitter = syntax_splitter,
        chunker_version: str = CHUNKER_VERSION,
    ):
        """``splitter`` divides source code; give another ``chunker_version`` with it, for chunks of two ways must not meet under one id."""
        self.spark, self.config = spark, config or Config()
        self.encoder = encoder or dense.create_encoder(self.config.embedding)
        self.languages = languages or Languages()
        self.splitter, self.chunker_version = splitter, chunker_version
        self.store = Store(spark, os.path.expanduser(self.config.store.path))
        self._healed = False

    # indexing -------------------------------------------------------------------------------------------------

    def repo_id(self, source: str, ref: str | None = None) -> str:
        """An id that changes with the encoder and the way of chunking, so that mixed vectors never meet."""
        raw = f"{git.identity(source, ref)}|model={self.encoder.name}|dim={self.encoder.dim}|chunker={self.chunker_version}"
        return hashlib.sha256(raw.encode()).hexdigest()[:32]

    def _state_of(self, source: str, include_text_files: bool, ref: str | None, refresh: bool) -> dict:
        """What a repository's rows depend on, as its row in the store has it."""
        root = git.checkout(source, ref, os.path.expanduser(self.config.store.clones), refresh)
        own = os.path.relpath(os.path.abspath(self.store.path), root)
        ignore = () if own.startswith("..") or "://" in self.store.path else (f"/{own}/",)  # the engine's tables are no sources
        listed = list(walk(root, self.languages.extensions(include_text_files), ignore))
        return {
            "repo_id": self.repo_id(source, ref),
            "source": git.identity(source, ref),
            "source_path": root,
            "include_text_files": include_text_files,
            "embedding_model": self.encoder.name,
            "embedding_dim": self.encoder.dim,
            "chunker_version": self.chunker_version,
            "commit_sha": git.source_state(root, listed),
            "ignore": list(ignore),
        }

    def index_repo(self, source: str, include_text_files: bool = False, force: bool = False, ref: str | None = None) -> IndexOutcome:
        """Index a repository, or bring it up to date; see ``index_repos``. What goes wrong is raised."""
        outcome = self.index_repos([(source, include_text_files, ref)], force)[0]
        if isinstance(outcome, Exception):
            raise outcome
        return outcome

    def index_repos(self, sources: list[tuple[str, bool, str | None]], force: bool = False) -> list[IndexOutcome | Exception]:
        """Index repositories (source, include_text_files, ref), or bring them up to date: an outcome for each, or the error that stopped it.

        Nothing happens where a repository's state is the stored one. The others are written as one segment and committed together: vectors of
        chunks that were there before are taken over, only new chunks are encoded. Old versions count until then, so a failure leaves them as they were. A
        repository without files to index is removed, with a ValueError as its outcome. Where texts could not be encoded, the state is not
        recorded, so the next run tries them again.
        """
        outcomes: list[IndexOutcome | Exception | None] = [None] * len(sources)
        changed: dict[str, tuple[int, dict]] = {}
        for k, (source, include_text_files, ref) in enumerate(sources):
            try:
                row = self._state_of(source, include_text_files, ref, force)
            except (OSError, ValueError, RuntimeError) as error:
                outcomes[k] = error
                continue
            known = self.store.repo(row["repo_id"])
            if not force and known and all(known.get(name) == row[name] for name in ("commit_sha", "include_text_files")):
                outcomes[k] = IndexOutcome(row["repo_id"], int(known.get("chunk_count") or 0), indexed=False)
            else:
                changed[row["repo_id"]] = (k, row)  # a repository that is named twice is indexed once
        if changed:
            counts, missing, segment, version = self._write([row for _, row in changed.values()], force)
            done = []
            for repo_id, (k, row) in changed.items():
                if counts.get(repo_id, 0) == 0:
                    self.store.remove_repo(repo_id)
                    outcomes[k] = ValueError(f"no files to index below {row['source_path']}")
                    continue
                state = "" if missing.get(repo_id) else row["commit_sha"]
                done.append({name: value for name, value in row.items() if name != "ignore"} | {"commit_sha": state, "chunk_count": counts[repo_id], "version": version})
                outcomes[k] = IndexOutcome(repo_id, counts[repo_id], indexed=True)
            if done:
                self.store.put_repos(done, segment)
        for k, (source, _, ref) in enumerate(sources):  # repeated sources share an outcome
            if outcomes[k] is None:
                outcomes[k] = outcomes[changed[self.repo_id(source, ref)][0]]
        return outcomes

    def _write(self, rows: list[dict], force: bool) -> tuple[dict[str, int], dict[str, int], str, int]:
        """Write a segment with the rows of some repositories: their numbers of chunks, and of chunks without a vector, the segment, the version."""
        settings, files = self.config.indexing, None
        for row in rows:
            found = scan_files(
                self.spark, row["source_path"], row["repo_id"], row["include_text_files"], self.languages, settings.max_file_bytes, row["ignore"]
            )
            files = found if files is None else files.unionByName(found)
        chunks = with_chunk_ids(structural_chunks(files, self.splitter, desired=settings.desired_chunk_chars, most=settings.max_chunk_chars))
        chunks = chunks.dropDuplicates(["chunk_id"]).persist()
        tokens = bm25.tokenized(chunks).persist()
        try:
            counts = {r["repo_id"]: r["n"] for r in chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).collect()}
            old = self.store.table("vectors").where(F.col("namespace").isin([r["repo_id"] for r in rows]) & F.col("vector").isNotNull())
            if force:
                old = old.limit(0)
            kept = old.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
            new = dense.encoded(only_in(chunks.select("chunk_id", "repo_id", "content"), old), self.encoder, "content", self.config.embedding.batch_size)
            wrong = F.col("vector").isNotNull() & (F.size("vector") != self.encoder.dim)
            vector = F.when(wrong, F.raise_error(F.lit(f"a vector without the {self.encoder.dim} components of {self.encoder.name}"))).otherwise(F.col("vector"))
            fresh = new.select("chunk_id", F.col("repo_id").alias("namespace"), vector.cast("array<float>").alias("vector"), "embed_error")
            version = self.store.new_version()
            tables = {"chunks": chunks, "vectors": kept.unionByName(fresh), "postings": bm25.postings(tokens), "doc_stats": bm25.doc_stats(tokens)}
            segment = self.store.write_segment(tables, version)
        finally:
            tokens.unpersist()
            chunks.unpersist()
        written = self.store.segment("vectors", segment)
        missing = written.where("vector IS NULL").groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
        return counts, {r["namespace"]: r["n"] for r in missing.collect()}, segment, version

    def heal(self) -> bool:
        """Rebuild postings and statistics from the chunks where their numbers differ; whether that was needed."""
        chunks, stats = self.store.table("chunks"), self.store.table("doc_stats")
        if chunks.count() == stats.count():
            return False
        tokens = bm25.tokenized(chunks)
        self.store.replace_tables({"postings": bm25.postings(tokens), "doc_stats": bm25.doc_stats(tokens)})
        return True

    def load(self) -> Store:
        """The store, healed if need be the first time that this engine reads it."""
        if not self._healed:
            self._healed = True
            self.heal()
        return self.store

    # reading --------------------------------------------------------------------------------------------------

    def resolve_repo_id(self, repo: str) -> str:
        """The id of an indexed repository by id, source, or a path inside of it."""
        if self.store.has_repo(repo):
            return repo
        exact = self.store.repo_ids_of(git.identity(repo))
        if exact:
            return exact[0]
        asked = self.spark.createDataFrame([(0, git.identity(repo))], "path_id int, path string")
        found = containing_repo(asked, self.store.repos()).first()
        if found is None:
            raise RepoNotIndexedError(self.repo_id(repo), repo)
        return found["repo_id"]

    def search(self, query: str, top_k: int = 5, repo: str | None = None, alpha: float | None = None, prefilter: bool = False) -> DataFrame:
        """The best chunks for a query, in all repositories or in one."""
        scope = None if repo is None else self.resolve_repo_id(repo)
        rows = self.spark.createDataFrame([(0, query, scope)], "query_id long, query string, scope string")
        return self._search(rows, scope, top_k, alpha, prefilter)

    def batch_search(self, queries: DataFrame, top_k: int = 5, alpha: float | None = None, prefilter: bool = False) -> DataFrame:
        """The best chunks for each of the queries (query_id, query, and optionally scope) in one plan."""
        return self._search(queries, None, top_k, alpha, prefilter)

    def _search(self, queries: DataFrame, scope: str | None, top_k: int, alpha: float | None, prefilter: bool) -> DataFrame:
        store = self.load()
        scopes = plans.scoped(queries).select("scope")
        tables = {name: store.table(name, scopes) for name in ("chunks", "vectors")} | {name: store.table(name) for name in ("postings", "doc_stats")}
        if scope is not None:  # the same for all queries, so the scan of the vectors can leave the others out
            tables["vectors"] = dense.in_namespaces(tables["vectors"], only=[scope])
        return plans.search(
            queries, tables["chunks"], tables["vectors"], tables["postings"], tables["doc_stats"], store.repos(),
            self.encoder, top_k, self.config.ranking.coarse_multiplier, alpha, prefilter, self.config.store.metric,
        )

    def find_related(
        self, file_path: str, line: int, repo: str, top_k: int = 5, exclude_source_repo: bool = True, re_embed: bool = False
    ) -> DataFrame:
        """Chunks like the one at a line; empty where no chunk is there. The repository must be indexed itself.

        The stored vector is used; ``re_embed`` encodes the chunk again.
        """
        ids = [repo] if self.store.has_repo(repo) else self.store.repo_ids_of(git.identity(repo))
        if not ids:
            raise RepoNotIndexedError(self.repo_id(repo), repo)
        place = self.spark.createDataFrame([(0, ids[0], file_path, line)], "place_id long, repo_id string, file_path string, line int")
        chunks, vectors = self.store.table("chunks"), self.store.table("vectors")
        seed = chunk_at_line(chunks, place).select(F.col("place_id").alias("query_id"), "chunk_id", "repo_id", "content")
        if re_embed:
            seeds = dense.encoded(seed, self.encoder).select("query_id", "chunk_id", "repo_id", "vector")
        else:
            seeds = seed.join(vectors.select("chunk_id", F.col("namespace").alias("repo_id"), "vector"), ["chunk_id", "repo_id"])
        return plans.related(seeds, chunks, vectors, self.store.repos(), top_k, exclude_source_repo, self.config.store.metric)

    def status(self) -> DataFrame:
        """One row: repositories, chunks, sources."""
        return self.store.status()
