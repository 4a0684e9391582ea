"""An index that grows: batches of documents are segments with their own postings and statistics, and replaced or
deleted documents are named in later ones. Searches read the segments as one index, with exact statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.dictionary import Dictionary, save_dictionary
from textloom.operators.index import Index, document_postings, schemas, write_terms
from textloom.sources.shared import delete, exists

#: Ids of documents that are gone, up to which they are broadcast; beyond it they are shuffled.
BROADCAST_IDS = 1_000_000
COMMIT = "n bigint, base bigint, gone bigint, batch bigint"


class GrowingIndex:
    """The index in a folder that driver and executors share; there is one writer at a time.

    Tables: ``postings``, ``doc_stats``, ``term_stats``, ``gone`` (ids whose earlier postings no longer count),
    ``variants`` and ``grams``, each with a folder for every segment. A segment is there once its row in
    ``commits`` is: what a writer that failed has left is not read, and the next one writes over it.

    A batch of new documents reads the ids of those that are there, not their postings. Replacing and deleting
    read the postings once, to take them from the terms' frequencies. Null ids are left out; empty and null texts
    have no postings, but still replace what was there. Documents of one batch with equal ids are one document."""

    def __init__(self, spark: SparkSession, path: str, analyzer: str = "plain"):
        self.spark, self.path, self.analyzer = spark, path, analyzer

    # what is there

    def _commits(self) -> list:
        """A row for each segment since the last merge that was cleaned up."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.path}/commits").collect()
        base = max((r.base for r in rows), default=0)
        return sorted((r for r in rows if r.n >= base), key=lambda r: r.n)

    def _folders(self, name: str, commits: list) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={r.n}" for r in commits])

    def _live(self, name: str, commits: list) -> DataFrame:
        """Rows of documents that were not replaced or deleted after their segment."""
        rows = self._folders(name, commits)
        removing = [r for r in commits if r.gone]
        if removing:
            gone = self._folders("gone", removing).groupBy("doc_id").agg(F.max("segment").alias("until"))
            if sum(r.gone for r in removing) <= BROADCAST_IDS:
                gone = F.broadcast(gone)
            rows = rows.join(gone, "doc_id", "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")
        return rows.drop("segment")

    def index(self) -> Index:
        """All live documents as one index; frequencies are sums over segments, to which conditions on terms
        are pushed down. Terms of the dictionary that no document has any more find no postings."""
        commits = self._commits()
        if not commits:
            raise ValueError(f"nothing has been added to {self.path}")
        terms = self._folders("term_stats", commits).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        words = Dictionary(self._folders("variants", commits), self._folders("grams", commits))
        return Index(self._live("postings", commits).select("term", "doc_id", "tf", "positions"), self._live("doc_stats", commits).select("doc_id", "dl"), terms, self.analyzer, words)

    # changes

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int | None = None) -> None:
        """Adds documents, and replaces those with the same ids. A ``batch`` that was added before is not added
        again, so a stream can repeat one."""
        commits = self._commits()
        if batch is not None and any(r.batch is not None and r.batch >= batch for r in commits):
            return
        ids = docs.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").groupBy("doc_id").count()
        path = f"{self.path}/grouped"
        rows = document_postings(docs, id_col, text_col, self.analyzer)
        rows.write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(rows.schema).parquet(path)
        repeated = ids.where("count > 1").select("doc_id")
        if not repeated.isEmpty():
            again = rows.join(repeated, "doc_id", "left_semi").groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
            rows = rows.join(repeated, "doc_id", "left_anti").select("term", "doc_id", "tf", "positions").unionByName(again)
        self._write(commits, rows, ids.select("doc_id"), batch)
        delete(self.spark, path)

    def delete(self, ids: DataFrame) -> None:
        """Deletes the documents in ``ids`` (doc_id); ids that are not there do nothing."""
        commits = self._commits()
        if commits:
            none = self._folders("postings", commits).drop("segment").where("false")
            self._write(commits, none, ids.select("doc_id").where("doc_id is not null").distinct(), None)

    def merge(self) -> None:
        """Writes all live documents as one segment, which later searches read alone. Earlier ones stay until
        ``clean``, for searches that still read them."""
        commits = self._commits()
        if commits:
            self._write(commits, self._live("postings", commits).select("term", "doc_id", "tf", "positions"), None, max((r.batch for r in commits if r.batch is not None), default=None))

    def clean(self) -> None:
        """Deletes the segments before the last merge. Only for when no search reads them any more."""
        if not (commits := self._commits()):
            return
        old = self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.path}/commits").where(F.col("n") < commits[0].n).collect()
        for r in old:
            delete(self.spark, f"{self.path}/commits/{r.n}")
            for name in ("postings", "doc_stats", "term_stats", "gone", "variants", "grams"):
                delete(self.spark, f"{self.path}/{name}/segment={r.n}")

    def _write(self, commits: list, postings: DataFrame, ids: DataFrame | None, batch: int | None) -> None:
        """One segment. ``ids``: documents whose earlier postings go; None for a merge."""
        n = commits[-1].n + 1 if commits else 1
        at = lambda name: f"{self.path}/{name}/segment={n}"
        write_terms(postings, at("postings"), "doc_id")
        own = self.spark.read.schema(postings.schema).parquet(at("postings"))
        # a document's postings lie together in a batch, not in the ranges of terms
        postings.groupBy("doc_id").agg(F.sum("tf").alias("dl")).write.mode("overwrite").parquet(at("doc_stats"))
        counted, gone = own.groupBy("term").agg(F.count("*").alias("df")), 0
        if ids is not None and commits:
            known = self._live("doc_stats", commits).select("doc_id").join(ids, "doc_id", "left_semi")
            known.write.mode("overwrite").parquet(at("gone"))
            known = self.spark.read.schema(known.schema).parquet(at("gone"))
            if gone := known.count():
                lost = self._live("postings", commits).join(F.broadcast(known) if gone <= BROADCAST_IDS else known, "doc_id", "left_semi")
                counted = counted.unionByName(lost.groupBy("term").agg((-F.count("*")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        write_terms(counted, at("term_stats"))
        # what has no more documents here than were lost was in an earlier segment, whose dictionary names it
        save_dictionary(self.spark.read.schema(schemas()["term_stats"]).parquet(at("term_stats")).where("df > 0"), self.path, f"/segment={n}")
        base = n if ids is None else commits[0].base if commits else n
        row = self.spark.createDataFrame([(n, base, gone, batch)], COMMIT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{n}")
