"""The inverted index and the chunk table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from textloom.functions import text as T
from textloom.functions.stem import stemmed
from textloom.operators.dictionary import Dictionary, load_dictionary, save_dictionary

MIN_TOKEN = 2


@dataclass
class Index:
    """postings (term, doc_id, tf, positions), doc_stats (doc_id, dl), term_stats (term, df)."""

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    analyzer: str = "plain"
    dictionary: Dictionary | None = None

    def cache(self) -> Index:
        return Index(self.postings.cache(), self.doc_stats.cache(), self.term_stats.cache(), self.analyzer, self.dictionary)


def schemas(id_type: str = "bigint", positions: bool = True) -> dict[str, S.StructType]:
    """The index's tables by name; ``id_type`` is that of the documents' ids."""
    places = ", positions array<int>" if positions else ""
    tables = {"postings": f"term string, doc_id {id_type}, tf bigint{places}", "doc_stats": f"doc_id {id_type}, dl bigint", "term_stats": "term string, df bigint"}
    return {name: S.StructType.fromDDL(ddl) for name, ddl in tables.items()}


def _words(text: Column, analyzer: str) -> Column:
    """A text's analysed words in their places, those that are dropped as nulls."""
    return T.tokens(text) if analyzer == "plain" else stemmed(T.tokens(text), MIN_TOKEN, T.STOP_WORDS)


def term_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: str = "plain") -> DataFrame:
    """term, doc_id, pos: analysed words. ``plain`` keeps every word; ``porter`` drops stop words and single
    letters and stems the rest, where texts are read. Documents without an id are left out."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(_words(F.col(text_col), analyzer)).alias("pos", "term"))
    return rows.where("term is not null").select("term", "doc_id", "pos")


def build_postings(rows: DataFrame, positions: bool = False) -> DataFrame:
    """Counts are partial before the shuffle, so frequent terms cost one row per task and document."""
    extra = [F.sort_array(F.collect_list("pos")).alias("positions")] if positions else []
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), *extra)


#: Documents whose words a task groups at a time.
GROUPED_DOCS = 512


def _grouped(part: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of some texts (doc_id, words); words that are null keep their place and have none."""
    lengths = np.diff(part.column(1).offsets.to_numpy())
    flat = part.column(1).flatten()
    row = np.repeat(np.arange(len(lengths)), lengths)
    pos = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    row, pos, terms = row[there], pos[there], flat.drop_null().dictionary_encode()
    key = row * (len(terms.dictionary) + 1) + terms.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends = np.append(first, len(order))
    places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order]))
    return pa.RecordBatch.from_arrays([terms.dictionary.take(terms.indices.take(pa.array(order[first]))), part.column(0).take(pa.array(row[order[first]])), pa.array(np.diff(ends)), places], ["term", "doc_id", "tf", "positions"])


def document_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: str = "plain") -> DataFrame:
    """``build_postings`` of each row of a table by itself: the task that reads a text groups its words, so no row for
    each word is sorted or shuffled. Rows with equal ids have postings of their own."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), _words(F.col(text_col), analyzer).alias("words"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUPED_DOCS):
                yield _grouped(batch.slice(at, GROUPED_DOCS))

    return rows.mapInArrow(group, schemas(dict(rows.dtypes)["doc_id"])["postings"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: str = "plain", positions: bool = True) -> Index:
    """An index as plans over the documents. A query's condition on terms reaches the rows before they are
    shuffled, lengths of documents need no postings, and each table is one shuffle that all its uses share."""
    postings = build_postings(term_rows(docs, id_col, text_col, analyzer), positions)
    if analyzer == "plain":
        words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.size(T.tokens(F.col(text_col))).cast("long").alias("n"))
    else:
        words = postings.select("doc_id", F.col("tf").alias("n"))
    lengths = words.groupBy("doc_id").agg(F.sum("n").alias("dl")).where("dl > 0")
    # the sum of ones is a count that reads tf, so its postings are those that are scored
    return Index(postings, lengths, postings.groupBy("term").agg(F.sum(F.least("tf", F.lit(1).cast("long"))).alias("df")), analyzer)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: str = "plain") -> DataFrame:
    """term, df of all terms: ``term_stats`` of ``build_index`` without its postings. Where each id is there once, a row's
    different terms are counted where it is read, so tasks hold terms, not postings; else equal ids meet first."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.array_distinct(F.array_compact(_words(F.col(text_col), analyzer))).alias("words"))
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    return rows.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def write_terms(rows: DataFrame, path: str, *then: str) -> None:
    """A table in ranges of terms, so a query reads the row groups of its terms only. A frequent term's rows lie in
    several ranges, cut by ``then``."""
    rows.repartitionByRange("term", *then).sortWithinPartitions("term", *then).write.mode("overwrite").parquet(path)


def save_index(index: Index, path: str, dictionary: bool = False) -> None:
    """The index's tables; with ``dictionary`` also those that find terms by edits and by masks. Both statistics
    come from the written postings, so that documents are tokenised once, not once for each table."""
    write_terms(index.postings, f"{path}/postings", "doc_id")
    postings = index.postings.sparkSession.read.schema(index.postings.schema).parquet(f"{path}/postings")
    postings.groupBy("doc_id").agg(F.sum("tf").alias("dl")).write.mode("overwrite").parquet(f"{path}/doc_stats")
    write_terms(postings.groupBy("term").agg(F.count("*").alias("df")), f"{path}/term_stats")
    if dictionary:
        save_dictionary(index.postings.sparkSession.read.parquet(f"{path}/term_stats"), path)


def load_index(spark: SparkSession, path: str, analyzer: str = "plain", dictionary: bool = False) -> Index:
    read = spark.read.parquet
    return Index(read(f"{path}/postings"), read(f"{path}/doc_stats"), read(f"{path}/term_stats"), analyzer, load_dictionary(spark, path) if dictionary else None)


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1, overlap: int = 0, min_length: int = T.MIN_SENTENCE, sentences: bool = True) -> DataFrame:
    """id, doc_id, chunk_index, text, first and last sentence, count, is_chunk. Without ``sentences`` each
    document is one record under its own id."""
    doc_id = F.col(id_col).cast("string")
    if not sentences:
        return docs.select(doc_id.alias("id"), doc_id.alias("doc_id"), F.lit(0).alias("chunk_index"), F.col(text_col).alias("text"), F.lit(0).alias("start_sentence_idx"), F.lit(0).alias("end_sentence_idx"), F.lit(1).alias("sentence_count"), F.lit(False).alias("is_chunk"))
    rows = docs.select(doc_id.alias("doc_id"), F.posexplode(T.chunks_or_whole(F.col(text_col), size, overlap, min_length)).alias("chunk_index", "c"))
    return rows.select(F.concat("doc_id", F.lit("_chunk_"), "chunk_index").alias("id"), "doc_id", "chunk_index", "c.*", F.lit(True).alias("is_chunk"))
