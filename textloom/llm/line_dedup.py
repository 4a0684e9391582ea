"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Edits allowed depend on a line's length: none below ``near_chars`` characters, one from there on. Within no
edit, a line has one variant, itself. Two lines within one edit of each other share a variant: either line
with one character deleted, or as it is. A line of L characters has L + 1 variants, which for lines of some
hundred characters is far more text than the corpus. So variants come in two steps. First, four per line and
length: the line without one of its quarters, cut at the places of the shorter line's quarters. An edit falls
into one quarter, so lines one edit apart agree in a variant. Then, only for lines that share such a variant
with another line, the deletion variants of the quarter left out, hashed with the rest of the line: together
exactly the full neighbourhood of the line. Lines up to ``short`` emit their full neighbourhood at once.

Lines that give a variant by deleting the same place are one substitution apart, and a line that is a
variant as it stands is one deletion from all that give it. So each line needs only the earliest line of
these as a witness, not a pair with every other one, and that pair is verified with ``levenshtein``. A line
goes if an earlier line is equal to it or one edit away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_ROWS, materialize, small_or_shuffled

#: Lines with fewer characters (after trimming) go only if an equal line is earlier; one edit makes another word of them.
NEAR_CHARS = 20
#: Lines with fewer characters are left alone: 1, so blank lines only.
MIN_CHARS = 1
#: Lines up to here emit every deletion variant at once.
SHORT = 40
QUARTERS = 4


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, doc (hash of id and text), pos, line, h (two hashes of the line) of lines of some length."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(F.col(id_col).cast("long"), text).alias("doc"))
    rows = rows.select("id", "doc", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line")).withColumn("line", F.trim(F.col("line"), F.lit(" \t\r"))).where(F.length("line") >= min_chars)
    return rows.withColumn("h", F.struct(F.xxhash64("line").alias("a"), F.hash("line").alias("b")))


def _cuts(length: Column, k: int) -> tuple[Column, Column]:
    """Begin of quarter k of a line of some length, and of what follows it."""
    cut = lambda q: F.floor(length * q / QUARTERS).cast("int")
    return cut(k), cut(k + 1)


def _quarter_keys(line: Column) -> list[tuple[Column, Column]]:
    """(key, middle) for each quarter, by the line's own length and, as the longer of two, by one less."""
    out, size = [], F.length(line)
    for shorter in (0, 1):
        length = size - shorter
        for k in range(QUARTERS):
            begin, end = _cuts(length, k)
            tail = length - end
            key = F.xxhash64(length, F.lit(k), F.left(line, begin), F.right(line, tail))
            out.append((key, F.substring(line, begin + 1, size - begin - tail)))
    return out


def _without_each(text: Column) -> Column:
    """Variants (at, v): the text without the character at each place, from 1, and as it is (0)."""
    size = F.length(text)
    none = F.array().cast("array<struct<at:int,v:string>>")
    one = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("at"), F.concat(F.left(text, i - 1), F.right(text, size - i)).alias("v")))
    return F.concat(F.array(F.struct(F.lit(0).alias("at"), text.alias("v"))), F.when(size > 0, one).otherwise(none))


def _short_key(variant: Column) -> Column:
    return F.xxhash64(F.lit("short"), variant)


def _keys(line: Column, short: int, near_chars: int) -> Column:
    quarters = F.array(*[k for k, _ in _quarter_keys(line)])
    every = F.transform(_without_each(line), lambda x: _short_key(x["v"]))
    size = F.length(line)
    return F.when(size < near_chars, F.array().cast("array<bigint>")).when(size <= short, every).when(size == short + 1, F.concat(every, quarters)).otherwise(quarters)


def _neighbourhood(lines: DataFrame, shared: DataFrame, short: int) -> DataFrame:
    """key, at, h, first: the full deletion neighbourhood of lines, as far as it lies within shared variants."""
    line = F.col("line")
    quarters = lines.where(F.length("line") > short).select("h", "first", F.explode(F.array(*[F.struct(k.alias("key"), F.lit(n).alias("n"), m.alias("middle")) for n, (k, m) in enumerate(_quarter_keys(line))])).alias("q")).select("h", "first", "q.*")
    quarters = quarters.join(shared, "key", "left_semi").select("h", "first", "key", F.explode(_without_each(F.col("middle"))).alias("x")).select(F.xxhash64("key", "x.v").alias("key"), "x.at", "h", "first")
    every = lines.where(F.length("line") <= short + 1).select("h", "first", F.explode(_without_each(line)).alias("x")).select(_short_key(F.col("x.v")).alias("key"), "x.at", "h", "first").join(shared, "key", "left_semi")
    return quarters.unionByName(every.select("key", "at", "h", "first")).distinct()


def _witnesses(around: DataFrame) -> DataFrame:
    """h, w: lines with an earlier line that shares a variant in a way that is one edit at most. A group has
    the distinct lines that give one variant: for each place in it, those of one inserted character."""
    me = F.struct("first", "h")
    of_place, of_key = Window.partitionBy("key", "at"), Window.partitionBy("key")
    rows = around.select("h", "first", "at", F.min(me).over(of_place).alias("same"), F.min(F.when(F.col("at") == 0, me)).over(of_key).alias("whole"), F.min(me).over(of_key).alias("any"))
    best = F.array(F.when(F.col("at") == 0, F.col("any")).otherwise(F.col("same")), F.col("whole"))
    return rows.select("h", "first", F.explode(best).alias("w")).where("w.first < first").select("h", F.col("w.h").alias("w")).distinct()


def find_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, short: int = SHORT, near_chars: int = NEAR_CHARS) -> DataFrame:
    """id, doc, pos, near: the lines to drop, by place in the document (split at line feeds). ``near`` says
    that an earlier line is one edit away; else an equal line is earlier. Lines are ordered by id (null
    last), document and place. Blank lines, and those with fewer than ``min_chars`` characters, are not
    considered.

    Lines travel as hashes; texts are gathered only for lines that share a variant with another one."""
    lines = _lines(docs, id_col, text_col, max(1, min_chars))
    seen = materialize(lines.select("id", "doc", "pos", "h", _keys(F.col("line"), short, near_chars).alias("keys")), "lines")
    place = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "doc", "pos")
    firsts = materialize(seen.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")), "first-lines")

    keyed = seen.select("h", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    shared = small_or_shuffled(materialize(shared, "shared-variants"))
    wanted = small_or_shuffled(materialize(keyed.join(shared, "key", "left_semi").select("h").distinct(), "wanted-lines"))
    texts = lines.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")).join(firsts.select("h", "first"), "h")
    texts = materialize(texts, "line-texts")
    pairs = _witnesses(_neighbourhood(texts, shared, short))
    # Lines are of any length, so their texts are never broadcast by a hint.
    pairs = pairs.join(texts.select("h", F.col("line").alias("mine")), "h").join(texts.select(F.col("h").alias("w"), F.col("line").alias("other")), "w")
    later = pairs.where(F.levenshtein("mine", "other", 1) >= 0).select("h").distinct().withColumn("near", F.lit(True))

    drop = firsts.join(later, "h", "left").where("n > 1 or near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    drop = small_or_shuffled(materialize(drop, "dropped-lines"))
    out = seen.select("id", "doc", "pos", "h", place.alias("place")).join(drop, "h").where(F.col("near") | (F.col("place") != F.col("first")))
    return out.select("id", "doc", "pos", (F.col("near") & (F.col("place") == F.col("first"))).alias("near"))


#: Columns that ``dedup_lines`` adds to those of the documents.
COUNTS = ["ld_lines", "ld_exact", "ld_near"]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_chars: int = MIN_CHARS, short: int = SHORT, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` without the lines that an earlier line makes superfluous, and ld_lines (lines before),
    ld_exact and ld_near (lines dropped). Columns of these names are replaced.

    Every other line stays as it is, blank ones included. ``chars_col``, if present, follows the text. Null texts stay null and have no lines. Rows equal in id and text count as
    one document and are treated alike; a null id comes last."""
    found = materialize(find_duplicate_lines(docs, id_col, text_col, min_chars, short, near_chars), "line-places")
    rows = found.limit(BROADCAST_ROWS + 1).count()
    lost = found.groupBy("doc").agg(F.collect_set("pos").alias("lost"), F.count_if("near").alias("near"))
    columns = [c for c in docs.columns if c not in COUNTS]
    text = F.col(text_col).cast("string")
    # the row is one column meanwhile, so its names cannot clash with ours
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(F.col(id_col).cast("long"), text).alias("doc"), F.split(text, "\n", -1).alias("lines"))
    out = out.join(F.broadcast(lost) if rows <= BROADCAST_ROWS else lost, "doc", "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost"), lambda i: F.col("lines")[i])
    changed = F.col("lost").isNotNull()
    out = out.withColumn("new", F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("row")[text_col]))

    def cell(c: str) -> Column:
        old = F.col("row")[c]
        if c == text_col:
            return F.col("new").alias(c)
        return (F.when(changed, F.length("new").cast(docs.schema[c].dataType)).otherwise(old) if c == chars_col else old).alias(c)

    total = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("ld_lines")
    near = F.coalesce("near", F.lit(0)).cast("long")
    exact = F.when(changed, F.size("lost") - near).otherwise(0).cast("long")
    return out.select(*map(cell, columns), total, exact.alias("ld_exact"), near.alias("ld_near"))
