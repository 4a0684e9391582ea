"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings stand alone: assignments of a secret, access identifiers, long hex strings. Weak candidates
(upper-case identifiers, long mixed tokens, endpoints) are common in clean text. They are reported only
where complementary parts of a credential lie within a scope of each other: an identifier with a secret,
an endpoint with both. The parts are rows with a start, and the interval join is a range window over the
starts of each document's parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize

#: Fixed patterns of the base findings: kind, pattern, group and its least length.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run, so the same as runs of any length from which the short are dropped
#: Weak candidates: whole runs of their characters, of any length from the least on.
WEAK_ID = r"\b(?=[A-Z]*[0-9])[A-Z][A-Z0-9]{15,}\b"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"\bhttps?://[^\s\"'<>]+"
#: Code points between the starts of parts that belong together.
SCOPE = 200
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]

_BLOCK = 256
_SPANS = "array<struct<s:bigint,e:bigint>>"


def _let(value: Column, use) -> Column:
    """``use`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def spans_of(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """[s, e) in code points of the pattern's leftmost non-overlapping matches whose group has at least
    ``least`` characters. Lengths of the parts between matches and of the matches are summed up in blocks,
    so a text with many matches costs little more than their number."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ok = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: F.length(g) >= least) if group else F.transform(found, lambda g: F.length(g) >= least)
    steps = F.zip_with(F.zip_with(parts, found, lambda p, m: F.struct(F.length(p).cast("long").alias("p"), F.length(m).cast("long").alias("m"))), ok, lambda x, k: F.struct(x["p"].alias("p"), x["m"].alias("m"), k.alias("k")))

    def spans(steps: Column) -> Column:
        empty = F.struct(F.array().cast(_SPANS).alias("a"), F.lit(0).cast("long").alias("at"))

        def add(c: Column, x: Column) -> Column:
            span = F.array(F.struct((c["at"] + x["p"]).alias("s"), (c["at"] + x["p"] + x["m"]).alias("e")))
            return F.struct(F.when(x["k"], F.concat(c["a"], span)).otherwise(c["a"]).alias("a"), (c["at"] + x["p"] + x["m"]).alias("at"))

        def block(c: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.array().cast(_SPANS).alias("a"), c["at"].alias("at")), add)
            return _let(inner, lambda i: F.struct(F.concat(c["a"], F.array(i["a"])).alias("a"), i["at"].alias("at")))

        outer = F.struct(F.array().cast(f"array<{_SPANS}>").alias("a"), empty["at"].alias("at"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), outer, block, lambda c: F.flatten(c["a"]))

    # the last part follows the last match: it has no match, and is left out
    counted = F.filter(steps, lambda x: x["m"].isNotNull())
    return F.when(text.rlike(pattern), _let(counted, spans)).otherwise(F.array().cast(_SPANS))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _listing(found: Column) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: the id, ``base`` and ``linked``, arrays of (s, k, e): start, number of the kind in
    KINDS, end. Null and empty texts have none. Repeated rows each get their findings; a null id is fine.
    Weak candidates that overlap a base finding are not reported again. One pass over the texts; only
    spans are shuffled, and only of documents that hold weak candidates and another part."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", "t", F.xxhash64("t").alias("h"))
    rows = rows.select(
        "id", "h", spans_of(F.col("t"), ASSIGN, 2, 6).alias("a0"), spans_of(F.col("t"), ACCESS, 0, 20).alias("a1"), spans_of(F.col("t"), HEX).alias("a2"),
        spans_of(F.col("t"), WEAK_ID).alias("a3"), spans_of(F.col("t"), WEAK_SECRET).alias("a4"), spans_of(F.col("t"), ENDPOINT).alias("a5"),
    )
    rows = rows.select("id", "h", F.concat(*[_tagged(F.col(f"a{k}"), k) for k in range(3)]).alias("base"), F.concat(*[_tagged(F.col(f"a{k}"), k) for k in range(3, 6)]).alias("weak"))
    rows = materialize(rows, "secrets")

    some = rows.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    parts = some.select("id", "h", F.explode(F.concat("base", "weak")).alias("x")).select("id", "h", "x.*").distinct()
    doc = Window.partitionBy("id", "h")
    near = doc.orderBy("s").rangeBetween(-scope, scope)
    before = doc.orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = doc.orderBy(F.desc("s"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows
    k = F.col("k")
    parts = parts.withColumns({
        "has_id": F.coalesce(F.max(k.isin(1, 3)).over(near), F.lit(False)), "has_secret": F.coalesce(F.max(k.isin(0, 2, 4)).over(near), F.lit(False)),
        "last": F.max(F.when(k < 3, F.col("e"))).over(before), "next": F.min(F.when(k < 3, F.col("s"))).over(after),
    })
    alone = (F.coalesce(F.col("last"), F.lit(-1)) <= F.col("s")) & (F.col("next").isNull() | (F.col("next") >= F.col("e")))
    linked = parts.where((k >= 3) & alone & F.col("has_id") & F.col("has_secret"))
    linked = linked.groupBy("id", "h").agg(F.collect_list(F.struct("s", "k", "e")).alias("linked"))
    r, n = rows.alias("r"), linked.alias("n")
    out = r.join(n, F.col("r.id").eqNullSafe(F.col("n.id")) & (F.col("r.h") == F.col("n.h")), "left")
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    return out.select(F.col("r.id").alias(id_col), F.col("r.base").alias("base"), F.coalesce(F.col("n.linked"), none).alias("linked"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, and the listings of base and of all findings."""

    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")

    return found.select(id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(F.concat("base", "linked")).alias("spans"))
