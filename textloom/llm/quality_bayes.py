"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes.

Two logistic models over shape features and learned evidence (words, and beginnings of words) give the chance
that a document is of low quality and that it is toxic; either makes it bad. Hosts, and paths within hosts,
have a rate of bad documents each. These rates are shrunk: a path's towards its host's, a host's towards the
corpus', the more the fewer documents it has. A prior counts as many documents as the variance within sites
is times that between them, which is what the rates spread beyond chance. A document's odds are then moved by
how far its site's rate, without the document itself, is from the corpus'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize, small_or_shuffled
from textloom.llm.decontaminate import WORD_BYTES, words_of

#: Labelled documents that the model is fitted on at most (those with the smallest hash of their id).
MAX_TRAIN = 10_000
#: Pieces of evidence of each model, and documents that one must be in.
MAX_WORDS, LEAST_DOCS = 512, 5
#: Log-likelihood ratio of evidence at least (chance gives that in 1 of 600 cases).
LEAST_GAIN = 10.0
#: Characters of the beginnings of words that are evidence besides the words.
STARTS = range(3, 9)
RIDGE = 1.0
THRESHOLD = 0.5
_SHAPES = 14
#: Rows that the fit holds as real numbers: 4 MB.
FIT_ROWS = 1_024


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """Shape features, each between 0 and a small number; all zero without words."""
    if not words:
        return [0.0] * _SHAPES
    size, n = len(text), len(words)
    without = lambda chars: size - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = [without(b"#*$%&"), without(b"|<>{}"), without(b"!?"), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"0123456789"), without(b".,;:"), max(0, size - n - sum(map(len, words)))]
    ratios = [np.log1p(100 * m / size) for m in marks]
    distinct = len(set(words)) / n
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    return [*ratios, distinct, pairs, repeated, np.log(n) / 10, float(n < 20), sum(map(len, words)) / n / 10, np.log1p(n / max(1, len(lines))) / 5]


def evidence(word: bytes) -> list[str]:
    """A word and its beginnings of STARTS characters (shorter than the word), which are marked by a circumflex
    (no character of words)."""
    w = word.decode()
    return [w, *(f"^{w[:k]}" for k in STARTS if k < len(w))]


@dataclass
class Model:
    """Models of one or more ways to be bad, over the same shape features and each with its own evidence."""

    mean: np.ndarray
    scale: np.ndarray
    heads: list[tuple[dict[str, int], np.ndarray]]  # evidence and weights: of the shapes, the evidence, the constant

    def __post_init__(self):
        self._whole = [{w.encode(): i for w, i in v.items() if w[0] != "^"} for v, _ in self.heads]
        self._starts = None  # made where texts are scored

    def found(self, text: bytes, words: set[bytes]) -> list[list[int]]:
        """The evidence of each model in a text: whole words by their set, beginnings by one scan of the text."""
        if self._starts is None:
            self._starts = ahocorasick.Automaton()
            for start in sorted({w for v, _ in self.heads for w in v if w[0] == "^"}):
                self._starts.add_word(f" {start[1:].encode().decode('latin-1')}", [v.get(start, -1) for v, _ in self.heads])
            if len(self._starts):
                self._starts.make_automaton()
        out = [[own[w] for w in own.keys() & words] for own in self._whole]
        if len(self._starts):
            begun = {tuple(ids) for _, ids in self._starts.iter((b" " + text.translate(WORD_BYTES)).decode("latin-1"))}
            for k, ids in enumerate(out):
                ids += [x[k] for x in begun if x[k] >= 0]
        return [sorted(ids) for ids in out]

    def score(self, text: bytes, words: list[bytes]) -> float:
        """Log-odds of being bad in one way or another."""
        x = (np.array(shape(text, words)) - self.mean) / self.scale
        fine = 0.0  # logarithm of the chance of not being bad
        for found, (_, weights) in zip(self.found(text, set(words)), self.heads, strict=True):
            odds = float(x @ weights[:_SHAPES] + weights[_SHAPES:-1][found].sum() + weights[-1])
            fine -= np.logaddexp(0.0, min(max(odds, -30.0), 30.0))
        return float(np.log(-np.expm1(fine)) - fine)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25, marks: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one is the constant, which is not shrunk) by Newton's method. ``marks``: more columns, as
    bytes. Sums are taken over blocks of rows, so only a block of marks is held as real numbers."""
    marks = np.zeros((len(x), 0), np.uint8) if marks is None else marks
    m = x.shape[1] + marks.shape[1] + 1
    w, penalty = np.zeros(m), np.full(m, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        slope, curve = penalty * w, np.diag(penalty)
        for at in range(0, len(x), FIT_ROWS):
            cut = slice(at, at + FIT_ROWS)
            rows = np.concatenate([x[cut], marks[cut], np.ones((len(x[cut]), 1))], 1)
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            slope += rows.T @ (p - y[cut])
            curve += (rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int) -> DataFrame:
    """text, poor and toxic (1, 0 or null) of a bounded sample of the labelled documents."""
    poor, toxic = F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 0)
    known = labels.select(F.col(id_col).alias("__id"), poor.alias("poor"), toxic.alias("toxic")).where("__id is not null and (poor is not null or toxic is not null)")
    known = known.groupBy("__id").agg(F.max("poor").alias("poor"), F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("__id", F.lit(17)), "__id").limit(max_train)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("text")).join(F.broadcast(chosen), "__id")
    # an id on many rows gives one of its texts
    return materialize(rows.groupBy("__id").agg(F.min("text").alias("text"), F.first("poor").alias("poor"), F.first("toxic").alias("toxic")).select("text", "poor", "toxic"), "labelled")


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


#: Ways to be bad: columns of the sample.
WAYS = ["poor", "toxic"]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS) -> Model | None:
    """A model with a part for low quality and one for toxicity, each only if the labelled documents are of
    both kinds; None without any.

    Evidence has the largest log-likelihood ratio between the kinds, counted over the sample on the executors.
    (A weighted log-odds would put evidence that fine documents never hold behind much weaker pieces.)
    The fit takes at most ``max_train`` short rows to the driver."""
    rows = _labelled(docs, labels, id_col, text_col, max_train)
    totals = rows.agg(*[x for w in WAYS for x in (F.count(w).alias(f"n_{w}"), F.coalesce(F.sum(w), F.lit(0)).alias(f"b_{w}"))]).first()
    ways = [w for w in WAYS if 0 < totals[f"b_{w}"] < totals[f"n_{w}"]]
    if not ways:
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = sorted({x for w in set(words_of(batch.column(0)[i].as_py())) for x in evidence(w)})
                marks = [pa.array([batch.column(k)[i].as_py()] * len(found), pa.int32()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *marks], ["word", *WAYS])

    counts = rows.mapInArrow(words, "word string, poor int, toxic int").groupBy("word").agg(*[x for w in WAYS for x in (F.count(w).alias(f"n_{w}"), F.sum(w).alias(f"b_{w}"))])
    counts = materialize(counts.where(F.greatest(*[f"n_{w}" for w in WAYS]) >= LEAST_DOCS), "evidence")
    vocabularies = []
    for w in ways:
        n, n_bad = totals[f"n_{w}"], totals[f"b_{w}"]
        b, g = F.col(f"b_{w}"), F.col(f"n_{w}") - F.col(f"b_{w}")
        gain = 2 * (_xlogx(b) + _xlogx(g) + _xlogx(n_bad - b) + _xlogx(n - n_bad - g) - _xlogx(b + g) - _xlogx(n - b - g) - _xlogx(F.lit(n_bad)) - _xlogx(F.lit(n - n_bad)) + _xlogx(F.lit(n)))
        best = counts.where(F.col(f"n_{w}") >= LEAST_DOCS).select("word", gain.alias("gain")).where(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "word").limit(max_words)
        vocabularies.append({r.word: i for i, r in enumerate(best.collect())})
    blank = Model(np.zeros(_SHAPES), np.ones(_SHAPES), [(v, np.zeros(0)) for v in vocabularies])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, found = [], [[] for _ in vocabularies]
            for text in batch.column(0).to_pylist():
                w = words_of(text)
                shapes.append(shape(text, w))
                for ids, own in zip(found, blank.found(text, set(w)), strict=True):
                    ids.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(shapes, pa.list_(pa.float64())), *(pa.array(x, pa.list_(pa.int32())) for x in found), batch.column(1), batch.column(2)], ["shape", *(f"words_{w}" for w in ways), *WAYS])

    sample = rows.mapInArrow(features, f"shape array<double>, {', '.join(f'words_{w} array<int>' for w in ways)}, poor int, toxic int").toArrow()
    s = np.array(sample.column("shape").to_pylist())
    mean, scale = s.mean(0), s.std(0) + 1e-6
    heads = []
    for w, vocabulary in zip(ways, vocabularies, strict=True):
        y = sample.column(w).to_numpy(zero_copy_only=False).astype(float)
        marks = np.zeros((len(y), len(vocabulary)), np.uint8)
        for i, found in enumerate(sample.column(f"words_{w}").to_pylist()):
            marks[i, found] = 1
        known = ~np.isnan(y)
        heads.append((vocabulary, fit_logistic(((s - mean) / scale)[known], y[known], marks=marks[known])))
    return Model(mean, scale, heads)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def odds_of(text: Column, model) -> Column:
    """Log-odds of being bad by a broadcast model (None: 0). Null if the text has no words. Texts alone go to
    Python, and a number each comes back."""

    @F.arrow_udf("double")
    def odds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = model.value
        for texts in batches:
            out = []
            for at in range(0, len(texts), 512):
                for t in texts.slice(at, 512).to_pylist():
                    w = words_of(t)
                    out.append(None if not w else known.score(t, w) if known else 0.0)
            yield pa.array(out, pa.float64())

    return odds(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def prior_counts(sites: DataFrame) -> tuple[float, float, float]:
    """Mean rate, and how many documents a host's and a path's prior count as. ``sites``: __host, __path and,
    of the chances of their documents, n (number), s (sum), ss (sum of squares).

    One-way analysis of variance, first of hosts, then of paths within hosts: the squares within sites give
    the variance v of single documents, and what is left of the squares between sites after the share that
    v explains gives the variance t between sites. A prior counts as v / t documents, 1 to a million."""
    hosts = sites.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"), F.count("*").alias("paths"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("means"))
    # squares of sums over n, on three levels: all, hosts, paths
    r = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hss").alias("ss"), F.count("*").alias("hosts"), F.sum("paths").alias("paths"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("h"), F.sum("means").alias("p"), F.sum(F.col("hn") * F.col("hn")).alias("hnn"), F.sum(F.col("nn") / F.col("hn")).alias("pnn")).first()
    if not r.n:
        return 0.5, 1e6, 1e6

    def count(within: float, documents: float, between: float, groups: float, share: float) -> float:
        v = within / documents if documents > 0 else 0.0
        t = (between - groups * v) / share if share > 0 else 0.0
        return float(np.clip(v / t, 1, 1e6)) if t > 0 else 1e6

    host = count(r.ss - r.h, r.n - r.hosts, r.h - r.s * r.s / r.n, r.hosts - 1, r.n - r.hnn / r.n)
    path = count(r.ss - r.p, r.n - r.paths, r.p - r.h, r.paths - r.hosts, r.n - r.pnn)
    return r.s / r.n, host, path


#: Columns that ``classify`` adds.
ADDED = ["qb_odds", "qb_document", "qb_host", "qb_path", "qb_bad", "qb_kept"]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns of ``docs`` by default) and the probabilities of being bad by the document alone
    (qb_document), of its host and path, and combined (qb_bad); qb_kept is false from ``threshold`` on, and
    for texts without words. Columns of these names are replaced.

    A null host or path is a site of its own. Without labels of both kinds there is no evidence, and all
    documents with words are kept. The scored table is written once; rates are sums by site, pre-aggregated
    before the shuffle, and come back by a join with one narrow row per site."""
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    model = train(docs, labels, id_col, text_col, max_train)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # the row is one column meanwhile, so its names cannot clash with ours
    scored = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.col(host_col).cast("string").alias("__host"), F.col(path_col).cast("string").alias("__path"), odds_of(F.col(text_col), shared).alias("qb_odds"))
    scored = materialize(scored, "scored")
    p = 1 / (1 + F.exp(-F.col("qb_odds")))
    site = [F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(c) for c in ("__host", "__path")]
    sites = scored.where("qb_odds is not null").select(*site, p.alias("p")).groupBy("__host", "__path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    sites = materialize(sites, "sites")
    m, k_host, k_path = prior_counts(sites)
    hosts = sites.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    rates = sites.join(hosts, "__host").select("__host", "__path", "n", "s", ((F.col("hs") + k_host * m) / (F.col("hn") + k_host)).alias("qb_host"))
    rates = small_or_shuffled(materialize(rates, "rates"))
    out = scored.withColumns({"__h": site[0], "__p": site[1]}).drop("__host", "__path").join(rates.withColumnsRenamed({"__host": "__h", "__path": "__p"}), ["__h", "__p"], "left")
    other = (F.greatest(F.col("s") - p, F.lit(0.0)) + k_path * F.col("qb_host")) / (F.col("n") - 1 + k_path)
    combined = F.col("qb_odds") + _logit(other) - _logit(F.lit(m))
    out = out.withColumns({"qb_document": p, "qb_path": other, "qb_bad": 1 / (1 + F.exp(-combined))})
    return out.withColumn("qb_kept", F.coalesce(F.col("qb_bad") < threshold, F.lit(False)) if model else F.col("qb_odds").isNotNull()).select(*[F.col("row")[c].alias(c) for c in columns], *ADDED)
