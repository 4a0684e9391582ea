"""What a model does elsewhere: embedding, annotation, query expansion. The defaults need no network and always
give the same results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from textloom.functions import text as T
from textloom.operators import grading
from textloom.operators.grading import json_reply
from textloom.operators.themes import excerpt, json_object


class Embedder(Protocol):
    def column(self, text: Column) -> Column: ...

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors of hashed word counts: each word adds or takes one at one of ``dims`` places."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                row[(h >> 1) % self.dims] += 1 if h & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def column(self, text: Column) -> Column:
        encode = self.encode

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(list(encode(s.fillna("").tolist()).astype(np.float32)))

        return embed(text)


class ModelEmbedder:
    """Vectors of a model that ``load`` brings: it is called once in each Python worker and returns a function from a
    list of texts to their vectors, which gets ``batch`` texts at a time. Null texts are embedded as empty ones."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32):
        self.load, self.batch = load, batch
        self._model: Callable[[list[str]], np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}  # workers load their own

    def encode(self, texts: list[str]) -> np.ndarray:
        """For a few texts, such as queries, where it is called."""
        if self._model is None:
            self._model = self.load()
        parts = [texts[i : i + self.batch] for i in range(0, len(texts), self.batch)]
        return np.concatenate([np.asarray(self._model([t or "" for t in p]), np.float64) for p in parts]) if parts else np.zeros((0, 0))

    def column(self, text: Column) -> Column:
        load = self.load

        def predictor() -> Callable[[np.ndarray], np.ndarray]:
            model = load()
            return lambda texts: np.asarray(model([str(t) for t in texts]), np.float32)

        return predict_batch_udf(predictor, return_type=ArrayType(FloatType()), batch_size=self.batch)(F.coalesce(text, F.lit("")))


class VocabularyEmbedder:
    """Unit vectors of how often each word of a short vocabulary comes, in built-in functions; all zeros for a text
    without any."""

    def __init__(self, words: list[str]):
        self.words = words

    def encode(self, texts: list[str]) -> np.ndarray:
        import re

        found = [re.findall(r"\w+", (t or "").lower()) for t in texts]
        out = np.array([[f.count(w) for w in self.words] for f in found], float).reshape(len(texts), len(self.words))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def column(self, text: Column) -> Column:
        def unit(counts: Column) -> Column:
            norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
            return F.transform(counts, lambda x: x / F.greatest(norm, F.lit(1e-12)))

        def count(t: Column, word: str) -> Column:
            return F.size(F.filter(t, lambda x: x == word)).cast("double")

        counts = T.let(T.tokens(text), lambda t: F.array(*[count(t, w) for w in self.words]))
        return T.let(counts, unit)


class Annotator(Protocol):
    """``tasks``: how many tasks may annotate at once in the whole cluster; None is any number."""

    tasks: int | None

    def quotes(self, text: Column, seed: str, n: int) -> Column: ...

    def bullet(self, text: Column, seed: str, words: str = "10-18") -> Column: ...

    def grade(self, points: DataFrame, concepts: DataFrame) -> DataFrame:
        """Answers (bullet_id, concept_id, answer, rationale, quote) of points (bullet_id, text, bullet) and concepts
        (concept_id, name, prompt); a pair may have none."""

    def summaries(self, matches: DataFrame, length: str) -> DataFrame:
        """``matches`` (concept_id, name, matches) with ``summary``."""

    def theme(self, cluster_id: int, bullets: list[str], seed: str, k: int, doc_ids: list[str] | None = None) -> list[dict]:
        """Up to ``k`` of name, prompt and example_ids: those of ``doc_ids``, a bullet's document each, that show it best."""

    def review(self, themes: list[dict], most: int) -> tuple[list[int], list[int]]: ...


class OfflineAnnotator:
    """Rules in place of a language model: quotes are sentences that hold a word of the seed (else the first
    ones), a bullet is an excerpt, an answer counts shared words, a theme is named after its frequent words, and a
    concept's summary is the first of its best examples."""

    tasks = None

    def quotes(self, text: Column, seed: str, n: int) -> Column:
        from textloom.functions.present import matching_sentences

        found = matching_sentences(text, T.query_words(seed))
        return F.slice(F.when(F.size(found) > 0, found).otherwise(T.sentences(text, T.MIN_SENTENCE)), 1, n)

    def bullet(self, text: Column, seed: str, words: str = "10-18") -> Column:
        return excerpt(text)

    def _shared(self, text: Column, name: Column, prompt: Column) -> Column:
        words = F.filter(T.tokens(F.concat_ws(" ", name, prompt)), lambda w: F.length(w) >= 3)
        return F.array_intersect(words, T.tokens(text))

    def answer(self, text: Column, name: Column, prompt: Column) -> Column:
        shared = F.size(self._shared(text, name, prompt))
        return F.when(shared >= 3, "A").when(shared == 2, "B").when(shared == 1, "C").otherwise("E")

    def grade(self, points: DataFrame, concepts: DataFrame) -> DataFrame:
        """Every pair has an answer; those that share no word have no rationale and no quote."""
        grid = points.crossJoin(F.broadcast(concepts)).withColumn("shared", self._shared(F.col("text"), F.col("name"), F.col("prompt")))
        some = F.size("shared") > 0
        return grid.select(
            "bullet_id", "concept_id", self.answer(F.col("text"), F.col("name"), F.col("prompt")).alias("answer"),
            F.when(some, F.concat(F.lit("shares "), F.array_join("shared", ", "))).otherwise("").alias("rationale"), F.when(some, F.col("bullet")).otherwise("").alias("quote"),
        )

    def summaries(self, matches: DataFrame, length: str) -> DataFrame:
        return matches.withColumn("summary", F.regexp_extract("matches", r"^- ([^\n]*)", 1))

    def theme(self, cluster_id: int, bullets: list[str], seed: str, k: int, doc_ids: list[str] | None = None) -> list[dict]:
        import collections
        import re

        counts = collections.Counter(w for b in bullets for w in set(re.findall(r"\w+", b.lower())) if len(w) >= 3 and w not in T.STOP_WORDS)
        words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        named = [words[i : i + 3] for i in range(0, 3 * k, 3)]
        return [{"name": " ".join(w), "prompt": f"Does it speak of {', '.join(w)}?"} for w in named if w] or [{"name": f"Cluster {cluster_id}", "prompt": ""}]

    def review(self, themes: list[dict], most: int) -> tuple[list[int], list[int]]:
        return [], []


class Prefixed:
    """An embedder whose model expects ``passage: `` before texts and ``query: `` before queries."""

    def __init__(self, embedder: Embedder):
        self.embedder = embedder

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.embedder.encode([f"query: {t}" if t else t for t in texts])

    def column(self, text: Column) -> Column:
        return self.embedder.column(T.prefixed(text, False, True))


def asked(ask: Callable[[str], str], prompts: list[str | None], timeout_s: float, concurrency: int, retries: int = 0) -> list[str | None]:
    """A model's replies to prompts, some at a time. A call that fails or takes too long is made again ``retries``
    times, and then has no reply."""
    out = _asked_once(ask, prompts, timeout_s, concurrency)
    for _ in range(retries):
        failed = [k for k, p in enumerate(prompts) if p is not None and out[k] is None]
        for k, reply in zip(failed, _asked_once(ask, [prompts[k] for k in failed], timeout_s, concurrency), strict=True):
            out[k] = reply
    return out


def _asked_once(ask: Callable[[str], str], prompts: list[str | None], timeout_s: float, concurrency: int) -> list[str | None]:
    from concurrent.futures import ThreadPoolExecutor

    out: list[str | None] = []
    pool = ThreadPoolExecutor(concurrency)
    try:
        for at in range(0, len(prompts), concurrency):  # so that the time limit starts when a call does
            calls = [None if p is None else pool.submit(ask, p) for p in prompts[at : at + concurrency]]
            for call in calls:
                try:
                    out.append(None if call is None else call.result(timeout_s))
                except Exception:  # noqa: BLE001  remote code: any failure means no answer
                    out.append(None)
            if any(call is not None and not call.done() for call in calls):
                pool.shutdown(wait=False, cancel_futures=True)
                pool = ThreadPoolExecutor(concurrency)  # late calls do not take the places of others
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return out


class ModelAnnotator:
    """A language model behind ``ask``, a function from a prompt to a reply that can be sent to workers. Calls run
    in tasks, one at a time in each, with a time limit and ``retries``; the rows are dealt to ``concurrency`` tasks,
    so no more calls run at once in the cluster. A reply that fails, or is no JSON object of the form asked for,
    counts as none: no quotes, an excerpt as bullet, no answer, no summary, a theme named by number."""

    def __init__(self, ask: Callable[[str], str], timeout_s: float = 45.0, concurrency: int = 6, batch: int = 6, retries: int = 0):
        self.ask, self.timeout_s, self.tasks, self.batch, self.retries = ask, timeout_s, concurrency, batch, retries

    def _replies(self, prompts: list[str | None]) -> list[str | None]:
        return asked(self.ask, prompts, self.timeout_s, 1, self.retries)

    def _reply(self) -> grading.Reply:
        replies = self._replies
        return lambda prompt: replies([prompt])[0]

    def grade(self, points: DataFrame, concepts: DataFrame) -> DataFrame:
        return grading.graded_replies(points, concepts, self._reply(), self.batch, self.tasks)

    def summaries(self, matches: DataFrame, length: str) -> DataFrame:
        return grading.concept_summaries(matches, self._reply(), length, self.tasks)

    def _column(self, prompt: Callable[[str], str], text: Column) -> Column:
        replies = self._replies

        @F.pandas_udf("string")
        def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(replies([prompt(t) if t else None for t in s]), dtype=object)

        return reply(text)

    def quotes(self, text: Column, seed: str, n: int) -> Column:
        reply = self._column(lambda t: f"Copy up to {n} passages, word by word, from the answer below that bear on {json.dumps(seed)}. Reply with JSON: {{\"quotes\": [...]}}; an empty list if there are none.\n\nAnswer:\n{t}", text)
        return F.coalesce(json_object(reply, "quotes array<string>")["quotes"], F.array().cast("array<string>"))

    def bullet(self, text: Column, seed: str, words: str = "10-18") -> Column:
        reply = self._column(lambda t: f"Say in one short sentence of {words} words what this passage tells about {json.dumps(seed)}. Reply with JSON: {{\"bullet\": \"...\"}}.\n\nPassage:\n{t}", text)
        found = json_object(reply, "bullet string")["bullet"]
        return F.when(F.length(T.strip(found)) > 0, found).otherwise(excerpt(text))

    def answer(self, text: Column, name: Column, prompt: Column) -> Column:
        """A letter from A to E for each passage and theme; ``batch`` passages of a theme are asked for at once."""
        replies, size = self._replies, self.batch

        def ask_for(theme: tuple, passages: list[str]) -> str:
            listed = "\n".join(f"{k}. {p}" for k, p in enumerate(passages, 1))
            return f"How well does each passage fit the theme {json.dumps(theme[0])} ({theme[1]})? A: fully, B: mostly, C: partly, D: hardly, E: not at all. Reply with JSON: {{\"answers\": [a letter for each passage, in order]}}.\n\nPassages:\n{listed}"

        @F.pandas_udf("string")
        def answers(texts: pd.Series, names: pd.Series, prompts: pd.Series) -> pd.Series:
            groups: dict[tuple, list[int]] = {}
            for i, (n, p) in enumerate(zip(names, prompts, strict=True)):
                groups.setdefault((n, p), []).append(i)
            parts = [(theme, rows[at : at + size]) for theme, rows in groups.items() for at in range(0, len(rows), size)]
            out: list[str | None] = [None] * len(texts)
            for (_, rows), reply in zip(parts, replies([ask_for(theme, [texts.iloc[i] or "" for i in rows]) for theme, rows in parts]), strict=True):
                for i, letter in zip(rows, json_reply(reply).get("answers") or [], strict=False):
                    out[i] = str(letter)
            return pd.Series(out, dtype=object)

        return answers(text, name, prompt)

    def theme(self, cluster_id: int, bullets: list[str], seed: str, k: int, doc_ids: list[str] | None = None) -> list[dict]:
        notes = json.dumps([{"example_id": d, "note": b} for d, b in zip(doc_ids or map(str, range(len(bullets))), bullets, strict=False)], ensure_ascii=False)
        reply = self._replies([f"Name {k} theme(s) that these notes on {json.dumps(seed)} share, a yes-or-no question that tells whether a text is about each, and 2 to 4 example_ids of notes that show it best. Reply with JSON: {{\"themes\": [{{\"name\": \"...\", \"prompt\": \"...\", \"example_ids\": [\"...\"]}}]}}.\n\nNotes: {notes}"])[0]
        found = []
        for t in json_reply(reply).get("themes") or []:
            if isinstance(t, dict) and str(t.get("name") or "").strip():
                ids = [str(x).strip() for x in t.get("example_ids") or []] if isinstance(t.get("example_ids"), list) else []
                found.append({"name": str(t["name"]).strip(), "prompt": str(t.get("prompt") or "")} | ({"example_ids": [x for x in ids if x in doc_ids]} if doc_ids else {}))
        return found[:k] or [{"name": f"Cluster {cluster_id}", "prompt": ""}]

    def review(self, themes: list[dict], most: int) -> tuple[list[int], list[int]]:
        reply = self._replies([f"These themes were found: {json.dumps(themes)}. Which are vague or repeat another, and which {most} at most are the best? Reply with JSON: {{\"remove\": [cluster ids], \"select\": [cluster ids]}}."])[0]
        known = {t["cluster_id"] for t in themes}
        pick = lambda key: [x for x in json_reply(reply).get(key) or [] if isinstance(x, int) and x in known]
        return pick("remove"), pick("select")


class Expander(Protocol):
    def phrases(self, query: str, n: int) -> list[str]: ...


class NoExpansion:
    """The query alone."""

    def phrases(self, query: str, n: int) -> list[str]:
        return [query]


class ModelExpander:
    """Phrases from a language model: what follows the reply's last colon, parted by commas, without the query
    and its single words."""

    def __init__(self, ask: Callable[[str], str], timeout_s: float = 10.0):
        self.ask, self.timeout_s = ask, timeout_s

    def phrases(self, query: str, n: int) -> list[str]:
        reply = asked(self.ask, [f"Give {n} other short ways to say {json.dumps(query)}, parted by commas."], self.timeout_s, 1)[0]
        if reply is None:
            raise RuntimeError("the model gave no phrases")
        own = {query.lower().strip(), *query.lower().split()}
        found = [p.strip().strip("\"'.") for p in reply.rsplit(":", 1)[-1].split(",")]
        return [query, *(p for p in found if p and p.lower() not in own)]


def expansion_phrases(query: str, expander: Expander, n: int = 3) -> tuple[list[str], str]:
    """The query and up to n - 1 other phrases that differ in more than case; and how it went: success, or
    fallback if the expander failed or had none."""
    try:
        found = expander.phrases(query, n)
    except Exception:  # noqa: BLE001  an expander is remote code: its failure is not the search's
        return [query], "fallback"
    out = {query.lower().strip(): query}
    for p in found:
        if p.strip():
            out.setdefault(p.lower().strip(), p.strip())
    phrases = list(out.values())[:n]
    return phrases, "success" if len(phrases) > 1 else "fallback"


def expanded_query(query: str, expander: Expander, n: int = 10) -> str:
    return " ".join(expansion_phrases(query, expander, n)[0])
