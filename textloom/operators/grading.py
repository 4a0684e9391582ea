"""Graded scores from a model's replies: points in batches, a call for each batch and concept, replies matched by
example id; and one summary for each concept.

The batches of all concepts are dealt to a fixed number of tasks, and a task makes one call at a time, so the calls
that run at once are bounded for the whole cluster, not for each task.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.shared import written

Reply = Callable[[str], "str | None"]
ANSWERS = "bullet_id {0}, concept_id {1}, answer string, rationale string, quote string"


def json_reply(reply: str | None) -> dict:
    """A JSON object in a reply, or an empty one."""
    text = reply or ""
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return {}


def grade_prompt(name: str, prompt: str, examples: list[dict]) -> str:
    return (
        f"How well does each example fit the concept {json.dumps(name)} ({prompt})? A: fully, B: mostly, C: partly, D: hardly, E: not at all. "
        'Reply with JSON: {"results": [{"example_id": "...", "answer": "A to E", "rationale": "why, in one sentence", "quote": "the words of the example that show it"}]}, a result for each example.\n\n'
        f"Examples: {json.dumps(examples, ensure_ascii=False)}"
    )


def _text(value) -> str:
    return value.strip() if isinstance(value, str) else ""


def graded_replies(points: DataFrame, concepts: DataFrame, reply: Reply, batch: int = 6, tasks: int = 6) -> DataFrame:
    """bullet_id, concept_id, answer, rationale and quote of every point (bullet_id, text) that a reply names, for each
    concept (concept_id, name, prompt; those of a run, so they are broadcast). ``reply``: what the model says to a
    prompt, or None; it is sent to workers. What a reply says of an id that it was not asked for is left out, and
    of an id named twice the last counts. Ids and answers may come in any order."""
    numbered = written(points.select("bullet_id", "text", F.floor(F.monotonically_increasing_id() / batch).cast("long").alias("batch")), "batches")
    kinds = dict(points.dtypes)["bullet_id"], dict(concepts.dtypes)["concept_id"]
    rows = numbered.crossJoin(F.broadcast(concepts.select("concept_id", "name", "prompt")))

    def grade(asked: pd.DataFrame) -> pd.DataFrame:
        first, ids = asked.iloc[0], {str(b).strip(): b for b in asked["bullet_id"]}
        examples = [{"example_id": str(b), "example": (t or "").strip()} for b, t in zip(asked["bullet_id"], asked["text"], strict=True)]
        results = json_reply(reply(grade_prompt(first["name"] or f"Theme {first['concept_id']}", first["prompt"] or "", examples))).get("results")
        found = {}
        for r in results if isinstance(results, list) else []:
            if isinstance(r, dict) and (key := str(r.get("example_id") or "").strip()) in ids:
                found[ids[key]] = (ids[key], first["concept_id"], None if r.get("answer") is None else str(r["answer"]), _text(r.get("rationale")), _text(r.get("quote")))
        return pd.DataFrame(list(found.values()), columns=["bullet_id", "concept_id", "answer", "rationale", "quote"])

    return rows.repartition(tasks, "concept_id", "batch").groupBy("concept_id", "batch").applyInPandas(grade, ANSWERS.format(*kinds))


def summary_prompt(name: str, matches: str, length: str) -> str:
    return f"Sum up in {length}s what these examples say of the concept {json.dumps(name)}. Reply with JSON: {{\"summary\": \"...\"}}.\n\nExamples:\n{matches}"


def concept_summaries(matches: DataFrame, reply: Reply, length: str = "15-20 word", tasks: int = 6) -> DataFrame:
    """``matches`` (concept_id, name, matches: its best examples as lines) with ``summary``; null where the reply has none."""

    @F.pandas_udf("string")
    def summed_up(ids: pd.Series, names: pd.Series, lines: pd.Series) -> pd.Series:
        replies = [json_reply(reply(summary_prompt(n or f"Theme {i}", m, length))).get("summary") if m else None for i, n, m in zip(ids, names, lines, strict=True)]
        return pd.Series([_text(s) or None for s in replies], dtype=object)

    return matches.repartition(tasks, "concept_id").withColumn("summary", summed_up("concept_id", "name", "matches"))
