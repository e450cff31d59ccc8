"""Batch enrichment by language models: what is cached and what is to be made, requests, the call, and reading answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from noteframe.functions import modeljson as J
from noteframe.functions import text as T

#: What a model is told, what it is asked, and how much of the note it sees.
ASSISTANT = "You are a helpful study assistant. "
SYSTEM = {
    "summary": ASSISTANT + "Summarize the student's notes clearly and concisely in plain English. Keep it under 200 words. Do not use markdown formatting.",
    "explain": ASSISTANT
    + "Explain the highlighted term or concept from the student's notes in simple, clear language. Use the surrounding context to make the explanation relevant. Keep it concise — 2 to 4 sentences.",
    "flashcards": ASSISTANT
    + 'Generate flashcards from the student\'s notes. Return ONLY a valid JSON array, no markdown, no explanation, no preamble. Format: [{"question": "...", "answer": "..."}]',
    "categories": ASSISTANT
    + 'Categorize the student\'s notes. Return ONLY a valid JSON object, no markdown, no explanation. Format: {"subject": "...", "topic": "...", "tags": ["...", "..."]}',
}
ASK = {
    "summary": "Summarize these notes:\n\n",
    "flashcards": "Generate 8 to 10 flashcards from these notes:\n\n",
    "categories": "Categorize these notes by subject, topic, and tags:\n\n",
}
NOTE_CHARS, CONTEXT_CHARS, HIGHLIGHT_CHARS = 4000, 2000, 500


def latest_flashcard_set(sets: DataFrame) -> DataFrame:
    """The newest set of each note and owner, one without a time before all others; of sets of one time the one with the larger id."""
    order = W.partitionBy("note_id", "owner_id").orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())
    return sets.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def first_match(df: DataFrame, *keys: str) -> DataFrame:
    """The row of the smallest id for each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where("_n = 1").drop("_n")


def plan_flashcards(requests: DataFrame, sets: DataFrame) -> DataFrame:
    """Requests (note_id, owner_id, regenerate) with set_id and action: cached or generate."""
    newest = latest_flashcard_set(sets).select("note_id", "owner_id", F.col("id").alias("set_id"))
    rows = requests.join(newest, ["note_id", "owner_id"], "left")
    cached = ~F.coalesce("regenerate", F.lit(False)) & F.col("set_id").isNotNull()
    return rows.withColumn("action", F.when(cached, "cached").otherwise("generate"))


def plan_summaries(requests: DataFrame, notes: DataFrame) -> DataFrame:
    rows = requests.join(notes.select(F.col("id").alias("note_id"), "owner_id", "ai_summary"), ["note_id", "owner_id"])
    cached = ~F.coalesce("regenerate", F.lit(False)) & (T.filled("ai_summary") != "")
    return rows.withColumn("action", F.when(cached, "cached").otherwise("generate"))


def plan_summaries_by_table(requests: DataFrame, summaries: DataFrame) -> DataFrame:
    """As plan_summaries, where summaries are a table of their own (note_id, owner_id, summary): what it holds is cached, empty or not."""
    have = summaries.select("note_id", "owner_id").distinct().withColumn("_have", F.lit(True))
    rows = requests.join(have, ["note_id", "owner_id"], "left")
    cached = ~F.coalesce("regenerate", F.lit(False)) & F.col("_have").isNotNull()
    return rows.withColumn("action", F.when(cached, "cached").otherwise("generate")).drop("_have")


def plan_explanations(requests: DataFrame, explanations: DataFrame) -> DataFrame:
    """Requests (owner_id, note_id, highlighted_text): cached if exactly that trimmed text of that note is explained. Without a note never."""
    keys = ["owner_id", "note_id", "highlighted_text"]
    have = first_match(explanations, *keys).select(*keys, F.col("id").alias("explanation_id"))
    rows = requests.withColumn("highlighted_text", T.trim_ws("highlighted_text")).join(have, keys, "left")
    return rows.withColumn("action", F.when(F.col("explanation_id").isNotNull(), "cached").otherwise("generate"))


def plan_explanations_anywhere(requests: DataFrame, explanations: DataFrame) -> DataFrame:
    """As plan_explanations, but a request without a note is answered by the explanation of that text in any of the owner's notes."""
    keys = ["owner_id", "highlighted_text"]
    anywhere = first_match(explanations, *keys).select(*keys, F.col("id").alias("_any"))
    rows = plan_explanations(requests, explanations).join(anywhere, keys, "left")
    found = F.coalesce("explanation_id", F.when(F.col("note_id").isNull(), F.col("_any")))
    return rows.withColumns({"explanation_id": found, "action": F.when(found.isNotNull(), "cached").otherwise("generate")}).drop("_any")


def plan_categories(requests: DataFrame, notes: DataFrame) -> DataFrame:
    full = (T.filled("subject") != "") & (T.filled("topic") != "") & (T.filled("tags") != "")
    rows = requests.join(notes.select(F.col("id").alias("note_id"), "owner_id", full.alias("_full")), ["note_id", "owner_id"])
    return rows.withColumn("action", F.when(F.col("_full"), "cached").otherwise("generate")).drop("_full")


def highlight_status(html: DataFrame, explanations: DataFrame) -> DataFrame:
    """Each current highlight of a note (note_id, html) as cached or new, by its exact text."""
    marks = html.select("note_id", F.posexplode(T.extract_highlights("html")).alias("place", "highlighted_text"))
    have = explanations.select("note_id", "highlighted_text").distinct().withColumn("_have", F.lit(True))
    rows = marks.join(have, ["note_id", "highlighted_text"], "left")
    return rows.withColumn("status", F.when(F.col("_have"), "cached").otherwise("new")).drop("_have")


def all_highlights(current: Column, cached: Column) -> Column:
    """Current ones, then cached ones that are no longer marked; each once."""
    return F.array_union(current, cached)


def build_requests(notes: DataFrame, kind: str) -> DataFrame:
    """One request a note with text: note_id, kind, system, user. For `explain` notes have highlighted_text and context."""
    if kind == "explain":
        user = F.concat(F.lit("Explain this: '"), T.truncate("highlighted_text", HIGHLIGHT_CHARS), F.lit("'\n\nContext from the note:\n"), T.truncate(T.filled("context"), CONTEXT_CHARS))
    else:
        user = F.concat(F.lit(ASK[kind]), T.truncate("raw_text", NOTE_CHARS))
    return notes.select(F.col("id").alias("note_id"), F.lit(kind).alias("kind"), F.lit(SYSTEM[kind]).alias("system"), user.alias("user"))


def enrich(requests: DataFrame, model: Callable[[str, str], str], tries: int = 3, wait: float = 1.0, accept: Callable[[str], bool] | None = None) -> DataFrame:
    """Call the model on every request: adds response, attempts and error; one row out for each row in, in Arrow batches.

    A call that raises, or whose answer `accept` refuses, is tried again after `wait` seconds, `tries` times in all. A
    request that never succeeds has a null response and the last error; it fails no other row. This is the only
    operator that runs Python on the executors.
    """

    def one(system: str, user: str) -> tuple[str | None, int, str | None]:
        error = None
        for attempt in range(1, tries + 1):
            try:
                answer = model(system, user)
                if accept is None or accept(answer):
                    return answer, attempt, None
                error = "answer not accepted"
            except Exception as e:  # noqa: BLE001  the caller's function may raise anything
                error = str(e)
            if attempt < tries:
                time.sleep(wait)
        return None, tries, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(s, u) for s, u in zip(batch["system"], batch["user"], strict=True)]
            yield batch.assign(response=[x[0] for x in found], attempts=[x[1] for x in found], error=[x[2] for x in found])

    added = Ty.StructType.fromDDL("response string, attempts int, error string")
    schema = Ty.StructType([*requests.schema.fields, *added.fields])
    return requests.mapInPandas(run, schema)


def read_flashcards(responses: DataFrame) -> DataFrame:
    """note_id, place, question, answer of every card in the responses; responses without cards give no rows."""
    cards = J.parse_flashcards(T.bound(J.join_response("response"), J.repair_json))
    return responses.select("note_id", F.posexplode(cards).alias("place", "card")).select("note_id", "place", "card.question", "card.answer")


def read_categories(responses: DataFrame) -> DataFrame:
    """note_id, subject, topic, tags; a response that is no object leaves the note out."""
    got = J.parse_categories(T.bound(J.join_response("response"), J.repair_json))
    return responses.select("note_id", got.alias("c")).where("c is not null").select("note_id", "c.subject", "c.topic", "c.tags")
