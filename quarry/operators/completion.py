"""Stages that ask a language model: prompts go out by partition through a function that is passed
in, so that any service, or the deterministic stub here, can answer.

A model is ``Callable[[list[str]], list[str | None]]``. A call that a service refuses for now (``Refused``
with a status of 429 or 5xx) or that doesn't get through (OSError) is tried again, ``RETRIES`` times, after the
seconds that the service names or a doubling pause with some jitter; other errors aren't, as the same call would fail
again. An answer that is None or no JSON marks its session as failed, so that the next run asks again.
Failures are rows, never exceptions of the job.

``ask_resumable`` keeps answers by the hash of their prompt in a table that grows wave by wave: what was answered
is never asked again, whatever broke the run.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.scratch import materialize

Model = Callable[[list[str]], list]
RETRIES, PAUSE = 3, 1.0
#: Sessions asked about at once, and the length from which the long-context model answers.
BATCH, LONG_CHARS = 30, 250_000
#: Up to so many records a project, or in all, are kept as they are.
KEEP_DECISIONS, KEEP_PAINS, KEEP_PAINS_IN_ALL, KEEP_PREFERENCES, CHUNK = 3, 3, 5, 10, 150
QUESTIONS = ("decisions", "pain_points", "preferences")
ANSWER = "session long, question string, model string, items string, n int, error string"


def stub(prompts: list[str]) -> list[str]:
    """Answers by rule: each question gets one record from the first line of the text."""
    out = []
    for prompt in prompts:
        question, _, text = prompt.partition("\n")
        head = text.strip().split("\n")[0][:80]
        record = {"decisions": {"what": head, "why": f"{len(text)} characters say so"}, "pain_points": {"problem": head, "solution": "none"}, "preferences": {"category": "", "observation": head}}[question]
        out.append("```json\n" + json.dumps({question: [record] if head else []}, ensure_ascii=False) + "\n```")
    return out


class Refused(Exception):
    """A service's answer that is none: its status, and after how many seconds it may be asked again, if it says so."""

    def __init__(self, status: int, retry_after: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def _wait(error: Exception, attempt: int, pause: float) -> float | None:
    """Seconds to wait before the next attempt; None if there should be none."""
    status = getattr(error, "status", None)
    if attempt >= RETRIES or not (status == 429 or 500 <= (status or 0) < 600 or (status is None and isinstance(error, OSError))):
        return None
    said = getattr(error, "retry_after", None)
    return float(said) if said else pause * (2**attempt + random.random() / 2)


def _ask(model: Model, prompts: list[str], pause: float) -> tuple[list, str | None]:
    for attempt in range(RETRIES + 1):
        try:
            answers = model(prompts)
            if len(answers) != len(prompts):
                return [None] * len(prompts), f"{len(answers)} answers to {len(prompts)} prompts"
            return answers, None
        except Exception as error:
            failed, wait = f"{type(error).__name__}: {error}", _wait(error, attempt, pause)
            if wait is None:
                break
            time.sleep(wait)
    return [None] * len(prompts), failed


def ask_resumable(prompts: DataFrame, model: Model, path: str, waves: int = 8, batch: int = BATCH, pause: float = PAUSE) -> DataFrame:
    """``prompts`` (id, prompt) with ``answer`` and ``error``. Equal prompts are asked once. Answers stand by the hash of their
    prompt in a table at ``path``, to which each of the ``waves``, a part of the prompts by hash, is
    appended as a whole; a run that is begun again asks only what has no answer there, so at most one wave twice.
    A batch that fails leaves its prompts without an answer and the others as they are."""
    from quarry.operators.store import read

    spark, schema = prompts.sparkSession, "key string, answer string"
    keyed = prompts.withColumn("key", F.sha2("prompt", 256))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame[at : at + batch]
                answers, failed = _ask(model, part["prompt"].tolist(), pause)
                yield pd.DataFrame({"key": part["key"], "answer": answers, "error": [None if a is not None else failed or "no answer" for a in answers]}).astype({"error": object})

    failures = []
    for wave in range(waves):
        known = read(spark, f"{path}/answers", schema)
        open_ = keyed.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).select("key", "prompt").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
        got = materialize(open_.mapInPandas(run, schema + ", error string"))
        got.where("answer is not null").select("key", "answer", F.lit(wave).alias("bucket")).write.mode("append").partitionBy("bucket").parquet(f"{path}/answers")
        failures.append(got.where("answer is null").select("key", "error"))
    failed = reduce(DataFrame.unionByName, failures)
    return keyed.join(read(spark, f"{path}/answers", schema).dropDuplicates(["key"]), "key", "left").join(failed, "key", "left").select("id", "prompt", "answer", "error")


def parse_json(answer: str | None):
    """The JSON of a fenced block, of all, or from the first brace to the last; None without one."""
    if not answer:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    first, last = answer.find("{"), answer.rfind("}")
    for text in (fenced[1] if fenced else None, answer, answer[first : last + 1] if 0 <= first < last else None):
        try:
            if text:
                return json.loads(text)
        except ValueError:
            pass
    return None


def snake(value):
    """The same JSON with keys in lower case and underscores."""
    if isinstance(value, dict):
        return {re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", k).replace("-", "_").lower(): snake(v) for k, v in value.items()}
    return [snake(v) for v in value] if isinstance(value, list) else value


def route(content: Column) -> Column:
    """Which model answers: by the length of what it has to read."""
    return F.when(F.char_length(content) > LONG_CHARS, "long").otherwise("short")


def ask_sessions(sessions: DataFrame, models: dict[str, Model], pause: float = PAUSE) -> DataFrame:
    """Three questions about each of (session, content): ANSWER, ``items`` being the JSON list of records."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                rows = []
                for name, part in frame[at : at + BATCH].groupby("model"):
                    asked = [(s, question, f"{question}\n{content}") for s, content in zip(part["session"], part["content"], strict=True) for question in QUESTIONS]
                    answers, failed = _ask(models[name], [a[2] for a in asked], pause)
                    for (s, question, _), answer in zip(asked, answers, strict=True):
                        found = snake(parse_json(answer))
                        items = found.get(question) if isinstance(found, dict) else None
                        ok = isinstance(items, list)
                        rows.append((s, question, name, json.dumps(items, ensure_ascii=False) if ok else None, len(items) if ok else 0, None if ok else failed or "no answer"))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return sessions.select("session", "content", route(F.col("content")).alias("model")).mapInPandas(run, ANSWER)


def processed(answers: DataFrame) -> DataFrame:
    """Sessions all of whose questions were answered."""
    return answers.groupBy("session").agg(F.max(F.col("error").isNotNull().cast("int")).alias("failed")).where("failed = 0").select("session")


def chunked(rows: DataFrame, group: str, order: list[Column], size: int = CHUNK) -> DataFrame:
    """``rows`` numbered in chunks of ``size`` within their group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("chunk", F.floor((n - 1) / size))


def consolidate(rows: DataFrame, group: str, record: str, model: Model, keep: int, pause: float = PAUSE, keep_all: int = 0) -> DataFrame:
    """(group, chunk, items, n): the JSON records of each group in chunks of CHUNK, rewritten by the
    model. A chunk of at most ``keep``, or whose answer is no list, stays as it is; so do all if there
    are at most ``keep_all`` records."""
    if keep_all and rows.limit(keep_all + 1).count() <= keep_all:
        keep = keep_all
    per = chunked(rows, group, [F.asc(record)]).groupBy(group, "chunk").agg(F.array_sort(F.collect_list(record)).alias("records"), F.count("*").alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, chunk, records, n in zip(frame[group], frame["chunk"], frame["records"], frame["n"], strict=True):
                raw = [json.loads(r) for r in records]
                answer = None if n <= keep else parse_json(_ask(model, [json.dumps(raw, ensure_ascii=False)], pause)[0][0])
                items = answer if isinstance(answer, list) else raw
                out.append((name, chunk, json.dumps(items, ensure_ascii=False), len(items)))
            yield pd.DataFrame(out, columns=[group, "chunk", "items", "n"])

    return per.mapInPandas(run, f"{group} string, chunk long, items string, n int")


def finish(chunks: DataFrame, group: str, model: Model, above: int = 80, pause: float = PAUSE) -> DataFrame:
    """(group, items, n): a group's chunks as one list, which the model goes over once more if it has
    more than ``above`` records; a model's chunks are short, so that one call holds them."""
    lists = chunks.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "items"))), lambda x: x["items"]).alias("lists"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, lists in zip(frame[group], frame["lists"], strict=True):
                items = [x for part in lists for x in json.loads(part)]
                answer = parse_json(_ask(model, [json.dumps(items, ensure_ascii=False)], pause)[0][0]) if len(items) > above else None
                items = answer if isinstance(answer, list) else items
                out.append((name, json.dumps(items, ensure_ascii=False), len(items)))
            yield pd.DataFrame(out, columns=[group, "items", "n"])

    return lists.mapInPandas(run, f"{group} string, items string, n int")


def polish(sections: DataFrame, cache: DataFrame, model: Model, pause: float = PAUSE) -> tuple[DataFrame, DataFrame]:
    """(section, draft) with ``polished``: from the cache (key, polished) by the hash of the draft, else
    from the model, else the draft; and what the cache gains. Only misses are asked about."""
    keyed = sections.withColumn("key", F.sha2("draft", 256))
    met = keyed.join(cache, "key", "left")
    asked = met.where("polished is null").select("key", "draft").dropDuplicates(["key"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = _ask(model, frame["draft"].tolist(), pause)[0]
            yield pd.DataFrame({"key": frame["key"], "polished": [a or None for a in answers]})

    gained = asked.mapInPandas(run, "key string, polished string").where("polished is not null")
    rows = met.withColumnRenamed("polished", "hit").join(gained, "key", "left")
    return rows.select("section", F.coalesce("hit", "polished", "draft").alias("polished"), F.col("hit").isNotNull().cast("int").alias("hit")), gained


#: Characters of a call that polishes sections, by default.
CALL_CHARS = 24_000


def polish_packed(sections: DataFrame, cache: DataFrame | None, model: Model, view: str, title: str, pause: float = PAUSE, most_chars: int = CALL_CHARS, version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """``sections`` (n, title, draft, ids) of a view with ``text``: polished by the cache (key, polished), else by the
    model, else the draft; and what the cache gains. A call holds as many sections that the cache has not, in
    order, as its characters allow; its answer is JSON of sections by id. A bounded view's sections are few."""
    from quarry.operators.views import chunk_by_chars

    spark = sections.sparkSession
    cache = cache if cache is not None else spark.createDataFrame([], "key string, polished string")
    key = F.sha2(F.concat_ws("\x1f", F.lit(version), F.lit(view), "title", "draft"), 256)
    met = sections.withColumn("key", key).join(cache, "key", "left")
    asked = met.where("polished is null").select("n", "key", "title", "draft", F.concat("title", "draft").alias("line"), F.col("n").alias("place"))
    calls = chunk_by_chars(asked, "line", most_chars).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("n", "key", "title", "draft"))).alias("all"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rows in frame["all"]:
                given = [{"sectionId": r["title"], "title": r["title"], "draftMarkdown": r["draft"]} for r in rows]
                answer = parse_json(_ask(model, [json.dumps({"viewTitle": title, "sections": given}, ensure_ascii=False)], pause)[0][0])
                parts = answer.get("sections") if isinstance(answer, dict) else None
                said = {p.get("sectionId"): p.get("markdown") for p in parts or [] if isinstance(p, dict)}
                out += [(r["key"], said[r["title"]]) for r in rows if isinstance(said.get(r["title"]), str) and said[r["title"]].strip()]
            yield pd.DataFrame(out, columns=["key", "polished"])

    gained = calls.mapInPandas(run, "key string, polished string").dropDuplicates(["key"])
    rows = met.withColumnRenamed("polished", "hit").join(gained, "key", "left")
    return rows.select("n", "title", F.rtrim(F.coalesce("hit", "polished", "draft")).alias("text"), "ids"), gained
