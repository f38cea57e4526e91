"""Model calls as table functions. A call is a row (task, prompt); its answer is a row with the task's schema.

Models are plug-ins: ``handlers`` maps a task to a function of the prompt. The default is deterministic, so that retried tasks give
equal rows. Answers are kept by request hash; only requests without a stored answer are called.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Handler = Callable[[str], str]
TRIES = 3


def fake_summary(prompt: str) -> str:
    """The first sentence, as a summary with one claim."""
    first = re.split(r"(?<=[.!?])\s+", prompt.strip())[0][:200]
    return json.dumps({"summary": first, "claims": [{"claim": first, "difficulty": 1 + int(hashlib.sha256(prompt.encode()).hexdigest(), 16) % 5}]}, ensure_ascii=False)


def fake_lint(prompt: str) -> str:
    """Marks prompts with more than three numbers."""
    return json.dumps({"hits": ["number_overload"] if len(re.findall(r"\d+", prompt)) > 3 else []})


FAKES: dict[str, Handler] = {"summary": fake_summary, "lint": fake_lint}
SCHEMAS = {"summary": "summary string, claims array<struct<claim: string, difficulty: int>>", "lint": "hits array<string>"}


def cleaned_answer(answer: str) -> str:
    """The outermost JSON object of an answer, without fences around it."""
    m = re.search(r"\{.*\}", answer, re.DOTALL)
    return m.group() if m else ""


def with_hash(requests: DataFrame) -> DataFrame:
    return requests.withColumn("request_hash", F.sha2(F.concat_ws("\x1f", "task", "prompt"), 256))


def called(requests: DataFrame, handlers: dict[str, Handler] | None = None) -> DataFrame:
    """requests(task, prompt) -> (request_hash, task, answer, tries, error), one row per distinct request."""
    known = handlers or FAKES

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, task, prompt in zip(part["request_hash"], part["task"], part["prompt"]):
                answer, error, tries = None, None, 0
                while tries < TRIES and answer is None:
                    tries += 1
                    try:
                        answer = cleaned_answer(known[task](prompt)) or None
                        error = None if answer else "no JSON object"
                    except Exception as e:  # a failed call is a row, not a failed job
                        error = f"{type(e).__name__}: {e}"[:200]
                rows.append((key, task, answer, tries, error))
            yield pd.DataFrame(rows, columns=["request_hash", "task", "answer", "tries", "error"])

    once = with_hash(requests.where("prompt is not null")).dropDuplicates(["request_hash"]).select("request_hash", "task", "prompt")
    return once.mapInPandas(call, "request_hash string, task string, answer string, tries int, error string")


def answered(requests: DataFrame, stored: DataFrame, handlers: dict[str, Handler] | None = None) -> DataFrame:
    """Stored answers, and calls for the requests that have none."""
    asked = with_hash(requests)
    new = asked.join(stored.where("answer is not null").select("request_hash"), "request_hash", "left_anti").select("task", "prompt")
    return stored.join(asked.select("request_hash").distinct(), "request_hash", "left_semi").unionByName(called(new, handlers))


def parsed(answers: DataFrame, task: str) -> DataFrame:
    """Answers of one task by its schema; malformed ones have a null value."""
    return answers.where(F.col("task") == task).withColumn("value", F.from_json("answer", SCHEMAS[task]))
