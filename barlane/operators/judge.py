"""The judge's side of the hybrid scorer: prompts, patience with a service, and what its answers come to."""
from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.reconcile import CLEAN

#: Tries of one call, seconds before the first retry without a hint, and seconds between two prompts.
ATTEMPTS, FIRST_WAIT, PACE = 5, 2.0, 1.5
# What a service says of a key that it doesn't take.
BAD_KEY = ("invalid_api_key", "incorrect api key", "error code: 401")


class JudgeError(Exception):
    """The judge can't be had."""


class Refused(JudgeError):
    """The service asks for fewer calls; the message may tell how long to wait."""


def bad_key(message: str) -> bool:
    """Whether an error says that the key isn't valid."""
    low = message.lower()
    return any(mark in low for mark in BAD_KEY)


def wait_for(message: str, k: int) -> float:
    """Seconds to wait after the k-th refusal (from 0): the service's own hint and half a second, else 2, 4, 8, ..."""
    hint = re.search(r"try again in (\d+)ms", message)
    return int(hint[1]) / 1000 + 0.5 if hint else FIRST_WAIT * 2**k


def refused(status: int, body: str) -> bool:
    return status == 429 or "rate_limit_exceeded" in body or "429" in body


def once(call: Callable[[str, str], tuple[int, str]], keys: Sequence[str]) -> Callable[[pd.Series], pd.Series]:
    """A function of prompts that tries each once, for `answers.fill`, which waits and tries again for the whole cluster."""
    left = list(keys)

    def one(prompt: str) -> str:
        for _ in range(2):
            status, body = call(prompt, left[0] if left else "")
            if status == 200:
                return body
            if not (bad_key(f"error code: {status} {body}") and len(left) > 1):
                break
            left.pop(0)
        raise (Refused if refused(status, body) else JudgeError)(f"status {status}: {body[:200]}")

    return lambda prompts: pd.Series([one(p) for p in prompts], dtype=str)


def patient(call: Callable[[str, str], tuple[int, str]], keys: Sequence[str], sleep: Callable[[float], None] = time.sleep) -> Callable[[pd.Series], pd.Series]:
    """A function of prompts for one worker from call(prompt, key), which gives a status like HTTP's and a text.

    What is refused is tried again, ATTEMPTS times in all; a key that isn't valid gives way to the next one, for good, which
    takes a try too; between prompts PACE seconds pass; all else raises JudgeError.
    """
    left = list(keys)

    def one(prompt: str) -> str:
        for k in range(ATTEMPTS):
            status, body = call(prompt, left[0] if left else "")
            if status == 200:
                return body
            if bad_key(f"error code: {status} {body}") and len(left) > 1:
                left.pop(0)
            elif refused(status, body):
                sleep(wait_for(body, k))
            else:
                raise JudgeError(f"status {status}: {body[:200]}")
        raise JudgeError("rate limit retries exhausted")

    def ask(prompts: pd.Series) -> pd.Series:
        out = []
        for i, p in enumerate(prompts):
            if i:
                sleep(PACE)
            out.append(one(p))
        return pd.Series(out, dtype=str)

    return ask


def repaired(s: str) -> str:
    """Plain quotes for curly ones, and a backslash before bare quotes inside string values."""
    s = s.translate({0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'"})
    return re.sub(r'":\s*"((?:[^"\\]|\\.)*)"', lambda m: '": "' + re.sub(r'(?<!\\)"', '\\"', m[1]) + '"', s)


def _readings(s: str) -> Iterator[str]:
    """The parts of an answer that may be its JSON, the likeliest first."""
    yield s
    yield from re.findall(r"```(?:json)?\s*([\s\S]+?)```", s)[:1]
    for outer in re.findall(r"\{[\s\S]+\}", s):
        yield outer
        yield repaired(outer)


def read(s: str) -> dict:
    """The JSON of an answer; one with `error` where there is none."""
    for part in _readings(s):
        try:
            got = json.loads(part)
        except json.JSONDecodeError:
            continue
        return got if isinstance(got, dict) else {"error": "no object", "raw": s[:500]}
    return {"error": "JSON parse failed", "raw": s[:500]}


def clean(s: str | None) -> str | None:
    """The JSON object in an answer, as plain JSON; None where none can be read."""
    got = {"error": ""} if s is None else read(s)
    return None if "error" in got else json.dumps(got)


@F.pandas_udf(T.StringType())
def clean_udf(s: pd.Series) -> pd.Series:
    return s.map(clean).astype(object)


def register(spark: SparkSession) -> None:
    """Makes the reader of answers known to a session's SQL."""
    spark.udf.register(CLEAN, clean_udf)
