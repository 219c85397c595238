"""What lies outside the engine: language models, web search, fetching and rendering pages.

Each provider is a plain callable, sent to tasks as it is. The defaults work offline and are deterministic. Calls happen
inside mapInPandas over as many partitions as there may be calls at a time; their errors are columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow.functions.modeljson import parse
from clauseflow.session import share_package

Model = Callable[[str], str]
Fetch = Callable[[str], tuple[int, str, bytes]]
Search = Callable[[str], list[dict]]

# What to tell people about HTTP states.
STATUS_HINTS = {401: "需要登录后才能访问", 403: "网站拒绝了访问", 404: "页面不存在", 429: "访问过于频繁，请稍后再试", 500: "网站内部出错", 502: "网站暂时不可用", 503: "网站暂时不可用"}


def no_fetch(url: str) -> tuple[int, str, bytes]:
    raise ConnectionError("no network")


def backoff_ms(attempt: int, jitter: float = 0.0) -> float:
    """Milliseconds before an attempt is made again."""
    return min(700 * 2 ** (attempt - 1) + 400 * jitter, 15_000)


# HTTP states after which a call is made again; and what a model is told whose answer isn't JSON.
RETRY_STATUSES = (408, 409, 425, 429, 500, 502, 503, 504)
REPAIR_TURN = "\n\n你上一次的输出不是合法的 JSON。请只输出 JSON，不要有任何其他文字。"


class CallError(Exception):
    """A call that ended with an HTTP state."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or STATUS_HINTS.get(status, f"HTTP {status}"))
        self.status = status


def ask(model: Model, prompt: str, attempts: int = 4, as_json: bool = False, wait: Callable[[float], None] = lambda ms: time.sleep(ms / 1000)) -> tuple[str | None, str | None, int]:
    """(answer, error, tries). Failed calls are made again after a growing wait, unless their state says that this is no use;
    where JSON is wanted, an answer without any is asked for once more, with a note."""
    error, told = None, prompt
    for n in range(1, attempts + 1):
        try:
            answer = model(told)
            if not as_json or parse(answer)[1] != "failed" or told is not prompt:
                return answer, None, n
            told, error = prompt + REPAIR_TURN, "no JSON"
            continue
        except CallError as e:
            error = f"HTTP {e.status}: {e}"
            if e.status not in RETRY_STATUSES:
                return None, error, n
        except Exception as e:  # noqa: BLE001 - a failed call is a row with an error
            error = f"{type(e).__name__}: {e}"
        if n < attempts:
            wait(backoff_ms(n))
    return None, error, attempts


def call_model(prompts: DataFrame, model: Model, attempts: int = 4, parallel: int = 3, as_json: bool = False) -> DataFrame:
    """prompts (id, prompt) with answer, error and tries; at most `parallel` calls at a time."""
    share_package(prompts.sparkSession)
    columns = [*prompts.columns, "answer", "error", "tries"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [ask(model, p, attempts, as_json) for p in f["prompt"]]
            f[["answer", "error", "tries"]] = rows
            yield f[columns]

    schema = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", answer string, error string, tries int"
    return prompts.repartition(parallel).mapInPandas(run, schema)


def first_that_works(*searches: Search) -> Search:
    """Search engines in order; the first with results answers."""

    def run(query: str) -> list[dict]:
        for s in searches:
            try:
                if found := s(query):
                    return found
            except Exception:  # noqa: BLE001 - the next one is asked
                continue
        return []

    return run


def fetch_urls(urls: DataFrame, fetch: Fetch = no_fetch, most_bytes: int = 8 << 20, parallel: int = 3) -> DataFrame:
    """urls (url) with status, mime, content and error, content cut at most_bytes."""
    share_package(urls.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for u in f["url"]:
                try:
                    status, mime, body = fetch(u)
                    rows.append((status, mime, body[:most_bytes], None if status < 400 else STATUS_HINTS.get(status, f"HTTP {status}")))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame([(u, *r) for u, r in zip(f["url"], rows, strict=True)], columns=["url", "status", "mime", "content", "error"])

    return urls.select("url").repartition(parallel).mapInPandas(run, "url string, status int, mime string, content binary, error string")


def extract_urls(urls: DataFrame, fetch: Fetch = no_fetch, render: Fetch | None = None, least: int = 300, parallel: int = 3) -> DataFrame:
    """urls (url) with extracted text and where it came from; pages with fewer than `least` characters are rendered, if there is
    a renderer, and the longer text stays. enough says whether that many were found."""
    from clauseflow.sources.documents import extract_files

    def texts(fetched: DataFrame, name: str) -> DataFrame:
        files = fetched.withColumn("filename", F.lit(""))
        return extract_files(files).select("url", F.coalesce("extracted.text", F.lit("")).alias(name), F.col("error").alias(f"{name}_error"))

    static = texts(fetch_urls(urls, fetch, parallel=parallel), "fetched")
    if render is None:
        both = static.withColumn("rendered", F.lit("")).withColumn("rendered_error", F.lit(None).cast("string"))
    else:
        again = texts(fetch_urls(static.where(F.length("fetched") < least), render, parallel=parallel), "rendered")
        both = static.join(again, "url", "left").withColumn("rendered", F.coalesce("rendered", F.lit("")))
    longer = F.length("rendered") > F.length("fetched")
    text = F.when(longer, F.col("rendered")).otherwise(F.col("fetched"))
    return both.select("url", text.alias("text"), F.when(longer, F.lit("rendered")).otherwise(F.lit("fetched")).alias("source"), (F.length(text) >= least).alias("enough"), F.coalesce("fetched_error", "rendered_error").alias("error"))
