"""Models as plug-ins: text models behind a function, run once a task; a generic HTTP client; a probe of a service."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarry.operators.retrieval import knn


class TextModel(Protocol):
    def generate(self, prompt: str) -> str: ...


class HttpModel:
    """A model behind HTTP: ``body`` makes the request's JSON from a prompt, ``reply`` finds the text in the response's JSON.
    Errors come back as text."""

    def __init__(self, url: str, body: Callable[[str], dict], reply: Callable[[dict], str], headers: dict[str, str] | None = None, timeout: float = 60):
        self.url, self.body, self.reply, self.headers, self.timeout = url, body, reply, headers or {}, timeout

    def generate(self, prompt: str) -> str:
        try:
            request = urllib.request.Request(self.url, json.dumps(self.body(prompt)).encode(), {"Content-Type": "application/json", **self.headers})
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return str(self.reply(json.load(r)))
        except Exception as e:
            return f"Error: {e}"


def generate_api(model: str, url: str = "http://localhost:11434", **options) -> HttpModel:
    """A local model server that completes prompts."""
    return HttpModel(f"{url}/api/generate", lambda prompt: {"model": model, "prompt": prompt, "stream": False, **options}, lambda r: r["response"])


def chat_api(model: str, key: str, url: str = "https://api.openai.com/v1", **options) -> HttpModel:
    """A service of chat completions."""
    body = lambda prompt: {"model": model, "messages": [{"role": "user", "content": prompt}], **options}
    return HttpModel(f"{url}/chat/completions", body, lambda r: r["choices"][0]["message"]["content"], {"Authorization": f"Bearer {key}"})


def messages_api(model: str, key: str, url: str = "https://api.anthropic.com/v1", max_tokens: int = 500, **options) -> HttpModel:
    """A service of messages, whose replies are lists of parts."""
    body = lambda prompt: {"model": model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}], **options}
    return HttpModel(f"{url}/messages", body, lambda r: "".join(p.get("text", "") for p in r["content"]), {"x-api-key": key, "anthropic-version": "2023-06-01"})


class LocalModel:
    """A text-generation pipeline on the worker, loaded when it is first asked. Needs the transformers package. A reply is what follows the
    prompt; errors come back as text."""

    def __init__(self, name: str, **options):
        self.name, self.options, self.pipeline = name, {"max_new_tokens": 150, "do_sample": False} | options, None

    def load(self) -> Callable:
        from transformers import pipeline

        return pipeline("text-generation", model=self.name)

    def generate(self, prompt: str) -> str:
        try:
            self.pipeline = self.pipeline or self.load()
            return self.pipeline(prompt, **self.options)[0]["generated_text"].removeprefix(prompt).strip()
        except Exception as e:
            return f"Error: {e}"


def reachable(url: str, timeout: float = 2) -> bool:
    """Whether a service answers; callers choose the deterministic answers of ``answers`` otherwise."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status < 500
    except Exception:
        return False


def generate(prompts: DataFrame, make: Callable[[], TextModel]) -> DataFrame:
    """Adds ``reply`` to rows with a prompt. The model is made once for each task, from a function that travels there."""
    names = [c for c in prompts.columns if c != "reply"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            yield f.assign(reply=[model.generate(p or "") for p in f["prompt"]])[[*names, "reply"]]

    fields = [x for x in prompts.schema.fields if x.name != "reply"]
    return prompts.mapInPandas(run, StructType([*fields, StructField("reply", StringType())]))


def timed_knn(texts: DataFrame, vectors: DataFrame, embed: Callable, k: int = 5, where=None) -> tuple[DataFrame, dict[str, float]]:
    """Nearest neighbours of (query_id, text) rows with the milliseconds of each stage. Stages are made to run one by one, the query
    vectors and the k results of each query being all that is kept."""
    start = time.perf_counter()
    queries = texts.select("query_id", embed(F.col("text")).alias("embedding")).persist()
    queries.count()
    embedded = time.perf_counter()
    found = knn(vectors, queries, k, where=where).persist()
    found.count()
    end = time.perf_counter()
    queries.unpersist()
    ms = lambda a, b: round((b - a) * 1000, 3)
    return found, {"embedding_ms": ms(start, embedded), "retrieval_ms": ms(embedded, end), "reranking_ms": 0.0, "llm_ms": 0.0, "total_ms": ms(start, end)}
