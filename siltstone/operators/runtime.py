"""Layered runs of nodes over shared state, and the seam to external models."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses worth another try (and all from 500 to 599), waits in seconds, tries after the first, texts of one embedding call, tool rounds.
RETRY_STATUS, SERVER_STATUS, RETRIES = [429], range(500, 600), 4
FIRST_WAIT, LONGEST_WAIT, JITTER = 1.0, 16.0, 0.3
EMBED_BATCH, TOOL_ROUNDS = 64, 8
#: Statuses and words by which an error says that a model takes no schema.
SCHEMA_STATUS, SCHEMA_WORDS = ["400", "404", "422", "501"], ["json_schema", "response_format", "schema", "not supported", "unsupported", "invalid type"]
#: The dimensions of a review; one is never left out.
DIMENSIONS = ["correctness", "concurrency", "memory", "security", "performance", "maintainability"]
ALWAYS = "correctness"


def bounded_map(items: Iterable[Any], limit: int, f: Callable[[Any], Any]) -> list[Any]:
    """f of each item in order, at most `limit` at a time; the first failure ends it."""
    work = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(limit, len(work)))) as pool:
        return list(pool.map(f, work))


@dataclass
class Node:
    """A step of a layer: what it returns is reduced into the state; one that fails returns nothing."""

    name: str
    layer: int
    run: Callable[[dict], dict]
    should_run: Callable[[dict], bool] = lambda state: True


def reduce_state(state: dict, update: dict) -> dict:
    """Dimension findings merge by category, usage adds up, the trace grows, all else is replaced."""
    out = dict(state)
    for key, value in update.items():
        if key == "dimension_findings":
            out[key] = {**state.get(key, {}), **value}
        elif key == "usage":
            before = state.get(key, {})
            out[key] = {k: before.get(k, 0) + value.get(k, 0) for k in [*before, *[k for k in value if k not in before]]}
        elif key == "trace":
            out[key] = [*state.get(key, []), *value]
        else:
            out[key] = value
    return out


def run_layers(nodes: list[Node], state: dict, limit: int = 3, after: Callable[[int, dict], None] | None = None) -> dict:
    """Layers in ascending order; nodes of one see the same state, and their results are reduced in the order of the nodes."""

    def attempt(node: Node, seen: dict) -> dict:
        try:
            return node.run(seen)
        except Exception:
            return {}

    for layer in sorted({n.layer for n in nodes}):
        active = [n for n in nodes if n.layer == layer and n.should_run(state)]
        if not active:
            continue
        seen = dict(state)
        for update in bounded_map(active, limit, lambda n, seen=seen: attempt(n, seen)):
            state = reduce_state(state, update)
        if after:
            after(layer, state)
    return state


class ChatModel(Protocol):
    def chat(self, request: dict) -> str: ...


class EmbedModel(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class StubModel:
    """A deterministic model without a network: canned answers by a word of the prompt, vectors from hashes of words."""

    answers: dict[str, str] = field(default_factory=dict)
    dim: int = 64

    def chat(self, request: dict) -> str:
        text = json.dumps(request, sort_keys=True)
        return next((a for word, a in self.answers.items() if word in text), '{"findings": []}')

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in text.lower().split():
                h = int.from_bytes(hashlib.sha1(word.encode()).digest()[:8], "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


class HttpStatus(Exception):
    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def wait_before(attempt: int) -> float:
    """Seconds before another try: doubling from FIRST_WAIT to LONGEST_WAIT, and up to JITTER of it more."""
    return min(FIRST_WAIT * 2**attempt, LONGEST_WAIT) * (1 + JITTER * random.random())


def with_retries(call: Callable[[], Any], retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> Any:
    """call(), again after failures that may pass."""
    for attempt in range(retries + 1):
        try:
            return call()
        except (ConnectionError, TimeoutError, HttpStatus) as e:
            if attempt == retries or (isinstance(e, HttpStatus) and e.status not in RETRY_STATUS and e.status not in SERVER_STATUS):
                raise
            sleep(wait_before(attempt))


@dataclass
class Fallback:
    """The first of several models that answers."""

    models: list[ChatModel]

    def chat(self, request: dict) -> str:
        last: Exception | None = None
        for model in self.models:
            try:
                return model.chat(request)
            except Exception as e:
                last = e
        raise last or ValueError("no model")


@dataclass
class Cached:
    """A model whose answers are kept by the whole request, its schema too: in memory and, if a folder is named, as a file each, which outlives the process.

    A file is written beside its place and moved there, so tasks that answer the same request at once leave one whole file.
    """

    model: ChatModel
    known: dict[str, str] = field(default_factory=dict)
    folder: str | None = None

    def chat(self, request: dict) -> str:
        key = hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()[:32]
        if key not in self.known:
            self.known[key] = self.kept(key, request)
        return self.known[key]

    def kept(self, key: str, request: dict) -> str:
        if self.folder is None:
            return self.model.chat(request)
        path = os.path.join(self.folder, f"{key}.json")
        try:
            with open(path, encoding="utf-8") as f:
                return json.load(f)["answer"]
        except (OSError, ValueError, KeyError, TypeError):
            pass
        answer = self.model.chat(request)
        os.makedirs(self.folder, exist_ok=True)
        fresh = f"{path}.{os.getpid()}.{threading.get_ident()}"
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump({"answer": answer}, f)
        os.replace(fresh, path)
        return answer


def rejects_schema(error: Exception) -> bool:
    said = str(error).lower()
    return bool(set(re.findall(r"\d+", said)) & set(SCHEMA_STATUS)) or any(w in said for w in SCHEMA_WORDS)


@dataclass
class Structured:
    """A model asked for JSON by a schema; once it has refused one, it is asked for any JSON object instead."""

    model: ChatModel
    by_schema: bool = True

    def chat(self, request: dict, schema: dict | None = None) -> str:
        if self.by_schema and schema is not None:
            try:
                return self.model.chat({**request, "schema": schema})
            except Exception as e:
                if not rejects_schema(e):
                    raise
                self.by_schema = False
        return self.model.chat({**request, "json": True})


def embed_all(model: EmbedModel, texts: list[str], dim: int) -> list[list[float]]:
    """Vectors of the texts; a batch that fails is halved until the failing text is alone, which gets zeros. Blank texts are sent as "(empty)"."""
    if not texts:
        return []
    try:
        return model.embed([t if t.strip() else "(empty)" for t in texts])
    except Exception:
        if len(texts) == 1:
            return [[0.0] * dim]
        half = len(texts) // 2
        return embed_all(model, texts[:half], dim) + embed_all(model, texts[half:], dim)


def embedded(df: DataFrame, model: EmbedModel, key: str = "id", text: str = "text", dim: int = 64) -> DataFrame:
    """key and vector of each row's text (null as empty), in batches on the executors."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = ["" if t is None else t for t in frame.iloc[:, 1]]
            vectors = [v for i in range(0, len(texts), EMBED_BATCH) for v in embed_all(model, texts[i : i + EMBED_BATCH], dim)]
            yield pd.DataFrame({key: frame.iloc[:, 0], "vector": vectors})

    return df.select(F.col(key), F.col(text)).mapInPandas(each, f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>")


def answered(df: DataFrame, model: ChatModel, keys: list[str], prompt: str = "prompt") -> DataFrame:
    """keys and the model's answer to each row's prompt, null where it fails."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for p in frame[prompt]:
                try:
                    answers.append(model.chat({"messages": [{"role": "user", "content": p}]}))
                except Exception:
                    answers.append(None)
            yield frame[keys].assign(answer=answers)

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, prompt).mapInPandas(each, f"{kinds}, answer string")


def chosen_dimensions(answer: str | None) -> list[str]:
    """The dimensions that a triage answer picks, the constant one with them; all of them if it can't be read or picks none."""
    try:
        text = answer or ""
        picked = [d for d in json.loads(text[text.index("{") : text.rindex("}") + 1])["dimensions"] if d in DIMENSIONS]
    except (ValueError, KeyError, TypeError):
        picked = []
    if not picked:
        return list(DIMENSIONS)
    return picked if ALWAYS in picked else [*picked, ALWAYS]


#: Signs in an answer that it means to have findings.
MEANT_FINDINGS = 'findings|"file"|"severity"'


def needs_repair(answer: str, n_findings: int) -> bool:
    """Whether an answer without findings looks as if it meant some."""
    return n_findings == 0 and re.search(MEANT_FINDINGS, answer) is not None


def tool_loop(model: ChatModel, tools: dict[str, Callable[[dict], str]], request: dict, rounds: int = TOOL_ROUNDS) -> str:
    """Answers of a model that may ask for tools as {"tool": ..., "args": ...}; after `rounds` such answers it is asked for its last."""
    for _ in range(rounds):
        said = model.chat(request)
        try:
            call = json.loads(said)
            name, args = call["tool"], call.get("args", {})
        except (ValueError, KeyError, TypeError):
            return said
        try:
            result = tools[name](args)
        except Exception as e:
            result = f"error: {e}"
        request = {**request, "messages": [*request.get("messages", []), {"role": "tool", "content": result}]}
    return model.chat({**request, "tools": []})
