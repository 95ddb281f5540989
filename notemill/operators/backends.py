"""Text models behind one batch interface: a configuration that travels to executors and a client made there."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .facts import join_stray_strings


@dataclass(frozen=True)
class Config:
    """kind: placeholder (offline, deterministic), http (a server that speaks the chat protocol of local model servers) or
    completions (one that speaks the chat-completions protocol; ``key`` is its bearer token). ``json`` asks for an object.

    Calls in flight never exceed workers times at_once: workers is the number of tasks that call (0: one a partition of the
    calls), at_once the number of threads of each."""

    kind: str = "placeholder"
    url: str = "http://127.0.0.1:11434/api/chat"
    model: str = "none"
    seed: int = 1225
    retries: int = 2
    pause: float = 2.0
    timeout: float = 900.0
    context: int = 16_384
    tokens: int = 4_096
    json: bool = False
    workers: int = 0
    at_once: int = 1
    key: str = field(default="", repr=False)

    def __post_init__(self):
        if self.kind not in ("placeholder", "http", "completions"):
            raise ValueError(f"no such backend: {self.kind}")
        if self.workers < 0 or self.at_once < 1:
            raise ValueError("workers must not be negative, at_once must be positive")


class Placeholder:
    """Answers from the prompt alone, so that every run agrees."""

    def __init__(self, config: Config):
        self.config = config

    def chat(self, system: str, user: str) -> str:
        digest = hashlib.sha256((system + user).encode()).hexdigest()
        if "FACTS AS JSON" in system:
            source = user.partition("SOURCE:\n")[2]
            parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", source) if s.strip()][:3]
            return json.dumps({"facts": [{"category": "Unlisted", "date": "Unknown date", "fact": p, "evidence": p, "confidence": "high"} for p in parts]}, ensure_ascii=False)
        if "VERIFY AS JSON" in system:
            sure = "fix this" in user or int(digest[:8], 16) % 3 > 0  # most pass at once, the rest on the second round
            return json.dumps({"verdict": "PASS", "coverage_score": 0.9 if sure else 0.5, "evidence_support_score": 0.97, "feedback_for_extractor": "" if sure else "fix this"})
        if task := re.match(r"JUDGE (\w+) AS JSON", system):
            return json.dumps(self.judged(task[1], int(hashlib.sha256((task[1] + user).encode()).hexdigest()[:8], 16)), ensure_ascii=False)
        if "STYLE AS JSON" in system:
            return json.dumps({"style_prompt": ""})
        return f"[OFFLINE NOTE {digest[:8]}]"


    @staticmethod
    def judged(task: str, n: int) -> dict:
        """The offline judge's answers, by a number told from the call."""
        claim = {"claim": "offline claim", "verdict": "supported", "error_type": None}
        wrong = {"claim": "offline claim", "verdict": "unsupported", "error_type": "fabricated"}
        if task == "faithfulness":
            return {"claims": [claim, wrong] if n % 5 == 0 else [claim], "faithfulness_likert": 2 if n % 5 == 0 else 3 + n % 3}
        if task == "completeness":
            kinds = (("diagnosis", "present"), ("operation", "present" if n % 4 else "absent"))
            return {"critical_facts": [{"fact": f"offline {kind}", "category": kind, "status": status} for kind, status in kinds]}
        return {"winner": ("A", "B", "tie")[n % 3]} if task == "style" else {}


class Http:
    """A local model server: one reply, greedy, with a fixed seed; failures are tried again after growing pauses."""

    def __init__(self, config: Config):
        self.config = config

    def body(self, system: str, user: str) -> dict:
        c = self.config
        form = {"format": "json"} if c.json else {}
        return {"model": c.model, "stream": False, "keep_alive": "30m", "think": False, **form, "messages": _messages(system, user), "options": {"temperature": 0, "top_p": 1, "seed": c.seed, "num_ctx": c.context, "num_predict": c.tokens}}

    def headers(self) -> dict:
        return {"Content-Type": "application/json"}

    def content(self, reply: dict) -> str:
        return reply["message"]["content"]

    def refused(self, error: urllib.error.HTTPError) -> bool:
        """Whether the same call can be made again at once, in another form."""
        return False

    def chat(self, system: str, user: str) -> str:
        c, attempt = self.config, 0
        while True:
            try:
                request = urllib.request.Request(c.url, json.dumps(self.body(system, user)).encode(), self.headers())
                with urllib.request.urlopen(request, timeout=c.timeout) as reply:
                    return self.content(json.load(reply))
            except (urllib.error.URLError, TimeoutError, KeyError, IndexError, ValueError) as e:
                if isinstance(e, urllib.error.HTTPError) and self.refused(e):
                    continue
                if attempt == c.retries:
                    raise
                attempt += 1
                time.sleep(c.pause * attempt)


class Completions(Http):
    """A server of chat completions. One that refuses temperature or seed is asked without them from then on."""

    def __init__(self, config: Config):
        super().__init__(config)
        self.sampling = True

    def body(self, system: str, user: str) -> dict:
        form = {"response_format": {"type": "json_object"}} if self.config.json else {}
        greedy = {"temperature": 0, "seed": self.config.seed} if self.sampling else {}
        return {"model": self.config.model, "messages": _messages(system, user), **form, **greedy}

    def headers(self) -> dict:
        return super().headers() | ({"Authorization": f"Bearer {self.config.key}"} if self.config.key else {})

    def content(self, reply: dict) -> str:
        return reply["choices"][0]["message"]["content"] or ""

    def refused(self, error: urllib.error.HTTPError) -> bool:
        said = error.read().decode("utf-8", "replace").lower()
        refused = self.sampling and ("temperature" in said or "seed" in said)
        self.sampling = self.sampling and not refused
        return refused


def _messages(system: str, user: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def client(config: Config) -> Placeholder | Http:
    return {"placeholder": Placeholder, "http": Http, "completions": Completions}[config.kind](config)


#: Our own wording.
REPAIR = "You mend the syntax of one malformed JSON object. Change no content and return the object only."


def json_reply(text: str) -> str | None:
    """The JSON object in a reply as canonical text: all of it, or from the first { to the last }, stray strings joined."""
    text = re.sub(r"<unused\d+>", "", re.sub(r"(?is)<think>.*?(?:</think>|$)", "", text or "")).strip()
    inner = re.search(r"(?s)\{.*\}", text)
    for attempt in (text, join_stray_strings(text), *((inner[0], join_stray_strings(inner[0])) if inner else ())):
        try:
            value = json.loads(attempt)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
    return None


class JsonClient:
    """A client whose replies are JSON objects: one that is none is given back to the model to be mended, once an attempt; without an
    object after all attempts, the call fails."""

    def __init__(self, model, config: Config):
        self.model, self.config = model, config

    def chat(self, system: str, user: str) -> str:
        for attempt in range(self.config.retries + 1):
            reply = self.model.chat(system, user)
            found = json_reply(reply)
            if found is None and (reply or "").strip():
                found = json_reply(self.model.chat(REPAIR, f"<<<\n{reply}\n>>>"))
            if found is not None:
                return found
            if attempt < self.config.retries:
                time.sleep(self.config.pause * (attempt + 1))
        raise ValueError(f"no JSON object: {(reply or '')[:200]}")


def available(config: Config) -> bool:
    """Whether the model answers at all; for a check before a long run."""
    try:
        return bool(client(config).chat("", "ping")) or True
    except Exception:  # noqa: BLE001  any failure means that it is not there
        return False


def ask(calls: DataFrame, config: Config, make: Callable[[Config], object] = client) -> DataFrame:
    """calls (any columns, with system and user) with response and error. A call that fails is a row with its error; it
    never fails the job. With config.json the response is a JSON object. A task makes config.at_once calls at a time, each thread with
    a client of its own; rows keep their order."""
    names, schema = calls.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = threading.local()

        def one(system: str | None, user: str | None) -> tuple[str | None, str | None]:
            try:
                if not hasattr(own, "model"):
                    own.model = JsonClient(make(config), config) if config.json else make(config)
                return own.model.chat(system or "", user or ""), None
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"[:500]

        with ThreadPoolExecutor(config.at_once) as threads:
            for batch in batches:
                found = list(threads.map(one, *(batch.column(names.index(c)).to_pylist() for c in ("system", "user"))))
                replies, errors = ([x[k] for x in found] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*names, "response", "error"])

    if config.workers:
        calls = calls.repartition(config.workers)
    return calls.mapInArrow(run, f"{schema}, response string, error string")


def ask_cached(calls: DataFrame, cache: DataFrame, config: Config, make: Callable[[Config], object] = client) -> tuple[DataFrame, DataFrame]:
    """(calls with response and error, new cache rows): calls with a key that the cache has are not made, equal calls are made
    once. A key is one row of few columns until its answer is joined to the calls, so a call that many rows share is made once."""
    first = cache.groupBy("key").agg(F.min("response").alias("known"))
    wanted = calls.groupBy("key").agg(F.min("system").alias("system"), F.min("user").alias("user")).join(first, "key", "left")
    made = ask(wanted.where("known is null").drop("known"), config, make).select("key", "response", "error")
    made = stored(made, "answers")
    answers = made.unionByName(wanted.where("known is not null").select("key", F.col("known").alias("response"), F.lit(None).cast("string").alias("error")))
    return calls.join(answers, "key", "left"), made.where("error is null").select("key", "response")
