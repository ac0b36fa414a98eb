"""Chat models behind a port: tiers of models, retries of a transport, token use; rows are answered inside the tasks.

A transport is a callable (path, payload) that returns (status, body); None as the status says that nothing answered.
No server is called by the engine itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame

from ..sources.tables import ship

Transport = Callable[[str, dict], tuple[int | None, Any]]

#: Tries of a request, and seconds before the second, doubled for each later one.
TRIES, FIRST_WAIT = 3, 0.5


class ProviderError(RuntimeError):
    """A model server that refuses, fails for good or answers what can't be used."""


@dataclass(frozen=True)
class Answer:
    text: str
    prompt_tokens: int
    completion_tokens: int

    @property
    def total_tokens(self) -> int:
        return self.prompt_tokens + self.completion_tokens


class ModelProvider(Protocol):
    def chat(self, messages: list[dict], tier: str = "standard", **options) -> Answer: ...


def worth_retrying(status: int | None) -> bool:
    """What may pass by waiting: no answer, a busy server and errors on its side; our own mistakes may not."""
    return status is None or status == 429 or not 400 <= status < 500


def waits(tries: int = TRIES, first: float = FIRST_WAIT) -> Iterator[float]:
    """Seconds to wait before each try: none before the first."""
    yield 0.0
    for k in range(tries - 1):
        yield first * 2**k


def request(transport: Transport, path: str, payload: dict, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The body of the first good answer."""
    status = None
    for wait in waits(tries):
        if wait:
            sleep(wait)
        status, body = transport(path, payload)
        if status is not None and 200 <= status < 300:
            return body
        if not worth_retrying(status):
            break
    raise ProviderError(f"{path} failed with {status if status is not None else 'no answer'}")


@dataclass
class HttpModels:
    """Chat over a transport; a tier without a model of its own takes the standard one."""

    transport: Transport
    models: dict[str, str]
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def model_for(self, tier: str) -> str:
        return self.models.get(tier) or self.models["standard"]

    def chat(self, messages: list[dict], tier: str = "standard", temperature: float = 0.0, most_tokens: int | None = None) -> Answer:
        options = {"temperature": temperature} | ({"num_predict": most_tokens} if most_tokens else {})
        body = request(self.transport, "/api/chat", {"model": self.model_for(tier), "messages": messages, "stream": False, "options": options}, sleep=self.sleep)
        try:
            return Answer(body["message"]["content"], int(body.get("prompt_eval_count") or 0), int(body.get("eval_count") or 0))
        except (KeyError, TypeError, AttributeError) as e:
            raise ProviderError(f"no answer in {body!r}") from e


def answered(rows: DataFrame, provider: ModelProvider, prompt: str = "prompt", tier: str = "standard") -> DataFrame:
    """rows with answer, prompt_tokens, completion_tokens and error (null where the model answered)."""
    ship(rows.sparkSession)

    def run(frames):
        for f in frames:
            out = []
            for text in f[prompt].tolist():
                try:
                    a = provider.chat([{"role": "user", "content": text or ""}], tier)
                    out.append((a.text, a.prompt_tokens, a.completion_tokens, None))
                except ProviderError as e:
                    out.append((None, 0, 0, str(e)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield f.assign(answer=list(columns[0]), prompt_tokens=list(columns[1]), completion_tokens=list(columns[2]), error=list(columns[3]))

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.mapInPandas(run, f"{fields}, answer string, prompt_tokens long, completion_tokens long, error string")
