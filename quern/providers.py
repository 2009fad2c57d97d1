"""Models behind an interface, with deterministic offline ones.

A provider embeds texts, reads a query's intent, or explains ranked products. Plans call
providers inside ``mapInArrow``, batch by batch; retry and fallback are wrappers. The offline
providers need no network, so plans and tests run the same everywhere.
"""

from __future__ import annotations

import hashlib
import importlib
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a passing failure, and as a model that cannot be used.
TRANSIENT_STATUS = (408, 409, 429, 500, 502, 503, 504)
TRANSIENT_NAMES = ("APITimeoutError", "APIConnectionError", "RateLimitError", "InternalServerError")
FALLBACK_NAMES = ("NotFoundError", "PermissionDeniedError")
MODEL_HINTS = ("access", "available", "does not exist", "invalid model", "not found", "permission", "unsupported")
MAX_ATTEMPTS, MAX_BACKOFF = 5, 30
COMPLETION_TOKENS = 200
SUMMARY_CHARS = 1000


class ProviderError(RuntimeError):
    """A provider's answer cannot be used."""


class MissingKeyError(ProviderError):
    """A provider has no key to ask its model with."""


@dataclass(frozen=True)
class Vectors:
    """An answer to a request of texts: (index of the text, vector) in any order, and what it used."""

    rows: list[tuple[int, Any]]
    prompt_tokens: int = 0
    total_tokens: int = 0


class Embedder(Protocol):
    """Has ``embed``; where it has ``request(texts, timeout) -> Vectors`` as well, jobs ask by that."""

    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class IntentParser(Protocol):
    def parse(self, query: str) -> dict[str, Any]: ...


class Explainer(Protocol):
    def explain(self, prompt: str, ranks: list[int]) -> list[tuple[int, str]]: ...


class VectorIndex(Protocol):
    def search(self, vector: list[float], k: int) -> DataFrame: ...


# --- failures ----------------------------------------------------------------------------


def is_transient(error: Exception) -> bool:
    return getattr(error, "status_code", None) in TRANSIENT_STATUS or type(error).__name__ in TRANSIENT_NAMES


def wants_fallback(error: Exception) -> bool:
    name = type(error).__name__
    said = f"{error} {getattr(error, 'body', '')}".lower()
    return name in FALLBACK_NAMES or (name == "BadRequestError" and "model" in said and any(h in said for h in MODEL_HINTS))


def transient_column(status: Column, name: Column) -> Column:
    return F.coalesce(status.isin(*TRANSIENT_STATUS), F.lit(False)) | F.coalesce(name.isin(*TRANSIENT_NAMES), F.lit(False))


def fallback_column(name: Column, message: Column) -> Column:
    said = F.lower(message)
    hinted = said.contains("model") & said.rlike("|".join(MODEL_HINTS))
    return F.coalesce(name.isin(*FALLBACK_NAMES) | ((name == "BadRequestError") & hinted), F.lit(False))


def backoff(attempt: int) -> int:
    return min(2**attempt, MAX_BACKOFF)


def backoff_column(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(MAX_BACKOFF))).cast("int")


def with_retry(call: Callable[[], Any], sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's result; passing failures are tried again, the last one raised."""
    for attempt in range(MAX_ATTEMPTS):
        try:
            return call()
        except Exception as e:
            if not is_transient(e) or attempt == MAX_ATTEMPTS - 1:
                raise
            sleep(backoff(attempt))
    raise AssertionError("unreachable")


def with_fallback(call: Callable[[str], Any], models: tuple[str, ...]) -> Any:
    """The call's result with the first model that can be used."""
    for i, model in enumerate(models):
        try:
            return call(model)
        except Exception as e:
            if i == len(models) - 1 or not wants_fallback(e):
                raise
    raise ProviderError("no model given")


# --- answers -----------------------------------------------------------------------------


def field_of(value: Any, name: str, default: Any = None) -> Any:
    return value.get(name, default) if isinstance(value, dict) else getattr(value, name, default)


def refusal_of(response: Any) -> str | None:
    """The first refusal among the contents of a response's outputs."""
    contents = (c for out in field_of(response, "output") or () for c in field_of(out, "content") or ())
    first = next((c for c in contents if field_of(c, "type") == "refusal"), None)
    said = field_of(first, "refusal") if first is not None else None
    return str(said) if said else None


def summary_of(response: Any) -> str:
    shown = repr(field_of(response, "output"))
    cut = shown if len(shown) <= SUMMARY_CHARS else shown[:SUMMARY_CHARS] + "..."
    return f"status={field_of(response, 'status')!r}, output={cut}"


def refusal_column(response: Column) -> Column:
    """The same over a VARIANT column."""
    outputs = F.coalesce(F.try_variant_get(response, "$.output", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    contents = F.flatten(F.transform(outputs, lambda o: F.coalesce(F.try_variant_get(o, "$.content", "array<variant>"), F.expr("cast(array() as array<variant>)"))))
    refusals = F.filter(contents, lambda c: F.try_variant_get(c, "$.type", "string") == "refusal")
    return F.nullif(F.try_variant_get(F.try_element_at(refusals, F.lit(1)), "$.refusal", "string"), F.lit(""))


def checked_rows(vectors: np.ndarray, rows: int, dimensions: int) -> np.ndarray:
    """Unit float32 rows; raises where there are too few, or one is of another size, not finite or zero."""
    v = np.asarray(vectors, np.float64)
    if v.ndim != 2 or v.shape != (rows, dimensions):
        raise ProviderError(f"expected {rows} vectors of {dimensions}, got {v.shape}")
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    if not np.isfinite(v).all() or not (norms > 0).all():
        raise ProviderError("a vector is not finite or zero")
    return (v / norms).astype(np.float32)


def in_order(answer: Vectors, n: int) -> list:
    """The vectors by index; raises unless there is exactly one for each of the n texts."""
    if sorted(i for i, _ in answer.rows) != list(range(n)):
        raise ProviderError(f"expected answers to {n} texts, got those to {sorted(i for i, _ in answer.rows)[:10]}")
    return [v for _, v in sorted(answer.rows, key=lambda r: r[0])]


def ask_vectors(embedder: Embedder, texts: list[str], timeout: float = 60.0) -> tuple[np.ndarray, int, int]:
    """(unit rows in the order of the texts, prompt tokens, total tokens) of one request, retried."""
    ask = getattr(embedder, "request", None)
    answer = with_retry((lambda: ask(texts, timeout)) if ask else (lambda: Vectors(list(enumerate(embedder.embed(texts))))))
    return checked_rows(in_order(answer, len(texts)), len(texts), embedder.dimensions), answer.prompt_tokens, answer.total_tokens


def status_of(error: Exception) -> str:
    return "missing_api_key" if isinstance(error, MissingKeyError) else "upstream_error"


# --- clients -----------------------------------------------------------------------------


def named(spec: str) -> Any:
    """What ``module:name`` names."""
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"{spec!r} is not module:name")
    return getattr(importlib.import_module(module), name)


@lru_cache(maxsize=8)
def _client(factory: str, key: str) -> Any:
    return named(factory)(key)


@dataclass(frozen=True)
class Connection:
    """Makes a client in the process that asks: ``factory`` (module:function) is called with the key that this process finds in
    its environment or in ``env_file``. A plan carries the names alone, never the key."""

    factory: str
    env_file: str | None = None

    def __call__(self) -> Any:
        from quern.sources.files import settings

        try:
            key = settings(required=True, path=self.env_file)["api_key"]
        except ValueError as e:
            raise MissingKeyError(str(e)) from None
        return _client(self.factory, key)


@dataclass(frozen=True)
class ClientEmbedder:
    """Embeds through a client with ``embeddings.create``; ``connect`` makes one in each process."""

    model: str
    dimensions: int
    connect: Callable[[], Any]

    def request(self, texts: list[str], timeout: float) -> Vectors:
        answer = self.connect().embeddings.create(model=self.model, input=texts, dimensions=self.dimensions, encoding_format="float", timeout=timeout)
        usage = field_of(answer, "usage")
        used = [int(field_of(usage, name, 0) or 0) for name in ("prompt_tokens", "total_tokens")]
        return Vectors([(int(field_of(d, "index")), field_of(d, "embedding")) for d in field_of(answer, "data")], *used)

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.asarray(in_order(self.request(texts, 60.0), len(texts)))


@dataclass(frozen=True)
class TextModel:
    """Asks a client with ``responses``: the first of ``models``, or the next where it cannot be used."""

    models: tuple[str, ...]
    connect: Callable[[], Any]

    def _asked(self, system: str, user: str) -> list[dict[str, str]]:
        return [{"role": "system", "content": system}, {"role": "user", "content": user}]

    def parse_structured(self, system: str, user: str, shape: Any) -> Any:
        """The answer in ``shape``; a refusal, or an answer without one, raises."""
        client = self.connect()
        answer = with_fallback(lambda model: client.responses.parse(model=model, input=self._asked(system, user), text_format=shape), self.models)
        found = field_of(answer, "output_parsed")
        return found if found is not None else self._none(answer)

    def complete_text(self, system: str, user: str) -> str:
        """A short text of at most COMPLETION_TOKENS; only the first model is told to think little."""
        client = self.connect()

        def ask(model: str) -> Any:
            more = {"reasoning": {"effort": "minimal"}} if model == self.models[0] else {}
            return client.responses.create(model=model, input=self._asked(system, user), store=False, max_output_tokens=COMPLETION_TOKENS, **more)

        answer = with_fallback(ask, self.models)
        return " ".join(str(field_of(answer, "output_text") or "").split()) or self._none(answer)

    def _none(self, answer: Any) -> Any:
        refusal = refusal_of(answer)
        raise ProviderError(f"the model refused: {refusal}" if refusal else f"an answer without content: {summary_of(answer)}")


@dataclass(frozen=True)
class ModelParser:
    """Intent by a text model; ``shape`` is what its answers are parsed to."""

    model: TextModel
    system: str
    shape: Any = None

    def parse(self, query: str) -> dict[str, Any]:
        found = self.model.parse_structured(self.system, f"Shopper query: {query}", self.shape)
        return {name: field_of(found, name) for name in (f.split()[0] for f in INTENT_DDL.split(", "))}


@dataclass(frozen=True)
class ModelExplainer:
    """Explanations of all products of a prompt in one answer."""

    model: TextModel
    system: str
    shape: Any = None

    def explain(self, prompt: str, ranks: list[int]) -> list[tuple[int, str]]:
        found = field_of(self.model.parse_structured(self.system, prompt, self.shape), "explanations") or []
        return [(field_of(e, "rank"), field_of(e, "why_this_matches")) for e in found]


# --- offline -----------------------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _axis(word: str, dimensions: int) -> tuple[int, float]:
    """A word's axis and sign, by the first 60 bits of its md5."""
    h = int(hashlib.md5(word.encode()).hexdigest()[:15], 16)
    return h % dimensions, 1.0 if h >> 59 else -1.0


@dataclass(frozen=True)
class HashEmbedder:
    """Signed feature hashing of words; a text without words, or whose words cancel out, has the first axis."""

    dimensions: int = 64
    model: str = "hashed-words"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float64)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                axis, sign = _axis(word, self.dimensions)
                out[row, axis] += sign
            if not out[row].any():
                out[row, 0] = 1.0
        return out


@dataclass(frozen=True)
class LexiconParser:
    """Intent by word lists."""

    occasions: tuple[str, ...] = ("wedding", "party", "work", "beach", "travel")
    seasons: tuple[str, ...] = ("summer", "winter", "spring", "autumn")
    garments: tuple[str, ...] = ("dress", "shirt", "shoes", "jacket", "pants", "skirt")
    audiences: tuple[str, ...] = ("women", "men", "kids")

    def parse(self, query: str) -> dict[str, Any]:
        words = re.findall(r"\w+", query.lower())
        first = lambda known: next((w for w in words if w in known), None)
        named = {*self.occasions, *self.seasons, *self.garments, *self.audiences}
        return {
            "occasion": first(self.occasions), "season": first(self.seasons), "audience": first(self.audiences),
            "price_preference": "low" if {"cheap", "budget"} & set(words) else None,
            "garment_types": [w for w in words if w in self.garments], "attributes": [w for w in words if w not in named and len(w) > 3],
            "retrieval_text": " ".join(words),
        }


@dataclass(frozen=True)
class TemplateExplainer:
    template: str = "Matches the request at rank {rank}."
    seen: list = field(default_factory=list, compare=False)

    def explain(self, prompt: str, ranks: list[int]) -> list[tuple[int, str]]:
        return [(r, self.template.format(rank=r)) for r in ranks]


@dataclass(frozen=True)
class Providers:
    """The three models that requests need."""

    embedder: Embedder
    parser: IntentParser
    explainer: Explainer


PARSER_PROMPT = "Turn the shopper's query into the fields asked for. Leave out what it does not say; retrieval_text is one sentence for finding products."
EXPLAINER_PROMPT = "For every ranked product say in one sentence how it meets the shopper's intent, by what is given about it alone. Answer each rank once."


def providers_of(connect: str | None, env_file: str | None = None, embedding_model: str = "", dimensions: int = 1536, text_models: tuple[str, ...] = (), intent_shape: str | None = None, explanations_shape: str | None = None) -> Providers:
    """Models behind the client that ``connect`` (module:function) makes; the offline ones without it."""
    if connect is None:
        return Providers(HashEmbedder(), LexiconParser(), TemplateExplainer())
    client = Connection(connect, env_file)
    text = TextModel(text_models, client)
    shapes = [named(s) if s else None for s in (intent_shape, explanations_shape)]
    return Providers(ClientEmbedder(embedding_model, dimensions, client), ModelParser(text, PARSER_PROMPT, shapes[0]), ModelExplainer(text, EXPLAINER_PROMPT, shapes[1]))


# --- plans -------------------------------------------------------------------------------

INTENT_DDL = (
    "occasion string, season string, garment_types array<string>, attributes array<string>, audience string, price_preference string, retrieval_text string"
)


def embed_column(df: DataFrame, embedder: Embedder, key: str, text: str, batch: int = 256, errors: bool = False) -> DataFrame:
    """key, embedding (unit vectors): requests of at most ``batch`` texts, checked and retried.

    With ``errors`` a failure does not end the task: the texts of a failed request are asked
    for one by one, and those that fail have a null vector and their status in ``error``.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(text: str) -> tuple[Any, str | None]:
        try:
            return ask_vectors(embedder, [text])[0][0], None
        except Exception as e:
            return None, status_of(e)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [t or "" for t in part.column("t").to_pylist()]
                try:
                    found = [(v, None) for v in ask_vectors(embedder, texts)[0]]
                except Exception:
                    if not errors:
                        raise
                    found = [one(t) for t in texts]
                arrays = [part.column(key), pa.array([v for v, _ in found], pa.list_(pa.float32()))]
                if errors:
                    arrays.append(pa.array([e for _, e in found], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [key, "embedding", "error"][: len(arrays)])

    ddl = f"{key} {kind}, embedding array<float>" + (", error string" if errors else "")
    return df.select(key, F.col(text).alias("t")).mapInArrow(run, ddl)


def parse_column(df: DataFrame, parser: IntentParser, key: str, query: str) -> DataFrame:
    """key, query, INTENT_DDL and error of every query: a query that fails has nulls and its status in ``error``."""
    kind = df.schema[key].dataType.simpleString()
    types = {"array<string>": pa.list_(pa.string()), "string": pa.string()}
    fields = [f.split() for f in f"{INTENT_DDL}, error string".split(", ")]

    def one(query: str) -> dict[str, Any]:
        try:
            return with_retry(lambda: parser.parse(query)) | {"error": None}
        except Exception as e:
            return {"error": status_of(e)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(q or "") for q in b.column("query").to_pylist()]
            arrays = [pa.array([f.get(n) for f in found], types[t]) for n, t in fields]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("query"), *arrays], [key, "query", *[n for n, _ in fields]])

    return df.select(key, F.col(query).alias("query")).mapInArrow(run, f"{key} {kind}, query string, {INTENT_DDL}, error string")


def explain_column(prompts: DataFrame, explainer: Explainer, key: str) -> DataFrame:
    """key, rank, why_this_matches, place, error: one request per prompt (key, prompt, ranks). A prompt that
    fails has one row, with its status in ``error`` and no rank."""
    kind = prompts.schema[key].dataType.simpleString()

    def one(k: Any, prompt: str, ranks: list[int]) -> list[tuple]:
        try:
            said = with_retry(lambda: explainer.explain(prompt, ranks))
            return [(k, r, why, at, None) for at, (r, why) in enumerate(said)]
        except Exception as e:
            return [(k, None, None, None, status_of(e))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row for asked in zip(*[b.column(c).to_pylist() for c in (key, "prompt", "ranks")], strict=True) for row in one(*asked)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [b.column(key).type, pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "rank", "why_this_matches", "place", "error"])

    return prompts.select(key, "prompt", "ranks").mapInArrow(run, f"{key} {kind}, rank int, why_this_matches string, place int, error string")
