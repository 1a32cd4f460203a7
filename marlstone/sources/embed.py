"""Embedding providers: an interface, two HTTP forms and an offline one."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmbedFailed
from ..functions.encoding import addressed, decode, encode_vec_root, encode_vec_shard
from ..functions.scalars import BUCKETS, bucket, embed_text
from ..functions.vectors import from_base64, to_base64
from ..lineage import cut

# Texts per request, seconds per request.
BATCH, TIMEOUT = 32, 30


#: The largest text of a shard that is made an object.
SHARD_BYTES = 256 << 20


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def checked(vectors: list[list[float]], n: int) -> list[list[float]]:
    """As many vectors as texts, none empty, all of one length."""
    if len(vectors) != n:
        raise EmbedFailed(f"{len(vectors)} vectors for {n} texts")
    if any(not v for v in vectors) or len({len(v) for v in vectors}) > 1:
        raise EmbedFailed("vectors are empty or of several lengths")
    return vectors


def _post(url: str, body: dict, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return json.load(answer)
    except (OSError, ValueError) as e:
        raise EmbedFailed(f"{url}: {e}") from e


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic and offline: component j is an FNV-1a hash of the text and j, in thousandths."""

    model: str = "hash"
    dim: int = 16

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            start = 2166136261
            for byte in text.encode():
                start = (start ^ byte) * 16777619 & 0xFFFFFFFF
            out.append([((start ^ j) * 16777619 & 0xFFFFFFFF) % 1000 / 1000 for j in range(self.dim)])
        return out


@dataclass(frozen=True)
class OllamaEmbedder:
    model: str
    url: str = "http://localhost:11434"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return checked(_post(self.url.rstrip("/") + "/api/embed", {"model": self.model, "input": texts}, {}).get("embeddings") or [], len(texts))


def endpoint(base: str) -> str:
    """The embeddings address below a base that may or may not name its version already."""
    base = base.rstrip("/")
    if base.endswith("/embeddings"):
        return base
    return base + ("/embeddings" if base.rsplit("/", 1)[-1].startswith("v") else "/v1/embeddings")


def align_by_index(items: list[dict], n: int) -> list[list[float]]:
    """Vectors in the order of the texts; every index once."""
    out: list[list[float] | None] = [None] * n
    for item in items:
        i = item.get("index")
        if not isinstance(i, int) or not 0 <= i < n or out[i] is not None:
            raise EmbedFailed(f"index {i!r} is out of range or repeated")
        out[i] = item["embedding"]
    if any(v is None for v in out):
        raise EmbedFailed("vectors are missing")
    return out  # type: ignore[return-value]


@dataclass(frozen=True)
class OpenAIEmbedder:
    model: str
    base: str
    key: str = ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        answer = _post(endpoint(self.base), {"model": self.model, "input": texts}, {"Authorization": f"Bearer {self.key}"} if self.key else {})
        return checked(align_by_index(answer.get("data") or [], len(texts)), len(texts))


def provider(name: str, model: str, url: str = "", key: str = "") -> Embedder:
    """The provider of a configuration; an empty name means the first HTTP form."""
    if name == "hash":
        return HashEmbedder(model or "hash")
    if not model:
        raise EmbedFailed("no embedding model is configured")
    if name in ("", "ollama"):
        return OllamaEmbedder(model, url) if url else OllamaEmbedder(model)
    if name == "openai":
        return OpenAIEmbedder(model, url or "https://api.openai.com/v1", key)
    raise EmbedFailed(f"unknown embedding provider {name!r}")


def embedded(notes: DataFrame, embedder: Embedder) -> DataFrame:
    """path, model, dim, bucket and vec of notes; requests of BATCH texts from the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                vectors = checked(embedder.embed(part["text"].tolist()), len(part))
                yield pd.DataFrame({"path": part["path"], "model": embedder.model, "dim": len(vectors[0]), "vec": vectors})

    found = notes.select("path", embed_text("title", "body").alias("text")).mapInPandas(run, "path string, model string, dim int, vec array<float>")
    return found.withColumn("bucket", bucket("path"))


def vector_objects(vectors: DataFrame) -> tuple[DataFrame | None, str | None]:
    """The objects (kind, data) of a generation of vectors, and its root's address.

    A shard is one text for all vectors of a path bucket. Where that would pass SHARD_BYTES, the form can't hold
    the vectors: there are no objects then, and they live in their relation alone.
    """
    widest = vectors.groupBy("bucket").agg(F.sum(6 * F.col("dim") + F.octet_length("path") + 32).alias("n")).agg(F.max("n")).first()[0]
    if widest is None or widest > SHARD_BYTES:
        return None, None
    items = vectors.select("bucket", "model", "dim", F.struct("path", to_base64("vec").alias("vec")).alias("item"))
    shards = items.groupBy("bucket", "model", "dim").agg(F.collect_list("item").alias("items"))
    shards = cut(shards.select("bucket", "model", "dim", addressed(encode_vec_shard(F.col("model"), F.col("dim"), F.col("items"))).alias("o")))
    found = {r["bucket"]: r for r in shards.select("bucket", "model", "dim", "o.addr").collect()}  # one row per bucket
    one = next(iter(found.values()))
    slots = F.array(*(F.lit(found[b]["addr"] if b in found else "") for b in range(BUCKETS)))
    root = vectors.sparkSession.range(1).select(addressed(encode_vec_root(F.lit(one["model"]), F.lit(one["dim"]), slots)).alias("o")).select("o.addr", F.lit("vecroot").alias("kind"), "o.data")
    rows = shards.select(F.lit("vecshard").alias("kind"), "o.data").unionByName(root.select("kind", "data"))
    return rows, root.first()["addr"]


def vectors_of(objects: DataFrame) -> DataFrame:
    """The rows of VECTORS that vector objects hold; a generation is named by its root."""
    roots = decode(objects, "vecroot").select(F.col("addr").alias("generation"), F.posexplode("o.shards").alias("bucket", "shard")).where("shard <> ''")
    shards = decode(objects, "vecshard").select(F.col("addr").alias("shard"), "o.model", "o.dim", F.explode("o.items").alias("item"))
    return roots.join(shards, "shard").select("generation", "model", "dim", "bucket", "item.path", from_base64("item.vec").alias("vec"))


def check_uniform(vectors: DataFrame) -> None:
    row = vectors.agg(F.min("dim").alias("low"), F.max("dim").alias("high")).head()
    if row["low"] != row["high"]:
        raise EmbedFailed(f"vectors of {row['low']} to {row['high']} components")
