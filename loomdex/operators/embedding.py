"""Embedding providers as batched UDFs. The default needs no model: hashed words, the same on every machine."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[list[float]]]
_registry: dict[str, Callable[..., Provider]] = {}


def provider(name: str):
    """Register a factory of providers under a name."""

    def add(factory: Callable[..., Provider]) -> Callable[..., Provider]:
        _registry[name] = factory
        return factory

    return add


@provider("hash")
def hashed(dim: int = 64) -> Provider:
    """Each word adds 1 or -1 to a column by its MD5 digest; the vector is scaled to length one. Texts without a word are all zero."""
    import re

    from loomdex.functions.text import WORD

    find, known = re.compile(WORD).findall, {}

    def run(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        if len(known) > 300_000:
            known.clear()
        for i, t in enumerate(texts):
            for w in find((t or "").lower()):
                h = known.get(w)
                if h is None:
                    d = hashlib.md5(w.encode()).digest()
                    h = known[w] = (int.from_bytes(d[:4], "big") % dim, 1.0 if d[4] & 1 else -1.0)
                out[i, h[0]] += h[1]
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out.astype(np.float32).tolist()

    return run


@provider("http")
def http(url: str, model: str, batch: int = 32, retries: int = 3, timeout: float = 600.0, headers: dict | None = None) -> Provider:
    """A service that takes {model, input: [...]} and gives {embeddings: [...]}. A batch that fails is sent again text by text."""

    def post(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts}).encode()
        for k in range(retries):
            try:
                request = urllib.request.Request(url, body, {"Content-Type": "application/json"} | (headers or {}))
                with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(request, timeout=timeout) as r:
                    return json.load(r)["embeddings"]
            except OSError:
                if k + 1 == retries:
                    raise
                time.sleep(2**k)
        raise AssertionError

    def run(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), batch):
            part = texts[at : at + batch]
            try:
                out += post(part)
            except OSError:
                out += [post([t])[0] for t in part]
        return out

    return run


def get_provider(name: str, **options) -> Provider:
    if name not in _registry:
        raise ValueError(f"unknown embedding provider: {name}")
    return _registry[name](**options)


def embed(text: Column, name: str = "hash", **options) -> Column:
    """array<float>; null texts have a null vector."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        made = get_provider(name, **options)(s.fillna("").tolist())
        return pd.Series([None if n else v for n, v in zip(s.isna(), made, strict=True)])

    return run(text)


def unload(url: str, model: str, timeout: float = 10.0) -> bool:
    """Ask a service to let go of a model; whether it answered."""
    body = json.dumps({"model": model, "keep_alive": 0}).encode()
    try:
        with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout):
            return True
    except OSError:
        return False
