"""Engines that read words from images of pages, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomdex.operators.structure import ocr_lines

#: The words of an image: x, y, text, confidence (null where unknown).
Engine = Callable[[bytes], list[tuple[float, float, str, float | None]]]
_engines: dict[str, Callable[[], Engine]] = {}


def engine(name: str):
    """Register a factory of engines, which is called once for each task."""

    def add(factory: Callable[[], Engine]) -> Callable[[], Engine]:
        _engines[name] = factory
        return factory

    return add


def recognised(images: DataFrame, name: str) -> DataFrame:
    """(doc, page, lines, error) of images (doc, page, image). An image that the engine fails on has no lines and the error."""
    if name not in _engines:
        raise ValueError(f"unknown OCR engine: {name}")
    factory = _engines[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = factory()
        for frame in frames:
            words, errors = [], []
            for image in frame["image"]:
                try:
                    words.append([{"x": float(x), "y": float(y), "text": t, "conf": c} for x, y, t, c in read(bytes(image))])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - one bad page must not stop the others
                    words.append([])
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({"doc": frame["doc"], "page": frame["page"], "words": words, "error": errors})

    made = images.select("doc", "page", "image").mapInPandas(run, "doc string, page int, words array<struct<x:double,y:double,text:string,conf:double>>, error string")
    return made.select("doc", "page", ocr_lines(made["words"]).alias("lines"), "error")
