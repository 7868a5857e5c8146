"""Outside models as plug-ins, with deterministic stand-ins that make no claim of quality."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Unit vectors of hashed character pairs."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size), np.float32)
        for k, t in enumerate(texts):
            for a, b in zip(t, t[1:]):
                h = zlib.crc32((a + b).encode("utf-8", "replace"))
                out[k, h % self.size] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class FirstSentence:
    """Answers with the first sentence of the context in a prompt."""

    def complete(self, prompt: str) -> str:
        body = prompt.split("Context:\n", 1)[-1].split("\nQuestion:", 1)[0]
        return body.replace("。", "。\n").split("\n")[0].strip()


def embed(df: DataFrame, text: str, model: Embedder, batch: int = 8, most_chars: int = 6000) -> DataFrame:
    """Adds column embedding, batch by batch; a batch that fails is tried text by text, cut to most_chars."""
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, out = pdf[text].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                own = texts[i : i + batch]
                try:
                    out += list(model.encode(own))
                except Exception:
                    out += [model.encode([t[:most_chars]])[0] for t in own]
            yield pdf.assign(embedding=[np.asarray(v, np.float32).tolist() for v in out])

    return df.mapInPandas(run, f"{fields}, embedding array<float>")


def prompt(question: str, parts: list[str]) -> str:
    return "Answer from the context alone.\nContext:\n" + "\n\n".join(parts) + f"\nQuestion: {question}\n"


def overlap_scorer(tokens: list[str]):
    """A stand-in for a cross-encoder: the share of query words that a text has."""
    from .functions.text import tokens as split

    return lambda c: F.size(F.array_intersect(split(F.lower(c)), F.array(*map(F.lit, tokens)))) / F.lit(max(1, len(tokens)))
