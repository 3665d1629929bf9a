"""Models as replaceable leaves.

An embedder, reranker, captioner or generator is any object with the method
that its protocol names.  The ones here are plain, deterministic stand-ins, so
that everything around them can run and be tested.  They are not neural models
and their results say nothing about any.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import basename, keep_head, tokens


class Embedder(Protocol):
    dimension: int

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray: ...


class Reranker(Protocol):
    def column(self, query: Column, document: Column) -> Column:
        """Score from 0 to 1 of each pair."""


class Captioner(Protocol):
    def column(self, path: Column, context: Column) -> Column: ...


class Generator(Protocol):
    def column(self, question: Column, context: Column, first_content: Column) -> Column: ...


_TOKEN = re.compile("[a-z0-9À-ɏ]+")


MOST_TOKENS = 1 << 17
#: Characters of texts whose tokens are held at once; a longer text is alone.
MOST_CHARS = 1 << 18


class _Buckets(dict):
    """Tokens that a process has seen, each with a number of 32 bits that the token alone decides; emptied when full."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MOST_TOKENS:
            self.clear()
        n = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
        return n


_BUCKETS = _Buckets()


def _runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """``texts`` in order, in runs of no more than :data:`MOST_CHARS` characters or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > MOST_CHARS:
            yield texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield texts[start:]


class HashingEmbedder:
    """Counts of a text's tokens by a hash of the token: no meaning, but alike for like wording."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        return np.concatenate([*map(self._counts, _runs(texts)), np.zeros((0, self.dimension), np.float32)])

    def _counts(self, texts: list[str | None]) -> np.ndarray:
        d = self.dimension
        found = [_TOKEN.findall((t or "").lower()) for t in texts]
        sizes = [len(ts) for ts in found]
        numbers = np.fromiter(map(_BUCKETS.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes))
        rows = np.repeat(np.arange(len(found)), sizes)
        return np.bincount(rows * d + numbers % d, minlength=len(found) * d).reshape(-1, d).astype(np.float32)


def embed(embedder: Embedder, text: Column, is_query: bool = False) -> Column:
    """Vector of each text, in Arrow batches; the embedder travels with the function."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        vectors = np.asarray(embedder.encode([t or "" for t in texts], is_query), np.float32)
        if vectors.shape != (len(texts), embedder.dimension):
            raise ValueError(f"the embedder gave {vectors.shape}, not {(len(texts), embedder.dimension)}")
        return pd.Series(list(vectors), dtype="object")

    return run(text)


class LexicalReranker:
    """Share of the question's distinct tokens that the document has; no tokens, no score."""

    def column(self, query: Column, document: Column) -> Column:
        asked = F.array_distinct(tokens(query))
        return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(document))) / F.size(asked)).otherwise(0.0)


#: What an absent or failing reranker says of every pair.
NEUTRAL = 0.5


class ContextCaptioner:
    """Says what is known of an image without looking at it."""

    def column(self, path: Column, context: Column) -> Column:
        return F.concat(context, F.lit(" ("), basename(path), F.lit(")"))


class FirstSentences:
    """Answers with the beginning of the best document."""

    def __init__(self, most: int = 200) -> None:
        self.most = most

    def column(self, question: Column, context: Column, first_content: Column) -> Column:
        return keep_head(first_content, self.most, "...")


def first_available(*factories: Callable[[], Embedder]) -> Embedder:
    """The first embedder that loads; its dimension is that of the index, so fallbacks can't be mixed into one."""
    failures = []
    for make in factories:
        try:
            return make()
        except (ImportError, OSError, RuntimeError, ValueError) as e:
            failures.append(f"{type(e).__name__}: {e}")
    raise RuntimeError("no embedder could be loaded: " + "; ".join(failures))
