"""What a user can replace: how texts are embedded, how tokens are counted, how symbols are found."""

from __future__ import annotations

import re
from typing import Protocol

import numpy as np
import xxhash


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Tokenizer(Protocol):
    def spans(self, text: str) -> list[tuple[int, int]]: ...


class SymbolExtractor(Protocol):
    def extract(self, path: str, text: str) -> list[dict]: ...


class HashedEmbedder:
    """Feature hashing of words onto a unit sphere: deterministic and model-free, so it compares words, not meanings."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for i, text in enumerate(texts):
            for w in re.findall("[A-Za-z0-9]+", text or ""):
                h = xxhash.xxh64_intdigest(w.lower())
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class WordTokenizer:
    """Words and single marks stand for subword tokens; budgets are counted in these."""

    pattern = re.compile(r"\w+|[^\w\s]")

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text)]


class BpeTokenizer:
    """Subword tokens by a vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        self.path, self._loaded = path, None

    def __getstate__(self):
        return {"path": self.path, "_loaded": None}

    def spans(self, text: str) -> list[tuple[int, int]]:
        if self._loaded is None:
            from tokenizers import Tokenizer as Loaded

            self._loaded = Loaded.from_file(self.path)
        return [s for s in self._loaded.encode(text, add_special_tokens=False).offsets]
