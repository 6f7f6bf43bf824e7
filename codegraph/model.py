"""Text models and embedders behind small protocols; the defaults work without a network."""

from __future__ import annotations

import importlib
import json
import re
import zlib
from collections import Counter
from typing import Protocol

import numpy as np

from .config import Options


class TextModel(Protocol):
    def call(self, prompt: str, max_tokens: int) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractive:
    """Answers with the sentences of the prompt that hold its commonest words, in order.

    A prompt that asks for a score gets one as JSON: the share of the question's words that the
    summary holds.
    """

    def __init__(self, sentences: int = 3):
        self.sentences = sentences

    def call(self, prompt: str, max_tokens: int) -> str:
        asked = re.match(r"Question: (.*)\nSummary: (.*)\nAnswer \{", prompt, re.S)
        if asked:
            wanted, held = (set(re.findall(r"[a-z]{4,}", x.lower())) for x in asked.groups())
            return json.dumps({"score": round(100 * len(wanted & held) / max(1, len(wanted))), "reason": ", ".join(sorted(wanted & held))})
        parts = [x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", prompt) if x.strip()]
        common = Counter(w for w in re.findall(r"[a-z]{4,}", prompt.lower()))
        score = [sum(common[w] for w in set(re.findall(r"[a-z]{4,}", x.lower()))) for x in parts]
        best = sorted(sorted(range(len(parts)), key=lambda i: (-score[i], i))[: self.sentences])
        return " ".join(" ".join(parts[i] for i in best).split()[:max_tokens])


class HashEmbedder:
    """Signed counts of hashed words, unit length; 384 numbers unless told otherwise."""

    def __init__(self, size: int = 384):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(word.encode())
                out[i, h % self.size] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def reflect(docstring: str, body: str, model: TextModel, rounds: int = 2, stop: str = "NO_ADDITIONS") -> str:
    """docstring with what a model adds on reading the body, in at most `rounds` calls; blank ones aren't sent."""
    if not (docstring or "").strip():
        return docstring
    for _ in range(rounds):
        said = model.call(f"Doc comment:\n{docstring}\nCode:\n{body}\nName behaviour that the comment leaves out, or answer {stop}.", 200).strip()
        if said == stop or not said:
            break
        docstring = f"{docstring}\n{said}"
    return docstring


def _made(kind: str, said: str, options: Options, default):
    if said == "offline":
        return default
    module, _, name = said.partition(":")
    if not module or not name:
        raise ValueError(f"{kind} must be offline or module:function, not {said!r}")
    return getattr(importlib.import_module(module), name)(options)


def text_model(options: Options) -> TextModel:
    """The text model that options name: the offline one, or what module:function makes of the options."""
    return _made("text_model", options.text_model, options, Extractive())


def embedder(options: Options) -> Embedder:
    """The embedder that options name, likewise."""
    return _made("embedder", options.embedder, options, HashEmbedder(options.embedding_size))
