"""Interfaces of outside services, and deterministic local stand-ins.

The stand-ins are not models: they let every dataflow run and be tested without a network.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from typing import Protocol, TypeVar

T = TypeVar("T")


class TextExtractor(Protocol):
    name: str

    def extract(self, path: str, content: bytes) -> str | None: ...


class ChunkCleaner(Protocol):
    def clean(self, texts: Sequence[str]) -> list[str | None]: ...


class DenseEmbedder(Protocol):
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]: ...


class NoteWriter(Protocol):
    def write(self, prompts: Sequence[str]) -> list[str | None]: ...


class NoteSink(Protocol):
    def put(self, item_key: str, html: str, version: int | None) -> int: ...


class Conflict(Exception):
    """The item changed since it was read; the sink's answer names its version."""

    def __init__(self, version: int):
        super().__init__(f"version {version}")
        self.version = version


class PermanentError(Exception):
    """A failure that another attempt cannot mend."""


def with_retries(call: Callable[[], T], attempts: int = 3, wait: Callable[[int], float] = lambda n: 2.0**n, sleep: Callable[[float], None] = time.sleep) -> T:
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except PermanentError:
            raise
        except Exception:
            if attempt == attempts:
                raise
            sleep(wait(attempt))
    raise AssertionError


def put_note(sink: NoteSink, item_key: str, html: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> int:
    """Write a note; after a conflict the newer version is used, other failures wait and try again."""
    version = None
    for attempt in range(1, attempts + 1):
        try:
            return sink.put(item_key, html, version)
        except Conflict as e:
            version = e.version
        except PermanentError:
            raise
        except Exception:
            if attempt == attempts:
                raise
            sleep(2.0**attempt)
    raise RuntimeError(f"{item_key} kept changing")


class PlainText:
    """Decodes UTF-8 files; stands in for native text extraction."""

    name = "plain"

    def extract(self, path: str, content: bytes) -> str | None:
        try:
            return content.decode()
        except UnicodeDecodeError:
            return None


def cascade(extractors: Sequence[TextExtractor], path: str, content: bytes) -> tuple[str | None, str | None, list[str]]:
    """The first extractor with text wins: text, its name, the errors of those before."""
    errors = []
    for e in extractors:
        try:
            text = e.extract(path, content)
            if text and text.strip():
                return text, e.name, errors
            errors.append(f"{e.name}: no text")
        except Exception as x:
            errors.append(f"{e.name}: {x}")
    return None, None, errors


class WhitespaceCleaner:
    """Joins words broken over lines and squeezes white space; stands in for a language model."""

    def clean(self, texts: Sequence[str]) -> list[str | None]:
        return [re.sub(r"[ \t]+", " ", re.sub(r"(\w)-\n(\w)", r"\1\2", t)).strip() if t else None for t in texts]


class HashEmbedder:
    """Signed feature hashing of words, scaled to length 1; stands in for an embedding model."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self._known: dict[str, tuple[int, float]] = {}

    def _places(self, words: list[str]) -> list[tuple[int, float]]:
        """Dimension and sign of each word; most words come again and again, so they are kept, as long as they are few."""
        if len(self._known) > 200_000:
            self._known.clear()
        for w in set(words).difference(self._known):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            self._known[w] = (h % self.dimensions, 1.0 if h >> 63 else -1.0)
        return [self._known[w] for w in words]

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = [0.0] * self.dimensions
            for i, sign in self._places(re.findall(r"\w+", (t or "").lower())):
                v[i] += sign
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else None)
        return out
