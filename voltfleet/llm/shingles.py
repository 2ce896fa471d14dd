"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

from voltfleet.llm import bpe, common
from voltfleet.llm.bpe import mix

STEP = np.uint64(0x9FB21C651E98DF25)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space word of a block and the byte where it starts."""
    found = bpe.Found(data)
    return found.hashes(), found.starts


def texts_words(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text, in order."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < bpe.BLOCK - 1):
            size += len(texts[end]) + 1
            end += 1
        if size >= bpe.BLOCK:
            out.append(np.concatenate([word_hashes(part)[0] for part, _ in bpe.parts(texts[at])]))
        else:
            found, starts = word_hashes(b"\n".join(texts[at:end]))
            ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[at:end]]))
            out.extend(np.split(found, ends[:-1]))
        at = end
    return out


def shingles(words: np.ndarray, wide: int = common.SHINGLE) -> np.ndarray:
    """Distinct shingle hashes in order; fewer words than a shingle are one shingle, no words none."""
    if not len(words):
        return words
    size = min(wide, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * STEP + words[k : len(words) - size + 1 + k]
    return np.unique(mix(out + np.uint64(size)))


def text_shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct shingle hashes of whole texts, A-Z lower-cased; null texts have none."""
    return [shingles(w) for w in texts_words([common.lower_ascii(t or "") for t in texts])]
