"""Deterministic answers without models: hashed features and word overlap."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Sequence

from .base import Provider

#: Words of nearness and of order in queries (a vocabulary of our own).
NEAR = ("near", "next to", "beside", "close to", "closest", "nearest", "by the", "adjacent")
FAR = ("far from", "farthest", "furthest", "away from")
MOST = ("closest", "nearest", "farthest", "furthest")
BETWEEN = r"\b(?:near|next to|beside|close to|closest to|nearest to|nearest|by|adjacent to|far from|farthest from|furthest from|away from|on|under|behind|above|below|between|in front of|left of|right of)\b"


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def hashed(words: Sequence[str], dimension: int) -> list[float]:
    """Signed feature hashing, of length 1 unless empty."""
    v = [0.0] * dimension
    for w in words:
        h = zlib.crc32(w.encode())
        v[h % dimension] += 1.0 if h >> 31 else -1.0
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


class OfflineProvider(Provider):
    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_text(self, texts):
        return [hashed(_words(t), self.dimension) for t in texts]

    def embed_image(self, images):
        return [hashed([str(b) for b in bytes(i)], self.dimension) for i in images]

    def tag(self, images):
        return [[f"thing{zlib.crc32(bytes(i)) % 97}"] for i in images]

    def describe(self, images, labels):
        return [json.dumps({"caption": ", ".join(x), "room_type_guess": "", "description": "A view of " + (", ".join(x) or "nothing known") + ".", "scene_layout": "", "objects": [{"id": n, "name": n, "confidence": 0.5} for n in x]}) for x in labels]

    def summarize(self, texts):
        return [" ".join(t.split(".")[0].strip() + "." for t in x if t) for x in texts]

    def detect(self, images, tags):
        return [[] for _ in images]

    def analyze(self, queries):
        out = []
        for q in queries:
            parts = [re.sub(r"^(?:the|a|an|find|where is|which)\s+", "", p.strip(" ?.,")) for p in re.split(BETWEEN, q, flags=re.I)]
            parts = [p for p in parts if p]
            low = q.lower()
            far = any(w in low for w in FAR)
            near = not far and any(w in low for w in NEAR)
            out.append({"target_object": parts[0] if parts else q, "anchor_objects": parts[1:], "relation_polarity": "far" if far else "near" if near else "", "relation_degree": "superlative" if any(w in low for w in MOST) else "comparative" if far or near else "", "operator": "argmax" if far else "argmin" if near else "", "behavior": "", "status": "ok"})
        return out

    def select(self, queries, contexts, candidates):
        return [{"object_id": c[0] if c else None, "reason": "the best match by words", "confidence": 0.5 if c else 0.0, "rejected_ids": list(c[1:]), "guess_id": None} for c in candidates]

    def answer(self, queries, contexts, candidates):
        return [{"answer": (x.splitlines() or [""])[0], "reasoning": "the best match by words", "object_ids": list(c[:1])} for x, c in zip(contexts, candidates, strict=True)]
