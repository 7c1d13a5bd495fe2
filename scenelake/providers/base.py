"""What a provider of models offers. Lists in, lists out, so that each call is a batch."""

from __future__ import annotations

from collections.abc import Sequence


class Provider:
    """All methods may raise; callers give one row an error, never the job."""

    dimension = 0

    def embed_text(self, texts: Sequence[str]) -> list[list[float]]:
        raise NotImplementedError

    def embed_image(self, images: Sequence[bytes]) -> list[list[float]]:
        raise NotImplementedError

    def tag(self, images: Sequence[bytes]) -> list[list[str]]:
        raise NotImplementedError

    def describe(self, images: Sequence[bytes], labels: Sequence[Sequence[str]]) -> list[str]:
        """JSON of caption, room_type_guess, description, scene_layout, objects."""
        raise NotImplementedError

    def summarize(self, texts: Sequence[Sequence[str]]) -> list[str]:
        raise NotImplementedError

    def detect(self, images: Sequence[bytes], tags: Sequence[Sequence[str]]) -> list[list[dict]]:
        """Dictionaries of label, score, x1, y1, x2, y2."""
        raise NotImplementedError

    def analyze(self, queries: Sequence[str]) -> list[dict]:
        raise NotImplementedError

    def select(self, queries: Sequence[str], contexts: Sequence[str], candidates: Sequence[Sequence[str]]) -> list[dict]:
        """Dictionaries of object_id, reason, confidence, rejected_ids, guess_id."""
        raise NotImplementedError

    def answer(self, queries: Sequence[str], contexts: Sequence[str], candidates: Sequence[Sequence[str]]) -> list[dict]:
        """Dictionaries of answer, reasoning, object_ids."""
        raise NotImplementedError
