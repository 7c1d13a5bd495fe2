"""Public tokenizer vocabularies, read on the driver and sent to the workers as bytes."""

from __future__ import annotations

import functools
import json
from pathlib import Path

import numpy as np

#: What a vocabulary file may hold; so much is sent to every worker.
LARGEST_FILE = 64 << 20


def read(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > LARGEST_FILE:
        raise ValueError(f"{path} has {len(data)} bytes; a vocabulary may have {LARGEST_FILE}")
    return data


@functools.cache
def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Byte-level BPE of a tokenizers file, word by word.

    Pairs merge by the rank of what they make, as in tiktoken. That equals the
    library's merges if the k-th merge makes id 256 + k and every entry of the
    vocabulary encodes to itself: then any two neighbours that make an entry
    are the pair of its own merge. Where a file doesn't hold to this, the
    library encodes the words itself.
    """

    def __init__(self, data: bytes):
        model = (top := json.loads(data))["model"]
        chars = _byte_chars()
        if top.get("normalizer") or model["type"] != "BPE" or any(c not in chars for k in model["vocab"] for c in k if k not in {a["content"] for a in top["added_tokens"]}):
            raise ValueError("not a byte-level BPE vocabulary")
        added = {a["content"].encode(): a["id"] for a in top["added_tokens"]}
        if len(added) > 1 or any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in top["added_tokens"]):
            raise ValueError("one added token without flags is supported")
        self.special, self.special_id = next(iter(added.items()), (b"", -1))
        self.ranks = {bytes(chars[c] for c in k): v for k, v in model["vocab"].items() if k.encode() not in added}
        import tiktoken

        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        merges = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        self.by_rank = all(model["vocab"][m] == 256 + k for k, m in enumerate(merges))
        self.library = None if self.by_rank else self._library(data)

    @staticmethod
    def _library(data: bytes):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(data.decode())

    def encode(self, words: list[bytes]) -> list[list[int]]:
        if self.library:
            return [x.ids for x in self.library.encode_batch([w.decode() for w in words], add_special_tokens=False)]
        one, special = self.core.encode_single_piece, self.special
        return [one(w) if w != special else [self.special_id] for w in words]

    def pieces(self) -> list[bytes]:
        """Bytes of each id, up to the largest."""
        out = [b""] * (max([*self.ranks.values(), self.special_id]) + 1)
        for piece, k in self.ranks.items():
            out[k] = piece
        if self.special:
            out[self.special_id] = self.special
        return out


class Pieces:
    """Counts of a sentencepiece BPE model, stretch by stretch.

    Merges never cross the border of two stretches if no piece has a space mark
    behind another character, or a line end beside one; that is checked.
    """

    MARK = "▁"

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(self.MARK in x.lstrip(self.MARK) or ("\n" in x and x != "\n") for x in names) or self.MARK not in names:
            raise ValueError("pieces of this model cross spaces or line ends")
        if self.model.encode("a  b", out_type=str)[0][0] != self.MARK or self.model.encode("\n", out_type=str)[0] != self.MARK:
            raise ValueError("this model adds no space before a text")

    def counts(self, stretches: list[bytes]) -> np.ndarray:
        texts, less = [], []
        for w in stretches:
            s = w.decode()
            if s[0] in (" ", self.MARK):
                texts.append(s[1:])
                less.append(0 if len(s) > 1 else -1)  # the library's own space comes before; alone, it gives none
            else:
                texts.append("\n" + s)
                less.append(2)
        return np.fromiter(map(len, self.model.encode(texts, num_threads=1)), np.int64, len(texts)) - np.array(less, np.int64)


@functools.lru_cache(4)
def byte_bpe(data: bytes) -> ByteBpe:
    return ByteBpe(data)


@functools.lru_cache(4)
def pieces(data: bytes) -> Pieces:
    return Pieces(data)
