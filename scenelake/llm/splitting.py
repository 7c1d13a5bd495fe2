"""Vectorised text splitting: whole blocks of documents as one UTF-8 buffer.

Every splitter returns the byte offsets at which tokens start. As the tokens
of a splitter that leaves no gaps tile the buffer, the offsets are at once the
offsets of an Arrow string array over it, so no token is ever copied.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: White space of the tokenizers' pattern (fixed values: Unicode White_Space).
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point under the byte-level pattern: white space, letter, number, other.

    The library asked is the tokenizers library itself, for the code points on
    which the Unicode versions of Python and of regex disagree.
    """
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    newer = np.full(0x110000, OTHER, np.uint8)
    chars = "".join("!" if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, chars):
            newer[m.start() : m.end()] = kind
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero(newer != table).tolist():
        spans = [x[1] for x in split(f"a{chr(c)}1!")]
        table[c] = LETTER if (0, 2) in spans else NUMBER if (1, 3) in spans else OTHER
    return table


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the n + 1 offsets of the texts in them."""
    texts = pa.array([], pa.large_string()) if len(texts) == 0 else texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return data, offsets - offsets[0]


def _multibyte(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes' positions, code points and lengths of the characters beyond ASCII."""
    pos = np.flatnonzero(buf >= 0xC0)
    first = buf[pos].astype(np.int32)
    more = 1 + (first >= 0xE0) + (first >= 0xF0)
    cp = first & np.array([0, 0x1F, 0x0F, 0x07], np.int32)[more]
    for k in (1, 2, 3):
        at = more >= k
        cp[at] = (cp[at] << 6) | (buf[pos[at] + k] & 0x3F)
    return pos, cp, more + 1


def byte_level_starts(buf: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> np.ndarray:
    """Starts of the pre-tokens of the byte-level BPE pattern in a buffer of documents.

    Bytes carry the class of their character, so that all steps run over bytes.
    special: an added token that the library takes out of a text before it splits the rest.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[:256].copy()
    cls[128:] = OTHER
    cls = cls[buf]
    pos, cp, size = _multibyte(buf)
    kind = _classes()[cp]
    for k in range(4):
        at = size > k
        cls[pos[at] + k] = kind[at]
    cuts = offsets[:-1][offsets[:-1] < n]
    inside = np.zeros(0, np.int64)
    if special and (found := _occurrences(buf, offsets, special)):
        a = np.array(found)
        inside = (a[:, None] + np.arange(1, len(special))).ravel()
        after = a + len(special)
        cuts = np.concatenate([cuts, a, after[after < n]])
    fresh = np.zeros(n + 3, bool)
    fresh[cuts] = True
    fresh[n] = True
    blank, space = cls == SPACE, buf == 32
    start = fresh[:n].copy()
    start[1:] |= (cls[1:] != cls[:-1]) & ~space[:-1]
    start[1:] |= blank[1:] & ~blank[:-1]
    last = blank.copy()  # the last of a run of white space, before something else
    last[:-1] &= ~blank[1:] & ~fresh[1:n]
    last[-1] = False
    wide = np.flatnonzero(last & ((buf & 0xC0) == 0x80))
    last[wide] = False
    while len(wide):  # to the first byte of a wide space
        wide = wide - 1
        done = (buf[wide] & 0xC0) != 0x80
        last[wide[done]] = True
        wide = wide[~done]
    start |= last
    quote = np.flatnonzero((buf == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~fresh[quote + 1]]
    short = quote[np.isin(buf[quote + 1], np.frombuffer(b"stmd", np.uint8))]
    two = quote[quote + 2 < n]
    two = two[~fresh[two + 2]]
    x, y = buf[two + 1], buf[two + 2]
    long = two[((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))]
    start[short + 1] = False
    start[long + 1] = False
    start[long + 2] = False
    ends = np.concatenate([short + 2, long + 3])
    start[ends[ends < n]] = True
    start[inside] = False
    return np.flatnonzero(start)


def _occurrences(buf: np.ndarray, offsets: np.ndarray, what: bytes) -> list[int]:
    """Where a string begins, from left to right without overlaps, none of them across documents."""
    data, at, found = buf.tobytes(), 0, []
    while (at := data.find(what, at)) >= 0:
        if offsets[np.searchsorted(offsets, at, "right")] >= at + len(what):
            found.append(at)
            at += len(what)
        else:
            at += 1
    return found


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of stretches across whose borders no vocabulary piece reaches: spaces and what follows them, and each line end alone."""
    if not len(buf):
        return np.zeros(0, np.int64)
    blank = buf == 32
    mark = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)) if len(buf) > 2 else np.zeros(0, np.int64)
    tail = blank.copy()  # the byte ends a space
    head = blank.copy()
    head[mark] = True
    tail[mark + 2] = True
    line = buf == 10
    start = head.copy()
    start[1:] &= ~tail[:-1]
    start |= line
    start[1:] |= line[:-1]
    start[offsets[:-1][offsets[:-1] < len(buf)]] = True
    return np.flatnonzero(start)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


@functools.cache
def _in_words(kind: str) -> np.ndarray:
    """kind: white (not of \\x20 \\x09-\\x0D) or alnum (letters, digits and all above ASCII)."""
    table = np.ones(256, bool)
    if kind == "white":
        table[[32, 9, 10, 11, 12, 13]] = False
    else:
        table[:128] = False
        table[48:58] = table[65:91] = table[97:123] = True
        table[0] = False
    return table


def words(buf: np.ndarray, offsets: np.ndarray, kind: str = "white") -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; no word crosses a document's end."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _in_words(kind)[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(buf)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = cut[cut > 0]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def views(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """The words as an Arrow array of bytes. Without ends, they tile the buffer."""
    if ends is None:
        bounds = np.append(starts, len(buf)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(buf)])
    edges = np.empty(2 * len(starts) + 1, np.int32)
    edges[:-1:2], edges[1::2], edges[-1] = starts, ends, ends[-1] if len(ends) else 0
    both = pa.Array.from_buffers(pa.binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(buf)])
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2)))
