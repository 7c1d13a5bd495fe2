"""opN_ queries, called through the entry file on a small folder: every contract column against a plain version."""

import base64
import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, "/opt/tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with a null text, a repeated row and clashing columns; pages with repeated payloads, a null html and repeated rows."""
    rng = random.Random(8)
    words = ["stone", "river ", " over", "\n", "é中", "'s", "12", "<|endoftext|>", "  "]
    shared = "a passage of more than fifty bytes that stands in several documents"
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 80))) + (shared if i % 4 == 0 else "") for i in range(40)] + [None, "", "word " * 5000]
    at = Path(tmp_path_factory.mktemp("contract"))
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_tokens long").repartition(3).write.parquet(f"{at}/documents.parquet")
    pages = [(i, f"http://h{i % 3}.org/", rng.choice(["<p>a</p>", "<p>b é</p>", None, "", f"<p>{i}</p>"])) for i in range(60)]
    pages += [pages[7], pages[7], (59, None, pages[0][2])]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{at}/pages.parquet")
    return str(at), docs, pages


def result(spark, folder, name, columns):
    return [tuple(r) for r in entry.queries()[name](spark, folder[0]).select(*columns).collect()]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op2(spark, folder, encode):
    got = result(spark, folder, "op2_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    want = []
    for i, t, *_ in folder[1]:
        ids = encode.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(encode.decode(ids, skip_special_tokens=False).encode())))
    assert Counter(got) == Counter(want)


def test_op3(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = result(spark, folder, "op3_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in folder[1]]
    assert Counter(got) == Counter(want) and any(w[3] for w in want)


def test_op4(spark, folder, encode):
    got = result(spark, folder, "op4_token_files", ["doc_id", "start", "n_tokens", "ids_crc32"])
    want, start = [], 0
    for i, t, *_ in sorted(folder[1], key=lambda r: r[0]):
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got) == want


def test_op5(spark, folder):
    got = result(spark, folder, "op5_repeats", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    first = {}
    data = [(i, (t or "").encode()) for i, t, *_ in folder[1]]
    for i, b in data:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    want = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)  # noqa: B905
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept)))
    assert Counter(got) == Counter(want) and any(w[2] for w in want)


def test_op10(spark, folder):
    got = result(spark, folder, "op10_warc", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    least, seen, want = {}, set(), []
    for i, _, h in folder[2]:
        least[h or ""] = min(least.get(h or "", i), i)
    for i, _, h in folder[2]:
        body, at = (h or "").encode(), least[h or ""]
        response = i == at and (h or "") not in seen
        seen |= {h or ""} if response else set()
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else at))
    assert Counter(got) == Counter(want)


def test_op6(spark, folder):
    """All but the model's own score, which is checked against a plain model elsewhere."""
    import math
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    end = object()
    tokens = [(i, zlib.crc32(str(i).encode()) % 7 == 2, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), end]) for i, t, *_ in folder[1]]
    c = Counter(w for _, held, ws in tokens if not held for w in ws)
    n, v = sum(c.values()), len(c)
    got = sorted(result(spark, folder, "op6_language_model", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
    want = sorted((i, held, len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws)) for i, held, ws in tokens)
    assert [g[:5] for g in got] == [w[:5] for w in want] and any(w[1] for w in want)
    assert all(g[5] == pytest.approx(w[5], rel=1e-9) and g[6] <= 0 and math.isfinite(g[6]) for g, w in zip(got, want, strict=True))


def test_op9(spark, folder):
    import re

    sets = []
    for i, t, *_ in folder[1]:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append((i, {tuple(w[k : k + 2]) for k in range(max(len(w) - 1, 1))} if w else set()))
    label = {i: i for i, _ in sets}
    for _ in sets:  # the smallest id reaches all in as many rounds as there are rows at most
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = result(spark, folder, "op9_near_duplicates", ["doc_id", "n_shingles", "component_id", "kept"])
    assert Counter(got) == Counter((i, len(s), label[i], label[i] == i) for i, s in sets)
