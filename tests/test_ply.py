"""PLY scans of all three kinds against the arrays they were written from."""

import numpy as np
import pytest

from scenelake.sources import annotations, ply

rng = np.random.default_rng(2)
KIND = [("x", "f4"), ("y", "f4"), ("z", "f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("alpha", "u1")]
LONG = {"f4": "float", "u1": "uchar"}


def scan(n):
    v = np.zeros(n, KIND)
    for c, t in KIND:
        v[c] = rng.normal(size=n) if t == "f4" else rng.integers(0, 256, n)
    return v


def write(path, v, kind, before=0, end="\n"):
    props = "".join(f"property {LONG[t]} {c}\n" for c, t in KIND)
    extra = f"element camera {before}\nproperty float f\nproperty uchar g\n" if before else ""
    head = f"ply\nformat {kind} 1.0\ncomment a scan\n{extra}element vertex {len(v)}\n{props}element face 2\nproperty list uchar int vertex_indices\nend_header\n"
    if kind == "ascii":
        body = "".join(f"1.5 7{end}" for _ in range(before)) + "".join(" ".join(repr(float(r[c])) if t == "f4" else str(r[c]) for c, t in KIND) + end for r in v) + f"3 0 1 2{end}3 1 2 0"
        data = body.encode()
    else:
        order = "<" if "little" in kind else ">"
        data = b"".join(np.array([(1.5, 7)], [("f", order + "f4"), ("g", "u1")]).tobytes() for _ in range(before)) + v.astype([(c, order + t) for c, t in KIND]).tobytes() + b"\x03" * 26
    path.write_bytes(head.encode() + data)
    return str(path)


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 20), (1000, 300), (97, 64)])
def test_all_kinds_in_ranges(spark, tmp_path, sizes):
    scans = {}
    for k, kind in enumerate(["ascii", "binary_little_endian", "binary_big_endian", "ascii"]):
        v = scan(40 + k)
        scans[write(tmp_path / f"{k}.ply", v, kind, before=3 * (k % 2), end="\r\n" if k == 3 else "\n")] = v
    scans[write(tmp_path / "none.ply", scan(0), "ascii")] = scan(0)
    df = ply.vertices(spark, list(scans), *sizes)
    got = df.collect()
    assert len(got) == len({(r.path, r.vertex) for r in got}) == sum(map(len, scans.values()))
    for r in got:
        v = scans[r.path][r.vertex]
        assert (r.x, r.y, r.z, r.red, r.green, r.blue) == (float(v["x"]), float(v["y"]), float(v["z"]), v["red"], v["green"], v["blue"])
    if sizes[0] < 1000:
        assert df.rdd.getNumPartitions() > 50  # about 10 kB in ranges of 97 bytes


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_belong_to_the_range_they_begin_in(tmp_path, end):
    text = end.join(["a", "bb", "", "ccc" * 9, "d", "", "last"]).encode()
    path = tmp_path / "lines"
    path.write_bytes(b"head\n" + text)
    for each in range(1, 40):
        for chunk in (1, 2, 5, 64):
            rows = [{"path": str(path), "at": at, "each": each, "first_byte": 5, "n_bytes": 5 + len(text), "chunk": chunk} for at in range(5, 5 + len(text), each)]
            assert b"".join(x for r in rows for x in ply._lines(r)) == text


def test_mesh_is_chosen_by_counts_of_headers(spark, tmp_path):
    paths = [write(tmp_path / f"{n}.ply", scan(n), "binary_little_endian") for n in (5, 7)]
    assert annotations.mesh_matching(ply.candidates(spark, [*paths, paths[0]]), 7).first().path == paths[1]


def test_broken_files_are_named(spark, tmp_path):
    for kind in ("ascii", "binary_little_endian"):
        path = write(tmp_path / f"cut_{kind}.ply", scan(30), kind)
        data = open(path, "rb").read()
        open(path, "wb").write(data[: len(data) - (400 if kind != "ascii" else 900)])
        with pytest.raises(Exception, match=f"cut_{kind}.ply ends before"):
            ply.vertices(spark, [path]).collect()
    other = tmp_path / "other.ply"
    other.write_bytes(b"plyx\nend_header\n")
    with pytest.raises(Exception, match="other.ply is no PLY"):
        ply.headers(spark, [str(other)]).collect()
