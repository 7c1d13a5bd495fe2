"""The data source of posed frames against the reader of files, and JPEG images against an encoder of our own."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.config import Config
from scenelake.plans.build import Build
from scenelake.sources import datasets, images, jpeg, posed

# --- JPEG: an encoder with flat code tables, so that every symbol has 8 bits ----------------------------------------


def dct():
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    c = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


def zigzag():
    r = c = 0
    up = True
    for _ in range(64):
        yield 8 * r + c
        if up:
            if c == 7:
                r, up = r + 1, False
            elif r == 0:
                c, up = c + 1, False
            else:
                r, c = r - 1, c + 1
        elif r == 7:
            c, up = c + 1, True
        elif c == 0:
            r, up = r + 1, True
        else:
            r, c = r + 1, c - 1


def bits_of(v):
    """Size class and bits of a coefficient."""
    s = abs(int(v)).bit_length()
    return s, (f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else "")


def encode(planes, factors, size, quant=1, every=0, extra=b""):
    """Baseline JPEG of planes (already subsampled) with sampling factors."""
    h, w = size
    top_h, top_v = max(f[0] for f in factors), max(f[1] for f in factors)
    wide, tall = -(-w // (8 * top_h)), -(-h // (8 * top_v))
    if len(planes) == 1:
        factors, wide, tall = [(1, 1)], -(-w // 8), -(-h // 8)
    c, order, coded = dct(), list(zigzag()), []
    for p, (fh, fv) in zip(planes, factors, strict=True):
        p = np.pad(p.astype(float), ((0, tall * fv * 8 - p.shape[0]), (0, wide * fh * 8 - p.shape[1])), "edge") - 128
        blocks = p.reshape(tall * fv, 8, wide * fh, 8).transpose(0, 2, 1, 3)
        coded.append(np.rint(c @ blocks @ c.T / quant).astype(int).reshape(tall * fv, wide * fh, 64)[:, :, order])
    ac = sorted({(r << 4) | s for r in range(16) for s in range(1, 11)} | {0x00, 0xF0})
    code = {s: f"{k:08b}" for k, s in enumerate(ac)}
    stretches, out, before = [], [], [0] * len(planes)
    for n in range(wide * tall):
        if every and n and n % every == 0:
            stretches.append("".join(out))
            out, before = [], [0] * len(planes)
        my, mx = divmod(n, wide)
        for k, (fh, fv) in enumerate(factors):
            for v in range(fv):
                for u in range(fh):
                    b = coded[k][my * fv + v, mx * fh + u]
                    s, tail = bits_of(b[0] - before[k])
                    before[k] = b[0]
                    out.append(f"{s:04b}{tail}")
                    run, last = 0, max(np.flatnonzero(b[1:]), default=-1) + 1
                    for x in b[1 : last + 1]:
                        if x == 0:
                            run += 1
                            continue
                        out += [code[0xF0]] * (run // 16)
                        s, tail = bits_of(x)
                        out.append(code[(run % 16) << 4 | s] + tail)
                        run = 0
                    if last < 63:
                        out.append(code[0])
    stretches.append("".join(out))
    body = b""
    for k, x in enumerate(stretches):
        x += "1" * (-len(x) % 8)
        raw = int("1" + x, 2).to_bytes(len(x) // 8 + 1, "big")[1:] if x else b""
        body += (b"" if not k else bytes([0xFF, 0xD0 + (k - 1) % 8])) + raw.replace(b"\xff", b"\xff\x00")
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    dc_table, ac_table = bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12)), bytes([*[0] * 7, len(ac), *[0] * 8]) + bytes(ac)
    frame = struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([k + 1, f[0] << 4 | f[1], 0]) for k, f in enumerate(factors))
    scan = bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + b"\0\x3f\0"
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + extra + seg(0xDB, b"\0" + bytes([quant] * 64)) + seg(0xC0, frame) + seg(0xC4, b"\x00" + dc_table) + seg(0xC4, b"\x10" + ac_table)
    return head + (seg(0xDD, struct.pack(">H", every)) if every else b"") + seg(0xDA, scan) + body + b"\xff\xd9"


def smooth(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([128 + 100 * np.sin(x / 9), 40 + 150 * y / max(h, 2), 200 - 120 * x / max(w, 2)], -1).round()


def ycc(rgb):
    r, g, b = np.moveaxis(rgb, -1, 0)
    return 0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168735892 * r - 0.331264108 * g + 0.5 * b, 128 + 0.5 * r - 0.418687589 * g - 0.081312411 * b


def halved(p, fh, fv):
    h, w = p.shape
    p = np.pad(p, ((0, -h % fv), (0, -w % fh)), "edge")
    return p.reshape(p.shape[0] // fv, fv, p.shape[1] // fh, fh).mean((1, 3))


@pytest.mark.parametrize(("size", "every"), [((8, 8), 0), ((1, 1), 0), ((17, 23), 0), ((40, 31), 2), ((64, 100), 3)])
def test_grey_and_full_colour_within_a_level(size, every):
    rgb = smooth(*size)
    grey = images.decode(encode([rgb[..., 0]], [(1, 1)], size, every=every))
    assert grey.shape == size and grey.dtype == np.uint8 and np.abs(grey - rgb[..., 0]).max() <= 1
    noise = np.random.default_rng(2).integers(0, 255, size)
    assert np.abs(images.decode(encode([noise], [(2, 2)], size)).astype(int) - noise).max() <= 1
    got = images.decode(encode(ycc(rgb), [(1, 1)] * 3, size, every=every)).astype(int)
    assert got.shape == (*size, 3) and np.abs(got - rgb).max() <= 2  # rounding of three planes


@pytest.mark.parametrize("factors", [(2, 1), (2, 2), (1, 2), (4, 1)])
@pytest.mark.parametrize("size", [(48, 64), (33, 47)])
def test_subsampled_colour(size, factors):
    rgb = smooth(*size)
    y, cb, cr = ycc(rgb)
    data = encode([y, halved(cb, *factors), halved(cr, *factors)], [factors, (1, 1), (1, 1)], size)
    got = images.decode(data).astype(int)
    inner = np.abs(got - rgb)[4:-4, 4:-4]
    assert got.shape == (*size, 3) and (inner.max() <= 4 and inner.mean() < 2 if max(factors) == 2 else inner.max() <= 60 and inner.mean() < 8)  # fourfold samples are repeated


def test_flat_colours_are_exact():
    for colour in ((255, 0, 0), (0, 255, 0), (10, 20, 30), (255, 255, 255)):
        rgb = np.broadcast_to(np.array(colour, float), (20, 20, 3))
        y, cb, cr = ycc(rgb)
        got = images.decode(encode([y, halved(cb, 2, 2), halved(cr, 2, 2)], [(2, 2), (1, 1), (1, 1)], (20, 20)))
        assert np.abs(got.astype(int) - rgb).max() <= 2


def test_other_jpegs_are_refused_by_name():
    data = encode([smooth(24, 24)[..., 0]], [(1, 1)], (24, 24), every=2)
    for n in range(3, len(data) - 2, 7):
        with pytest.raises(jpeg.BrokenImage):
            images.decode(data[:n])
    with pytest.raises(ValueError, match="only baseline"):
        images.decode(data.replace(b"\xff\xc0", b"\xff\xc2", 1))
    with pytest.raises(ValueError, match="no PNG"):
        images.decode(b"\xff\xd9")


# --- posed frames -------------------------------------------------------------------------------------------------


def matrix(k):
    m = np.eye(4)
    m[:3, 3] = k / 10, 1, -k
    return m


def scene(root, kind, n=23):
    """A scene of n frames; names don't sort as numbers."""
    folders = {"scannet": ("color", "depth", "pose", "intrinsic"), "hm3d": ("rgb", "depth", "pose"), "replica": ("results",)}[kind]
    for d in folders:
        (root / d).mkdir(parents=True)
    for k in range(n):
        rgb, depth = images.write_png(np.full((2, 3, 3), k, np.uint8)), images.write_png(np.full((2, 3), 1000 + k, np.uint16))
        m = matrix(k)
        if kind == "replica":
            (root / "results" / f"frame{k}.png").write_bytes(rgb)
            (root / "results" / f"depth{k}.png").write_bytes(depth)
            continue
        (root / folders[0] / f"{k}.png").write_bytes(rgb)
        (root / "depth" / f"{k}.png").write_bytes(depth)
        (root / "pose" / f"{k}.txt").write_text(("\n" if kind == "scannet" else " ").join(" ".join(map(str, r)) for r in m))
    if kind == "scannet":
        (root / "intrinsic" / "intrinsic_depth.txt").write_text("8 0 4 0\n0 8 3 0\n0 0 1 0\n0 0 0 1")
    if kind == "replica":
        (root / "traj.txt").write_text("\n".join(" ".join(map(str, matrix(k).ravel())) for k in range(n - 2)) + "\n\n")
        (root.parent / "cam_params.json").write_text('{"camera": {"fx": 8, "fy": 7, "cx": 4, "cy": 3, "scale": 6553.5}}')
    return f"file://{root}"


def rows(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def posed_spark(spark):
    return posed.register(spark)


@pytest.mark.parametrize("kind", ["scannet", "hm3d", "replica"])
def test_same_rows_as_the_reader_of_files(posed_spark, tmp_path, kind):
    root = scene(tmp_path / "s", kind)
    want = datasets.frames(posed_spark, kind, root)
    got = posed_spark.read.format("posed_frames").option("kind", kind).option("framesPerPartition", 5).load(root)
    assert got.columns == want.columns and got.rdd.getNumPartitions() == 5
    assert rows(got) == rows(want)
    every = posed_spark.read.format("posed_frames").option("kind", kind).option("every", 4).load(root)
    assert rows(every) == [r for r in rows(want) if r[0] % 4 == 0]


def test_conditions_on_a_loaded_scene(posed_spark, tmp_path):
    root = scene(tmp_path / "s", "scannet")
    df = posed_spark.read.format("posed_frames").option("kind", "scannet").option("framesPerPartition", 2).load(root)
    for condition, want in (("frame_index >= 3 and frame_index < 7", [3, 4, 5, 6]), ("frame_index in (2, 9, 99)", [2, 9]), ("frame_index > 20 or frame_index = 1", [1, 21, 22]), ("frame_index < 0", [])):
        assert [r.frame_index for r in df.filter(condition).select("frame_index").orderBy("frame_index").collect()] == want, condition


@pytest.mark.parametrize(("options", "want"), [({"every": "5", "first": "4", "last": "20"}, [5, 10, 15, 20]), ({"first": "21"}, [21, 22]), ({"LAST": "1"}, [0, 1]), ({"first": "99"}, [])])
def test_only_chosen_files_are_opened(tmp_path, options, want):
    root = scene(tmp_path / "s", "hm3d")
    reader = posed.PosedFramesReader({"path": root, "kind": "hm3d", "framesPerPartition": "3"} | options)
    parts = reader.partitions()
    assert [f[0] for p in parts for f in p.frames] == want and len(parts) == max(1, -(-len(want) // 3))
    for d in ("rgb", "depth", "pose"):
        for name in os.listdir(tmp_path / "s" / d):
            if int(name.split(".")[0]) not in want:
                (tmp_path / "s" / d / name).unlink()
    assert [b.column("frame_index")[0].as_py() for p in parts for b in reader.read(p)] == want


def test_broken_scenes_are_named(posed_spark, tmp_path):
    root = scene(tmp_path / "s", "scannet", 4)
    read = lambda **o: posed_spark.read.format("posed_frames").options(**o).load(root)
    (tmp_path / "s" / "pose" / "2.txt").write_text("1 2 3")
    with pytest.raises(Exception, match="a pose has 3 numbers"):
        read(kind="scannet").collect()
    assert read(kind="scannet", last=1).count() == 2
    (tmp_path / "s" / "pose" / "3.txt").unlink()
    with pytest.raises(Exception, match="differ in number"):
        read(kind="scannet").collect()
    with pytest.raises(Exception, match="no scene kind"):
        read(kind="kitti").collect()


def test_build_of_jpeg_colours(posed_spark, tmp_path):
    root = scene(tmp_path / "s", "scannet", 4)
    for k in range(4):
        (tmp_path / "s" / "color" / f"{k}.png").unlink()
        rgb = np.broadcast_to(np.array([200.0, 100, 50]), (2, 3, 3))
        (tmp_path / "s" / "color" / f"{k}.jpg").write_bytes(encode(ycc(rgb), [(1, 1)] * 3, (2, 3)))
    got = datasets.pixels(datasets.frames(posed_spark, "scannet", root)).select("r", "g", "b").distinct().collect()
    assert all(abs(r.r - 200) <= 2 and abs(r.g - 100) <= 2 and abs(r.b - 50) <= 2 for r in got) and got
    config = Config.of("dataset=scannet", f"root={root}", f"output=file://{tmp_path}/out", "mode=single", "fuse_every=1", "max_depth=4")
    assert Build(posed_spark, config).graph().keyframes.select(F.count("*")).first()[0] > 0
