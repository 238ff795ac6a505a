"""Clouds read by ranges and written in parts."""

import glob
import random
import struct

import numpy as np
import pytest

from plumbline.sources import clouds, scans

FIELDS = [("x", "<f8"), ("y", "<f4"), ("z", "<f8"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("nx", "<f4"), ("ny", "<f4"), ("nz", "<f4")]
PLY = {"<f8": "double", "<f4": "float", "u1": "uchar"}


def table(n, seed):
    rng = np.random.default_rng(seed)
    t = np.empty(n, np.dtype(FIELDS))
    for name, kind in FIELDS:
        t[name] = rng.integers(0, 256, n) if kind == "u1" else np.round(rng.normal(0, 10, n), 3)
    return t


def ply(t, form):
    head = f"ply\nformat {form} 1.0\ncomment made by hand\nelement vertex {len(t)}\n" + "".join(f"property {PLY[k]} {n}\n" for n, k in FIELDS) + "element face 2\nproperty list uchar int vertex_index\nend_header\n"
    if form == "ascii":
        return (head + "".join(" ".join(repr(float(v)) if k != "u1" else str(v) for v, (_, k) in zip(r.tolist(), FIELDS, strict=True)) + "\n" for r in t) + "3 0 1 2\n3 1 2 3\n").encode()
    big = form.endswith("big_endian")
    return head.encode() + t.astype(t.dtype.newbyteorder(">") if big else t.dtype).tobytes() + b"\x03" + struct.pack("<iii", 0, 1, 2)


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("point_id", *clouds.VALUES).collect())


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
@pytest.mark.parametrize("size", [100, 4096, 1 << 26])
def test_ply_by_ranges(spark, tmp_path, form, size):
    t = table(500, 1)
    (tmp_path / "a.ply").write_bytes(ply(t, form))
    want = scans.decode_ply(ply(t, form))
    got = clouds.read_cloud(spark, str(tmp_path), size)
    assert got.columns == [c.split()[0] for c in scans.CLOUD.split(", ")]
    assert rows(got) == [(i, *(round(v, 9) for v in r)) for i, r in enumerate(want[list(clouds.VALUES)].itertuples(index=False))]
    assert len(clouds.ranges(str(tmp_path), size)) >= (1 if size > 1 << 20 else len(ply(t, form)) // max(size, 60) // 2)


def lzf(data):
    """A plain compressor: repeats of three bytes and more become references."""
    out, literal, i, seen = bytearray(), bytearray(), 0, {}

    def flush():
        for a in range(0, len(literal), 32):
            part = literal[a : a + 32]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < len(data):
        at = seen.get(data[i : i + 3])
        seen[data[i : i + 3]] = i
        n = 0
        if at is not None and i - at <= 8192:
            while i + n < len(data) and n < 264 and data[at + n] == data[i + n]:
                n += 1
        if n >= 3:
            flush()
            off, size = i - at - 1, n - 2
            out.extend([(min(size, 7) << 5) | off >> 8, *([size - 7] if size >= 7 else []), off & 255])
            i += n
        else:
            literal.append(data[i])
            i += 1
    flush()
    return bytes(out)


def pcd(t, data):
    names = ["x", "y", "z", "rgb", "normal_x", "normal_y", "normal_z", "extra"]
    bits = (t["red"].astype("u4") << 16 | t["green"].astype("u4") << 8 | t["blue"]).astype("<u4")
    parts = [*(t[c].astype("<f4") for c in "xyz"), bits.view("<f4"), *(t[c] for c in ("nx", "ny", "nz")), np.arange(len(t) * 2, dtype="<i2").reshape(-1, 2)]
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(names)}\nSIZE 4 4 4 4 4 4 4 2\nTYPE F F F F F F F I\nCOUNT 1 1 1 1 1 1 1 2\nWIDTH {len(t)}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {len(t)}\nDATA {data}\n".encode()
    if data == "ascii":
        return head + "".join(" ".join([*(repr(float(p[i])) for p in parts[:7]), *map(str, parts[7][i])]) + "\n" for i in range(len(t))).encode()
    if data == "binary":
        whole = np.empty(len(t), [(n, "<f4") for n in names[:7]] + [("extra", "<i2", 2)])
        for n, p in zip(names, parts, strict=True):
            whole[n] = p
        return head + whole.tobytes()
    flat = b"".join([*(p.tobytes() for p in parts[:7]), parts[7][:, 0].tobytes(), parts[7][:, 1].tobytes()])
    packed = lzf(flat)
    return head + struct.pack("<II", len(packed), len(flat)) + packed


def test_pcd_encodings_agree(spark, tmp_path):
    t = table(300, 2)
    t["x"][:100] = 1.5  # runs to refer to
    found = []
    for data in ("ascii", "binary", "binary_compressed"):
        (tmp_path / data).mkdir()
        (tmp_path / data / "c.PCD").write_bytes(pcd(t, data))
        found.append(rows(clouds.read_cloud(spark, str(tmp_path / data), 1000)))
    assert len(found[0]) == 300 and found[0] == found[1] == found[2]
    assert [r[4:7] for r in found[0]] == [tuple(round(v / 255, 9) for v in (a, b, c)) for a, b, c in zip(t["red"], t["green"], t["blue"], strict=True)]
    assert np.allclose([r[1] for r in found[0]], t["x"].astype("f4")) and np.allclose([r[9] for r in found[0]], t["nz"])


def test_lzf():
    rng = random.Random(3)
    for text in (b"", b"a", b"abcabcabcabc" * 50, bytes(1000), bytes(rng.randrange(4) for _ in range(3000)), bytes(rng.randrange(256) for _ in range(500))):
        assert clouds.lzf_decompress(lzf(text), len(text)) == text
    with pytest.raises(ValueError, match="holds"):
        clouds.lzf_decompress(b"\x00a", 2)
    with pytest.raises(ValueError, match="before"):
        clouds.lzf_decompress(b"\x20\x05", 3)


def test_written_cloud_reads_back(spark, tmp_path):
    df = spark.range(2000).selectExpr("id / 7 as x", "id * 2.0 as y", "-id / 3 as z", "(id % 256) / 255 as r", "0.2 as g", "cast(null as double) as b").repartition(5)
    where = str(tmp_path / "cloud")
    clouds.write_cloud(df, where)
    back = clouds.read_cloud(spark, where, 5000)
    key = lambda r: (r.x, r.y, r.z, round(r.r * 255), round(r.g * 255))
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    assert sorted(r.point_id for r in back.collect()) == list(range(2000))
    assert {round(r.b, 1) for r in back.collect()} == {0.7}
    head = (tmp_path / "cloud" / "header.ply").read_bytes()
    names = [p[0] for p in clouds.ply_header(head).parts]
    joined = scans.decode_ply(head + b"".join((tmp_path / "cloud" / n).read_bytes() for n in names))
    assert len(joined) == 2000 and sorted(joined["x"]) == sorted(r.x for r in df.collect())
    (tmp_path / "cloud" / "part-99999-left.bin").write_bytes(b"left by a task that was lost")
    assert clouds.read_cloud(spark, where).count() == 2000
    clouds.write_cloud(df.limit(10), where, overwrite=True)
    assert clouds.read_cloud(spark, where).count() == 10
    assert len(glob.glob(where + "/part-*")) == len(clouds.ply_header((tmp_path / "cloud" / "header.ply").read_bytes()).parts)


def test_empty_and_broken(spark, tmp_path):
    (tmp_path / "e.ply").write_bytes(ply(table(0, 1), "binary_little_endian"))
    (tmp_path / "t.ply").write_bytes(ply(table(0, 1), "ascii"))
    assert clouds.read_cloud(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.ply").write_bytes(ply(table(9, 1), "binary_little_endian")[:-200])
    with pytest.raises(Exception, match="ends before"):
        clouds.read_cloud(spark, str(tmp_path)).count()
