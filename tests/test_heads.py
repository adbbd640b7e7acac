"""Heads of generated files: what is read of them, what they say, and files that are broken, empty or far too large to read."""

import os
import struct

import pytest

from quarrylight.sources import files, heads


def box(kind, *inner):
    data = b"".join(inner)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def moov(width=320, height=240, scale=600, length=4500, long=False):
    times = struct.pack(">BxxxQQIQ", 1, 0, 0, scale, length) if long else struct.pack(">BxxxIIII", 0, 0, 0, scale, length)
    head = box(b"mvhd", times, b"\0" * 80)
    sound = box(b"trak", box(b"tkhd", b"\0" * 84), box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", b"\0" * 8, struct.pack(">I4s", 16, b"mp4a"), b"\0" * 8)))))
    picture = box(b"trak", box(b"tkhd", b"\0" * 76, struct.pack(">II", width << 16, height << 16)), box(b"mdia", box(b"hdlr", b"\0" * 9), box(b"minf", box(b"stbl", box(b"stsd", b"\0" * 8, struct.pack(">I4s", 16, b"avc1"), b"\0" * 8)))))
    return box(b"moov", head, sound, picture)


def ebml(kind, data):
    return bytes.fromhex(kind) + struct.pack(">Q", (1 << 56) | len(data)) + data


MKV = ebml("1A45DFA3", b"\x42\x86\x81\x01") + ebml("18538067", ebml("1549A966", ebml("2AD7B1", b"\x0f\x42\x40") + ebml("4489", struct.pack(">d", 2500.0))) + ebml("1654AE6B", ebml("AE", ebml("86", b"V_VP9") + ebml("E0", ebml("B0", b"\x05\x00") + ebml("BA", b"\x02\xd0")))))
AVI = b"RIFF\0\0\0\0AVI LIST\0\0\0\0hdrlavih" + struct.pack("<IIIIIIIIII", 56, 40_000, 0, 0, 0, 250, 0, 1, 0, 640) + struct.pack("<I", 360) + b"\0" * 16
CASES = {
    "a.png": (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 2, 0, 0, 0) + b"crcc" + struct.pack(">I4sII", 8, b"acTL", 7, 0), {"kind": "png", "width": 640, "height": 480, "frames": 7, "animated": True}),
    "b.GIF": (b"GIF89a" + struct.pack("<HH", 320, 200) + b"\0" * 20, {"kind": "gif", "width": 320, "height": 200}),
    "c.jpg": (b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 600, 800) + b"\0" * 20, {"kind": "jpeg", "width": 800, "height": 600}),
    "d.webp": (b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<IB3x", 10, 2) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), {"kind": "webp", "width": 100, "height": 50, "animated": True}),
    "e.webp": (b"RIFF\0\0\0\0WEBPVP8L" + struct.pack("<IBI", 9, 0x2F, 63 | 31 << 14) + b"\0" * 9, {"kind": "webp", "width": 64, "height": 32, "animated": False}),
    "f.bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -20) + b"\0" * 20, {"kind": "bmp", "width": 30, "height": 20}),
    "g.avi": (AVI, {"kind": "avi", "width": 640, "height": 360, "frames": 250, "duration_s": 10.0}),
    "h.mkv": (MKV, {"kind": "matroska", "width": 1280, "height": 720, "duration_s": 2.5, "codec": "V_VP9"}),
    "i.mp4": (box(b"ftyp", b"isom") + box(b"mdat", b"\0" * 50_000) + moov(), {"kind": "mp4", "width": 320, "height": 240, "duration_s": 7.5, "codec": "avc1"}),
    "j.MOV": (box(b"ftyp", b"qt  ") + moov(long=True), {"kind": "mp4", "width": 320, "height": 240, "duration_s": 7.5, "codec": "avc1"}),
    "k.mp4": (box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", 16 + 9000) + b"\0" * 9000 + moov(), {"kind": "mp4", "width": 320, "height": 240, "duration_s": 7.5, "codec": "avc1"}),
    "l.txt": (b"plain text", {}),
}


@pytest.fixture()
def folder(tmp_path):
    for name, (data, _) in CASES.items():
        at = tmp_path / ("in" if name < "e" else "in/deep") / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    return tmp_path


def probes(df):
    return {r["name"]: r for r in heads.probed(df).collect()}


def test_what_heads_say(spark, folder):
    found = probes(heads.heads(spark, str(folder), n=256))
    assert set(found) == set(CASES)
    for name, (data, expected) in CASES.items():
        got = {k: v for k, v in found[name]["probe"].asDict().items() if v is not None and k not in ("pixels", "duration_ms", "bitrate")}
        assert got == {k: v for k, v in expected.items() if v is not None}, name
        assert found[name]["size"] == len(data)
        assert found[name]["probe"]["pixels"] == expected.get("width", 0) * expected.get("height", 0)
    assert found["i.mp4"]["probe"]["duration_ms"] == 7500 and found["i.mp4"]["probe"]["bitrate"] == 8 * len(CASES["i.mp4"][0]) * 10 // 75


def test_cut_short_at_every_place():
    for data, _ in CASES.values():
        for k in range(0, min(len(data), 400)):
            heads.said(data[:k], data[:k])
            heads.said(data, data[:k])


def test_bytes_read(spark, tmp_path):
    """Files of 4 GB that hold nothing but holes: of each no more than its head, and of a film its boxes' starts and its index."""
    large = 4 << 30
    (tmp_path / "x").mkdir()
    for name, start, end in (("a.gif", CASES["b.GIF"][0], b""), ("b.mp4", box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", large), moov())):
        with open(tmp_path / "x" / name, "wb") as f:
            f.write(start)
            at = len(box(b"ftyp", b"isom")) + large if end else large
            f.seek(at)
            f.write(end)
            f.truncate(at + len(end))
    found = probes(heads.heads(spark, str(tmp_path), n=100))
    assert found["a.gif"]["n_read"] == 100 and found["a.gif"]["size"] == large and found["a.gif"]["probe"]["width"] == 320
    assert found["b.mp4"]["n_read"] <= 100 + 16 + len(moov()) and found["b.mp4"]["probe"]["duration_s"] == 7.5


def test_listings_and_animated(spark, folder):
    (folder / "Duplicate").mkdir()
    for name in ("Duplicate/z.gif", ".hidden.gif", "_part.gif"):
        (folder / name).write_bytes(CASES["b.GIF"][0])
    (folder / "empty.gif").write_bytes(b"")
    found = heads.heads(spark, f"file://{folder}", files.LISTINGS["animated"], files=2)
    assert sorted(r["path"] for r in found.collect()) == ["empty.gif", "in/b.GIF", "in/d.webp", "in/deep/e.webp"]
    assert sorted(r["name"] for r in heads.animated(found).collect()) == ["b.GIF", "d.webp", "empty.gif"]
    assert [r["name"] for r in heads.heads(spark, str(folder), files.Listing((".gif",)), recursive=False).collect()] == ["empty.gif"]
    (folder / "nothing").mkdir()
    assert heads.heads(spark, str(folder / "nothing")).count() == 0


def test_unreadable(spark, folder):
    os.chmod(folder / "in/b.GIF", 0)
    found = {r["name"]: r["head"] for r in heads.heads(spark, str(folder)).collect()}
    assert found["b.GIF"] is None or os.geteuid() == 0  # nothing is closed to root
    os.remove(folder / "in/a.png")
    os.symlink(folder / "gone", folder / "in/a.png")
    assert probes(heads.heads(spark, str(folder)))


def test_files_written(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.bin", bytes([i]) * i) for i in range(20)] + [("none", None)], "path string, content binary")
    for _ in range(2):  # a second run replaces the first's files
        heads.write_files(rows, f"file://{tmp_path}/out")
    found = {r["path"]: bytes(r["head"]) for r in heads.heads(spark, f"{tmp_path}/out").collect()}
    assert found == {**{f"d{i % 3}/f{i}.bin": bytes([i]) * i for i in range(20)}, "none": b""}
    assert not [x for _, _, names in os.walk(tmp_path) for x in names if x.startswith(".") and not x.endswith(".crc")]
