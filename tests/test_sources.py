"""Readers of stores, profiles, logs and sessions on bytes and texts made here."""

import json
import struct

import pytest

from momentis.sources import leveldb, logs, profiles, tables


def varint(n):
    out = b""
    while n >= 0x80:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def batch(sequence, writes):
    body = b"".join(bytes([v is not None]) + varint(len(k)) + k + (varint(len(v)) + v if v is not None else b"") for k, v in writes)
    return struct.pack("<QI", sequence, len(writes)) + body


def log(records):
    out = b""
    for r in records:
        first = True
        while True:
            left = leveldb.BLOCK - len(out) % leveldb.BLOCK
            if left < 7:
                out += b"\0" * left
                continue
            part, r = r[: left - 7], r[left - 7 :]
            kind = 1 if first and not r else 2 if first else 4 if not r else 3
            out += struct.pack("<IHB", 0, len(part), kind) + part
            first = False
            if not r:
                break
    return out


def block(entries):
    out, last = b"", b""
    for k, v in entries:
        shared = next((i for i in range(min(len(k), len(last))) if k[i] != last[i]), min(len(k), len(last)))
        out += varint(shared) + varint(len(k) - shared) + varint(len(v)) + k[shared:] + v
        last = k
    return out + struct.pack("<II", 0, 1)


def snapped(data):
    return varint(len(data)) + b"".join(bytes([(len(p) - 1) << 2]) + p for p in (data[k : k + 60] for k in range(0, len(data), 60)))


def table(rows, compressed):
    body = block([(k + struct.pack("<Q", s << 8 | (v is not None)), v or b"") for k, s, v in rows])
    data = snapped(body) if compressed else body
    index = block([(b"\xff", varint(0) + varint(len(data)))])
    at = len(data) + 5
    footer = varint(0) + varint(0) + varint(at) + varint(len(index))
    return data + bytes([compressed]) + b"\0" * 4 + index + b"\0" * 5 + footer.ljust(40, b"\0") + struct.pack("<Q", leveldb.MAGIC)


def test_store_keeps_the_last_write(spark, tmp_path):
    long = b"x" * 70_000
    (tmp_path / "000003.log").write_bytes(log([batch(10, [(b"a", b"new"), (b"b", None)]), batch(12, [(b"long", long)])]) + b"\1\2\3")
    (tmp_path / "000001.ldb").write_bytes(table([(b"a", 1, b"old"), (b"b", 2, b"gone"), (b"key-c", 3, b"kept"), (b"key-d", 4, None)], True))
    (tmp_path / "000002.sst").write_bytes(table([(b"key-d", 2, b"older"), (b"key-e", 5, b"plain")], False))
    (tmp_path / "MANIFEST-000001").write_bytes(b"no store file")
    got = {bytes(r.key): bytes(r.value) for r in leveldb.read_store(spark, str(tmp_path)).collect()}
    assert got == {b"a": b"new", b"long": long, b"key-c": b"kept", b"key-e": b"plain"}


def test_snappy_copies():
    assert leveldb.unsnapped(varint(11) + bytes([4 << 2]) + b"abcab"[:5] + bytes([(6 - 4) << 2 | 1, 3])) == b"abcababcabc"[:5] + b"cabcab"
    with pytest.raises(ValueError, match="before the start"):
        leveldb.unsnapped(varint(4) + bytes([1, 9]))


def text(x):
    return b'"' + varint(len(x)) + x.encode("latin-1")


def test_serialised_values():
    event = b"o" + text("kind") + text("kill") + text("t") + b"N" + struct.pack("<d", 12.5) + b"{" + varint(2)
    data = b"\xff\x0f" + b"o" + text("medias") + b"A" + varint(2) + event + b"^" + varint(2) + b"$" + varint(0) + varint(2)
    data += text("n") + b"I" + varint(7) + text("ok") + b"T" + b"\0" + b"c" + varint(4) + "né".encode("utf-16-le") + b"_" + b"{" + varint(4)
    value = leveldb.Serialised(data).value()
    assert value == {"medias": [{"kind": "kill", "t": 12.5}] * 2, "n": -4, "ok": True, "né": None}
    assert [x["n"] for x in leveldb.holding([{"x": value}], "medias")] == [-4]
    assert leveldb.Serialised(b"a" + varint(3) + b"I" + varint(2) + text("z") + b"@" + varint(1) + varint(3)).value() == [None, "z", None]
    with pytest.raises(ValueError, match="unknown kind"):
        leveldb.Serialised(b"?").value()


YAML = """# a profile
id: shooter
name: "A shooter"
match:
  priority: 5
  pathContains: [Shooter, 'shot er']
detectors:
  - id: loud
    weight: 0.5
    params:
      floor: -70
  - id: feed   # the feed
    zones:
    - left
    - right
empty:
"""


def test_profiles(spark, tmp_path):
    assert profiles.parse_yaml(YAML) == {
        "id": "shooter", "name": "A shooter", "match": {"priority": 5, "pathContains": ["Shooter", "shot er"]}, "detectors": [{"id": "loud", "weight": 0.5, "params": {"floor": -70}}, {"id": "feed", "zones": ["left", "right"]}], "empty": None,
    }
    for bad in ("a: 1\na: 2", "a: 1\n  b: 2", "just words", "a:\n  b: 1\n c: 2"):
        with pytest.raises(ValueError, match="line"):
            profiles.parse_yaml(bad)
    (tmp_path / "b.yaml").write_text(YAML)
    (tmp_path / "a.yaml").write_text("id: low\nmatch:\n  pathContains: [shoot]\n")
    own = profiles.read_profiles(spark, str(tmp_path))
    assert [(r.id, r.priority, r.needles) for r in own.collect()] == [("low", 0, ["shoot"]), ("shooter", 5, ["Shooter", "shot er"])]
    files = spark.createDataFrame([("C:/SHOOTER/x.mp4",), ("shoot.mp4",), ("other",), (None,)], "path string")
    assert {r.path: r.profile for r in profiles.resolve(files, own).collect()} == {"C:/SHOOTER/x.mp4": "shooter", "shoot.mp4": "low", "other": "default", None: "default"}
    (tmp_path / "c.yaml").write_text("id: low")
    with pytest.raises(ValueError, match="both called low"):
        profiles.read_profiles(spark, str(tmp_path))


def test_truth_is_read_strictly(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("capture: x.mp4\ntolerance: 2s\nevents:\n  - kind: kill\n    at: \"1:02.5\"\n  - kind: death\n    at: 90\n")
    assert sorted(map(tuple, profiles.read_truth(spark, str(tmp_path)).collect())) == [("x.mp4", "death", 90_000_000, 2_000_000), ("x.mp4", "kill", 62_500_000, 2_000_000)]
    (tmp_path / "b.yaml").write_text("capture: y\nevnts: []\n")
    with pytest.raises(ValueError, match="unknown key evnts"):
        profiles.read_truth(spark, str(tmp_path))


def test_logs_and_sessions(spark, tmp_path):
    (tmp_path / "a.log").write_text("frame:0 pts:0 pts_time:0.1\nlavfi.r128.M=-23.4\nother\nframe:1 pts:1 pts_time:0.2\nlavfi.r128.M=nan\nlavfi.r128.M=-20\n")
    assert [(r.t, r.lufs) for r in tables.read_loudness(spark, str(tmp_path / "a.log")).collect()] == [(0.1, -23.4), (0.2, -20.0)]
    lines = spark.createDataFrame([("f", 0, "silence_start: 2"), ("f", 1, "noise"), ("f", 2, "silence_end: 5 | silence_duration: 3"), ("f", 3, "silence_start: 8"), ("g", 0, "silence_start: -0.01"), ("g", 1, "silence_end: 1")], "file string, n int, value string")
    totals = spark.createDataFrame([("f", 10.0), ("g", 4.0), ("h", 3.0)], "file string, total double")
    assert sorted(map(tuple, logs.speech(lines, totals).collect())) == [("f", 0.0, 2.0), ("f", 5.0, 8.0), ("g", 1.0, 4.0), ("h", 0.0, 3.0)]
    good = {"version": 1, "capture": "c", "duration_us": 5, "moments": [], "future": 1}
    folder = tmp_path / "s"
    folder.mkdir()
    for name, body in {"a.json": "\ufeff" + json.dumps(good, indent=1), "b.json": json.dumps(good | {"version": 9}), "c.json": "{broken", "d.txt": json.dumps(good)}.items():
        (folder / name).write_text(body)
    assert [r.capture for r in tables.read_sessions(spark, str(folder)).collect()] == ["c"]
