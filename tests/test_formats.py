"""Data sources by name: the same rows however files are cut, in batches and as streams."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from mediaspark.sources import formats, readers


@pytest.fixture(scope="module")
def source(spark):
    return formats.register(spark)


def datagram(seq, payload, magic=b"CAST", length=None):
    return struct.pack(">4sBBBIqHHI", magic, 1, 3, 0, seq, seq * 40, 0, 1, len(payload) if length is None else length) + payload


def capture(n, seed):
    rng = random.Random(seed)
    # payloads that hold whole datagrams must not be taken for such
    return [datagram(k, datagram(999, b"inner") + rng.randbytes(rng.randrange(60)) if k % 5 == 0 else rng.randbytes(rng.randrange(80))) for k in range(n)]


def test_byte_ranges_digest_is_the_same_on_any_ranges(source, tmp_path):
    rng = random.Random(1)
    files = {"a.iso": rng.randbytes(10_000), "b.iso": rng.randbytes(4_096), "c.iso": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "none.iso").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no")
    want = {}
    for name, data in files.items():
        digests = [hashlib.sha256(data[k : k + 1024]).hexdigest() for k in range(0, len(data), 1024)]
        want[name] = (len(digests), hashlib.sha256("".join(digests).encode()).hexdigest())
    for step in (1, 1024, 3000, 1 << 30):
        df = source.read.format("byte_ranges").option("pattern", "*.iso").option("chunk_bytes", 1024).option("range_bytes", step).load(str(tmp_path))
        got = readers.chunk_sha256(df, ["path"])
        assert {r["path"].rsplit("/", 1)[-1]: (r["n_chunks"], r["sha256"]) for r in got.collect()} == want
        assert df.rdd.getNumPartitions() == {1: 15, 1024: 15, 3000: 8, 1 << 30: 3}[step]
    sizes = df.groupBy("path").agg(F.sum("length").alias("n"), F.max("size").alias("size")).collect()
    assert all(r["n"] == r["size"] for r in sizes)


def test_datagrams_are_whole_on_any_ranges(source, tmp_path):
    sent = capture(60, 3)
    (tmp_path / "one.cap").write_bytes(b"".join(sent))
    (tmp_path / "cut.cap").write_bytes(sent[0] + sent[1][:-1] if len(sent[1]) > 27 else sent[0] + sent[1][:20])
    (tmp_path / "bad.cap").write_bytes(sent[2] + datagram(7, b"lost", magic=b"CAXX") + sent[3])
    (tmp_path / "empty.cap").write_bytes(b"")
    want = [("one.cap", d) for d in sent] + [("cut.cap", sent[0]), ("cut.cap", sent[1][:27] if len(sent[1]) > 27 else sent[1][:20]), ("bad.cap", sent[2]), ("bad.cap", datagram(7, b"lost", magic=b"CAXX")[:27])]
    for step in (1, 7, 100, 1 << 30):
        df = source.read.format("datagrams").option("magic", "CAST").option("range_bytes", step).load(str(tmp_path))
        assert sorted((r["path"].rsplit("/", 1)[-1], bytes(r["datagram"])) for r in df.collect()) == sorted(want), step
    reject = readers.read_datagrams(df, "CAST").filter("reject IS NOT NULL").select("reject").collect()
    assert sorted(r["reject"] for r in reject) == ["bad magic", "truncated payload" if len(sent[1]) > 27 else "truncated header"]


def test_datagram_stream_follows_growing_files(source, tmp_path):
    sent = capture(40, 4)
    data = b"".join(sent)
    inbox = tmp_path / "in"
    inbox.mkdir()
    one, two = inbox / "one.cap", inbox / "two.cap"
    one.write_bytes(b"")
    stream = source.readStream.format("datagrams").option("magic", "CAST").option("range_bytes", 100).load(str(inbox))

    def drain():
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()

    for a, b in ((0, 70), (70, 75), (75, len(data) - 3), (len(data) - 3, len(data))):
        with one.open("ab") as f:
            f.write(data[a:b])
        if a == 75:
            two.write_bytes(sent[0])
        drain()
    with two.open("ab") as f:
        f.write(b"CA")
    drain()
    with two.open("ab") as f:
        f.write(b"XX" + bytes(30))
    drain()
    drain()
    got = source.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(bytes(r["datagram"]) for r in got if r["path"].endswith("one.cap")) == sorted(sent)
    assert sorted(bytes(r["datagram"]) for r in got if r["path"].endswith("two.cap")) == sorted([sent[0], b"CAXX" + bytes(23)])


def playlist(flags):
    item = struct.pack(">H5s4s3sII", 20, b"00001", b"M2TS", bytes(3), 0, 45000)
    header = b"MPLS0200" + struct.pack(">I", 80) + bytes(28) + struct.pack(">I", 14) + bytes(12) + bytes([flags]) + bytes(23)
    return header + struct.pack(">IHHH", 0, 0, 1, 0) + item


def test_playlists_in_batch_and_stream(source, tmp_path):
    for disc, flags in (("d1", 0x0F), ("d2", 0x10)):
        folder = tmp_path / "in" / disc / "BDMV" / "PLAYLIST"
        folder.mkdir(parents=True)
        (folder / "00000.mpls").write_bytes(playlist(flags))
        (folder / "00001.MPLS").write_bytes(b"MPLS0200\xff")
    root = str(tmp_path / "in")

    def eyes(df):
        return sorted(tuple(r) for r in df.select("disc_id", "playlist", "clip", "out_45k", readers.playlist_eye(F.col("header"))).collect())

    want = [("d1", "00000.mpls", "00001", 45000, "left_first"), ("d2", "00000.mpls", "00001", 45000, "right_first")]
    assert eyes(source.read.format("disc_playlists").load(root)) == want
    segments, _ = readers.read_discs(source, root)
    assert sorted(r["disc_id"] for r in segments.collect()) == ["d1", "d2"]
    stream = source.readStream.format("disc_playlists").load(root)
    for n in (1, 2):
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        assert eyes(source.read.parquet(str(tmp_path / "out"))) == [*want, ("d3", "00000.mpls", "00001", 45000, "left_first")][: n + 1]
        folder = tmp_path / "in" / "d3" / "BDMV" / "PLAYLIST"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "00000.mpls").write_bytes(playlist(0))
