import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sparkloom.llm import gif as G, queries


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.sampled_from([b"a", b"ab", b"\0" * 50, b"xyz" * 30]), max_size=80).map(b"".join)))
def test_lzw_round_trip(data):
    assert G.lzw_decode(G.lzw_encode(data), 8, len(data)) == data


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * G.FRAME_ROWS, 64 * G.FRAME_ROWS + 1, 300_000])
def test_payloads(n):
    payload = G.pad(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())
    frames = list(G.read_frames(G.write_gif(payload)))
    assert len(payload) % 64 == 0 and payload and b"".join(f.samples.tobytes() for f in frames) == payload
    assert all(f.delay_cs == G.DELAY_CS for f in frames)
    assert sum(int(G.histogram(f.canvas).sum()) for f in frames) == len(frames) * frames[0].canvas.shape[0] * 64


def image(frames, size=(4, 4), palette=bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), palette]
    for left, top, w, h, disposal, clear, interlaced, data in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), 7, clear or 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced) + b"\x02" + G._blocks(G.lzw_encode(bytes(data), 2)))
    return b"".join(out) + b"\x3b"


def test_drawing_rules():
    base = (0, 0, 4, 4, 1, None, 0, [1] * 16)
    clear = list(G.read_frames(image([base, (1, 1, 2, 2, 1, 2, 0, [2, 3, 3, 2])])))[1].canvas
    assert clear[1, 1].tolist() == [255, 0, 0] and clear[1, 2].tolist() == [0, 0, 255]  # what is transparent stays
    back = list(G.read_frames(image([base, (0, 0, 2, 2, 2, None, 0, [3] * 4), (3, 3, 1, 1, 1, None, 0, [2])])))[2].canvas
    assert back[0, 0].tolist() == [0, 0, 0] and back[2, 2].tolist() == [255, 0, 0]  # disposal 2 restores the background
    before = list(G.read_frames(image([base, (0, 0, 2, 2, 3, None, 0, [3] * 4), (3, 3, 1, 1, 1, None, 0, [2])])))[2].canvas
    assert before[0, 0].tolist() == [255, 0, 0]  # disposal 3 restores what was before
    rows = list(G.read_frames(image([(0, 0, 1, 8, 0, None, 1, [0, 1, 2, 2, 3, 3, 3, 3])], (1, 8))))[0].samples[:, 0].tolist()
    assert rows == [0, 3, 2, 3, 1, 3, 2, 3]  # interlaced


def test_broken_data():
    good = image([(0, 0, 4, 4, 1, None, 0, [1] * 16)])
    for n in range(13, len(good)):
        list(G.read_frames(good[:n]))
    with pytest.raises(ValueError):
        list(G.read_frames(b"PNG"))


def test_bands_hold_what_one_band_holds():
    rng = np.random.default_rng(1)
    frames = []
    for k in range(12):
        left, top, w, h = (int(x) for x in (rng.integers(0, 9), rng.integers(0, 30), rng.integers(1, 12), rng.integers(1, 25)))
        frames.append((left, top, w, h, k % 4, None if k % 3 else 2, k % 2, rng.integers(0, 4, w * h).tolist()))
    data = image(frames, (10, 40))
    whole = list(G.read_frames(data))
    for pixels in (1, 30, 100, 400):
        bands = list(G.read_frames(data, pixels))
        for k, f in enumerate(whole):
            mine = [b for b in bands if b.frame == k]
            assert np.array_equal(np.concatenate([b.samples for b in mine]), f.samples)
            assert np.array_equal(np.concatenate([b.canvas for b in mine]), f.canvas)
            assert sum(G.histogram(b.canvas) for b in mine).tolist() == G.histogram(f.canvas).tolist()


def test_a_screen_of_81_million_pixels_is_drawn(spark):
    data = image([(8990, 8990, 4, 4, 1, None, 0, [1] * 16)], (9000, 9000))
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    got = df.select(G.frames_column(df["b"]).alias("f")).first()["f"]
    assert got["error"] is None and sum(f["histogram"][48] for f in got["frames"]) == 16
    assert sum(sum(f["histogram"]) for f in got["frames"]) == 9000 * 9000
    assert [x for x in (bytes(f["samples"]) for f in got["frames"]) if x] == [bytes([1] * 16)]


def test_query(spark, small):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op9_gif(spark, small).collect():
        p = G.pad(docs[r["doc_id"]])
        media = G.write_gif(p)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(docs[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest())
        colours = np.bincount(sum((list(p[at : at + 65536]) for at in range(0, len(p), 65536)), []), minlength=256).reshape(4, 64).sum(1)
        unused = sum(-len(p[at : at + 65536]) % min(len(p), 65536) for at in range(0, len(p), 65536))
        grey = [0] * 64
        for k in range(4):
            grey[k * 21] = int(colours[k])
        # a last frame that is shorter leaves the rows below as the frame before drew them
        if not unused:
            assert r["feature"] == ",".join(map(str, grey))
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest())


def test_nulls_and_empty_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None,), (bytearray(b""),)], "b binary")
    got = df.select(G.write_column(F.col("b")).alias("m")).select(G.frames_column(F.col("m")).alias("f")).collect()
    assert [bytes(r["f"]["frames"][0]["samples"]) for r in got] == [bytes(64)] * 2 and got[0]["f"]["error"] is None
    none = df.select(G.frames_column(F.col("b")).alias("f")).collect()[0]["f"]
    assert none["frames"] == [] and none["error"] == "not a GIF"
    assert df.limit(0).select(G.write_column(F.col("b"))).count() == 0
