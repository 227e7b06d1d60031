import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest

from glidemesh.llm import op08_audio as op


def direct(x, up, down, taps):
    half = taps * max(up, down)
    t = np.arange(-half, half + 1)
    h = up / max(up, down) * np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 6.0)
    z = np.zeros(len(x) * up + 2 * half + 1)
    z[half : half + len(x) * up : up] = x
    n = -(-len(x) * up // down)
    return np.array([np.dot(z[m * down : m * down + 2 * half + 1] if len(z[m * down : m * down + 2 * half + 1]) == 2 * half + 1 else np.pad(z[m * down :], (0, 2 * half + 1 - len(z[m * down :]))), h[::-1]) for m in range(n)])


@pytest.mark.parametrize("up,down", [(2, 3), (1, 2), (3, 2), (1, 1)])
def test_polyphase_equals_direct_filtering(up, down):
    raw = np.random.default_rng(1).integers(0, 256, 700).astype(np.uint8)
    want = direct((raw.astype(float) - 128) / 128, up, down, 8)
    whole = op.resample_block(raw, 0, len(want), up, down, 8)
    assert np.allclose(whole, want, atol=1e-4)
    for first in (up * 20, up * 51):
        assert np.allclose(op.resample_block(raw, first, 60, up, down, 8), want[first : first + 60], atol=1e-4)


def test_blocks_do_not_change_the_features():
    raw = np.random.default_rng(2).integers(32, 122, 40_000).astype(np.uint8)
    a, n, seg = op.features(raw, op.AudioParams())
    b, m, seg2 = op.features(raw, op.AudioParams(block=3))
    assert n == m and seg == seg2 and np.allclose(a, b, atol=1e-3)


def test_wav_is_a_wav():
    media = op.write_wav(b"abc" * 64, 12_000)
    w = wave.open(io.BytesIO(media))
    assert (w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(999)) == (12_000, 1, 1, b"abc" * 64)
    with pytest.raises(ValueError):
        op.read_wav(b"x" * 44)


def test_hysteresis():
    e = np.array([0, 0, 5, 3, 5, 0, 3, 3, 0, 0, 0.0])
    p = op.AudioParams(open_std=1.5, keep_std=0.2)
    assert op.hysteresis(e, p) == [(2, 5)]


def test_query(spark, tmp_path):
    texts = [None, "", "a", "é" * 96, "x" * 192, "long text " * 9000, "a"]
    spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(pay), zlib.crc32(pay[-16:]))
        assert r.payload_sha256 == hashlib.sha256(pay).hexdigest()
        assert r.media_sha256 == hashlib.sha256(op.write_wav(pay, 12_000)).hexdigest() and r.media_bytes == 44 + len(pay)
    assert got[2].feature == got[6].feature and got[0].feature == got[1].feature != got[2].feature


def test_tensors_and_edge_cases(spark):
    df = spark.createDataFrame([(None, bytearray(b"hello" * 2000), 7), (1, None, 8)], "doc_id long, payload binary, extra int")
    got = {r.doc_id: r for r in op.audio_features(df, keep=("extra",)).collect()}
    t = pa.ipc.open_stream(bytes(got[None].tensors)).read_all()
    assert t.schema.field("mel").type.shape == [8, 16] and t["start_s"][0].as_py() == 0 and got[None].extra == 7
    ends = t["end_s"].to_pylist()
    assert all(a < b for a, b in zip(t["start_s"].to_pylist(), ends)) and got[1].data_bytes == 0
    assert op.audio_features(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        op.audio_features(df.withColumnRenamed("extra", "media"), keep=("media",))
