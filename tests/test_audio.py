"""Mono samples of generated WAV files against NumPy: scaling, channel means, the polyphase filter as a plain convolution."""

import math
import wave

import numpy as np
import pytest

from driftline.sources import audio


def write(path, x, rate, width):
    """x in [-1, 1) as (frames, channels); what a reader must find again."""
    half = 1 << (8 * width - 1)
    n = np.clip(np.round(x * half), -half, half - 1).astype(np.int64)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(x.shape[1])
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(b"".join(int(v + 128 if width == 1 else v % (2 * half)).to_bytes(width, "little") for v in n.ravel()))
    return (n / half).mean(1)


def plain(x, rate, to=16000):
    """Zeros between samples, one convolution with the whole filter, every so many samples kept."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    if up == down:
        return x
    most = max(up, down)
    half = 10 * most
    t = np.arange(-half, half + 1)
    h = np.sinc(t / most) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, h)[half:][: len(x) * up][::down]


def test_files_of_many_kinds(spark, tmp_path):
    r = np.random.default_rng(3)
    want = {}
    for name, rate, channels, width, n in (("a", 16000, 1, 2, 400), ("b", 16000, 3, 3, 200), ("c", 8000, 1, 2, 150), ("d", 48000, 2, 2, 301), ("e", 16000, 2, 1, 99), ("f", 22050, 1, 4, 120), ("g", 8000, 1, 2, 0)):
        x = write(tmp_path / f"{name}.wav", r.uniform(-0.9, 0.9, size=(n, channels)), rate, width)
        want[name] = (rate, channels, n, plain(x, rate) if n else x)
    rows = audio.wav(spark, str(tmp_path)).collect()
    assert len(rows) == len(want)
    for row in rows:
        rate, channels, n, x = want[row["path"].rsplit("/", 1)[1][0]]
        assert (row["file_rate"], row["channels"], row["n_frames"]) == (rate, channels, n)
        assert len(row["samples"]) == math.ceil(n * 16000 / rate) == len(x)
        assert not n or np.abs(np.array(row["samples"]) - x).max() < 1e-6


def test_chunks_before_the_data_and_other_files(spark, tmp_path):
    (tmp_path / "one").mkdir()
    x = write(tmp_path / "one" / "a.wav", np.linspace(-0.5, 0.5, 50)[:, None], 16000, 2)
    body = (tmp_path / "one" / "a.wav").read_bytes()
    (tmp_path / "one" / "a.wav").write_bytes(body[:36] + b"LIST" + (5).to_bytes(4, "little") + b"notes\0" + body[36:])
    got = audio.wav(spark, str(tmp_path / "one")).first()
    assert np.abs(np.array(got["samples"]) - x).max() < 1e-6
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.wav").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="is no PCM WAV file"):
        audio.wav(spark, str(tmp_path / "two")).collect()
