"""Audio features against plain loops and direct sums."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import media
from tests.llm.test_operators import docs  # noqa: F401


def test_resampler_is_a_direct_convolution():
    x = np.random.default_rng(0).normal(size=150)
    for up, down in ((1, 2), (3, 2), (2, 3), (1, 1)):
        n, cut = media.TAPS * up, 1 / max(up, down)
        t = [i - (n - 1) / 2 for i in range(n)]
        h = [cut * (1 if u == 0 else math.sin(math.pi * cut * u) / (math.pi * cut * u)) * (0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1))) for i, u in enumerate(t)]
        h = [v * up / sum(h) for v in h]
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        # the filter's middle lies half its length behind the first output
        full = np.convolve(wide, h)
        want = [full[at] if (at := j * down + (media.TAPS // 2 - 1) * up + j * 0) < len(full) else 0 for j in range(-(-len(x) * up // down))]
        assert np.allclose(media.resample(x.astype(np.float32), up, down), want, atol=1e-4), (up, down)


def test_log_mel_is_a_plain_fourier_sum():
    y = np.random.default_rng(1).normal(size=media.FRAME + 2 * media.HOP + 7).astype(np.float32)
    mels, energy = media.log_mel(y)
    rate = media.RATE * media.UP / media.DOWN
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    low, high = mel(20.0), mel(rate / 2)
    points = [700 * (10 ** ((low + (high - low) * i / (media.MELS + 1)) / 2595) - 1) for i in range(media.MELS + 2)]
    assert len(mels) == 3
    for frame in range(3):
        w = [float(y[frame * media.HOP + i]) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1))) for i in range(media.FRAME)]
        assert energy[frame] == pytest.approx(10 * math.log10(sum(v * v for v in w) / media.FRAME + 1e-9), abs=1e-3)
        power = [abs(sum(v * complex(math.cos(a := -2 * math.pi * k * i / media.FFT), math.sin(a)) for i, v in enumerate(w))) ** 2 for k in range(media.FFT // 2 + 1)]
        for m in range(media.MELS):
            total = 0.0
            for k, p in enumerate(power):
                f = k * rate / media.FFT
                total += p * max(0.0, min((f - points[m]) / (points[m + 1] - points[m]), (points[m + 2] - f) / (points[m + 2] - points[m + 1])))
            assert mels[frame, m] == pytest.approx(math.log(total + 1e-6), abs=2e-3)


def test_segments_are_those_of_a_loop():
    rng = np.random.default_rng(2)
    for _ in range(50):
        energy = rng.normal(0, 4, rng.integers(1, 40)).astype(np.float32)
        level, on, want = energy - energy.mean(), None, []
        for i, v in enumerate(level):
            if on is None and v >= media.OPEN_DB:
                on = i
            elif on is not None and v < media.CLOSE_DB:
                want.append((on, i))
                on = None
        want += [(on, len(level))] if on is not None else []
        assert [tuple(x) for x in media.segments(energy).tolist()] == want


def test_stored_media_come_back(spark, docs):  # noqa: F811
    out = media.audio_features(docs).collect()
    step = media.HOP * media.DOWN / (media.RATE * media.UP)
    by = {}
    for r in out:
        samples = media.decode_wav(r.media)[1]
        x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
        mels, energy = media.log_mel(media.resample(x))
        table = pa.ipc.open_stream(r.tensors).read_all()
        assert table["tensor"].type == media.TENSOR
        flat = np.concatenate([np.array(t, np.float32).reshape(-1, media.MELS) for t in table["tensor"].combine_chunks().storage.to_pylist()])
        assert np.allclose(flat[: len(mels)], mels, atol=0.02) and not flat[len(mels) :].any()
        assert table["start_s"].to_pylist() == pytest.approx([i * media.SPAN * step for i in range(table.num_rows)])
        assert np.allclose(np.array(r.spans).reshape(-1, 2), media.segments(energy) * step)
        by.setdefault(hashlib.sha256(r.media).hexdigest(), set()).add((r.feature, r.payload_sha256, r.tail_crc32))
    assert all(len(v) == 1 for v in by.values()) and len(out) == docs.count()
    assert "tensors" in media.audio_features(docs, keep_media=False).columns
