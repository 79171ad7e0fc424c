import io
import wave

import numpy as np
import pytest

from cadastra.operators import loudness as l


def naive(x, b0, b1, b2, a1, a2):
    out, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
    for v in x:
        y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        out.append(y)
        x1, x2, y1, y2 = v, x1, y, y1
    return np.array(out)


@pytest.mark.parametrize("stage", l.STAGES)
def test_filter_equals_its_recurrence_over_any_blocks(stage):
    x = np.random.default_rng(42).normal(size=5000)
    want = naive(x, *stage)
    for cuts in ([], [1], [255, 256, 257, 3000], [4999]):
        f = l.Biquad(*stage)
        got = np.concatenate([f(part) for part in np.split(x, cuts)])
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_ramps_and_codec():
    assert l.encode_ramp([(-17, 3), (0, 513)]) == bytes.fromhex("EF0300000102")
    assert l.decode_ramp(bytes.fromhex("EF0300000102")) == [(-17, 3), (0, 513)]
    found = dict(l.ramp([-95, -50, 0, -20]))
    assert found[-90] == 1 and found[-40] == 2 and found[0] == 2 and 3 not in found
    with pytest.raises(ValueError):
        l.encode_ramp([(0, 0)] * 16)


def wav(samples, rate, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(samples.shape[0])
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes((samples.T * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}").tobytes())
    return out.getvalue()


def test_profiles_of_files(spark, tmp_path):
    t = np.arange(2 * 48_000) / 48_000
    (tmp_path / "tone.wav").write_bytes(wav(np.stack([0.5 * np.sin(2 * np.pi * 440 * t)] * 2), 48_000))
    (tmp_path / "wide.wav").write_bytes(wav(np.stack([0.5 * np.sin(2 * np.pi * 440 * t)] * 2), 48_000, 4))
    (tmp_path / "silent.wav").write_bytes(wav(np.zeros((1, 48_000)), 48_000))
    (tmp_path / "broken.wav").write_bytes(b"no audio")
    rows = {r["id"].rsplit("/", 1)[1]: r for r in l.profiles(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows["tone.wav"]["duration_ms"] == 2000 and -15 < rows["tone.wav"]["ref_lufs"] < 0 and rows["tone.wav"]["problem"] is None
    assert rows["wide.wav"]["ref_lufs"] == pytest.approx(rows["tone.wav"]["ref_lufs"], abs=1e-3)
    assert rows["silent.wav"]["problem"] == "silent" and rows["broken.wav"]["problem"].startswith("no PCM audio")
    assert dict(l.decode_ramp(bytes(rows["tone.wav"]["start_ramp"])))[-3] == 0


def test_blocks_do_not_matter():
    x = np.random.default_rng(1).normal(size=(2, 30_000)).astype(np.float32) * 0.1
    whole = l.window_loudness([x], 8000)
    parts = l.window_loudness(np.split(x, [7, 500, 12_345], axis=1), 8000)
    assert whole[1] == parts[1] == 30_000 and np.allclose(whole[0], parts[0], atol=1e-10) and len(whole[0]) == 38


def test_limits():
    assert l.profile("x", [], 0)[-1] == "sample rate"
    assert l.profile("x", [np.zeros((1, 10))], 8000)[-1] == "silent"
    assert l.profile("x", [np.ones((1, 10)), np.ones((2, 10))], 8000)[-1] == "the number of channels changed"
    assert l.integrated([-80.0, -71.0]) == float("-inf") and l.integrated([-20.0, -20.0, -90.0]) == pytest.approx(-20)


def peak_of_profile(path):
    """Peak resident memory (KB) of a process that makes one profile."""
    import subprocess
    import sys

    code = "import resource, sys; from cadastra.operators import loudness as l; f = l.opened(sys.argv[1]); rate, blocks = l.wav_blocks(f); assert l.profile('x', blocks, rate)[-1] is None; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    return int(subprocess.run([sys.executable, "-c", code, str(path)], capture_output=True, text=True, check=True).stdout)


def test_memory_does_not_grow_with_the_file(tmp_path):
    second = (0.1 * np.sin(np.arange(48_000) / 9)).astype(np.float32)
    for name, seconds in (("short.wav", 10), ("long.wav", 300)):
        with wave.open(str(tmp_path / name), "wb") as f:
            f.setnchannels(2)
            f.setsampwidth(2)
            f.setframerate(48_000)
            for _ in range(seconds):
                f.writeframes((np.stack([second, second], axis=1) * 32767).astype("<i2").tobytes())
    assert peak_of_profile(tmp_path / "long.wav") - peak_of_profile(tmp_path / "short.wav") < 20_000  # of 55 MB more audio
