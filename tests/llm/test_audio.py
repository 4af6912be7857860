import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import audio


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=900))
def test_payload_survives_storage(text):
    payload, n = audio.payload_of(text)
    raw = text.encode()
    assert len(payload) % 576 == 0 and len(payload) >= 576 and n == len(raw) and payload == raw + b"\xff" * (len(payload) - n)
    assert len(payload) - n < 576 or not raw
    assert audio.read_wav(audio.write_wav(payload)) == (payload, audio.SOURCE_HZ)


def test_resampler_equals_direct_filter():
    x = np.random.default_rng(1).normal(size=1000).astype("float32")
    n, taps = audio.UP * audio.TAPS, audio.TAPS
    proto = np.empty(n)
    bank = audio.phases()
    for p in range(audio.UP):
        proto[p :: audio.UP] = bank[p][::-1]
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    want = np.convolve(up, proto)[: len(up)][:: audio.DOWN]
    got = audio.resample(x)
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-4) and taps == 16


def test_a_tone_keeps_its_band():
    t = np.arange(24_000) / audio.SOURCE_HZ
    mel, _ = audio.log_mel(audio.resample(np.sin(2 * np.pi * 1000 * t).astype("float32")))
    centre = int(np.argmax(audio.mel_bank()[round(1000 * audio.FFT / audio.TARGET_HZ)]))
    assert abs(int(np.median(mel.argmax(1))) - centre) <= 1


def test_hysteresis():
    e = np.array([-40, -11, -5, -11, -11, -30, -11, -11, -11, -30, 0, -1, -2], float)
    assert audio.segments(e) == [(1, 5), (10, 13)]


def test_tensors_round_trip_and_equal_rows(spark):
    text = "ab é" * 9000
    rows = audio.featurize(spark.createDataFrame([(1, text, 5), (1, text, 6), (2, None, 7)], "doc_id long, text string, media int"), ("n_bytes", "feature", "n_tensors", "tensors_sha256", "media", "tensors", "spans")).collect()
    assert rows[0] == rows[1] and len(rows) == 3
    assert all(r.tensors_sha256 == hashlib.sha256(bytes(r.tensors)).hexdigest() and r.n_tensors == audio.from_ipc(bytes(r.tensors)).num_rows for r in rows)
    table = audio.from_ipc(bytes(rows[0]["tensors"]))
    tensor = table.column("log_mel").combine_chunks()
    assert tensor.type.shape == [audio.WINDOW, audio.MELS]
    mel, _ = audio.log_mel(audio.resample((np.frombuffer(audio.read_wav(bytes(rows[0]["media"]))[0], np.uint8).astype("float32") - 128) / 128))
    got = tensor.to_numpy_ndarray().reshape(-1, audio.MELS)[: len(mel)]
    assert np.allclose(got, mel, atol=1e-3) and rows[2]["n_bytes"] == 0
    assert hashlib.sha256(bytes(rows[2]["media"])).hexdigest() == hashlib.sha256(audio.write_wav(b"\xff" * 576)).hexdigest()


def test_every_segment_is_told():
    energy = np.tile(np.r_[np.zeros(4), np.full(4, -40.0)], 90)
    spans = audio.segments(energy)
    mel = np.zeros((len(energy), audio.MELS), "float32")
    feature = audio._feature(audio.windows(mel), mel, spans)
    assert len(spans) == 90 and feature.split(";")[2].count("-") == 90 and feature.endswith(";90")


def test_empty_table(spark):
    assert audio.featurize(spark.createDataFrame([], "doc_id long, text string"), ("feature", "tensors_sha256", "spans")).count() == 0
