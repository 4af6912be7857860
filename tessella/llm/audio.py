"""Media columns: audio features (operator 6).

A payload of bytes is stored losslessly as the 8-bit samples of a WAV file. Reading it back gives the
samples, which are resampled by a polyphase filter, cut into overlapping frames and turned into
log-mel filterbanks. Frames are grouped into windows of one fixed shape, held as Arrow fixed-shape
tensors with the time span of each window; energy with two thresholds gives the active segments.

Defined cases: null text is the empty one and still has one padded block, so at least one window;
equal texts give equal values, as each row is computed alone; an empty table gives an empty result;
other columns are ignored. Very long texts are worked on in blocks of samples, so besides the bytes
themselves memory is bounded.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from struct import pack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import arrow_pass, texts

#: Bytes are padded with PAD to a positive multiple of BLOCK.
BLOCK, PAD = 576, 255
SOURCE_HZ, TARGET_HZ, UP, DOWN = 24_000, 16_000, 2, 3
TAPS = 16  # of each phase
FRAME, HOP, FFT, MELS = 400, 160, 512, 40
#: Frames of a window; a window is one tensor of shape (WINDOW, MELS).
WINDOW = 100
#: Energy thresholds of a segment in dB below the clip's loudest frame: it opens above the first and
#: closes below the second. Shorter ones than MIN_FRAMES go.
OPEN_DB, CLOSE_DB, MIN_FRAMES = -6.0, -12.0, 3
FLOOR = 1e-6
BLOCK_SAMPLES = 1 << 17


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + bytes([PAD]) * (-len(raw) % BLOCK or BLOCK * (not raw)), len(raw)


def write_wav(payload: bytes, rate: int = SOURCE_HZ) -> bytes:
    """Mono PCM with 8 bits a sample; the payload's length is even, so no fill byte follows."""
    return b"RIFF" + pack("<I", 36 + len(payload)) + b"WAVEfmt " + pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + pack("<I", len(payload)) + payload


def read_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit PCM file; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(4)
def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """The low-pass prototype (windowed sinc, cut at the lower of the two rates) by phase, reversed
    so that a plain inner product applies it."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.blackman(n)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1]).astype("float32")


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: output n is phase n*down % up of the filter over the samples up to n*down // up."""
    bank = phases(up, down)
    taps = bank.shape[1]
    n = -(-len(x) * up // down)
    out = np.zeros(n, "float32")
    padded = np.concatenate([np.zeros(taps - 1, "float32"), x, np.zeros(1, "float32")])
    for k in range(up):  # outputs k, k+up, ...: their phase is fixed and their samples are `down` apart
        own = len(range(k, n, up))
        first = k * down // up
        seen = np.lib.stride_tricks.sliding_window_view(padded, taps)[first::down][:own]
        for at in range(0, own, BLOCK_SAMPLES // 8):
            part = seen[at : at + BLOCK_SAMPLES // 8]
            out[k + at * up : k + (at + len(part)) * up : up] = np.ascontiguousarray(part) @ bank[k * down % up]
    return out


@lru_cache(2)
def mel_bank(rate: int = TARGET_HZ) -> np.ndarray:
    """Triangles of equal width on the mel scale, (FFT // 2 + 1, MELS)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype("float32")


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n, MELS) and each frame's energy in dB; the last frame is filled with zeros."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    padded = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), "float32")])
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP][:n]
    window = np.hanning(FRAME).astype("float32")
    mel, energy = np.empty((n, MELS), "float32"), np.empty(n, "float32")
    for at in range(0, n, BLOCK_SAMPLES // FFT):
        part = frames[at : at + BLOCK_SAMPLES // FFT] * window
        spectrum = np.fft.rfft(part, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype("float32")
        mel[at : at + len(part)] = np.log(power @ mel_bank() + FLOOR)
        energy[at : at + len(part)] = 10 * np.log10((part**2).mean(1) + FLOOR)
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans (end exclusive) that stay above the closing threshold and rise above the opening
    one somewhere."""
    top = float(energy.max())
    low = np.concatenate([[False], energy > top + CLOSE_DB, [False]])
    edges = np.flatnonzero(low[1:] != low[:-1])
    loud = np.concatenate([[0], np.cumsum(energy > top + OPEN_DB)])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= MIN_FRAMES and loud[b] > loud[a]]


def windows(mel: np.ndarray) -> pa.RecordBatch:
    """Fixed-shape tensors with the time span and the number of real frames of each."""
    n = -(-len(mel) // WINDOW)
    filled = np.full((n * WINDOW, MELS), np.float32(np.log(FLOOR)), "float32")
    filled[: len(mel)] = mel
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, WINDOW, MELS))
    starts = np.arange(n) * WINDOW
    frames = np.minimum(len(mel) - starts, WINDOW)
    step = HOP / TARGET_HZ
    return pa.record_batch([tensor, pa.array(starts * step), pa.array(((starts + frames - 1) * HOP + FRAME) / TARGET_HZ), pa.array(frames.astype("int32"))], names=["log_mel", "start_s", "end_s", "frames"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.Table:
    """The tensors that featurize() stores in its `tensors` column."""
    return pa.ipc.open_stream(raw).read_all()


def _feature(batch: pa.RecordBatch, mel: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """An account of the tensors: shape, mean by band (8 groups of 5), all segments and their number."""
    bands = mel.mean(0).reshape(8, -1).mean(1)
    shape = "x".join(map(str, (batch.num_rows, WINDOW, MELS)))
    return f"{shape};" + ",".join(f"{v:.2f}" for v in bands) + ";" + ",".join(f"{a}-{b}" for a, b in spans) + f";{len(spans)}"


#: What featurize() can return per row.
OUTPUTS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "n_tensors": pa.int64(), "tensors_sha256": pa.string(), "media": pa.binary(), "tensors": pa.binary(), "spans": pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _row(text: str, outputs: tuple[str, ...]) -> dict:
    payload, n = payload_of(text)
    media = write_wav(payload)
    back, _ = read_wav(media)
    x = (np.frombuffer(back, np.uint8).astype("float32") - 128) / 128
    mel, energy = log_mel(resample(x))
    spans = segments(energy)
    batch = windows(mel)
    row = {"n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": _feature(batch, mel, spans)}
    if "media" in outputs:
        row["media"] = media
    if "tensors" in outputs or "tensors_sha256" in outputs:
        row["tensors"] = to_ipc(batch)
        row["n_tensors"], row["tensors_sha256"] = batch.num_rows, hashlib.sha256(row["tensors"]).hexdigest()
    if "spans" in outputs:
        row["spans"] = [{"start_s": a * HOP / TARGET_HZ, "end_s": b * HOP / TARGET_HZ} for a, b in spans]
    return row


def featurize(docs: DataFrame, outputs: tuple[str, ...] = ("media", "tensors", "spans"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the chosen OUTPUTS for each row, in one pass without a shuffle. `tensors` is an
    Arrow stream of fixed-shape tensors with time spans; from_ipc() reads it."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [_row(t, outputs) for t in batch.column("text").to_pylist()]
            return pa.record_batch([batch.column("doc_id"), *(pa.array([r[x] for r in rows], OUTPUTS[x]) for x in outputs)], names=["doc_id", *outputs])

        return work

    schema = "doc_id long" + "".join(f", {x} {_SQL.get(OUTPUTS[x], 'array<struct<start_s:double,end_s:double>>')}" for x in outputs)
    return arrow_pass(texts(docs, id_col, text_col), make, schema, rows=64)
