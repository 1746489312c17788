"""Signals: WAV decoding, content hashes, spectra and intervals that need numpy, as pandas UDFs over Arrow batches."""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wav_chunks(data: bytes) -> dict[bytes, bytes]:
    """The chunks of a RIFF file by name (the first of each)."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    out, at = {}, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        out.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def wav_header(data: bytes) -> tuple[int, int, int, int, int]:
    """(format, channels, rate, bits, frames); an extensible format is taken by its sub-format."""
    chunks = wav_chunks(data)
    kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", chunks[b"fmt "])
    if kind == 0xFFFE:
        kind = struct.unpack_from("<H", chunks[b"fmt "], 24)[0]
    return kind, channels, rate, bits, len(chunks.get(b"data", b"")) // max(1, align)


def wav_channels(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, frames x channels in [-1, 1]): 8 to 32-bit PCM or 32 and 64-bit floats; NaN is an error."""
    kind, channels, rate, bits, frames = wav_header(data)
    raw = wav_chunks(data)[b"data"]
    width = bits // 8
    raw = np.frombuffer(raw[: frames * channels * width], np.uint8)
    if kind == 3 and bits in (32, 64):
        x = raw.view(f"<f{width}").astype(np.float64)
        if np.isnan(x).any():
            raise ValueError("a float WAV with NaN samples")
        x = np.clip(x, -1.0, 1.0)
    elif kind == 1 and bits == 8:
        x = (raw.astype(np.float64) - 128.0) / 128.0
    elif kind == 1 and bits in (16, 24, 32):
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)
        x = wide.reshape(-1).view("<i4").astype(np.float64) / 2147483648.0
    else:
        raise ValueError(f"WAV format {kind} with {bits} bits")
    return rate, x.reshape(-1, channels)


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples): the mean of the channels as float32."""
    rate, x = wav_channels(data)
    return rate, x.mean(1).astype(np.float32)


def encode_wav(rate: int, samples: np.ndarray) -> bytes:
    """16-bit PCM, one channel."""
    pcm = np.clip(np.rint(np.asarray(samples, float) * 32767.0), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def encoded_wav(rate: int):
    """A pandas UDF: samples as 16-bit PCM WAV, one channel."""

    @F.pandas_udf(T.BinaryType())
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series([encode_wav(rate, s) for s in samples], dtype=object)

    return run


_DECODED = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])


@F.pandas_udf(_DECODED)
def wav(content: pd.Series) -> pd.DataFrame:
    """struct(rate, samples, error) of WAV bytes; what can't be decoded has only an error."""
    rows = []
    for data in content:
        try:
            rate, x = decode_wav(bytes(data))
            rows.append((rate, x.tolist(), None))
        except (ValueError, TypeError, KeyError, struct.error) as e:
            rows.append((None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["rate", "samples", "error"])


_HEADER = T.StructType([T.StructField(n, T.IntegerType()) for n in ("format", "channels", "rate", "bits", "frames")])


@F.pandas_udf(_HEADER)
def wav_info(content: pd.Series) -> pd.DataFrame:
    """struct(format, channels, rate, bits, frames) of WAV bytes, without decoding; nulls where there is no header."""
    rows = []
    for data in content:
        try:
            rows.append(wav_header(bytes(data)))
        except (ValueError, TypeError, KeyError, struct.error):
            rows.append((None,) * 5)
    return pd.DataFrame(rows, columns=["format", "channels", "rate", "bits", "frames"]).astype("Int32")


_VARIANTS = T.ArrayType(T.StructType([T.StructField("variant", T.StringType()), T.StructField("samples", T.ArrayType(T.FloatType()))]))


@F.pandas_udf(_VARIANTS)
def channel_variants(content: pd.Series) -> pd.Series:
    """The mono signal, or the mean and each channel, of WAV bytes."""
    out = []
    for data in content:
        _, x = wav_channels(bytes(data))
        named = [("mono", x[:, 0])] if x.shape[1] == 1 else [("mean", x.mean(1)), *[(f"channel_{i}", x[:, i]) for i in range(x.shape[1])]]
        out.append([{"variant": n, "samples": v.astype(np.float32).tolist()} for n, v in named])
    return pd.Series(out)


_HASHES = T.StructType([T.StructField("float32_sha256", T.StringType()), T.StructField("pcm16_sha256", T.StringType())])


def hashes_of(samples) -> tuple[str, str]:
    x = np.ascontiguousarray(samples, "<f4") + np.float32(0.0)  # -0.0 becomes 0.0
    if not np.isfinite(x).all():
        raise ValueError("samples must be finite")
    pcm = np.rint(np.clip(x.astype(np.float64), -1.0, 1.0) * 32767.0).astype("<i2")
    return hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(pcm.tobytes()).hexdigest()


@F.pandas_udf(_HASHES)
def waveform_hashes(samples: pd.Series) -> pd.DataFrame:
    """struct(float32_sha256, pcm16_sha256) of samples."""
    return pd.DataFrame([hashes_of(s) for s in samples], columns=["float32_sha256", "pcm16_sha256"])


def gain_invariant_hash(protocol: str, rate: int = 16000, normalise: bool = True):
    """A pandas UDF: SHA-256 of a header and the samples, which are at the rate, as 16-bit PCM, at full scale if normalise.

    Samples are held below 1 by one step; a silent signal isn't scaled; samples that aren't finite are errors.
    """
    top = 1.0 - 1.0 / 32768.0

    @F.pandas_udf(T.StringType())
    def run(samples: pd.Series) -> pd.Series:
        out = []
        for s in samples:
            x = np.asarray(s, np.float32)
            if not np.isfinite(x).all():
                raise ValueError("samples must be finite")
            x = np.clip(x, -1.0, top)
            peak = float(np.abs(x).max()) if len(x) else 0.0
            if normalise and peak > 1e-8:
                x = np.clip(x / peak, -1.0, top)
            header = f"{protocol}|rate={rate}|samples={len(x)}|gain_normalized={int(normalise)}|"
            out.append(hashlib.sha256(header.encode() + np.rint(x * 32768.0).astype("<i2").tobytes()).hexdigest())
        return pd.Series(out, dtype=object)

    return run


def spectral_fingerprint(rate: int, bands: int = 48, frame: int = 1024):
    """A pandas UDF: mean log power in logarithmic bands from 50 Hz up, centred, at length 1."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    which = np.digitize(f, np.geomspace(50.0, rate / 2, bands + 1)) - 1
    window = np.hanning(frame)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(samples: pd.Series) -> pd.Series:
        out = []
        for s in samples:
            x = np.asarray(s, float)
            x = np.pad(x, (0, max(0, frame - len(x))))
            frames = np.lib.stride_tricks.sliding_window_view(x, frame)[:: frame // 2]
            power = (np.abs(np.fft.rfft(frames * window)) ** 2).mean(0)
            v = np.log10(np.array([power[which == b].mean() if (which == b).any() else 0.0 for b in range(bands)]) + 1e-12)
            v = v - v.mean()
            out.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32).tolist())
        return pd.Series(out)

    return run


_BANDS = T.StructType([T.StructField("shares", T.ArrayType(T.DoubleType())), T.StructField("above", T.DoubleType()), T.StructField("above_db", T.DoubleType())])


def band_energy(rate: int, edges: tuple[float, ...] = (0, 8000, 12000, 16000, 20000)):
    """A pandas UDF: struct(shares, above, above_db) of the centred signal under a Hann window.

    shares are of the energy up to the last edge that lies between consecutive ones (below half the rate); above is
    the sum of all but the first, also in dB. Signals of under 64 samples are errors.
    """

    @F.pandas_udf(_BANDS)
    def run(samples: pd.Series) -> pd.DataFrame:
        rows = []
        for s in samples:
            x = np.asarray(s, float)
            if len(x) < 64:
                raise ValueError("a signal of under 64 samples has no bands")
            power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
            f = np.fft.rfftfreq(len(x), 1 / rate)
            total = max(power[f <= edges[-1]].sum(), np.finfo(float).tiny)
            shares = [float(power[(f >= a) & (f < min(b, rate / 2))].sum() / total) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            rows.append((shares, sum(shares[1:]), 10 * math.log10(max(sum(shares[1:]), 1e-15))))
        return pd.DataFrame(rows, columns=["shares", "above", "above_db"])

    return run


EPSILON = 1e-12
#: Fixed values of the harmonic features: Hz of the lowest band, the range of fundamentals, the last harmonic, and frames of a segment.
LOWEST_HZ, FUNDAMENTALS_HZ, LAST_HARMONIC_HZ, FRAMES = 20.0, (40.0, 500.0), 6000.0, 4
HARMONIC_FEATURES = 61


def rolloffs(power: np.ndarray, f: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
    """rows x shares: the frequency below (or at) which each share of a row's power lies."""
    total = np.cumsum(power, 1)
    places = np.stack([(total < share * power.sum(1, keepdims=True)).sum(1) for share in shares], 1)
    return f[np.minimum(places, len(f) - 1)]


def above_floor(log_power: np.ndarray, width: int) -> np.ndarray:
    """Log power less its running mean over width bins (beyond the ends: zeros)."""
    half = width // 2
    sums = np.cumsum(np.pad(log_power, ((0, 0), (half + 1, half))), 1)
    return log_power - (sums[:, width:] - sums[:, :-width]) / width


def comb_search(residual: np.ndarray, low: int, high: int, last: int, harmonics: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the bin from low to high whose multiples stand out most, its score, and the residual at them.

    The score is the mean over multiples k up to the bin last, weighted by 1 / sqrt(k); beyond it multiples are 0.
    Where a spectrum ends before last or high (at a low rate), its end takes their place.
    """
    last = min(last, residual.shape[1] - 1)
    high = min(high, last)
    order = np.arange(1, harmonics + 1)
    bins = np.arange(low, high + 1)[:, None] * order
    weight = (bins <= last) / np.sqrt(order)
    at = np.minimum(bins, last)
    score = np.einsum("nck,ck->nc", residual[:, at], weight) / np.maximum(weight.sum(1), EPSILON)
    best = score.argmax(1)
    rows = np.arange(len(residual))
    return low + best, score[rows, best], np.where(bins[best] <= last, residual[rows[:, None], at[best]], 0.0)


def harmonics_of(x: np.ndarray, rate: int = 16000, n_fft: int = 16384, bands: int = 32, harmonics: int = 12) -> np.ndarray:
    """segments x 61 of one-second segments (segments x rate): level, centroid, bandwidth, flatness, entropy and three
    roll-offs; band levels; the fundamental, its comb and profile; and how steady it is over four frames."""
    x = np.asarray(x, float)
    if x.ndim != 2 or x.shape[1] != rate or n_fft < rate or not np.isfinite(x).all():
        raise ValueError("harmonic features are of finite segments of one second")
    x = x - x.mean(1, keepdims=True)
    power = np.abs(np.fft.rfft(x * np.hanning(rate), n_fft)) ** 2 + EPSILON
    f, half = np.fft.rfftfreq(n_fft, 1 / rate), rate / 2
    heard = (f >= LOWEST_HZ) & (f <= half)
    p, g = power[:, heard], f[heard]
    share = p / p.sum(1, keepdims=True)
    centre = share @ g
    spread = np.sqrt(np.maximum((share * (g - centre[:, None]) ** 2).sum(1), 0))
    flat = np.exp(np.log(p).mean(1)) / np.maximum(p.mean(1), EPSILON)
    entropy = -(share * np.log(share + EPSILON)).sum(1) / np.log(p.shape[1])
    overall = np.column_stack([np.log10((x**2).mean(1) + EPSILON), centre / half, spread / half, flat, entropy, rolloffs(p, g, (0.5, 0.85, 0.95)) / half])

    edge = np.searchsorted(f, np.geomspace(LOWEST_HZ, half, bands + 1))
    level = np.log10(np.stack([power[:, a:b].mean(1) for a, b in zip(edge[:-1], edge[1:], strict=True)], 1) + EPSILON)
    level = level - level.mean(1, keepdims=True)

    step = rate / n_fft
    last = int(np.searchsorted(f, LAST_HARMONIC_HZ, side="right")) - 1
    residual = above_floor(np.log10(power), 41)
    place, strength, profile = comb_search(residual, max(1, math.ceil(FUNDAMENTALS_HZ[0] / step)), math.floor(FUNDAMENTALS_HZ[1] / step), last, harmonics)
    scale = np.maximum(residual[:, 20:last].std(1), EPSILON)
    profile = profile / scale[:, None]
    comb = np.column_stack([place * step / FUNDAMENTALS_HZ[1], strength / scale, (profile > 1).mean(1), profile.mean(1), profile.std(1), profile])

    # the same search in each of the frames
    size, n_short = rate // FRAMES, n_fft // FRAMES
    frames = x.reshape(-1, size)
    short = above_floor(np.log10(np.abs(np.fft.rfft(frames * np.hanning(size), n_short)) ** 2 + EPSILON), 21)
    wide = rate / n_short
    place, strength, _ = comb_search(short, int(FUNDAMENTALS_HZ[0] / wide), int(FUNDAMENTALS_HZ[1] / wide), int(LAST_HARMONIC_HZ / wide), 8)
    place, strength = (place * wide / FUNDAMENTALS_HZ[1]).reshape(-1, FRAMES), strength.reshape(-1, FRAMES) / scale[:, None]
    steady = np.column_stack([place.mean(1), place.std(1), strength.mean(1), strength.std(1)])
    return np.concatenate([overall, level, comb, steady], 1).astype(np.float32)


def harmonic_features(rate: int = 16000, n_fft: int = 16384):
    """A pandas UDF: the 61 harmonic features of one-second segments, null for null; other lengths are errors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(samples: pd.Series) -> pd.Series:
        out, there = np.full(len(samples), None, object), np.flatnonzero(samples.notna())
        for a in range(0, len(there), 32):  # a few MB of spectra at a time
            at = there[a : a + 32]
            for i, h in zip(at, harmonics_of(np.stack([np.asarray(s, float) for s in samples.iloc[at]]), rate, n_fft), strict=True):
                out[i] = h
        return pd.Series(out)

    return run


_MIX = T.StructType([T.StructField("mixed", T.ArrayType(T.DoubleType())), T.StructField("background", T.ArrayType(T.DoubleType())), T.StructField("gain", T.DoubleType())])


def _level(x: np.ndarray) -> float:
    return math.sqrt(float((x * x).mean())) + 1e-12


def _mixture(b: np.ndarray, t: np.ndarray, snr: float) -> np.ndarray:
    """The target added to the background at an SNR, at the level of the background alone."""
    if min(_level(b), _level(t)) <= 1e-8:
        raise ValueError("a silent signal has no SNR")
    mixed = b + t * (_level(b) / _level(t) * 10 ** (snr / 20))
    return mixed * (_level(b) / _level(mixed))


def _gain(*signals: np.ndarray) -> float:
    """The gain that keeps signals from clipping."""
    return min(1.0, 0.99 / max(1e-12, *(float(np.abs(x).max()) for x in signals)))


@F.pandas_udf(_MIX)
def mix_at_snr(background: pd.Series, target: pd.Series, snr_db: pd.Series) -> pd.DataFrame:
    """The target added to the background at an SNR, scaled to the level of the background, and the background alone,
    under one gain that keeps both from clipping."""
    rows = []
    for b, t, snr in zip(background, target, snr_db, strict=True):
        b, t = np.asarray(b, float), np.asarray(t, float)
        mixed = _mixture(b, t, snr)
        gain = _gain(b, mixed)
        rows.append(((mixed * gain).tolist(), (b * gain).tolist(), gain))
    return pd.DataFrame(rows, columns=["mixed", "background", "gain"])


_GRID = T.ArrayType(T.StructType([T.StructField("snr_db", T.DoubleType()), T.StructField("mixed", T.ArrayType(T.DoubleType())), T.StructField("background", T.ArrayType(T.DoubleType())), T.StructField("gain", T.DoubleType())]))


def mix_grid(snr_db: list[float]):
    """A pandas UDF of (background, target): the pair at every SNR of a rising grid, all under the least gain that any needs.

    The background comes out the same at every SNR.
    """
    grid = [float(x) for x in snr_db]
    if len(grid) < 2 or grid != sorted(set(grid)):
        raise ValueError("the SNR grid has at least two values, rising")

    @F.pandas_udf(_GRID)
    def run(background: pd.Series, target: pd.Series) -> pd.Series:
        out = []
        for b, t in zip(background, target, strict=True):
            b, t = np.asarray(b, float), np.asarray(t, float)
            mixed = [_mixture(b, t, snr) for snr in grid]
            gain = _gain(b, *mixed)
            out.append([{"snr_db": snr, "mixed": (m * gain).tolist(), "background": (b * gain).tolist(), "gain": gain} for snr, m in zip(grid, mixed, strict=True)])
        return pd.Series(out, dtype=object)

    return run


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beta_cdf(middle, a, b) < p else (low, middle)
    return (low + high) / 2


_CI = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


@F.pandas_udf(_CI)
def clopper_pearson(successes: pd.Series, total: pd.Series) -> pd.DataFrame:
    """struct(low, high): the exact 95 % interval of a binomial share; nulls without trials."""
    rows = []
    for k, n in zip(successes, total, strict=True):
        if not n > 0:
            rows.append((None, None))
        else:
            rows.append((0.0 if k == 0 else beta_quantile(0.025, k, n - k + 1), 1.0 if k == n else beta_quantile(0.975, k + 1, n - k)))
    return pd.DataFrame(rows, columns=["low", "high"])


def mel_filters(rate: int, n_fft: int, mels: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular filters, mels x (n_fft / 2 + 1): corners evenly spaced on the mel scale and rounded down to bins.

    A filter rises from 0 at its first bin to 1 before its middle one, and falls from 1 there to 0 before its end;
    a side of one bin is its first value, a side without bins is left out.
    """
    to_mel = lambda f: 2595.0 * np.log10(1 + np.asarray(f) / 700.0)
    points = 700.0 * (10 ** (np.linspace(to_mel(low), to_mel(high or rate / 2), mels + 2) / 2595.0) - 1)
    left, middle, right = (np.floor((n_fft + 1) * points / rate).astype(int)[i : i + mels, None] for i in range(3))
    k = np.arange(n_fft // 2 + 1)[None]
    rise = np.where((k >= left) & (k < middle), (k - left) / np.maximum(middle - left - 1, 1), 0.0)
    fall = np.where((k >= middle) & (k < right), 1 - (k - middle) / np.maximum(right - middle - 1, 1), 0.0)
    return rise + fall


def dct_matrix(coefficients: int, mels: int) -> np.ndarray:
    """The orthonormal DCT-II, coefficients x mels."""
    k, n = np.arange(coefficients)[:, None], np.arange(mels)[None]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * mels)) * np.sqrt(2 / mels) * np.where(k == 0, np.sqrt(0.5), 1.0)


def log_mel(rate: int, mels: int = 64, n_fft: int = 512, hop: int = 160, coefficients: int | None = None, window: int | None = None, low: float = 0.0, high: float | None = None, preemphasis: float = 0.0, hamming: bool = False):
    """A pandas UDF: standardised log-mel frames (or their first DCT coefficients), frames x features.

    Frames are centred (the signal is mirrored at its ends) under a periodic Hann (or Hamming) window; the whole
    signal is standardised at once, by the sample deviation.
    """
    filters, size = mel_filters(rate, n_fft, mels, low, high), window or n_fft
    shape = (np.hamming if hamming else np.hanning)(size + 1)[:-1]
    shape = np.pad(shape, ((n_fft - size) // 2, n_fft - size - (n_fft - size) // 2))
    dct = dct_matrix(coefficients, mels) if coefficients else None

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def run(samples: pd.Series) -> pd.Series:
        out = []
        for s in samples:
            x = np.asarray(s, float)
            x = np.append(x[:1], x[1:] - preemphasis * x[:-1])
            x = np.pad(x, n_fft // 2, mode="reflect") if len(x) > n_fft // 2 else np.pad(x, (n_fft // 2, n_fft - n_fft // 2))
            frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * shape
            v = np.log(np.maximum(np.abs(np.fft.rfft(frames)) ** 2 @ filters.T, 1e-10))
            v = v if dct is None else v @ dct.T
            out.append(((v - v.mean()) / max(v.std(ddof=1), 1e-5)).astype(np.float32).tolist())
        return pd.Series(out)

    return run
