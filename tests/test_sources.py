"""Readers, writers, signals and streams on temporary folders."""

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenfold.functions import scalars, signals
from lumenfold.sources import readers, writers
from lumenfold.streaming import alarms


def tone(n=800, rate=16000, f=440.0):
    return (0.5 * np.sin(2 * np.pi * f * np.arange(n) / rate)).astype(np.float32)


def test_wav_formats():
    rate, x = signals.decode_wav(signals.encode_wav(16000, tone()))
    assert rate == 16000 and np.abs(x - tone()).max() < 1e-3
    import struct

    pcm24 = b"".join(int(v * 8388607).to_bytes(3, "little", signed=True) for v in (0.5, -0.5))
    head = lambda kind, ch, bits, size: b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, ch, 8000, 8000 * ch * bits // 8, ch * bits // 8, bits) + b"data" + struct.pack("<I", size)
    assert signals.decode_wav(head(1, 1, 24, 6) + pcm24)[1] == pytest.approx([0.5, -0.5], abs=1e-5)
    stereo = np.array([[2.0, 0.0], [-0.5, 0.5]], "<f4").tobytes()
    assert signals.decode_wav(head(3, 2, 32, 16) + stereo)[1] == pytest.approx([0.5, 0.0])
    with pytest.raises(ValueError, match="NaN"):
        signals.decode_wav(head(3, 1, 32, 4) + np.array([np.nan], "<f4").tobytes())
    assert signals.hashes_of([0.0, -0.0])[0] == signals.hashes_of([0.0, 0.0])[0]


def test_tree_and_registry(spark, tmp_path):
    for folder, name in (("drone/s1/near", "a.wav"), ("drone/s2", "b.wav"), ("noise", "c.wav")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_bytes(signals.encode_wav(16000, tone()))
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.labelled_tree(spark, f"file:{tmp_path}", {"drone": 1, "noise": 0}).collect()}
    assert (rows["a.wav"].label, rows["a.wav"].source_group, rows["a.wav"].condition, rows["c.wav"].source_group) == (1, "s1", "near", None)
    registry = spark.createDataFrame([("s1", "lab")], "source_group string, provenance string")
    with pytest.raises(ValueError, match="s2"):
        readers.registered_tree(spark, f"file:{tmp_path}", {"drone": 1}, registry)


def test_corpus_scan(spark, tmp_path):
    rows = [(1, {"bytes": signals.encode_wav(16000, tone()), "path": "x"}), (0, {"bytes": signals.encode_wav(16000, np.zeros(100)), "path": "y"}), (0, {"bytes": b"junk", "path": "z"})]
    spark.createDataFrame(rows, "label int, audio struct<bytes: binary, path: string>").write.parquet(str(tmp_path / "c"))
    got = {r.path: r.status for r in readers.corpus(spark, str(tmp_path / "c")).collect()}
    assert got == {"x": "kept", "y": "silent", "z": "undecodable"}
    assert readers.corpus_hashes(spark, str(tmp_path / "c")).count() == 3


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.wav", b"1")
        z.writestr("e/x.wav", b"2")
        z.writestr("readme.txt", b"3")
    members = readers.zip_members(spark, f"file:{tmp_path}", ".wav")
    assert sorted(r.member for r in members.collect()) == ["d/x.wav", "e/x.wav"]
    assert readers.unique_basenames(members).first().members == 2
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.wav", b"1")
    with pytest.raises(PySparkException, match="leads outside"):
        readers.zip_members(spark, f"file:{tmp_path}", ".wav").collect()


def test_lists_and_manifests(spark, tmp_path):
    good = tmp_path / "h.txt"
    good.write_text(f"{'a' * 64}\n\n{'a' * 64}\n{'b' * 64}\n")
    assert readers.hash_list(spark, str(good)).count() == 2
    bad = tmp_path / "b.txt"
    bad.write_text("xyz\n")
    with pytest.raises(PySparkException, match="not a SHA-256"):
        readers.hash_list(spark, str(bad)).collect()
    sums = tmp_path / "m.txt"
    sums.write_text("d41d8  some file.zip\n")
    assert tuple(readers.checksum_list(spark, str(sums)).first()) == ("d41d8", "some file.zip")
    csv = tmp_path / "m.csv"
    csv.write_text("split,label\ntrain,1\ntest,0\n")
    assert readers.manifest(spark, str(csv), "split string, label int", "train").first().label == 1
    with pytest.raises(ValueError, match="no rows"):
        readers.manifest(spark, str(csv), "split string, label int", "val")
    csv.write_text("split,label\ntrain,one\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|For input string"):
        readers.manifest(spark, str(csv), "split string, label int").collect()


def test_arrays_and_reports(spark, tmp_path):
    buffer = io.BytesIO()
    np.save(buffer, np.arange(6, dtype=np.float32).reshape(2, 3))
    (tmp_path / "x.npy").write_bytes(buffer.getvalue())
    assert [r.samples for r in readers.array_rows(spark, f"file:{tmp_path}").orderBy("cache_index").collect()] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    (tmp_path / "r.json").write_text('{"seed": 42, "model_type": "m", "threshold_metrics": [{"threshold": 0.5, "f1": 0.9}]}')
    rows = readers.metric_reports(spark, str(tmp_path / "r.json"))
    assert [(r.seed, r.metric, r.value, r.threshold) for r in rows.collect()] == [(42, "f1", 0.9, 0.5)]
    with pytest.raises(ValueError, match="seeds"):
        readers.expected_runs(rows, [42, 43])


def test_sinks_refuse_what_exists(spark, tmp_path):
    df = spark.range(3)
    writers.write_table(df, str(tmp_path / "t"), expected_rows=3)
    with pytest.raises(PySparkException):
        writers.write_table(df, str(tmp_path / "t"))
    writers.write_report({"passed": True}, str(tmp_path / "r.json"))
    with pytest.raises(FileExistsError):
        writers.write_report({}, str(tmp_path / "r.json"))
    assert writers.column_union([df, spark.range(1).withColumn("x", F.lit(1))]).columns == ["id", "x"]
    cache = spark.createDataFrame([("train", [0.0, 1.0])], "split string, samples array<float>")
    assert writers.write_array_cache(cache, str(tmp_path / "c"), "samples", 2, {"train": 1}).count() == 1
    assert "| id |" in writers.markdown_table(df)


def test_signal_functions(spark):
    df = spark.createDataFrame([(tone().tolist(), (0.5 * tone(f=2000.0)).tolist())], "a array<float>, b array<float>")
    fp = signals.spectral_fingerprint(16000)
    r = df.select(fp("a").alias("x"), fp(F.transform("a", lambda v: v * F.lit(0.5).cast("float"))).alias("y"), signals.gain_invariant_hash("h")("a").alias("p"), signals.gain_invariant_hash("h")(F.transform("a", lambda v: v * F.lit(0.5).cast("float"))).alias("q")).first()
    assert np.dot(r.x, r.y) == pytest.approx(1.0, abs=1e-3) and r.p == r.q
    e = df.select(signals.band_energy(16000, (0, 500, 2500, 8000))("b").alias("e")).first().e
    assert np.argmax(e.shares) == 1 and e.above == pytest.approx(sum(e.shares[1:]))
    m = df.select(signals.mix_at_snr("a", "b", F.lit(6.0)).alias("m")).first().m
    assert max(map(abs, m.mixed)) <= 0.9901 and m.gain <= 1
    ci = spark.createDataFrame([(5, 10), (0, 10), (10, 10), (0, 0)], "k int, n int").select(signals.clopper_pearson("k", "n").alias("c")).collect()
    assert ci[0].c.low == pytest.approx(0.18708603, abs=1e-7) and ci[1].c.low == 0.0 and ci[2].c.high == 1.0 and ci[3].c.low is None
    v = df.select(signals.wav_info(F.lit(bytearray(signals.encode_wav(8000, tone()))).cast("binary")).alias("i")).first().i
    assert (v.rate, v.channels, v.bits, v.frames) == (8000, 1, 16, 800)


def spelt_out_harmonics(x, rate, n_fft, bands=32, harmonics=12):
    """The features of one segment, number by number."""
    x = np.asarray(x, float) - np.mean(x)
    power = np.abs(np.fft.rfft(x * np.hanning(rate), n_fft)) ** 2 + 1e-12
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    half = rate / 2
    p, g = zip(*[(a, b) for a, b in zip(power, f, strict=True) if 20 <= b <= half], strict=True)
    p, g = np.array(p), np.array(g)
    q = p / p.sum()
    centre = (q * g).sum()
    out = [np.log10((x * x).mean() + 1e-12), centre / half, np.sqrt((q * (g - centre) ** 2).sum()) / half, np.exp(np.log(p).mean()) / p.mean(), -(q * np.log(q + 1e-12)).sum() / np.log(len(q))]
    for share in (0.5, 0.85, 0.95):
        acc = 0.0
        for a, b in zip(p, g, strict=True):
            acc += a
            if acc >= share * p.sum():
                out.append(b / half)
                break
    edges = np.geomspace(20, half, bands + 1)
    level = np.array([np.log10(power[(f >= a) & (f < b)].mean() + 1e-12) for a, b in zip(edges, edges[1:], strict=False)])
    out += (level - level.mean()).tolist()

    def search(residual, low, high, last, n):
        best = (-np.inf, 0, None)
        for c in range(low, high + 1):
            ks = [k for k in range(1, n + 1) if c * k <= last]
            score = sum(residual[c * k] / np.sqrt(k) for k in ks) / sum(1 / np.sqrt(k) for k in ks)
            if score > best[0]:
                best = (score, c, [residual[c * k] if k in ks else 0.0 for k in range(1, n + 1)])
        return best

    def floorless(v, width):
        return v - np.convolve(v, np.ones(width) / width, "same")

    step = rate / n_fft
    last = max(i for i, b in enumerate(f) if b <= 6000)
    residual = floorless(np.log10(power), 41)
    score, c, profile = search(residual, int(np.ceil(40 / step)), int(500 // step), last, harmonics)
    scale = residual[20:last].std()
    profile = np.array(profile) / scale
    out += [c * step / 500, score / scale, (profile > 1).mean(), profile.mean(), profile.std(), *profile]
    pitches, scores = [], []
    for part in np.split(x, 4):
        r = floorless(np.log10(np.abs(np.fft.rfft(part * np.hanning(len(part)), n_fft // 4)) ** 2 + 1e-12), 21)
        wide = rate / (n_fft // 4)
        s, c, _ = search(r, int(40 / wide), int(500 / wide), int(6000 / wide), 8)
        pitches.append(c * wide / 500)
        scores.append(s / scale)
    return np.array([*out, np.mean(pitches), np.std(pitches), np.mean(scores), np.std(scores)])


def test_harmonic_features_against_the_formulas(spark):
    rng = np.random.default_rng(5)
    t = np.arange(16000) / 16000
    x = sum(np.sin(2 * np.pi * 120 * k * t) / k for k in range(1, 9)) + 0.1 * rng.normal(size=16000)
    y = np.concatenate([np.sin(2 * np.pi * 100 * t[:4096]), np.sin(2 * np.pi * 300 * t[4096:])]) + 0.01 * rng.normal(size=16000)
    got = signals.harmonics_of(np.stack([x, y]))
    assert got.shape == (2, signals.HARMONIC_FEATURES)
    for row, v in zip(got, (x, y), strict=True):
        assert row == pytest.approx(spelt_out_harmonics(v, 16000, 16384), abs=2e-4)
    assert got[0, 40] * 500 == pytest.approx(120, abs=1.5) and got[1, 40] * 500 == pytest.approx(300, abs=1.5)  # the whole segment counts
    assert got[0, 58] < got[1, 58]  # the steady pitch
    df = spark.createDataFrame([(x.tolist(),)], "a array<double>").select(signals.harmonic_features()("a").alias("h")).first()
    assert np.allclose(df.h, got[0], atol=1e-5)
    with pytest.raises(ValueError):
        signals.harmonics_of(np.zeros((1, 100)))


@pytest.mark.parametrize(("rate", "n_fft"), [(2000, 2048), (800, 1024)])
def test_harmonic_features_where_the_spectrum_ends_below_the_last_harmonic(rate, n_fft):
    t = np.arange(rate) / rate
    x = np.sin(2 * np.pi * 90 * t) + 0.5 * np.sin(2 * np.pi * 180 * t) + 0.01 * np.random.default_rng(7).normal(size=rate)
    got = signals.harmonics_of(x[None], rate, n_fft)[0]
    assert got.shape == (signals.HARMONIC_FEATURES,) and np.isfinite(got).all()

    def residual(v, n, width):
        log = np.log10(np.abs(np.fft.rfft(v * np.hanning(len(v)), n)) ** 2 + 1e-12)
        return log - np.convolve(log, np.ones(width) / width, "same")

    def search(r, low, high, n):
        scores = {}
        for c in range(low, min(high, len(r) - 1) + 1):
            ks = [k for k in range(1, n + 1) if c * k < len(r)]  # all there is of the spectrum
            scores[c] = sum(r[c * k] / np.sqrt(k) for k in ks) / sum(1 / np.sqrt(k) for k in ks)
        best = max(scores, key=scores.get)
        return best, scores[best]

    x = x - x.mean()
    step, whole = rate / n_fft, residual(x, n_fft, 41)
    scale = whole[20:-1].std()
    place, score = search(whole, int(np.ceil(40 / step)), int(500 / step), 12)
    assert got[40:42] == pytest.approx([place * step / 500, score / scale], abs=1e-4)
    found = [search(residual(part, n_fft // 4, 21), int(40 / (4 * step)), int(500 / (4 * step)), 8) for part in np.split(x, 4)]
    pitches, scores = np.array([[c * 4 * step / 500, s / scale] for c, s in found]).T
    assert got[57:] == pytest.approx([pitches.mean(), pitches.std(), scores.mean(), scores.std()], abs=1e-4)


def test_harmonic_features_query_gives_its_values(spark, tiny):
    from lumenfold.plans.catalogue import QUERIES

    rows = QUERIES["harmonic_features"](spark, tiny).collect()  # a count would leave the features out
    assert len({r.doc_id for r in rows}) == len(rows) == 200
    assert all(len(r.h) == signals.HARMONIC_FEATURES and np.isfinite(r.h).all() for r in rows)


def test_harmonic_features_query_keeps_repeated_rows_and_rows_without_a_length(spark, tmp_path):
    import duckdb

    from lumenfold.plans.catalogue import ORACLE_SQL, QUERIES
    from tests.compare import rows

    docs = [(1, 40), (1, 40), (2, None), (3, 340), (None, 0), *((k, k * 37) for k in range(4, 44))]
    spark.createDataFrame(docs, "doc_id long, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.sql(ORACLE_SQL["harmonic_features"]).df()
    got = QUERIES["harmonic_features"](spark, str(tmp_path)).toPandas()
    assert len(got) == 45 and rows(got) == rows(want)
    h = {r.doc_id: r.h for r in got.itertuples()}
    assert h[2] is None and (h[1] == h[3]).all()


def test_gain_invariant_hash_is_of_header_and_pcm(spark):
    import hashlib

    x = np.array([0.25, -0.5, 0.1], np.float32)
    df = spark.createDataFrame([(x.tolist(),), ((x * 0.5).tolist(),)], "a array<float>")
    full, plain = (df.select(signals.gain_invariant_hash("p1", 16000, n)("a").alias("h")).collect() for n in (True, False))
    pcm = np.rint(np.clip(x / 0.5, -1, 1 - 1 / 32768) * 32768).astype("<i2").tobytes()
    assert full[0].h == full[1].h == hashlib.sha256(b"p1|rate=16000|samples=3|gain_normalized=1|" + pcm).hexdigest() and plain[0].h != plain[1].h


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(scalars.snr_label(F.lit(10))) == "snr_+10_db"
    assert get(scalars.stem(F.lit("a/b.c.wav"))) == "b.c"
    assert tuple(get(scalars.named_parts(F.lit("1-100032-A-0.wav"), *scalars.CLIP))) == (1, 100032, "A", 0)
    assert get(scalars.named_parts(F.lit("x"), *scalars.CLIP)) is None
    assert get(scalars.sigmoid(F.lit(-1000.0))) == 0.0 and get(scalars.sigmoid(F.lit(1000.0))) == 1.0
    assert get(scalars.fitted_length(F.array(*[F.lit(i) for i in range(5)]), 3)) == [1, 2, 3]
    assert get(scalars.fitted_length(F.array(F.lit(1), F.lit(2)), 5)) == [1, 2, 1, 2, 1]
    assert get(scalars.peak_normalised(F.array(F.lit(0.0), F.lit(-2.0)))) == [0.0, -1.0]
    assert get(scalars.degenerate(F.array(F.lit(0.5), F.lit(0.5))))
    with pytest.raises(PySparkException, match="sample range"):
        get(scalars.sliced(F.array(F.lit(1.0).cast("float")), F.lit(0), F.lit(2)))
    assert "lf_compact" in scalars.register(spark) and spark.sql("SELECT lf_compact('A-b 1')").first()[0] == "ab1"


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    events = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:05", "2024-01-01 00:50", "2024-01-01 03:00"]), "v": [1.0, 9.0, 2.0], "h": ["a", "b", "a"]})
    spark.createDataFrame(events).write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, v double, h string").parquet(str(source))
    out = alarms.run_to_end(alarms.tumbling_rates(stream, "ts", "v", 5.0), "rates", str(tmp_path / "c1"), "append").collect()
    assert [(r.rows, r.alarms) for r in out] == [(2, 1)]
    clean = alarms.run_to_end(alarms.clean_stream(stream, "h", spark.createDataFrame([("b",)], "sha256 string")), "clean", str(tmp_path / "c2"))
    assert clean.count() == 2
    assert alarms.run_to_end(alarms.first_seen(stream, "h", "ts", "12 hours"), "first", str(tmp_path / "c3")).count() == 2
