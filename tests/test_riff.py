"""Headers of WAV files in Columns against Python's wave module."""

import io
import random
import struct
import wave

import pytest

from kinloom.operators import riff


def chunk(name, body, length=None):
    return name + struct.pack("<I", len(body) if length is None else length) + body + b"\0" * (len(body) % 2)


def wav(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def form(rate=16000, channels=1, bits=16, tag=1, byte_rate=None, more=b""):
    block = channels * bits // 8
    return chunk(b"fmt ", struct.pack("<HHIIHH", tag, channels, rate, rate * block if byte_rate is None else byte_rate, block, bits) + more)


def plain(data):
    """(rate, channels, bits, frames), as wave has them."""
    with wave.open(io.BytesIO(data)) as w:
        return w.getframerate(), w.getnchannels(), 8 * w.getsampwidth(), len(w.readframes(w.getnframes())) // (w.getnchannels() * w.getsampwidth())


@pytest.fixture(scope="module")
def probed(spark):
    rng = random.Random(1)
    files = {"plain": wav(form(), chunk(b"data", bytes(3200))), "odd": wav(chunk(b"LIST", b"abc"), form(), chunk(b"x\0\0\0", b"1"), chunk(b"data", bytes(801)))}
    for k in range(25):
        chunks = [chunk(rng.choice([b"LIST", b"bext", b"data"[::-1]]), rng.randbytes(rng.randint(0, 9))) for _ in range(rng.randint(0, 5))]
        chunks.insert(rng.randint(0, len(chunks)), form(rng.choice([8000, 44100, 48000]), rng.choice([1, 2, 6]), rng.choice([8, 16, 24, 32])))
        files[f"r{k}"] = wav(*chunks, chunk(b"data", rng.randbytes(rng.randint(0, 5000)))) + rng.randbytes(rng.randint(0, 9))
    files |= {"many": wav(*[chunk(b"junk", b"fmt data")] * 700, form(), chunk(b"data", bytes(320))), "cut": wav(form(), chunk(b"data", bytes(999), 32000)), "stream": wav(form(), chunk(b"data", bytes(640), 0xFFFFFFFF))}
    odd = {
        "none": b"", "null": None, "text": b"not audio at all", "rifx": b"RIFX" + wav(form())[4:], "no format": wav(chunk(b"data", bytes(9))), "no data": wav(form(), chunk(b"LIST", b"ab")), "half": wav(form())[:30],
        "undeclared": wav(form(byte_rate=0), chunk(b"data", bytes(32000))), "blank": wav(form(rate=0, byte_rate=0), chunk(b"data", bytes(320))), "silent": wav(form(byte_rate=0), chunk(b"data", b"")),
        "float": wav(form(tag=3, bits=32), chunk(b"data", bytes(64))), "ext": wav(form(tag=0xFFFE, more=struct.pack("<HHIH14s", 22, 16, 4, 1, bytes(14))), chunk(b"data", bytes(64))), "law": wav(form(tag=7, bits=8), chunk(b"data", bytes(64))),
    }
    df = spark.createDataFrame([(k, v) for k, v in (files | odd).items()], "path string, content binary").repartition(3)
    return files, odd, {r["path"]: r for r in riff.probe(df).collect()}


def test_headers_are_those_that_wave_reads(probed):
    files, odd, got = probed
    assert len(got) == len(files) + len(odd)
    for k, data in files.items():
        rate, channels, bits, frames = plain(data)
        r = got[k]
        assert (r["sample_rate_hz"], r["channels"], r["bits"], r["frames"], r["probe_error"]) == (rate, channels, bits, frames, None), k
        assert r["duration_sec"] == (pytest.approx(frames / rate, abs=6e-4) if frames else None) and r["size_bytes"] == len(data)
        assert r["bitrate_kbps"] == pytest.approx(rate * channels * bits / 1000, abs=0.06) and r["bitrate_source"] == "declared"


def test_damaged_files_say_what_is_missing(probed):
    _, odd, got = probed
    assert {k: got[k]["probe_error"] for k in ("none", "null", "text", "rifx", "no format", "no data", "half")} == {
        "none": "probe failed: no RIFF header", "null": "probe failed: no RIFF header", "text": "probe failed: no RIFF header", "rifx": "probe failed: no RIFF header", "no format": "probe failed: no format",
        "no data": "probe failed: no data", "half": "probe failed: no format",
    }
    assert all(got[k]["bitrate_kbps"] is None and got[k]["duration_sec"] is None and got[k]["codec"] is None for k in ("none", "null", "text", "no data"))


def test_a_bitrate_that_is_not_declared_is_derived(probed):
    _, odd, got = probed
    assert (got["undeclared"]["bitrate_kbps"], got["undeclared"]["bitrate_source"]) == (round(len(odd["undeclared"]) * 8 / 1000, 1), "derived from size/duration")
    assert [got[k]["bitrate_source"] for k in ("blank", "silent")] == [None, None] and got["blank"]["bitrate_kbps"] is None
    assert [got[k]["codec"] for k in ("plain", "float", "ext", "law")] == ["pcm_s16le", "pcm_f32le", "pcm_s16le", "pcm_mulaw"]
