"""Media files: directory listings and 16-bit PCM clips."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_inputs(
    spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".mp4", ".mkv", ".mov"), *, max_mb: int = 4096
) -> DataFrame:
    """Files directly in a folder with an allowed extension, in name order; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    f = f.withColumn("name", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))
    suffix = F.concat(F.lit("."), F.lower(F.element_at(F.split("name", r"\."), -1)))
    f = f.where(suffix.isin(*[e.lower() for e in extensions]))
    ok = F.col("length") <= max_mb * 1024 * 1024
    return f.select(
        "name", "length", F.when(ok, "").otherwise("exceeds_max_size").alias("problem")
    ).orderBy(F.lower("name"), "name")


def reject_without_audio(inputs: DataFrame, probes: DataFrame) -> DataFrame:
    """Mark inputs whose probe metadata (name, has_audio) shows no audio stream."""
    p = inputs.join(probes.select("name", "has_audio"), "name", "left")
    silent = ~F.coalesce("has_audio", F.lit(False))
    return p.withColumn("problem", F.when((F.col("problem") == "") & silent, "no_audio_stream").otherwise(F.col("problem"))).drop("has_audio")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """WAV files as (clip_id=path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select(F.col("path").alias("clip_id"), "content")


def _decode(content: bytes) -> tuple[int, int, list[int] | None]:
    with wave.open(io.BytesIO(content), "rb") as w:
        if w.getsampwidth() != 2:
            return w.getframerate(), w.getnchannels(), None
        return w.getframerate(), w.getnchannels(), np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").tolist()


def decode_wav(files: DataFrame) -> DataFrame:
    """(clip_id, content) -> (clip_id, sample_rate, channels, samples[]); other sample widths are left out."""
    key = files.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(k, *_decode(c)) for k, c in zip(pdf["clip_id"], pdf["content"])]
            yield pd.DataFrame(got, columns=["clip_id", "sample_rate", "channels", "samples"])

    out = files.select("clip_id", "content").mapInPandas(run, f"clip_id {key}, sample_rate int, channels int, samples array<int>")
    return out.where("samples IS NOT NULL")


def encode_wav(clips: DataFrame) -> DataFrame:
    """(clip_id, sample_rate, samples[]) -> (clip_id, content) as mono 16-bit WAV."""
    key = clips.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rate, samples in zip(pdf["sample_rate"], pdf["samples"]):
                buf = io.BytesIO()
                with wave.open(buf, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(int(rate))
                    w.writeframes(np.asarray(samples, dtype="<i2").tobytes())
                out.append(buf.getvalue())
            yield pd.DataFrame({"clip_id": pdf["clip_id"], "content": out})

    return clips.select("clip_id", "sample_rate", "samples").mapInPandas(run, f"clip_id {key}, content binary")
