"""Interfaces to encoders, codecs and vision-language models, and how each is mapped over a DataFrame.

A factory is called once for each task, so a model is loaded once and serves all its batches.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as tx


class TextEncoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class AudioEncoder(Protocol):
    def encode(self, waves: list[np.ndarray]) -> np.ndarray: ...


class Decoder(Protocol):
    def decode(self, path: str, content: bytes, rate: int, seconds: float) -> np.ndarray | None: ...


class VlmClient(Protocol):
    def describe(self, image: bytes) -> str: ...


class FrameSource(Protocol):
    def metadata(self, path: str) -> dict: ...

    def grab(self, path: str, frame: int) -> np.ndarray | None: ...


@dataclass(frozen=True)
class HashedEncoder:
    """A deterministic stand-in for a text encoder: hashed words, signed.  For tests and demonstrations, not for quality."""

    width: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.width))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % self.width] += 1 if h >> 16 & 1 else -1
        return out


def encode_texts(df: DataFrame, column: str, factory: Callable[[], TextEncoder], out: str = "emb") -> DataFrame:
    """``df`` with the embedding of a text column."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series(list(model.encode([x or "" for x in texts]).astype(np.float32)), index=texts.index)

    return df.withColumn(out, encode(F.col(column)))


def encode_audio(files: DataFrame, decoder: Callable[[], Decoder], encoder: Callable[[], AudioEncoder], rate: int = 48000, seconds: float = 120.0, batch: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, audio_emb, ok) of ``files`` (path, content): mono waves of ``seconds`` at most; a file that can't be decoded is marked, not dropped.

    The encoder gets ``batch`` waves at once; columns to ``keep`` come along, so that nothing needs to be joined.
    """
    kinds = dict(files.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dec, enc = decoder(), encoder()
        for frame in frames:
            paths, contents, rows = frame["path"].tolist(), frame["content"].tolist(), []
            for a in range(0, len(frame), batch):
                waves = [dec.decode(p, bytes(c or b""), rate, seconds) for p, c in zip(paths[a : a + batch], contents[a : a + batch])]
                good = [w for w in waves if w is not None and len(w)]
                vectors = iter(enc.encode(good)) if good else iter(())
                rows += [next(vectors).astype(np.float32) if w is not None and len(w) else None for w in waves]
            # one frame out for one in: vectors are small beside the contents, and a frame of a few rows costs more than they do
            yield pd.DataFrame({"path": paths, "audio_emb": rows, "ok": [r is not None for r in rows], **{c: frame[c] for c in keep}})

    return files.select("path", "content", *keep).mapInPandas(run, ", ".join(["path string, audio_emb array<float>, ok boolean", *(f"{c} {kinds[c]}" for c in keep)]))


def grab_frames(wanted: DataFrame, source: Callable[[], FrameSource], features: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """``wanted`` (video_id, path, scene_id, sample_no, frame_idx) with read_ok and ``features`` (columns of ``schema``) of each frame.

    A frame that can't be read is tried again as frame 0 by the source's own choice, else its features are null.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src = source()
        for frame in frames:
            found = [src.grab(p, int(i)) for p, i in zip(frame["path"], frame["frame_idx"])]
            told = [features(x) if x is not None else {} for x in found]
            yield frame.assign(read_ok=[x is not None for x in found], **{n: [t.get(n) for t in told] for n in names})

    kinds = ", ".join(f"{n} {k}" for n, k in wanted.dtypes)
    return wanted.mapInPandas(run, f"{kinds}, read_ok boolean, {schema}")


def grey_features(frame: np.ndarray, black: int = 25, white: int = 225) -> dict:
    """Statistics of a frame (height x width x 3): brightness, uniformity, edges and texture by plain differences.

    Edge density is the share of pixels whose gradient exceeds 50, texture the variance of the 4-neighbour Laplacian.
    """
    grey = frame.astype(np.float64) @ np.array([0.114, 0.587, 0.299])
    lap = np.zeros_like(grey)
    lap[1:-1, 1:-1] = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]
    gy, gx = np.gradient(grey) if min(grey.shape) > 1 else (np.zeros_like(grey), np.zeros_like(grey))
    return {
        "mean_brightness": float(grey.mean()), "std_brightness": float(grey.std()), "color_std": float(frame.std(axis=(0, 1)).mean()),
        "edge_density": float((np.hypot(gx, gy) > 50).mean()), "lap_var": float(lap.var()), "p_black": float((grey < black).mean()),
        "p_white": float((grey > white).mean()), "uniform_ratio": float((np.abs(grey - np.median(grey)) < 4).mean()),
    }


FRAME_FEATURES = "mean_brightness double, std_brightness double, color_std double, edge_density double, lap_var double, p_black double, p_white double, uniform_ratio double"


def colour_histogram(frame: np.ndarray, bins: int = 8) -> list[float]:
    """Counts of a frame's colours in bins x bins x bins cells."""
    cell = (frame.astype(np.int64) * bins // 256).reshape(-1, 3)
    return np.bincount(cell @ np.array([bins * bins, bins, 1]), minlength=bins**3).astype(float).tolist()


@dataclass(frozen=True)
class HttpVlm:
    """A vision-language model behind an OpenAI-style chat endpoint; three tries with a pause, then an empty reply."""

    url: str
    prompt: str
    tries: int = 3
    timeout: float = 90.0
    pause: float = 2.0

    def describe(self, image: bytes) -> str:
        picture = "data:image/jpeg;base64," + base64.b64encode(image).decode()
        body = {"messages": [{"role": "user", "content": [{"type": "text", "text": self.prompt}, {"type": "image_url", "image_url": {"url": picture}}]}], "temperature": 0.1}
        for k in range(self.tries):
            try:
                request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    told = json.load(reply)["choices"][0]["message"]
                return told.get("content") or told.get("reasoning_content") or ""
            except (OSError, ValueError, KeyError, IndexError):
                if k + 1 < self.tries:
                    time.sleep(self.pause)
        return ""


@dataclass(frozen=True)
class CommandVlm:
    """A vision-language model run as a command for each image; ``command`` gets the image on its standard input."""

    command: tuple[str, ...]
    timeout: float = 300.0

    def describe(self, image: bytes) -> str:
        import subprocess

        try:
            return subprocess.run(self.command, input=image, capture_output=True, timeout=self.timeout, check=True).stdout.decode("utf-8", "replace")
        except (OSError, subprocess.SubprocessError):
            return ""


def describe_frames(frames: DataFrame, client: Callable[[], VlmClient], at_once: int | None = None) -> DataFrame:
    """``frames`` (scene_id, image, ...) with the parsed reply for each image; ``at_once`` bounds how many are asked at the same time."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vlm = client()
        for images in batches:
            yield pd.Series([vlm.describe(bytes(x)) if x is not None else None for x in images], index=images.index)

    spread = frames.repartition(at_once) if at_once else frames
    return spread.withColumn("raw", ask(F.col("image"))).withColumn("parsed", tx.parse_reply(F.col("raw")))
