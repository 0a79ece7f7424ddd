"""Headers of RIFF/WAVE files: duration, embedded description, embedded category, in one pass over the chunks."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("UCS_CATID", "CATEGORY", "SUBCATEGORY")
HEADER = "path string, size long, duration double, sample_rate int, channels int, bit_depth int, embedded string, metadata_catid string"


def chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, size) of each chunk of a WAVE file; ends at the first that is cut off."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return
    at = 12
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def description(data: bytes) -> str:
    """The description of the ``bext`` chunk; empty without one."""
    for name, at, size in chunks(data):
        if name == b"bext":
            return data[at : at + min(256, size)].rstrip(b"\0").decode("latin-1").strip()
    return ""


def category(data: bytes) -> str | None:
    """The category of the ``iXML`` chunk; the first tag holds even if it is empty, the others if they are not."""
    for name, at, size in chunks(data):
        if name == b"iXML":
            xml = data[at : at + size].decode("utf-8", "ignore")
            if found := re.search("<IXML:CATEGORY>(.*?)</IXML:CATEGORY>", xml):
                return found.group(1).strip()
            for tag in TAGS:
                if (found := re.search(f"<{tag}>(.*?)</{tag}>", xml)) and found.group(1).strip():
                    return found.group(1).strip()
    return None


def sound(data: bytes, size: int | None = None) -> dict:
    """duration (null if unknown), sample_rate, channels, bit_depth (48000, 2, 16 without a format chunk)."""
    out = {"duration": None, "sample_rate": 48000, "channels": 2, "bit_depth": 16}
    block = 0
    for name, at, n in chunks(data):
        if name == b"fmt " and at + 16 <= len(data):
            _, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", data, at)
            out |= {"sample_rate": rate or 48000, "channels": channels or 2, "bit_depth": bits or 16}
        elif name == b"data" and block and out["sample_rate"]:
            out["duration"] = n // block / out["sample_rate"]
    return out


def header_of(path: str, data: bytes, probe: Callable[[str, bytes], float | None] | None = None) -> dict:
    """The fields of ``HEADER`` for one file."""
    told = sound(data)
    if told["duration"] is None and probe is not None:
        told["duration"] = probe(path, data)
    return {"path": path, "size": len(data), **told, "embedded": description(data), "metadata_catid": category(data)}


def headers(files: DataFrame, probe: Callable[[str, bytes], float | None] | None = None) -> DataFrame:
    """``HEADER`` of ``files`` (path, content): a file that is no WAVE file has what ``probe`` gives as its duration.

    Chunks may follow the sound's bytes, so the whole content is looked at.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [header_of(path, bytes(data or b""), probe) for path, data in zip(frame["path"], frame["content"])]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in HEADER.split(", ")])

    return files.select("path", F.col("content")).mapInPandas(read, HEADER)
