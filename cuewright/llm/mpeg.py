"""Op 2: MPEG audio as a media column: frames, tags, variable-bitrate tables, checksums, durations, seek offsets.

Reading (``parse``): an ID3v2 tag at the front and an ID3v1 tag at the end are parsed and
skipped, the latter only where no frame holds its place; frame headers of MPEG-1, 2 and 2.5, layers I to III are followed by their lengths;
where a header is not valid, or disagrees with the stream, the reader moves on to the next place where two
frames in a row fit together (resynchronisation); a first frame with a Xing, Info or VBRI table
holds no samples and gives its counts and seek points, which are held against the frames that are found (``table_check``); protected frames' CRC-16 is verified, over the header and what
their layer protects: bit allocation (I), bit allocation and scale factor selection (II), side information (III).
The duration is exact: samples over sampling rate, as whole numbers.  Seek offsets are the byte
offsets of all frames.  A stream of free format (no bit rate in its headers) is not followed: its frames count as none.

Writing (``carry``): 576 payload bytes to a frame of MPEG-2 layer III, mono, 16 kHz, 144 kbit/s.  Its side
information gives a main-data length of 0, so a player hears silence and the bytes are ancillary
data, kept as they are; a frame lasts 576 samples, one for each byte.  An ID3v2 tag names the
payload's length and CRC-32, and an Info frame holds the number of frames and bytes and 100 seek points.

Defined results: a null text is empty; an empty text is one frame of bytes 255; bytes that hold
no frame give zero frames and a duration of 0; a broken header or checksum is counted, never
raised; equal bytes give equal values; rows may repeat; other columns are not read, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of ISO/IEC 11172-3 and 13818-3: bit rates in kbit/s by index 1 to 14, sampling rates in Hz by index.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
UNIT = 576
# Layer II: bits of the allocation by subband.  MPEG-1's four tables (B.2a to d of 11172-3), then that of 13818-3.
ALLOCATION = ([4] * 11 + [3] * 12 + [2] * 4, [4] * 11 + [3] * 12 + [2] * 7, [4] * 2 + [3] * 6, [4] * 2 + [3] * 10, [4] * 4 + [3] * 7 + [2] * 19)


class Header:
    """A frame header's fields; ``of`` gives None for four bytes that are none."""

    __slots__ = ("version", "layer", "protected", "bitrate", "rate", "padding", "mono", "bound", "samples", "size", "side")
    _seen: dict[bytes, "Header | None"] = {}

    @classmethod
    def of(cls, raw: bytes) -> "Header | None":
        if raw not in cls._seen:
            if len(cls._seen) > 4096:
                cls._seen.clear()
            cls._seen[raw] = cls._read(raw)
        return cls._seen[raw]

    @classmethod
    def _read(cls, raw: bytes) -> "Header | None":
        if len(raw) < 4 or raw[0] != 255 or raw[1] < 0xE0:
            return None
        version, layer, rate, bits = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 2 & 3, raw[2] >> 4
        if version == 1 or layer == 4 or rate == 3 or bits in (0, 15) or raw[3] & 3 == 2:
            return None
        h = cls()
        h.version, h.layer, h.protected = version, layer, not raw[1] & 1
        h.bitrate = BITRATES[1 if version == 3 else 2, layer][bits - 1]
        h.rate, h.padding, h.mono = RATES[version][rate], raw[2] >> 1 & 1, raw[3] >> 6 == 3
        h.bound = 4 + 4 * (raw[3] >> 4 & 3) if raw[3] >> 6 == 1 else 32  # joint stereo: subbands from here on share their allocation
        h.samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
        if layer == 1:
            h.size = (12000 * h.bitrate // h.rate + h.padding) * 4
        else:
            h.size = h.samples // 8 * 1000 * h.bitrate // h.rate + h.padding
        h.side = (32, 17)[h.mono] if version == 3 else (17, 9)[h.mono]
        return h

    def fits(self, other: "Header") -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


def _crc_table() -> list[int]:
    table = []
    for x in range(256):
        x <<= 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005) & 0xFFFF if x & 0x8000 else x << 1
        table.append(x)
    return table


_CRC = _crc_table()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for x in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ x]
    return crc


def protected_bits(frame: bytes, h: Header) -> int:
    """How many bits after the checksum it covers, beside the header."""
    channels = 2 - h.mono
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (h.bound * channels + 32 - h.bound)
    each = h.bitrate // channels
    if h.version != 3:
        widths = ALLOCATION[4]
    elif each <= 48:
        widths = ALLOCATION[3 if h.rate == 32000 else 2]
    else:
        widths = ALLOCATION[0 if each <= 80 or h.rate == 48000 else 1]
    bits, at, used = int.from_bytes(frame[6:].ljust(64, b"\0")[:64], "big"), 0, 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < h.bound else 1):
            at += width
            if bits >> 512 - at & (1 << width) - 1:
                used += 1 if band < h.bound else channels
    return at + 2 * used


def checksum_holds(frame: bytes, h: Header) -> bool:
    """Whether a protected frame's CRC-16 is right."""
    n = protected_bits(frame, h)
    if 8 * (len(frame) - 6) < n:
        return False
    crc = crc16(frame[2:4] + frame[6 : 6 + n // 8])
    for k in range(n % 8):
        bit = frame[6 + n // 8] >> 7 - k & 1
        crc = crc << 1 & 0xFFFF ^ (0x8005 if crc >> 15 ^ bit else 0)
    return crc == frame[4] << 8 | frame[5]


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _text(raw: bytes) -> str:
    """An ID3v2 text field: its encoding's number, then the text."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(kind, "replace").rstrip("\0")


def read_tags(data: bytes) -> tuple[dict[str, str], int]:
    """(text fields of the tags at the front, where frames may start)."""
    tags, start = {}, 0
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10 and max(data[start + 6 : start + 10]) < 128:
        major, flags, size = data[start + 3], data[start + 5], _syncsafe(data[start + 6 : start + 10])
        at, stop = start + 10, min(len(data), start + 10 + size)
        if flags & 0x40 and major in (3, 4) and at + 4 <= stop:  # extended header
            at += _syncsafe(data[at : at + 4]) if major == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
        width, head = (3, 6) if major == 2 else (4, 10)
        while at + head <= stop and data[at]:
            name, raw = data[at : at + width].decode("latin-1"), data[at + width : at + 2 * width]
            n = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
            if n <= 0 or at + head + n > stop:
                break
            if name[0] == "T":
                value = _text(data[at + head : at + head + n])
                if name in ("TXXX", "TXX"):  # a description of its own
                    name, _, value = value.partition("\0")
                    name = f"TXXX:{name}"
                tags[name] = value
            at += head + n
        start += 10 + size + (10 if flags & 0x10 else 0)
    return tags, min(start, len(data))


def read_last_tag(tag: bytes) -> dict[str, str]:
    """The text fields of an ID3v1 tag."""
    fields = ((f"id3v1:{name}", tag[a:b].split(b"\0")[0].decode("latin-1").strip()) for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)))
    return {name: value for name, value in fields if value}


def read_table(frame: bytes, h: Header) -> dict | None:
    """Counts and seek points of a Xing, Info or VBRI frame."""
    at = 4 + h.side + (2 if h.protected else 0)
    for at in {at, 4 + h.side}:
        if (name := frame[at : at + 4]) in (b"Xing", b"Info"):
            (flags,), at, out = struct.unpack_from(">I", frame.ljust(at + 8, b"\0"), at + 4), at + 8, {"kind": name.decode()}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit and at + 4 <= len(frame):
                    (out[key],) = struct.unpack_from(">I", frame, at)
                    at += 4
            if flags & 4 and at + 100 <= len(frame):
                out["toc"] = list(frame[at : at + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack_from(">IIHHH", frame, 46)
        out = {"kind": "VBRI", "frames": frames, "bytes": size}
        if width in (1, 2, 3, 4) and 62 + entries * width <= len(frame):
            out["toc"] = [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") for k in range(entries)]
        return out
    return None


def table_check(table: dict | None, offsets: list[int], sizes: list[int]) -> dict | None:
    """How a table agrees with the frames: whether its counts are theirs, and by how many bytes its seek points miss theirs at most.

    Seek point k of n stands for the frame at the share k / n of all; a VBRI point is a length, a Xing point a share of the bytes in 256ths.
    """
    if not table or not offsets:
        return None
    first, last = table["at"], offsets[-1] + sizes[-1]
    out = {"frames_ok": table.get("frames") in (None, len(offsets)), "bytes_ok": table.get("bytes") in (None, last - first), "toc_miss": None}
    toc, at = table.get("toc"), offsets + [last]
    if toc and table["kind"] == "VBRI":
        ends = np.cumsum(toc)
        true = [at[len(offsets) * (k + 1) // len(toc)] - offsets[0] for k in range(len(toc))]
        out["toc_miss"] = int(np.abs(ends - np.array(true)).max())
    elif toc:
        out["toc_miss"] = max(abs(x * (last - first) // 256 - (at[len(offsets) * k // 100] - first)) for k, x in enumerate(toc))
    return out


def seek(found: dict, share: float) -> int:
    """The byte offset of the frame that holds the moment at ``share`` (0 to 1) of the duration: exact, whatever the table says."""
    at = found["offsets"]
    return at[min(len(at) - 1, int(share * len(at)))] if at else 0


def parse(data: bytes) -> dict:
    """All that is read of a stream; see the module's text."""
    tags, at = read_tags(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":  # an ID3v1 tag, unless a frame holds its place
        end -= 128
    offsets, sizes, bitrates, table = [], [], {}, None
    samples = crc_ok = crc_bad = resyncs = skipped = 0
    first: Header | None = None
    checked: dict[bytes, bool] = {}

    def followed(stop: int, h: Header) -> bool:
        """Whether at ``stop`` another frame starts, or the frames end."""
        after = Header.of(data[stop : stop + 4])
        return stop in (end, len(data)) or after is not None and after.fits(h)

    while at + 4 <= end:
        h = Header.of(data[at : at + 4])
        stop = at + h.size if h else 0
        good = h is not None and stop <= len(data) and (first is None or h.fits(first))
        if good and (first is None or not offsets or stop > end):  # a first frame, or one over a tag's place, must be followed by another, or the end
            good = followed(stop, h)
        if not good:
            resyncs += 1
            begin = at
            at += 1
            while (at := data.find(b"\xff", at, end - 3)) >= 0:
                h = Header.of(data[at : at + 4])
                if h and at + h.size <= len(data) and (first is None or h.fits(first)) and followed(at + h.size, h):
                    break
                at += 1
            if at < 0:
                skipped, at = skipped + end - begin, end
                break
            skipped += at - begin
            continue
        if stop > end:  # what looked like a tag is part of this frame
            end = len(data)
        if h.protected:
            side = data[at : min(at + (6 + h.side if h.layer == 3 else 70), stop)]
            if side not in checked:
                if len(checked) > 4096:
                    checked.clear()
                checked[side] = checksum_holds(side, h)
            crc_ok, crc_bad = crc_ok + checked[side], crc_bad + (not checked[side])
        if first is None:
            first = h
            table = read_table(data[at:stop], h) if h.layer == 3 else None
            if table:
                table["at"] = at
                at = stop
                continue
        offsets.append(at)
        sizes.append(h.size)
        bitrates[h.bitrate] = bitrates.get(h.bitrate, 0) + 1
        samples += h.samples
        at = stop
    if end < len(data):
        tags.update(read_last_tag(data[end:]))
    rate = first.rate if first else 1
    g = math.gcd(samples, rate)
    return {
        "tags": tags, "table": table, "table_check": table_check(table, offsets, sizes), "frames": len(offsets), "samples": samples, "rate": first.rate if first else 0, "duration": [samples // g, rate // g],
        "bitrates": bitrates, "crc_ok": crc_ok, "crc_bad": crc_bad, "resyncs": resyncs, "skipped": skipped + max(0, end - at), "offsets": offsets, "sizes": sizes,
        "version": {3: "1", 2: "2", 0: "2.5"}[first.version] if first else "", "layer": first.layer if first else 0,
    }


def _head(kbits: int) -> bytes:
    """MPEG-2, layer III, protected, 16 kHz, mono; its CRC over header and an empty side information."""
    head = bytes([255, 0xF2, (BITRATES[2, 3].index(kbits) + 1) << 4 | 2 << 2, 3 << 6])
    side = bytes(9)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


KBITS = 144
FRAME = Header.of(_head(KBITS)[:4]).size
_BODY = 15  # header, checksum, side information


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def carry(payload: bytes, n_bytes: int) -> bytes:
    """A stream that holds ``payload`` (a positive multiple of 576 bytes) without loss."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, FRAME), dtype=np.uint8)
    frames[:, :_BODY] = np.frombuffer(_head(KBITS), dtype=np.uint8)
    frames[1:, _BODY : _BODY + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    toc = bytes(min(255, 256 * ((n * k // 100 + 1) * FRAME) // ((n + 1) * FRAME)) for k in range(100))
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    frames[0, _BODY : _BODY + len(info)] = np.frombuffer(info, dtype=np.uint8)
    tag = b""
    for name, value in (("payload_bytes", n_bytes), ("payload_crc32", zlib.crc32(payload))):
        field = f"{name}\0{value}".encode()
        tag += b"TXXX" + _packed(len(field) + 1) + b"\0\0\3" + field
    return b"ID3\4\0\0" + _packed(len(tag)) + tag + frames.tobytes()


def _packed(n: int) -> bytes:
    return bytes(n >> k & 127 for k in (21, 14, 7, 0))


def carried(data: bytes, found: dict) -> tuple[bytes, int, bool | None]:
    """(payload, unpadded length, whether its checksum holds) of a stream written by ``carry``, by what ``parse`` found in it.

    A stream of another writer has no checksum (null), and its length is that of the bytes found.
    """
    raw = b"".join(data[at + _BODY : at + _BODY + UNIT] for at in found["offsets"])
    n, crc = (found["tags"].get(f"TXXX:{x}", "") for x in ("payload_bytes", "payload_crc32"))
    return raw, int(n) if n.isdigit() else len(raw), int(crc) == zlib.crc32(raw) if crc.isdigit() else None


def feature_of(found: dict, payload: bytes) -> str:
    """What a stream's frames and samples tell, as canonical JSON."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    offsets = np.array(found["offsets"], dtype="<i8")
    return json.dumps(
        {k: found[k] for k in ("version", "layer", "rate", "frames", "samples", "duration", "crc_ok", "crc_bad", "resyncs", "skipped")}
        | {
            "bitrates": {str(k): found["bitrates"][k] for k in sorted(found["bitrates"])},
            "table": {k: found["table"][k] for k in ("kind", "frames", "bytes") if k in found["table"]} if found["table"] else None,
            "table_check": found["table_check"], "seek_crc32": zlib.crc32(offsets.tobytes()),
            "sample_sum": int(x.sum()), "sample_energy": int((x * x).sum()), "crossings": int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128))),
        },
        sort_keys=True, separators=(",", ":"),
    )


ENCODED = "doc_id long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_num long, duration_den long, payload_ok boolean, seek_offsets array<long>"
_ROWS_BYTES = 16 << 20


def _batches(rows, names, kinds, weigh):
    """Record batches of about 16 MB at most, one row at least."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= _ROWS_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every whole text of ``docs`` as an MPEG stream."""

    def rows(batches):
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                yield key, carry(*payload_of(text.as_py()))

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.spread(small).mapInArrow(lambda it: _batches(rows(it), ["doc_id", "media"], [pa.int64(), pa.binary()], lambda r: len(r[1])), ENCODED)


def probe(media: DataFrame) -> DataFrame:
    """What is read back from the bytes of ``media`` (doc_id, media); null bytes are empty."""
    names, kinds = zip(*((n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[k]) for n, k in (x.split(" ") for x in READ.split(", "))))

    def rows(batches):
        for batch in batches:
            for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                data = data.as_py() or b""
                found = parse(data)
                payload, n, whole = carried(data, found)
                yield (
                    key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(),
                    feature_of(found, payload), *found["duration"], whole, found["offsets"],
                )

    return media.mapInArrow(lambda it: _batches(rows(it), list(names), kinds, lambda r: 8 * len(r[-1]) + 800), READ)


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe(common.stored(encode(common.table(spark, sf_dir, "documents")), "media"))
