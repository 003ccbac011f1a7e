"""Media columns: MPEG audio.

``encode_stream`` lays a payload into constant-size chunks of 576 bytes, one per MPEG-1
Layer III frame (44.1 kHz, 192 kbit/s, mono, CRC on). The granules are silent
(``part2_3_length`` 0), so the bytes after the side information are ancillary data and
carry the chunk unchanged. An ID3v2.4 tag holds the payload's length and CRC-32; a first
``Info`` frame holds frame and byte counts and the 100-entry seek table.

``parse_stream`` reads any elementary stream: ID3v2/ID3v1/APE tags, versions 1, 2 and 2.5,
layers I to III, Xing/Info/VBRI tables, junk between frames (resynchronised), and the CRCs of
what each layer protects: layer III its side information, layer I its bit allocation, layer II
that and its scale factor selection. A last frame that the stream cuts short is told apart.
The feature string also holds what the payload's bytes sound like as 8-bit samples: their
root mean square, zero crossings and entropy.

Defined cases: null text counts as empty; an empty text gives one chunk of padding; a very long
text is one stream, worked on alone; rows with equal texts give equal values; a null media value parses as an empty stream; extra
columns pass through ``add_media`` unless they bear the name of a new column, which wins.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, text_of

CHUNK = 576

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index 1 to 14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Hz by version and index.
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
# Samples of a frame by MPEG-1 or later, and layer.
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


CRC_TABLE = _crc_table()


@lru_cache(maxsize=4096)
def crc16(protected: bytes, bits: int | None = None) -> int:
    """CRC-16 of the bytes, or of so many bits of them."""
    c, n = 0xFFFF, len(protected) * 8 if bits is None else bits
    for b in protected[: n // 8]:
        c = ((c << 8) & 0xFFFF) ^ CRC_TABLE[(c >> 8) ^ b]
    for k in range(n % 8):
        bit = protected[n // 8] >> (7 - k) & 1
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


# Fixed values of layer II: bits of a subband's allocation, by subband, in the standards' tables.
ALLOCATED = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def _allocation(h: dict) -> tuple[int, ...]:
    """Bits of each subband's allocation of a layer II frame."""
    if h["version"] != 1:
        return ALLOCATED["low"]
    each = h["kbps"] // (1 if h["mono"] else 2)
    if each <= 48:
        return ALLOCATED["d" if h["rate"] == 32000 else "c"]
    return ALLOCATED["a" if each <= 80 or h["rate"] == 48000 else "b"]


def protected_bits(data: bytes, at: int, h: dict) -> int | None:
    """Bits after a frame's checksum that it covers; None if the frame ends before."""
    if h["layer"] == 3:
        return h["side"] * 8
    channels, joint = (1 if h["mono"] else 2), data[at + 3] >> 6 == 1
    widths = (4,) * 32 if h["layer"] == 1 else _allocation(h)
    bound = min(len(widths), 4 * ((data[at + 3] >> 4 & 3) + 1)) if joint else len(widths)
    body = int.from_bytes(data[at + 6 : at + h["length"]], "big")
    room = 8 * max(0, h["length"] - 6)
    used, selected = 0, 0
    for k, width in enumerate(widths):
        for _ in range(channels if k < bound else 1):
            used += width
            if used > room:
                return None
            if h["layer"] == 2 and body >> (room - used) & ((1 << width) - 1):
                # scale factor selection stands for each channel, shared allocation or not
                selected += channels if k >= bound else 1
    total = used + 2 * selected
    return total if total <= room else None


def checksum_holds(data: bytes, at: int, h: dict) -> bool:
    bits = protected_bits(data, at, h)
    if bits is None:
        return False
    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + -(-bits // 8)]
    return crc16(covered, 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")


@lru_cache(maxsize=4096)
def header(four: bytes) -> dict | None:
    """Fields of a frame header; None if these four bytes are none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2, 0: 2.5}.get(four[1] >> 3 & 3)
    layer = {3: 1, 2: 2, 1: 3}.get(four[1] >> 1 & 3)
    index, rate_index, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version is None or layer is None or index in (0, 15) or rate_index == 3:
        return None
    family = 1 if version == 1 else 2
    kbps, rate = BITRATES[family, layer][index - 1], RATES[version][rate_index]
    samples = SAMPLES[family, layer]
    slot = 4 if layer == 1 else 1
    length = (samples // 8 * kbps * 1000 // rate // slot + pad) * slot
    mono = four[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    crc = not four[1] & 1
    return {"version": version, "layer": layer, "kbps": kbps, "rate": rate, "samples": samples, "length": length, "mono": mono, "side": side, "crc": crc, "body": 4 + 2 * crc + side}


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsafe(four: bytes) -> int:
    return sum((b & 0x7F) << s for b, s in zip(four, (21, 14, 7, 0), strict=False))


def _txxx(key: str, value: str) -> bytes:
    body = b"\x03" + key.encode() + b"\0" + value.encode()
    return b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body


def encode_stream(payload: bytes, n_bytes: int) -> bytes:
    """An MP3 stream whose ancillary data is the payload, a positive multiple of 576 bytes."""
    n = len(payload) // CHUNK
    size, rate = SAMPLES[1, 3] // 8 * 192_000, RATES[1][0]
    ends = [(k + 1) * size // rate for k in range(n + 1)]
    lengths = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    frames = []
    for k, length in enumerate(lengths):
        pad = length - size // rate
        crc_on = k > 0
        head = bytes((0xFF, 0xFA if crc_on else 0xFB, 11 << 4 | pad << 1, 3 << 6))
        side = bytes(17)
        if crc_on:
            body = crc16(head[2:] + side).to_bytes(2, "big") + side + payload[(k - 1) * CHUNK : k * CHUNK]
        else:
            toc = bytes(min(255, 256 * ([0, *ends][j * (n + 1) // 100]) // ends[-1]) for j in range(100))
            body = side + b"Info" + struct.pack(">III", 7, n, ends[-1]) + toc
        frames.append((head + body).ljust(length, b"\0"))
    tag = _txxx("PAYLOAD_BYTES", str(n_bytes)) + _txxx("PAYLOAD_CRC32", str(zlib.crc32(payload)))
    return b"ID3\4\0\0" + _synchsafe(len(tag)) + tag + b"".join(frames)


def _id3_text(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 10 <= len(data) and data[at : at + 4].strip(b"\0"):
        key, n = data[at : at + 4].decode("latin-1"), _unsafe(data[at + 4 : at + 8])
        body = data[at + 10 : at + 10 + n]
        if key.startswith("T") and body:
            text = body[1:].decode({0: "latin-1", 3: "utf-8"}.get(body[0], "utf-16"), "replace")
            if key == "TXXX":
                key, _, text = text.partition("\0")
            out[key] = text.strip("\0")
        at += 10 + n
    return out


def _vbr(data: bytes, at: int, h: dict) -> dict | None:
    """The Xing/Info or VBRI table of a frame, if it has one."""
    x = at + 4 + h["side"]
    if data[x : x + 4] in (b"Xing", b"Info"):
        out = {"kind": data[x : x + 4].decode(), "frames": None, "bytes": None, "toc": None}
        flags, x = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key], x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 4:
            out["toc"] = list(data[x : x + 100])
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI" and len(data) >= x + 26:
        total, frames, n, scale, width, step = struct.unpack(">IIHHHH", data[x + 10 : x + 26])
        sizes = [int.from_bytes(data[x + 26 + k * width : x + 26 + (k + 1) * width], "big") * scale for k in range(n)]
        return {"kind": "VBRI", "frames": frames, "bytes": total, "toc": sizes, "step": step}
    return None


def parse_stream(data: bytes | None) -> dict:
    """Frames with offsets, tags, tables, checksums and ancillary bytes of a stream.

    A header counts if the next one follows at its length, agreeing in version, layer and
    rate, or the stream ends there; otherwise the search moves on one byte (junk)."""
    data = data or b""
    at, end, tags, junk = 0, len(data), {}, 0
    if data[:3] == b"ID3" and end >= 10:
        n = _unsafe(data[6:10])
        tags |= _id3_text(data[10 : 10 + n])
        at = min(end, 10 + n + 10 * (data[5] >> 4 & 1))
    if data[end - 128 : end - 125] == b"TAG" and end - 128 >= at:
        tags["ID3v1"] = data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    if end - 32 >= at and data[end - 32 : end - 24] == b"APETAGEX":
        tags["APE"] = str(int.from_bytes(data[end - 16 : end - 12], "little"))
        end = max(at, end - int.from_bytes(data[end - 20 : end - 16], "little"))
    frames, table_, ok, checked = [], None, 0, 0
    same = lambda a, b: (a["version"], a["layer"], a["rate"]) == (b["version"], b["layer"], b["rate"])
    in_sync, cut = False, 0
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and at + h["length"] <= end and h["length"] >= h["body"]:
            after = at + h["length"]
            nxt = header(data[after : after + 4]) if after + 4 <= end else None
            if after >= end - 3 or nxt and same(h, nxt) or in_sync and same(h, frames[-1][1]):
                if not frames and not table_ and (table_ := _vbr(data, at, h)):
                    table_["at"] = at
                else:
                    if h["crc"]:
                        checked += 1
                        ok += checksum_holds(data, at, h)
                    frames.append((at, h))
                    in_sync = True
                at = after
                continue
        elif h and in_sync and same(h, frames[-1][1]) and h["length"] >= h["body"]:
            cut = end - at  # the last frame, without its end
            break
        found = data.find(b"\xff", at + 1, end)
        junk += (found if found >= 0 else end) - at
        at = found if found >= 0 else end
        in_sync = False
    samples = sum(h["samples"] for _, h in frames)
    return {"tags": tags, "frames": frames, "vbr": table_, "junk": junk, "truncated": cut, "crc_ok": ok, "crc_checked": checked, "samples": samples, "rate": frames[0][1]["rate"] if frames else 0}


def seek(parsed: dict, second: float) -> int | None:
    """Byte offset of the frame that plays at a time."""
    if not parsed["frames"] or second < 0 or second * parsed["rate"] >= parsed["samples"]:
        return None
    starts, at = [], 0
    for _, h in parsed["frames"]:
        starts.append(at)
        at += h["samples"]
    return parsed["frames"][bisect_right(starts, second * parsed["rate"]) - 1][0]


def payload_of(data: bytes, parsed: dict) -> bytes:
    """The chunks that ``encode_stream`` laid down."""
    return b"".join(data[at + h["body"] : at + h["body"] + CHUNK] for at, h in parsed["frames"])


def _sound(payload: bytes) -> str:
    """Root mean square, zero crossings and entropy (bits) of bytes as 8-bit samples about 128."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return "rms=0 crossings=0 entropy=0"
    counts = np.bincount(x, minlength=256)
    level = (np.arange(256) - 128) ** 2
    share = counts[counts > 0] / len(x)
    return f"rms={math.sqrt(int(counts @ level) / len(x)):.3f} crossings={int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))} entropy={abs(float(-(share * np.log2(share)).sum())):.4f}"


def feature_of(parsed: dict, payload: bytes = b"") -> str:
    h = parsed["frames"][0][1] if parsed["frames"] else {"version": 0, "layer": 0, "mono": False}
    rates = {x["kbps"] for _, x in parsed["frames"]}
    vbr = parsed["vbr"]
    agrees = bool(vbr) and vbr["frames"] == len(parsed["frames"])
    return (
        f"mpeg{h['version']}-l{h['layer']} {parsed['rate']}Hz {'mono' if h['mono'] else 'stereo'} "
        f"kbps={min(rates, default=0)}-{max(rates, default=0)} frames={len(parsed['frames'])} samples={parsed['samples']} "
        f"crc={parsed['crc_ok']}/{parsed['crc_checked']} junk={parsed['junk']} truncated={parsed['truncated']} {_sound(payload)} table={vbr['kind'] if vbr else '-'}:{'ok' if agrees else 'differs'}"
    )


def _add_media(batches):
    import pyarrow as pa

    for b in slices(batches, "text"):
        media = []
        for text in b.column("text").to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            media.append(encode_stream(raw.ljust(max(1, -(-len(raw) // CHUNK)) * CHUNK, b"\xff"), len(raw)))
        keep = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(media, pa.binary())], [*keep, "media"])


def add_media(df: DataFrame) -> DataFrame:
    """Replace ``text`` by the binary column ``media``; other columns pass through."""
    df = df.drop("media") if "media" in df.columns else df
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "text")
    return df.mapInArrow(_add_media, f"{fields + ', ' if fields else ''}media binary")


MEASURES = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "sample_rate long, n_samples long, n_frames long, duration_seconds double, crc_ok boolean, junk_bytes long, seek_offsets array<bigint>"
)


def measure(data: bytes | None) -> tuple:
    data = data or b""
    p = parse_stream(data)
    payload = payload_of(data, p)
    declared = p["tags"].get("PAYLOAD_BYTES", "")
    return (
        int(declared) if declared.isdigit() else len(payload),
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-32:]),
        len(data),
        hashlib.sha256(data).hexdigest(),
        feature_of(p, payload),
        p["rate"],
        p["samples"],
        len(p["frames"]),
        p["samples"] / p["rate"] if p["rate"] else 0.0,
        p["crc_ok"] == p["crc_checked"] and p["tags"].get("PAYLOAD_CRC32", str(zlib.crc32(payload))) == str(zlib.crc32(payload)),
        p["junk"],
        [at for at, _ in p["frames"]],
    )


def _measures(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in MEASURES.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    kinds = {x.split()[0]: types[x.split()[1]] for x in MEASURES.split(", ")}
    for b in slices(batches, "media"):
        rows = [measure(x) for x in b.column("media").to_pylist()]
        keep = [n for n in b.schema.names if n != "media" and n not in names]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *(pa.array(c, kinds[n]) for c, n in zip(cols, names, strict=True))], [*keep, *names])


def features(df: DataFrame) -> DataFrame:
    """Parse the binary column ``media`` of each row; other columns pass through."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "media" and n not in names)
    return df.mapInArrow(_measures, f"{fields + ', ' if fields else ''}{MEASURES}")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an MPEG audio column, read back, verified and measured."""
    docs = table(spark, sf_dir, "documents")
    return features(add_media(docs.select("doc_id", text_of(docs).alias("text"))))
