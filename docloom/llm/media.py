"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

`parse_audio` reads any MPEG-1/2/2.5 Layer I-III byte string; `store_payload` puts bytes losslessly into the main
data of Layer III frames, so that a payload makes the trip through the format.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import pieces

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer) and index, Hz by version and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


# Fixed values of Layer II: the subbands' allocation widths, as (bits, how many subbands).
WIDTHS = {"high": ((4, 11), (3, 12), (2, 7)), "middle": ((4, 11), (3, 12), (2, 4)), "low": ((4, 2), (3, 6)), "low32": ((4, 2), (3, 10)), "half": ((4, 4), (3, 7), (2, 19))}


def _widths(head: dict) -> list[int]:
    """The allocation widths of a Layer II frame's subbands, by its version, rate and bitrate a channel."""
    each = head["kbps"] // head["channels"]
    if head["version"] != "1":
        name = "half"
    elif each <= 48:
        name = "low32" if head["hertz"] == 32000 else "low"
    else:
        name = "middle" if head["hertz"] == 48000 or each <= 80 else "high"
    return [bits for bits, n in WIDTHS[name] for _ in range(n)]


def protected_bits(head: dict, body: bytes) -> int:
    """How many bits behind the checksum it covers: side information, bit allocation, and in Layer II the scale factor selection too."""
    if head["layer"] == 3:
        return 8 * head["side"]
    widths = [4] * 32 if head["layer"] == 1 else _widths(head)
    bound = min(len(widths), head["bound"])
    bits, at, used = int.from_bytes(body, "big"), 0, 0
    for band, width in enumerate(widths):
        for _ in range(head["channels"] if band < bound else 1):
            at += width
            if bits >> max(0, 8 * len(body) - at) & (1 << width) - 1:
                used += head["channels"] if band >= bound else 1
    return at + (2 * used if head["layer"] == 2 else 0)


@lru_cache(maxsize=4096)
def frame_header(four: bytes) -> dict | None:
    """The fields of a frame header, or None where the four bytes aren't one (free-format streams count as none)."""
    word = int.from_bytes(four, "big")
    version, layer = VERSIONS.get(word >> 19 & 3), 4 - (word >> 17 & 3)
    rate_at, hertz_at, padding, mode = word >> 12 & 15, word >> 10 & 3, word >> 9 & 1, word >> 6 & 3
    if word >> 21 != 0x7FF or version is None or layer == 4 or rate_at in (0, 15) or hertz_at == 3:
        return None
    kbps, hertz = BITRATES[version == "1", layer][rate_at], SAMPLE_RATES[version][hertz_at]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != "1" else 1152
    length = (12 * kbps * 1000 // hertz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + padding
    mono = mode == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == "1" else (9 if mono else 17)
    bound = 4 * ((word >> 4 & 3) + 1) if mode == 1 else 32  # from here on joint stereo shares what it reads
    return {"version": version, "layer": layer, "kbps": kbps, "hertz": hertz, "samples": samples, "length": length, "channels": 1 if mono else 2, "protected": not word >> 16 & 1, "side": side, "bound": bound}


@lru_cache(maxsize=8192)
def frame_crc(data: bytes, bits: int | None = None) -> int:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of the first `bits` bits (else all): a header's last two bytes and what else is covered."""
    bits = 8 * len(data) if bits is None else bits
    crc = 0xFFFF
    for byte in data[: bits // 8]:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    for k in range(bits % 8):
        crc ^= (data[bits // 8] >> (7 - k) & 1) << 15
        crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsyncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def parse_id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2.3/2.4 tag at the start, and where the audio begins after it."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    end = min(len(data), 10 + _unsyncsafe(data[6:10]) + (10 if data[5] & 16 else 0))
    tags, at = {}, 10
    while at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode("ascii")
        n = _unsyncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + n]
        if name[0] == "T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = body[1:].decode(code, "replace").rstrip("\0")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text
        at += 10 + n
    return tags, end


def parse_audio(data: bytes) -> dict:
    """Frames, tags, the variable-bitrate table, checksums, duration, seek offsets and the main data of a stream.

    A frame counts where its header is valid and the next frame, an ID3v1 tag or the end follows it; elsewhere the
    parser moves to the next sync word, and the bytes passed over are counted. The duration leaves out what an
    encoder says it has put before and behind the sound; samples count all frames. A VBRI table is given as the byte
    offsets of its entries from the first frame on, an Xing table as it is.
    """
    tags, at = parse_id3v2(data)
    stop = len(data)
    if data[-128:-125] == b"TAG" and stop - at >= 128:
        stop -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if value := data[stop + a : stop + b].rstrip(b"\0 ").decode("latin-1"):
                tags[f"v1.{name}"] = value
    offsets, main, rates, skipped, checked, good, samples, bits, vbr, first = [], [], set(), 0, 0, 0, 0, 0, None, None
    while at + 4 <= stop:
        head = frame_header(data[at : at + 4])
        after = at + head["length"] if head else 0
        if head is None or after > stop or not (after == stop or frame_header(data[after : after + 4])):
            sync = data.find(b"\xff", at + 1, stop)
            skipped += (sync if sync >= 0 else stop) - at
            at = sync if sync >= 0 else stop
            continue
        body = at + 4 + 2 * head["protected"]
        if head["protected"]:
            checked += 1
            covered = data[body : body + (head["side"] or min(after - body, 64))]
            good += frame_crc(data[at + 2 : at + 4] + covered, 16 + protected_bits(head, covered)) == int.from_bytes(data[at + 4 : at + 6], "big")
        inside = body + head["side"]
        if first is None and vbr is None and data[inside : inside + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[inside + 4 : inside + 8], "big"), inside + 8
            vbr = {"kind": data[inside : inside + 4].decode(), "frames": None, "bytes": None, "toc": None}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    vbr[key], p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                vbr["toc"], p = list(data[p : p + 100]), p + 100
            p += 4 * (flags >> 3 & 1)
            if data[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):  # an encoder's extension says what it has put around the sound
                both = int.from_bytes(data[p + 21 : p + 24], "big")
                vbr["delay"], vbr["padding"] = both >> 12, both & 0xFFF
        elif first is None and vbr is None and data[at + 36 : at + 40] == b"VBRI":
            entries, scale, width = (int.from_bytes(data[at + p : at + p + 2], "big") for p in (54, 56, 58))
            steps = [scale * int.from_bytes(data[at + 62 + width * k : at + 62 + width * (k + 1)], "big") for k in range(entries)]
            vbr = {"kind": "VBRI", "bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big"), "toc": list(accumulate(steps)), "delay": int.from_bytes(data[at + 42 : at + 44], "big")}
        else:
            first = first or head
            offsets.append(at)
            samples += head["samples"]
            rates.add(head["kbps"])
            if head["layer"] == 3 and head["version"] == "1" and head["channels"] == 1:
                side = int.from_bytes(data[body : body + 17], "big")
                n = ((side >> 106 & 0xFFF) + (side >> 47 & 0xFFF)) // 8
                main.append(data[inside : inside + n])
            else:
                main.append(data[inside:after])
        at = after
    skipped += max(0, stop - at)
    hertz = first["hertz"] if first else 0
    heard = max(0, samples - sum((vbr or {}).get(k, 0) for k in ("delay", "padding") if (vbr or {}).get("kind") != "VBRI"))
    return {
        "version": first["version"] if first else None, "layer": first["layer"] if first else None, "hertz": hertz, "channels": first["channels"] if first else 0,
        "frames": len(offsets), "samples": samples, "duration_us": heard * 1_000_000 // hertz if hertz else 0, "offsets": offsets,
        "kbps_low": min(rates, default=0), "kbps_high": max(rates, default=0), "vbr": vbr, "tags": tags, "crc_checked": checked, "crc_good": good, "skipped": skipped, "payload": b"".join(main),
    }


# The stored form: MPEG-1 Layer III, 48 kHz, mono, protected. A frame has 3 bytes for each kbit/s.
_HEAD = 4 + 2 + 17
_SIZES = [(i, 3 * k, 3 * k - _HEAD) for i, k in enumerate(BITRATES[True, 3]) if k]
_LARGEST = _SIZES[-1][2]


@lru_cache(maxsize=2048)
def _frame_start(n: int) -> tuple[bytes, int]:
    """Header, checksum and side information of the smallest frame for n bytes of main data, and its zero filling."""
    index, length, room = next(x for x in _SIZES if x[2] >= n)
    low = min(8 * n, 4088)
    side = (low << 106 | (8 * n - low) << 47).to_bytes(17, "big")
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    return head + frame_crc(head[2:] + side).to_bytes(2, "big") + side, room - n


def store_payload(payload: bytes, title: str = "payload") -> bytes:
    """An ID3v2 tag, an Xing frame with its seek table, and Layer III frames that hold the payload as main data."""
    frames, lengths = [], []
    for i in range(0, len(payload), _LARGEST):
        part = payload[i : i + _LARGEST]
        start, filling = _frame_start(len(part))
        frames.append(start + part + bytes(filling))
        lengths.append(len(frames[-1]))
    audio = sum(lengths)
    table = bytes(120)
    head, filling = _frame_start(len(table))
    size = len(head) + len(table) + filling
    whole = size + audio
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] + size if lengths else np.array([size])
    toc = (starts[(np.arange(100) * len(starts)) // 100] * 256 // whole).astype("u1").tobytes()
    head = head[:4] + frame_crc(head[2:4] + bytes(17)).to_bytes(2, "big") + bytes(17)
    info = head + b"Xing" + struct.pack(">III", 7, len(frames), whole) + toc + struct.pack(">I", 100)
    info += bytes(size - len(info))
    text = b"\3" + title.encode() + b"\0"
    extra = b"\3payload_bytes\0" + str(len(payload)).encode() + b"\0"
    tag = b"".join(name + _syncsafe(len(body)) + b"\0\0" + body for name, body in ((b"TIT2", text), (b"TXXX", extra)))
    return b"ID3\4\0\0" + _syncsafe(len(tag)) + tag + info + b"".join(frames)


def feature_text(found: dict) -> str:
    """The stored facts of a stream in one line; seek offsets by count, first, last and a digest."""
    offsets = np.array(found["offsets"], "<i8")
    vbr = found["vbr"] or {}
    return (
        f"mpeg{found['version']}-l{found['layer']} {found['hertz']}Hz {found['channels']}ch frames={found['frames']} samples={found['samples']} duration_us={found['duration_us']}"
        f" kbps={found['kbps_low']}-{found['kbps_high']} vbr={vbr.get('kind')}:{vbr.get('frames')}:{vbr.get('bytes')} crc={found['crc_good']}/{found['crc_checked']} skipped={found['skipped']}"
        f" seek={offsets[0] if len(offsets) else -1}..{offsets[-1] if len(offsets) else -1}:{zlib.crc32(offsets.tobytes()):08x}"
    )


def audio_columns(df: DataFrame, id_column: str, audio_column: str) -> DataFrame:
    """Facts of each audio value: id, frames, samples, duration_us, seek_offsets, tags, vbr frames and bytes, checks.

    Null and empty values and bytes without a frame give 0 frames, duration 0 and empty lists; repeated rows stay;
    columns other than the two named are not read.
    """
    schema = "id long, frames long, samples long, duration_us long, hertz int, seek_offsets array<long>, tags map<string,string>, vbr_kind string, vbr_frames long, vbr_bytes long, crc_checked long, crc_good long, skipped long"
    arrow = pa.schema([("id", pa.int64()), ("frames", pa.int64()), ("samples", pa.int64()), ("duration_us", pa.int64()), ("hertz", pa.int32()), ("seek_offsets", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string())), ("vbr_kind", pa.string()), ("vbr_frames", pa.int64()), ("vbr_bytes", pa.int64()), ("crc_checked", pa.int64()), ("crc_good", pa.int64()), ("skipped", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "audio"):
            rows = []
            for key, data in zip(batch.column("id").to_pylist(), batch.column("audio").to_pylist(), strict=True):
                x = parse_audio(data or b"")
                vbr = x["vbr"] or {}
                rows.append({"id": key, "frames": x["frames"], "samples": x["samples"], "duration_us": x["duration_us"], "hertz": x["hertz"], "seek_offsets": x["offsets"], "tags": list(x["tags"].items()), "vbr_kind": vbr.get("kind"), "vbr_frames": vbr.get("frames"), "vbr_bytes": vbr.get("bytes"), "crc_checked": x["crc_checked"], "crc_good": x["crc_good"], "skipped": x["skipped"]})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.selectExpr(f"cast(`{id_column}` as long) id", f"`{audio_column}` audio").mapInArrow(run, schema)


def stored_digests(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text as an MPEG stream and back: digests of the payload that was read from the stored bytes.

    The payload is the text's UTF-8 bytes with zero bytes up to a positive multiple of 64 (a null text counts as
    empty: 64 zero bytes). Equal texts give equal values; repeated rows stay; other columns are not read.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string() if " string" in x else pa.int64() for x in schema.split(", ")]
        for batch in pieces(batches, "text"):
            columns: list[list] = [[] for _ in names]
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                stored = store_payload(text + bytes(-len(text) % 64 or (0 if text else 64)))
                found = parse_audio(stored)
                back = found["payload"]
                row = (key, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_text(found))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return df.selectExpr(f"cast(`{id_column}` as long) id", f"`{text_column}` text").mapInArrow(run, schema)
