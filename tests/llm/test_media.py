import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(payload):
    found = media.parse_audio(media.store_payload(payload))
    assert found["payload"] == payload and found["skipped"] == 0
    assert found["crc_good"] == found["crc_checked"] == found["frames"] + 1
    assert found["vbr"]["frames"] == found["frames"] == -(-len(payload) // 937)
    assert found["duration_us"] == found["frames"] * 24_000 and found["tags"]["payload_bytes"] == str(len(payload))


def test_seek_table_and_offsets():
    stored = media.store_payload(bytes(range(256)) * 40)
    found = media.parse_audio(stored)
    assert all(media.frame_header(stored[o : o + 4]) for o in found["offsets"])
    toc = found["vbr"]["toc"]
    assert len(toc) == 100 and toc == sorted(toc)
    start = found["offsets"][0] - 144  # the table's own frame
    for k in range(100):
        wanted = found["offsets"][k * found["frames"] // 100]
        assert abs(toc[k] * found["vbr"]["bytes"] // 256 + start - wanted) <= found["vbr"]["bytes"] // 256 + 1


def test_damage_is_seen_and_passed_over():
    stored = bytearray(media.store_payload(b"x" * 6000))
    whole = media.parse_audio(bytes(stored))
    stored[whole["offsets"][0] + 8] ^= 1  # side information: the checksum fails
    stored[whole["offsets"][4]] = 0  # a lost sync word: this frame and the one that it should follow don't count
    found = media.parse_audio(bytes(stored))
    assert found["crc_good"] == found["crc_checked"] - 1
    assert found["offsets"] == [o for i, o in enumerate(whole["offsets"]) if i not in (3, 4)]
    assert found["skipped"] == whole["offsets"][5] - whole["offsets"][3]


def test_junk_tags_and_other_layers():
    frame = media.store_payload(b"abc")
    body = frame[media.parse_id3v2(frame)[1] :]
    tag = b"TAG" + b"Song".ljust(30, b"\0") + b"Singer".ljust(30, b"\0") + bytes(65)
    found = media.parse_audio(b"\xff\xfbjunk" + body + tag)
    assert found["payload"] == b"abc" and found["tags"]["v1.title"] == "Song" and found["skipped"] == 6
    layer2 = bytes((0xFF, 0xFD, 0x84, 0xC0))  # MPEG-1 Layer II, 128 kbit/s, 48 kHz, mono
    head = media.frame_header(layer2)
    assert (head["version"], head["layer"], head["kbps"], head["hertz"], head["length"]) == ("1", 2, 128, 48000, 384)
    assert media.parse_audio((layer2 + bytes(380)) * 3)["samples"] == 3456
    assert media.parse_audio(b"")["frames"] == 0 and media.parse_audio(b"\xff" * 50)["frames"] == 0


def test_digests(spark, awkward):
    got = media.stored_digests(awkward).collect()
    texts = {(r.doc_id, r.text) for r in awkward.collect()}
    assert len(got) == awkward.count()
    want = {}
    for key, text in texts:
        raw = (text or "").encode()
        raw += bytes(-len(raw) % 64 or (0 if raw else 64))
        want.setdefault(key, set()).add((len((text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
    assert media.stored_digests(awkward.limit(0)).count() == 0


def test_audio_columns(spark):
    rows = [(1, media.store_payload(b"a" * 2000)), (2, b""), (3, None)]
    got = {r.id: r for r in media.audio_columns(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio").collect()}
    assert got[1].frames == 3 == len(got[1].seek_offsets) and got[1].duration_us == 72_000 and got[1].vbr_kind == "Xing"
    assert got[2].frames == got[3].frames == 0 and got[2].seek_offsets == []


def bitwise_crc(bits):
    """CRC-16 by long division over a list of bits."""
    state = [1] * 16
    for b in bits:
        out = state[0] ^ b
        state = state[1:] + [0]
        if out:
            for k in (0, 13, 15):  # x^15, x^2, 1
                state[k] ^= 1
    return int("".join(map(str, state)), 2)


def frame_of(header, bits):
    """A protected frame whose body begins with these bits, all covered by the checksum."""
    length = media.frame_header(header)["length"]
    covered = [int(x) for byte in header[2:] for x in f"{byte:08b}"] + bits
    padded = bits + [0] * (-len(bits) % 8)
    body = bytes(int("".join(map(str, padded[i : i + 8])), 2) for i in range(0, len(padded), 8))
    return (header + bitwise_crc(covered).to_bytes(2, "big") + body).ljust(length, b"\x55")


def test_checksums_of_layers_one_and_two():
    """Covered are the bit allocation and, in Layer II, the selection of scale factors of what is allocated."""
    cases = [
        (bytes((0xFF, 0xFE, 0x84, 0xC0)), [0, 1, 0, 1] * 32),  # Layer I, mono: 4 bits a subband
        (bytes((0xFF, 0xFE, 0x84, 0x40)), [1, 0, 0, 1] * (2 * 4 + 28)),  # joint stereo from subband 4 on
        (bytes((0xFF, 0xFC, 0xA4, 0xC0)), [1, 0, 0, 1] * 11 + [0, 1, 1] * 12 + [1, 0] * 4 + [1, 1] * 27),  # Layer II, 48 kHz, mono: 27 subbands
        (bytes((0xFF, 0xFC, 0xA0, 0xC0)), [0, 0, 0, 0] * 11 + [0, 1, 1] * 12 + [0, 0] * 7 + [1, 0] * 12),  # 44.1 kHz: 30 subbands, 12 of them used
        (bytes((0xFF, 0xFC, 0x14, 0xC0)), [1, 1, 1, 1] * 2 + [1, 0, 1] * 6 + [0, 1] * 8),  # 32 kbit/s: 8 subbands
        (bytes((0xFF, 0xF4, 0x84, 0xC0)), [1, 0, 0, 1] * 4 + [0, 1, 1] * 7 + [1, 0] * 19 + [1, 1] * 30),  # MPEG-2
    ]
    for header, bits in cases:
        whole = frame_of(header, bits) * 3
        found = media.parse_audio(whole)
        assert (found["frames"], found["crc_checked"], found["crc_good"]) == (3, 3, 3), header
        damaged = bytearray(whole)
        damaged[6] ^= 0x10
        assert media.parse_audio(bytes(damaged))["crc_good"] == 2


def test_vbri_table_and_encoder_delay():
    head = bytes((0xFF, 0xFB, 0x94, 0xC0))
    length = media.frame_header(head)["length"]
    frame = head.ljust(length, b"\0")
    table = bytearray(frame)
    table[36:40] = b"VBRI"
    table[42:44], table[46:50], table[50:54] = (529).to_bytes(2, "big"), (4 * length).to_bytes(4, "big"), (4).to_bytes(4, "big")
    for at, value in ((54, 4), (56, 2), (58, 2), (60, 1)):
        table[at : at + 2] = value.to_bytes(2, "big")
    for k in range(4):
        table[62 + 2 * k : 64 + 2 * k] = (length // 2).to_bytes(2, "big")
    found = media.parse_audio(bytes(table) + frame * 4)
    assert found["vbr"]["frames"] == found["frames"] == 4 and found["vbr"]["toc"] == [length * k for k in (1, 2, 3, 4)]
    info = bytearray(frame)
    info[21:25], info[25:29] = b"Info", (1).to_bytes(4, "big")
    info[29:33], info[33:37] = (4).to_bytes(4, "big"), b"LAME"
    info[54:57] = (576 << 12 | 1000).to_bytes(3, "big")
    found = media.parse_audio(bytes(info) + frame * 4)
    assert found["samples"] == 4 * 1152 and found["duration_us"] == (4 * 1152 - 1576) * 1_000_000 // 48_000


def test_stored_form_against_one_built_by_hand():
    """Byte for byte the stream that the format asks for, from its parts alone."""
    payload = bytes(range(64))
    length = 3 * 32
    header = bytes((0xFF, 0xFA, 1 << 4 | 1 << 2, 0xC0))
    side = [0] * 136
    for k, x in enumerate(f"{8 * 64:012b}"):
        side[18 + k] = int(x)
    covered = [int(x) for byte in header[2:] for x in f"{byte:08b}"] + side
    body = bytes(int("".join(map(str, side[i : i + 8])), 2) for i in range(0, 136, 8))
    frame = (header + bitwise_crc(covered).to_bytes(2, "big") + body + payload).ljust(length, b"\0")
    stored = media.store_payload(payload)
    assert stored.endswith(frame) and stored.startswith(b"ID3\4\0\0")
    info = stored[media.parse_id3v2(stored)[1] : -length]
    whole = len(info) + length
    assert info[23:39] == b"Xing" + (7).to_bytes(4, "big") + (1).to_bytes(4, "big") + whole.to_bytes(4, "big")
    assert media.feature_text(media.parse_audio(stored)).startswith("mpeg1-l3 48000Hz 1ch frames=1 samples=1152 duration_us=24000 kbps=32-32 vbr=Xing:1:")
