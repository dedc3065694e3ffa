import hashlib
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import mpeg_audio as m


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(data):
    media = m.write(m.padded(data))
    payload, stream = m.read(media)
    assert payload == m.padded(data) and stream.resyncs == 0 and stream.broken == 0
    assert stream.table["frames"] == len(stream.offsets) and stream.table["bytes"] == len(media) - (stream.offsets[0] - 144)
    assert stream.samples == 1152 * len(stream.offsets)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.lists(st.tuples(st.integers(0, 400), st.sampled_from([b"TAG", b"ID3\4\0\0", b"Xing", b"Info", b"VBRI", b"\xff\xfb\x90\x64", b"\xff\xfa"])), max_size=6))
def test_marks_in_the_last_frames_are_payload(n, sown):
    data = bytearray(m.padded(b"w" * n))
    for back, mark in sown:
        at = max(0, len(data) - back - 1)
        data[at : at + len(mark)] = mark
    data = m.padded(bytes(data))
    payload, stream = m.read(m.write(data))
    assert payload == data and stream.resyncs == 0 and stream.broken == 0


def test_tag_at_every_offset():
    for n in range(64, 1088, 64):
        for back in range(n - 3):
            data = bytearray(b"x" * n)
            data[n - back - 3 : n - back] = b"TAG"
            assert m.read(m.write(bytes(data)))[0] == bytes(data)
    for text in [b"TAG" * 342] + [b"x" * k + b"TAG" * 300 for k in range(400)]:
        assert m.read(m.write(m.padded(text)))[0] == m.padded(text)


def test_a_real_tag_at_the_end():
    body = m.write(b"some words " * 700)
    tag = (b"TAG" + b"A title").ljust(128, b"\0")
    for media in (body + tag, body + b"junk" + tag):
        stream = m.parse(media)
        assert stream.tags["id3v1_title"] == "A title" and len(stream.offsets) == len(m.parse(body).offsets)
    cut = m.parse(body[:-40] + tag)  # the last frame is damaged: it reaches into the tag but not to the end
    assert cut.tags["id3v1_title"] == "A title" and len(cut.offsets) == len(m.parse(body).offsets) - 1


def division(bits):
    """The checksum as a polynomial remainder: ones in front of the message, 16 zeros behind it, divided by 0x18005."""
    n = len(bits)
    value = int(bits or "0", 2) << 16 ^ 0xFFFF << n
    for k in range(n + 15, 15, -1):
        if value >> k & 1:
            value ^= 0x18005 << k - 16
    return value


def test_checksums_of_layers_one_and_two():
    bits = lambda raw: "".join(f"{b:08b}" for b in raw)
    one = bytes((0xFF, 0xFE, 0x50 | 1 << 2, 0x00))  # layer I, stereo: 64 allocations of four bits
    h = m.frame_header(one)
    side = bytes(range(3, 35))
    frame = one + division(bits(one[2:] + side)).to_bytes(2, "big") + side
    frame = frame.ljust(h.size, b"\x55")
    assert (h.layer, m.parse(frame * 3).checked, m.parse(frame * 3).broken) == (1, 3, 0)
    bad = bytearray(frame * 3)
    bad[h.size + 8] ^= 4
    assert m.parse(bytes(bad)).broken == 1
    two = bytes((0xFF, 0xFC, 0xA0 | 1 << 2, 0xC0))  # layer II, mono, 192 kbit/s at 48 kHz: table a, 27 subbands
    h = m.frame_header(two)
    allocation = "0001" * 2 + "0000" * 9 + "000" * 12 + "01" + "00" * 3
    covered = allocation + "10" * 3  # three allocated subbands have a selection
    raw = covered.ljust(8 * (h.size - 6), "1")
    frame = two + division(bits(two[2:]) + covered).to_bytes(2, "big") + int(raw, 2).to_bytes(h.size - 6, "big")
    assert (h.layer, m.parse(frame * 3).checked, m.parse(frame * 3).broken) == (2, 3, 0)


def test_vbri_seek_points():
    head = bytes((0xFF, 0xFB, 0x90, 0x64))
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 50, 4170, 9, 3, 2, 2, 3) + struct.pack(">HHH", 600, 601, 602)
    first = (head + bytes(32) + table).ljust(417, b"\0")
    stream = m.parse(first + (head + bytes(413)) * 9)
    assert stream.table == {"kind": "VBRI", "bytes": 4170, "frames": 9, "seek": [1200, 1202, 1204], "step": 3} and len(stream.offsets) == 9


def test_damage_is_found():
    media = bytearray(m.write(b"some words " * 700))
    clean = m.parse(bytes(media))
    media[clean.offsets[2] + 8] ^= 1
    assert m.parse(bytes(media)).broken == 1
    cut = clean.offsets[3]
    broken = m.parse(bytes(media[:cut]) + b"\xff\xfbjunk\xff" + bytes(media[cut:]))
    assert broken.resyncs == 1 and len(broken.offsets) == len(clean.offsets)
    assert m.parse(b"").samples == 0 and m.parse(b"no audio here").offsets == []


def test_known_headers():
    h = m.frame_header(bytes((0xFF, 0xFB, 0x90, 0x64)))
    assert (h.size, h.samples, h.rate, h.kbps, h.side, h.crc, h.layer) == (417, 1152, 44100, 128, 32, False, 3)
    assert m.frame_header(bytes((0xFF, 0xF3, 0x40, 0xC0))).samples == 576 and m.frame_header(b"\xff\xfb\xf0\x00") is None


def test_query(make, prose):
    prose = [*prose, "TAG" * 342, "x" * 65 + "TAG" * 300, "ÿûTAG ID3 Xing VBRI " * 300_000]
    got = {r["doc_id"]: r for r in m.digest(make(prose)).collect()}
    for i, text in enumerate(prose):
        raw = (text or "").encode()
        payload = m.padded(raw)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[3]["feature"] == got[60]["feature"] and got[3]["media_sha256"] == got[60]["media_sha256"]
    assert m.digest(make([]).limit(0)).collect() == []
