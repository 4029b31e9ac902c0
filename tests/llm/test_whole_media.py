"""Streams of several programs, tables over several packets, and units that aren't as long as they say."""

from lodestrand.llm import media


def packets(pid, data, first=True, cc=0, pointer=False):
    """Packets of a pid that carry data whole, the last one stuffed in its adaptation field."""
    out, start = b"", first
    data = (b"\0" if pointer else b"") + data
    while data:
        part, data = data[:184], data[184:]
        n = 184 - len(part)
        field = b"" if not n else bytes([0]) if n == 1 else bytes([n - 1, 0]) + b"\xff" * (n - 2)
        out += bytes([0x47, 0x40 * start | pid >> 8, pid & 255, (0x30 if n else 0x10) | cc & 15]) + field + part
        start, cc = False, cc + 1
    return out, cc


def section(table_id, key, body):
    s = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, key >> 8, key & 255, 0xC1, 0, 0]) + body
    return s + media.crc_mpeg(s).to_bytes(4, "big")


def pes(data, pts=None, declared=None):
    head = bytes([0x84, 0x80, 5, 0x21 | (pts >> 29 & 14), pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1]) if pts is not None else bytes([0x84, 0, 0])
    n = len(head) + len(data) if declared is None else declared
    return b"\0\0\1\xe0" + n.to_bytes(2, "big") + head + data


def test_programs_streams_and_long_tables():
    pat = section(0, 1, bytes([0, 0, 0xE0, 16, 0, 1, 0xE1, 0, 0, 2, 0xE1, 1]))  # a network table, programs 1 and 2
    note = bytes([0x09, 250]) + b"n" * 250
    pmt1 = section(2, 1, bytes([0xE2, 0, 0xF0, 0]) + bytes([0x1B, 0xE2, 0, 0xF0, 252]) + note + bytes([0x0F, 0xE2, 1, 0xF0, 0]))
    pmt2 = section(2, 2, bytes([0xE3, 0, 0xF0, 0]) + bytes([0x06, 0xE3, 0, 0xF0, 0]))
    assert len(pmt1) > 184
    video, audio, text = [bytes([i]) * (500 + i) for i in range(5)], [b"a" * 100, b"b" * 90], [b"t" * 1000]
    s = packets(0, pat, pointer=True)[0] + packets(0x100, pmt1, pointer=True)[0] + packets(0x101, pmt2, pointer=True)[0]
    for pid, units in ((0x200, video), (0x201, audio), (0x300, text)):
        cc = 0
        for i, u in enumerate(units):
            more, cc = packets(pid, pes(u, 9000 * i), cc=cc)
            s += more
    d = media.demux_all(s)
    assert sorted(d["streams"]) == [(1, 0x200, 0x1B), (1, 0x201, 0x0F), (2, 0x300, 6)] and not d["bad_tables"] and not d["lost_sync"]
    for key, units in (((1, 0x200, 0x1B), video), ((1, 0x201, 0x0F), audio), ((2, 0x300, 6), text)):
        x = d["streams"][key]
        assert x["payload"] == b"".join(units) and x["units"][:, 0].tolist() == [9000 * i for i in range(len(units))] and x["units"][:, 2].tolist() == [len(u) for u in units]
        assert not (x["discontinuities"] or x["repeated"] or x["short_units"] or x["long_units"])
    half = s.replace(packets(0x100, pmt1, pointer=True)[0][188:], b"")
    assert media.demux_all(half)["bad_tables"] == 1 and sorted(media.demux_all(half)["streams"]) == [(2, 0x300, 6)]


def test_units_and_their_declared_length():
    pat, pmt = section(0, 1, bytes([0, 1, 0xE1, 0])), section(2, 1, bytes([0xE2, 0, 0xF0, 0, 0x06, 0xE2, 0, 0xF0, 0]))
    tables = packets(0, pat, pointer=True)[0] + packets(0x100, pmt, pointer=True)[0]
    body, cc = b"", 0
    for data, declared in ((b"x" * 50, None), (b"y" * 50, 3 + 20), (b"z" * 50, 3 + 80), (b"w" * 400, 0)):
        more, cc = packets(0x200, pes(data, declared=declared), cc=cc)
        body += more
    d = media.demux(tables + body)
    assert d["payload"] == b"x" * 50 + b"y" * 20 + b"z" * 50 + b"w" * 400
    assert (d["long_units"], d["short_units"]) == (1, 1) and d["units"].tolist() == [[-1, 0, 50, 0], [-1, 50, 20, 0], [-1, 70, 50, 0], [-1, 120, 400, 0]]
