import hashlib
import os
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import transport_stream as ts
from tests.llm.helpers import awkward, empty


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 600))
def test_round_trip(n, unit):
    data = os.urandom(n)
    stream = ts.mux(data, unit)
    assert len(stream) % ts.PACKET == 0
    read = ts.parse(stream)
    assert b"".join(u.data for u in read.units) == data
    assert read.lost == read.damaged == 0 and read.programs == {1: ts.PMT_PID} and read.streams == {ts.DATA_PID: ts.STREAM_TYPE}
    assert [u.pts for u in read.units] == [k * ts.TICK for k in range(len(read.units))] and all(u.random_access for u in read.units)


def test_faults_are_counted():
    stream = ts.mux(bytes(5000), 1000)
    cut = stream[: 4 * 188] + stream[5 * 188 :]
    read = ts.parse(cut)
    assert read.lost == 1 and read.damaged >= 1 and len(read.units) == 4
    twice = stream[: 4 * 188] + stream[3 * 188 : 4 * 188] + stream[4 * 188 :]
    assert ts.parse(twice).lost == 0 and len(ts.parse(twice).units) == 5
    bad = bytearray(ts.mux(bytes(500), 1000))
    bad[10] ^= 1
    assert ts.parse(bytes(bad)).damaged == 1 and not ts.parse(bytes(bad)).programs
    late = bytearray(stream)
    late[10] ^= 1  # the tables come again before the second unit
    assert ts.parse(bytes(late)).damaged == 1 and [u.pts for u in ts.parse(bytes(late)).units] == [k * ts.TICK for k in range(1, 5)]
    assert ts.parse(b"") == ts.Parsed()


def walked(stream):
    """Reads a stream by the standard's layout alone, apart from the module: payload by PID, counters by PID, clocks, marked packets."""
    payload, counters, clocks, marked = {}, {}, [], []
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        pid, body = (p[1] & 31) * 256 + p[2], p[4:]
        counters.setdefault(pid, []).append(p[3] & 15)
        if p[3] & 0x20:
            size = p[4]
            if size and p[5] & 0x40:
                marked.append(at)
            if size and p[5] & 0x10:
                clocks.append(int.from_bytes(p[6:10], "big") * 2 + (p[10] >> 7))
            body = p[5 + size :]
        payload.setdefault(pid, []).append((bool(p[1] & 0x40), body))
    return payload, counters, clocks, marked


def test_layout_of_the_standard():
    data = os.urandom(5000)
    stream = ts.mux(data, 1500)
    payload, counters, clocks, marked = walked(stream)
    assert all(b == (a + 1) % 16 for own in counters.values() for a, b in zip(own, own[1:]))
    pat, pmt = payload[0][0][1], payload[ts.PMT_PID][0][1]
    assert pat[1] == 0 and int.from_bytes(pat[9:11], "big") == 1 and int.from_bytes(pat[11:13], "big") & 0x1FFF == ts.PMT_PID
    assert pmt[1] == 2 and pmt[13] == ts.STREAM_TYPE and int.from_bytes(pmt[14:16], "big") & 0x1FFF == ts.DATA_PID
    assert len(payload[0]) == len(payload[ts.PMT_PID]) == len(marked) == 4 and clocks == [k * ts.TICK for k in range(4)]
    assert all(stream[at - 376 + 1] & 31 == 0 and stream[at - 376 + 2] == 0 for at in marked)  # a table packet pair stands before each
    pes, back = [], b""
    for begins, body in payload[ts.DATA_PID]:
        pes += [body] if begins else []
        pes[-1] = pes[-1] if begins else pes[-1] + body
    for x in pes:
        assert x[:4] == b"\x00\x00\x01" + bytes([ts.STREAM_ID]) and int.from_bytes(x[4:6], "big") == len(x) - 6
        back += x[9 + x[8] :]
    assert back == data


def test_section_checksum_and_stamps():
    assert ts.section_crc(b"123456789") == 0x0376E6E7
    for pts in (0, 1, 2**32 + 12345, 2**33 - 1):
        assert ts._stamp(ts._timestamp(pts)) == pts


def test_awkward(spark):
    docs = awkward(spark)
    rows = {(r.doc_id, r.n_bytes): r for r in ts.digests(docs).collect()}
    assert rows[(3, 0)].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and rows[(3, 0)].payload_bytes == 64
    long = "word " * 30000
    want = long.encode() + bytes(-len(long) % 64)
    assert rows[(7, len(long))].payload_sha256 == hashlib.sha256(want).hexdigest() and rows[(7, len(long))].tail_crc32 == zlib.crc32(want[-64:])
    assert ts.digests(docs).count() == 10 and ts.digests(empty(spark)).count() == 0
    units = ts.units(ts.to_streams(docs)).where("doc_id = 7").orderBy("offset").collect()
    assert b"".join(bytes(u.data) for u in units) == want and len(units) == -(-len(want) // ts.UNIT)
