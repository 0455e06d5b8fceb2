"""Large WARC files cut at records."""

import gzip
import random

import pytest

from sitelake.sources import splits
from sitelake.sources.warc import read_warc

LOOKS_LIKE = b"\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def record(i, body):
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://x.test/{i}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def bodies(seed, n=60, tricky=True):
    draw = random.Random(seed)
    out = [draw.randbytes(draw.choice([0, 1, 50, 400, 3000])) for _ in range(n)]
    if tricky:
        for i in range(0, n, 7):
            out[i] = b"x" * draw.randrange(200) + LOOKS_LIKE * draw.randrange(1, 20) + b"y" * 100
        out[n // 2] = b"z" * 40_000
    return out


def members(i, body):
    """A gzip member whose body may hold whole members, which stay as they are."""
    return gzip.compress(record(i, body), compresslevel=0 if i % 3 == 0 else 6)


def rows(df):
    return sorted((r.file, r.seq, r.target_uri, r.content_length, bytes(r.body or b""), r._error) for r in df.collect())


@pytest.mark.parametrize("size", [500, 2_000, 30_000])
@pytest.mark.parametrize("packed", [False, True])
def test_cut_files_give_the_same_rows(spark, tmp_path, packed, size):
    parts = bodies(3)
    if packed:
        # Members within a body look like members of the file.
        parts[9] = b"".join(members(3, b"inner" * 30) for _ in range(40))
        data = b"".join(members(i, b) for i, b in enumerate(parts))
    else:
        data = b"".join(record(i, b) for i, b in enumerate(parts))
    path = tmp_path / ("a.warc.gz" if packed else "a.warc")
    path.write_bytes(data)
    whole = rows(read_warc(spark, str(tmp_path), split=None))
    assert len(whole) == len(parts) and [r[4] for r in whole] == parts
    cut = read_warc(spark, str(tmp_path), split=size)
    assert rows(cut) == whole
    assert cut.rdd.getNumPartitions() > 1
    found = splits.find_splits(spark, str(tmp_path), [(str(path), len(data))], size)
    assert found[0].start == 0 and found[-1].end == len(data)
    assert [s.start for s in found[1:]] == [s.end for s in found[:-1]]


def test_a_record_across_every_cut(spark, tmp_path):
    data = b"".join(record(i, b"b" * 1000) for i in range(64))
    (tmp_path / "a.warc").write_bytes(data)
    size = -(-len(data) // 8)
    starts, at = set(), 0
    for i in range(64):
        starts.add(at)
        at += len(record(i, b"b" * 1000))
    assert not starts & {k * size for k in range(1, 8)}
    cut = read_warc(spark, str(tmp_path), split=size)
    assert cut.rdd.getNumPartitions() == 8
    assert [r[1] for r in rows(cut)] == list(range(64))


def test_small_files_and_other_forms_stay_whole(spark, tmp_path):
    data = b"".join(record(i, b"b" * 1000) for i in range(20))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(data, compresslevel=0))
    (tmp_path / "small.warc").write_bytes(record(0, b"s"))
    cut = read_warc(spark, str(tmp_path), split=3_000)
    assert cut.rdd.getNumPartitions() == 2
    assert rows(cut) == rows(read_warc(spark, str(tmp_path), split=None))


@pytest.mark.parametrize("packed", [False, True])
def test_malformed_files_are_not_cut(spark, tmp_path, packed):
    parts = [record(i, b"b" * 500) for i in range(30)]
    parts[12] = b"WARC/1.0\r\nWARC-Type: resource\r\n\r\nno length\r\n\r\n"
    path = tmp_path / ("a.warc.gz" if packed else "a.warc")
    path.write_bytes(b"".join(gzip.compress(p) if packed else p for p in parts))
    for mode in ("DROPMALFORMED", "FAILFAST"):
        cut, whole = (read_warc(spark, str(tmp_path), mode, split=s) for s in (1_000, None))
        if mode == "DROPMALFORMED":
            assert rows(cut) == rows(whole) and sum(r[5] is not None for r in rows(cut)) >= 1
        else:
            with pytest.raises(Exception, match="Content-Length"):
                cut.collect()


def test_a_file_cut_short(spark, tmp_path):
    data = b"".join(record(i, b"b" * 500) for i in range(30))
    (tmp_path / "a.warc").write_bytes(data[:-100])
    cut, whole = (read_warc(spark, str(tmp_path), "DROPMALFORMED", split=s) for s in (1_000, None))
    assert rows(cut) == rows(whole)
    assert rows(cut)[-1][5] == "record body cut short"
