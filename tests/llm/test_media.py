import hashlib
import io
import zipfile
import zlib

import pytest

from voltweave.llm import media
from voltweave.llm.common import new_path


def test_round_trip(make, odd, spark):
    got = media.write_and_describe(make(odd)).collect()
    assert len(got) == len(odd)
    want = []
    for d, t, *_ in odd:
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        png = media.to_png(data, len(raw))
        want.append((str(d), len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(png), hashlib.sha256(png).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:7]) for r in got) == sorted(want)
    assert len({r.feature for r in got if r.doc_id == 4}) == 1


def test_empty_table(make):
    assert media.write_and_describe(make([]).filter("false")).count() == 0


def test_archives_are_plain_zip_and_ranges_cover_them(make, spark):
    folder = new_path(spark, "m")
    assert media.write_archives(make([(i, f"text {i}" * i) for i in range(50)]).coalesce(1), folder) == 50
    files, path = media.filesystem(folder)
    with files.open_input_file(f"{path}/part-000000-0000-m50.zip") as f:
        data = f.read()
    archive = zipfile.ZipFile(io.BytesIO(data))
    assert archive.testzip() is None and len(archive.namelist()) == 50
    members = len(data) - media.END - 50 * media.RECORD
    for name in ("part-000000-0000-m50.zip", "other.zip"):  # the second says nothing of its members
        got = media.read_archives(spark, folder, partitionBytes=members // 7, batchBytes=300)
        assert got.rdd.getNumPartitions() == 8
        assert {r.doc_id: media.from_png(bytes(r.media))[0].rstrip(b"\0").decode() for r in got.collect()} == {i: f"text {i}" * i for i in range(50)}
        files.move(f"{path}/{name}", f"{path}/other.zip")
    files.move(f"{path}/other.zip", f"{path}/other-m51.zip")
    with pytest.raises(Exception):
        media.read_archives(spark, folder).collect()


def test_members_are_retried_alone():
    out = io.BytesIO()
    archive = media.Archive(out)
    for i in range(3):
        archive.add(f"{i:+020d}", bytes([i]) * 100)
    archive.close()
    data = out.getvalue()
    opened, reads = [], []

    class Flaky(io.BytesIO):
        def read(self, n=-1):
            reads.append(self.tell())
            if len(opened) < 3 and n == 100:
                raise OSError("gone")
            return super().read(n)

    def opener():
        opened.append(1)
        return Flaky(data)

    reader = media.ArchiveReader({"path": "x"})
    offset = media.LOCAL + media.NAME + 100
    assert reader.member(opener, None, offset, 100, zlib.crc32(b"\1" * 100))[0] == b"\1" * 100
    assert len(opened) == 3 and min(reads) >= offset
    with pytest.raises(OSError):
        reader.member(lambda: io.BytesIO(data), None, offset, 100, 1)
