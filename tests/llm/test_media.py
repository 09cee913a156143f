import hashlib
import zipfile
import zlib

import pytest

from brooktext.llm.media import ArchiveReader, ByteRange, feature, media_table, padded, png, read_archives, samples, with_features, write_archives
from brooktext.llm.shared import file_system, new_folder


def brute(doc_id, text):
    data = (text or "").encode()
    load = data + bytes(-len(data) % 64 or (0 if data else 64))
    return doc_id, len(data), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-64:])


def test_round_trip(odd, empty, docs):
    assert media_table(empty).count() == 0
    for df in (odd, docs):
        got = media_table(df).collect()
        key = lambda r: repr(r)
        assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=key) == sorted((brute(r.doc_id, r.text) for r in df.collect()), key=key)
        of = {}
        assert all(of.setdefault(r.payload_sha256, (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes) for r in got)


def test_damage_is_seen():
    image = bytearray(png(padded(b"some text")))
    image[45] ^= 1
    with pytest.raises(ValueError):
        samples(bytes(image))
    assert samples(png(padded(b""))) == bytes(64) and feature(bytes(64)) == "0.0000:0.0000:0.0000:0000000000000000"


def test_ranges_and_batches(spark, docs):
    folder = new_folder(spark, "media-test")
    write_archives(docs, folder, archive_bytes=20_000)
    whole = {tuple(r) for r in with_features(read_archives(spark, folder)).collect()}
    small = read_archives(spark, folder, range_bytes=3000, batch_bytes=500)
    assert small.rdd.getNumPartitions() > 40
    assert {tuple(r) for r in with_features(small).collect()} == whole and len(whole) == docs.count()


class Flaky:
    """A file some of whose reads fail or come back short or damaged."""

    def __init__(self, file, harm):
        self.file, self.harm = file, harm

    def __getattr__(self, name):
        return getattr(self.file, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read(self, *n):
        return self.harm(self.file.tell(), self.file.read(*n))


def test_members_are_retried_alone(spark, docs):
    folder = new_folder(spark, "media-test")
    write_archives(docs.limit(5).coalesce(1), folder)
    reader = ArchiveReader({"path": folder})
    (part,) = reader.partitions()
    opened, opens = reader.opened, []

    def through(harm):
        opens.clear()

        def harmed(path):
            opens.append(path)
            return Flaky(opened(path), lambda at, data, k=len(opens): harm(k, at, data))

        reader.opened = harmed
        return [i for b in reader.read(part) for i in b.column("doc_id").to_pylist()]

    whole = through(lambda k, at, data: data)
    assert len(whole) == 5 and len(opens) == 1  # a range is one open file
    infos = sorted(zipfile.ZipFile(opened(part.path)).infolist(), key=lambda i: i.header_offset)
    third = infos[2].header_offset + 60

    def damaged(k, at, data):
        return data[: third - at] + b"?" + data[third - at + 1 :] if k == 1 and at == 0 and len(data) > third else data

    assert through(damaged) == whole and len(opens) == 2  # only the third member is read again
    assert through(lambda k, at, data: data[:third] if k == 1 and at == 0 and len(data) > third else data) == whole and len(opens) == 4  # the third and those after it

    def lost(k, at, data):
        if k in (1, 3) and len(data) > 100:
            raise OSError("lost")
        return data

    assert through(lost) == whole
    with pytest.raises((OSError, zipfile.BadZipFile)):
        through(lambda k, at, data: b"")
    reader.opened = opened
    cut = ByteRange(part.path, part.size, 1, part.size)  # without the first member
    assert sum(b.num_rows for b in reader.read(cut)) == 4


def test_unlisted_archives_are_not_read(spark, docs):
    folder = new_folder(spark, "media-test")
    write_archives(docs, folder)
    fs, root = file_system(folder)
    with fs.open_output_stream(f"{root}/lost-attempt.zip") as f:
        f.write(b"half a file")
    assert read_archives(spark, folder).count() == docs.count()
