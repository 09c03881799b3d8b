"""Archives against the pages themselves: nulls, empty and very long pages, copies, repeated rows, damage, lost attempts, an empty table, clashing columns."""

import base64
import glob
import hashlib
import os
import random

import pytest
import zstandard

from feedloom.llm import warc

SCHEMA = "page_id long, url string, html string, row long, page string, same int, digest string, bundle string, payload string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", 2, "y", "z", "w") for i, u, h in rows], SCHEMA)


def expected(rows, least=0):
    """Rows without an id sort last; of rows that repeat page and payload one is the response."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for page, _, html in order:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) >= least and data in first:
            out.append((page, len(data), digest, "revisit", first[data]))
        else:
            first[data] = page
            out.append((page, len(data), digest, "response", None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abc <p>é\r\n日\x00&") for _ in range(n))
    rows = [(i, f"http://example.org/{i}?q=a b\r\nX: y&é", text(r.randint(0, 3000))) for i in range(200)]
    hot = "<html>same</html>"
    rows += [(300 + i, "http://h/", hot) for i in range(150)] + [(1000, None, None), (1001, "", ""), (1002, "u", None), (1003, "u", ""), (-7, "u", hot), (None, "u", hot), (None, "u", "only\r\n\r\nhere")]
    rows += [(2000, "u", text(700_000)), (2001, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (2002, "u", rows[3][2]), (2002, "u", rows[3][2])]
    return rows


@pytest.fixture(scope="module")
def archive(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc") / "a")
    warc.write_archive(frame(spark, rows).repartition(4), folder, frame_bytes=20_000, bundle_bytes=150_000)
    return folder


def test_archive_reads_back(spark, rows, archive):
    assert got(warc.read_archive(spark, archive)) == expected(rows)


def test_least_bytes_and_defaults(spark, rows, tmp_path):
    warc.write_archive(frame(spark, rows), str(tmp_path / "b"), least=10)
    assert got(warc.read_archive(spark, str(tmp_path / "b"))) == expected(rows, 10)
    assert got(warc.archived(frame(spark, rows))) == expected(rows)


def test_bundles_are_plain_zstandard_with_a_seek_table(archive):
    files = glob.glob(f"{archive}/bundles/*.warc.zst")
    assert len(files) > 4 and not glob.glob(f"{archive}/parts/*")
    for path in files:
        with open(path, "rb") as f:
            data = f.read()
            frames = warc.read_seek_table(f, len(data))
            plain = b"".join(warc.read_frame(f, e) for e in frames)
        # any decompressor that goes on over frames reads the same
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == plain
        assert len(frames) > 1 and frames[-1][0] + frames[-1][1] + 8 + 12 * len(frames) + 9 == len(data)
        at, kinds = 0, []
        while at < len(plain):
            headers, _, at = warc.parsed(plain, at)
            kinds.append(headers["WARC-Type"])
            assert all("\r" not in v and "\n" not in v for v in headers.values())
        assert kinds[0] == "warcinfo" and set(kinds[1:]) <= {"response", "revisit"}


def test_fetch_reads_records_by_identifier(spark, rows, archive):
    wanted = [0, 5, 310, 399, 1000, 2000, 2002, 77_777]
    found = warc.fetch(spark, archive, spark.createDataFrame([(i,) for i in wanted], "page_id long")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in found) == sorted((i, (h or "").encode()) for i, _, h in rows if i in wanted)
    assert all(warc.page_of(r.record_id) == r.page_id for r in found)


def test_index_maps_records_to_places(spark, archive):
    index = spark.read.parquet(f"{archive}/index").collect()
    assert len({r.record_id for r in index}) == len(index)
    for r in index[::17]:
        path = f"{archive}/bundles/{r.bundle}"
        with open(path, "rb") as f:
            data = warc.read_frame(f, warc.read_seek_table(f, os.path.getsize(path))[r.frame])
        headers, _, end = warc.parsed(data, r.offset)
        assert headers["WARC-Record-ID"] == r.record_id and end - r.offset == r.length and headers["WARC-Type"] == r.record_type


@pytest.mark.parametrize("page", [0, 1, -1, 12345678901, -(1 << 63), (1 << 63) - 1])
def test_identifiers_hold_the_page(page):
    import uuid
    name = warc.record_id(page, 8_589_934_592)
    assert warc.page_of(name) == page and uuid.UUID(name[10:-1]).version == 8 and warc.record_id(page, 1) != name


def test_damage_is_found(spark, rows, tmp_path):
    folder = str(tmp_path / "c")
    warc.write_archive(frame(spark, rows[:30]).coalesce(1), folder)
    path = glob.glob(f"{folder}/bundles/*")[0]
    data = bytearray(open(path, "rb").read())
    with open(path, "rb") as f:
        start, packed, *_ = warc.read_seek_table(f, len(data))[1]
    data[start + packed // 2] ^= 0x5A
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        warc.read_archive(spark, folder).collect()


def test_files_of_lost_attempts_are_not_read(spark, rows, tmp_path):
    folder = str(tmp_path / "d")
    os.makedirs(f"{folder}/parts")
    open(f"{folder}/parts/000000-0000-999.warc.zst", "wb").write(b"half a file")
    warc.write_archive(frame(spark, rows), folder)
    assert got(warc.read_archive(spark, folder)) == expected(rows)
    # publishing again, as a repeated task would, changes nothing
    names = [os.path.basename(p) for p in glob.glob(f"{folder}/bundles/*")]
    import pyarrow as pa
    list(warc.published(folder, [pa.RecordBatch.from_arrays([pa.array(names)], ["bundle"])]))
    assert got(warc.read_archive(spark, folder)) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert got(warc.archived(frame(spark, []))) == []


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got(warc.archived(pages)) == expected([(r.page_id, r.url, r.html) for r in pages.collect()])
