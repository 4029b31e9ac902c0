"""Rolling by compressed size, ids with gaps, and urls that would end a header line."""

import random

from lodestrand.llm import warc


def pages(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"page_id {kind}, url string, html string").repartition(3)


def test_files_roll_by_compressed_size(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://a/{i}", rng.randbytes(300).hex()) for i in range(60)]
    out = str(tmp_path / "r")
    warc.write(pages(spark, rows), out, roll_bytes=2000)
    files = spark.read.parquet(f"{out}/manifest.parquet").orderBy("file").collect()
    assert len(files) > 8 and all(f.bytes <= 2000 for f in files) and sum(f.records for f in files) == 60
    assert all(a.last_id < b.first_id for a, b in zip(files, files[1:]))
    assert {(r.page_id, r.payload.decode()) for r in warc.read(spark, out).collect()} == {(i, h) for i, _, h in rows}
    warc.write(pages(spark, rows), str(tmp_path / "s"), roll_bytes=1)  # a record is never parted
    assert spark.read.parquet(f"{tmp_path}/s/manifest.parquet").count() == 60


def test_ranges_of_ids_with_gaps(spark, tmp_path):
    ids = [*range(200), 2**40, -(2**63), 2**63 - 1, None]
    rows = [(i, "u", f"h{i}") for i in ids]
    for per in (3, 40):  # many bounds and few
        out = str(tmp_path / f"g{per}")
        warc.write(pages(spark, rows), out, per_range=per)
        files = spark.read.parquet(f"{out}/manifest.parquet").collect()
        assert len(files) > 2 and max(f.records for f in files) <= 4 * per + 8
        assert {r.page_id for r in warc.read(spark, out).collect()} == set(ids)
    named = [(f"a b\r\n%{i}é", "u", "same") for i in range(9)]
    warc.write(pages(spark, named, "string"), str(tmp_path / "n"), per_range=2)
    got = warc.read(spark, str(tmp_path / "n"), "string").collect()
    assert {r.page_id for r in got} == {n[0] for n in named} and {r.refers_to for r in got} == {None, min(n[0] for n in named)}


def test_urls_with_line_ends(spark, tmp_path):
    urls = ["http://a/\r\nWARC-Type: revisit", "x\r\ny", "\r\n\r\n", "http://a/b c\t\x00\x7f", "é \u0085", ""]
    rows = [(i, u, "same") for i, u in enumerate(urls)]
    out = str(tmp_path / "u")
    warc.write(pages(spark, rows), out)
    got = {r.page_id: r for r in warc.read(spark, out).collect()}
    assert [got[i].record_type for i in range(6)] == ["response"] + ["revisit"] * 5 and all(got[i].refers_to == 0 for i in range(1, 6))
    assert got[0].url == "http://a/%0D%0AWARC-Type:%20revisit" and got[4].url == urls[4] and got[5].url == ""
