"""The round trip holds each response's payload against the digest that its header gives."""

import pytest

from tidemark.llm import warc

PAGES = "page_id long, url string, html string"


def test_a_payload_that_is_not_what_was_digested_is_an_error(spark, tmp_path, monkeypatch):
    write = warc.write_archives

    def altered(pages, path):
        write(pages, f"{path}-good")
        (tmp_path / "w").mkdir()
        rows = warc.read_archives(spark, f"{path}-good").collect()
        out = [warc.member(warc.record("response", r.record_id.removeprefix("urn:page:"), r.target_uri, bytes(r.payload).replace(b"b", b"c"), r.payload_digest, None)) for r in rows]
        (tmp_path / "w" / "part-0").write_bytes(b"".join(out))

    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], PAGES)
    assert warc.archived(pages, str(tmp_path / "v")).count() == 2
    monkeypatch.setattr(warc, "write_archives", altered)
    with pytest.raises(Exception, match="payload of urn:page:2 has SHA-1"):
        warc.archived(pages, str(tmp_path / "w")).count()
