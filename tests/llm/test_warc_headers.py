"""Records of other writers: names in any case, headers that cannot be understood."""

import zlib

from corpusloom.llm import warc


def member(head: str, block: bytes = b"HTTP/1.1 200 OK\r\n\r\nhello") -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def test_odd_headers_give_rows_and_the_rest_is_read(spark):
    good = "WARC-Type: response\r\nWARC-Record-ID: <a>\r\nX-Page-ID: 1\r\nContent-Length: 24\r\n"
    lower = good.lower().replace("<a>", "<b>").replace(": ", ":").replace("id:1", "id:2")
    odd = [
        ("no type", good.replace("WARC-Type: response\r\n", ""), "a record has no type"),
        ("no id", good.replace("WARC-Record-ID: <a>\r\n", ""), "a record has no id"),
        ("segment", good + "WARC-Segment-Number: x\r\n", "WARC-Segment-Number is no number"),
        ("total", good + "WARC-Segment-Total-Length: -3\r\n", "WARC-Segment-Total-Length is no number"),
        ("no colon", good + "nonsense\r\n", None),
        ("digest", good + "warc-payload-digest: sha1:AAAA\r\n", "the digest differs"),
    ]
    data = b"".join([member(lower)] + [member(head) for _, head, _ in odd] + [member(good.replace("Page-ID: 1", "Page-ID: 9"))])
    archives = spark.createDataFrame([(bytearray(data),), (bytearray(member(good.replace("Content-Length: 24", "Content-Length: y"))),), (None,)], "data binary")
    rows = warc.read_archives(archives).collect()
    assert [r.error for r in rows] == [None] + [e for *_, e in odd] + [None, "Content-Length is no number"]
    assert [(r.key, bytes(r.payload)) for r in rows if r.error is None] == [("2", b"hello"), ("1", b"hello"), ("9", b"hello")]
    assert {r.record_type for r in rows if r.error and "digest" not in r.error} == {"damaged"}
