import base64
import gzip
import hashlib
import io
from collections import defaultdict
from urllib.parse import urlparse

import pytest

from aspectra.llm import warc


def want(rows, smallest=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in groups[b] if x is not None]
        head = max(ids) if ids and len(b) >= smallest else None
        plain = head is None or i == head
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), digest, "response" if plain else "revisit", None if plain else head))
    return sorted(out, key=str)


ROWS = [(i, f"http://x/{i}", h) for i, h in enumerate(["a", "b", "a", None, "", "é" * 100000, "é" * 100000, "a\r\n\r\nWARC/1.1\r\n", "q" * warc.CHUNK, "q" * (warc.CHUNK + 1)])]
ROWS += [(None, None, "zz"), (9, "u\r\nX: y", "zz"), (None, "v", "alone"), (20, "w", "twice"), (20, "w", "twice")]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "r", 1) for i, u, h in rows], "page_id long, url string, html string, record string, n int")


@pytest.mark.parametrize("smallest", [0, 3])
def test_pages(spark, smallest):
    got = sorted((tuple(r) for r in warc.archive_pages(frame(spark, ROWS), smallest).collect()), key=str)
    assert got == want(ROWS, smallest)


def test_empty(spark):
    assert warc.archive_pages(frame(spark, []).limit(0)).count() == 0


def test_chunks_and_files(spark):
    manifest = warc.write_archives(frame(spark, ROWS))
    chunks = warc.read_archives(manifest).collect()
    whole = defaultdict(bytes)
    for c in sorted(chunks, key=lambda c: c.chunk_no):
        whole[c.record] += bytes(c.data)
        assert hashlib.sha1(whole[c.record]).hexdigest() == c.sha1 and len(whole[c.record]) == c.n
    assert max(len(c.data) for c in chunks) <= warc.CHUNK
    big = [c for c in chunks if c.id == 6 and c.kind == "response"]
    assert len(big) == -(-200000 // warc.CHUNK) and sum(c.last for c in big) == 1
    uri = manifest.first().uri
    raw = gzip.decompress(open(urlparse(uri).path, "rb").read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"\r\nX: y" not in raw
    assert warc.open_archive(spark, [r.uri for r in manifest.collect()]).count() == len(chunks)


def test_long_urls_and_shuffled_input(spark):
    """Headers of any length; input that comes from an exchange; digests carried over chunks."""
    rows = [(1, "http://x/" + "é" * (2 << 20), "a"), (2, "u" * (3 << 20), "b" * 500_000), (3, "v", "b" * 500_000)]
    df = frame(spark, rows * 5)
    got = sorted((tuple(r) for r in warc.archive_pages(df.repartition(3, "page_id")).collect()), key=str)
    assert got == want(rows * 5)
    chunks = warc.chunked(warc.stable_rows(frame(spark, ROWS), "page_id", "url", "html"), 7)
    digests = {r.row: (r.n, r.sha1) for r in warc.payload_digests(chunks).collect()}
    payloads = [(h or "").encode() for _, _, h in ROWS]
    assert sorted(digests.values()) == sorted((len(p), hashlib.sha1(p).hexdigest()) for p in payloads)


def archive(digest="sha1:" + base64.b32encode(hashlib.sha1(b"hi").digest()).decode(), end=b"\r\n\r\n"):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: {digest}\r\nContent-Length: 2\r\n\r\n"
    return gzip.compress(head.encode() + b"hi" + end)


def test_broken_archives():
    read = lambda raw: list(warc.read_records(io.BytesIO(raw)))
    assert len(read(archive() + archive())) == 2
    for bad in (archive("sha1:AAAA"), archive(end=b"\r\n"), archive()[:-12], gzip.compress(b"HELLO\r\n\r\n")):
        with pytest.raises((warc.WarcError, EOFError)):
            read(bad)
