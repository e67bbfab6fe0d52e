import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from waymark.llm import media_chunks, warc


def test_payloads_come_back(spark, folder, odd):
    rows = {i: r for i, r in enumerate(media_chunks.op5_media_chunks(spark, folder(extra=True, documents=odd)).collect())}
    assert len(rows) == len(odd)
    texts = {}
    for i, t, *_ in odd:
        texts.setdefault(i, set()).add(t)
    for r in rows.values():
        (t,) = texts[r.doc_id]
        data = (t or "").encode()
        full = data + bytes(-len(data) % 64 or (64 if not data else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    same = [r for r in rows.values() if r.doc_id in (3, 4)]
    assert len({(r.media_bytes, r.media_sha256, r.feature) for r in same}) == 1


def test_store_is_written_and_verified(spark, folder, odd):
    docs = spark.read.parquet(folder(documents=odd) + "/documents.parquet").select("doc_id", "text")
    lists, store = media_chunks.recipes(docs, "text", "doc_id"), media_chunks.settled(media_chunks.store(docs, "text"))
    assert store.inputFiles() and store.count() == store.select("digest").distinct().count()
    assert media_chunks.with_features(media_chunks.read_back(lists, store)).count() == lists.select("payload_digest").distinct().count()
    lost = store.orderBy("digest").offset(1)
    with pytest.raises(Exception, match="not in the store"):
        media_chunks.with_features(media_chunks.read_back(lists, lost)).collect()


def test_few_frames_are_sent(spark, folder):
    """Chunks that come up once stay where they are cut: what is shuffled is small against what is stored."""
    docs = [(i, "".join(random.Random(i).choices("0123456789abcdef", k=3000)), None, None, None) for i in range(400)]
    docs += [(1000 + i, t, None, None, None) for i, t, *_ in docs[:5]]
    path = folder(documents=docs)
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    moved = lambda: sum(stages().apply(k).shuffleWriteBytes() for k in range(stages().size()))
    before = moved()
    rows = media_chunks.op5_media_chunks(spark, path).collect()
    assert len(rows) == 405 and sum(r.media_bytes for r in rows) > 600_000
    assert moved() - before < 300_000


def test_each_chunk_is_stored_once_with_or_without_marks(spark, folder, odd):
    docs = spark.read.parquet(folder(documents=odd) + "/documents.parquet").select("doc_id", "text")
    marks = media_chunks.again(media_chunks.recipes(docs, "text", "doc_id"))
    met = Counter(hashlib.sha256(c).digest() for _, t, *_ in odd for c in media_chunks.chunks(media_chunks.padded((t or "").encode())))
    bits = len(marks).bit_length() + 2
    assert set(np.flatnonzero(np.unpackbits(marks))) == {int.from_bytes(d[:4], "big") >> (32 - bits) for d, n in met.items() if n > 1}
    told = lambda *marks: sorted((bytes(r.digest), bytes(r.frame), r.whole, r.part) for r in media_chunks.store(docs, "text", *marks).collect())
    assert told() == told(marks) == told(np.full_like(marks, 255)) and len(told()) == len({r[0] for r in told()})


def test_no_payload(spark, folder):
    assert media_chunks.op5_media_chunks(spark, folder(documents=[])).collect() == []


def test_cuts_follow_content():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(400_000))
    ends = media_chunks.cuts(data)
    sizes = [j - i for i, j in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= media_chunks.LONGEST and min(sizes[:-1]) >= media_chunks.SHORTEST
    moved = media_chunks.chunks(b"ahead" + data)
    assert len(set(moved) & set(media_chunks.chunks(data))) > len(ends) - 5


def test_gear_hash_by_hand():
    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(30_000))
    marks, h = [], 0
    for k, b in enumerate(data):
        h = ((h << 1) + int(media_chunks.GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - (media_chunks.MEAN.bit_length() - 1)) == 0:
            marks.append(k + 1)
    at, want = 0, []
    while len(data) - at > media_chunks.SHORTEST:
        at = min(next((m for m in marks if m >= at + media_chunks.SHORTEST), len(data)), at + media_chunks.LONGEST, len(data))
        want.append(at)
    assert media_chunks.cuts(data) == want + ([len(data)] if at < len(data) else [])


PAGES = [(3, "http://u", "x" * 200), (1, "http://v\nz", "x" * 200), (None, None, "x" * 200), (2, "u", None), (7, "q", "short"), (8, "q", "short"), (9, "é", "<p>é</p>" * 5000), (11, "r", "<p>é</p>" * 5000), (12, "", "")]


def test_archives(spark, folder):
    got = {r.page_id: r for r in warc.op9_warc(spark, folder(extra=True, pages=PAGES)).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {3: 1, None: 1, 11: 9}


def test_empty_archive(spark, folder):
    assert warc.op9_warc(spark, folder(pages=[])).collect() == []


def test_predicates_and_skipping(spark, folder, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archives(warc.archive_rows(pages), path)
    read = warc.read_archives(spark, path)
    assert read.count() == len(PAGES)
    assert [r.payload for r in read.filter("page_id = 7 and record_type = 'response'").collect()] == [bytearray(b"short")]
    assert {r.payload for r in warc.read_archives(spark, path, payloads=False).collect()} == {None}
    assert read.filter("url = 'http://v%0Az'").count() == 1

    assert {r.page_id for r in warc.read_archives(spark, path, record_type="revisit").collect()} == {3, None, 11}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = warc.read_archives(spark, path, payloads=False).filter("record_type = 'revisit' and page_id = 3")
        assert [r.refers_to for r in pushed.collect()] == [1]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = warc.FilteringWarcReader(path, True)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == []
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


def test_many_repeated_payloads(spark, monkeypatch):
    pages = spark.createDataFrame([*PAGES, (3, "again", "x" * 200)], "page_id long, url string, html string")
    rows = lambda **k: sorted(map(str, warc.archive_rows(pages, **k).collect()))
    assert rows(most_sent=0) == rows()


def test_payloads_that_nobody_wants_are_not_decoded(tmp_path):
    r = random.Random(4)
    n, size = 20, 200_000
    rows = [type("Row", (), {"page_id": i, "url": "u", "record_type": "response" if i % 2 else "revisit", "payload_bytes": size, "payload_digest": "d", "refers_to": None, "payload": r.randbytes(size)}) for i in range(n)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(warc.record(x)) for x in rows))
    for payloads, where, wanted in ((False, {}, 0), (True, {"page_id": 7}, 1), (True, {"record_type": "response"}, n // 2)):
        reader = warc.WarcReader(str(tmp_path), payloads, where)
        found = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
        assert len([x for x in found if x["payload"] is not None]) == wanted
        assert reader.bytes_decoded <= wanted * (size + 2 * warc.BODY_STEP) + n * 2 * warc.HEAD_STEP
        assert reader.bytes_read <= wanted * (size + 2 * warc.BODY_STEP) + n * 3 * warc.HEAD_STEP
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(warc.record(type("Row", (), {**vars(x), "payload": b"<p>small</p>"}))) for x in rows))
    reader = warc.WarcReader(str(tmp_path), True)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == n
    assert reader.bytes_read <= 2 * (tmp_path / "a.warc.gz").stat().st_size


def test_members_without_length_field(tmp_path):
    import gzip

    row = type("Row", (), {"page_id": 1, "url": "u", "record_type": "response", "payload_bytes": 3, "payload_digest": "d", "refers_to": None, "payload": b"abc"})
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(warc.record(row)) + warc.member(warc.record(row)) + gzip.compress(warc.record(row)))
    reader = warc.WarcReader(str(tmp_path), True)
    found = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert [x["payload"] for x in found] == [b"abc"] * 3
