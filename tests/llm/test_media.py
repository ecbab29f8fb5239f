import hashlib
import zlib

import numpy as np

from tests.llm.helpers import documents, empty
from tidemill.llm import media


def slow_cuts(data, least, typical, greatest):
    bits, ends, at = typical.bit_length() - 1, [], 0
    while at < len(data):
        end = min(at + greatest, len(data))
        for i in range(at + least, end + 1):
            h = 0
            for b in data[max(0, i - 32) : i]:
                h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
            if h >> (32 - bits) == 0:
                end = i
                break
        ends.append(end)
        at = end
    return ends


def test_cuts_match_a_rolling_loop():
    data = np.random.default_rng(1).integers(97, 105, 4000, dtype=np.uint8)
    got = media.cuts(data, 64, 256, 700)
    want = slow_cuts(data.tolist(), 64, 256, 700)
    assert len(got) > 5 and got[-1] == len(data)
    assert got[:-2] == want[: len(got) - 2]


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(2)
    body = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    one = {hashlib.sha256(c).digest() for c in media._chunks(body)}
    two = [hashlib.sha256(c).digest() for c in media._chunks(b"something before it" + body)]
    assert sum(x in one for x in two) > 0.8 * len(two)


def test_every_row_reads_back(spark):
    docs = documents(spark)
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.store_media(docs).collect()}
    assert media.store_media(docs).count() == docs.count()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        x = got[r["doc_id"], len(raw)]
        assert (x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.store_media(empty(spark)).count() == 0
