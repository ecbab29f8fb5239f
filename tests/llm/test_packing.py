import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.helpers import documents, empty
from tidemill.llm import packing
from tidemill.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN, KEPT = Tokenizer.from_file(PATH), Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab' \n\t'sré1²　\u0085\x1c中.!_😀") | st.characters(codec="utf-8"), max_size=60))
def test_ids_equal_the_tokenizers(text):
    text = text + "<|endoftext|>" * (len(text) % 7 == 6)
    assert np.frombuffer(KEPT.encode([text])[0], "<u2").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_ids_of_a_table(spark):
    assert KEPT.quick is not None
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert all(np.frombuffer(a, "<u2").tolist() == b.ids for a, b in zip(KEPT.encode(texts), PLAIN.encode_batch(texts, add_special_tokens=False), strict=True))


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Encoder(path)
    assert other.quick is None
    assert np.frombuffer(other.encode(["Ab c <|endoftext|>"])[0], "<u2").tolist() == Tokenizer.from_file(path).encode("Ab c <|endoftext|>", add_special_tokens=False).ids


def check(docs, pieces):
    """Every id in exactly one piece, sequences full and gapless."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    for s, parts in by_sequence.items():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at and length > 0
            at += length
        assert at == packing.WINDOW or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc_id, text in docs:
        ids = np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[doc_id], key=lambda p: p["start"])
        copies = sum(p["length"] for p in own) // len(ids)
        assert sum(p["length"] for p in own) == copies * len(ids)
        for p in own:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())


def test_small(spark):
    docs = documents(spark).repartition(3)
    check([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack(docs, PATH).collect())
    assert packing.pack(empty(spark), PATH).count() == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    check([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack(docs, PATH).collect())
