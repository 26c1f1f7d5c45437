import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from eventloom.llm.packing import digest, pack_documents, plan

SCHEMA = "doc_id long, text string, length int"


def check(docs, rows, window=1024):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = {d: tok.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    rows = digest(pack_documents(docs)).collect()
    assert check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], rows) == 0


def test_nulls_copies_and_odd_text(spark):
    docs = [(i, "same words again " * 120, 1) for i in range(40)] + [(100, None, 1), (101, "", 1), (102, "x" * 5000, 1),
            (103, "漢字 \u0085 Ω <|endoftext|> é ß", 1)]
    rows = digest(pack_documents(spark.createDataFrame(docs, SCHEMA))).collect()
    assert check([d[:2] for d in docs], rows) == 0
    assert digest(pack_documents(spark.createDataFrame([], SCHEMA))).count() == 0


def test_plan_takes_everything_once():
    counts = {700: 5, 324: 3, 512: 7, 1: 9, 1023: 2, 333: 4}
    left = dict.fromkeys(counts, 0)
    for lengths, times in plan(dict(counts)):
        assert sum(lengths) <= 1024
        for x in lengths:
            left[x] += times
    assert left == counts
