import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventloom.llm.completion import best_fit, complete, dominated, fillings, lower_bound, op12_completion, pack_documents

SCHEMA = "doc_id long, text string, length int"


def valid(plan, counts, capacity):
    laid = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= capacity and times > 0
        for k in lengths:
            laid[k] += times
    assert laid == +Counter(counts)
    return sum(t for _, t in plan)


def optimum(items, capacity):
    @lru_cache(None)
    def fewest(left):
        if not left:
            return 0
        rest = left[1:]
        return 1 + min(fewest(tuple(x for i, x in enumerate(rest) if i not in pick))
                       for n in range(len(rest) + 1) for pick in combinations(range(len(rest)), n)
                       if left[0] + sum(rest[i] for i in pick) <= capacity)
    return fewest(tuple(sorted(items, reverse=True)))


@pytest.mark.parametrize("seed", range(40))
def test_small_sets_are_packed_best(seed):
    r = random.Random(seed)
    low, high = r.choice([(1, 30), (5, 20), (8, 14)])
    items = [r.randint(low, high) for _ in range(10)]
    counts = Counter(items)
    got, best = valid(complete(counts, 30), counts, 30), optimum(items, 30)
    assert lower_bound(counts, 30) <= best == got <= valid(best_fit(counts, 30), counts, 30)


def test_search_beats_best_fit():
    # best-fit decreasing takes 10 + 9; the pairs 10 + 6 + 4 and 9 + 8 + 3 fill two sequences
    counts = {10: 1, 9: 1, 8: 1, 6: 1, 4: 1, 3: 1}
    assert valid(best_fit(counts, 20), counts, 20) == 3 and valid(complete(counts, 20), counts, 20) == 2


def test_fillings_are_those_no_other_dominates():
    counts = {9: 1, 6: 2, 5: 1, 3: 2, 2: 1}
    got = {tuple(sorted(f)): slack for f, slack in fillings(counts, sorted(counts), 11, 11)}
    for f, slack in got.items():
        assert sum(f) + slack == 11 and not Counter(f) - Counter(counts)
    every = {tuple(sorted(c)) for n in range(5) for c in combinations([9, 6, 6, 5, 3, 3, 2], n) if sum(c) <= 11}
    assert set(got) == {f for f in every if not dominated(f, sum(1 << k for k in counts if counts[k] > f.count(k)), 11 - sum(f))}
    assert (2, 9) in got and (2, 6) not in got


def test_many_documents():
    r = random.Random(4)
    counts = {r.randint(1, 2047): r.randint(1, 10**6) for _ in range(400)}
    got = valid(complete(counts, 2048, 1500), counts, 2048)
    assert got <= valid(best_fit(counts, 2048), counts, 2048) and got <= 1.02 * lower_bound(counts, 2048)
    assert complete({}) == []


def check(docs, rows, window=2048):
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
        for i, r in enumerate(sorted(by_doc[d], key=lambda r: r.start)):
            assert r.start == at and r.piece == i and (i == 0 or r.length == window)
            assert zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()) == (r.ids_crc32 if hasattr(r, "ids_crc32") else zlib.crc32(bytes(r.ids)))
            at += r.length
        assert at == len(ids) and len(by_doc[d]) == -(-len(ids) // window)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    rests = Counter(len(ids) % window for ids in want.values())
    rests.pop(0, None)
    return len(by_seq), sum(len(ids) // window for ids in want.values()) + lower_bound(rests, window)


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    used, bound = check([tuple(d) for d in docs], op12_completion(spark, "/root/testdata/sf0.01").collect())
    assert used <= bound + 1


def test_nulls_copies_and_odd_text(spark):
    docs = [(i, "same words again " * 120, 1) for i in range(40)] + [(100, None, 1), (101, "", 1), (102, "x" * 50000, 1), (103, "a " * 30_000, 1),
            (104, "a" + " a" * 2046, 1), (105, "漢字 \u0085 Ω <|endoftext|> é ß", 1)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS rest", "2 AS part", "3 AS ids", "4 AS piece").repartition(5)
    used, bound = check([d[:2] for d in docs], pack_documents(df).collect())
    assert used <= bound + 1
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_and_null_ids(spark):
    docs = [(i, t, 1) for i in (None, 7) for t in ("one two", "one two", "three")]
    rows = pack_documents(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == 6 and {r.sequence_id for r in rows} == {0} and sorted(r.offset for r in rows)[0] == 0
    assert sum(r.length for r in rows) == max(r.offset + r.length for r in rows)
