import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing, pfor, queries
from corpusloom.llm.tokens import Encoder, vocabulary

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_library(name, spark, data):
    path = vocabulary(name)
    library, mine = Tokenizer.from_file(path), Encoder(path)
    assert mine.core is not None
    rng = random.Random(5)
    alphabet = list("ab zA1é'’s\n\t \r  .,!<|_-İßĲŁµ²½") + ["́", "日", " ", "\x1c", "\x85", "<|endoftext|>", "'ll", "Σ", "​", "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(15))) for _ in range(4000)]
    texts += [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_memo_is_bounded():
    encoder = Encoder(vocabulary("word_bpe_49k.json"), most=10)
    for i in range(100):
        encoder.encode(f"word{i} other{i}")
    assert len(encoder.words) < 40


def test_best_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        sizes = rng.integers(1, 101, n)
        bins = packing.best_fit(sizes, 100)
        used = np.bincount(bins, sizes) if n else np.empty(0)
        assert (used <= 100).all() and len(used) <= 1.1 * sizes.sum() / 100 + 1
    assert packing.best_fit(np.array([60, 50, 40, 50]), 100).tolist() == [0, 1, 0, 1]


def test_pieces():
    assert packing.pieces(5, 10) == [(0, 5)] and packing.pieces(10, 10) == [(0, 10)] and packing.pieces(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.pieces(20, 10) == [(0, 10), (10, 10)]


def check_packing(rows, texts, capacity=2048):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    by_doc, by_sequence, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, p in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (p.piece, p.start) == (k, at) and (k == 0 or p.length == capacity) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
        total += at
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_packing_query(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    used, least = check_packing(queries.op3_packing(spark, data).collect(), texts)
    assert used <= 1.03 * least + 1


def test_packing_in_many_partitions(spark, docs):
    rng = random.Random(2)
    texts = {i: "some words here " * rng.randrange(0, 400) for i in range(300)} | {1000: None, 1001: "long " * 9000}
    df = docs([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, bin int").repartition(40)
    for options in ({}, {"fan_in": 2}, {"most_items": 50}):
        used, least = check_packing(packing.pack(df, **options).collect(), texts)
        assert used <= 1.1 * least + 1, options
    assert packing.pack(df.limit(0)).count() == 0
    twice = packing.pack(docs([(1, "a", 0), (1, "a", 0), (None, "b", 0)], "doc_id long, text string, bin int")).collect()
    assert len(twice) == 3 and len({r.sequence_id for r in twice}) == 1


def test_blocks_round_trip():
    rng = random.Random(4)
    for _ in range(400):
        n, top = rng.randrange(1, 400), 2 ** rng.randrange(0, 33) - 1
        ids = np.array([rng.randrange(top + 1) for _ in range(n)], np.uint32)
        ids[rng.randrange(n)] = rng.choice([0, 2**32 - 1, 7])
        assert (pfor.decode_block(pfor.encode_block(ids)) == ids).all()


def test_outliers_go_to_the_exception_list():
    ids = np.arange(4096, dtype=np.uint32) % 100
    ids[[5, 900]] = 2**31
    assert len(pfor.encode_block(ids)) < 4096 * 7 / 8 + 60


def test_file_ranges():
    ids = np.arange(10_000, dtype=np.uint32) * 7 % 50_000
    reader = pfor.Reader(pfor.encode_file([1, None], [9_000, 1_000], ids, block=256))
    for a, b in ((0, 0), (0, 1), (255, 257), (9_999, 10_000), (0, 10_000)):
        assert (reader.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        pfor.Reader(b"XXXX" + bytes(60))


def test_token_files_query(spark, data):
    library, at = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = sorted(queries.op10_token_blocks(spark, data).collect())
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_edges(spark, docs):
    rows = [(3, "a b"), (None, "q"), (1, None), (3, "z"), (2**60 + 1, "k"), (2**60, "k k"), (-5, "")]
    df = docs([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(3)
    for size in (1, 4_000_000):
        found = pfor.read_token_files(spark, pfor.encode_corpus(df, file_ids=size)).orderBy("start").collect()
        assert [r.doc_id for r in found] == [None, -5, 1, 3, 3, 2**60, 2**60 + 1]
        assert [r.start for r in found] == [0, 2, 3, 4, *[found[3].n_tokens + 4], 9, 12]
    assert pfor.read_token_files(spark, pfor.encode_corpus(df.limit(0))).count() == 0


def test_very_long_texts_and_repeated_ids(spark, docs):
    long = "some words of a long text, " * 40_000
    df = docs([(2, long), (1, long), (2, "x"), (2, long), (None, None)], "doc_id long, text string")
    rows = sorted(pfor.read_token_files(spark, pfor.encode_corpus(df, file_ids=1000)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 2] and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(5)]
    assert rows[0].n_tokens == 1 and max(r.n_tokens for r in rows) > 200_000


def test_many_rows_of_one_id(spark, docs):
    rows = [(None, f"null {i}") for i in range(400)] + [(7, f"seven {i}") for i in range(300)] + [(i, f"own {i}") for i in range(20)] + [(None, None), (7, None), (-3, "")]
    df = docs([(i, t, 0) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    folder = pfor.encode_corpus(df)
    found = pfor.read_token_files(spark, folder).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert len(found) == len(rows) and ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    ends = [r.start + r.n_tokens for r in found]
    assert [r.start for r in found] == [0, *ends[:-1]]
    sizes = [r.n for r in spark.read.parquet(f"{folder}/_files").groupBy("part").agg({"docs": "sum"}).toDF("part", "n").collect()]
    assert max(sizes) < 40  # neither the rows without id nor those of one id are one task's
