import random
import zlib

import numpy as np
import pytest

from facetry.llm.packing import CAPACITY, Plan, encoder, op1_packing, pack, packing_plan, piece_bounds, sequences, to_pieces
from facetry.session import materialize
from tests.llm import fixtures


def check_plan(histogram, plan: Plan, capacity):
    length = np.concatenate([np.full(n, i) for i, n in histogram.items()]) if histogram else np.zeros(0, int)
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    seq, off = plan.place(length, rank)
    order = np.lexsort((off, seq))
    seq, off, length = seq[order], off[order], length[order]
    new = np.r_[True, seq[1:] != seq[:-1]]
    assert (off[new] == 0).all() and (off[~new] == (off + length)[:-1][~new[1:]]).all()
    assert (off + length).max() <= capacity and seq.max() == plan.bins - 1 and len(set(seq.tolist())) == plan.bins


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = 256
    histogram = {i: rng.randint(1, 400) for i in rng.sample(range(1, capacity + 1), 120)}
    plan = packing_plan(histogram, capacity)
    check_plan(histogram, plan, capacity)
    bound = max(-(-sum(i * n for i, n in histogram.items()) // capacity), sum(n for i, n in histogram.items() if 2 * i > capacity))
    best_fit = packing_plan(histogram, capacity, rounds=0).bins
    assert bound <= plan.bins <= best_fit and plan.bins <= bound * 1.05 + 1


def test_plan_finds_exact_thirds():
    histogram = {100: 300, 90: 300, 66: 300}
    plan = packing_plan(histogram, 256)
    check_plan(histogram, plan, 256)
    assert plan.bins <= 301


def test_piece_bounds():
    assert piece_bounds(1, 4) == [(0, 1)] and piece_bounds(4, 4) == [(0, 4)] and piece_bounds(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_ids_equal_the_json_tokenizer(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["", " ", "a b c\x85d", "日本語 🙂‍", "<|endoftext|>x", "x <|endoftext|>", "<|endoftext|>", "a<|endoftext|><|endoftext|> b\n<|endoftext|>\n", "<|endoftext|", "\t\n  \r\n x"]
    enc = encoder()
    for t in texts:
        assert enc.encode(t, allowed_special="all") == tok.encode(t, add_special_tokens=False).ids


def test_query_is_whole_and_gapless(spark, tmp_path):
    texts = [None, "", "short one", "short one", "one <|endoftext|> two", "word " * 7000, "é" * 3000, *[f"text number {i} " * (i % 50) for i in range(300)]]
    docs = fixtures.docs(spark, texts, ids=[None, 1, 2, 2, *range(3, len(texts) - 1)]).withColumnRenamed("n_chars", "piece")
    got = op1_packing(spark, fixtures.write(spark, tmp_path, documents=docs)).toPandas()
    enc, want = encoder(), []
    for r in docs.collect():
        ids = np.array([*enc.encode(r["text"] or "", allowed_special="all"), 0], dtype="<u4")
        want += [(-1 if r["doc_id"] is None else r["doc_id"], i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(piece_bounds(len(ids), CAPACITY))]
    assert sorted(map(tuple, got.fillna(-1)[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).values.tolist())) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= CAPACITY
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // CAPACITY) + 1
    assert op1_packing(spark, fixtures.write(spark, tmp_path / "e", documents=docs.limit(0))).count() == 0


def test_sequences_carry_ids_and_small_buckets_agree(spark):
    docs = fixtures.docs(spark, [f"text {i} " * (i % 40) for i in range(200)])
    pieces = materialize(to_pieces(docs, capacity=64, with_ids=True))
    packed = materialize(pack(pieces, capacity=64, bucket_rows=9))
    assert packed.count() == pieces.count()
    made = sequences(packed).collect()
    enc = encoder()
    for s in made:
        assert len(s["ids"]) <= 64 and s["ids"].count(0) >= 1
    total = sum(len(enc.encode(r["text"], allowed_special="all")) + 1 for r in docs.collect())
    assert sum(len(s["ids"]) for s in made) == total
