import zlib

import numpy as np
import public_tokenizers
import pytest
from genoframe.llm.packing import WordTokenizer, fill_rate, pack, sum_of_squares, token_pieces
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n", "Hello, world! it's 12 o'clock", "a <|endoftext|>b<|startoftext|> c", "ΑΣ\tİß é\x1cz\x85q  ́x",
    "word " * 9000, "x" * 3000, "plain text again", "plain text again",
]


def test_ids_equal_the_tokenizers(spark):
    plain, own = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    for t in TEXTS:
        assert own.encode(t) == np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_and_places(spark):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as length", "8 as offset", "9 as _g")
    out = pack(token_pieces(df, PATH), group_pieces=4).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(token_pieces(empty, PATH)).count() == 0


def slow_choice(lengths, capacity):
    gaps, out = [], []
    for s in lengths:
        def cost(g):
            after = [x for x in gaps]
            if g is None:
                after.append(capacity - s)
            else:
                after.remove(g)
                after.append(g - s)
            counts = {}
            for x in after:
                if x:
                    counts[x] = counts.get(x, 0) + 1
            return sum(v * v for v in counts.values())

        options = sorted({g for g in gaps if g >= s}) + [None]
        best = min(options, key=lambda g: (cost(g), options.index(g)))
        if best is None:
            gaps.append(capacity - s)
        else:
            gaps.remove(best)
            gaps.append(best - s)
        out.append(capacity - s if best is None else best - s)
    return out


def test_rule_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 21, 60)
        bins, offsets = sum_of_squares(lengths, 20)
        assert (20 - offsets - lengths).tolist() == slow_choice(lengths.tolist(), 20)
        for b in set(bins.tolist()):
            assert lengths[bins == b].sum() <= 20


def test_few_sequences(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 2500, 5000))], "doc_id long, length long")
    r = fill_rate(pack(df)).first()
    assert r.fill == pytest.approx(1, abs=0.01)
