import hashlib
import random

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from loomspan.llm import tokens

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n  x", "a" * 700, "é" * 300 + "  　 b", "\x1c\x1d a\x85b", "don't we'll I'M", "日本語テキスト、 ok 🙂🙂", "x y ​ z", "²³¹¼ ½0٣٤ⅷ", " \t\r\n ", "<|endoftext|>", "ab " * 40000]


def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(RANKS), special_tokens={})


def test_equals_library_and_round_trip():
    bpe, lib = tokens.loaded(RANKS, P.PATTERN), encoding()
    rng = random.Random(1)
    alphabet = "aAeéß ñ\n\t.,'0²9$ł€語🙂  \x1f"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        coded = bpe.encoded([bpe.pieces(t, all(ord(c) < 256 for c in t))])[0]
        assert coded == ",".join(map(str, lib.encode_ordinary(t)))
        assert bpe.decoded(coded) == t.encode()


def test_long_pieces_by_heap_equal_matrix(monkeypatch):
    bpe = tokens.loaded(RANKS, P.PATTERN)
    rng = random.Random(2)
    some = ["".join(rng.choice("aeinrstéthou") for _ in range(rng.randrange(2, 200))).encode() for _ in range(300)]
    by_matrix = bpe.merge(some)
    monkeypatch.setattr(tokens, "WIDE", 1)
    assert bpe.merge(some) == by_matrix


def test_known_pieces_are_bounded_by_size(monkeypatch):
    bpe, lib = tokens.Bpe(tokens.read_ranks(RANKS), P.PATTERN), encoding()
    monkeypatch.setattr(tokens, "CACHE", 2000)
    rng = random.Random(9)
    for _ in range(30):
        t = " ".join("".join(rng.choice("abcdefgh") for _ in range(80)) for _ in range(10))
        assert bpe.encoded([bpe.pieces(t, True)]) == [",".join(map(str, lib.encode_ordinary(t)))]
        assert sum(len(k) + len(v) for k, v in bpe.known.items()) == bpe.held < 2000 + 4000


def test_whole_table(spark, sf):
    from loomspan.llm.queries import QUERIES

    lib = encoding()
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert {tuple(r) for r in QUERIES["op3_bpe_round_trip"](spark, sf).collect()} == want
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows}
    assert {tuple(r) for r in QUERIES["op8_token_counts"](spark, sf).collect()} == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (2, "")] + [(10 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = tokens.token_counts(df, P.path("piece_bpe_32k.model"), limit=2).collect()
    assert sorted(map(str, ((r[0], r[2], r[3]) for r in got))) == sorted(map(str, ((i, n := len(model.encode(t or "")), n > 2) for i, t in rows)))
    back = tokens.bpe_round_trip(df, RANKS, P.PATTERN).collect()
    lib = encoding()
    assert sorted((str(r[0]), r[1], bytes(r[2])) for r in back) == sorted((str(i), lib.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert tokens.bpe_digests(df.limit(0), RANKS, P.PATTERN).collect() == [] == tokens.token_counts(df.limit(0), P.path("piece_bpe_32k.model")).collect()


def test_safe_parts():
    text = ("word " * 9 + "x,  y\n") * 9000
    parts = tokens.safe_parts(text.encode(), 1000)
    assert len(parts) > 100 and b" ".join(parts) == text.encode()
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert sum(len(x) for x in model.encode([p.decode() for p in parts])) == len(model.encode(text))
    assert len(tokens.safe_parts(b"a" * 10**6, 1000)) == 1


@pytest.mark.parametrize("text", ["a b", "a  b", "a\tb c", " a b ", "1 2é 3"])
def test_safe_parts_small(text):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert sum(len(x) for x in model.encode([p.decode() for p in tokens.safe_parts(text.encode(), 0)])) == len(model.encode(text))
