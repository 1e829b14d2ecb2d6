import json
import random

import pytest
from tokenizers import Tokenizer

from tablelens.llm import token_counts as tc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, _text string, n_tokens string"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(2)
    letters = "abcdefg  \n\t'’éß漢🙂09!?.,-<|>"
    noise = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    return noise + [
        None, "", " ", "\n\n\n", "x" * 5000, " " * 3000, "<|endoftext|>" * 40, "a <|endoftext|> b" * 60, "don't we'll I'VE " * 90,
        "word " * 900, ("longword" * 300 + " ") * 3, "ab cd　ef " * 100, "<|endo", "é" * 2000 + " end",
    ]


@pytest.mark.parametrize("chunk,overlap", [(50, 8), (400, 70), (32_768, 512)])
def test_counts_are_those_of_the_library(spark, plain, chunk, overlap):
    rows = [(i, t, "z", None) for i, t in enumerate(texts())] + [(None, "a b", None, None), (3, texts()[3], None, None)]
    got = tc.token_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, chunk=chunk, overlap=overlap).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(plain.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_other_files_use_their_own_library(spark):
    rows = [(1, "Hello there, WORLD", None, None), (2, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode("Hello there, WORLD", add_special_tokens=False)
    assert {r.doc_id: r.n_tokens for r in tc.token_counts(df, path).collect()} == {1: len(want.ids), 2: 0}
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in tc.token_counts(df, path).collect()} == {1: len(model.encode("Hello there, WORLD")), 2: 0}


def test_only_plain_rank_tables_are_encoded_as_such():
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert tc._is_rank_table(spec)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    assert not tc._is_rank_table(spec)


def test_empty(none):
    assert tc.token_counts(none, PATH).count() == 0
