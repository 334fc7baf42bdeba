"""Encoding by prefixes, and decoding, against the tokenizers library."""

import hashlib
import itertools
import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from quillspark.llm import prefixbpe
from quillspark.llm.tokens import vocabulary

from .fixtures import SCHEMA, documents, pairs

PATH = vocabulary(prefixbpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return prefixbpe.PrefixEncoder(PATH)


def same(own, library, texts):
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = [x.tolist() for x in own.encode(texts)]
    assert got == want
    assert own.decode(pa.array(got, pa.list_(pa.int32()))).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want]


@pytest.mark.parametrize("letters", ["ab", "aeinst", "abcdefghijklmnopqrstuvwxyz", "aBé's 1 .,!\n漢🙂Σσςİ́ ", "th \x00\x1c\t'sreve"])
def test_same_ids_as_the_library(own, library, letters):
    r = random.Random(letters)
    same(own, library, ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(600)])


def test_same_ids_for_joined_tokens(own, library):
    """Strings of tokens side by side: borders that merges might cross."""
    r, names = random.Random(8), [v.replace("</w>", "") for v in json.load(open(PATH))["model"]["vocab"]]
    same(own, library, ["".join(r.choice(names) for _ in range(r.randrange(1, 5))) for _ in range(4000)])


def test_special_tokens_in_a_text(own, library):
    same(own, library, ["a <|endoftext|>b<|startoftext|><|endoftext|>", "<|endoftext|>", "<|ENDOFTEXT|> x", "é<|endoftext|>́", "", " <|startoftext|>  "])
    plain, other = prefixbpe.PrefixEncoder(PATH, special=False), Tokenizer.from_file(PATH)
    other.encode_special_tokens = True
    assert plain.encode(["a<|endoftext|>b"])[0].tolist() == other.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_small_vocabularies_equal_merging_by_rank():
    """Every word of two letters and up to nine places, for vocabularies whose merges repeat letters and overlap."""
    letters = prefixbpe.byte_letters()
    base = {c: i for i, c in enumerate(letters)} | {f"{c}</w>": 256 + i for i, c in enumerate(letters)}
    r = random.Random(2)
    for _ in range(12):
        vocab, merges, pieces = dict(base), [], ["a", "b", "a</w>", "b</w>"]
        while len(merges) < 9:
            x, y = r.choice(pieces), r.choice(pieces)
            if not x.endswith("</w>") and x + y not in vocab:
                vocab[x + y] = len(vocab)
                merges.append((x, y))
                pieces.append(x + y)
        held, rank = prefixbpe.Prefixes(vocab, merges), {m: i for i, m in enumerate(merges)}
        for n in range(1, 10):
            for word in map("".join, itertools.product("ab", repeat=n)):
                parts = [*word[:-1], f"{word[-1]}</w>"]
                while True:
                    found = min(((rank.get(p, 99), i) for i, p in enumerate(itertools.pairwise(parts))), default=(99, 0))
                    if found[0] == 99:
                        break
                    parts[found[1] : found[1] + 2] = ["".join(parts[found[1] : found[1] + 2])]
                assert held.encode(word.encode()) == [vocab[p] for p in parts], (merges, word)


def test_a_little_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(prefixbpe, "PAIRS", 3)
    own, r = prefixbpe.PrefixEncoder(PATH, memory=4), random.Random(6)
    for _ in range(20):
        same(own, library, ["".join(r.choice("abcdeth ") for _ in range(60)) for _ in range(3)])


def test_documents(spark, library):
    docs = documents(spark).cache()
    rows = pairs(docs)
    coded = prefixbpe.encode(docs)
    want = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
    got = coded.collect()
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in got) == Counter((d, len(x), tuple(x)) for d, x in want)
    assert all(r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r["ids"])).hexdigest() for r in got)
    back = prefixbpe.decode(coded).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((d, library.decode(x, skip_special_tokens=False)) for d, x in want)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [99999, 320, -4, None])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in prefixbpe.decode(odd).collect()} == {1: "", 2: "", 3: library.decode([320])}


def test_very_long_word_and_text(spark, library):
    r = random.Random(1)
    rows = [(1, "".join(r.choice("abcdeinorst") for _ in range(200_000))), (2, "some words, " * 300_000)]
    for r in prefixbpe.encode(documents(spark, rows)).collect():
        assert r["ids"] == library.encode(dict(rows)[r["doc_id"]], add_special_tokens=False).ids


def test_empty_table(spark):
    assert prefixbpe.decode(prefixbpe.encode(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_equals_the_library(spark, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {tuple(r) for r in entry.queries()["op11_prefixbpe"](spark, "/root/testdata/sf0.001").collect()}
    want = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert got == want
