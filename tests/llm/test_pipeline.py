"""The pipeline on the smallest table, stage by stage, against brute force."""

import re
from collections import Counter

import corpus_pipeline
from quillspark.llm import pii
from quillspark.llm.common import read

from .fixtures import CLASHING, SCHEMA, documents
from .test_operators_small import base_by_pattern, exact_ids, hits, linked_components

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = read(spark, FOLDER, "documents")
    items = [(str(r["item_id"]), r["text"]) for r in read(spark, FOLDER, "benchmark").collect()]
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        before = rows
        out = step(spark, docs, FOLDER)
        if name == "packing":
            want = Counter()
            for d, ids in zip(before, exact_ids("word_bpe_49k.json", [r["text"] for r in before.values()], 1), strict=True):
                want[d] = len(ids)
            got = out.collect()
            assert Counter({d: sum(r["length"] for r in got if r["doc_id"] == d) for d in before}) == want
            return
        assert out.columns == columns, name
        docs = out.cache()
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(rows)
        if name == "language":
            assert set(rows) == {d for d, r in before.items() if re.search(r"[^\W\d_]", r["text"])}
        elif name == "near_duplicates":
            top = linked_components([(d, r["text"]) for d, r in before.items()], 5, 80)
            assert set(rows) == {d for d in before if top[d] == d}
        elif name == "decontamination":
            for d, r in before.items():
                n, hit, _ = hits(r["text"], items)
                assert (d in rows) == (2 * hit <= n)
                if d in rows:
                    assert (rows[d]["text"] == r["text"]) == (hit == 0)
        elif name == "personal_data":
            assert set(rows) == set(before)
            for d, r in before.items():
                found = base_by_pattern(r["text"])
                assert not any(r["text"][a:b] in rows[d]["text"] for kind, a, b in found if kind == "email")
                if not found and not pii.marked_words(r["text"]):
                    assert rows[d]["text"] == r["text"]


def test_run_covers_all_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_texts_like_no_language_go(spark):
    rows = [(i, "some words of one language and more", "en") for i in range(20)] + [(90, "漢字 仮名", None), (91, "12 ..", None), (92, "and more", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, FOLDER).collect()} == {*range(20), 92}


def test_stages_on_awkward_documents(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns; each stage alone."""
    docs = documents(spark).cache()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    top = linked_components(rows, 5, 80)
    want = {
        "language": [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")],
        "near_duplicates": [r for r in rows if r[0] is None or top[r[0]] == r[0]],
        "decontamination": rows,
        "personal_data": rows,
    }
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(want[name]), name
        assert all(r[c] == c for r in out.collect() for c in CLASHING), name
    got = Counter()
    for r in corpus_pipeline.packed(spark, docs, FOLDER).collect():
        got[r["doc_id"]] += r["length"]
    ids = Counter()
    for (d, _), x in zip(rows, exact_ids("word_bpe_49k.json", [t for _, t in rows], 1), strict=True):
        ids[d] += len(x)
    assert got == ids


def test_stages_on_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, FOLDER).count() == 0
