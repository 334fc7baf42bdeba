"""The queries and the pipeline as they are registered, on the smallest tables: columns, types, rows, SQL."""

import itertools
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from quillspark.llm import queries as llm
from quillspark.sources.tables import TABLES

from ..compare import duck_rows, spark_rows
from .test_operators_small import exact_ids

FOLDER = "/root/testdata/sf0.001"
VIEWS = {t: f"{FOLDER}/{t}.parquet" for t in TABLES}
COLUMNS = {
    "op1_neardup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_tokenfile": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op11_prefixbpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op12_importance": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_infill": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
}


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(llm.ORACLE_SQL)))
def test_contract(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    ids = {r["doc_id"] for r in spark.read.parquet(VIEWS["documents"]).select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == ids and (name == "op6_packing" or len(rows) == len(ids))
    for n, held in ((3, 1), (5, 0)):
        if name == {3: "op4_toxicity", 5: "op7_language"}[n]:
            assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == held) for r in rows)


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_rows_of_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    assert spark_rows(df) == duck_rows(llm.ORACLE_SQL[name], VIEWS)


def documents_in_order(spark):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(VIEWS["documents"]).select("doc_id", "text").collect())


def crc_of(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def test_token_files_hold_the_ids_of_the_library(spark):
    docs = documents_in_order(spark)
    want, start = [], 0
    for (d, _), ids in zip(docs, exact_ids("byte_bpe_50k.json", [t for _, t in docs], 2), strict=True):
        want.append((d, start, len(ids), crc_of(ids)))
        start += len(ids)
    assert sorted(map(tuple, entry.queries()["op5_tokenfile"](spark, FOLDER).collect())) == want


def test_packed_sequences_hold_every_id_once(spark):
    docs = documents_in_order(spark)
    ids = dict(zip((d for d, _ in docs), exact_ids("word_bpe_49k.json", [t for _, t in docs], 1), strict=True))
    rows = entry.queries()["op6_packing"](spark, FOLDER).collect()
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == crc_of(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    gapless = lambda spans, end: sum(n for _, n in spans) == end and all(a + n == b for (a, n), (b, _) in itertools.pairwise([*sorted(spans), (end, 0)])) and min(spans)[0] == 0
    assert all(gapless(covered[d], len(x)) for d, x in ids.items())
    assert all(gapless(s, sum(n for _, n in s)) and sum(n for _, n in s) <= 2048 for s in sequences.values())
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 2048) * 1.02 + 1


def test_shards_are_near_equal_and_keep_equal_texts(spark):
    texts = dict(documents_in_order(spark))
    rows = entry.queries()["op8_sharding"](spark, FOLDER).collect()
    shards, at, size = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r["shard"] < 24
        shards[r["shard"]].append(r["slot"])
        at[raw].add(r["shard"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(s) == 1 for s in at.values())
    # the bound of longest-processing-time scheduling against the mean or the largest group
    groups = Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 8
    best = max(max(groups.values()), sum(groups.values()) / 24)
    assert max(size.values()) <= best * (4 / 3 - 1 / 72)
