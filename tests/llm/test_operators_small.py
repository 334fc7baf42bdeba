"""Each operator on awkward documents, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import codec, components, decontamination, fingerprint, language, neardup, packing, pii, sharding, substring, tokenfile, tokens, toxicity

from .fixtures import SCHEMA, documents, in_order, pairs, prose, texts

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1 near-duplicates


def shingle_set(text, k):
    w = split((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked_components(rows, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {d: top(d) for d in parent}


@pytest.mark.parametrize("k", [4, 5])
def test_neardup_equals_all_pairs(spark, docs, k):
    rows = pairs(docs)
    want = linked_components(rows, k, 80)
    got = neardup.link(docs, k, 80).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((d, len(shingle_set(t, k))) for d, t in rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("members", [512, 16])
def test_neardup_of_a_large_group_loses_no_link(spark, members, monkeypatch):
    """Copies of one text edited more and less: many fail against the pivot but are linked among themselves."""
    monkeypatch.setattr(neardup, "MEMBERS", members)
    r = random.Random(5)
    base = prose(r, 150).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice((1, 2, 4, 6, 9))):
            w[r.randrange(len(w))] = f"new{r.randrange(4)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(documents(spark, rows), 4, 80).collect()}
    assert got == linked_components(rows, 4, 80)


def test_deduplicate_keeps_one_of_each_component(spark, docs):
    rows, want = pairs(docs), linked_components(pairs(docs), 5, 80)
    left = neardup.deduplicate(docs)
    assert left.columns == docs.columns
    assert Counter(pairs(left)) == Counter(r for r in rows if r[0] is None or want[r[0]] == r[0])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 109)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2 personal data


def base_by_pattern(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("0123459..@@ab+- (\n)é") for _ in range(r.randrange(45)))
        assert pii.base_spans(t) == base_by_pattern(t), t


def test_long_runs_take_no_square_time():
    t = "1" * 100_000 + " " + "a." * 50_000 + "@" * 1000 + "0.1." * 20_000
    assert isinstance(pii.Finder(pii.Field()).find([t])[0][1], list)


def test_field_adds_what_patterns_miss():
    found = pii.Finder(pii.Field()).find(["call (771) 555-1655 now", "in 2004 12 13 14 15 of 3", "+1 (771) 555-1655 4785380592391139 x", None or ""])
    assert found[0] == ([], [("phone", 5, 19)])
    assert found[1] == ([], []) and found[3] == ([], [])
    assert ("card", 18, 34) in found[2][1] and ("phone", 0, 17) in found[2][1]


@pytest.mark.parametrize(("kind", "text", "sound"), [
    ("ip", "1.2.3", False), ("ip", "1.2.3.4", True), ("ip", "1.2.3.256", False), ("ip", "1.2.3.4.5", False), ("ip", "1..3.4", False), ("ip", "10.0.0.255", True),
    ("card", "4785380592391139", True), ("card", "4785380592391138", False), ("phone", "(212) 555-0143", True), ("phone", "555-0143", False), ("email", "a@b.c", True), ("email", "a@", False),
])
def test_what_the_field_adds_is_checked(kind, text, sound):
    assert pii.Finder._sound(kind, text) == sound


def test_find_and_redact(spark):
    rows = [(1, None), (2, ""), (3, "é mail a.b@c.de, 1.2.3.4 999.1.1.1"), (3, "é mail a.b@c.de, 1.2.3.4 999.1.1.1"), (None, "+1 (212) 555-0123!")]
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.find(documents(spark, rows)).collect()}
    assert pii.find(documents(spark, rows)).count() == 5
    assert got[1, sha("")]["spans"] == "" and got[3, sha("email:7:15,ip:17:24")]["n_ip"] == 1
    assert got[None, sha("phone:0:17")]["n_phone"] == 1
    left = pii.redact(documents(spark, rows))
    assert left.columns == documents(spark, rows).columns
    assert Counter(t for _, t in pairs(left)) == Counter([None, "", "é mail [EMAIL], [IP] 999.1.1.1", "é mail [EMAIL], [IP] 999.1.1.1", "[PHONE]!"])


def test_features_of_long_runs_are_of_the_whole_run():
    assert pii.shape("a-" * 100 + "12345") == "a-" * 100 + "d5" and pii.shape("é" * 300 + "@a") == "aaa@a"
    assert pii.features(["1" + "x" * 500, "23"])[1][3] == "n=3|luhn=False"
    assert pii.features(["x" * 500, "4785380592391139"])[1][3] == "n=16|luhn=True"


# 3 fingerprints


def test_fingerprints_of_edited_texts(spark, docs):
    rows = in_order([(d, t or "") for d, t in pairs(docs)])
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in fingerprint.fingerprints(docs).collect())
    want = Counter()
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        a, b = fingerprint.Printed(t).print, fingerprint.Printed(edited).print
        want[d, len(t), sha(edited), a.text(), b.text(), a.likeness(fingerprint.Printed(after).print)] += 1
    assert got == want


def test_edit_behind_a_word_of_one_byte():
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice((f"{r.choice('aAbI')} ", f"{prose(r, 2)} ", "\n", "\n ")) for _ in range(r.randrange(1, 30)))
        new, changed = fingerprint.Printed(text).edited(prose(r, 30))
        assert changed.text() == fingerprint.Printed(new).print.text()


def test_fingerprint_is_a_homomorphism():
    a, b = [b"one two", b"three", b"one two"], [b"four", b"three"]
    x, y, z = fingerprint.Fingerprint(), fingerprint.Fingerprint(), fingerprint.Fingerprint()
    x.add(a + b)
    y.add(b[::-1] + a[::-1])
    assert x.text() == y.text() == fingerprint.Fingerprint.parse(x.text()).text()
    x.add(b, -1)
    z.add(a)
    assert x.text() == z.text() and x.likeness(z) == 1.0
    assert fingerprint.Fingerprint().likeness(x) == 0.0


def test_likeness_follows_the_edit():
    r = random.Random(2)
    t, other = prose(r, 900), " ".join(f"w{i}" for i in range(900))
    a = fingerprint.Printed(t)
    assert a.edited(other)[1].likeness(a.print) > 0.4 and fingerprint.Printed(other).print.likeness(a.print) < 0.3


def test_likeness_is_near_the_exact_one():
    """The estimate against sums over pieces: shared by all, each piece weighed by the square of its count."""
    r = random.Random(4)
    errors = []
    for _ in range(150):
        words = prose(r, r.randrange(60, 600)).split(" ")
        for _ in range(r.randrange(len(words))):
            words[r.randrange(len(words) // r.choice((1, 2, 4)))] = f"new{r.randrange(10**6)}"
        a, b = (fingerprint.Printed(t) for t in (prose(random.Random(r.randrange(9)), 300) + " " + " ".join(words), " ".join(words)))
        x, y = (Counter(fingerprint.pieces(p.raw, p.at)) for p in (a, b))
        apart = sum((x[k] - y[k]) ** 2 for k in x | y)
        both = sum(n * n for n in x.values()) + sum(n * n for n in y.values())
        errors.append(abs(a.print.likeness(b.print) - max(0.0, (both - apart) / (both + apart))))
    assert sorted(errors)[75] < 0.08 and sorted(errors)[142] < 0.2


def test_no_mismatch_and_the_likeness_of_edits(spark):
    """All rows of a table: equal texts have equal fingerprints, and an edit that changes nothing has likeness 1."""
    rows = [(i, t) for i, t in enumerate([t for t in texts() if t] + ["same text here " * 20] * 3)]
    got = fingerprint.fingerprints(documents(spark, rows)).collect()
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert r["fingerprint"] == fingerprint.Printed(text).print.text() and 0 <= r["near_edited"] <= 1
        if r["edited_sha256"] == sha(text):
            assert r["near_edited"] == 1.0 and r["edited_fingerprint"] == r["fingerprint"]


def test_single_document_is_next_to_itself(spark, empty):
    r = fingerprint.fingerprints(documents(spark, [(5, "abcdefgh")])).collect()
    assert [(x["edited_sha256"], x["near_next"]) for x in r] == [(sha("abcdefab"), 1.0)]
    assert fingerprint.fingerprints(empty).count() == 0


# 4 toxicity


def toxic_corpus(spark):
    r = random.Random(4)
    bad = ["grobax", "fluzzen", "mordip"]
    rows, labels = [], []
    for i in range(600):
        w = prose(r, r.randrange(30, 90)).split(" ")
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(("", "ed", "ing"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    return documents(spark, rows), spark.createDataFrame([*labels, (0, 1), (5000, 1), (7, None)], "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = toxic_corpus(spark)
    mark = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    keep = [i for i in range(1002) if not mark(i)]
    model = toxicity.learn(docs.where(docs["doc_id"].isin(keep)), labels.where(labels["doc_id"].isin(keep)))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs.select("doc_id", "text", "label"), model).collect()}
    held = [i for i in truth if mark(i)]
    assert sum(got[i][1] == truth[i] for i in held) >= 0.97 * len(held)
    assert got[1000] == got[1001] and got[1000][1] == 0
    assert all(0 <= s <= 1 and p == (s >= 0.7) for s, p in got.values())


def test_toxicity_with_nothing_to_learn_from(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    """Without any label: three voters, and a copy of the third, which must not count twice."""
    r = np.random.RandomState(0)
    y = r.rand(4000) < 0.3
    rates = ((0.9, 0.1), (0.8, 0.2), (0.7, 0.3))
    votes = np.stack([(r.rand(4000) < np.where(y, a, b)) for a, b in rates], 1)
    votes = np.hstack([votes, votes[:, 2:]]).astype(float)
    m = toxicity.LabelModel(votes, np.where(votes[:, 0] > 0, 0.8, 0.2))
    assert abs(m.hit[0] - 0.9) < 0.07 and m.correlation[2, 3] > 0.9 and m.parent[3] == 2
    post = m.posterior(votes)
    assert ((post > 0.5) == y).mean() > 0.88
    like = np.log(0.3 / 0.7) + sum(np.where(votes[:, j] > 0, np.log(a / b), np.log((1 - a) / (1 - b))) for j, (a, b) in enumerate(rates))
    assert np.abs(post - 1 / (1 + np.exp(-like))).mean() < 0.06


def test_label_model_equals_enumeration():
    """One round on a few rows against sums over both labels of each row, written out."""
    votes = np.array([[1, 1, 0], [1, 1, 1], [0, 0, 0], [0, 0, 1], [0, 1, 0], [0, 0, 0]], float)
    first = np.array([0.9, 0.9, 0.1, 0.3, 0.4, 0.1])
    m = toxicity.LabelModel(votes, first, rounds=1)
    for i, row in enumerate(votes):
        joint = []
        for side, p in enumerate((first, 1 - first)):
            total = m.prior if side == 0 else 1 - m.prior
            for j, v in enumerate(row):
                own = (sum(p[k] * votes[k, j] for k in range(6)) + 0.1) / (p.sum() + 0.2)
                k = m.parent[j]
                same = [q for q in range(6) if k < 0 or votes[q, k] == row[k]]
                rate = (sum(p[q] * votes[q, j] for q in same) + own) / (sum(p[q] for q in same) + 1)
                total *= rate if v else 1 - rate
            joint.append(total)
        assert abs(m.posterior(votes)[i] - joint[0] / sum(joint)) < 1e-9


def test_terms_beyond_the_voters_count(spark):
    r = random.Random(9)
    marks = [f"{a}{b}{c}x" for a in "bcdfg" for b in "aeiou" for c in "hjklmnp"]
    rows = [(i, prose(r, 30) + " " + " ".join(marks[(6 * i + k) % len(marks)] for k in range(6)), 1) for i in range(300)]
    rows += [(300 + i, prose(r, 36), 0) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(model.voters.lexicon) == toxicity.VOTERS < len(marks)
    clean = model.score(prose(r, 36))
    assert all(model.score(f"{prose(r, 30)} {m} {n}") > max(0.7, clean) for m, n in zip(marks, marks[1:], strict=False))


# 5 token files, 6 packing


def exact_ids(name, texts_, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(name))
    t.encode_special_tokens = True
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts_]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_those_of_whole_texts(name, spaces, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 60)
    r = random.Random(9)
    odd = ["", None, " ", "\n", "a\x00 b", "x\n\ny  z\n w", "\u2028 a\u3000 b", "a.b it's.x don't!", "x×. y÷! ŉ.", "\nİ! ß", "a\n", "İstanbul. ſtop ĳ", "a  b", " a", "a ", "it's I'LL\n\n we've", "é́ Á ́x ΑΣ Σ", "<|endoftext|> a", "a\r\n b", "　a b　 c", "x.\ny", "x\n", "***a!!b?? 12 3.4 $5"]
    odd += ["".join(r.choice("ab.'é \n1Σ\t-") for _ in range(30)) for _ in range(300)] + [t for t in texts() if t]
    enc = tokens.Encoder(tokens.vocabulary(name), spaces)
    for i in range(0, len(odd), 40):
        assert [x.tobytes() for x in (a[:-1] for a in exact_ids(name, odd[i : i + 40], 0))] == [x.tobytes() for x in enc.encode(odd[i : i + 40])]
    assert len(enc.young.row) <= 400 and enc.encode([]) == [] and tokens.encoder(tokens.vocabulary(name), spaces) is tokens.encoder(tokens.vocabulary(name), spaces)


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 9000])
def test_codec_round_trip(n):
    r = np.random.RandomState(n)
    for ids in (r.randint(0, 50257, n), r.randint(0, 2, n), np.minimum(r.geometric(0.01, n), 60000), np.zeros(n, int), np.tile([5, 9, 70000], n)[:n]):
        data = codec.encode(ids.astype("<u4"), [None, 7], [n // 2, n - n // 2])
        got, doc_ids, lengths = codec.decode(data)
        assert (got == ids).all() and doc_ids == [None, 7] and lengths.tolist() == [n // 2, n - n // 2]
        for at in (9, 40 if n else 9):
            bad = bytearray(data)
            bad[at] ^= 1
            with pytest.raises((ValueError, zlib.error)):
                codec.decode(bytes(bad))


def test_a_damaged_block_leaves_the_others_readable():
    r = np.random.RandomState(1)
    for ids in (np.minimum(r.geometric(0.01, 9000), 40000), r.randint(0, 250_000, 90_000)):
        data = codec.encode(ids.astype("<u4"), [1], [len(ids)])
        whole = codec.Segment(data)
        n = whole.blocks
        for i in (0, 2, n - 1):
            body = whole.bodies[i]
            at = data.index(body)
            for spoiled in (bytes([body[0] ^ 255]) + body[1:], bytes(len(body)), b"\xff" * len(body)):
                got = codec.Segment(data[:at] + spoiled + data[at + len(body) :]).read(list(range(n)))
                assert got[i] is None and all((got[k] == ids[k * codec.BLOCK : (k + 1) * codec.BLOCK]).all() for k in range(n) if k != i)
        assert all((whole.read([i])[0] == ids[i * codec.BLOCK : (i + 1) * codec.BLOCK]).all() for i in (0, 1, n - 1))


@pytest.mark.parametrize("high", [200_000, 2**32 - 1])
def test_any_number_of_different_ids_is_coded(high):
    ids = np.concatenate((np.unique(np.linspace(0, high, 200_000).astype(np.int64)), np.arange(3000) % 7)).astype("<u4")
    assert (codec.decode(codec.encode(ids, [1], [len(ids)]))[0] == ids).all()


def test_mixing_beats_the_frequencies_alone():
    r = np.random.RandomState(3)
    words = [np.minimum(r.geometric(0.003, 4), 30000) for _ in range(400)]
    ids = np.concatenate([words[min(399, i)] for i in r.geometric(0.02, 5000)]).astype("<u4")
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(codec.encode(ids, [1], [len(ids)])) * 8 < 0.85 * -(p * np.log2(p)).sum() * len(ids)


def test_frequencies_fill_their_total():
    for counts in ([1], [1] * 1000, [10**9, 1, 1], list(range(1, codec.KINDS))):
        f = codec.frequencies(np.array(counts))
        assert f.sum() == 1 << codec.FREQ and f.min() >= 1


def test_files_stay_the_same():
    """Bytes of the format, as the first version of these blocks wrote them; the last block is shorter."""
    r = np.random.RandomState(7)
    ids = np.minimum(r.geometric(0.01, 5 * codec.BLOCK + 77), 5000).astype("<u4")
    data = codec.encode(ids, [3, None], [2000, len(ids) - 2000])
    assert hashlib.md5(data).hexdigest() == "40bd9859f4a22d17476d68fae41388fb"
    assert (codec.decode(data)[0] == ids).all()


@pytest.mark.parametrize("kinds", [1, 2, 5, 400])
def test_guesses_of_whole_blocks_are_those_of_each_step(kinds):
    """A block's guesses, found without a step for each id, against a dictionary; symbols, slots and confidences run together."""
    r = np.random.RandomState(kinds)
    s = np.minimum(r.geometric(2 / (kinds + 1), (5, 700)) - 1, kinds).astype(np.int32)
    s[1, 100:400] = 0
    slot = r.randint(0, 9, s.shape).astype(np.uint32)
    got = codec._guesses(s << np.int32(3), slot)
    for row in range(len(s)):
        held = {}
        for t, (symbol, at) in enumerate(zip(s[row].tolist(), slot[row].tolist(), strict=True)):
            guess, sure = held.get(at, (0, 0))
            assert divmod(int(got[row, t]), 8) == (guess, sure)
            if guess == symbol:
                held[at] = guess, min(7, sure + 1)
            else:
                held[at] = (guess, sure - (sure + 1) // 2) if sure > 1 else (symbol, 1)


def test_pieces_share_the_bytes_of_their_texts():
    """Texts are cut where a regular expression cuts them, without a copy."""
    r = random.Random(4)
    some = ["a" + "".join(r.choice("abÉé×÷ß中😀 \n.,'!-_9Ā") for _ in range(r.randrange(30))) for _ in range(500)]
    whole = pa.array(some).slice(13)
    pieces, offsets = tokens.cut_texts(whole)
    want = [[x for x in re.split("\0", re.sub(tokens._MARK, "\\1\0\\2", re.sub("([ \n])", "\0\\1", t)))] for t in some[13:]]
    assert pieces.to_pylist() == [x for t in want for x in t] and np.diff(offsets).tolist() == [len(t) for t in want]
    assert pieces.buffers()[2].address == whole.buffers()[2].address


def test_token_file_in_order(spark, docs, empty, monkeypatch):
    rows = in_order(pairs(docs))
    at, want = 0, []
    for (d, _), ids in zip(rows, exact_ids("byte_bpe_50k.json", [t for _, t in rows], 2), strict=True):
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    monkeypatch.setattr(tokenfile, "SEGMENT", 4096)
    files = tokenfile.write(docs)
    assert Counter(map(tuple, tokenfile.read_back(files).collect())) == Counter(want)
    assert tokenfile.read_back(tokenfile.write(empty)).count() == 0
    some = sorted(files.collect(), key=lambda r: (r["part"], r["place"]))
    assert sum(r["n_ids"] for r in some) == at and all(r["path"].endswith(".qti") for r in some)
    data = bytearray(tokenfile._get(some[0]["path"]))
    own = codec.Segment(bytes(data))
    data[-1] ^= 255
    folder, _, name = some[0]["path"].rpartition("/")
    spoiled = tokenfile._put(folder, f"spoiled-{name}", bytes(data))
    if own.blocks > 1:
        assert (tokenfile.read_block(spoiled, 0) == tokenfile.read_block(some[0]["path"], 0)).all()
    with pytest.raises(ValueError):
        tokenfile.read_block(spoiled, own.blocks - 1)


def test_fill_is_the_closest_sum():
    r = random.Random(8)
    for _ in range(200):
        stock = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(r.randrange(1, 6))}
        room = r.randrange(40)
        used = packing.fill(stock, room)
        best = max(s for s in (sum(n * k for n, k in zip(c, stock, strict=True)) for c in itertools.product(*(range(v + 1) for v in stock.values()))) if s <= room)
        assert sum(k * n for k, n in used.items()) == best and all(n <= stock[k] for k, n in used.items())


def test_packing_lays_each_id_once(spark, docs, empty):
    length = 64
    got = packing.pack(docs, length).collect()
    want = Counter()
    for (d, _), ids in zip(pairs(docs), exact_ids("word_bpe_49k.json", [t for _, t in pairs(docs)], 1), strict=True):
        for i in range(0, len(ids), length):
            want[d, i, min(length, len(ids) - i), zlib.crc32(ids[i : i + length].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= length
    assert len(sequences) <= -(-sum(k[2] * n for k, n in want.items()) // length) + 3
    assert packing.pack(empty).count() == 0


# 7 language


def test_language_of_held_out_texts(spark, empty):
    r = random.Random(6)
    kinds = {"aa": "the tha and ing ion ent", "bb": "der die sch ung ein ich", "cc": "que les oux eau ent ais"}
    rows = []
    for i in range(240):
        lang = r.choice(list(kinds))
        rows.append((i, " ".join("".join(r.choice(kinds[lang].split()) for _ in range(r.randrange(1, 4))) for _ in range(40)).title(), lang))
    df = spark.createDataFrame([(*x, "s", "x", "y", None, "z", "q") for x in rows] + [(900, None, "aa", *"sxyzzq"), (901, "12 ..", "bb", *"sxyzzq"), (902, "", None, *"sxyzzq"), (903, "the tha", None, *"sxyzzq")], SCHEMA)
    profiles = language.learn(df.where("doc_id % 5 <> 0 or doc_id >= 900"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, profiles).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows) and all(0 <= s <= 1 for _, s in got.values())
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    left = language.identify(df, profiles, keep=0.0)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, _, _ in rows} | {903}
    nothing = language.learn(empty)
    assert language.identify(empty, nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df, nothing, keep=0.0).count() == len(rows) + 1


def test_languages_of_minor_scripts_are_told_apart(spark):
    r = random.Random(7)
    latin = [chr(c) for c in (*range(0x61, 0x7B), *range(0xE0, 0xF7), *range(0x101, 0x130, 2))]
    kinds = {
        "la": ["".join(r.choice(latin) for _ in range(3)) for _ in range(300)], "ru": "что про ние ста ого при".split(),
        "bg": "ъта ият щях със ват ките".split(), "el": "και του την στο ους εις".split(),
    }
    langs = ["la"] * 9 + ["ru", "bg", "el"]
    rows = [(i, " ".join("".join(r.choice(kinds[langs[i % 12]]) for _ in range(r.randrange(1, 4))) for _ in range(40)), langs[i % 12]) for i in range(480)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn(df.where("doc_id < 360"))
    got = {x["doc_id"]: x["lang_pred"] for x in language.identify(df, profiles).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    g = language.Grams([ord("a")])
    assert g.count("жа").tolist() != g.count("ца").tolist() and g.count("ЖА").tolist() == g.count("жа").tolist()


def test_counts_handed_on_early_give_equal_profiles(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"one two {chr(0x4E00 + i)}{chr(0x4E01 + i)} three", "ab"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    a = language.learn(df)
    monkeypatch.setattr(language, "GRAMS", 50)
    b = language.learn(df)
    assert (a.grams == b.grams).all() and (a.rank == b.rank).all() and a.langs == b.langs == ["a", "b"]


def test_long_texts_are_counted_whole(monkeypatch):
    g = language.Grams([ord(c) for c in "abcdefg"])
    t = "abc def, gab\n ca " * 40
    whole = g.count(t)
    monkeypatch.setattr(language, "PIECE", 7)
    assert (g.count(t) == whole).all() and whole.sum() > 0 and g.count(" 12 ") is None


def test_least_distance_equals_brute_force():
    """The judge's language against sums of |rank - rank|, written out over dictionaries."""
    r = random.Random(3)
    kinds = {"aa": "the tha and ing ion ent", "bb": "der die sch ung ein ich", "cc": "что про ние ста ого при"}
    made = lambda k, n: " ".join("".join(r.choice(kinds[k].split()) for _ in range(r.randrange(1, 4))) for _ in range(n))

    def profile(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        joined = f" {' '.join(letters.split())} "
        grams = Counter(joined[i : i + n] for n in (1, 2, 3) for i in range(len(joined) - n + 1))
        return {g: n for g, n in grams.items() if g.strip()}

    texts_ = {k: made(k, 400) for k in kinds}
    grams = language.Grams([])
    profiles = language.Profiles([], list(kinds), [grams.count(texts_[k]) for k in kinds])
    ordered = lambda counts: sorted(counts.values(), reverse=True)
    for k in kinds:
        assert sorted(grams.count(texts_[k])[1].tolist(), reverse=True)[:50] == ordered(profile(texts_[k]))[:50]
    for _ in range(30):
        text = made(r.choice(list(kinds)), 30)
        own = grams.count(text)
        best = own[0, language.ranks(own[1])].tolist()
        away = {}
        for i, k in enumerate(kinds):
            count = grams.count(texts_[k])
            place = {g: n for n, g in enumerate(count[0, language.ranks(count[1])].tolist())}
            away[k] = sum(abs(place[g] - n) if g in place else language.TOP for n, g in enumerate(best))
        assert profiles.judge(grams, text)[0] == min(away, key=away.get)


def test_out_of_place_distance():
    count = np.zeros(language.GRAMS, int)
    count[[5, 9, 7]] = (3, 8, 3)
    assert language.ranks(count).tolist() == [9, 5, 7] and language.ranks(count, 2).tolist() == [9, 5]


# 8 sharding


def test_shards(spark, docs, empty):
    rows = pairs(docs)
    got = sharding.shard(docs, 5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    shards = defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shards[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    assert sharding.shard(empty, 5).count() == 0


def by_heap(sizes, k):
    """Loads by longest processing time, one group at a time."""
    load = [0] * k
    for size in sorted(sizes, reverse=True):
        load[load.index(min(load))] += size
    return load


def test_place_is_longest_processing_time():
    r = random.Random(7)
    for _ in range(200):
        classes = sorted({r.randrange(1, r.choice((30, 5_000, 10**9))): r.choice((1, 2, r.randrange(1, 400))) for _ in range(r.randrange(1, 20))}.items(), reverse=True)
        k = r.randrange(1, 9)
        load, at, counts = [0] * k, 0, Counter()
        for x in sharding.place(classes, k).to_pylist():
            assert x["__end"] > at
            load[x["shard"]] += (x["__end"] - at) * x["__size"]
            counts[x["__size"]] += x["__end"] - at
            at = x["__end"]
        assert counts == dict(classes) and load == by_heap([s for s, n in classes for _ in range(n)], k)


def test_shards_of_large_and_small_groups_are_those_of_the_heap(spark):
    r = random.Random(2)
    rows = [(i, f"{i} " + "x" * r.choice((3, 40, 9_000 + r.randrange(30_000), 70_000))) for i in range(300)] + [(1000 + i, "copy " * 2000) for i in range(40)]
    load = Counter()
    for x in sharding.shard(documents(spark, rows), 7).collect():
        load[x["shard"]] += x["size"]
    sizes = Counter()
    for _, t in rows:
        sizes[t] += len(t) + 8
    assert sorted(load.values()) == sorted(by_heap(sizes.values(), 7))


# 9 substrings


def removed(rows, window):
    seen, out = {}, []
    for d, t in sorted(((d if d is not None else -1, t) for d, t in set(rows)), key=lambda r: r[0]):
        w = split(t)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                keep[i : i + window] = [False] * window
            else:
                seen[g] = d
        out.append((d, len(w), keep.count(False), sha(" ".join(x for x, k in zip(w, keep, strict=True) if k))))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_repeated_windows_go(spark, docs, batches):
    rows = pairs(docs)
    got = Counter((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs, n_batches=batches).collect())
    assert set(got) == set(removed(rows, 20)) and sum(got.values()) == len(rows)


def test_repeats_in_random_texts(spark, empty):
    r = random.Random(11)
    parts = [" ".join(r.choice("ab") for _ in range(r.randrange(3, 40))) for _ in range(12)]
    rows = [(i, " ".join(r.choice(parts) for _ in range(4))) for i in range(40)]
    got = {tuple(x) for x in substring.remove_repeats(documents(spark, rows)).collect()}
    assert got == set(removed(rows, 20))
    assert substring.remove_repeats(empty).count() == 0


@pytest.mark.parametrize(("runs", "tiers"), [(2, [[0], [1], [1, 0], [2]]), (3, [[0], [0, 0], [1], [1, 0]])])
def test_index_compacts_runs_of_one_tier(spark, monkeypatch, runs, tiers):
    """A batch rewrites runs of its own tier alone; those of higher tiers stay the tables they were."""
    monkeypatch.setattr(substring, "RUNS", runs)
    index, before = substring.Index(spark, buckets=3), []
    for i, keys in enumerate(([1, 2], [2, 3], [3, 4], [2, 7])):
        index.run(spark.createDataFrame([(k, i) for k in keys], "key long, row long"))
        assert index.tiers == tiers[i] and len(index.runs) == len(index.tiers)
        kept = len(index.runs) - 1
        assert index.runs[:kept] == before[:kept]
        before = list(index.runs)
    met = index.met(spark.createDataFrame([(2,), (4,), (9,)], "key long"))
    assert sorted(map(tuple, met.collect())) == [(2, 0), (2, 1), (2, 3), (4, 2)]
    index.close()


def test_batches_one_by_one_equal_one_run(spark, monkeypatch):
    """A kept index is brought batch after batch; runs are compacted on the way; what it holds are first windows alone."""
    monkeypatch.setattr(substring, "RUNS", 3)
    r = random.Random(13)
    parts = [" ".join(r.choice("abc") for _ in range(r.randrange(5, 60))) for _ in range(10)]
    rows = [(i, " ".join(r.choice(parts) for _ in range(3))) for i in range(24)]
    rows += [(30 + i, rows[i][1]) for i in range(0, 8, 3)] + [(50, " ".join(w for _, t in rows[:3] for w in t.split()))]
    index, got, earlier = substring.Index(spark), set(), None
    for low, high in ((0, 9), (9, 17), (17, 32), (32, 60)):
        batch = documents(spark, [x for x in rows if low <= x[0] < high]).select("doc_id", "text")
        got |= {tuple(x) for x in index.add(batch, earlier).collect()}
        earlier = batch if earlier is None else earlier.unionAll(batch)
    assert got == set(removed(rows, 20)) and len(index.runs) == 2
    index.close()


# 10 decontamination


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))


def hits(text, items, window=10):
    w, hit, names = item_words(text), set(), set()
    for name, t in items:
        i = item_words(t)
        n = min(len(i), window)
        for g in {tuple(i[j : j + n]) for j in range(len(i) - n + 1)} if n else ():
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) == g:
                    hit |= set(range(j, j + n))
                    names |= {name} - {None}
    return len(w), len(hit), sorted(names)


def test_hits_equal_brute_force(spark, docs, empty, monkeypatch):
    found = [t for t in texts() if t]
    items = [("1", found[10][:300]), ("2", "KA-LORI, tela"), ("10", found[8]), ("3", None), ("4", ""), ("5", " ".join(found[11].split(" ")[100:115])), (None, found[9][:200]), ("2", found[11][:150]), ("7", "a b c d")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for limit in (1 << 20, 300):  # in one pass and in several
        monkeypatch.setattr(decontamination, "PASS_BYTES", limit)
        got = Counter((r["doc_id"], r["scanned"]["n_words"], sum(s["end"] - s["start"] for s in r["scanned"]["spans"]), tuple(r["scanned"]["items"])) for r in decontamination.scan(docs, bench).collect())
        want = Counter((d, n, k, tuple(names)) for d, t in pairs(docs) for n, k, names in [hits(t, items)])
        assert got == want
    assert decontamination.scan(empty, bench).count() == 0
    assert Counter(r["scanned"]["n_words"] for r in decontamination.scan(docs, bench.limit(0)).collect()) == Counter(len(item_words(t)) for _, t in pairs(docs))


def test_automaton_on_small_alphabets():
    r = random.Random(12)
    for _ in range(300):
        items = [(str(i), " ".join(r.choice("ab") for _ in range(r.randrange(0, 9)))) for i in range(3)]
        text = " ".join(r.choice("abc") for _ in range(30))
        n, spans, names = decontamination.Automaton([([i], t.encode()) for i, t in items], 4).scan(text.encode())
        assert (n, sum(b - a for a, b in spans), sorted(names)) == hits(text, items, 4), (items, text)


def test_spans_go_and_clean_documents_stay(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, "é start, " + item.upper() + "! and a longer end that is kept for a while with more words than hit"), (2, item), (3, "clean text"), (4, None)]
    docs = documents(spark, rows)
    left = decontamination.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted(pairs(left)) == [(1, "é start, ! and a longer end that is kept for a while with more words than hit"), (3, "clean text"), (4, None)]


def test_likeness_of_pieces_that_repeat_very_often():
    """Lanes go beyond 16 bits and don't come round; such fingerprints are written and read as well."""
    line = b"the same line"
    held = []
    for n in (65_536, 64_000, 40_000, 65_536):
        f = fingerprint.Fingerprint()
        f.add([line] * n)
        held.append(fingerprint.Fingerprint.parse(f.text()))
    a, b, c, same = held
    assert 0.99 < a.likeness(b) < 1
    assert a.likeness(c) < a.likeness(b) and a.likeness(same) == 1.0 and a.text() == same.text()
    a.add([line] * 1536, -1)
    assert a.text() == b.text()
