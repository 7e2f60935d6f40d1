"""Operators on texts against brute force, with nulls, repeated rows, clashing columns and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import leaks, linear, mixing, near, pii, quality, records, repeats, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def multiset(rows):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows)


# -- near duplicates


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j, both = rows[b][0], len(sets[a] & sets[b])
            if both and i is not None and j is not None and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(rows, sets, strict=True)]


def test_near_duplicates(docs, messy):
    got = near.near_duplicates(docs, shingle=4, percent=80).collect()
    assert multiset(got) == multiset(brute_components(messy, 4, 80))


def test_near_duplicates_of_a_hub_whose_spokes_differ(spark):
    """Every spoke is close to the hub only: star edges from other centres must not lose it."""
    hub = [f"w{k}" for k in range(400)]
    rows = [(1000, " ".join(hub))]
    for s in range(40):
        spoke = list(hub)
        for k in range(9):
            spoke[s * 10 + k] = f"s{s}x{k}"
        rows.append((s, " ".join(spoke)))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 94).collect()
    assert multiset(got) == multiset(brute_components(rows, 4, 94))


def test_near_duplicates_of_one_hot_group(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(i, text) for i in range(500)] + [(500 + i, f"{text} tail{i}") for i in range(300)] + [(i, f"other {i} words in here {i * i}") for i in range(900, 950)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {r.component_id for r in got if r.doc_id < 800} == {0}
    assert sum(r.kept for r in got) == 51


@pytest.mark.parametrize("rare", [1, 4, 16])
def test_near_copies_that_differ_from_each_other_too(spark, monkeypatch, rare):
    """Copies of one text with up to eight edits of their own, or edits that a few share: most do not reach the threshold."""
    import random

    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        text = list(base)
        for k in rng.sample(range(150), i % 9):
            text[k] = f"own{i}x{k}" if rng.random() < 0.7 else f"shared{i % 40}x{k}"
        rows.append((i, " ".join(text)))
    emitted = []
    kept = near._remaining
    monkeypatch.setattr(near, "_remaining", lambda *a: emitted.append(kept(*a).count()) or kept(*a))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80, rare=rare).collect()
    assert multiset(got) == multiset(brute_components(rows, 4, 80))
    assert rare < 16 or emitted[0] < 4_000


def test_no_documents(no_docs, benchmark, labels):
    assert near.near_duplicates(no_docs).count() == 0
    assert leaks.decontaminate(no_docs, benchmark).count() == 0
    assert quality.score_quality(no_docs, labels).count() == 0
    assert mixing.mix(no_docs, labels).count() == 0
    assert repeats.remove_repeats(no_docs).count() == 0
    assert pii.find_personal_data(no_docs).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab \n\té,", max_size=30), min_size=1, max_size=8))
def test_words_and_shingles(texts):
    w = words.words_of(pa.array(texts), words.SPACED)
    split = [re.findall("[^\x20\x09-\x0d]+", t) for t in texts]
    assert np.diff(w.first).tolist() == [len(s) for s in split]
    flat = [x for s in split for x in s]
    assert len(set(w.hash.tolist())) == len(set(flat))
    sets = words.shingle_sets(pa.array(texts), 3)
    assert np.diff(sets.first).tolist() == [len({tuple(s[k:k + 3]) for k in range(max(1, len(s) - 2))}) if s else 0 for s in split]


# -- benchmark passages


def brute_leaks(rows, items, window=10):
    spell = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    index = defaultdict(set)
    for item, text in items:
        w = spell(text)
        size = min(window, len(w))
        if w:
            for k in range(len(w) - size + 1):
                index[tuple(w[k:k + size])] |= set() if item is None else {str(item)}
    out = []
    for i, text in rows:
        w, hit, found = spell(text), set(), set()
        for size in {len(k) for k in index}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in index:
                    hit.update(range(k, k + size))
                    found |= index[tuple(w[k:k + size])]
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return out


@pytest.mark.parametrize("scan_terms", [1_000_000, 7])
def test_decontaminate(docs, messy, benchmark, scan_terms):
    expected = brute_leaks(messy, [(r.item_id, r.text) for r in benchmark.collect()])
    got = leaks.decontaminate(docs, benchmark, scan_terms=scan_terms).drop("text_hash").collect()
    assert multiset(got) == multiset(expected)
    assert sum(r.contaminated for r in got) > 3


def test_phrases_without_id_and_phrases_that_repeat(spark):
    """An item without id hits words; a document may hold one phrase at very many places."""
    rows = [(1, "a nameless phrase of some words"), (2, "spam eggs " * 20_000), (3, "spam eggs"), (None, "spam eggs spam"), (4, "clean")]
    items = [(None, "nameless phrase of"), (None, "eggs spam"), (7, "eggs spam"), (8, "spam eggs " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = leaks.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).drop("text_hash").collect()
    assert multiset(got) == multiset(brute_leaks(rows, items))
    assert {(r.doc_id, r.n_hit, r.n_items) for r in got} >= {(1, 3, 0), (2, 40_000, 2)}


def test_proximity_passes_over_terms_that_no_document_has(spark):
    docs = spark.createDataFrame([(1, "red b c d fox"), (2, "red b"), (3, "fox c"), (4, "b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "red unseen fox"), (8, "unseen c"), (7, "never heard"), (None, "b c")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.proximity_matches(docs, items, slop=2).collect()} == {(1, "9"), (1, "8"), (3, "8"), (4, "8")}


def test_decontaminate_against_nothing(docs, messy, benchmark):
    got = leaks.decontaminate(docs, benchmark.filter("1 = 0")).collect()
    assert len(got) == len(messy) and not any(r.contaminated for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red b c d fox"), (2, "red x x b fox c d"), (3, "fox red")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "red b c d fox")], "item_id long, text string")
    assert {r.doc_id for r in leaks.proximity_matches(docs, items, slop=0).collect()} >= {1}
    assert {r.doc_id for r in leaks.proximity_matches(docs, items, slop=1).collect()} == {1, 2}  # b and c, the rarest terms


# -- quality and mixing


def test_quality_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got.predicted[got.quality == 1].mean() > 0.98


def test_quality_of_messy_rows(docs, messy, labels):
    got = quality.score_quality(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in messy)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.score for r in quality.score_quality(docs, labels.filter("1 = 0")).collect()} == {0.5}


def test_quality_never_sees_held_out_labels(docs, labels):
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(linear.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert multiset(quality.score_quality(docs, turned).collect()) == multiset(quality.score_quality(docs, labels).collect())


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet((0.2, 0.2, 0.2), 400)
    tokens = rng.integers(1, 500, 400)
    soft = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(tokens, p, strict=True)], "_tokens long, _posterior array<double>")
    goal = [0.6, 0.3, 0.1]
    steps = mixing.fit_rates(soft, goal, max_steps=400, tolerance=1e-6)
    rates = np.array([r[0] for r in soft.select(mixing.rate(steps)).collect()])
    mine = np.ones(400)  # the same projected steps, by hand
    capacity = (p * tokens[:, None]).sum(axis=0)
    for _ in steps:
        mine = np.maximum(0, mine - p @ (((mine * tokens) @ p - np.array(goal) * tokens.sum()) / capacity))
    assert np.allclose(rates, mine) and rates.min() >= 0
    assert np.allclose((rates * tokens) @ p, np.array(goal) * tokens.sum(), rtol=1e-3)


def test_rates_of_overlapping_memberships(spark):
    """Production settings: weak memberships take more passes than forty, out of reach targets end too."""
    rng = np.random.default_rng(9)
    p = rng.dirichlet((2.0, 1.0, 1.0), 300)
    tokens = rng.integers(1, 500, 300)
    soft = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(tokens, p, strict=True)],
                                 "_tokens long, _posterior array<double>").coalesce(1).cache()  # few rows, many passes
    shares = lambda steps: np.array([r * n for (r,), n in zip(soft.select(mixing.rate(steps)).collect(), tokens, strict=True)]) @ p / tokens.sum()
    steps = mixing.fit_rates(soft, [0.7, 0.15, 0.15])
    assert len(steps) > 40 and np.abs(shares(steps) - [0.7, 0.15, 0.15]).max() <= mixing.TOLERANCE
    far = mixing.fit_rates(soft, [0.0, 0.0, 1.0], progress=1e-2)
    start = np.abs(shares([]) - [0, 0, 1]).max()
    assert 0 < len(far) < 200 and mixing.TOLERANCE < np.abs(shares(far) - [0, 0, 1]).max() < start


def test_labels_that_repeat_are_one_example(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} words {i}", i % 2) for i in range(40)]
    plain = linear.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    often = spark.createDataFrame(rows + [rows[3]] * 3000, "doc_id long, text string, label int")
    assert np.array_equal(linear.fit(often), plain)
    assert np.array_equal(linear.fit(often, sample_rows=40), plain)
    assert not linear.fit(often.filter("1 = 0")).any()


def test_mixing_messy_rows(docs, messy, labels):
    got = mixing.mix(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in messy)
    for r in got:
        assert r.copies in (int(r.rate), int(r.rate) + 1) and abs(r.p_prime + r.p_rough + r.p_toxic - 1) < 1e-9
    again = mixing.resample(docs, labels, {"prime": 0.9, "toxic": 0.1})
    assert again.columns == docs.columns


# -- repeats


def brute_repeats(rows, length, first):
    place = defaultdict(list)
    data = [(t or "").encode() for _, t in rows]
    for n, b in enumerate(data):
        for k in range(len(b) - length + 1):
            place[b[k:k + length]].append((rows[n][0], k, n))
    gone = [bytearray(len(b)) for b in data]
    for found in place.values():
        if len(found) > 1:
            for _, k, n in sorted(found)[1:] if first else found:
                gone[n][k:k + length] = b"\1" * length
    out = []
    for (i, _), b, g in zip(rows, data, gone, strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        out.append((i, len(b), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest()))
    return out


def test_remove_repeats(docs, messy):
    got = repeats.remove_repeats(docs, length=50, gram=12).drop("kept").collect()
    assert multiset(got) == multiset(brute_repeats(messy, 50, False))
    assert sum(r.n_removed for r in got) > 5000


@pytest.mark.parametrize("crowd", [2000, 3])
@pytest.mark.parametrize("first", [False, True])
def test_remove_repeats_of_a_small_alphabet(spark, monkeypatch, first, crowd):
    import random

    rng = random.Random(3)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    base = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 90))) for _ in range(20)]
    rows = [(i, "".join(rng.choice(base)[rng.randint(0, 30):][:rng.randint(0, 60)] for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(500, "a" * 300), (501, "é" * 30)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, 12, keep_first=first).drop("kept").collect()
    assert multiset(got) == multiset(brute_repeats(rows, 20, first))


def test_long_texts_come_in_pieces(spark, monkeypatch):
    import random

    rng = random.Random(4)
    monkeypatch.setattr(repeats, "PIECE", 300)
    block = "".join(rng.choice("abcdefgh") for _ in range(400))
    text = "".join(rng.choice("abcdefgh") for _ in range(3000)) + block + "x" * 70 + block
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_hash": [5], "salt": [0], "text": [text]})
    seen = {}
    for part in repeats._anchors(iter([batch]), 50, 12):
        for g, b, s in zip(part.column("gram").to_pylist(), part.column("begin").to_pylist(), part.column("starts").to_pylist(), strict=True):
            for k in range(b, b + s):
                seen.setdefault(k, g)
    assert sorted(seen) == list(range(len(text) - 49))


def test_longest_factors_by_hand():
    data = np.frombuffer(b"abracadabra-abracadabra", np.uint8)
    place = np.arange(len(data) - 8)
    before, after, same = repeats.longest_factors(data, place, np.zeros(len(place), np.int64), 8)
    for i in place:
        lcp = [next((k for k in range(8) if data[i + k] != data[j + k]), 8) if i != j else 0 for j in place]
        assert before[i] == max([lcp[j] for j in place if j < i], default=0)
        assert after[i] == max([lcp[j] for j in place if j > i], default=0)
        assert [same[j] == same[i] for j in place if j != i] == [lcp[j] == 8 for j in place if j != i]


# -- personal data

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_base(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": name != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if fine:
                out.append((m.start(), m.end(), k))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a.b", "@", "x", ".com", "4111 1111 1111 1111", "+", "1", "25", "0", ".", " ", "-", "(555)", "é", "%"]), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute_base(text)


def test_personal_data(spark):
    rows = [(1, "mail a.b@c.org or a.b(at)c.org, call (555) 123-4567"), (2, None), (3, "x" * 200_000 + "@" + "1" * 100_000), (1, "ip 10.0.0.1 v 1.2.3.999")]
    rows += [(10 + i, f"call me: +1 (555) 555-{1000 + i} or phone (555) 555-{2000 + i} today") for i in range(60)]
    rows += [(100 + i, f"isbn {i} 123 456-7890{i % 7}") for i in range(30)]
    got = {}
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
        if r.doc_id == 3:  # the plain patterns would take hours over these runs
            assert r.spans == []
        elif r.doc_id != 1:
            assert [(s.start, s.end, pii.KINDS.index(s.kind)) for s in r.base] == brute_base(dict(rows)[r.doc_id] or "")
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert len(got[1]) == 2 and got[2][0].spans == []
    assert all(len(got[10 + i][0].spans) == 2 for i in range(60))  # the number without a country code is added
    assert all(got[100 + i][0].spans == got[100 + i][0].base for i in range(30))  # nothing is added after a cue against it


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 for p in (0.95, 0.9, 0.9, 0.5, 0.85)], axis=1)
    p = pii.reliabilities(np.zeros(4000, np.int64), votes, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.96


# -- records


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


@pytest.fixture(scope="module")
def encoder(tokenizer):
    return records.Encoder(tokenizer, cache=500)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", " ", " ", " ", "\n", "\t", "'", "’", "s", "ll", "re", "3", "²", ".", "!!", "&&&", "_",
                                 "<|endoftext|>", " ", "́", "中", "\x1c", "\x00", "’s", " 's"]), max_size=40))
def test_pieces_encode_as_whole_texts(encoder, plain, parts):
    text = "".join(parts)
    assert np.frombuffer(encoder.ids([text])[0], "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_checksums():
    crc = records.masked_crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0]
    assert crc == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_token_records(docs, messy, tokenizer, plain):
    got = records.token_records(docs, tokenizer).collect()
    ids = [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in messy]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in rows][:2] == [None, None]


def test_random_reads_and_damage(spark, docs, tokenizer, plain, messy, tmp_path):
    folder = str(tmp_path / "records")
    index = records.write_records(docs.filter("doc_id < 20").repartition(3), folder, tokenizer)
    index.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    got = {r.doc_id: r.ids for r in records.fetch(index.orderBy("length"), folder).collect()}
    assert got == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in messy if i is not None and i < 20}
    file = next((tmp_path / "records").iterdir())
    raw = bytearray(file.read_bytes())
    with pytest.raises(records.DamagedRecord):
        records.parse(bytes(raw[:-3]), last=True)
    raw[40] ^= 1
    with pytest.raises(records.DamagedRecord):
        records.parse(bytes(raw), last=True)


def test_no_records(no_docs, tokenizer):
    assert records.token_records(no_docs, tokenizer).count() == 0


def test_upper_case_address():
    """An obfuscated address is a candidate in a text without a lower-case marker."""
    text = "JOHN (AT) EXAMPLE (DOT) COM"
    assert [s[:4] for s in pii.spans(text)] == [(0, len(text), 0, False)]


def test_every_file_is_read_in_its_own_task(spark, docs, tokenizer, tmp_path):
    folder = str(tmp_path / "records")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    records.write_records(docs, folder, tokenizer).write.parquet(str(tmp_path / "index"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    index = spark.read.parquet(str(tmp_path / "index"))
    assert records.read_records(index.where("false"), folder).count() == 0
    back = records.read_records(index, folder)
    assert back.rdd.getNumPartitions() == index.select("file").distinct().count() > 1
    assert back.count() == docs.count()


def test_an_encoder_stays_with_its_worker(tokenizer):
    one = records.encoder(tokenizer, 2)
    assert records.encoder(tokenizer, 2) is one and records.encoder(tokenizer, 4) is not one


def test_labels_in_a_table_of_their_own(spark):
    """Labels looked up by hashes of the texts give the weights of the joined table, sampled or not."""
    rows = [(i, f"{'good' if i % 2 else 'bad'} words {i}") for i in range(400)] + [(7, "other text"), (8, "bad words 8"), (None, "x"), (401, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, 0), (6, 0), (6, 0), (None, 1), (999, 1), (401, 1)], "doc_id long, label int")
    joined = texts.join(marks, "doc_id")
    for bound in (24_000, 100):
        apart = linear.fit(texts, sample_rows=bound, shard_rows=60, marks=marks)
        assert apart.any() and np.array_equal(apart, linear.fit(joined, sample_rows=bound, shard_rows=60))
    assert not linear.fit(texts, marks=marks.filter("1 = 0")).any()


def test_late_passes_repeat_few_steps(spark, monkeypatch):
    """Rates are stored on the way, so no pass starts from the first step again; the steps stay the same."""
    rng = np.random.default_rng(9)
    p = rng.dirichlet((2.0, 1.0, 1.0), 100)
    soft = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(rng.integers(0, 500, 100), p, strict=True)],
                                 "_tokens long, _posterior array<double>").coalesce(1)
    repeated, rate = [], mixing.rate
    monkeypatch.setattr(mixing, "rate", lambda steps, **more: repeated.append(len(steps)) or rate(steps, **more))
    steps = mixing.fit_rates(soft, [0.7, 0.15, 0.15], max_steps=11, keep=4)
    assert len(steps) == 11 and max(repeated) == 4
    assert np.allclose(steps, mixing.fit_rates(soft, [0.7, 0.15, 0.15], max_steps=11, keep=100), rtol=1e-9)


def test_marks_are_remembered_apart(tokenizer, plain):
    """A word with marks after it is the word and the marks: it goes through the tokenizer once."""
    one = records.Encoder(tokenizer)
    texts = ["a thonder, thonder. (thonder) thonder!? thonder", None, "thonder, x", " thonder,  y"]
    assert [np.frombuffer(x, "<u2").tolist() for x in one.ids([t or "" for t in texts])] == [
        plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert one.ids(pa.array(texts)) == one.ids([t or "" for t in texts])
    assert {p for p in one.spaced if p.startswith("thonder")} == {"thonder"}


def test_long_spans_take_few_steps(monkeypatch):
    """Checksums join neighbours, then pairs: steps grow with the logarithm of a span, and are those of single bytes."""
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 63, 64, 65, 127, 128, 129, 0, 1000, 64 * 37 + 5, 200_000, 0])
    data = rng.integers(0, 256, int(size.sum()) + 7, dtype=np.uint8)
    start = np.cumsum(size) - size + 7
    steps, then = [], records._then
    monkeypatch.setattr(records, "_then", lambda op, c: steps.append(len(c)) or then(op, c))
    got = records.masked_crc32c(data, start, size)
    assert len(steps) < 50
    for s, n, value in zip(start.tolist(), size.tolist(), got.tolist(), strict=True):
        crc = 0xFFFFFFFF
        for b in data[s:s + n].tolist():
            crc = int(records._TABLE[(crc ^ b) & 255]) ^ (crc >> 8)
        crc ^= 0xFFFFFFFF
        assert value == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    assert len(records.masked_crc32c(data, start[:0], size[:0])) == 0


def test_pieces_are_spelled_once(tokenizer, plain, monkeypatch):
    """A slice makes each distinct piece a string once, known or new, and after the memory was emptied too."""
    texts = [f"a {' '.join(f'wo{k}rd' for k in range(n, n + 300))}" for n in (0, 100, 900)]
    spelled, strings = [], records._strings
    for cache in (1 << 20, 0):
        one = records.Encoder(tokenizer, cache=cache)
        for text in texts:
            spelled.clear()
            with monkeypatch.context() as m:
                m.setattr(records, "_strings", lambda x: spelled.extend(strings(x)) or strings(x))
                ids = one.ids([text])[0]
            assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
            assert len(spelled) <= 302
