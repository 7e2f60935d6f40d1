"""Importance resampling against counters and zlib, with any split into head and tail."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute(rows, target, buckets=10_000):
    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    whole_s, whole_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out, able = [], []
    for doc_id, text in rows:
        n_words, found = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t))) for b in map(bucket, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if n_words >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(able[:len(able) * 25 // 100], 1):
        row[4] = place
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("words", "paired"), [(1 << 16, 512), (50, 3), (0, 0)])
def test_resample(docs, messy, benchmark, words, paired):
    got = Counter(map(tuple, resample.resample(docs, benchmark, words=words, paired=paired).collect()))
    assert got == brute(messy, [r.text for r in benchmark.collect()])
    assert sum(x[4] is not None for x in got) > 10


def test_nothing(docs, no_docs, messy, benchmark):
    assert resample.resample(no_docs, benchmark).count() == 0
    got = resample.resample(docs, benchmark.where("false"))
    assert Counter(map(tuple, got.collect())) == brute(messy, [])


def test_head_and_tail_agree():
    text = pa.array(["A b a B a", None, "", "…", "ünï x1 ünï x1", "solo", "a b"])
    want, offsets = resample.Slice(text, resample.Head()).buckets(10_000)
    assert [[zlib.crc32(f.encode()) % 10_000 for f in features(t)[1]] for t in text.to_pylist()] == [
        want[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
    word, state, _ = resample._count_words(text)
    head = resample.Head(word, state)
    pair, bucket, _ = resample._count_pairs(text, head, word, 10_000)
    for known in (head, resample.Head(word, state, pair, bucket), resample.Head(word[::2], state[::2], pair[1:2], bucket[1:2])):
        assert resample.Slice(text, known).buckets(10_000)[0].tolist() == want.tolist()


def test_counts_are_passed_on_when_a_task_holds_too_many(monkeypatch):
    monkeypatch.setattr(resample, "HELD", 8)
    batch = pa.RecordBatch.from_pydict({"text": ["a b c d e f g h i j k", "a b c", "a l m n o p q r s t u v"]})
    parts = list(resample._tally(iter([batch.slice(i, 1) for i in range(3)]), resample._count_words))
    assert len(parts) > 1
    n = Counter()
    for p in parts:
        n.update(dict(zip(p.column("value").to_pylist(), p.column("n").to_pylist(), strict=True)))
    assert n[zlib.crc32(b"a")] == 3 and n[zlib.crc32(b"b")] == 2 and sum(n.values()) == 26


def test_the_head_is_bounded(spark):
    rows = [(f"w{k % 40} w{k % 7} w{k}",) for k in range(400)]
    df = spark.createDataFrame(rows, "text string")
    for words in (0, 1, 7, 45, 10_000):
        head = resample.frequent(df, words, 5)
        assert len(head.word) <= words and len(head.pair) <= 25 and (np.diff(head.word.astype(object)) > 0).all()
    assert len(head.word) == 400 and len(resample.frequent(df, 45, 5).word) >= 7
