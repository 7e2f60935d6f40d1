"""Language identification: the forward algorithm against listed segmentations, learning, and held-out accuracy."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import langid

PIECES = [b" ", b"a", b"b", b"c", b"ab", b" a", b" ab", b"bc", b"abc", "ü".encode(), b"\xc3", b"\xbc"]


def segmentations(unit):
    for cuts in itertools.product((0, 1), repeat=len(unit) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(unit)]
        parts = [unit[a:b] for a, b in zip(at, at[1:], strict=False)]
        if all(p in PIECES for p in parts):
            yield parts


@pytest.fixture(scope="module")
def small():
    p = np.random.default_rng(5).dirichlet(np.ones(len(PIECES)), 3).T
    pieces = langid.Pieces(PIECES)
    return pieces, p, langid.scaled(p, pieces.length)


UNITS = [" abc", " a", "abcabc", " üab", "c", " abab"]


def test_forward_sums_all_segmentations(small):
    pieces, p, now = small
    got = langid.log_likelihood(UNITS, pieces, now)
    for unit, row in zip(UNITS, got, strict=True):
        for k in range(3):
            whole = sum(math.prod(p[PIECES.index(x), k] for x in parts) for parts in segmentations(unit.encode()))
            assert row[k] == pytest.approx(math.log(whole))


def test_expected_counts(small):
    pieces, p, now = small
    language, times = np.array([0, 1, 2, 0, 1, 1]), np.array([3, 1, 4, 1, 5, 9])
    want = np.zeros_like(p)
    for unit, k, n in zip(UNITS, language, times, strict=True):
        ways = [(math.prod(p[PIECES.index(x), k] for x in parts), parts) for parts in segmentations(unit.encode())]
        for weight, parts in ways:
            for x in parts:
                want[PIECES.index(x), k] += n * weight / sum(w for w, _ in ways)
    assert np.allclose(langid.expected(UNITS, language, times, pieces, now), want)


def test_units():
    assert langid.units("Ab cD, x1y _z² Αβ") == [" ab", " cd", " x", " y", " z²", " αβ"]
    long = "q" * 1000
    assert "".join(langid.units(long + " a")).replace(" ", "") == long + "a" and max(map(len, langid.units(long))) <= 16
    assert langid.units("1 2 _") == []


def test_long_units_stay_in_range():
    pieces = langid.Pieces(langid.public_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    p = np.full((pieces.number, 1), 1e-7)
    p[1] = 1 - p[:-1].sum()
    got = langid.log_likelihood([" " + "\U0001d4d0" * 15, " " + "e" * 62, "\ud800"], pieces, langid.scaled(p, pieces.length))
    assert np.isfinite(got).all()


SPOKEN = {"xx": "kala mola tuki kala pemo", "yy": "strand grund schrift strand pfund", "zz": "óléá íbú óléá éfí"}


def test_identify(spark):
    rows = [(i, " ".join(SPOKEN[name].split()[i % 3:]) + f" {i}", name if i % 6 else None) for i in range(60) for name in SPOKEN]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "123 … _", None), (None, "Strand", "yy"), (903, "KALA", "zz"), (903, "KALA", "zz")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, score int, name int")
    whole = langid.identify(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(whole) == len(rows)
    own = {}
    for i, text, _ in rows:
        own.setdefault((i, text is not None and any(w in text.lower() for w in ("kala", "tuki"))), text)
    for r in whole:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = Counter((r.doc_id, r.lang_pred) for r in whole)
    assert all(by[i, name] == 1 for i in range(60) for name in SPOKEN)
    assert all(by[i, "und"] == 1 for i in (900, 901, 902)) and by[903, "xx"] == 2 and by[None, "yy"] == 1
    assert {r.score for r in whole if r.lang_pred == "und"} == {0.0}
    blocks = langid.identify(df, public_tokenizers.path("piece_bpe_32k.model"), block=2).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in blocks) == Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in whole)


def test_nothing_to_learn(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(df, path).collect()] == [(1, False, "und", 0.0)]
    assert langid.identify(df.where("false"), path).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model")).join(docs, "doc_id").where("held_out and lang_pred <> 'und'")
    rows = got.select("lang", "lang_pred").collect()
    assert len(rows) > 200 and sum(a == b for a, b in rows) / len(rows) > 0.97


def test_a_judge_that_forgets_says_the_same(small):
    pieces, p, now = small
    model = langid.Model(["x", "y", "z"], np.log([1, 2, 3]), now)
    texts = ["abc a\tab", "", "Ab, CAB 1", "1 2", "a" * 500, "b c b"]
    patient, forgetful = langid.Judge(pieces, model), langid.Judge(pieces, model, memory=0)
    want, letters = patient(texts)
    assert letters.tolist() == [True, False, True, False, True, True]
    for text, row, letter in zip(texts * 2, [*want] * 2, [*letters] * 2, strict=True):
        got, has = forgetful([text])
        assert np.allclose(got[0], row) and has[0] == letter
        assert np.allclose(row, model.prior + langid.log_likelihood(langid.units(text), pieces, now).sum(axis=0))


def test_short_prefixes_have_tables_of_their_own(monkeypatch):
    """One and two bytes are not looked up again; what is found is every piece at every place."""
    some = ["a", "ab", "b", "bc", "abc", "é", "aé", "abcab"]
    pieces = langid.Pieces(sorted(p.encode() for p in some))
    block = np.frombuffer("abcabcaébb€b".encode() * 2, np.uint8).reshape(2, -1)
    looked = []
    plain = langid.Pieces._look_up
    monkeypatch.setattr(langid.Pieces, "_look_up", lambda self, key: (looked.append(len(key)), plain(self, key))[1])
    found = {(b, e, int(u), int(k)) for b, e, units_, ks in pieces.edges(block) for u, k in zip(units_, ks, strict=True)}
    texts, names = [bytes(r) for r in block], sorted(p.encode() for p in some)
    assert found == {(b, b + len(p), u, k) for u, t in enumerate(texts) for k, p in enumerate(names) for b in range(len(t)) if t[b:b + len(p)] == p}
    assert sum(looked) < block.size
