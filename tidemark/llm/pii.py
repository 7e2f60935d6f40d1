"""Personal data in texts: exact patterns, and labelers whose votes train a span classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored
from tidemark.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "shape", "gazetteer", "context", "surroundings")
THRESHOLD, ROUNDS = 0.9, 200
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Wider nets: what the patterns above miss and a labeler may still vouch for.
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}"
                         r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z]{2,24}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z.-]*[0-9])")),
)
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co dev app ai eu de fr es it nl be at ch uk ie pt pl se no dk fi cz us ca mx br ar au nz jp cn in ru".split())
CUES = {
    "email": frozenset("email mail mailto contact write reach kontakt correo courriel address an schreiben".split()),
    "ip": frozenset("ip ipv6 address host server client login logged from adresse dirección".split()),
    "card": frozenset("card visa mastercard amex credit debit pay paid payment karte kreditkarte carte tarjeta cc".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp contact dial telefon rufen anruf téléphone appelez teléfono llame".split()),
}
AGAINST = frozenset("isbn issn doi version v no nr order invoice item sku id ref page section article § # $ € £".split())
_WORD = re.compile(r"[^\W_]+|[§#$€£]")
_AT = re.compile(r"[(\[{]at[)\]}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, end, kind`` by the exact patterns, leftmost and non-overlapping within a kind."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at  # the local part is the run before the sign, however long other runs are
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end(), 0))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out)


def votes(text: str, start: int, end: int, kind: int, base: bool) -> list[int]:
    """1, -1 or 0 (no opinion) from each labeler."""
    name, span = KINDS[kind], text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if base:
        pattern = 1
    else:
        pattern = -1 if name == "card" and not luhn(digits) or name == "phone" and not 9 <= len(digits) <= 15 else 0
    if name == "email":
        top = re.split(r"[^A-Za-z0-9]+", span)[-1].lower()
        shape, gazetteer = (1 if top.isalpha() and len(top) >= 2 else -1), (1 if top in TOP_DOMAINS else -1)
    elif name == "ip":
        parts = span.split(".")
        plain = all(p == "0" or not p.startswith("0") for p in parts)
        shape, gazetteer = (1 if plain else -1), (-1 if parts[0] in ("0", "255") else 0 if len(parts) == 4 else 1)
    elif name == "card":
        shape = 1 if re.fullmatch(r"[0-9]{12,19}|[0-9]{4}([ -][0-9]{4}){2,3}([ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span) else -1
        gazetteer = 1 if re.match(r"4|5[1-5]|2[2-7]|3[47]|6011|65|62|35", digits) else -1
    else:
        shape = 1 if re.fullmatch(r"(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}", span) else -1
        gazetteer = 0 if not span.startswith("+") else -1 if digits.startswith("0") else 1
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40):start])][-4:]
    context = 1 if CUES[name] & set(before) else -1 if AGAINST & set(before[-2:]) else 0
    touching = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return [pattern, shape, gazetteer, context, -1 if touching else 0]


def spans(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """Candidates ``start, end, kind, base, pattern of votes, size class``; wider ones do not touch exact ones."""
    exact = base_spans(text)
    found = [(*s, True) for s in exact]
    for name, net in _LOOSE:
        if name == "email" and not _AT.search(text) or name == "ip" and ":" not in text:
            continue
        for m in net.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b, _, _ in found):
                found.append((m.start(), m.end(), KINDS.index(name), False))
    out = []
    for a, b, kind, base in found:
        code = 0
        for v in votes(text, a, b, kind, base):
            code = code * 3 + v + 1
        out.append((a, b, kind, base, code, min((b - a) // 4, 7)))
    return out


def decode(code: np.ndarray) -> np.ndarray:
    """Votes ``[rows, labelers]`` as 0 (against), 1 (no opinion), 2 (for)."""
    return np.stack([code // 3 ** k % 3 for k in range(len(LABELERS) - 1, -1, -1)], axis=1)


def reliabilities(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of being personal data of each vote pattern, by expectation-maximisation.

    Labelers are independent given the truth; each has a table of vote
    probabilities for either truth, and each kind a share of true spans.
    Starts from the majority of votes.
    """
    p = 1 / (1 + np.exp(-2.0 * (vote - 1).sum(axis=1)))
    for _ in range(rounds):
        log = np.zeros((len(p), 2))
        for truth, weight in ((1, p * n), (0, (1 - p) * n)):
            for k in range(vote.shape[1]):
                table = np.bincount(vote[:, k], weight, 3) + 1
                log[:, truth] += np.log(table / table.sum())[vote[:, k]]
            share = np.bincount(kind, weight, len(KINDS)) + 1
            total = np.bincount(kind, n, len(KINDS)) + 2
            log[:, truth] += np.log(share / total)[kind]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -40, 40)))
        done = np.abs(new - p).max(initial=0) < 1e-7
        p = new
        if done:
            break
    return p


def design(kind: np.ndarray, vote: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Features of the span classifier: kind, every vote, and size within kind."""
    hot = [np.eye(len(KINDS))[kind], *[np.eye(3)[vote[:, k]] for k in range(vote.shape[1])], np.eye(8 * len(KINDS))[kind * 8 + size]]
    return np.concatenate(hot, axis=1)


def train(patterns: pd.DataFrame) -> np.ndarray:
    """Logistic weights fitted to the posteriors of all candidates, by Newton steps on their counted patterns."""
    kind, size, n = (patterns[c].to_numpy(np.int64) for c in ("kind", "size", "n"))
    vote = decode(patterns["code"].to_numpy(np.int64))
    x, goal = design(kind, vote, size), reliabilities(kind, vote, n)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (goal - p)) - w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Spans of personal data: ``doc_id, base, spans`` (arrays of ``kind, start, end``), one row per input row.

    Takes ``doc_id, text``; other columns are ignored.  Offsets count code
    points, ends are exclusive; spans come by start, then kind as in ``KINDS``.
    ``base`` holds the exact patterns' matches.  ``spans`` adds candidates of
    wider patterns: regular-expression, gazetteer and context labelers vote on
    all candidates of all documents, expectation-maximisation estimates how far
    each is to be trusted, and a span classifier trained on the outcome keeps
    those of probability ``threshold`` or more that touch no other span.

    What is gathered for training is a count for each pattern of votes, of
    which there are a few thousand at most.  Null and empty texts have no
    spans; repeated rows vote as often as they occur; ids play no part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("base", pa.bool_()), ("code", pa.int32()), ("size", pa.int32())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [[dict(zip(one.names, s, strict=True)) for s in spans(t)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(one))], ["doc_id", "found"])

    held = stored(rows.mapInArrow(look, (
        "doc_id long, found array<struct<start: int, end: int, kind: int, base: boolean, code: int, size: int>>")), "candidates")
    counted = held.select(F.explode("found").alias("f")).groupBy("f.kind", "f.code", "f.size").agg(F.count("*").alias("n"))
    weights = train(counted.orderBy("kind", "code", "size").toPandas())
    named = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for found in batch.column("found").to_pylist():
                sure = [f for f in found if f["base"]]
                maybe = [f for f in found if not f["base"]]
                if maybe:
                    kind, code, size = (np.array([f[c] for f in maybe]) for c in ("kind", "code", "size"))
                    p = 1 / (1 + np.exp(-design(kind, decode(code), size) @ weights))
                    maybe = [f for f, x in zip(maybe, p, strict=True) if x >= threshold]
                order = lambda f: (f["start"], f["kind"])
                name = lambda some: [{"kind": KINDS[f["kind"]], "start": f["start"], "end": f["end"]} for f in sorted(some, key=order)]
                base.append(name(sure))
                every.append(name(sure + maybe))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, named), pa.array(every, named)], ["doc_id", "base", "spans"])

    shape = "array<struct<kind: string, start: int, end: int>>"
    return held.mapInArrow(decide, f"doc_id long, base {shape}, spans {shape}")
