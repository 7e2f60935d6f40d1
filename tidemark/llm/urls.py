"""URL filters: rules by host and path, and a naive Bayes judge of segmented host names."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

#: Rules of the registered query (fixed values).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words that mark a host as unwanted to begin with; naive Bayes learns the rest from the hosts that carry them.
SEEDS = ("casino", "poker", "bet", "bets", "betting", "lottery", "slots", "jackpot", "adult", "porn", "xxx", "sex", "escort", "cams",
         "pills", "viagra", "pharma", "spam", "ads", "adserver", "tracker", "track", "malware", "phishing", "warez", "torrent", "crack",
         "payday", "replica", "clickbait")
#: Slots of the token counts, and what is added to counts.
SLOTS, SMOOTHING = 1 << 18, 0.1
#: Letters by which a piece of a name is looked up, and places of a name whose pieces are told apart at once.
PIECE, PLACES = 24, 4096
_PARTS = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``verdict, rule`` of the longest rule that fits, else null.

    A rule ``host/path`` fits its host and all subdomains where the path
    starts with the rule's; of rules of one length the first listed wins.
    """
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # longer ones are tried before
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


class Segmenter:
    """Most probable split of a name into words of a unigram model, by dynamic programming.

    ``counts`` needs the words that are pieces of the names only, ``total`` is
    that of all words.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = total or sum(counts.values()) or 1
        self.known = {w: math.log(n / self.total) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts})

    def words(self, name: str) -> list[str]:
        """An unseen word costs ten times less than one count for each letter, so its best start follows from the best of all before."""
        first, letter = math.log(10 / self.total), math.log(10)
        best, back, unseen = [0.0], [0], (-math.inf, 0)
        for end in range(1, len(name) + 1):
            unseen = max(unseen, (best[end - 1] + letter * (end - 1), end - 1))
            score, start = unseen[0] + first - letter * end, unseen[1]
            for length in self.lengths:
                if (s := end - length) < 0:
                    break
                if (p := self.known.get(name[s:end])) is not None and (best[s] + p, s) > (score, start):
                    score, start = best[s] + p, s
            best.append(score)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        return out[::-1]


def name_parts(host: str, path: str) -> list[tuple[str, bool, bool]]:
    """Parts of a host's labels and of the path: part, in the path, to be cut into words."""
    return [(p, False, True) for p in _PARTS.findall(host)] + [(p, True, not p[0].isdigit()) for p in _PARTS.findall(path.lower())]


def slot(token: str) -> int:
    """A token's slot; stable over processes."""
    value = 0xCBF29CE484222325
    for b in token.encode():
        value = (value ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return (value ^ value >> 31) % SLOTS


def lexicon(pages: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """All words of page titles and URL paths with their counts: ``w, n``.

    Host names stay out, since they are what is to be cut.  Seed words count as often as the most frequent word does in a thousand, so that they can be cut out of names.
    """
    title = F.regexp_extract(F.coalesce(F.col("html").cast("string"), F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1)
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", title, "path")), F.lit("([a-z]+|[^\\x00-\\x7f]+)"), 1)
    counted = stored(pages.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
    floor = max(1, (counted.agg(F.max("n")).first()[0] or 0) // 1000)
    marked = pages.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "w string").withColumn("n", F.lit(floor).cast("long"))
    return counted.unionByName(marked).groupBy("w").agg(F.max("n").alias("n"))


def segments(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """Words of every distinct part: ``part, words``; each part meets the counts of its own pieces only.

    A word is looked up by its first ``PIECE`` letters, a longer one is then
    kept where the part holds it.  So a part of n letters makes at most
    ``PIECE`` times n rows, each with a checksum in place of the part.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    keyed = parts.select("part", F.md5("part").alias("key"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        heads: list[str] = []

        def held() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(heads, pa.string())], ["key", "head"])
            keys.clear()
            heads.clear()
            return out

        for batch in batches:
            for part, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True):
                for at in range(0, len(part), PLACES):
                    some = {part[s:s + k] for s in range(at, min(at + PLACES, len(part))) for k in range(1, min(PIECE, len(part) - s) + 1)}
                    keys += [key] * len(some)
                    heads += some
                    if len(heads) >= 50_000:
                        yield held()
        yield held()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [Segmenter({k["w"]: k["n"] for k in known or ()}, total).words(part)
                     for part, known in zip(batch.column("part").to_pylist(), batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(words, pa.list_(pa.string()))], ["part", "words"])

    met = keyed.mapInArrow(pieces, "key string, head string").join(
        counts.select("w", "n", F.substring("w", 1, PIECE).alias("head")), "head").select("key", "w", "n")
    whole = met.filter(F.length("w") <= PIECE).unionByName(
        met.filter(F.length("w") > PIECE).join(keyed, "key").filter(F.col("part").contains(F.col("w"))).select("key", "w", "n"))
    known = whole.groupBy("key").agg(F.collect_set(F.struct("w", "n")).alias("known"))
    return keyed.join(known, "key", "left").select("part", "known").mapInArrow(cut, "part string, words array<string>")


def tokenized(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``host, path, tokens`` of distinct names: words of the host's labels, and of the path marked as such."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, k, *one) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
                    for k, one in enumerate(name_parts(h, p))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             ["host", "path", "place", "part", "in_path", "cut"])

    parts = stored(names.select("host", "path").mapInArrow(split, "host string, path string, place int, part string, in_path boolean, cut boolean"), "parts")
    cuts = segments(parts.filter("cut").select("part").distinct(), counts)
    words = F.coalesce("words", F.array("part"))
    marked = F.when(F.col("in_path"), F.transform(words, lambda w: F.concat(F.lit("/"), w))).otherwise(words)
    met = parts.join(cuts.withColumn("cut", F.lit(True)), ["part", "cut"], "left").groupBy("host", "path").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", marked.alias("tokens")))), lambda s: s["tokens"])).alias("tokens"))
    return names.join(met, ["host", "path"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS,
               threshold: float = 0.5) -> DataFrame:
    """Allow or block every URL: ``page_id, host, path, rule, verdict, score, words``, one row per input row.

    Takes ``page_id, url, html``; other columns are ignored.  A URL that a
    rule fits gets the rule's verdict.  Else its host's labels and its path
    are cut into words by the unigram model (Viterbi), and multinomial naive
    Bayes decides: its two classes are counted over all pages, where a host
    with a seed word is unwanted.  ``score`` is the probability of that class.

    The lexicon is a table of all words; each distinct part of a name meets the
    counts of its own pieces in a join.  The number of count slots is fixed, so
    what is gathered and sent is bounded whatever the table.  A null URL, or
    one without ``://``, has an empty host and path and is judged by the
    classes' shares alone; a null ``html`` has no title.  Repeated rows count
    as often as they occur.  An empty table gives an empty result.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "html")
    sc = pages.sparkSession.sparkContext
    names = stored(tokenized(rows.groupBy("host", "path").agg(F.count("*").alias("n")), lexicon(rows, seeds)), "names")
    marked = frozenset(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, urls = np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for tokens, n in zip(*(batch.column(c).to_pylist() for c in ("tokens", "n")), strict=True):
                bad = int(any(t in marked for t in tokens))
                urls[bad] += n
                for t in tokens:
                    total[bad, slot(t)] += n
        kind, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(kind, [0, 1])), pa.array(np.append(place, [-1, -1])), pa.array(np.append(total[kind, place], urls))],
            ["kind", "slot", "n"])

    found = names.select("tokens", "n").mapInArrow(count, "kind long, slot long, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts, urls = np.zeros((2, SLOTS)), np.ones(2)
    real = found[found.slot >= 0]
    counts[real.kind, real.slot] += real.n
    counts[:, counts.any(axis=0)] += SMOOTHING  # tokens that were never counted say nothing
    prior = found[found.slot < 0].groupby("kind").n.sum()
    urls[prior.index] += prior
    per = np.log(np.where(counts > 0, counts, 1)) - np.where(counts > 0, np.log(np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)), 0)
    model = sc.broadcast(((per[1] - per[0]).astype(np.float32), float(np.log(urls[1] / urls[0]))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, start = model.value
        for batch in batches:
            tokens = batch.column("tokens").to_pylist()
            logit = np.array([start + sum(float(odds[slot(t)]) for t in some) for some in tokens])
            p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), pa.array(p, pa.float64()),
                                              pa.array([" ".join(some) for some in tokens], pa.string())], ["host", "path", "score", "words"])

    scored = names.select("host", "path", "tokens").mapInArrow(score, "host string, path string, score double, words string")
    judged = rows.select("page_id", "host", "path").join(scored, ["host", "path"])
    rule = best_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumn("fit", rule).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score", "words")
