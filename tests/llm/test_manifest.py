"""The Merkle manifest against a plain tree, with null and repeated ids, scattered ids and short groups."""

import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """All levels, and the path of each node as (side, sibling or None)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[i:i + 2]) for i in range(0, len(now), 2)])
    paths = []
    for at in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            path.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else None))
            at >>= 1
        paths.append(path)
    return levels[-1][0], paths


def fold(node, path):
    for side, other in path:
        node = sha(node) if other is None else sha(other, node) if side else sha(node, other)
    return node


def brute(rows):
    """Rows are doc_id, source, lang, n_chars, text."""
    by = defaultdict(list)
    for row in rows:
        by[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    groups = [sorted(by[g], key=lambda x: x[:3]) for g in sorted(by, key=lambda g: (g is not None, (g or "").encode()))]
    trees = [tree([x[2] for x in group]) for group in groups]
    if not trees:
        return Counter()
    root, tops = tree([t[0] for t in trees])
    out = []
    for group, (subroot, paths), top in zip(groups, trees, tops, strict=True):
        for (_, _, own, row), path in zip(group, paths, strict=True):
            now = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                now[3] += 1
            whole = path + top
            folded = fold(leaf(now), whole)
            out.append((row[0], own, subroot, root, sha(*[o for _, o in whole if o]), folded, folded == root))
    return Counter(out)


def manifest(spark, rows):
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, rank int, g int")
    return Counter(map(tuple, merkle.manifest(df.repartition(3)).collect()))


def rows_of(ids, lang="en"):
    return [(i, f"s{k % 3}", lang, 10 + k, f"täxt {k}") for k, i in enumerate(ids)]


def test_messy_rows(spark, messy):
    rows = [(i, None if k % 9 == 0 else "a", (None, "en", "", "ü", "Z", "one")[k % 7 if k % 7 < 5 else 1], None if k % 11 == 0 else k, t) for k, (i, t) in enumerate(messy)]
    rows += [(4, "a", "solo", 1, "x"), *[rows[20]] * 5]
    got = manifest(spark, rows)
    assert got == brute(rows)
    assert {x[-1] for x in got} == {True, False}


IDS = [
    [3, 1, 2], list(range(1024)), list(range(1025)), list(range(2100, 0, -1)),
    [0, -1, 1, -(2**63), 2**63 - 1, 2**40, 2**40 + 63, 2**40 + 64, -65, -64, -63, 2**22, 2**38, 2**54],
    [7] * 40 + [8, None, None, 6, -7],
]


def test_ids(spark):
    rows = [r for k, ids in enumerate(IDS) for r in rows_of(ids, f"l{k}")]
    assert manifest(spark, rows) == brute(rows)


def test_one_row(spark):
    rows = rows_of([5])
    assert manifest(spark, rows) == brute(rows)


def test_more_rounds(spark, monkeypatch):
    """Blocks of four nodes: several rounds below a subroot and above."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [r for n in range(1, 13) for r in rows_of(range(n * 7), f"lang{n}")]
    assert manifest(spark, rows) == brute(rows)


def test_no_leaves(spark):
    assert manifest(spark, []) == Counter()


def test_ranks_are_places_in_order(spark):
    ids = [i * i * 977 % 100_003 for i in range(3000)] + [2**50 + i for i in range(300)]
    df = spark.createDataFrame(rows_of(ids), "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.coordinates(merkle.leaves(df)).orderBy("rank").select("doc_id", "rank", "size").collect()
    assert [r.doc_id for r in got] == sorted(ids)
    assert [r["rank"] for r in got] == list(range(len(ids))) and {r["size"] for r in got} == {len(ids)}
    words = merkle.directory(merkle.leaves(df)).agg(F.count("*")).first()[0]
    assert words == len({i >> 6 for i in ids})
