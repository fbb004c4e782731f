"""The filter audit, vector codes and near vectors against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import audit, codes, signs
from barloom.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string"
VECS = "vec_id bigint, embedding array<double>, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 11 filter audit


def prose(rng, n, distinct):
    return " ".join(f"w{rng.randrange(distinct)}" for _ in range(n))


def audit_rows():
    rng = random.Random(3)
    long = prose(rng, 250, 400)
    big = " ".join(f"Long{i % 70_000}" for i in range(600_000)) + "\t" + "y" * 300_000  # over 5 MB, with a long word
    return [
        (1, long, "en"), (2, long, "en"), (3, long, "de"), (4, None, None), (5, "", "en"), (6, " \t\n", None), (7, prose(rng, 300, 50), "en"), (8, "ABC DEF", "de"), (9, "a $5", ""),
        (1, long, "en"), (None, long, "en"), (None, "alone without an id", "fr"), (None, "alone without an id", "fr"), (10, big, "de"), (11, big, "de"), (12, long + " é ü ", "en"),
        (13, "A" * 3 + "b" * 97, "en"), (14, "A" * 4 + "b" * 96, "en"), (15, "É" * 97 + "AAA", "en"), (16, prose(rng, 200, 10**6), "fr"), (17, prose(rng, 199, 10**6), "fr"), (18, " ".join(["a", "b"] * 2 + ["c"] * 0) + " " + prose(rng, 500, 10**6), "fr"),
    ]


LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, 0, 0), (7, 1, None), (9, None, 1), (None, 1, 1), (10, 1, 0), (99, 1, 1)]


def brute_fails(rows):
    first = {}
    for i, text, _ in rows:
        t = text or ""
        if i is not None:
            first[t] = min(first.get(t, i), i)
    out = []
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        at = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), t in first and (i is None or i > first[t])]
        out.append((i, lang or "", len(w), len(set(w)), "".join(x for x, f in zip("ABCDE", at) if f)))
    return out


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("rows", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("word", F.lit(0)).withColumn("fails", F.lit(None).cast("string"))
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("x")).withColumn("good", F.lit(0))
    flags = brute_fails(rows)
    assert sorted(map(str, map(tuple, audit.document_flags(docs).collect()))) == sorted(map(str, flags))
    good, toxic = {i for i, q, _ in LABELS if q == 1 and i is not None}, {i for i, _, x in LABELS if x == 1 and i is not None}
    want = {}
    for part in {f[1] for f in flags}:
        own = [f for f in flags if f[1] == part]
        removed = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[4]]
                left = [f for f in left if x not in f[4]]
                redundant = sum(x in f[4] for f in own) - len(gone)
                want[part, order, step] = [len(left), len(gone), redundant, sum(f[4] == x for f in own), sum(f[0] in good for f in gone), sum(f[0] in toxic for f in gone)]
                removed[x] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                want[part, order, step].append(removed[x])
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.filter_audit(docs, labels).collect()}
    assert got == want
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    assert audit.filter_audit(docs.where("doc_id < 3"), labels.limit(0)).count() == 600


def test_matrix_holds_every_count(spark):
    docs = spark.createDataFrame([r for r in audit_rows() if r[0] != 10], DOCS).repartition(2)
    shards = audit.document_shards(docs, 3000)
    numbers = audit.numbered_words(shards)
    word = {r.id: bytes(r.word).decode() for r in audit.word_dictionary(numbers).collect()}
    assert sorted(word) == list(range(len(word))) and len(set(word.values())) == len(word)
    assert shards.count() > 2 and shards.select("shard").distinct().count() == shards.count()
    got, want = Counter(), Counter()
    for s in audit.csr_shards(shards, numbers).collect():
        for i, row in enumerate(s.rows):
            ids, n = s.indices[s.ends[i] : s.ends[i + 1]], s.counts[s.ends[i] : s.ends[i + 1]]
            assert ids == sorted(set(ids))
            got[row.doc_id, str(sorted((word[k], c) for k, c in zip(ids, n)))] += 1
    for i, t, _ in docs.collect():
        want[i, str(sorted(Counter(WORD.findall(t or "")).items()))] += 1
    assert got == want


# 12 vector codes


def brute_codes(rows, scale=4096, rounds=6):
    """Plain loops over Python's whole numbers; rows of one length."""
    rows = [(i, [math.floor(scale * v) for v in x], y) for i, x, y in rows if x is not None and all(v is not None and math.isfinite(v) for v in x) and len(x) % 8 == 0]
    rows = [(i, [min(max(v, -(2**63)), 2**63 - 1) for v in x], y) for i, x, y in rows]
    if not rows:
        return []
    d = len(rows[0][1]) // 8
    cut = lambda x: [x[p * d : (p + 1) * d] for p in range(8)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[cut(x)[p] for _, x, _ in first] for p in range(8)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    best = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(8):
            of = defaultdict(list)
            for _, x, _ in rows:
                of[best(p, cut(x)[p])].append(cut(x)[p])
            new.append([[sum(c) // len(c) for c in zip(*of[e])] if e in of else b for e, b in enumerate(books[p])])
        books = new
    out, by_label = [], Counter()
    for i, x, y in rows:
        at = [best(p, cut(x)[p]) for p in range(8)]
        error = min(sum(far(cut(x)[p], books[p][e]) for p, e in enumerate(at)), 2**63 - 1)
        out.append((i, "".join(f"{e:02x}" for e in at), error, y))
        by_label[y] += error
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, c, e, min(by_label[y], 2**63 - 1), digest) for i, c, e, y in out]


def vectors(rng, n, d, clusters=12, spread=0.02):
    middle = rng.standard_normal((clusters, d)) * 0.3
    return [(int(i), (middle[rng.integers(clusters)] + rng.standard_normal(d) * spread).tolist(), int(rng.integers(4))) for i in rng.permutation(n)]


CODE_CASES = {
    "clusters": lambda rng: vectors(rng, 700, 16),
    "ties and repeats": lambda rng: [(int(rng.integers(30)), rng.integers(-2, 3, 24).astype(float).tolist(), None if k % 3 else 1) for k in range(300)] + [(None, [0.5] * 24, 2)] * 3,
    "few rows": lambda rng: vectors(rng, 5, 8),
    "huge": lambda rng: [(k, (rng.standard_normal(8) * 10.0 ** rng.integers(0, 300)).tolist(), 1) for k in range(60)],
    "wide": lambda rng: [(k, (rng.standard_normal(16) * 2.0**35).tolist(), 1) for k in range(200)],
    "no components": lambda rng: [(k, [], 1) for k in range(3)],
    "hot label and equal vectors": lambda rng: [(k, [0.25] * 8 if k % 3 else rng.standard_normal(8).tolist(), 7) for k in range(400)],
}


@pytest.mark.parametrize("case", CODE_CASES)
def test_codes_equal_brute_force(spark, case):
    rows = CODE_CASES[case](np.random.default_rng(5))
    odd = [(1, None, 1), (2, [float("nan")] * len(rows[0][1]), 1), (3, [float("inf")] * len(rows[0][1]), None), (4, [None] * len(rows[0][1]), 1), (5, [1.0] * 9, 1)]
    table = spark.createDataFrame(rows + ([r for r in odd if r[1] is None or len(r[1])]), VECS).repartition(3)
    table = table.withColumn("dim", F.lit("x")).withColumn("code", F.lit(1)).withColumn("width", F.lit(0)).withColumn("x", F.lit(0))
    got = codes.compressed(table).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_codes(rows)))


def test_codes_of_several_lengths_and_none(spark):
    rng = np.random.default_rng(6)
    a, b = vectors(rng, 100, 8), [(i + 1000, x, y) for i, x, y in vectors(rng, 90, 16)]
    got = {r.vec_id: (r.code, r.error, r.codebooks_sha256) for r in codes.compressed(spark.createDataFrame(a + b, VECS)).collect()}
    assert got == {i: (c, e, s) for part in (a, b) for i, c, e, _, s in brute_codes(part)}
    assert codes.compressed(spark.createDataFrame([], VECS)).count() == 0


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2), (8, 1)):
        grid = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * d)], 1)
        keys = codes.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_shortlists_hold_the_nearest_and_leave_out_others():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(-5, 6, (64, 4)) + c for c in rng.integers(-500, 500, (40, 4))])
    entries = x[:: len(x) // 16][:16]
    blocks = x.reshape(40, 64, 4)
    may = codes.shortlists(blocks.min(1), blocks.max(1), entries)
    at, _ = codes.nearest(x, entries)
    assert all(may[i // 64, e] for i, e in enumerate(at)) and may.mean() < 0.3


# 13 near vectors


def brute_near(rows, cosine=0.95):
    good = [k for k, (_, x, *_) in enumerate(rows) if x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    unit = {}
    for k in good:
        v = np.array(rows[k][1], float)
        v = v / np.abs(v).max()
        unit[k] = v / np.sqrt(v @ v)
    links = defaultdict(set)
    for d in {len(v) for v in unit.values()}:
        own = [k for k in good if len(unit[k]) == d]
        m = np.stack([unit[k] for k in own])
        for a, b in zip(*np.nonzero(m @ m.T >= cosine)):
            if a != b:
                links[own[a]].add(own[b])
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            for o in links[todo.pop()] - group:
                group.add(o)
                todo.append(o)
        seen |= group
        first = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), first, rows[j][0] == first)
    return out


def near_rows(rng, d=16):
    rows = [rng.standard_normal(d).tolist() for _ in range(150)]
    for size, spread in ((2, 0.05), (3, 0.05), (40, 0.05), (120, 0.04), (6, 0.2), (30, 0.1)):
        middle = rng.standard_normal(d)
        rows += [(middle + rng.standard_normal(d) * spread).tolist() for _ in range(size)]
    rows += [rows[0]] * 5 + [[2 * v for v in rows[1]], [1e-200 * v for v in rows[2]], [1e200 * v for v in rows[3]], [-v for v in rows[4]]]
    walk = rng.standard_normal(d)
    for _ in range(12):  # a chain, each near the next
        walk = walk / np.linalg.norm(walk) + rng.standard_normal(d) * 0.06
        rows.append(walk.tolist())
    rows += [None, [0.0] * d, [-0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [None] + [1.0] * (d - 1), [], [1.0] * 3, [1.0, 1.0, 1.01], [1.0] * 4]
    ids = [int(i) for i in rng.permutation(len(rows) + 50)[: len(rows)]]
    out = list(zip(ids, rows))
    return out + [(None, rows[5]), (None, [7.0] * d), (ids[6], rows[7]), (ids[6], rows[6]), (None, None)]


def counted(rows):
    return Counter(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("few,tile", [(32, 1024), (4, 16)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, few, tile):
    monkeypatch.setattr(signs, "FEW", few)
    monkeypatch.setattr(signs, "TILE", tile)
    monkeypatch.setattr(signs, "MISSED", 1e-7)
    rows = near_rows(np.random.default_rng(8))
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3).withColumn("row", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("node", F.lit("y")).withColumn("key", F.lit(0))
    got = signs.near_vectors(table).collect()
    assert counted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == counted((i, n, c, k if c is not None else True) for i, n, c, k in brute_near(rows))
    assert signs.near_vectors(table.limit(0)).count() == 0


def test_near_vectors_as_registered(spark):
    """A crowd over several tiles beside scattered vectors, as floats, with the parameters of the query."""
    rng = np.random.default_rng(9)
    crowd = rng.standard_normal(24) + rng.standard_normal((2600, 24)) * 0.03
    x = np.concatenate([crowd, rng.standard_normal((3000, 24))]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = signs.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    want = {r[0]: r for r in brute_near(rows)}
    assert all((r.component_id, r.kept) == want[r.vec_id][2:] for r in got)
    assert sum(r.n_links for r in got) >= 0.9999 * sum(w[1] for w in want.values()) and all(r.n_links <= want[r.vec_id][1] for r in got)


def test_tables_follow_the_rows():
    for n in (10, 10**4, 10**9):
        bits, tables = signs.tables_for(n, 0.95)
        meet = (1 - math.acos(0.95) / math.pi) ** bits
        assert n / 2**bits < 0.3 and (1 - meet) ** tables <= signs.MISSED < (1 - meet) ** (tables - 1)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_vector_codes", "op13_near_vectors"])
def test_queries_cover_their_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES[name](spark, sf).count()
    table = spark.read.parquet(f"{sf}/{'documents' if 'audit' in name else 'embeddings'}.parquet")
    assert rows == (600 * table.select(F.coalesce("lang", F.lit(""))).distinct().count() if "audit" in name else table.count())
