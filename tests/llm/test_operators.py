"""Each document operator against brute force, on small fixtures and on the small tables."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from barloom.llm import language, lattice, minhash, mixing, packing, sharding, topk, toxicity
from barloom.llm.common import mixed
from barloom.llm.exact import exact_duplicates, with_buckets
from barloom.llm.minhash import connected, near_duplicates
from barloom.llm.oracle import ORACLE_SQL
from barloom.llm.queries import QUERIES, tokenizer_file
from barloom.llm.tokens import UnigramCounter, plain_vocabulary, token_counts, vocabulary
from barloom.llm.topk import top_k

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls, blanks, ties, repeats, and a column whose name an operator uses itself.
ODD = [
    (1, "alpha beta gamma delta", "en", "a", 1), (2, "alpha  beta\tgamma\ndelta", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0),
    (5, " \t\n", None, "b", 0), (6, "one", "fr", "c", 3), (7, "one two", "fr", "c", 3), (1, "alpha beta gamma delta", "en", "a", 1), (None, "null id", "en", "a", 1),
    (8, "!!! 123 ###", "en", None, 1), (9, "Ünïcode ÉTÉ 你好   é don't o'clock <|endoftext|> \U0001f600", "de", "a", 1), (10, "long " * 3000, "en", "b", 1), (11, "x" * 5000, "de", "c", 1),
]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, DOCS).withColumn("has_letter", F.lit(1)).withColumn("block", F.lit("x")).withColumn("bucket", F.lit(0))


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def words(text):
    return [w for w in WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))]


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# 1 packing


def reference_ids(text):
    from tokenizers import Tokenizer

    t = reference_ids.t = getattr(reference_ids, "t", None) or Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return np.array([*t.encode(text, add_special_tokens=False).ids, 1], np.uint32)


def check_packing(rows, ids_by_doc, copies):
    places = defaultdict(list)
    seen = Counter()
    for r in rows:
        ids = ids_by_doc[r.doc_id]
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.astype("<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
        seen[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: len(ids_by_doc[i]) * copies[i] for i in ids_by_doc}
    padded = 0
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 2048 - at
    return padded / (2048 * len(places))


def test_packing(docs, odd):
    rows = QUERIES["op1_packing"](docs.sparkSession, SF).collect()
    assert check_packing(rows, {i: reference_ids(t) for i, t in texts_of(docs).items()}, defaultdict(lambda: 1)) < 0.02
    rows = packing.packed_documents(odd, tokenizer_file("word_bpe_49k.json")).collect()
    check_packing(rows, {i: reference_ids(t) for i, t in texts_of(odd).items()}, Counter(r[0] for r in ODD))
    assert packing.packed_documents(odd.limit(0), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_pack_plan_uses_everything():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 2049, 20000), np.full(900, 700), np.concatenate([np.full(9000, 1100), rng.integers(1, 1025, 18000)]), np.array([5])):
        histogram = Counter(lengths.tolist())
        plan = packing.pack_plan(histogram)
        used = Counter()
        for part, times in plan:
            assert sum(part) <= 2048 and times > 0
            for n in part:
                used[n] += times
        assert used == histogram
        if len(histogram) > 1:
            assert 1 - lengths.sum() / (2048 * sum(t for _, t in plan)) < 0.09


def test_least_squares_solves_an_exact_case():
    combos = packing.combinations(12)
    truth = np.zeros(len(combos))
    truth[[1, 5, 9]] = 40, 25, 10
    counts = np.zeros(13, np.int64)
    for (a, b, c), x in zip(combos, truth):
        for n in (a, b, c):
            if n:
                counts[n] += int(x)
    x = packing.non_negative_least_squares(combos, counts, 200)
    made = np.zeros(13)
    for row, k in zip(combos, x):
        for n in row[row > 0]:
            made[n] += k
    assert (x >= 0).all() and np.abs(made - counts).max() < 1


# 2 exact duplicates


def check_exact(rows, table):
    norm = {}
    groups = defaultdict(list)
    for i, t, *_ in table:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        norm.setdefault(i, set()).add(n)
        groups[n].append(i)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): ids for n, ids in groups.items()}
    assert len(rows) == len(table)
    for r in rows:
        ids = by_sha[r.text_sha256]
        keep = min((i for i in ids if i is not None), default=None)
        assert r.doc_id in ids and (r.keep_id, r.group_size, r.kept) == (keep, len(ids), keep is None or r.doc_id == keep)


def test_exact(docs, odd):
    check_exact(QUERIES["op2_exact_dedup"](docs.sparkSession, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check_exact(exact_duplicates(odd, capacity=2).collect(), ODD)
    assert exact_duplicates(odd.limit(0)).count() == 0


def test_directory_doubles_only_for_overfull_buckets(spark):
    from pyspark.sql import functions as F

    at = lambda bits, n: [(((bits << 60) + i + (1 << 63)) % (1 << 64) - (1 << 63), i) for i in range(n)]
    heads = spark.createDataFrame(at(0b0000, 3) + at(0b0001, 3) + at(0b1000, 2), "h bigint, doc_id bigint")
    got = {(r.first, r.bucket, r.depth) for r in with_buckets(heads, 3, 8).select(F.shiftrightunsigned("h", 60).alias("first"), "bucket", "depth").distinct().collect()}
    assert got == {(0, 0, 4), (1, 1 << 36, 4), (8, 1 << 39, 1)}
    # one hash over the capacity ends at full depth, whatever else is there
    same = spark.createDataFrame([(5 << 30, i) for i in range(40)] + [(i << 50, i) for i in range(200)], "h bigint, doc_id bigint")
    by = {r.bucket: r.n for r in with_buckets(same, 10, 240).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert sum(by.values()) == 240 and max(by.values()) == 40 and sorted(by.values())[-2] <= 10


# 3 language


def test_language(docs, odd):
    rows = {r.doc_id: r for r in QUERIES["op3_language_id"](docs.sparkSession, SF).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in rows if rows[i].held_out]
    assert set(held) == {i for i in lang if crc(i, 4) == 2}
    assert np.mean([rows[i].lang_pred == lang[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())
    model = language.fit_language(docs)
    got = language.identify(odd, model).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 8}
    kept = language.known_language(odd, model)
    assert kept.columns == odd.columns and not {3, 4, 5, 8} & {r.doc_id for r in kept.collect()}
    none = language.fit_language(odd.limit(0))
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"} and language.identify(odd.limit(0), model).count() == 0


def test_language_equals_brute_force(spark, odd):
    rng = random.Random(4)
    letters = {"aa": "abcdeé ", "bb": "defgh ", "cc": "ghiß jk "}
    table = [(i, "".join(rng.choice(letters[x]) for _ in range(rng.randint(5, 900))), x) for i in range(120) for x in [rng.choice(list(letters))]]
    df = spark.createDataFrame([(i, t, x, "a", 1) for i, t, x in table], DOCS)
    model = language.fit_language(df)

    def cells(text):
        b = [32, *(c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in text.encode()), 32]
        b += [32] * 4
        out = []
        for k, n in enumerate(language.ORDERS):
            for i in range(len(b) - 4):
                gram = 0
                for c in b[i : i + n]:
                    gram = gram << 8 | c
                out.append(k * language.CELLS + ((gram * 0x9E3779B97F4A7C15) % 2**64 >> 48))
        return out

    counts = {x: Counter() for x in letters}
    for i, t, x in table:
        if crc(i, 4) != 2:
            counts[x].update(cells(t))
    share = {}
    for x, own in counts.items():
        for k in range(len(language.ORDERS)):
            total = sum(n for c, n in own.items() if c // language.CELLS == k)
            share[x, k] = lambda c, own=own, total=total: (own[c] + 0.02) / (total + 0.02 * language.CELLS)
    names = sorted(letters)
    code = language.codewords(3)
    assert model.languages == names
    for _, t, _ in table[:30]:
        got = model.margins([t.encode()])[0][0]
        for bit in range(code.shape[1]):
            up, down = [x for x, c in zip(names, code[:, bit]) if c > 0], [x for x, c in zip(names, code[:, bit]) if c < 0]
            mean = lambda side, c: sum(share[x, c // language.CELLS](c) for x in side) / len(side)
            own = cells(t)
            # the last places of a text stand for the gap to the next one
            want = sum(math.log(mean(up, c) / mean(down, c)) for c in own) / len(own)
            assert got[bit] == pytest.approx(want, rel=0.05, abs=0.05)
        margin = model.margins([t.encode()])[0][0] * min(model.margins([t.encode()])[1][0], language.SATURATION) / 4
        losses = [sum(np.logaddexp(0, -m * s) * w for m, s, w in zip(margin, row, trust)) for row, trust in zip(code, model.trust)]
        best, p, _ = model.predict([t.encode()])
        assert best[0] == int(np.argmin(losses)) and p[0] == pytest.approx(1 / sum(math.exp(min(losses) - x) for x in losses))
    rows = {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()}
    assert np.mean([rows[i] == x for i, _, x in table if crc(i, 4) == 2]) > 0.95


def test_codewords_keep_apart():
    for n in (2, 4, 5, 9, 30):
        code = language.codewords(n).astype(int)
        apart = ((code[:, None] != code[None]).sum(2) + 99 * np.eye(n, dtype=int)).min()
        assert apart >= max(1, code.shape[1] // 4)


# 4 mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 300, 300], [5, 2, 1]) == pytest.approx([30, 1160 / 3, 580 / 3])
    assert mixing.targets([0, 5], [5, 2]) == [0, 5]


def test_splitting_tree():
    tree = mixing.splitting_tree([1000, 10, 0], 7)
    assert tree.sum(0).tolist() == [1000, 10, 0] and np.ptp(tree.sum(1)) <= 2 and (tree >= 0).all()


def test_mixing(docs, odd, spark):
    for df, table in ((docs, [(r.doc_id, r.text, r.source) for r in docs.collect()]), (odd, [(r[0], r[1], r[3]) for r in ODD])):
        rows = mixing.mixed_documents(df).collect()
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(t[0]) for t in table)
        size = {t[0]: len(words(t[1] or "")) for t in table}
        of = defaultdict(int)
        for i, _, s in table:
            of[s] += size[i]
        names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
        goal = dict(zip(names, mixing.targets([of[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
        taken = defaultdict(int)
        for r in rows:
            assert r.size == size[r.doc_id] and r.source_size == of[r.source] and r.target == pytest.approx(goal[r.source])
            assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and len(r.shards) <= r.copies and len(r.places) == len(r.shards)
            taken[r.source] += r.taken
        for s in names:
            assert abs(taken[s] - goal[s]) <= max((size[i] for i, _, x in table if x == s), default=0)
        again = mixing.mixed_documents(df).collect()
        assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mixed_documents(odd.limit(0)).count() == 0


def test_mixing_deals_disjoint_blocks_by_exact_quotas(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, " ".join("w" for _ in range(rng.randint(5, 9))), rng.choice("abbbbbb")) for i in range(3000)], "doc_id bigint, text string, source string")
    rows = mixing.mixed_documents(df, shards=5).collect()
    home = defaultdict(set)
    for r in rows:
        for n, shard in enumerate(r.shards):
            home[r.source, r.block, n].add(shard)
    assert all(len(x) == 1 for x in home.values())  # a drawn block is in one shard alone
    drawn = Counter(k[0] for k in home)
    tree = mixing.splitting_tree([drawn["a"], drawn["b"]], 5)
    got = Counter((s, next(iter(x))) for (s, _, _), x in home.items())
    assert [[got["a", k], got["b", k]] for k in range(5)] == tree.tolist()
    # each shard's copies come in the shuffled order of their places, in no order of ids
    out = mixing.in_shards(mixing.mixed_documents(df, shards=5).where("copies > 0"), "shards", "places", ["doc_id"], slices=1).collect()
    assert Counter(r.doc_id for r in out) == Counter({r.doc_id: r.copies for r in rows if r.copies}) and [r.doc_id for r in out[:50]] != sorted(r.doc_id for r in out[:50])


def test_mixing_grows_with_its_sources(spark, monkeypatch):
    assert [mixing.blocks_of(n) for n in (0, 1, 10_000, 10**10)] == [1, 1, 250, 7905694]
    monkeypatch.setattr(mixing, "SHARD_BYTES", 100)
    df = spark.createDataFrame([(i, "some words here", "ab"[i % 2]) for i in range(2000)], "doc_id bigint, text string, source string")
    assert {k for r in mixing.mixed_documents(df).collect() for k in r.shards} <= set(range(300))
    assert max(k for r in mixing.mixed_documents(df).collect() for k in r.shards) > mixing.LEAST_SHARDS


# 5 top-k


def brute_top(rows, every=100, k=10):
    vecs = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    first = {}
    for i, v in sorted(vecs):
        first.setdefault(i, v)
    for q, v in first.items():
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vecs if i != q and len(w) == len(v))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(700)] + [(1000 + i, [0.5, 1.0, 0.0, 0.0, 0.0, 1.0]) for i in range(50)]
    rows += [(100, None), (None, [1.0] * 6), (2000, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2200, [1.0, 2.0]), (2201, [3.0, 1.0]), (2300, []), (2301, []), (2400, [1e4] * 6), (300, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {tuple(r) for r in top_k(df).collect()} == brute_top(rows)
    assert top_k(df.limit(0)).count() == 0
    huge = [(i, [1e6 * (i + 1), -3.0]) for i in range(5)] + [(7, [1e300, 1.0])]
    got = {tuple(r) for r in top_k(spark.createDataFrame(huge, "vec_id bigint, embedding array<double>"), k=3).collect()}
    assert {r[:3] for r in got} == {(0, 1, 7), (0, 2, 4), (0, 3, 3)} and max(r[3] for r in got) == 2**63 - 1
    small = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert {tuple(r) for r in QUERIES["op5_topk"](spark, SF).collect()} == brute_top([(r.vec_id, r.embedding) for r in small.collect()])


def broadcast_rows(df):
    """Rows of each broadcast in the plan that gave df's rows."""
    out, plans = [], [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            out.append(p.metrics().get("numOutputRows").get().value())
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        else:
            plans += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_top_k_broadcasts_no_queries(spark, monkeypatch):
    """What the driver gets to broadcast has a row a cell or block, none for each query and cell (1,000 by some 60 here)."""
    monkeypatch.setattr(topk, "CELL_ROWS", 40)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(4000)]
    df = top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(8), every=4)
    got = {tuple(r) for r in df.collect()}
    assert got == brute_top(rows, every=4)
    assert max(broadcast_rows(df)) < 200


@pytest.mark.parametrize("scale, crowd", [(0.1, 3), (5, 40), (1e5, 3)])
def test_top_k_in_teams_and_parts(spark, monkeypatch, scale, crowd):
    """Many teams, parts and blocks, cells that can be ruled out, ties, repeated ids, numbers of all widths."""
    for name, value in (("CELL_ROWS", 30), ("BLOCK_ROWS", 16), ("TEAM_BYTES", 8 * 300), ("PARTS", 5), ("FEW_ROWS", 2), ("QUERY_STEP", 4), ("ROW_STEP", 16)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(7)
    centres = [[rng.gauss(0, 5) for _ in range(3)] for _ in range(9)]
    rows = [(i, [scale * (c + rng.gauss(0, 0.2)) for c in centres[i % 9]]) for i in range(900)]
    rows += [(900 + i, [float(scale)] * 3) for i in range(crowd)] + [(20, rows[7][1]), (20, rows[8][1]), (33, rows[8][1])] + [(2000 + i, [rng.random()]) for i in range(30)]
    if crowd > 3:
        rows = rows + rows[:200]  # the same rows once more
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4), every=10, k=5).collect()]
    want = brute_top(rows, every=10, k=5)
    assert set(got) == want and len(got) == len(want)


def test_packed_integers():
    for most in (0, 2**15 - 1, 2**15, 2**31 - 1, 2**31, 2**63 - 1):
        x = np.array([[most, -most - 1], [0, 1]], np.int64)
        assert topk.unpacked(topk.packed(x), 2).tolist() == x.tolist()
    both = topk.pa.concat_arrays([topk.packed(np.array([[1, 2]])), topk.packed(np.array([[2**40, -5]])), topk.packed(np.array([[3, 4]]))])
    assert topk.unpacked(both, 2).tolist() == [[1, 2], [2**40, -5], [3, 4]] and topk.unpacked(both[1:], 2).tolist() == [[2**40, -5], [3, 4]] and topk.unpacked(both[2:], 2).tolist() == [[3, 4]]
    assert topk.unpacked(topk.packed(np.zeros((3, 0), np.int64)), 0).shape == (3, 0)


# 6 sharding


@pytest.mark.parametrize("limit", [3000, 40_000, 16 << 20])
def test_sharding(docs, limit):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(sharding.shards_sql(limit)).fetchall()
    got = [tuple(r) for r in sharding.extendible_shards(docs, limit).collect()]
    if limit > 10_000:
        assert sorted(got) == sorted(want)
    of = defaultdict(list)
    for r in got:
        of[r[5]].append(r)
    for rows in of.values():
        assert {r[6] for r in rows} == {sum(r[1] for r in rows)} and (rows[0][6] <= limit or len(rows) == 1)
    assert len(got) == docs.count()


def test_sharding_odd(odd, tmp_path):
    got = sharding.extendible_shards(odd, 3000).collect()
    assert len(got) == len(ODD)
    of = defaultdict(list)
    for r in got:
        of[r.shard].append(r.n_bytes)
    assert all(sum(v) <= 3000 or sum(x > 0 for x in v) == 1 for v in of.values())
    assert sharding.extendible_shards(odd.limit(0)).count() == 0
    same = [(1, "a" * 1400), (1, "b" * 1400), (1, None), (None, "c" * 1400), (None, "d" * 10), (2, "e" * 2900), (3, "f" * 5000)]
    for n, table in enumerate((odd, odd.sparkSession.createDataFrame(same, "doc_id bigint, text string").selectExpr("*", "'x' AS shard"))):
        plan = sharding.write_shards(table, str(tmp_path / f"s{n}"), 3000).collect()
        back = odd.sparkSession.read.parquet(str(tmp_path / f"s{n}"))
        assert Counter(map(str, map(tuple, back.select(table.columns).collect()))) == Counter(map(str, map(tuple, table.collect())))
        size, rows = Counter(), Counter()
        for r in back.select(back.columns[-1], "text").collect():
            size[r[0]] += len((r[1] or "").encode())
            rows[r[0]] += bool(r[1])
        assert all(b <= 3000 or rows[s] == 1 for s, b in size.items()) and size == Counter({r.shard: r.shard_bytes for r in plan})


def test_tables_without_a_folder_set(tmp_path):
    """Where spark.checkpoint.dir is unset, a local session gets a folder of its own, the same each time."""
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
from barloom.llm.common import shared_dir, written
from barloom.sources.files import scratch
assert written(spark.range(5), "x").count() == 5 and shared_dir(spark) == shared_dir(spark)
spark.range(3).write.parquet(scratch(spark, "y"))
print("fine")
"""
    done = subprocess.run([sys.executable, "-c", code], env={**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_special_tokens_as_the_plain_call(spark):
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext|>", "x <|endoftext |> <|endoftext|>, end"]
    rows = packing.packed_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), tokenizer_file("word_bpe_49k.json")).collect()
    check_packing(rows, {i: reference_ids(t) for i, t in enumerate(texts)}, defaultdict(lambda: 1))


# 7 near duplicates


def brute_near(table, k, percent):
    sets = []
    for i, t in table:
        w = words(t or "")
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(n)
    for n, (i, s) in enumerate(sets):
        both = Counter(m for x in s for m in index[x] if m < n)
        for m, c in both.items():
            j, o = sets[m]
            if 100 * c >= percent * (len(s) + len(o) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


def test_near(docs, spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        assert sorted(tuple(r) for r in QUERIES["op7_near_dedup"](spark, sf).collect()) == sorted(brute_near(table, 3, 85))


def test_near_odd(spark, odd):
    rows = [(r[0], r[1]) for r in ODD if r[0] is not None]
    got = near_duplicates(odd.where("doc_id is not null"), 3, 85).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_near(rows, 3, 85))
    assert near_duplicates(odd).count() == len(ODD) and near_duplicates(odd.limit(0)).count() == 0


def test_near_family_is_found(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(300)]
    table = []
    for i in range(250):  # all close to the base, hardly to each other
        w = list(base)
        for j in rng.sample(range(300), 7):
            w[j] = rng.choice(vocab)
        table.append((i + 1, " ".join(w)))
    table.append((500, " ".join(base)))
    table += [(1000 + i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40)))) for i in range(200)]
    df = spark.createDataFrame(table, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in near_duplicates(df, 3, 85).collect()) == sorted(brute_near(table, 3, 85))


def test_near_crowds_and_families_lose_no_link(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(100_000)]
    core = [rng.choice(vocab) for _ in range(92)]
    table = [(i + 1, " ".join(core + [rng.choice(vocab) for _ in range(10)])) for i in range(300)]  # a crowd just under the threshold
    for j in range(60):  # pairs above it, inside the crowd
        w = table[j * 5][1].split()
        for p in rng.sample(range(92, 102), 5):
            w[p] = rng.choice(vocab)
        table.append((1000 + j, " ".join(w)))
    for j in range(8):  # a small family that shares most of its words with a much larger one
        table.append((2000 + j, " ".join(core[:70] + [f"own{i}" for i in range(30)] + [rng.choice(vocab)])))
    df = spark.createDataFrame(table, "doc_id bigint, text string")
    want = sorted(brute_near(table, 3, 85))
    assert sum(not r[3] for r in want) > 10 and sorted(tuple(r) for r in near_duplicates(df, 3, 85).collect()) == want


def test_connected_chain(spark):
    links = [(i + 1, i) for i in range(40)] + [(101, 100)]
    got = {tuple(r) for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(101, 100)}


# 8 language model


def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces([b"a", b"b", b"ab", b"ba", b"aba"], np.log([0.2, 0.2, 0.1, 0.1, 0.1, 0.3]))

    def brute(w):
        if not w:
            return 1.0
        return sum(p * brute(w[len(n) :]) for n, p in zip(pieces.names, np.exp(pieces.logp)) if w.startswith(n))

    for w in (b"a", b"ab", b"abab", b"babaab"):
        assert math.exp(pieces.log_marginals([w])[0]) == pytest.approx(brute(w))
        assert math.exp(pieces.one(w)) == pytest.approx(brute(w))
    used = pieces.expected([b"ab"], np.array([2.0]))
    whole, parts = 0.1, 0.2 * 0.2
    assert used == pytest.approx([2 * parts / (whole + parts)] * 2 + [2 * whole / (whole + parts), 0, 0, 0])


def test_pieces_learn_from_words_and_pieces_of_every_length(spark, monkeypatch):
    names = [b"a", b"b", b"ab", b"ab" * 20]
    own = lattice.Pieces(names, np.log(np.array([0.2, 0.2, 0.2, 0.1, 0.3])))
    word = b"ab" * 60
    once = np.ones(1)
    short = own.expected([word], once)
    limit, lattice.LONG = lattice.LONG, 100
    try:
        assert np.allclose(own.expected([word], once), short) and short[3] > 0
    finally:
        lattice.LONG = limit
    assert np.isclose(own.expected([word * 2], once)[:-1] @ own.sizes, 240)
    with monkeypatch.context() as m:
        m.setattr(lattice, "vocabulary", lambda path: [(lattice.SPACE_MARK + "x" * 30, -1.0)])
        assert lattice.starting_pieces("").sizes.max() == 31  # with its mark
    # every round reads every word, so that its uses of the stop are all words
    seen, real = [], lattice.by_arrow
    lattice.by_arrow = lambda df, f, schema: (seen.append(df.count()) if "uses" in schema else None, real(df, f, schema))[1]
    try:
        lattice.lattice_scores(spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(100))) for i in range(20)], "doc_id bigint, text string"), tokenizer_file("piece_bpe_32k.model"))
    finally:
        lattice.by_arrow = real
    assert len(seen) > 1 and set(seen) == {100}


def test_lattice_pieces_are_told_by_the_model_and_long_words_keep_no_arcs():
    path = tokenizer_file("piece_bpe_32k.model")
    names = {x for x, _ in plain_vocabulary(path)}
    assert not names & {"<s>", "</s>", "<unk>", "<0x41>"}
    bracketed = [x for x, _ in vocabulary(path) if x.startswith("<") and x.endswith(">") and x in names]
    assert all(x.replace(lattice.SPACE_MARK, " ").encode() in lattice.starting_pieces(path).by_name for x in bracketed if x == x.lower())
    own = lattice.Pieces([b"a", b"b", b"ab"], np.log(np.array([0.3, 0.2, 0.2, 0.3])))
    word = b"ab" * 20_000
    tracemalloc.start()
    uses, likely = own.uses([word], np.ones(1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert likely == pytest.approx(own.one(word)) and uses[:-1] @ own.sizes == pytest.approx(len(word)) and peak < 40 * len(word)


def check_lm(rows, table):
    held = {i: i is not None and crc(i, 7) == 2 for i, _ in table}
    toks = [(i, [*words(t or ""), b"\n"]) for i, t in table]
    c = Counter(w for i, ws in toks if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in toks)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    return rows


def test_lm_score_equals_brute_force(spark, monkeypatch):
    mark = lattice.SPACE_MARK
    names = ["a", f"{mark}b", "ab", "ba", f"{mark}abc", "c", "É", mark, f"{mark}ab"]
    monkeypatch.setattr(lattice, "vocabulary", lambda path: [(x, -float(i)) for i, x in enumerate(names)])
    texts = {1: "ab abc a", 2: "b ab AB", 3: "cab é É", 4: "", 5: None, 6: "abcabcab x", 18: "ab ba zz ab"}
    given = {bytes([b]): 1e-6 for b in range(256)}
    for i, x in enumerate(names):
        given[x.replace(mark, " ").encode()] = 1 / (20 + i)
    given["end"] = 1 / 20
    given = {k: x / sum(given.values()) for k, x in given.items()}

    def ways(w, p):
        return [[]] if not w else [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in p for rest in ways(w[k:], p)]

    def weight(way, p):
        return math.prod(p[x] for x in way)

    held = {i: crc(i, 7) == 2 for i in texts}
    trained = Counter(b" " + w for i, t in texts.items() if not held[i] for w in words(t or ""))
    p = given
    n, gain, before = sum(trained.values()) + sum(not h for h in held.values()), math.inf, -math.inf
    while gain >= lattice.SETTLED * n:
        uses = Counter({"end": sum(not h for h in held.values())})
        likely = uses["end"] * math.log(p["end"]) + sum(k * math.log(sum(weight(x, p) for x in ways(w, p))) for w, k in trained.items())
        gain, before = likely - before, likely
        for w, n in trained.items():
            all_ = ways(w, p)
            whole = sum(weight(x, p) for x in all_)
            for x in all_:
                for piece in x:
                    uses[piece] += n * weight(x, p) / whole
        total = sum(uses.values())
        p = {k: 0.1 * given[k] + 0.9 * uses[k] / total for k in given}
    got = lattice.lattice_scores(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), "").collect()
    assert any(held.values()) and len(got) == len(texts)
    for r in got:
        want = math.log10(p["end"]) + sum(math.log10(sum(weight(x, p) for x in ways(b" " + w, p))) for w in words(texts[r.doc_id] or ""))
        assert r.score == pytest.approx(want)


def test_lm(docs, odd, spark):
    rows = check_lm(QUERIES["op8_lm_scoring"](spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    # seen texts are told from held-out ones, and more pieces of evidence only help
    rate = lambda flag: sum(r.score for r in rows if r.held_out is flag) / sum(r.n_tokens for r in rows if r.held_out is flag)
    assert rate(False) > -8 and rate(True) > -8
    path = tokenizer_file("piece_bpe_32k.model")
    check_lm(lattice.lattice_scores(odd, path).collect(), [(r[0], r[1]) for r in ODD])
    assert lattice.lattice_scores(odd.limit(0), path).count() == 0


# 9 token counts


def test_token_counts(docs, odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer_file("piece_bpe_32k.model")
    whole = Tokenizer(models.Unigram(vocabulary(path), unk_id=0, byte_fallback=True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    for df in (docs, odd):
        for r in df.join(token_counts(df, path), "doc_id").select("text", "n_tokens").collect():
            assert r.n_tokens == len(whole.encode(r.text or "", add_special_tokens=False).ids), (r.text or "")[:80]
    assert token_counts(odd, path).count() == len(ODD) and token_counts(odd.limit(0), path).count() == 0


def test_one_lattice_equals_words():
    counter = UnigramCounter(tokenizer_file("piece_bpe_32k.model"))
    text = "The  quick brown fox, über-allem 你好 jumps...  over   \n\n  x"
    assert counter.tokens(text) == counter.count("▁" + text.replace(" ", "▁"))


# 10 toxicity


def test_restoration():
    counts = toxicity.character_counts([b"the idiot and the moron said stupid things to the loser " * 50 + b"hello little bottle better butter all"])
    own = toxicity.Restorer(counts)
    for text, word in ((b"you 1d10t", b"idiot"), (b"stup1d", b"stupid"), (b"an i.d.i.o.t here", b"idiot"), (b"m o r o n", b"moron"), (b"looooser!!!", b"loser"), (b"$tup1d!", b"stupid"), (b"M-O-R-0-N.", b"moron")):
        assert word in own.words(text), text
    assert set(own.words(b"little bottle, all good 123 $5")) == {b"little", b"bottle", b"all", b"good"} | set(own.words(b"123 $5"))
    assert own.words(b"1d10t idiot id1ot idiot!! i d i o t")[b"idiot"] == 5


def test_restoration_parts_spelled_words_and_takes_long_tokens():
    counts = toxicity.character_counts([b"the idiot and a moron said stupid things to the loser. you are a stupid idiot and i am a moron " * 50 + b"hello little bottle better butter all"])
    own = toxicity.Restorer(counts)
    assert {b"a", b"moron"} <= set(own.words(b"he is a m o r o n")) and {b"stupid", b"idiot"} <= set(own.words(b"s t u p i d i d i o t"))
    assert {b"stupid", b"idiot"} <= set(own.words(b"a s t u p i d i d i o t")) and {b"stupid", b"idiot"} <= set(own.words(b"s t u p i d   i d i o t"))
    assert b"stupid" in own.words(b"st" + b"u" * 60 + b"pid") and b"idiot" in own.words(b"1" * 60 + b"d10t")
    sentence = b"y o u  a r e  a  s t u p i d  i d i o t  a n d  a  m 0 r o n  y o u  a r e  a  s t u p i d  l o s e r"
    assert {b"stupid", b"idiot", b"moron", b"loser"} <= set(own.words(sentence))
    assert b"idiot" in own.words(b"i d i o t") and own.words(b"x1" * 100_000)


def test_toxicity_features_equal_a_recount(spark):
    rng, known = random.Random(5), []
    pool = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    for i in range(3000):
        toxic = int(i % 3 == 0)
        words = set(rng.choices(pool, k=12))
        words |= {w for w, odds in (("grumbler", 0.2), ("grumbled", 0.02), ("grumbles", 0.008), ("rarely", 0.02)) if toxic and rng.random() < odds}
        words |= {"rarely"} if not toxic and i % 9 == 1 else set()
        known.append((toxic, [w.encode() for w in sorted(words)], [1] * len(words)))
    n1 = sum(k[0] for k in known)
    n0 = len(known) - n1
    count = (Counter(), Counter())
    for toxic, words, _ in known:
        count[toxic].update({x for w in words for x in (w, *(w[:n] + b"*" for n in (4, 5, 6) if len(w) > n))})
    tested = {f for f, n in count[1].items() if n >= toxicity.FEWEST}
    want = {}
    for f in tested:
        a, b = count[1][f], count[0][f]
        if f.endswith(b"*"):
            lead = max(((count[1][w], w) for w in tested if not w.endswith(b"*") and len(w) >= len(f) and w.startswith(f[:-1])), default=None)
            if lead:
                a, b = a - lead[0], b - count[0][lead[1]]
        if a <= 0:
            continue
        p = (a + b) / len(known)
        ratio = 2 * sum(k * math.log(k / (n * q)) for k, n, q in ((a, n1, p), (b, n0, p), (n1 - a, n1, 1 - p), (n0 - b, n0, 1 - p)) if k)
        w = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if w >= toxicity.LIFT and ratio >= max(toxicity.EVIDENCE, 2 * math.log(len(tested)) + toxicity.SLACK):
            want[f] = w
    got = toxicity.telling(spark.createDataFrame(known, "toxic int, words array<binary>, times array<bigint>"), n0, n1).collect()
    assert {bytes(r.feature): r.weight for r in got} == pytest.approx(want)
    assert b"grumbler" in want and b"grumbled" in want and b"rarely" not in want
    assert any(count[1][f] < 0.01 * n1 for f in tested)


def test_toxicity_learns_words_of_few_toxic_texts(spark):
    filler = [f"plain words of text number {i % 50} stand here" for i in range(5000)]
    docs = [(i, x + (" awful" if i % 2 == 0 else "") + (" zorgish" if i % 400 == 2 else "")) for i, x in enumerate(filler)]
    model = toxicity.fit_toxicity(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in docs], "doc_id bigint, toxic int"))
    assert b"awful" in model.weights and b"zorgish" not in model.weights  # half of the rows being toxic, 10 documents of 2,500 tell too little
    docs = [(i, x + (" awful" if i % 10 == 0 else "") + (" zorgish" if i % 500 == 0 else "")) for i, x in enumerate(filler * 4)]
    model = toxicity.fit_toxicity(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in docs], "doc_id bigint, toxic int"))
    assert b"zorgish" in model.weights


def test_toxicity(spark, odd):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if rows[i].held_out]
    assert len(rows) == 10_000 and all(crc(i, 5) == 0 for i in held)
    hits = sum(rows[i].predicted and labels[i] for i in held)
    assert hits >= 0.85 * sum(labels[i] for i in held) and hits >= 0.9 * sum(rows[i].predicted for i in held)
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_toxicity(docs, marks)
    fixed = spark.createDataFrame([(1, "you are a m0r0n and an idiot"), (2, "what an i d i o t he is, looooser"), (3, "the and of")], "doc_id bigint, text string")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(fixed, model).collect()} == {1: 1, 2: 1, 3: 0}
    assert toxicity.toxicity(odd, model).count() == len(ODD) and toxicity.toxicity(odd.limit(0), model).count() == 0
    none = toxicity.fit_toxicity(odd, marks.limit(0))
    assert {r.predicted for r in toxicity.toxicity(odd, none).collect()} == {0}
    assert toxicity.fit_toxicity(odd.limit(0), marks.withColumn("toxic", F.lit(None).cast("int"))).weights == {}


# all


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want.fetchall())), name


def test_hash_finaliser_spreads():
    x = mixed(np.arange(10000, dtype=np.uint64))
    assert len(np.unique(x >> np.uint64(50))) > 7000


def test_unlike_texts_with_rare_shingles_in_common_are_no_candidates(spark):
    rng = random.Random(3)
    common, pool, size = list(range(50)), list(range(1000, 1040)), 120
    sets = {i: sorted(common + rng.sample(pool, 10)) for i in range(size)}
    sets[size] = sorted(sets[7][:-1] + [5000])  # alike: 59 of 61
    rows = [(i, s, minhash.marks(np.array(s, np.int64)).tolist()) for i, s in sets.items()]
    alike = {(b, a) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})}
    left = spark.createDataFrame([(1, i) for i in sets], "bucket bigint, doc_id bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    found = minhash.rare_shingle_edges(left, roots, spark.createDataFrame(rows, "doc_id bigint, shingles array<bigint>, marks array<bigint>"), 85)
    found = {(r["a"], r["b"]) for r in found.collect()}
    assert alike <= found and (size, 7) in found
    assert len(found) < 2 * size  # without marks a good part of all 7,260 pairs


def test_marks_differ_no_more_than_sets():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, 2000)[: rng.integers(0, 2000)]) for _ in "ab")
        b = np.union1d(b[: rng.integers(0, 40)], a[: rng.integers(0, len(a) + 1)])
        apart = sum(int(x).bit_count() for x in (minhash.marks(a) ^ minhash.marks(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_lattice_looks_up_few_places_and_agrees_with_the_log_form(monkeypatch):
    rng = random.Random(4)
    names = [bytes([b]) for b in range(97, 123)] + list({bytes(rng.choices(range(97, 123), k=n)) for n in (2, 3, 4, 5) for _ in range(150)})
    pieces = lattice.Pieces(names, np.log(np.full(len(names) + 1, 1 / (len(names) + 1))))
    words = [bytes(rng.choices(range(97, 123), k=rng.randint(1, 40))) for _ in range(500)] + [names[-1] * 3]
    times = np.array([rng.randint(1, 9) for _ in words], float)
    asked = []
    find = lattice.Pieces.find
    monkeypatch.setattr(lattice.Pieces, "find", lambda self, h, size: asked.append(len(h)) or find(self, h, size))
    uses, likely = pieces.uses(words, times)
    assert sum(asked) < sum(map(len, words))  # before, one for each place and length of piece
    marginals = pieces.log_marginals(words)
    monkeypatch.setattr(lattice, "PLAIN", 0.0)
    logs, likely_by_logs = pieces.uses(words, times)
    assert np.allclose(uses, logs, rtol=1e-10) and np.isclose(likely, likely_by_logs, rtol=1e-12)
    assert np.allclose(marginals, pieces.log_marginals(words), rtol=1e-12)


def test_only_words_that_begin_as_a_feature_are_weighed():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    weights = Counted({b"vile": 5.0, b"grub": 4.5, b"grubb*": 6.0, b"ox": 4.25, b"nasti*": 7.0})
    model = toxicity.ToxicityModel(None, weights)
    words = {b"vile": 2, b"grub": 1, b"grubby": 3, b"grubbier": 1, b"ox": 1, b"oxen": 1, b"nastier": 1, b"nasty": 5, b"vil": 1}
    assert model.total(words) == 2 * 5.0 + 4.5 + 3 * 6.0 + 6.0 + 4.25 + 7.0
    weights.asked = 0
    assert model.total({f"word{i}".encode(): 1 for i in range(1000)}) == 0.0
    assert weights.asked == 0  # before, up to four for each word


def test_family_meets_apart_from_a_larger_one_that_has_all_hubs(spark):
    large, small = range(64), range(100, 140)
    rows = [(i, 500, [1000 + j if j == i % 32 else j for j in range(32)]) for i in large] + [(i, 500, [1000 + j for j in range(32)]) for i in small]
    edges, left = minhash.star_edges(spark.createDataFrame(rows, "doc_id bigint, n_shingles bigint, bands array<bigint>"), 85)
    got = [(r["a"], r["b"]) for r in edges.collect()]
    assert {x for a, b in got if min(a, b) >= 100 for x in (a, b)} == set(small)  # before, none of 780 pairs was met by a hub
    assert {r["bucket"] for r in left.collect()} == {*range(32), *range(1000, 1032)}


def test_pair_comes_once_however_many_rare_shingles_it_has_in_common(spark):
    place = {1: list(range(20)), 2: list(range(5, 25)), 3: list(range(18, 30))}
    rows = [(d, d, 400, s, at, True, 9, order[:at], [0] * minhash.MARKS) for d, order in place.items() for at, s in enumerate(order)]
    schema = "doc_id bigint, component bigint, n int, shingle bigint, place int, indexed boolean, most bigint, earlier array<bigint>, marks array<bigint>"
    got = sorted((r["a"], r["b"]) for r in minhash.listed_pairs(spark.createDataFrame(rows, schema), 85).collect())
    assert sorted(set(got)) == [(2, 1), (3, 1), (3, 2)] and len(got) == 6  # sets of equal size meet in both orders


def test_recurring_chunks_are_learned_once_though_too_many_are_remembered(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    own, learned = packing.ChunkIds(tokenizer_file("word_bpe_49k.json")), []
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda chunks: learned.extend(chunks) or learn(chunks))
    texts = [[b"the of " + b" ".join(b"w%dx%d" % (i, j) for j in range(20)) + b" the", b"of it"] for i in range(8)]
    for part in texts:
        want = [np.array(own.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32).tobytes() for t in part]
        assert list(own.encode(part)) == want
        assert len(own.known) <= 40 + 24
    assert learned.count(b"the") == learned.count(b"of") == 1
