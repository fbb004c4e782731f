"""The pipeline's stages against brute force on the smallest tables."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from barloom.llm import mixing
from barloom.llm.common import written
from tests.llm.test_operators import brute_near, check_packing, reference_ids, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact", "near", "mix", "pack"]

    told = written(stages["language"](spark, docs, SF), "told")
    every = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in told.collect()}
    assert told.columns == columns and kept <= set(every) and len(kept) >= 0.99 * len(every)
    assert all(re.search(r"[^\W\d_]", every[i].text) for i in kept)

    once = written(stages["exact"](spark, told, SF), "once")
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", every[i].text), i)
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(first.values())

    apart = written(stages["near"](spark, once, SF), "apart")
    want = [r[0] for r in brute_near([(i, every[i].text) for i in first.values()], 5, 80) if r[3]]
    rows = apart.collect()
    assert apart.columns == columns and sorted(r.doc_id for r in rows) == sorted(want)

    mixed = written(stages["mix"](spark, apart, SF), "mixed")
    size = {r.doc_id: len(words(r.text)) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    of, taken = defaultdict(int), defaultdict(int)
    for i, s in source.items():
        of[s] += size[i]
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(names, mixing.targets([of[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
    copies = Counter(r.doc_id for r in mixed.collect())
    for i, n in copies.items():
        assert n <= 3
        taken[source[i]] += n * size[i]
    assert mixed.columns == columns
    assert all(abs(taken[s] - goal[s]) <= max(size[i] for i in source if source[i] == s) for s in names)

    pieces = stages["pack"](spark, mixed, SF).collect()
    assert check_packing(pieces, {i: reference_ids(every[i].text) for i in copies}, copies) < 0.03


def test_run_gives_the_same_rows(spark):
    a = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    b = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert a and a == b


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_rows_without_an_id_of_their_own(spark):
    stages = dict(corpus_pipeline.STAGES)
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [
        (1, text(1), "en", "a", 1), (2, text(2), "en", "a", 1), (2, text(1), "en", "a", 1), (2, text(3), "en", "b", 1), (None, text(4), "en", "a", 1),
        (None, text(4), "en", "b", 1), (None, text(5), "en", "b", 1), (None, text(2), "en", "a", 1), (3, text(3), "en", "a", 1), (3, text(3), "en", "a", 1), (-4, text(6), "en", "b", 1),
    ]
    docs = written(spark.createDataFrame(rows, DOCS), "rows")
    for name in ("exact", "near"):
        got = stages[name](spark, docs, SF)
        assert got.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
        assert sorted(t for _, t in got) == sorted(text(i) for i in range(1, 7)), name
        assert (1, text(1)) in got and (2, text(2)) in got and (None, text(4)) in got and (None, text(5)) in got, name
    # an id's rows are mixed apart: none above its limit of copies, no row lost
    sources = [(7, text(i), "en", "a", 1) for i in range(30)] + [(None, text(i), "en", "b", 1) for i in range(30, 60)] + [(i, text(i), "en", "c", 1) for i in range(60, 90)]
    docs = written(spark.createDataFrame(sources, DOCS), "sources")
    copies = Counter(stages["mix"](spark, docs, SF).select("doc_id", "text", "source").collect())
    taken = Counter()
    for r, n in copies.items():
        assert n <= 3
        taken[r.source] += 40 * n
    goal = dict(zip("abc", mixing.targets([1200] * 3, [5, 2, 1])))
    assert all(abs(taken[s] - goal[s]) <= 40 for s in "abc")
    # with no label nothing is learned, and only texts without a letter go
    names = ("copies", "copy", "shards", "places", "block", "bucket", "kept", "own_id", "size", "n", "rows", "first")
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide, SF).count() >= 5 and stage(spark, wide.limit(0), SF).count() == 0, name
        if name != "pack":
            assert stage(spark, wide, SF).columns == wide.columns, name
    # texts without words stay in the mix once, and take no words
    blank = spark.createDataFrame([(1, text(1), "en", "a", 1), (2, None, "en", "a", 1), (None, " ", "en", "a", 1)], DOCS)
    assert sorted(str(r.text) for r in stages["mix"](spark, written(blank, "blank"), SF).collect()) == sorted(["None", " ", text(1)])
    bare = spark.createDataFrame([(1, "some words", None, "a", 1), (None, "more words", None, "a", 1), (2, "123", None, "a", 1), (3, None, None, "a", 1)], DOCS)
    assert sorted(r.text for r in stages["language"](spark, bare, SF).collect()) == ["more words", "some words"]


def test_numbers_stay_with_their_rows(spark, tmp_path):
    """However a table is split when it is read again, a row without an id of its own keeps its number."""
    rows = [(None if i % 3 else i % 40, f"text {i}", "en", "a", i) for i in range(4000)]
    spark.createDataFrame(rows, DOCS).repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "4")
        numbers = corpus_pipeline.numbered(docs)
        seen = []
        for n in ("4", "16", "2"):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
            again = numbers.select("*").withColumn("k", F.lit(n)).drop("k")
            seen.append(sorted((r.n_chars, r[corpus_pipeline.ROW]) for r in again.collect()))
        assert seen[0] == seen[1] == seen[2] and len({r for _, r in seen[0]}) == len(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
