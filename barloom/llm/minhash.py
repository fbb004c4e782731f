"""Near-duplicate documents by one-permutation hashing with optimal densification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import CHUNK, as_bytes, by_arrow, chunks, cut_text, dropped, mixed, word_hashes, written

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Bins that two documents must share before their whole sets are compared. At a similarity
#: of 0.8 the share of equal bins has a deviation of 0.035, so this is over eight of them below.
LEAST_BINS = 0.50
#: Edges of one document that may meet under one key.
SPREAD = 128
#: 64-bit words of a set's marks: bit i tells whether an odd number of its shingles fall on i.
MARKS = 8
#: Runs of this many bands are buckets too, so that texts much alike also meet apart from a larger family less like them.
RUNS = (2, 4, 8)
#: Earlier shingles of its own document that a row of the rare-shingle join knows.
EARLIER = 32

_STEP = np.random.default_rng(7).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)
#: For each bin the order in which it looks for a bin to borrow from: its own random permutation of all bins.
_PROBES = np.stack([np.random.default_rng(1000 + k).permutation(BINS) for k in range(BINS)])
_PLACE = mixed(np.arange(1, BINS + 1, dtype=np.uint64))


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; fewer than k words make one shingle, none an empty set."""
    for _, part in chunks([t.lower() for t in texts]):
        if len(part[0]) > CHUNK:  # then it is alone
            words = np.concatenate([word_hashes([p])[0] for p in cut_text(part[0])])
            at = np.array([0, len(words)])
        else:
            words, at = word_hashes(part)
        for i in range(len(part)):
            w = words[at[i] : at[i + 1]]
            n = len(w)
            if n == 0:
                yield w
                continue
            m = max(1, n - k + 1)
            h = np.full(m, min(n, k), np.uint64)
            for j in range(min(n, k)):
                h = mixed(h * _STEP[1] + w[j : j + m] * _STEP[0] + np.uint64(j + 1))
            yield np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One minimum for each of the BINS ranges of the hash space; an empty bin copies the first filled one of its probes."""
    out = np.zeros((len(sets), BINS), np.uint64)
    edges = (np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        if len(s):
            first = np.searchsorted(s, edges)
            has = np.append(first[1:], len(s)) > first
            full[i] = has
            out[i, has] = s[first[has]]
    for at in range(0, len(sets), 256):
        rows = np.flatnonzero(full[at : at + 256].any(1) & ~full[at : at + 256].all(1)) + at
        if len(rows):
            first = full[rows][:, _PROBES].argmax(2)
            source = _PROBES[np.arange(BINS), first]
            out[rows] = np.take_along_axis(out[rows], source, 1)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        h = mixed(h * _STEP[2] + sig[:, r::ROWS])
    return mixed(h + _PLACE[:BANDS])


def _sketched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(as_bytes(batch, "text"), k))
            sig = signatures(sets)
            bands = band_hashes(sig).view(np.int64)
            small = (mixed(sig) & np.uint64(255)).astype(np.uint8)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([x if f else None for x, f in zip(bands, full)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if f else None for x, f in zip(small, full)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return run


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document: set size, digest of the whole set, band hashes, one byte of each bin."""
    return by_arrow(docs.select("doc_id", "text"), _sketched(k), "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary")


def marks(s: np.ndarray) -> np.ndarray:
    """A set's marks. Those of two sets differ in no more bits than the sets do in shingles, as what they share cancels out."""
    at = (mixed(s.view(np.uint64)) % np.uint64(64 * MARKS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * MARKS) & 1).astype(np.uint8)).view(np.int64)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(as_bytes(batch, "text"), k)]
            columns = [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64())), pa.array([marks(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shingles", "marks"])

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
            keep = (a == b).mean(1) >= LEAST_BINS
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def star_edges(reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(edges, buckets): candidate pairs (a > b), in each bucket every member with up to two hubs; and the band buckets' rows.

    Buckets are those of the bands and of runs of bands: where the hubs of all of a family's band buckets are of another
    family, which shares some bands with each of its members, the longer runs still bring the family together.
    The hubs are the member that shares most buckets in all and the smallest id, so that a bucket of m members gives at
    most 2(m-1) pairs, and a family's buckets mostly the same ones. The popular hub is the text that a family was copied from.
    What pairs of non-hubs in a band bucket are left is for rare_shingle_edges(), by (bucket, doc_id).
    """
    runs = F.array(*(F.xxhash64(F.slice("bands", j * w + 1, w), F.lit(w * BANDS + j)) for w in RUNS for j in range(BANDS // w)))
    rows = reps.select(F.posexplode(F.concat("bands", runs)).alias("band", "bucket"), "doc_id", F.col("n_shingles").alias("n"))
    rows = rows.select("bucket", "doc_id", "n", (F.col("band") < BANDS).alias("single"))
    # small sides are written first: a join of two plain exchanges is one whose hot keys Spark can split
    shared = written(rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    rows = written(rows.join(shared, "bucket"), "buckets")
    fame = rows.groupBy("doc_id").agg(F.sum(F.when(F.col("single"), F.col("members")).otherwise(0)).alias("fame"))
    hub = lambda order: F.max_by(F.struct(F.col("doc_id").alias("hub"), F.col("n").alias("hub_n")), order)
    hubs = (
        rows.join(fame, "doc_id")
        .groupBy("bucket")
        .agg(hub(F.struct("fame", -F.col("doc_id"))).alias("x"), hub(-F.col("doc_id")).alias("y"))
        .select("bucket", F.array_distinct(F.array("x", "y")).alias("all"))
        .select("bucket", F.size("all").alias("hubs"), F.explode("all").alias("h"))
        .select("bucket", "hubs", "h.hub", "h.hub_n")
    )
    hubs = written(hubs, "hubs")
    near = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    edges = (
        rows.join(hubs, "bucket")
        .where((F.col("doc_id") != F.col("hub")) & near)
        .select(F.greatest("doc_id", "hub").alias("a"), F.least("doc_id", "hub").alias("b"))
        .distinct()
    )
    left = rows.join(hubs.select("bucket", "hubs").distinct(), "bucket").where("single and members > hubs + 1").select("bucket", "doc_id")
    return written(edges, "edges"), left


def rare_shingle_edges(left: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a > b) that hubs left over: an exact prefix-filter join on the rarest shingles of open buckets.

    A bucket is open if pairs of its members were not compared and its members are in more than one component.
    Shingles of these documents are ordered by rarity. If a pair is similar, a shingle of the larger set's first
    n - ceil(t n) + 1 is among the smaller set's first n - ceil(2 t n / (1 + t)) + 1, and no less than the overlap
    that is asked for remains from there, and their marks differ in no more bits than the sets may differ in shingles, so
    that a crowd of unlike texts with a rare shingle in common gives no rows. Pairs of one component are left out; as most lists of a common shingle
    are of one component, each list's most frequent one is never joined with itself.
    """
    member = left.join(roots, left.doc_id == roots.node, "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("component"))
    member = written(member, "members")
    open_ = written(member.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("bucket"), "open")
    asked = written(member.join(open_, "bucket").select("doc_id", "component").distinct(), "asked")
    own = sets.join(asked, "doc_id").select("doc_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    own = written(own, "shingles")
    common = written(own.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "common")
    n = F.col("n")
    probe = n - F.ceil(n * percent / 100) + 1
    index = n - F.ceil(n * (2 * percent) / (100 + percent)) + 1
    ranked = own.join(common, "shingle").groupBy("doc_id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    ranked = ranked.withColumn("unique", n - F.size("order")).where(F.col("unique") < probe)  # shingles of one document alone come first
    rows = ranked.select("doc_id", "component", "n", "unique", F.posexplode(F.slice("order", F.lit(1), (probe - F.col("unique")).cast("int"))).alias("at", "s"))
    rows = written(rows.select("doc_id", "component", "n", (F.col("unique") + F.col("at")).alias("place"), F.col("s.shingle").alias("shingle"), (F.col("unique") + F.col("at") < index).alias("indexed")), "prefixes")
    by_part = rows.groupBy("shingle", "component").agg(F.count("*").alias("k"))
    most = by_part.groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("shingle", "most")
    listed = rows.join(written(most, "lists"), "shingle").groupBy("doc_id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("place", "shingle", "indexed", "most"))).alias("order"))
    listed = listed.withColumn("first", F.slice("order.shingle", 1, EARLIER)).select("doc_id", "component", "n", "first", F.posexplode("order").alias("at", "s"))
    listed = listed.select("doc_id", "component", "n", "s.*", F.slice("first", F.lit(1), F.col("at")).alias("earlier"))
    return listed_pairs(written(listed.join(sets.select("doc_id", "marks"), "doc_id"), "listed"), percent).distinct()


def listed_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a > b) of rare_shingle_edges(), from its rows by document and shingle of a list.

    A pair meets at the first shingle that both have: bounds that hold at a later one hold there too, so that
    rows in whose earlier shingles the pair has met before are left out. A pair may come again only where it first meets
    after EARLIER listed shingles of one of the two.
    """
    side = lambda s: (F.col("doc_id").alias(s), *(F.col(c).alias(k + s) for c, k in (("component", "c"), ("n", "n"), ("place", "p"), ("marks", "b"), ("earlier", "e"))), (F.col("component") == F.col("most")).alias("m" + s))
    x, y = rows.select("shingle", *side("x")), rows.where("indexed").select("shingle", *side("y"))
    asked_for = F.ceil((F.col("nx") + F.col("ny")) * percent / (100 + percent))
    fits = (F.col("cx") != F.col("cy")) & ((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") != F.col("x")))) & (F.col("ny") * 100 >= F.col("nx") * percent)
    fits = fits & (F.col("nx") - F.col("px") >= asked_for) & (F.col("ny") - F.col("py") >= asked_for)
    apart = sum((F.bit_count(F.col("bx")[i].bitwiseXOR(F.col("by")[i])) for i in range(MARKS)), F.lit(0))
    fits = fits & (apart <= F.col("nx") + F.col("ny") - 2 * asked_for) & ~F.arrays_overlap("ex", "ey")
    pair = lambda p, q: p.join(q, "shingle").where(fits).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return pair(x, y.where("not my")).unionByName(pair(x.where("not mx"), y.where("my")))


def with_sides(edges: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """Edges (a, b) with value_a and value_b of their ends, from (doc_id, value).

    An end with many edges is a hub: its edges are dealt over salts and its value is copied to each of them, so that
    no key gathers more than SPREAD edges; the copies are fewer than the edges. Sides may come swapped.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("k")).where(F.col("k") > SPREAD)
    heavy = written(ends, "heavy")
    of = lambda s: heavy.select(F.col("doc_id").alias(s), F.col("k").alias(f"k{s}"))
    ka, kb = F.coalesce("ka", F.lit(1)), F.coalesce("kb", F.lit(1))
    turned = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.when(ka >= kb, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(ka >= kb, F.col("b")).otherwise(F.col("a")).alias("leaf"), F.ceil(F.greatest(ka, kb) / SPREAD).alias("parts")
    )
    turned = written(turned.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), F.col("parts")).alias("salt")), "turned")
    copied = side.join(heavy, "doc_id", "left").select(
        F.col("doc_id").alias("hub"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.coalesce("k", F.lit(1)) / SPREAD) - 1)).alias("salt"), F.col(value).alias(f"{value}_a")
    )
    needed = turned.select("hub", "salt").distinct()
    plain = side.select(F.col("doc_id").alias("leaf"), F.col(value).alias(f"{value}_b"))
    return turned.join(plain, "leaf").join(copied.join(needed, ["hub", "salt"], "left_semi"), ["hub", "salt"]).select(F.col("hub").alias("a"), F.col("leaf").alias("b"), f"{value}_a", f"{value}_b")


def confirmed(edges: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose whole sets are similar enough; sketches first rule out what is far below."""
    near = written(by_arrow(with_sides(edges, reps, "sketch"), _alike, "a bigint, b bigint"), "candidates")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    links = with_sides(near, sets, "shingles").where(both * 100 >= (F.size("shingles_a") + F.size("shingles_b") - both) * percent)
    return written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "confirmed")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links, root the smallest id reachable, by alternating large and small stars."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = written(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        both = sides.join(least, "u")
        if large:
            moved = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = both.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a != b").distinct()

    edges, seen = written(links.select("a", "b").where("a != b").distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        after = written(star(star(edges, True), False), "links")
        dropped(edges)
        edges, seen = after, state


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a document is the set of its distinct
    k-word shingles (one shingle if it has fewer words, none if it has no word). Documents whose sets
    have a Jaccard similarity of at least percent / 100 are linked; component_id is the smallest doc_id
    reachable and kept marks it. Equal sets are one class and travel as one representative; candidates
    come from BANDS buckets of ROWS densified minima each, as stars, and are confirmed on whole sets. What a
    bucket's hubs did not settle is settled by an exact join on rare shingles, so that a link is lost only if its
    documents meet in no bucket. Null or blank texts have an empty set and stay alone. Rows that repeat a doc_id
    are one node and give a row each. A null doc_id with words joins what its set equals; alone it has a null component.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_rows = written(sketches(docs, k), "sketches")
    classes = all_rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = all_rows.join(classes, (all_rows.set_key == classes.set_key) & (all_rows.doc_id == classes.rep), "left_semi").dropDuplicates(["doc_id", "set_key"])
    reps = written(reps.select("doc_id", "n_shingles", "bands", "sketch"), "reps")
    edges, left = star_edges(reps, percent)
    ids = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(left.select("doc_id")).distinct()
    whole = docs.join(written(ids, "ids").hint("shuffle_hash"), "doc_id", "left_semi")
    sets = written(by_arrow(whole, _sets(k), "doc_id bigint, shingles array<bigint>, marks array<bigint>"), "sets")
    links = confirmed(edges, reps, sets, percent)
    more = confirmed(written(rare_shingle_edges(left, connected(links), sets, percent), "more"), reps, sets, percent)
    roots = connected(links.unionByName(more))
    owner = classes.join(roots, classes.rep == roots.node, "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    owner = written(owner, "owners")
    return (
        all_rows.select("doc_id", "n_shingles", "set_key")
        .join(owner, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
