"""MinHash near-duplicates by one-permutation hashing with optimal densification.

A document's set is its distinct word shingles. One 64-bit hash a shingle fills BINS bins with the least hash each; an
empty bin takes over the value of the first filled bin of a fixed random sequence of its own (optimal densification).
Bands of ROWS bins are bucket keys. At a similarity of 0.8 a pair shares none of the 36 buckets of 5 rows with a
probability of 6e-7.

Equal sets are first collapsed to their smallest id, so copies cost one row each. In every bucket a star of candidate
pairs joins one centre with the other members; the same order of precedence holds in all buckets, so a document meets
few centres. Pairs that a parity sketch of each set shows to differ too much go, none wrongly; links are confirmed on
the full sets of shingle hashes, the pairs of a centre dealt out in lots. Buckets whose members do not all hang
together then get further centres, one in each of sixteen times as many classes of ids each turn, from the largest
components first, until every bucket's members are in one component or have all been compared: no bucket is cut off,
and pairs are made of what the sketches leave, not of a bucket's square. A centre is an aggregate of its bucket, so
map sides combine; the joins by bucket are plain ones whose large partitions Spark splits.
Components are found by alternating stars, in tables on the shared folder, until at most FEW edges are left, which one
task joins up, or nothing changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.llm import common
from gatewell.llm.common import _G, _M1, _M2, mix

BANDS, ROWS = 36, 5
BINS = BANDS * ROWS
WORDS64 = 16  # of 64 bits in a parity sketch
SUB_BYTES, SUB_TEXTS = 500_000, 400  # text and texts hashed at once, which bound the temporaries
LOT = 512  # pairs of one centre that meet in a task
FEW = 1_000_000  # edges that one task joins up
SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("ka", T.LongType()), T.StructField("kb", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
_PROBES = np.random.default_rng(20240229).integers(0, BINS, (BINS, 4 * BINS))  # each empty bin's own sequence


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word (a run of bytes other than ASCII white space), A-Z in lower case."""
    hashes, starts, _ = common.hashed_words(b" ".join(texts).translate(_FOLD) + b" ")
    return hashes, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")


def shingle_sets(texts: list[str | None], words: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and how many each has. Fewer words are one shingle; none, none."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    hashes, owner = word_hashes(raw)
    n = np.bincount(owner, minlength=len(texts))
    span = np.maximum(n - words + 1, (n > 0).astype(np.int64))
    first = np.repeat(np.cumsum(n) - n, span) + np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
    of = np.repeat(np.arange(len(texts)), span)
    length = np.minimum(n, words)[of]
    value = length.astype(np.uint64) * _G
    for j in range(words):
        inside = length > j
        value[inside] = mix(value[inside] * _M2 + hashes[first[inside] + j])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[fresh], np.bincount(of[fresh], minlength=len(texts))


def densified(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation signatures (texts, bins) of sorted sets; every set must have a value."""
    owner = np.repeat(np.arange(len(counts)), counts)
    at = ((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # rises with the value: the first in a bin is its least
    first = np.ones(len(values), bool)
    first[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    signature = np.zeros((len(counts), bins), np.uint64)
    filled = np.zeros((len(counts), bins), bool)
    signature[owner[first], at[first]] = values[first]
    filled[owner[first], at[first]] = True
    who, which = np.nonzero(~filled)
    for t in range(_PROBES.shape[1]):
        if not len(who):
            break
        source = _PROBES[which, t]
        found = filled[who, source]
        signature[who[found], which[found]] = signature[who[found], source[found]]
        who, which = who[~found], which[~found]
    if len(who):  # as good as never: the first filled bin
        signature[who, which] = signature[who, filled[who].argmax(axis=1)]
    return signature


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G, (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        keys = mix(keys * _M1 + parts[:, :, r])
    return keys.view(np.int64)


def parity_bits(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Parity sketches (texts, WORDS64): every value of a set flips one bit.

    Two sketches differ in at most as many bits as their sets have values that are not in both, never in more.
    """
    bits = 64 * WORDS64
    owner = np.repeat(np.arange(len(counts)), counts)
    flips = np.bincount(owner * bits + (values & np.uint64(bits - 1)).astype(np.int64), minlength=len(counts) * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(counts), bits), axis=1).view(np.int64)


def _batches(texts: pa.Array):
    at = 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and len(held) < SUB_TEXTS and (not held or size < SUB_BYTES):
            held.append(texts[at].as_py())
            size += len(held[-1] or "")
            at += 1
        yield held


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def sketches(texts: pa.Array, words: int = 2) -> pa.Array:
    """SKETCH of every text: set size, a 128-bit key of the set, bucket keys (none for empty sets), parity sketch."""
    parts = []
    for held in _batches(texts):
        values, counts = shingle_sets(held, words)
        ends = np.cumsum(counts)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values + salt))]) for salt in (_G, _M1)]
        ka, kb = ((s[ends] - s[ends - counts]).view(np.int64) for s in sums)
        some = counts > 0
        bands = band_keys(densified(values, counts[some])) if some.any() else np.zeros((0, BANDS), np.int64)
        bits = parity_bits(values, counts)
        columns = [pa.array(counts.astype(np.int64)), pa.array(ka), pa.array(kb), _lists(some * BANDS, bands.ravel()), _lists(np.full(len(held), WORDS64), bits.ravel())]
        parts.append(pa.StructArray.from_arrays(columns, SKETCH.names))
    if not parts:
        return pa.array([], pa.struct([("n", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]))
    return pa.concat_arrays(parts)


def sketcher(spark, words: int = 2):
    """A column function text -> SKETCH."""
    common.ship(spark)

    @F.arrow_udf(SKETCH)
    def sketched(texts: pa.Array) -> pa.Array:
        out = sketches(texts, words)
        common.tidy()
        return out

    return sketched


def hashed_sets(spark, words: int = 2):
    """A column function text -> array<bigint>, the full set of shingle hashes."""
    common.ship(spark)

    @F.arrow_udf(T.ArrayType(T.LongType(), False))
    def whole(texts: pa.Array) -> pa.Array:
        parts, counts = [], []
        for held in _batches(texts):
            values, n = shingle_sets(held, words)
            parts.append(values.view(np.int64))
            counts.append(n)
        common.tidy()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    return whole


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """Those pairs (a, b) whose full sets are as similar as percent says.

    The pairs of a centre a are dealt out in lots of about LOT, and its set is sent to each lot, so the members of a
    centre that many resemble do not meet in one task.
    """
    pairs = common.materialize(pairs, "pairs")
    many = common.materialize(pairs.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > LOT).select("a", F.ceil(F.col("m") / LOT).alias("lots")), "lots")
    lots = F.coalesce("lots", F.lit(1).cast("long"))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), lots).alias("lot"))
    members = sets.select(F.col("id").alias("b"), F.col("set").alias("b_set"))
    centres = sets.select(F.col("id").alias("a"), F.col("set").alias("a_set")).join(many, "a", "left")
    centres = centres.select("a", "a_set", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1)).alias("lot"))
    joined = dealt.join(members, "b").join(centres, ["a", "lot"])
    both = F.size(F.array_intersect("a_set", "b_set"))
    return joined.select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set")).alias("sum")).filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("sum") - F.col("both"))).select("a", "b")


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0 to n - 1 reaches by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # roots hang on their smallest neighbour
        while not np.array_equal(further := root[root], root):
            root = further
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _joined_up(batches):
    """All edges (a, b), read in one task, as (node, component)."""
    held = list(batches)
    if held:
        edges = pa.Table.from_batches(held)
        ends = pa.chunked_array(edges["a"].chunks + edges["b"].chunks).combine_chunks()
        nodes = ends.unique()
        nodes = nodes.take(pc.sort_indices(nodes))
        at = pc.index_in(ends, nodes).to_numpy()
        root = smallest(at[: len(edges)], at[len(edges) :], len(nodes))
        yield from pa.table({"node": nodes, "component": nodes.take(pa.array(root))}).to_batches(max_chunksize=10_000)
    common.tidy()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), component being its smallest node.

    At most FEW edges are joined up in one task. Of more, large-star and small-star alternate, which only lessens them,
    until they are few or nothing changes. Each step groups by node for a minimum, which is pre-aggregated, and joins it
    back; nothing but a count and a checksum reaches the driver. Nodes other than integers and strings have stars alone.
    """
    common.ship(edges.sparkSession)
    edges = edges.filter("a <> b") if getattr(edges, "_scratch", None) else common.materialize(edges.filter("a <> b"), "edges")
    kind = edges.schema["a"].dataType
    joinable = kind in (T.LongType(), T.IntegerType(), T.StringType())
    joined_up = lambda few: few.coalesce(1).mapInArrow(_joined_up, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    if joinable and edges.count() <= FEW:
        return joined_up(edges)
    held = common.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        after = common.materialize(small, "edges")
        common.release(held)
        held = after
        now = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if joinable and now[0] <= FEW:
            return joined_up(held)
        if now == state:
            break
        state = now
    stars = held.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, percent: int = 80) -> DataFrame:
    """A row per row of docs: id, n_shingles, component_id (the smallest id reachable by links), kept.

    Rows with one id are one document with several texts; repeated rows are reported as often. Null and empty texts have
    an empty set and link with nothing. Rows with a null id stand alone: their component is null and they are kept. Equal
    sets tie for the smallest id. An empty table stays empty; other columns are left out, whatever their names. A long
    text costs memory in proportion to its words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = rows.select("id", sketcher(spark, words)(F.col("text")).alias("s")).select("id", "s.*")
    sk = common.materialize(sketched, "sketches")
    named = sk.filter("id is not null and n > 0")
    groups = common.materialize(named.groupBy("n", "ka", "kb").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "groups")
    links = _links(rows, groups, words, percent)
    ids = named.select("id", "n", "ka", "kb")
    repeated = ids.groupBy("id").agg(F.count("*").alias("m")).filter("m > 1").select("id")  # one id, several texts
    by_id = ids.join(repeated, "id").join(groups.select("n", "ka", "kb", "rep"), ["n", "ka", "kb"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = common.materialize(components(links.unionByName(by_id)), "components")
    common.release(links)
    where = groups.join(found, groups["rep"] == found["node"], "left").filter("copies > 1 or node is not null")
    where = where.select("n", "ka", "kb", F.coalesce("component", "rep").alias("component"))
    own = found.select(F.col("node").alias("id"), F.col("component").alias("own"))
    joined = sk.drop("bands", "bits").join(where, ["n", "ka", "kb"], "left").join(own, "id", "left")
    component = F.coalesce(F.least("own", "component"), "id")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(rows: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between representatives of equal sets, enough to connect whatever is linked."""
    spark = rows.sparkSession
    words64 = [f"w{k}" for k in range(WORDS64)]
    each = groups.select(F.col("rep").alias("id"), "n", "ka", F.explode("bands").alias("key"))
    own_bits = groups.select(F.col("rep").alias("id"), "ka", *[F.get("bits", F.lit(k)).alias(w) for k, w in enumerate(words64)])
    shared = each.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = each.join(shared, "key").join(own_bits, ["id", "ka"]).drop("ka")
    buckets = common.materialize(members.withColumns({"component": F.col("id"), "size": F.lit(1).cast("long")}), "buckets")
    texts = rows.join(buckets.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    # a filter on the sets here would be pushed below the join, and every text hashed once more for it
    sets = common.materialize(texts.select("id", hashed_sets(spark, words)(F.col("text")).alias("set")), "sets")
    classes = lambda k: F.pmod(F.xxhash64(F.lit("class"), "id"), F.lit(k))
    as_centre = {"a": F.col("id"), "a_n": F.col("n"), "a_component": F.col("component")} | {f"a_{w}": F.col(w) for w in words64}
    first = F.min(F.struct((-F.col("size")).alias("rank"), F.xxhash64("id").alias("order"), *[c.alias(n) for n, c in as_centre.items()]))
    links, centres_a_turn = None, 1
    while True:
        # of a bucket that has no more members all are centres, which needs no dealing out
        few = buckets.filter(F.col("m") <= centres_a_turn).select("key", *[c.alias(n) for n, c in as_centre.items()])
        many = buckets.filter(F.col("m") > centres_a_turn).groupBy("key", classes(centres_a_turn).alias("class")).agg(first.alias("c")).select("key", *[f"c.{n}" for n in as_centre])
        centres = common.materialize(few.unionByName(many), "centres")
        differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"a_{w}"))) for w in words64[1:]), F.bit_count(F.col("w0").bitwiseXOR(F.col("a_w0"))))
        alike = F.lit(100) * F.least("n", "a_n") >= F.lit(percent) * F.greatest("n", "a_n")
        # similar sets share all but (100 - percent) / (100 + percent) of their sizes' sum, which bounds the bits that differ
        near = F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("n") + F.col("a_n"))
        met = buckets.join(centres, "key").filter("id <> a and component <> a_component").filter(alike).filter(near)
        new = confirm(met.select("a", F.col("id").alias("b")).distinct(), sets, percent)
        after = common.materialize(new if links is None else links.unionByName(new), "links")
        common.release(links)
        links = after
        # what is left: buckets whose members, without the centres so far, are in several components
        found = common.materialize(components(links), "components")
        sizes = found.groupBy("component").agg(F.count("*").alias("size"))
        rest = buckets.select("key", "id", "n", *words64).join(centres.select("key", F.col("a").alias("id"), F.col("a_n").alias("n"), F.col("a_w0").alias("w0"), F.col("a_w1").alias("w1")), ["key", "id", "n", "w0", "w1"], "left_anti")
        known = found.join(sizes, "component").select(F.col("node").alias("id"), "component", "size")
        marked = rest.join(known, "id", "left").select("key", "id", "n", *words64, F.coalesce("component", "id").alias("component"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))
        marked = common.materialize(marked, "marked")
        several = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).filter("low <> high").select("key", "m")
        after = common.materialize(marked.join(several, "key"), "buckets")
        common.release(buckets, centres, found, marked)
        buckets = after
        if buckets.isEmpty():
            common.release(sets, buckets)
            return links
        centres_a_turn *= 16  # a centre of the largest component takes in a share of the rest, so what is left shrinks faster
