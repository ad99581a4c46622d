"""Benchmark decontamination on a distributed positional inverted index.

build() reads the training texts once and stores, for each shard of documents, the positions of every term as one sorted
list over the shard (documents are kept apart by a gap wider than any phrase). The index does not depend on the test side:
any number of benchmarks, in any number of blocks, are searched in it. Shards are independent, so a term that occurs
everywhere is spread over all of them and nothing is shuffled. Phrases are found in a shard by intersecting
offset-adjusted lists, from the phrase's rarest term on, where rarity is the term's frequency in the whole corpus. All
terms of a phrase are intersected, so matches are exact. With slop, each term may stand up to that many places off (a
proximity match).

Terms are kept by a 64-bit hash with their spelling, which is compared when a term is looked up. Only the test side is
broadcast, in blocks of at most BLOCK_WORDS words; a larger test side takes more passes over the same index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.llm import common

WINDOW = 13
GAP = 64  # places between documents; phrases with their slop must be shorter
SHARD_BYTES = 6_000_000  # text of a shard; a longer document is a shard of its own
BLOCK_WORDS = 1_000_000
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def folded(text: str | None) -> bytes:
    """A-Z in lower case; all but ASCII letters, digits and characters beyond ASCII as spaces; a space at the end."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD) + b" "


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z; words are runs of ASCII letters, digits and characters beyond ASCII."""
    return folded(text).split()


def windows(text_words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of size words; a shorter item is one window, an empty one none."""
    if not text_words:
        return []
    return [tuple(text_words[k : k + size]) for k in range(max(1, len(text_words) - size + 1))]


@dataclass
class Phrases:
    """A block of the test side: distinct phrases over a vocabulary, and the items each belongs to."""

    vocabulary: dict[bytes, int]
    phrases: list[tuple[int, ...]]
    items: list[list[str]]
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    spelt: list[bytes] = field(default_factory=list)

    def close(self) -> Phrases:
        self.spelt = list(self.vocabulary)
        self.hashes = common.hashed_words(b" ".join(self.spelt) + b" ")[0] if self.spelt else self.hashes
        return self

    @property
    def longest(self) -> int:
        return max(map(len, self.phrases), default=1)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The test side in blocks of bounded size, one on the driver at a time. Items with null ids can hit, but aren't listed."""
    block = Phrases({}, [], [])
    index: dict[tuple[int, ...], int] = {}
    used = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    for row in rows.toLocalIterator():
        item_words = words(row["text"])
        if used and used + len(item_words) > block_words:
            yield block.close()
            block, index, used = Phrases({}, [], []), {}, 0
        used += len(item_words)
        for window in windows(item_words, size):
            key = tuple(block.vocabulary.setdefault(w, len(block.vocabulary)) for w in window)
            if (at := index.setdefault(key, len(index))) == len(block.phrases):
                block.phrases.append(key)
                block.items.append([])
            if row["item"] is not None and row["item"] not in block.items[at]:
                block.items[at].append(row["item"])
    yield block.close()


def build(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The index: a row per shard with its terms, postings, document keys and lengths; every document is in one shard.

    terms: sorted 64-bit hashes; spelt: their words, with a space after each; counts and postings: 32-bit numbers, the
    postings as steps from one place of a term to the next.
    """
    fields = [T.StructField(f"key{k}", T.ArrayType(docs.schema[c].dataType)) for k, c in enumerate(keys)]
    schema = T.StructType([T.StructField("shard", T.StringType()), *fields, T.StructField("n_words", T.ArrayType(T.LongType())), *[T.StructField(n, T.BinaryType()) for n in ("terms", "spelt", "counts", "postings")]])
    types = [pa.list_(docs_type) for docs_type in _arrow_types(docs, keys)]
    common.ship(docs.sparkSession)

    def row(held: list[list], texts: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        hashes, starts, sizes = common.hashed_words(whole)
        document = np.searchsorted(np.cumsum([len(t) for t in texts]), starts, side="right")
        lengths = np.bincount(document, minlength=len(texts))
        at = np.arange(len(hashes)) + GAP * document
        order = np.argsort(hashes, kind="stable")
        hashes, listed = hashes[order], at[order]
        fresh = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        steps = np.diff(listed, prepend=0)
        steps[fresh] = listed[fresh]
        some = order[fresh]  # one place of each term, for its spelling
        size = sizes[some] + 1
        letters = data[np.repeat(starts[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        binaries = (hashes[fresh], letters, np.diff(np.append(fresh, len(hashes))).astype(np.int32), steps.astype(np.int32))
        columns = [pa.array([uuid.uuid4().hex]), *[pa.array([h], t) for h, t in zip(held, types, strict=True)], pa.array([lengths.tolist()], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in binaries]]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in keys]
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                for h, c in zip(held, columns, strict=True):
                    h.append(c[k])
                texts.append(folded(text.as_py()))
                size += len(texts[-1]) + 64
                if size >= SHARD_BYTES:
                    yield row(held, texts)
                    common.tidy()
                    held, texts, size = [[] for _ in keys], [], 0
        if texts:
            yield row(held, texts)

    return docs.select(*keys, text_col).mapInArrow(shards, schema)


def _arrow_types(df: DataFrame, names: list[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(df.schema[c].dataType) for c in names]


def lookup(block: Phrases, terms: bytes, spelt: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which terms of the block a shard has, and where in its list of terms."""
    own = np.frombuffer(terms, np.uint64)
    if not len(own) or not len(block.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(own, block.hashes), len(own) - 1)
    known = np.flatnonzero(own[at] == block.hashes)
    listed = spelt.split()
    known = known[[listed[at[k]] == block.spelt[k] for k in known.tolist()]] if len(known) else known
    return known, at[known]


def frequencies(index: DataFrame, block: Phrases) -> dict[int, int]:
    """Corpus frequency of each term of the block: at most as many rows as the block has terms."""
    shared = common.broadcast(index.sparkSession, block)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                known, at = lookup(shared.value, shard["terms"], shard["spelt"])
                counts = np.frombuffer(shard["counts"], np.int32)[at]
                yield pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array(counts, pa.int64())], ["term", "n"])

    pairs = index.select("terms", "spelt", "counts").mapInArrow(counted, "term int, n bigint")
    return {r[0]: r[1] for r in pairs.groupBy("term").agg(F.sum("n")).collect()}


def intersect(lists: list[tuple[int, np.ndarray]], slop: int = 0) -> np.ndarray:
    """Starts of a phrase, given (offset in the phrase, sorted positions) of its terms, rarest first."""
    offset, positions = lists[0]
    starts = positions - offset
    for offset, positions in lists[1:]:
        if not len(starts) or not len(positions):
            return starts[:0]
        want = starts + offset
        at = np.searchsorted(positions, want)
        near = np.abs(positions[np.minimum(at, len(positions) - 1)] - want)
        if slop:
            near = np.minimum(near, np.abs(positions[np.maximum(at - 1, 0)] - want))
        starts = starts[near <= slop]
    return starts


def search(index: DataFrame, block: Phrases, rarity: dict[int, int], keys: list[str], slop: int = 0) -> DataFrame:
    """A row per document: shard and place in it, its keys, n_words, the hit word spans (start, end; merged) and the items with a match."""
    if block.longest + 2 * slop >= GAP:
        raise ValueError("phrases must be shorter than the gap between documents")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField(f"key{k}", index.schema[f"key{k}"].dataType.elementType) for k in range(len(keys))]
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("place", T.LongType()), *fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))])
    types = [pa.string(), pa.int64(), *[t.value_type for t in _arrow_types(index, [f"key{k}" for k in range(len(keys))])]]
    types += [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
    plans: dict[int, list[int]] = {}
    ordered = [sorted(range(len(p)), key=lambda k: (rarity.get(p[k], 0), p[k], k)) for p in block.phrases]
    for n, p in enumerate(block.phrases):
        plans.setdefault(p[ordered[n][0]], []).append(n)
    shared = common.broadcast(index.sparkSession, (block, ordered, plans))

    def matches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, order_of, by_rarest = shared.value
        for batch in batches:
            for shard in batch.to_pylist():
                n = np.array(shard["n_words"], np.int64)
                bases = np.cumsum(n + GAP) - (n + GAP)
                steps = np.frombuffer(shard["postings"], np.int32)
                counts = np.frombuffer(shard["counts"], np.int32).astype(np.int64)
                ends = np.cumsum(counts)
                first = {t: (int(ends[k] - counts[k]), int(ends[k])) for t, k in zip(*(x.tolist() for x in lookup(own, shard["terms"], shard["spelt"])), strict=True)}
                lists: dict[int, np.ndarray] = {}

                def positions(term: int) -> np.ndarray:
                    if term not in lists:
                        a, b = first[term]
                        lists[term] = np.cumsum(steps[a:b], dtype=np.int64)
                    return lists[term]

                edges = np.zeros(int((n + GAP).sum()) + 1, np.int32)
                found: list[set[str]] = [set() for _ in n]
                for term in first.keys() & by_rarest.keys():
                    for k in by_rarest[term]:
                        phrase = own.phrases[k]
                        starts = intersect([(o, positions(phrase[o])) for o in order_of[k]], slop) if all(t in first for t in phrase) else ()
                        if len(starts):
                            starts = np.maximum(starts, 0)
                            np.add.at(edges, starts, 1)
                            np.add.at(edges, np.minimum(starts + len(phrase), len(edges) - 1), -1)
                            for d in np.unique(np.searchsorted(bases, starts, side="right") - 1).tolist():
                                found[d].update(own.items[k])
                hit = np.cumsum(edges[:-1]) > 0
                turn = np.flatnonzero(np.diff(hit, prepend=False, append=False))
                spans: list[list[dict[str, int]]] = [[] for _ in n]
                for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                    d = int(np.searchsorted(bases, a, side="right")) - 1
                    spans[d].append({"start": a - int(bases[d]), "end": min(b - int(bases[d]), int(n[d]))})
                columns = [[shard["shard"]] * len(n), list(range(len(n))), *[shard[f"key{k}"] for k in range(len(keys))], shard["n_words"], spans, [sorted(f) for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)
                common.tidy()

    return index.mapInArrow(matches, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, keys: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int = 0) -> DataFrame:
    """A row per document: keys, n_words, n_hit, items (sorted as strings), contaminated (20 * n_hit >= n_words, n_hit > 0).

    Null texts have no words; documents repeated in the table are reported as often, whatever their ids; an empty benchmark
    hits nothing and an empty table stays empty. keys name the columns to carry, whatever their types; a key called like a
    column of the result gives way to it. Words hit by several windows count once. A long text costs memory in proportion
    to its words.
    """
    index = common.materialize(build(docs, keys, text_col), "postings")
    parts = [search(index, block, frequencies(index, block), keys, slop) for block in blocks(benchmark, item_col, item_text_col)]
    found = parts[0]
    if len(parts) > 1:  # a document's spans and items are united, by its place in the index
        for more in parts[1:]:
            found = found.unionByName(more)
        same = [F.first(c).alias(c) for c in [*[f"key{k}" for k in range(len(keys))], "n_words"]]
        found = found.groupBy("shard", "place").agg(*same, F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        inside = F.transform("hits", lambda s: F.sequence(s["start"], s["end"] - 1))
        n_hit = F.size(F.array_distinct(F.flatten(inside))).cast("long")
    else:
        n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.withColumn("n_hit", n_hit)
    own = ("n_words", "hits", "items", "n_hit", "contaminated")
    carried = [F.col(f"key{k}").alias(c) for k, c in enumerate(keys) if c not in own]
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select(*carried, "n_words", "hits", "items", "n_hit", contaminated.alias("contaminated"))
