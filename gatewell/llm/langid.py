"""Language identification by prediction by partial matching (PPM).

A byte context tree of bounded depth is grown for each language from a bounded labelled sample. Its statistics
are then frozen: in context s, symbol x costs -log2(c(s,x) / (n(s) + q(s))) bits if x was seen there, else the
escape -log2(q(s) / (n(s) + q(s))) plus the cost in the next shorter context; below order 0 every byte costs
8 bits. n counts the visits of s and q its distinct symbols (escape method C). A text gets the language whose
tree codes it in the fewest bits; the code length is a sum over all bytes of the whole text.

Since statistics are frozen, a language's cost of each (deepest context, symbol) is tabulated once, and a text is
scored by a few table lookups a byte and language in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.llm import common

UNDETERMINED = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
END = 0xFF  # never occurs in UTF-8; stands between texts
BLOCK = 1 << 18  # bytes scored at once, which bounds the temporaries


@dataclass
class Tree:
    """A language's frozen context tree, as tables."""

    child: np.ndarray  # (node, symbol class of the byte before the context) -> longer context, or the dead end
    cost: np.ndarray  # (node, symbol class) -> bits


@dataclass
class Model:
    langs: list[str]
    classes: np.ndarray  # byte -> symbol class
    trees: list[Tree]
    depth: int

    @property
    def width(self) -> int:
        return int(self.classes.max()) + 1

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) < BLOCK):
                size += len(texts[upto]) + 1
                upto += 1
            out[at:upto] = self._block(texts[at:upto])
            at = upto
        return out

    def _block(self, texts: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", np.uint8)
        ends = np.flatnonzero(data == END)
        totals = np.zeros((len(texts), len(self.langs)))
        width, edge = self.width, np.int32(self.classes[END])
        for lo in range(0, len(data), BLOCK):  # a single long text is scored piecewise, with its left context
            hi = min(len(data), lo + BLOCK)
            back = min(lo, self.depth)
            symbol = np.concatenate([np.full(self.depth - back, edge), self.classes[data[lo - back : hi]]])
            here = symbol[self.depth :]
            text_of = np.searchsorted(ends, np.arange(lo, hi), side="right") - 1
            starts = np.flatnonzero(np.diff(text_of, prepend=-2))
            inside = (text_of[starts] >= 0) & (text_of[starts] < len(texts))
            for lang, tree in enumerate(self.trees):
                dead = len(tree.child) // width - 1
                node = walk = np.zeros(hi - lo, np.int32)
                for d in range(1, self.depth + 1):
                    walk = tree.child[walk * width + symbol[self.depth - d : len(symbol) - d]]
                    node = np.where(walk != dead, walk, node)
                sums = np.add.reduceat(tree.cost[node * width + here], starts, dtype=np.float64)
                np.add.at(totals[:, lang], text_of[starts][inside], sums[inside])
        return totals


def train(samples: list[tuple[str, str]], depth: int = 3, max_nodes: int = 4_000) -> Model:
    """Grow and freeze a tree for each language. samples: (language, text). A tree keeps its max_nodes most visited
    contexts, so what a language has does not depend on the others, and the model grows in proportion to their number."""
    langs = sorted({lang for lang, _ in samples})
    by_lang = [[t.encode("utf-8", "replace") for lang, t in samples if lang == x] for x in langs]
    seen = sorted({b for texts in by_lang for t in texts for b in set(t)})
    classes = np.zeros(256, np.int32)  # class 0: bytes never seen
    for k, b in enumerate(seen):
        classes[b] = k + 1
    classes[END] = len(seen) + 1
    return Model(langs, classes, [_tree(texts, classes, depth, max_nodes) for texts in by_lang], depth)


def _tree(texts: list[bytes], classes: np.ndarray, depth: int, max_nodes: int) -> Tree:
    width = int(classes.max()) + 1
    symbol = classes[np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", np.uint8)].astype(np.int64)
    # a context of order k is packed as its k classes, the newest lowest; counts: packed (context, symbol) -> count
    grown: dict[tuple[int, int], list[tuple[int, int]]] = {}
    key, ok = symbol.copy(), symbol != classes[END]
    for order in range(depth + 1):
        if order:
            before = np.concatenate([np.full(order, classes[END]), symbol[:-order]])
            ok = ok & (before != classes[END])
            key = key + before * width**order
        for packed, n in zip(*(x.tolist() for x in np.unique(key[ok], return_counts=True)), strict=True):
            grown.setdefault((order, packed // width), []).append((packed % width, n))
    visits = {s: sum(n for _, n in symbols) for s, symbols in grown.items()}
    # the empty context first, and each context after its suffix, which is visited at least as often
    chosen = sorted(sorted(visits, key=lambda s: (-visits[s], s))[:max_nodes] or [(0, 0)])
    index = {s: k for k, s in enumerate(chosen)}
    child = np.full((len(chosen) + 1, width), len(chosen), np.int32)
    cost = np.full((len(chosen), width), 8.0, np.float32)
    for s, k in index.items():
        order, context = s
        if order:
            oldest, suffix = divmod(context, width ** (order - 1))
            parent = index.get((order - 1, suffix), 0)
            child[parent, oldest] = k
            cost[k] = cost[parent]
        if symbols := grown.get(s):
            total, distinct = visits[s], len(symbols)
            cost[k] -= np.log2(distinct / (total + distinct))
            for x, n in symbols:
                cost[k, x] = -np.log2(n / (total + distinct))
    cost[:, classes[END]] = 0
    return Tree(child.ravel(), cost.ravel())


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, posterior of it under equal priors, and bits a byte. `und` and 0 for null texts and texts without a letter."""
    live = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.langs else []
    raw = [texts[k].encode("utf-8", "replace") for k in live]
    langs, scores, rates = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    bits = model.bits(raw)
    for k, t, b in zip(live, raw, bits, strict=True):
        best = int(b.argmin())
        langs[k] = model.langs[best]
        scores[k] = float(1 / np.exp2(np.clip(b[best] - b, -1000, 0)).sum())
        rates[k] = float(b[best] / len(t))
    return langs, scores, rates


def training_sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 200, max_chars: int = 20_000) -> list[tuple[str, str]]:
    """At most per_lang whole texts of each language, none longer than max_chars: the bound of what training sees."""
    fit = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.length("text").between(1, max_chars))
    return sorted((r["lang"], r["text"]) for r in common.sample_by_label(fit, "lang", ["id", "text"], per_lang))


def predictor(model: Model, spark):
    """A column function text -> struct(lang_pred, score, bits)."""
    shared = common.broadcast(spark, model)

    @F.arrow_udf(RESULT)
    def identify(texts: pa.Array) -> pa.Array:
        langs, scores, rates = predict_texts(shared.value, texts.to_pylist())
        common.tidy()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], ["lang_pred", "score", "bits"])

    return identify


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column `out` (lang_pred, score, bits per byte); a column of that name is replaced.

    Every row is kept, repeated rows included. Null texts and texts without a letter get `und` with score 0; an
    empty table gives an empty result; with nothing to learn from, every row is `und`. Of languages that code a text
    in equally few bits the first by name is given. Long texts are coded whole, a stretch at a time.
    """
    found: Column = predictor(model, docs.sparkSession)(F.col(text_col))
    return docs.withColumn(out, found)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, hold: int = 2) -> Model:
    """Train on rows outside the held-out fold."""
    return train(training_sample(docs.filter(~common.held_out(id_col, modulus, hold)), id_col, text_col, lang_col))
