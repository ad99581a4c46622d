"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose joint piece is in the vocabulary, ordered by the piece's
score. The best pair, the leftmost of equals, is merged; its new neighbours join the agenda. Symbols that stay unknown
are spelt in byte pieces.

Texts are first cut where no piece of the vocabulary spans the two adjacent characters: no merge crosses such a cut,
so parts have agendas of their own. The distinct short parts of a batch of texts are merged side by side in numpy, each
a row of symbols and a row of pair scores, one best pair of every row at a time; long parts use a heap. A part that is new
to a worker is checked against the sentencepiece library, batch by batch, and decoding is the library's.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.llm import common

SPACE = "▁"
LATIN = 0x250  # below, pairs of characters are looked up in a table; above, in a sorted list
ROW = 24  # characters of the longest part that is merged in numpy
REMEMBERED = 1_000_000  # distinct parts whose ids a worker remembers; about 40 MB
BATCH_CHARS = 500_000  # of texts encoded at once, which bounds the temporaries
END = "￿"  # not a character of any vocabulary; stands between texts


class Codec:
    """A merge-type vocabulary with identity normalization, white space escaped and a leading space added."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        ordinary = [k for k in range(len(pieces)) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        self.ids = {pieces[k]: k for k in ordinary}
        self.score = {pieces[k]: sp.get_score(k) for k in ordinary}
        self.bytes = {int(pieces[k][3:5], 16): k for k in range(len(pieces)) if sp.is_byte(k)}
        self.unknown = sp.unk_id()
        self.text_of = [str(k) for k in range(len(pieces))]
        spans = {(ord(a), ord(b)) for p in self.score for a, b in pairwise(p)}
        self.wide = np.array(sorted((a << 32) | b for a, b in spans if max(a, b) >= LATIN) or [-1], np.int64)
        self.narrow = np.zeros((LATIN, LATIN), bool)
        for a, b in spans:
            if max(a, b) < LATIN:
                self.narrow[a, b] = True
        self.single = np.full(0x110000, -1, np.int32)
        for p, k in self.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = k
        self.base = len(pieces)
        pairs = {self.ids[p[:k]] * self.base + self.ids[p[k:]]: p for p in self.score for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_ids = np.array([self.ids[pairs[k]] for k in sorted(pairs)] or [0], np.int32)
        self.pair_scores = np.array([self.score[pairs[k]] for k in sorted(pairs)] or [0], np.float32)
        self.feed = sp.encode("\n", add_bos=False, add_eos=False)  # what the library has before a part that follows a line feed
        self.known, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # parts seen before, by key
        self.first, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.line_cuts = not any("\n" in p for p in self.score)

    def cut_after(self, points: np.ndarray) -> np.ndarray:
        """Of code points, whether a cut follows each but the last."""
        a, b = points[:-1], points[1:]
        high = (a >= LATIN) | (b >= LATIN)
        joined = self.narrow[np.where(high, 0, a), np.where(high, 0, b)]
        at = np.flatnonzero(high)
        keys = (a[at].astype(np.int64) << 32) | b[at]
        joined[at] = self.wide[np.minimum(np.searchsorted(self.wide, keys), len(self.wide) - 1)] == keys
        return ~joined

    def part(self, text: str) -> list[int]:
        """Encode one part by a heap of pairs."""
        score = self.score
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(-score[p], k, p) for k in range(n - 1) if (p := text[k : k + 2]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, left, piece = heapq.heappop(agenda)
            if symbols[left] is None or (right := after[left]) >= n or symbols[left] + symbols[right] != piece:
                continue  # a symbol of the pair has been merged meanwhile
            symbols[left], symbols[right] = piece, None
            after[left] = end = after[right]
            if end < n:
                before[end] = left
                if (p := piece + symbols[end]) in score:
                    heapq.heappush(agenda, (-score[p], left, p))
            if (start := before[left]) >= 0 and (p := symbols[start] + piece) in score:
                heapq.heappush(agenda, (-score[p], start, p))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if (k := self.ids.get(s)) is not None:
                    out.append(k)
                elif self.bytes:
                    out += [self.bytes[b] for b in s.encode("utf-8", "replace")]
                else:
                    out.append(self.unknown)
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score (minus infinity: no such piece) and id of joint pieces; symbols below 0 are none."""
        keys = np.where((a < 0) | (b < 0), -2, a.astype(np.int64) * self.base + b)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = self.pair_keys[at] == keys
        return np.where(known, self.pair_scores[at], -np.inf).astype(np.float32), np.where(known, self.pair_ids[at], -1)

    def rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merge each row of symbols (padded by -1) to the end, best pair first."""
        done = np.full_like(symbols, -1)
        where = np.arange(len(symbols))
        score, joint = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(where):
            best = score.argmax(axis=1)
            rows = np.arange(len(where))
            open_ = score[rows, best] > -np.inf
            done[where[~open_], : symbols.shape[1]] = symbols[~open_]
            symbols, score, joint, best, where = symbols[open_], score[open_], joint[open_], best[open_], where[open_]
            if not len(where):
                break
            rows = np.arange(len(where))
            merged = joint[rows, best]
            column = np.arange(symbols.shape[1])[None, :]
            moved = np.concatenate([symbols[:, 1:], np.full((len(where), 1), -1, symbols.dtype)], axis=1)
            symbols = np.where(column <= best[:, None], symbols, moved)
            symbols[rows, best] = merged
            later = column[:, :-1] >= best[:, None]
            score = np.where(later, np.concatenate([score[:, 1:], np.full((len(where), 1), -np.inf, score.dtype)], axis=1), score)
            joint = np.where(later, np.concatenate([joint[:, 1:], np.full((len(where), 1), -1, joint.dtype)], axis=1), joint)
            follows = best + 1 < symbols.shape[1]
            score[rows[follows], best[follows]], joint[rows[follows], best[follows]] = self._pairs(merged[follows], symbols[rows[follows], best[follows] + 1])
            leads = best > 0
            score[rows[leads], best[leads] - 1], joint[rows[leads], best[leads] - 1] = self._pairs(symbols[rows[leads], best[leads] - 1], merged[leads])
            if (width := int((symbols >= 0).sum(axis=1).max())) + 1 < symbols.shape[1]:
                symbols, score, joint = symbols[:, : width + 1], score[:, :width], joint[:, :width]
        return done

    def distinct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut joined texts. Where parts start; first place and length, and key, of each distinct form; each part's form; code points."""
        points = np.frombuffer((END.join(texts) + END).encode("utf-32-le", "replace"), np.uint32)
        starts = np.concatenate([[0], np.flatnonzero(self.cut_after(points)) + 1])
        lengths = np.diff(np.append(starts, len(points)))
        mixed = (points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        place = np.arange(len(points)) - np.repeat(starts, lengths)
        step = np.cumprod(np.full(int(lengths.max()), 0x94D049BB133111EB, np.uint64))
        keys = np.add.reduceat(mixed * step[place], starts)
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + lengths.astype(np.uint64)
        forms, first, form = np.unique(keys, return_index=True, return_inverse=True)
        source = np.repeat(starts[first][form], lengths) + place
        if not (lengths == lengths[first][form]).all() or not (points[source] == points).all():
            raise ValueError("two parts have the same 64-bit key")
        return starts, np.stack([starts[first], lengths[first]]), forms, form, points

    def encode(self, texts: list[str | None], check: bool = True) -> list[list[int]]:
        """Ids of each text; null counts as empty."""
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size < BATCH_CHARS):
                size += len(texts[upto] or "")
                upto += 1
            out += self._encode(texts[at:upto], check)
            at = upto
        return out

    def _encode(self, texts: list[str | None], check: bool) -> list[list[int]]:
        odd = {k for k, t in enumerate(texts) if t and END in t}
        whole = [(SPACE + t.replace(" ", SPACE)) if t and k not in odd else "" for k, t in enumerate(texts)]
        starts, (heads, sizes), forms, form, points = self.distinct(whole)
        joined = points.tobytes().decode("utf-32-le")
        at = np.minimum(np.searchsorted(self.known, forms), max(0, len(self.known) - 1))
        fresh = np.flatnonzero(self.known[at] != forms) if len(self.known) else np.arange(len(forms))
        counts, flat = self._forms(joined, points, heads[fresh], sizes[fresh])
        if check:
            first = np.cumsum(counts) - counts
            self.check([joined[h : h + n] for h, n in zip(heads[fresh].tolist(), sizes[fresh].tolist(), strict=True)], flat.tolist(), first.tolist(), counts.tolist())
        if len(self.known) + len(fresh) > REMEMBERED:  # forget all but what this batch uses
            old = np.unique(np.delete(at, fresh))
            self.flat = self.flat[np.repeat(self.first[old], self.counts[old]) + _ramp(self.counts[old])]
            self.known, self.counts = self.known[old], self.counts[old]
            self.first = np.cumsum(self.counts) - self.counts
        into = np.searchsorted(self.known, forms[fresh])  # both are sorted
        self.first, self.counts = np.insert(self.first, into, len(self.flat) + np.cumsum(counts) - counts), np.insert(self.counts, into, counts)
        self.known, self.flat = np.insert(self.known, into, forms[fresh]), np.concatenate([self.flat, flat])
        at = np.searchsorted(self.known, forms)
        first, counts, flat = self.first[at], self.counts[at], self.flat
        each = counts[form]
        ids = flat[np.repeat(first[form], each) + _ramp(each)].tolist()
        ends = np.flatnonzero(points[starts] == ord(END))
        stops = np.cumsum(each)[ends].tolist()
        out = [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        for k in odd:
            out[k] = self.part(SPACE + texts[k].replace(" ", SPACE))
        return out

    def _forms(self, joined: str, points: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each distinct part has, and all ids in a row."""
        counts = np.zeros(len(heads), np.int64)
        done = np.zeros(len(heads), bool)
        merged: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in pairwise((1, 4, 6, 8, 11, 16, ROW)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            inside = np.arange(high)[None, :] < sizes[chosen][:, None]
            table = np.full((len(chosen), high), -1, np.int32)
            table[inside] = self.single[points[(heads[chosen][:, None] + np.arange(high)[None, :])[inside]]]
            spelt = ((table >= 0) == inside).all(axis=1)  # of pieces only; other parts go the long way
            table = self.rows(table[spelt])
            done[chosen[spelt]] = True
            counts[chosen[spelt]] = (table >= 0).sum(axis=1)
            merged.append((chosen[spelt], table[table >= 0]))
        found = {k: self.part(text) for k in np.flatnonzero(~done).tolist() if (text := joined[heads[k] : heads[k] + sizes[k]]) != END}
        for k, ids in found.items():
            counts[k] = len(ids)
        first = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for chosen, ids in merged:
            flat[np.repeat(first[chosen], counts[chosen]) + _ramp(counts[chosen])] = ids
        for k, ids in found.items():
            flat[first[k] : first[k] + len(ids)] = ids
        return counts, flat

    def check(self, parts: list[str], flat: list[int], first: list[int], counts: list[int]) -> None:
        """Hold parts against the library, each after a line feed, with which nothing merges."""
        if not self.line_cuts:
            return
        asked = [k for k, p in enumerate(parts) if p not in ("\n", END)]
        for k, ids in zip(asked, self.library.encode(["\n" + parts[k].replace(SPACE, " ") for k in asked], num_threads=1), strict=True):
            if ids != self.feed + flat[first[k] : first[k] + counts[k]]:
                raise ValueError(f"the agenda and the library differ on {parts[k]!r}")

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... n - 1 for each n."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A worker's codec, loaded once and kept between tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


FIELDS = {"ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "n_tokens": (T.LongType(), pa.int64()), "ids_sha256": (T.StringType(), pa.string()), "decoded": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string())}
SUB_BATCH = 512  # texts held decoded at once


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", out: str = "encoded", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """docs with a struct column `out` of those of FIELDS that keep asks for.

    path names the model file on every executor; a model that this codec does not read as the library does fails its
    checks. Null texts count as empty: no ids and an empty decoding. Rows are kept as they come, repeated ones too, and
    an empty table stays empty; a column of the name `out` is replaced. Of pairs with one score the leftmost is merged
    first. Long texts are encoded whole, part by part, in memory in proportion to their length.
    """
    common.ship(docs.sparkSession)

    @F.arrow_udf(T.StructType([T.StructField(k, FIELDS[k][0]) for k in keep]))
    def encoded(texts: pa.Array) -> pa.Array:
        own = codec(path)
        chunks: dict[str, list[pa.Array]] = {k: [] for k in keep}
        for at in range(0, max(1, len(texts)), SUB_BATCH):
            ids = own.encode(texts.slice(at, SUB_BATCH).to_pylist())
            decoded = own.decode(ids) if {"decoded", "decoded_sha256"} & {*keep} else []
            made = {"ids": lambda: ids, "n_tokens": lambda: list(map(len, ids)), "ids_sha256": lambda: [_sha(",".join([own.text_of[x] for x in row])) for row in ids], "decoded": lambda: decoded, "decoded_sha256": lambda: list(map(_sha, decoded))}
            for k in keep:
                chunks[k].append(pa.array(made[k](), FIELDS[k][1]))
        common.tidy()
        return pa.StructArray.from_arrays([pa.concat_arrays(chunks[k]) for k in keep], list(keep))

    return docs.withColumn(out, encoded(F.col(text_col)))
