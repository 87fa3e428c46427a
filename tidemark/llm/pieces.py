"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of vocabulary pieces.  Forward Viterbi gives the best score from the start to each
place; a backward A-star search from the end, for which those scores are the exact remainder, then
yields segmentations in descending order of score.  No piece reaches across the start of a word or a
character that stands in no longer piece, so the lattice falls into independent chunks: each is
searched by itself (and remembered), and the best of the whole are merged from the chunks'.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest
from itertools import chain as chained
from itertools import product, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, ship

TOKENIZER_DIR = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 in a text while it is cut; no valid text contains it.
LITERAL = "\udc81"
#: Chunks that a process remembers; beyond, it starts anew.
REMEMBERED = 400_000
#: Chunks of up to so many characters are searched many together, longer ones singly.
SHORT = 32
#: So many short chunks at once: some 10 KB each while it lasts.
LEARNT = 2048
#: Texts are taken up together until they have so many characters.
TOGETHER = 1 << 20
OPENING = 4
_models: dict[tuple[str, int], PieceModel] = {}


@lru_cache(maxsize=4096)
def _picks(sizes: tuple[int, ...], nbest: int) -> list[list[tuple[int, int]]]:
    """The combinations that can be among the nbest: of those with more lesser picks than that, all come before."""
    every = product(*[range(n) for n in sizes])
    return [[(i, p) for i, p in enumerate(picks) if p] for picks in every if math.prod(p + 1 for p in picks) <= nbest]


class _Finder:
    """Finds which substrings of many short strings are pieces: a table by hash, and another for pieces whose place is taken."""

    def __init__(self, scores: dict[str, float], ids: dict[int, float]):
        order = list(scores)
        self.ids, self.scores = np.array([*ids, -1], np.int32), np.array([*scores.values(), -math.inf])
        self.longest = max(map(len, order), default=1)
        self.hashes = np.zeros(len(order) + 1, np.uint64)
        for n in {len(p) for p in order}:
            at = [i for i, p in enumerate(order) if len(p) == n]
            self.hashes[at] = self._all(codes([order[i] for i in at], n), n)[-1][:, 0]
        self.bits, self.salt, none = len(order).bit_length() + 5, 0, len(order)
        while True:  # until no two pieces want one place of the second table
            self.salt += 2
            places = self._place(self.hashes[:-1], 0)
            first = np.unique(places, return_index=True)[1]
            rest = np.setdiff1d(np.arange(none), first)
            others = self._place(self.hashes[rest], 1)
            if len(np.unique(others)) == len(rest):
                break
        self.tables = [np.full(1 << self.bits, none, np.int32) for _ in range(2)]
        self.tables[0][places[first]], self.tables[1][others] = first, rest

    def _place(self, h: np.ndarray, table: int) -> np.ndarray:
        odd = np.uint64((self.salt + table) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
        return (h * odd) >> np.uint64(64 - self.bits)

    @staticmethod
    def _all(points: np.ndarray, longest: int) -> list[np.ndarray]:
        """By length less 1: the hash of the substring of that length at each place."""
        out = [points.astype(np.uint64) + np.uint64(1)]
        for n in range(2, longest + 1):
            out.append((out[-1][:, :-1] * np.uint64(0xD6E8FEB86659FD93)) ^ (points[:, n - 1 :].astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
        return out

    def find(self, points: np.ndarray) -> list[np.ndarray]:
        """By length less 1: the ordinal of the piece at each place, or that of no piece."""
        none, out = len(self.hashes) - 1, []
        for h in self._all(points, min(self.longest, points.shape[1])):
            at = self.tables[0][self._place(h, 0)]
            missed = np.nonzero((self.hashes[at] != h) & (at != none))
            rest = h[missed]
            second = self.tables[1][self._place(rest, 1)]
            at[missed] = np.where(self.hashes[second] == rest, second, none)
            out.append(at)
        return out


def codes(strings: list[str], width: int) -> np.ndarray:
    """Code points by row, padded with 0."""
    return np.frombuffer("".join([s.ljust(width, "\0") for s in strings]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), width)


class PieceModel:
    """A vocabulary with the log-probability of each piece, from its rank: in proportion to 1 / (rank + 10).

    Bytes stand for characters that are no piece; each costs the rarest piece's log-probability less 1.
    """

    def __init__(self, pieces: list[str], kinds: list[str], nbest: int = 4):
        self.nbest = nbest
        self.raw: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        weights: dict[int, float] = {}
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == "byte":
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.raw.append(piece.replace(SPACE, " ").encode() if kind == "piece" else b"")
                if kind == "piece":
                    weights[i] = 1.0 / (len(weights) + 10)
        total = sum(weights.values())
        #: The score of each piece, and -inf for a piece's beginning that is no piece.
        self.scores: dict[str, float] = {pieces[i]: math.log(w / total) for i, w in weights.items()}
        self.finder = _Finder(self.scores, weights)
        self.ids: dict[str, int] = {pieces[i]: i for i in weights}
        self.longest = max(map(len, self.scores), default=1)
        self.byte_score = min(self.scores.values(), default=0.0) - 1.0
        joined = {c for p in self.scores if len(p) > 1 for c in p} - {SPACE}
        for piece in list(self.scores):
            for n in range(1, len(piece)):
                self.scores.setdefault(piece[:n], -math.inf)
        # letters and others are cut apart if no piece holds both side by side
        mixed = any(a.isalpha() != b.isalpha() and SPACE not in (a, b) for p in self.scores for a, b in zip(p, p[1:], strict=False))
        classes = [joined] if mixed else [{c for c in joined if c.isalpha()}, {c for c in joined if not c.isalpha()}]
        runs = ["".join(map(re.escape, sorted(c))) for c in classes if c]
        self.cut = re.compile("|".join([*[f"{SPACE}*[{r}]+" for r in runs], f"{SPACE}+", "."]), re.DOTALL).findall
        self.openings: dict[str, tuple[list[tuple[int, float]], bool]] = {}
        #: Where a chunk's best ids, their number and score, and what the second segmentation loses, stand in the lists.
        self.memory: dict[str, int] = {}
        self.best: list[bytes] = []
        self.size, self.score, self.loss = np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.passing: list[str] = []
        self.close: dict[str, list[tuple[float, bytes]]] = {}

    def spelt(self, c: str) -> bytes:
        """The bytes that stand for a character which is no piece."""
        return SPACE.encode() if c == LITERAL else c.encode("utf-8", "surrogatepass")

    def forward(self, chunk: str) -> tuple[list[float], list[float], list[int]]:
        """By place: the best score from the start, the best of those that come in by another last piece, and where the best one's last piece starts."""
        get, known, n, low = self.scores.get, self.openings.get, len(chunk), -math.inf
        best, other, back = [low] * (n + 1), [low] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            short, more = known(chunk[start : start + OPENING]) or self.opening(chunk[start : start + OPENING])
            for size, score in short:
                value, end = here + score, start + size
                if value > best[end]:
                    other[end], best[end], back[end] = best[end], value, start
                elif value > other[end]:
                    other[end] = value
            if more:
                end = start + OPENING + 1
                while end <= n and (score := get(chunk[start:end])) is not None:
                    value = here + score
                    if value > best[end]:
                        other[end], best[end], back[end] = best[end], value, start
                    elif value > other[end]:
                        other[end] = value
                    end += 1
        return best, other, back

    def opening(self, text: str) -> tuple[list[tuple[int, float]], bool]:
        """(length, score) of the edges that leave the start of at most OPENING characters, and whether longer pieces may leave it."""
        get, low = self.scores.get, -math.inf
        short = [(n, score) for n in range(1, len(text) + 1) if (score := get(text[:n], low)) > low]
        if get(text[0], low) == low:
            short.append((1, self.byte_score * len(self.spelt(text[0]))))
        if len(self.openings) >= REMEMBERED:
            self.openings = {}
        found = self.openings[text] = (short, len(text) == OPENING and text in self.scores)
        return found

    def piece(self, chunk: str, start: int, end: int) -> tuple[int, ...]:
        """The ids of the lattice's edge between two places."""
        own = self.ids.get(chunk[start:end])
        return (own,) if own is not None else tuple([self.byte_ids[b] for b in self.spelt(chunk[start])])

    def into(self, chunk: str, end: int) -> list[tuple[int, float]]:
        """(start, score) of the edges that end at a place."""
        get, low = self.scores.get, -math.inf
        found = [(start, score) for start in range(end - 1, max(0, end - self.longest) - 1, -1) if (score := get(chunk[start:end], low)) > low]
        if get(chunk[end - 1], low) == low:
            found.append((end - 1, self.byte_score * len(self.spelt(chunk[end - 1]))))
        return found

    def search(self, chunk: str, most: int) -> list[tuple[float, bytes]]:
        """The `most` best segmentations of a chunk, best first; ids as 32-bit integers.

        A* backward from the end: a hypothesis has come back to a place, and the forward score of that
        place is exactly what the rest will add.  So each hypothesis is sure to be completed for what it
        promises, no two to the same segmentation, and only the `most` that promise best are kept.  Of
        equal ones that which has come further goes first.
        """
        best, _, _ = self.forward(chunk)
        # what it promises (negative), the place, an ordinal, the score of what follows, and its ids as a chain
        n, count = len(chunk), 0
        open_: list[tuple[float, int, int, float, tuple | None]] = [(-best[n], n, 0, 0.0, None)]
        found: list[tuple[float, bytes]] = []
        while open_:
            _, at, _, behind, chain = open_.pop(0)
            if at == 0:
                ids: list[int] = []
                while chain:
                    ids += chain[0]
                    chain = chain[1]
                found.append((behind, array("i", ids).tobytes()))
                continue
            for start, score in self.into(chunk, at):
                count += 1
                score += behind
                insort(open_, (-best[start] - score, start, count, score, (self.piece(chunk, start, at), chain)))
            del open_[most - len(found) :]
        return found

    def parts(self, chunk: str) -> tuple[bytes, float, float]:
        """A chunk's best ids and score, and what its second segmentation loses.

        That is what the search's second result loses: the least that any place of the best path loses
        by coming in through another piece.
        """
        best, other, back = self.forward(chunk)
        at, ids, least, get = len(chunk), [], math.inf, self.ids.get
        while at:
            start, least = back[at], min(least, best[at] - other[at])
            own = get(chunk[start:at])
            ids += [own] if own is not None else self.piece(chunk, start, at)[::-1]
            at = start
        return array("i", ids[::-1]).tobytes(), best[-1], least

    def remember(self, chunks: list[str], ids: list[bytes], score: np.ndarray, loss: np.ndarray) -> None:
        at = len(self.best)
        self.memory.update(zip(chunks, range(at, at + len(chunks)), strict=True))
        self.best += ids
        size = np.array([len(x) for x in ids], np.int64) // 4
        for name, more in (("size", size), ("score", score), ("loss", loss)):
            have = getattr(self, name)
            if at + len(chunks) > len(have):  # room for as many again
                have = np.concatenate((have[:at], np.empty(at + len(chunks), have.dtype)))
                setattr(self, name, have)
            have[at : at + len(chunks)] = more

    def learn(self, chunks: list[str]) -> None:
        """Remembers the parts of many chunks at once, each of 2 to SHORT characters; those with a character that is no piece are left."""
        finder, low = self.finder, -math.inf
        chunks.sort(key=len)
        for first in range(0, len(chunks), LEARNT):
            own = chunks[first : first + LEARNT]
            width, n = len(own[-1]), np.array([len(c) for c in own])
            found = finder.find(codes(own, width))
            best, other = np.full((2, len(own), width + 1), low)
            back = np.zeros((len(own), width + 1), np.int64)
            best[:, 0] = 0.0
            for end in range(1, width + 1):
                top, next_, size = best[:, end], other[:, end], back[:, end]
                for k in range(min(len(found), end), 0, -1):
                    value = best[:, end - k] + finder.scores[found[k - 1][:, end - k]]
                    more = value > top
                    np.copyto(next_, np.where(more, top, np.maximum(next_, value)))
                    np.copyto(top, np.maximum(top, value))
                    size[more] = k
            row = np.arange(len(own))
            least, at, ids = np.full(len(own), math.inf), n.copy(), []
            table = np.stack([np.pad(f, ((0, 0), (0, width - f.shape[1])), constant_values=len(finder.ids) - 1) for f in found])
            while (at > 0).any():
                size = back[row, at]
                with np.errstate(invalid="ignore"):
                    least = np.where(at > 0, np.fmin(least, best[row, at] - other[row, at]), least)
                ids.append(np.where(at > 0, finder.ids[table[np.maximum(size - 1, 0), row, at - size]], -1))
                at = np.where(size > 0, at - size, 0)
            paths = np.stack(ids[::-1], axis=1)
            stops = np.cumsum((paths >= 0).sum(axis=1)) * 4
            raw = paths[paths >= 0].astype(np.int32).tobytes()
            score = best[row, n]
            made = [raw[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist(), strict=False)]
            good = score > low
            if good.all():
                self.remember(own, made, score, least)
            else:
                at = np.flatnonzero(good)
                self.remember([own[i] for i in at], [made[i] for i in at], score[at], least[at])

    def cut_all(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """The chunks of each text and where each is remembered; null and empty texts have none.

        Short chunks that are new are searched together.  Those of more than 64 characters are remembered
        until the next call only.
        """
        for chunk in self.passing:
            del self.memory[chunk]
        del self.best[len(self.best) - len(self.passing) :]
        if len(self.memory) > REMEMBERED:
            self.memory, self.best = {}, []
        cuts = [self.cut(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
        at = [np.fromiter(map(self.memory.get, c, repeat(-1)), np.int64, len(c)) for c in cuts]
        gaps = [np.flatnonzero(x < 0).tolist() for x in at]
        new = {c[i] for c, own in zip(cuts, gaps, strict=True) for i in own}
        self.learn([c for c in new if 1 < len(c) <= SHORT])
        self.passing = [c for c in new if len(c) > 64]
        for some in ([c for c in new if len(c) <= 64 and c not in self.memory], self.passing):
            parts = [self.parts(c) for c in some]
            self.remember(some, [p[0] for p in parts], np.array([p[1] for p in parts]), np.array([p[2] for p in parts]))
        for c, x, own in zip(cuts, at, gaps, strict=True):
            if own:
                x[own] = [self.memory[c[i]] for i in own]
        return list(zip(cuts, at, strict=True))

    def all_parts(self, chunk: str) -> list[tuple[float, bytes]]:
        """A chunk's nbest segmentations."""
        known = self.close.get(chunk)
        if known is None:
            known = self.search(chunk, self.nbest)
            if len(self.close) >= REMEMBERED // 8:
                self.close = {}
            if len(chunk) <= 64:
                self.close[chunk] = known
        return known

    def combined(self, options: list[list[tuple[float, bytes]]]) -> list[tuple[float, list[tuple[int, int]]]]:
        """The nbest combinations of independent options: what each loses against all the first, and its (option, pick) other than the first.

        options must be those nbest - 1 whose second pick loses least: any other departure has nbest - 1
        better ones and the best combination before it.
        """
        choices = []
        for picks in _picks(tuple([len(o) for o in options]), self.nbest):
            choices.append((sum([options[i][0][0] - options[i][p][0] for i, p in picks]), picks))
        return sorted(choices)[: self.nbest]

    def encode(self, text: str | None, cut: tuple[list[str], np.ndarray] | None = None) -> tuple[bytes, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
        """(32-bit ids of the best segmentation, the nbest): each with its score and where it differs, as (place, ids dropped, ids put).

        Null and empty texts have no ids and one segmentation of score 0.  cut: what cut_all gave for the text.
        """
        if not text:
            return b"", [(0.0, [])]
        chunks, at = cut or self.cut_all([text])[0]
        base, losses = float(self.score[at].sum()), self.loss[at]
        # the nbest - 1 chunks whose second segmentation loses least, by place
        few = min(self.nbest - 1, len(chunks))
        near = np.flatnonzero(losses <= np.partition(losses, few - 1)[few - 1]) if few else np.empty(0, np.int64)
        near = sorted(i for i in near[np.argsort(losses[near], kind="stable")][:few].tolist() if losses[i] < math.inf)
        wide = [self.all_parts(chunks[i]) for i in near]
        ids = list(map(self.best.__getitem__, at.tolist()))
        ends, more, starts = np.cumsum(self.size[at]), 0, []
        for i, own in zip(near, wide, strict=True):
            starts.append(int(ends[i]) - len(ids[i]) // 4 + more)
            more += (len(own[0][1]) - len(ids[i])) // 4
            ids[i] = own[0][1]  # of equal segmentations the search may have found another
        best = []
        for loss, picks in self.combined(wide):
            best.append((base - loss, [(starts[j], len(wide[j][0][1]) // 4, array("i", wide[j][p][1]).tolist()) for j, p in picks]))
        return b"".join(ids), best

    def decode(self, ids: Iterator[int]) -> str:
        """The text of ids; the space put before it is taken off."""
        raw = self.raw
        line = b"".join([raw[i] for i in ids])
        return (line[1:] if line[:1] == b" " else line).decode("utf-8", "replace")


def load(path: str | None = None, nbest: int = 4) -> PieceModel:
    """The model of a SentencePiece file; loaded once in a process."""
    path = path or str(Path(TOKENIZER_DIR) / MODEL)
    if (path, nbest) not in _models:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = own.get_piece_size()
        kinds = ["byte" if own.is_byte(i) else "other" if own.is_control(i) or own.is_unknown(i) or own.is_unused(i) else "piece" for i in range(size)]
        _models[path, nbest] = PieceModel([own.id_to_piece(i) for i in range(size)], kinds, nbest)
    return _models[path, nbest]


ENCODED = "ids array<int>, nbest array<struct<score:double,edits:array<struct<at:int,drop:int,put:array<int>>>>>"


def _portions(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of 256 rows, or fewer if column `at` has more than TOGETHER characters or so in them."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(at)).to_pylist()):
            if i > start and (size + (n or 0) > TOGETHER or i - start == 256):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def encode_pieces(docs: DataFrame, path: str | None = None, nbest: int = 4, into: str | None = None) -> DataFrame:
    """docs with ids (the best segmentation) and nbest (scores, and each one's edits of ids), best first.

    With `into`, also the text that the ids decode to, in the same pass.  Null and empty texts have no
    ids and a single segmentation of score 0.  Columns of docs with these names are replaced; the rest
    pass through.
    """
    ship(docs.sparkSession)
    fields = T._parse_datatype_string(ENCODED + (f", {into} string" if into else ""))
    docs = docs.drop(*fields.names)
    at, names = docs.columns.index("text"), [*docs.columns, *fields.names]
    edits = pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))]))
    kind = pa.list_(pa.struct([("score", pa.float64()), ("edits", edits)]))

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, nbest)
        for batch in _portions(batches, at):
            texts = batch.column(at).to_pylist()
            made = [model.encode(t, c) for t, c in zip(texts, model.cut_all(texts), strict=True)]
            flat = np.frombuffer(b"".join([m[0] for m in made]), np.int32)
            offsets = np.concatenate(([0], np.cumsum([len(m[0]) // 4 for m in made]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            best = pa.array([[{"score": s, "edits": [{"at": a, "drop": d, "put": p} for a, d, p in e]} for s, e in m[1]] for m in made], kind)
            back = [pa.array([model.decode(array("i", m[0])) for m in made], pa.string())] if into else []
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, best, *back], names)

    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, *fields.fields]))


def decode_pieces(docs: DataFrame, path: str | None = None, into: str = "decoded") -> DataFrame:
    """docs with the text of its ids under `into`; null ids decode to null."""
    ship(docs.sparkSession)
    docs = docs.drop(into)
    at, names = docs.columns.index("ids"), [*docs.columns, into]

    @lean
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [None if x is None else model.decode(x) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return docs.mapInArrow(decode, T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())]))
