"""A hidden Markov language model, trained by Baum-Welch over all training texts.

Tokens are words, then one end.  They are counted exactly, and every training token has emissions of its
own; one more symbol stands for a token never seen, so the model is a distribution over all token
sequences.  Texts are coded in blocks.  Each round, every block runs scaled forward-backward, its texts side by side
and long ones in segments, and hands on expected counts by token.  The emissions of frequent tokens are broadcast; all others stay in tables and
are sent to the blocks that hold the tokens.  Scores come from the scaled forward recursion.

Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_stored, ship, stored
from .shingles import word_hashes

#: The end of a text, as a token: no word hashes to it but by chance of 1 in 2 ** 64.
END = np.uint64(0x656E64656E64)
MAX_FREQUENT = 200_000
#: Symbols to a block, about: what a block sends and gets is one row for each of its distinct tokens.
BLOCK = 2_000_000
#: Distinct tokens to a bucket, about; the number of buckets grows with the vocabulary.
BUCKET = 50_000


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows of texts (text): its words, and one end for each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, ends = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            every = np.concatenate([tokens, *[t for t, _ in waiting]])
            own, where = np.unique(every, return_inverse=True)
            return own, np.bincount(where, np.concatenate([counts, *[n for _, n in waiting]]), len(own)).astype(np.int64)

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                texts = whole.column(0).slice(at, 512).to_pylist()
                ends += len(texts)
                waiting.append(np.unique(np.concatenate(list(word_hashes(texts))), return_counts=True))
                if sum(len(t) for t, _ in waiting) > 500_000:
                    tokens, counts = merged()
                    waiting.clear()
                    if len(tokens) > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], ["token", "c"])
                        tokens, counts = tokens[:0], counts[:0]
        tokens, counts = merged()
        if ends:
            tokens, counts = np.append(tokens, END), np.append(counts, ends)
        for a in range(0, len(tokens), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(tokens[a : a + 100_000].view(np.int64)), pa.array(counts[a : a + 100_000])], ["token", "c"])

    return texts.select("text").mapInArrow(count, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent tokens, most frequent first, with their counts; of all n training words there are v distinct ones."""

    tokens: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    order: np.ndarray | None = None
    sorted: np.ndarray | None = None
    table: np.ndarray | None = None
    shift: np.uint64 | None = None

    #: Symbols of a block: a frequent token's place, then the end, a token never seen, and the block's seldom tokens.
    @property
    def end(self) -> int:
        return len(self.tokens)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is here) of each token."""
        if not len(self.tokens):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        if self.order is None:
            self.order = np.argsort(self.tokens)
            self.sorted = self.tokens[self.order]
            self.shift = np.uint64(64 - max(8, len(self.tokens).bit_length() + 3))
            self.table = np.zeros(1 << int(64 - self.shift), np.int32)
            self.table[self.tokens[::-1] >> self.shift] = np.arange(len(self.tokens), dtype=np.int32)[::-1]
        # most stand where their upper bits point, the others are looked up
        at = self.table[hashes >> self.shift].astype(np.int64)
        hit = self.tokens[at] == hashes
        rest = np.flatnonzero(~hit)
        own = np.minimum(np.searchsorted(self.sorted, hashes[rest]), len(self.sorted) - 1)
        at[rest], hit[rest] = self.order[own], self.sorted[own] == hashes[rest]
        return at, hit


def vocabulary(counts: DataFrame, most: int = MAX_FREQUENT) -> Vocabulary:
    """The frequent tokens of (token, c), at most `most` of them."""
    counts = counts.where(F.col("token") != int(END.view(np.int64)))
    steps = [1 << k for k in range(50)]
    row = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), *[F.sum((F.col("c") >= s).cast("long")).alias(f"at{s}") for s in steps]).first()
    least = next((s for s in steps if (row[f"at{s}"] or 0) <= most), steps[-1])
    got = counts.where(F.col("c") >= least).toArrow()
    tokens, c = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy().astype(np.int64)
    order = np.lexsort((tokens, -c))
    return Vocabulary(tokens[order], c[order], row["n"] or 0, row["v"])


@dataclass
class HiddenMarkov:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @staticmethod
    def initial(weights: np.ndarray, states: int, seed: int = 7) -> HiddenMarkov:
        """Every state emits by the overall weights, shaken so that states part."""
        rng = np.random.default_rng(seed)
        emit = (weights + 1e-3)[:, None] * rng.uniform(0.2, 1.8, (len(weights), states))
        move = rng.uniform(0.8, 1.2, (states, states)) + 4 * np.eye(states)
        return HiddenMarkov(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-likelihood (natural) of each sequence, none empty, by the scaled forward recursion."""
        return self._run(symbols, lengths, None)

    def expected(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood and expected counts of starts, moves and emissions."""
        states = len(self.start)
        sums = np.zeros(states), np.zeros((states, states)), np.zeros((len(self.emit), states))
        total = self._run(symbols, lengths, sums)
        return float(total.sum()), sums[0], sums[1] * self.move, sums[2]

    def _run(self, symbols: np.ndarray, lengths: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Log-likelihoods; into sums, if given, go the expected counts of starts, moves (to be weighted) and emissions.

        Long sequences are cut into segments that run side by side.  What a segment does to any state
        distribution is a product of matrices; chained, those give the distribution that enters each
        segment and the weights that come back to its end, so nothing is approximated.
        """
        own = _Segments(lengths)
        states, count = len(self.start), len(own.start)
        kind = self.emit.dtype
        entry, ends, back = np.tile(self.start, (count, 1)), np.empty((count, states), kind), np.ones((count, states), kind)
        if own.deepest:
            later = np.flatnonzero(own.depth > 0)
            moved = np.empty((count, states, states), kind)
            inner = later if sums else later[~own.last[later]]
            for some in _portions(own.length, inner, TOGETHER // 8):
                moved[some] = self._product(symbols, own.start[some], own.length[some])
            openers = np.flatnonzero((own.depth == 0) & ~own.last)
            for some in _portions(own.length, openers, TOGETHER):
                ends[some] = self._pass(symbols, own.start[some], own.length[some], entry[some])[1]
            for at in own.by_depth()[1:]:
                entry[at] = ends[at - 1] @ self.move
                going = at[~own.last[at]]
                out = np.einsum("ni,nij->nj", ends[going - 1], moved[going]) if len(going) else np.empty((0, states))
                ends[going] = out / out.sum(axis=1, keepdims=True)
            if sums:
                for at in own.by_depth()[:0:-1]:
                    value = np.einsum("nij,nj->ni", moved[at], back[at])
                    back[at - 1] = value / (ends[at - 1] * value).sum(axis=1, keepdims=True)
        total = np.zeros(len(lengths))
        for some in _portions(own.length, np.arange(count), TOGETHER):
            kept = [] if sums else None
            like, _ = self._pass(symbols, own.start[some], own.length[some], entry[some], kept)
            np.add.at(total, own.sequence[some], like)
            if sums:
                before = np.where((own.depth[some] > 0)[:, None], ends[some - 1], kind.type(0))
                self._back(symbols, own.start[some], own.length[some], kept, before, back[some], own.depth[some] == 0, sums)
        return total

    def _pass(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Forward over segments, longest first: log-likelihoods and the last state distributions; kept gets (alpha, scale, emissions) by step."""
        active = _active(lengths)
        total, last = np.zeros(len(lengths)), np.empty_like(entry)
        alpha = entry
        for t, n in enumerate(active):
            emit = self.emit[symbols[starts[:n] + t]]
            if n < len(alpha):
                last[n : len(alpha)] = alpha[n:]
            alpha = emit * entry if t == 0 else (alpha[:n] @ self.move) * emit
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
            if kept is not None:
                kept.append((alpha, scale, emit))
        last[: len(alpha)] = alpha
        return total, last

    def _product(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """By segment, longest first, the product of its steps' matrices, up to a factor."""
        states = len(self.start)
        out = np.tile(np.eye(states, dtype=self.emit.dtype), (len(starts), 1, 1))
        for t, n in enumerate(_active(lengths)):
            emit = self.emit[symbols[starts[:n] + t]]
            step = (out[:n].reshape(-1, states) @ self.move).reshape(n, states, states) * emit[:, None, :]
            if t % 8 == 7 or t < 2:  # often enough to stay in range
                step /= step.sum(axis=(1, 2), keepdims=True)
            out[:n] = step
        return out

    def _back(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kept: list, before: np.ndarray, beta: np.ndarray, opens: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Backward over segments after a forward pass; adds to sums."""
        states = len(self.start)
        gammas, seen = np.empty((int(lengths.sum()), states), self.emit.dtype), np.empty(int(lengths.sum()), np.int64)
        at = len(seen)
        beta = beta.copy()
        for t in range(len(kept) - 1, -1, -1):
            alpha, scale, emit = kept[t]
            n = len(alpha)
            at -= n
            np.multiply(alpha, beta[:n], out=gammas[at : at + n])
            seen[at : at + n] = symbols[starts[:n] + t]
            ahead = emit * beta[:n]
            ahead /= scale[:, None]
            sums[1][...] += (kept[t - 1][0][:n] if t else before).T @ ahead
            if t:
                np.matmul(ahead, self.move.T, out=beta[:n])
            else:
                sums[0][...] += gammas[at : at + n][opens].sum(axis=0)
            kept[t] = None
        for k in range(states):
            sums[2][:, k] += np.bincount(seen, gammas[:, k], len(self.emit))


#: Symbols of a segment of a sequence, and symbols that run side by side, about.
SEGMENT = 1024
TOGETHER = 400_000


def _active(lengths: np.ndarray) -> np.ndarray:
    """How many of descending lengths reach each step."""
    return np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")


def _portions(lengths: np.ndarray, which: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """`which`, longest first, in parts of about `most` symbols."""
    which = which[np.argsort(-lengths[which], kind="stable")]
    ends, at = np.cumsum(lengths[which]), 0
    while at < len(which):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield which[at:stop]
        at = stop


class _Segments:
    """Sequences cut into segments of at most SEGMENT symbols; those of a sequence follow one another."""

    def __init__(self, lengths: np.ndarray):
        counts = -(-lengths // SEGMENT)
        self.sequence = np.repeat(np.arange(len(lengths)), counts)
        first = np.cumsum(counts) - counts
        self.depth = np.arange(len(self.sequence)) - first[self.sequence]
        self.start = (np.cumsum(lengths) - lengths)[self.sequence] + self.depth * SEGMENT
        self.length = np.minimum(SEGMENT, lengths[self.sequence] - self.depth * SEGMENT)
        self.last = self.depth == counts[self.sequence] - 1
        self.deepest = int(counts.max(initial=1)) - 1

    def by_depth(self) -> list[np.ndarray]:
        """The segments that stand first in their sequences, then the second ones, and so on."""
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.cumsum(np.bincount(self.depth))[:-1])


def _zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzipped(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _packed(symbols: np.ndarray) -> bytes:
    """32-bit symbols, byte by byte from the lowest: frequent symbols are low, so the upper bytes shrink."""
    return _zipped(np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzipped(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _blocks(rows: DataFrame, shared, buckets: int) -> DataFrame:
    """Rows (doc_id, text, learns, scored) as blocks of about BLOCK symbols.

    In a block the texts to learn from come first.  Its distinct seldom tokens follow in two parts, those
    of the texts to learn from and the others, each by bucket.  A block is one text at least, and so as
    long as the longest text at most.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, number = shared.value, TaskContext.get().partitionId() << 32
        parts, hashes, size = [], [], 0

        def block():
            rows = pa.Table.from_batches(parts).combine_chunks()
            learns = rows["learns"].to_numpy().astype(bool)
            order = np.argsort(~learns, kind="stable")
            rows, own = rows.take(pa.array(order)), [hashes[i] for i in order]
            lengths = np.array([len(h) + 1 for h in own], np.int64)
            words, first = np.concatenate(own), int((lengths[: learns.sum()] - 1).sum())
            symbols, hit = vocab.find(words)
            seldom = np.flatnonzero(~hit)
            learnt = np.unique(words[seldom[seldom < first]])
            others = np.setdiff1d(words[seldom[seldom >= first]], learnt, assume_unique=False)
            tail = np.concatenate([part[np.argsort(part % np.uint64(buckets), kind="stable")] for part in (learnt, others)])
            by = np.argsort(tail)
            symbols[seldom] = vocab.end + 2 + by[np.searchsorted(tail[by], words[seldom])]
            symbols = np.insert(symbols, np.cumsum(lengths - 1), vocab.end)
            ids = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), rows["doc_id"].combine_chunks())
            packed = [pa.array([x], pa.binary()) for x in (_packed(symbols), lengths.tobytes(), tail.tobytes(), rows["scored"].to_numpy().astype(bool).tobytes())]
            counts = [pa.array([x], pa.int64()) for x in (learns.sum(), len(learnt))]
            return pa.RecordBatch.from_arrays([pa.array([number]), ids, *packed, *counts], ["block", "ids", "symbols", "lengths", "tail", "scored", "learn", "learnt"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                hashes += word_hashes(part.column(1).to_pylist())
                parts.append(part.select(["doc_id", "learns", "scored"]))
                size += sum(len(h) + 1 for h in hashes[-part.num_rows :])
                if size >= BLOCK:
                    yield block()
                    number, parts, hashes, size = number + 1, [], [], 0
        if hashes:
            yield block()

    kind = dict(rows.dtypes)["doc_id"]
    return stored(rows.select("doc_id", "text", "learns", "scored").mapInArrow(encode, f"block bigint, ids array<{kind}>, {BLOCK_FIELDS}"), "blocks")


BLOCK_FIELDS = "symbols binary, lengths binary, tail binary, scored binary, learn bigint, learnt bigint"


def _shares(sums: np.ndarray) -> bytes:
    """Expected counts of tokens as they travel: each token's count, and of it each state's share in 65535ths."""
    total = sums.sum(axis=1)
    parts = np.rint(sums / np.maximum(total, 1e-300)[:, None] * 65535).astype("<u2")
    return _zipped(np.rint(total).astype("<f8").tobytes() + np.ascontiguousarray(parts.T).tobytes())


def _unshared(raw: bytes, states: int) -> np.ndarray:
    """tokens x (count, expected count in each state)."""
    raw = _unzipped(raw)
    n = len(raw) // (8 + 2 * states)
    total, parts = np.frombuffer(raw, "<f8", n), np.frombuffer(raw, "<u2", n * states, 8 * n).reshape(states, n).T.astype(float)
    return np.concatenate((total[:, None], parts * (total / np.maximum(parts.sum(axis=1), 1))[:, None]), axis=1)


def _mail(rows: list[tuple]) -> pa.Table:
    """Rows of MAIL."""
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("sums", pa.binary())]
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


MAIL = "kind int, bucket int, block bigint, tokens binary, sums binary"
#: Kinds of mail: from a block to a bucket about seldom and about frequent tokens, a block's sums without tokens,
#: a question about tokens; and from a bucket its frequent and its seldom tokens, what became of the tokens that a
#: block told of, and the answer to a question.
SELDOM, FREQUENT, WHOLE, ASK, SHARED, KEPT, REPLY, ANSWER = range(8)


def _by_bucket(tokens: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    own = (tokens % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(own[places[0]]), places


def _jitter(tokens: np.ndarray, states: int) -> np.ndarray:
    """0.2 to 1.8 for each token and state, by hash: states part from there."""
    out = np.empty((len(tokens), states))
    for k in range(states):
        x = (tokens ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = 0.2 + 1.6 * ((x >> np.uint64(11)).astype(float) / (1 << 53))
    return out


def _replies(rows: pa.Table, kind: int, states: int) -> np.ndarray:
    """What buckets told a block, in the order of its seldom tokens."""
    told = sorted((b, raw) for k, b, raw in zip(rows["kind"].to_pylist(), rows["bucket"].to_pylist(), rows["sums"].to_pylist(), strict=True) if k == kind)
    return np.concatenate([np.empty((0, states + 1)), *[_unshared(raw, states) for _, raw in told]])


def _block(rows: pa.Table) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    at = int(np.flatnonzero(rows["symbols"].is_valid().to_numpy())[0])
    row = rows.select(["symbols", "lengths", "tail", "scored", "learn", "learnt"]).slice(at, 1).to_pylist()[0]
    return row, _unpacked(row["symbols"]), np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["tail"], np.uint64)


def _with_mail(blocks: DataFrame, mail: DataFrame | None, *kinds: int):
    """The blocks and the letters of some kinds to them, grouped by block."""
    if mail is None:
        blocks = blocks.select("*", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("sums"))
    else:
        blocks = blocks.unionByName(mail.where(F.col("kind").isin(*kinds)).select("block", "kind", "bucket", "sums"), allowMissingColumns=True)
    return blocks.groupBy("block")


@dataclass
class Trained:
    """The model with the emissions of frequent tokens, end and a token never seen.

    Those of seldom tokens are (sums + more) / norm, with the sums as mail of kind KEPT, and of kind REPLY
    for the tokens of each block's texts to learn from.
    """

    model: HiddenMarkov
    more: np.ndarray
    norm: np.ndarray
    mail: DataFrame | None


def train(blocks: DataFrame, shared, docs: int, buckets: int, states: int = 8, rounds: int = 4) -> Trained:
    """Baum-Welch over the texts to learn from in blocks, `docs` in number; none leave the initial model.

    Every training token has emissions of its own.  Those of frequent tokens are broadcast.  The others
    go by mail: a block sends its expected counts to the buckets of its tokens, which add them up and
    send back what becomes of the tokens that the block told of.
    """
    spark, vocab = blocks.sparkSession, shared.value
    move = np.full((states, states), 1.0) + 4 * np.eye(states)
    ends = np.array([END, np.uint64(0)], np.uint64)
    trained = Trained(HiddenMarkov(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), _jitter(np.concatenate((vocab.tokens, ends)), states)), np.zeros(states), np.ones(states), None)
    whole = 2 * states + states * states
    mail, cleanup = None, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")  # a round's shuffle files go when it is stored
    for turn in range(rounds if docs else 0):
        current, last = spark.sparkContext.broadcast((trained.model, trained.more, trained.norm)), turn == rounds - 1

        def expect(rows, *, current=current, turn=turn):
            (model, more, norm), vocab = current.value, shared.value
            block = rows["block"][0].as_py()
            row, symbols, lengths, tail = _block(rows)
            if not row["learn"]:
                return _mail([])
            lengths, tail, end = lengths[: row["learn"]], tail[: row["learnt"]], vocab.end
            own = (_replies(rows, REPLY, states)[:, 1:] + more) / norm if turn else _jitter(tail, states)
            # a factor to all emissions of a token changes no expected count: with the largest at 1, 32 bits do
            emit = np.concatenate((model.emit, own))
            emit = (emit / emit.max(axis=1, keepdims=True)).astype(np.float32)
            _, starts, moves, emits = HiddenMarkov(model.start.astype(np.float32), model.move.astype(np.float32), emit).expected(symbols[: lengths.sum()], lengths)
            out = [(WHOLE, -1 - block % 16, block, None, np.concatenate((starts, moves.ravel(), emits[end])).tobytes())]
            met = np.flatnonzero(emits[:end].sum(axis=1) > 0)
            for kind, tokens, sums in ((SELDOM, tail, emits[end + 2 :]), (FREQUENT, vocab.tokens[met], emits[met])):
                out += [(kind, b, block, tokens[at].tobytes(), _shares(sums[at])) for b, at in _by_bucket(tokens, buckets)]
            return _mail(out)

        def add(rows, *, last=last):
            bucket, kinds, raw = rows["bucket"][0].as_py(), rows["kind"].to_pylist(), rows["sums"].to_pylist()
            if bucket < 0:
                return _mail([(WHOLE, bucket, None, None, sum(np.frombuffer(x) for x in raw).tobytes())])
            named = [np.frombuffer(x, np.uint64) for x in rows["tokens"].to_pylist()]
            tokens, where = np.unique(np.concatenate(named), return_inverse=True)
            sums = np.concatenate([_unshared(x, states) for x in raw])[:, 1:]
            total = np.stack([np.bincount(where, sums[:, k], len(tokens)) for k in range(states)], axis=1)
            out, parts = [], np.split(where, np.cumsum([len(x) for x in named])[:-1])
            frequent = np.zeros(len(tokens), bool)
            for kind, block, at in zip(kinds, rows["block"].to_pylist(), parts, strict=True):
                if kind == FREQUENT:
                    frequent[at] = True
                else:
                    out.append((REPLY, bucket, block, None, _shares(total[at])))
            out.append((SHARED, bucket, None, tokens[frequent].tobytes(), total[frequent].tobytes()))
            if last:
                out.append((KEPT, bucket, None, tokens[~frequent].tobytes(), _shares(total[~frequent])))
            return _mail(out)

        read = mail
        mail = stored(_with_mail(blocks, mail, REPLY).applyInArrow(expect, MAIL).groupBy("bucket").applyInArrow(add, MAIL), "mail")
        sums, emit = np.zeros(whole), np.zeros((vocab.end + 2, states))
        for row in mail.where(F.col("kind").isin(WHOLE, SHARED)).select("kind", "tokens", "sums").collect():
            if row["kind"] == WHOLE:
                sums += np.frombuffer(row["sums"])
            else:
                emit[vocab.find(np.frombuffer(row["tokens"], np.uint64))[0]] = np.frombuffer(row["sums"]).reshape(-1, states)
        starts, moves, end = sums[:states] + 0.1, sums[states:-states].reshape(states, states) + 0.1, sums[-states:]
        # every token but a text's last, its end, is left by a move
        visits = sums[states:-states].reshape(states, states).sum(axis=1) + end
        emit[vocab.end] = end
        # every token, the end and one never seen occur once more, in all states by their visits
        more = (visits + 1) / (visits + 1).sum()
        norm = visits + more * (vocab.v + 2)
        trained = Trained(HiddenMarkov(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), (emit + more) / norm), more, norm, mail if last else None)
        current.unpersist()
        if read is not None:
            drop_stored(read)
    spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return trained


def score_texts(docs: DataFrame, training: DataFrame | Column, states: int = 8, rounds: int = 4, symbols: int = MAX_FREQUENT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text), learning from training.

    training is another table (text), or a condition on docs: its rows are then read once for both.  Null
    and empty texts are a lone end.  base_score is the add-one unigram log10-probability, score the
    model's.  Without training rows every token is unknown and the base probability is 1.  At most
    `symbols` tokens are broadcast; the result is the same for any number, but for the rounding of
    expected counts that travel, to 1/65535 of a token's count.
    """
    spark = docs.sparkSession
    ship(spark)
    if isinstance(training, Column):
        rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("learns"), F.lit(True).alias("scored"))
    else:
        none = F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id")
        rows = docs.select("doc_id", "text", F.lit(False).alias("learns"), F.lit(True).alias("scored")).unionByName(training.select(none, "text", F.lit(True).alias("learns"), F.lit(False).alias("scored")))
    counts = stored(token_counts(rows.where("learns")), "token-counts")
    vocab = vocabulary(counts, symbols)
    ends = counts.where(F.col("token") == int(END.view(np.int64))).agg(F.sum("c")).first()[0] or 0
    drop_stored(counts)
    buckets = max(1, -(-vocab.v // BUCKET))
    shared = spark.sparkContext.broadcast(vocab)
    blocks = _blocks(rows, shared, buckets)
    trained = train(blocks, shared, ends, buckets, states, rounds)
    learnt = spark.sparkContext.broadcast((trained.model, trained.more, trained.norm))
    kind = dict(docs.dtypes)["doc_id"]
    total, types = vocab.n + ends, vocab.v + (1 if ends else 0)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens = np.frombuffer(raw, np.uint64)[known:]
                yield from _mail([(ASK, b, block, tokens[at].tobytes(), None) for b, at in _by_bucket(tokens, buckets)]).to_batches()

    def answer(rows):
        letters = rows.to_pylist()
        kept = next((r for r in letters if r["kind"] == KEPT), None)
        tokens = np.frombuffer(kept["tokens"] if kept else b"", np.uint64)
        sums = _unshared(kept["sums"], states)[:, 1:] if kept else np.empty((0, states))
        # after the last a token never seen, with count 0
        sums = np.concatenate((sums, np.zeros((1, states))))
        out = []
        for r in letters:
            if r["kind"] == ASK:
                own = np.frombuffer(r["tokens"], np.uint64)
                at = np.searchsorted(tokens, own)
                at[np.append(tokens, np.uint64(0))[at] != own] = len(tokens)
                out.append((ANSWER, r["bucket"], r["block"], None, _shares(sums[at])))
        return _mail(out)

    def score(rows):
        (model, more, norm), vocab = learnt.value, shared.value
        row, symbols, lengths, _ = _block(rows)
        told = np.concatenate((_replies(rows, REPLY, states), _replies(rows, ANSWER, states)))
        seen = told[:, 0] > 0
        own = np.where(seen[:, None], (told[:, 1:] + more) / norm, model.emit[vocab.end + 1])
        wanted = np.frombuffer(row["scored"], bool)
        symbols, lengths = symbols[np.repeat(wanted, lengths)], lengths[wanted]
        if not len(lengths):
            return pa.table([pa.array([], t) for t in kinds], names)
        like = HiddenMarkov(model.start, model.move, np.concatenate((model.emit, own))).forward(symbols, lengths)
        known = np.concatenate((np.ones(vocab.end, np.int64), [1 if ends else 0, 0], seen.astype(np.int64)))[symbols]
        logs = np.log10(np.concatenate((vocab.counts, [ends, 0], told[:, 0])) + 1.0)[symbols]
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        base = np.array([math.fsum(logs[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]) - lengths * math.log10(total + types + 1)
        made = [lengths, np.add.reduceat(known, cuts[:-1]), np.full(len(lengths), total), base, like / math.log(10)]
        ids = rows["ids"].combine_chunks().drop_null().flatten().filter(pa.array(wanted))
        return pa.table([ids, *map(pa.array, made)], names)

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [to_arrow_type(docs.schema["doc_id"].dataType), *[pa.int64()] * 3, pa.float64(), pa.float64()]
    asked = blocks.select("block", "tail", "learnt").mapInArrow(ask, MAIL)
    if trained.mail is not None:
        asked = asked.unionByName(trained.mail.where(F.col("kind") == KEPT))
    mail = asked.groupBy("bucket").applyInArrow(answer, MAIL)
    if trained.mail is not None:
        mail = mail.unionByName(trained.mail.where(F.col("kind") == REPLY))
    return _with_mail(blocks, mail, REPLY, ANSWER).applyInArrow(score, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
