"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Texts are reduced to lower-cased letters with single spaces between words.  For each language the
4-grams of a bounded sample are counted on the executors; from the distinct 4-grams come the lower
orders' continuation counts, and from those the interpolated probabilities.  The model holds its
languages in groups of bounded size.  A group has, for each order, the hashes of all grams of any of its
languages in ascending order, with a row of log-probabilities by language; a gram is found by binary
search, one that no language of the group has seen backs off.  A language's probabilities are the same
in any grouping.  Texts go past one group after the other and keep the best so far, so however many
languages there are, one group at a time is in memory.  A text's language is that of the lowest
cross-entropy per character; one whose cross-entropy lies far above what labelled texts of its length
show is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, lean, ship, stored
from .shingles import mixed

ORDER = 4
UNKNOWN = "und"
_SPACE = np.uint64(32)
#: Stands for all letters above U+FFFF; no character has this code point.
_HIGH = 0xFFFF
_tables: list[tuple[np.ndarray, np.ndarray]] = []
#: A group has at most this many languages, and about this many grams times languages; one language is a group at any size.
GROUP = 64
CELLS = 1 << 22
#: Bytes of rows that go past the groups together, where there are several.
HELD = 1 << 23
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0)


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point below 65536 is a letter, and whether it is a letter or a mark; made once in a process."""
    if not _tables:
        kinds = np.array([unicodedata.category(chr(i))[0] for i in range(1 << 16)])
        _tables.append((kinds == "L", (kinds == "L") | (kinds == "M")))
    return _tables[0]


def letters(text: str | None) -> np.ndarray:
    """The text's letters and the marks on them (16 bits; higher letters are one code), lower-cased; runs of others are one space, none at the ends.

    A text without a letter (general category L) gives nothing, whatever marks it has.
    """
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, part = _letter_tables()
    low = np.minimum(points, 0xFFFF)
    lettered, good = letter[low], part[low]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        kinds = np.array([unicodedata.category(chr(p))[0] for p in points[high]])
        lettered[high], good[high] = kinds == "L", (kinds == "L") | (kinds == "M")
        points = np.where(points > 0xFFFF, np.uint32(_HIGH), points)
    if not lettered.any():
        return np.empty(0, np.uint64)
    points = np.where(good, points.astype(np.uint64), _SPACE)
    points = points[good | np.concatenate(([False], good[:-1]))]
    return points[:-1] if points[-1] == _SPACE else points


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-gram that ends at each letter or space of each text, text after text; and how many each text has.

    Three spaces stand before a text and one after it.
    """
    parts, counts = [], []
    pad = np.full(ORDER - 1, _SPACE)
    for text in texts:
        own = letters(text)
        if len(own):
            parts += [pad, own, pad[:1]]
        counts.append(len(own) + 1 if len(own) else 0)
    if not parts:
        return np.empty(0, np.uint64), np.array(counts)
    line = np.concatenate(parts)
    packed = (line[:-3] << np.uint64(48)) | (line[1:-2] << np.uint64(32)) | (line[2:-1] << np.uint64(16)) | line[3:]
    lengths = np.array(counts)
    has = lengths[lengths > 0]
    # each text takes len + 3 places of the line; those that end in the next text's padding go
    first = np.cumsum(np.concatenate(([0], has[:-1] + ORDER - 1)))
    keep = np.zeros(len(packed) + 1, np.int64)
    np.add.at(keep, first, 1)
    np.add.at(keep, first + has, -1)
    return packed[np.cumsum(keep[:-1]).astype(bool)], lengths


@dataclass
class Level:
    """The grams of one order: hashes ascending, and by language the interpolated log-probability of each."""

    hashes: np.ndarray
    logp: np.ndarray  # grams x languages
    contexts: np.ndarray  # hashes of contexts, ascending
    backoff: np.ndarray  # contexts x languages: log of the weight of the lower order


@dataclass
class Group:
    """The models of some languages, side by side."""

    languages: list[str]
    levels: list[Level]  # from the highest order down to 2
    floor: np.ndarray  # log-probability by language of each single character
    floor_hashes: np.ndarray
    unseen: np.ndarray

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """grams x languages; unseen grams back off order by order."""
        out = np.empty((len(packed), len(self.languages)), np.float32)
        todo = np.arange(len(packed))
        carried = np.zeros((len(packed), len(self.languages)), np.float32)
        for depth, level in enumerate(self.levels):
            mask = np.uint64((1 << (16 * (ORDER - depth))) - 1)
            own = packed[todo] & mask
            at = np.minimum(np.searchsorted(level.hashes, mixed(own)), len(level.hashes) - 1)
            hit = level.hashes[at] == mixed(own)
            out[todo[hit]] = carried[hit] + level.logp[at[hit]]
            miss = ~hit
            todo, carried, own = todo[miss], carried[miss], own[miss]
            if not len(todo):
                return out
            context = mixed(own >> np.uint64(16))
            at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            known = level.contexts[at] == context
            carried = carried + np.where(known[:, None], level.backoff[at], np.float32(0))
        own = mixed(packed[todo] & np.uint64(0xFFFF))
        at = np.minimum(np.searchsorted(self.floor_hashes, own), len(self.floor_hashes) - 1)
        out[todo] = carried + np.where((self.floor_hashes[at] == own)[:, None], self.floor[at], self.unseen)
        return out

    def cross_entropies(self, texts: list[str | None], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, characters): nats per character; a text without letters has 0 characters."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < chunk):
                size += len(texts[end] or "")
                end += 1
            packed, counts = _grams(texts[at:end])
            sizes[at:end] = counts
            has = np.flatnonzero(counts)
            if len(has):
                starts = np.concatenate(([0], np.cumsum(counts[has])[:-1]))
                piece = 8 * chunk * 4 // max(4, len(self.languages))
                for a in range(0, len(packed), piece):  # a text of any length in pieces
                    b = min(len(packed), a + piece)
                    logp = self.log_probabilities(packed[a:b])
                    inside = np.flatnonzero((starts < b) & (starts + counts[has] > a))
                    sums[at + has[inside]] -= np.add.reduceat(logp, np.maximum(starts[inside] - a, 0), axis=0, dtype=np.float64)
            at = end
        return sums / np.maximum(sizes, 1)[:, None], sizes


class Tally:
    """What some texts have of the languages so far: the lowest cross-entropy, whose it is, and the weight of all languages at each temperature."""

    def __init__(self, texts: int, temperatures: tuple[float, ...], truth: np.ndarray | None = None) -> None:
        self.sizes = np.zeros(texts, np.int64)
        self.low = np.full(texts, 1e9)  # above any cross-entropy
        self.best = np.zeros(texts, np.int64)
        self.temperatures = temperatures
        self.weights = np.zeros((len(temperatures), texts))
        self.truth, self.own = truth, np.zeros(texts)  # the right language, and its cross-entropy

    def lead(self, over: np.ndarray) -> np.ndarray:
        return np.minimum(self.sizes, 400)[:, None] * over

    def add(self, entropy: np.ndarray, sizes: np.ndarray, start: int) -> None:
        """Takes up texts x languages, of the languages from place start; of equal ones the first stays best."""
        self.sizes = sizes
        least = entropy.min(axis=1)
        low = np.minimum(self.low, least)
        self.best = np.where(least < self.low, start + entropy.argmin(axis=1), self.best)
        before, lead = self.lead((self.low - low)[:, None])[:, 0], self.lead(entropy - low[:, None])
        for i, t in enumerate(self.temperatures):
            self.weights[i] = self.weights[i] * np.exp(-np.minimum(before * t, 700.0)) + np.exp(-np.minimum(lead * t, 700.0)).sum(axis=1)
        self.low = low
        if self.truth is not None:
            here = np.flatnonzero((self.truth >= start) & (self.truth < start + entropy.shape[1]))
            self.own[here] = entropy[here, self.truth[here] - start]

    def losses(self) -> np.ndarray:
        """texts x temperatures: minus the log-probability of the right language."""
        lead = self.lead((self.own - self.low)[:, None]) * np.array(self.temperatures)
        return np.log(self.weights).T + np.minimum(lead, 700.0)


@dataclass
class LanguageModel:
    """All languages in order; groups hold them in that order, at hand or broadcast."""

    languages: list[str]
    groups: list[Group | Broadcast]
    temperature: float = 1.0
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    def opened(self) -> Iterator[Group]:
        """The groups one after the other; of several that are broadcast none stays in memory."""
        for held in self.groups:
            if not isinstance(held, Broadcast):
                yield held
                continue
            yield held.value
            if len(self.groups) > 1 and "_path" in vars(held):  # it can be read again
                vars(held).pop("_value", None)

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """grams x languages."""
        return np.concatenate([np.empty((len(packed), 0), np.float32), *(g.log_probabilities(packed) for g in self.opened())], axis=1)

    def tallies(self, slices: list[list[str | None]], temperatures: tuple[float, ...], truths: list[np.ndarray] | None = None) -> list[Tally]:
        """The tally of each slice of texts over all languages; each group is opened once."""
        out = [Tally(len(texts), temperatures, truths and truths[i]) for i, texts in enumerate(slices)]
        start = 0
        for group in self.opened():
            for texts, tally in zip(slices, out, strict=True):
                if texts:
                    tally.add(*group.cross_entropies(texts), start)
            start += len(group.languages)
        return out

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Lists of slices of ROWS rows, with about HELD bytes together where there are several groups."""
        kept, size = [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                kept.append(batch)
                size += batch.get_total_buffer_size() * batch.num_rows // max(whole.num_rows, 1)
                if len(self.groups) <= 1 or size >= HELD:
                    yield kept
                    kept, size = [], 0
        if kept:
            yield kept

    def classify_all(self, slices: list[list[str | None]]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """(language, score, cross-entropy, rejected) of the texts of each slice; score is the calibrated probability of the language.

        A model of no languages calls every text 'und', and rejects those without a letter.
        """
        if not self.languages:
            for texts in slices:
                bare = np.array([len(letters(t)) == 0 for t in texts], bool)
                yield [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), bare
            return
        limits = np.array([self.limits.get(x, (np.inf, 0.0)) for x in self.languages])
        for tally in self.tallies(slices, (self.temperature,)):
            none = tally.sizes == 0
            names = [UNKNOWN if n else self.languages[b] for n, b in zip(none, tally.best, strict=True)]
            centre, spread = limits[tally.best].T
            rejected = none | (tally.low > centre + spread / np.sqrt(np.maximum(tally.sizes, 1)))
            score = 1.0 / np.maximum(tally.weights[0], 1.0)  # the best language itself weighs 1
            yield names, np.where(none, 0.0, score), np.where(none, 0.0, tally.low), rejected

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """classify_all of one slice."""
        return next(self.classify_all([texts]))


def _distinct(packed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct packed grams, the sum of counts, and how many rows each had."""
    grams, where = np.unique(packed, return_inverse=True)
    return grams, np.bincount(where, counts, len(grams)), np.bincount(where, minlength=len(grams))


def build_group(counts: dict[str, tuple[np.ndarray, np.ndarray]], characters: int) -> Group:
    """The models of languages from their packed 4-grams, ascending, and counts; characters is how many different ones all languages of all groups have."""
    names = sorted(counts)
    tables: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
    own = counts
    for depth in range(ORDER):  # depth 0: 4-gram counts; below: how many distinct characters precede
        tables.append(own)
        mask = np.uint64((1 << (16 * (ORDER - depth - 1))) - 1)
        own = {x: (lambda g: (g[0], g[2].astype(float)))(_distinct(grams & mask, c)) for x, (grams, c) in own.items()}
    single = tables[ORDER - 1]
    alphabet = np.unique(np.concatenate([g for g, _ in single.values()]))
    size = characters + 1
    lower_grams = alphabet
    lower = np.empty((len(alphabet), len(names)))
    unseen = np.empty(len(names))
    for j, x in enumerate(names):
        grams, c = single[x]
        total = c.sum()
        discount = 0.5
        rest = discount * len(grams) / total
        lower[:, j] = rest / size
        lower[np.searchsorted(alphabet, grams), j] += (c - discount) / total
        unseen[j] = rest / size
    order = np.argsort(mixed(alphabet))
    floor, floor_hashes = np.log(lower)[order], mixed(alphabet)[order]
    levels: list[Level] = []
    fallback = np.exp(unseen * 0) * unseen
    for depth in range(ORDER - 2, -1, -1):
        table = tables[depth]
        every = np.unique(np.concatenate([g for g, _ in table.values()]))
        contexts = np.unique(every >> np.uint64(16))
        mask = np.uint64((1 << (16 * (ORDER - depth - 1))) - 1)
        at = np.minimum(np.searchsorted(lower_grams, every & mask), len(lower_grams) - 1)
        probability = np.where((lower_grams[at] == (every & mask))[:, None], lower[at], fallback)
        weight = np.ones((len(contexts), len(names)))
        for j, x in enumerate(names):
            grams, c = table[x]
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            place = np.searchsorted(contexts, grams >> np.uint64(16))
            total = np.bincount(place, c, len(contexts))
            types = np.bincount(place, minlength=len(contexts))
            seen = total > 0
            weight[seen, j] = discount * types[seen] / total[seen]
            probability[:, j] *= weight[np.searchsorted(contexts, every >> np.uint64(16)), j]
            i = np.searchsorted(every, grams)
            probability[i, j] += (c - discount) / total[place]
        by, of = np.argsort(mixed(every)), np.argsort(mixed(contexts))
        levels.insert(0, Level(mixed(every)[by], np.log(probability)[by].astype(np.float32), mixed(contexts)[of], np.log(weight)[of].astype(np.float32)))
        lower_grams, lower = every, probability
    return Group(names, levels, floor.astype(np.float32), floor_hashes, np.log(unseen).astype(np.float32))


#: Rows that Python takes up at a time.
ROWS = 512


@lean
def _count_grams(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n); a gram may come several times. About `most` grams of all languages together are held."""
    kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, n, _ = _distinct(np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts]))
        return grams, n.astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, [(grams, n)] in kept.items():
            for a in range(0, len(grams), 100_000):
                part = grams[a : a + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[a : a + 100_000])], ["lang", "gram", "n"])

    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            texts: dict[str, list[str | None]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                grams, n = np.unique(_grams(own)[0], return_counts=True)
                kept.setdefault(lang, []).append((grams, n))
                size += len(grams)
            if size > most:
                kept = {lang: [merged(parts)] for lang, parts in kept.items()}
                size = sum(len(parts[0][0]) for parts in kept.values())
                if size > most // 2:
                    yield from out()
                    kept, size = {}, 0
    kept = {lang: [merged(parts)] for lang, parts in kept.items()}
    yield from out()


def _drawn(rows: DataFrame, limit: int, what: str, most: int | None = None) -> DataFrame:
    """The rows that are drawn, and with `first` whether one is its language's first draw.

    Rows are drawn by hash of doc_id: about `limit` characters of each language, and its least hash in any
    case.  Where `most` is given, only that many languages are drawn from, those with most characters.
    """
    draw = F.pmod(F.xxhash64(F.lit(what), "doc_id"), F.lit(1 << 30))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("size"), F.min(draw).alias("least"))
    if most is not None:
        sizes = sizes.orderBy(F.col("size").desc(), "lang").limit(most)
    cut = F.when(F.col("size") <= limit, F.lit(1 << 30)).otherwise((F.lit(float(1 << 30)) * limit / F.col("size")).cast("long"))
    cuts = rows.sparkSession.createDataFrame(sizes.select("lang", cut.cast("long").alias("cut"), "least").toArrow())
    drawn = rows.join(F.broadcast(cuts), "lang").where((draw < F.col("cut")) | (draw == F.col("least")))
    return drawn.select(*rows.columns, (draw == F.col("least")).alias("first"))


def _grouped(sizes: dict[str, int], group: int) -> Iterator[list[str]]:
    """Languages in order, at most `group` together, and while their grams times their number is at most CELLS."""
    names, grams = [], 0
    for x in sorted(sizes):
        if names and (len(names) == group or (grams + sizes[x]) * (len(names) + 1) > CELLS):
            yield names
            names, grams = [], 0
        names.append(x)
        grams += sizes[x]
    if names:
        yield names


def _counts(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Ascending grams and their counts, by language."""
    lang = table.column(0).combine_chunks().dictionary_encode()
    place = lang.indices.to_numpy()
    grams, n = table.column(1).to_numpy().view(np.uint64), table.column(2).to_numpy()
    counts = {}
    for i, x in enumerate(lang.dictionary.to_pylist()):
        own = np.flatnonzero(place == i)
        own = own[np.argsort(grams[own])]
        counts[x] = (grams[own], n[own].astype(float))
    return counts


def train(labelled: DataFrame, max_chars: int = 10_000_000, calibration_chars: int = 1_000_000, max_languages: int | None = None, group: int = GROUP) -> LanguageModel:
    """A model from labelled (doc_id, text, lang); null and blank-named languages, null texts and texts without a letter are left out.

    Every language is learnt, however many there are: the counts are stored in the shared folder and
    become models group by group, of at most `group` languages each.  The fit reads a sample by hash of
    doc_id of about max_chars characters of each language; an eighth of the sampled documents, at most
    about calibration_chars of each language, is kept out of the counts and sets the score's temperature
    and the rejection limits.  At least one document of every language is counted, however few or long
    they are.  A caller who wants only the languages with most characters gives max_languages.  Nothing
    labelled gives a model of no languages.
    """
    spark = labelled.sparkSession
    ship(spark)
    text = F.coalesce("text", F.lit(""))
    rows = labelled.where(F.col("lang").isNotNull() & (F.trim("lang") != "") & text.rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sample = _drawn(rows, max_chars, "language-sample", max_languages)
    held = ~F.col("first") & (F.pmod(F.xxhash64(F.lit("language-calibration"), "doc_id"), F.lit(8)) == 0)
    counted = sample.where(~held).select("text", "lang").mapInArrow(_count_grams, "lang string, gram bigint, n bigint")
    counts = stored(counted.repartition("lang").groupBy("lang", "gram").agg(F.sum("n").alias("n")).sortWithinPartitions("lang", "gram"), "language-grams")
    sizes = {x: n for x, n in counts.groupBy("lang").count().collect()}
    characters = counts.select(F.col("gram").bitwiseAND(F.lit(0xFFFF))).distinct().count()
    model = LanguageModel(sorted(sizes), [])
    for names in _grouped(sizes, group):
        own = _counts(counts.where(F.col("lang").isin(names)).toArrow())
        model.groups.append(spark.sparkContext.broadcast(build_group(own, characters)))
    drop_stored(counts)
    if model.languages:
        calibrate(model, _drawn(sample.where(held).drop("first"), calibration_chars, "language-trial"))
    return model


def calibrate(model: LanguageModel, trial: DataFrame) -> None:
    """Sets the temperature of least log-loss on (text, lang), and by language the limit centre + spread / sqrt(n).

    Centre is 1.75 times the median cross-entropy of labelled texts, of all languages where one has no
    calibration text; spread is twice the 0.99 quantile of the excess of all of them over their
    languages' medians, scaled by sqrt(n), so a few odd texts do not move it.  Without calibration texts
    nothing is rejected but texts without letters.
    """
    place = {x: i for i, x in enumerate(model.languages)}

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in model.slices(batches):
            truths = [np.array([place.get(x, -1) for x in batch.column(1).to_pylist()], np.int64) for batch in held]
            for tally in model.tallies([batch.column(0).to_pylist() for batch in held], TEMPERATURES, truths):
                good = (tally.truth >= 0) & (tally.sizes > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tally.truth[good]), pa.array(tally.own[good]), pa.array(tally.sizes[good]), pa.array(list(tally.losses()[good]), pa.list_(pa.float64()))],
                    ["place", "e", "n", "losses"],
                )

    found = stored(trial.select("text", "lang").mapInArrow(measure, "place bigint, e double, n bigint, losses array<double>"), "language-trial")
    losses = found.agg(*[F.avg(F.col("losses")[i]) for i in range(len(TEMPERATURES))]).first()
    table = found.select("place", "e", "n").toArrow()
    drop_stored(found)
    if not table.num_rows:
        return
    model.temperature = TEMPERATURES[int(np.argmin(losses))]
    truth, own, sizes = (table.column(i).to_numpy() for i in range(3))
    by = np.argsort(truth, kind="stable")
    ends = np.searchsorted(truth[by], np.arange(len(place) + 1))
    middle = np.full(len(place), np.median(own))
    for i in np.unique(truth):
        middle[i] = np.median(own[by[ends[i] : ends[i + 1]]])
    excess = np.maximum(0.0, (own - middle[truth]) * np.sqrt(sizes))
    spread = 2 * float(np.quantile(excess, 0.99))
    model.limits = {x: (1.75 * float(middle[i]), spread) for x, i in place.items()}


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score (0 to 1), cross_entropy (nats per character) and rejected.

    The prediction reads the text alone.  Null texts and texts without a letter are 'und' with score 0
    and are rejected.  Ties go to the language first in order.  Columns of docs with these names are
    replaced; the rest pass through.
    """
    own = ("lang_pred", "score", "cross_entropy", "rejected")
    ship(docs.sparkSession)
    docs = docs.drop(*own)
    at, names_out = docs.columns.index("text"), [*docs.columns, *own]

    @lean
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in model.slices(batches):
            found = model.classify_all([batch.column(at).to_pylist() for batch in held])
            for batch, (names, score, entropy, rejected) in zip(held, found, strict=True):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], names_out)

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, *T._parse_datatype_string("lang_pred string, score double, cross_entropy double, rejected boolean").fields]))
