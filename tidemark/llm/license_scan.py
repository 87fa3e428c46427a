"""Licence scanning with a generalised suffix automaton of licence tokens.

The automaton accepts every run of words of every template.  A file is streamed through it, which gives
for each word the longest run ending there that some template holds (matching statistics); long runs of
one template in its own order are chained into covered spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship
from .license_texts import TEMPLATES

#: Phrases whose words, standing consecutively, give a label by themselves.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class SuffixAutomaton:
    """A generalised suffix automaton over integer tokens; each state knows which texts hold its runs, and one end in each."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for number, text in enumerate(texts):
            last = 0
            for at, token in enumerate(text):
                last = self._extend(last, token)
                self.ends[last].setdefault(number, at)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            up = self.link[state]
            for number, at in self.ends[state].items():
                self.ends[up][number] = min(at, self.ends[up].get(number, at))

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            to = self.next[last][token]
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, token, to)
        state = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = state
            at = self.link[at]
        if at >= 0:
            to = self.next[at][token]
            self.link[state] = to if self.length[to] == self.length[at] + 1 else self._clone(at, token, to)
        return state

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.link) - 1

    def _clone(self, at: int, token: int, to: int) -> int:
        twin = self._state(dict(self.next[to]), self.length[at] + 1, self.link[to])
        self.link[to] = twin
        while at >= 0 and self.next[at].get(token) == to:
            self.next[at][token] = twin
            at = self.link[at]
        return twin

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest run of any text that ends at each token."""
        state = length = 0
        out = []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            else:
                length = 0
            out.append((length, state))
        return out


class LicenseIndex:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, least_run: int = 5, least_cover: float = 0.6, gap: int = 12):
        self.labels = [label for label, _ in templates]
        texts = [words(t) for _, t in templates]
        self.vocabulary: dict[bytes, int] = {}
        for w in (w for t in texts for w in t):
            self.vocabulary.setdefault(w, len(self.vocabulary))
        self.sizes = [len(t) for t in texts]
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in t] for t in texts])
        self.phrases = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in phrases]
        self.least_run, self.least_cover, self.gap = least_run, least_cover, gap

    def spans(self, own: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, first word, past the last word, template words covered) of chained runs, by place."""
        get = self.vocabulary.get
        ids = [get(w, -1) for w in own]
        known = np.array(ids) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        runs: list[tuple[int, int, int, int]] = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a < self.least_run:
                continue
            found = self.automaton.statistics(ids[a:b])
            for i, (length, state) in enumerate(found):
                # a run is told of where it cannot be longer
                if length >= self.least_run and (i + 1 == len(found) or found[i + 1][0] <= length):
                    for number, end in self.automaton.ends[state].items():
                        runs.append((number, int(a) + i - length + 1, int(a) + i + 1, end - length + 1))
        chains: list[list[int]] = []  # template, first, past, next place in the template, covered
        open_: dict[int, int] = {}
        for number, first, past, at in sorted(runs, key=lambda r: (r[1], -r[2], r[0])):
            chain = chains[open_[number]] if number in open_ else None
            if chain and first - chain[2] <= self.gap and past > chain[2] and at + (past - first) > chain[3]:
                chain[4] += min(past - max(first, chain[2]), at + past - first - max(at, chain[3]))
                chain[2], chain[3] = past, at + past - first
            elif not chain or first >= chain[2]:
                open_[number] = len(chains)
                chains.append([number, first, past, at + past - first, past - first])
        return [(n, first, past, covered) for n, first, past, _, covered in chains]

    def scan(self, text: str | None) -> dict:
        own = words(text)
        line = b" " + b" ".join(own) + b" "
        places: list[int] = []
        base: set[str] = set()
        for phrase, label in self.phrases:
            at, seen, place = line.find(phrase), 0, 0
            while at >= 0:
                place, seen = place + line.count(b" ", seen, at), at
                places.append(place)
                base.add(label)
                at = line.find(phrase, at + 1)
        spans = self.spans(own) if len(own) >= self.least_run else []
        shares = [(n, first, past, covered, covered / self.sizes[n]) for n, first, past, covered in spans]
        good = [s for s in shares if s[4] >= self.least_cover]
        # of templates that cover the same words, those that are covered best tell
        good = [s for s in good if not any(o[1] <= s[1] and s[2] <= o[2] and (o[3], o[4]) > (s[3], s[4]) for o in good)]
        score = max([1.0 * bool(places), *(min(1.0, s[4]) for s in shares)])
        return {"n_words": len(own), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {self.labels[s[0]] for s in good})), "score": score, "license_spans": [{"label": self.labels[n], "first": first, "stop": past, "share": share} for n, first, past, _, share in good]}


FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, license_spans array<struct<label:string,first:bigint,stop:bigint,share:double>>"


def scan_licenses(docs: DataFrame, index: LicenseIndex | None = None) -> DataFrame:
    """docs with the columns of FIELDS; the rest pass through, those of these names are replaced.

    Null text has no words: zero counts, null places, empty labels, score 0.  score is 1 where a phrase
    stands, else the largest share of a template that one chain covers; labels are those of phrases and of
    templates of which least_cover is covered.
    """
    ship(docs.sparkSession)
    fields = T._parse_datatype_string(FIELDS)
    docs = docs.drop(*fields.names)
    index = index or LicenseIndex()
    place, names = docs.columns.index("text"), [*docs.columns, *fields.names]
    # the automaton is small, and bounded by the templates
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            rows = [index.scan(t) for t in batch.column(place).to_pylist()]
            made = [pa.array([r[f] for r in rows], kind) for f, kind in zip(names[-len(kinds) :], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *fields.fields]))
