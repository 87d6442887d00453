"""License scan: phrases, and an exact set-similarity join of text blocks with license templates (operator 9).

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Base labels come from phrases
whose words stand consecutively. The method adds labels of two kinds:

Templates (license texts, openings, notices). A block is found where it holds at least ``CONTAINMENT`` of a
template's distinct words. Blocks follow the template: of a template of L words they are the windows of 2 L words
that begin at every multiple of L, so any passage of L words lies whole in one of them. Every block that meets the
threshold is returned. Templates of one family share most of their words (GPL and LGPL notices, the Creative
Commons licenses), so blocks that overlap are rivals: a block gives its label unless a rival of another label
holds a larger share of its own template, or as large a share of a template with all the words and more.

Titles ("apache license", SPDX lines) are too short to be told apart as sets, so they are phrases too, longest
first. A title without a version gives its label where no version of it was found.

The join is exact. Template words are ordered by their frequency in the whole corpus (one counting pass, sums
of some hundred counters), rarest first. Of a template with n distinct words a matching block has
need = ceil(CONTAINMENT * n), so it misses at most n - need of them, and of the first n - need + k it holds at
least k: only blocks with k such prefix words are candidates (prefix and positional filter). A candidate must have
``need`` known words at all (length filter). What is left is verified by counting.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, license_texts, words

CONTAINMENT = 0.8
#: Longer template texts are cut into pieces of about this many words, each a template.
PIECE = 250
#: Fewer distinct words would be met by chance; such a text belongs to the titles.
FEWEST = 12

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Names that licenses go by, as words.
NAMES = {
    "apache": ["apache license", "apache software license"],
    "apache-2.0": ["apache license 2 0", "apache license version 2", "apache license version 2 0", "apache license v2", "apache license v2 0"],
    "mit": ["mit license", "expat license"],
    "bsd": ["bsd license", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd"],
    "isc": ["isc license"],
    "zlib": ["zlib license"],
    "unlicense": ["the unlicense"],
    "gpl": ["gnu gpl", "gplv2", "gplv3"],
    "lgpl": ["lesser general public license", "library general public license", "lgpl", "lgplv2", "lgplv3"],
    "agpl": ["affero general public license", "agpl", "agplv3"],
    "gfdl": ["free documentation license"],
    "mpl": ["mozilla public license"],
    "mpl-1.1": ["mozilla public license 1 1", "mozilla public license version 1 1"],
    "mpl-2.0": ["mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0"],
    "epl": ["eclipse public license"],
    "bsl": ["boost software license"],
    "artistic": ["artistic license"],
    "cc0": ["cc0", "creative commons zero"],
    "cc-by": ["creative commons attribution"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives"],
}
#: Labels whose SPDX identifiers begin with the label's own words ("GPL-2.0-only").
SPDX = ["apache-2.0", "mit", "bsd", "isc", "zlib", "unlicense", "gpl", "lgpl", "agpl", "gfdl", "mpl-1.1", "mpl-2.0", "epl", "bsl", "artistic", "cc0", "cc-by", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"]
#: Families whose templates are rivals, by how their labels begin or end.
FAMILIES = ("gpl", "cc-by", "mpl", "apache")


def split(text: str) -> list[str]:
    """The words of a short text, as the scan sees them."""
    w = words.scan(pa.array([text]), words.NOT_ALNUM, lower=True)
    data = words.LOWER[w.data].tobytes()
    return [data[a:b].decode() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


def titles() -> dict[str, str]:
    """Title to label: the names, and the SPDX lines."""
    out = {name: label for label, names in NAMES.items() for name in names}
    out.update({" ".join(["spdx license identifier", *split(label.replace(".", "-"))]): label for label in SPDX})
    out["spdx license identifier cc0 1 0"] = "cc0"
    return out


def family(label: str) -> str:
    """Where rivals meet: the GNU and the Creative Commons licenses, versions of one license; else the label alone."""
    return next((f for f in FAMILIES if label.startswith(f) or label.endswith(f)), label)


class Index:
    """Templates with their words, prefixes in global order, and titles; goes to the tasks."""

    def __init__(self, texts: Iterable[tuple[str, str, str]] = license_texts.TEXTS, containment: float = CONTAINMENT):
        if not 0 < containment <= 1:
            raise ValueError("containment must be above 0 and at most 1")
        self.containment, self.names, self.labels, self.lengths, sets = containment, [], [], [], []
        for label, name, text in texts:
            w = split(text)
            pieces = max(math.ceil(len(w) / PIECE), 1)
            for i in range(pieces):
                piece = w[len(w) * i // pieces : len(w) * (i + 1) // pieces]
                if len(set(piece)) < FEWEST:
                    raise ValueError(f"template {label!r}, {name!r}: fewer than {FEWEST} distinct words")
                self.names.append(f"{label}: {name}" + (f", piece {i + 1}" if pieces > 1 else ""))
                self.labels.append(label)
                self.lengths.append(len(piece))
                sets.append(set(piece))
        self.titles = [(t.split(), label) for t, label in sorted(titles().items(), key=lambda x: (-len(x[0].split()), x[0]))]
        vocabulary = sorted(set().union(*sets, *(t for t, _ in self.titles), *(p.split() for p in PHRASES)))
        place = {w: i for i, w in enumerate(vocabulary)}
        h = words.hash_of(vocabulary)
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.sets = [np.array(sorted(place[w] for w in s)) for s in sets]
        self.titles = [([place[w] for w in t], label) for t, label in self.titles]
        self.phrases = [([place[w] for w in p.split()], label) for p, label in PHRASES.items()]
        self.member = np.zeros((len(sets), len(vocabulary) + 1), bool)  # the last column: words of no template
        for t, s in enumerate(self.sets):
            self.member[t, s] = True
        self.in_any = self.member.any(0)
        self.heads = np.zeros(len(vocabulary) + 1, bool)
        self.heads[[t[0] for t, _ in (*self.titles, *self.phrases)]] = True
        self.family = [family(label) for label in self.labels]
        self.need = [math.ceil(containment * len(s) - 1e-9) for s in self.sets]
        self.rank_by(np.zeros(len(vocabulary), np.int64))

    def rank_by(self, frequency: np.ndarray) -> None:
        """Sets the global order, rarest first, and with it each template's prefix. Any order gives the same result."""
        rank = np.empty(len(frequency), np.int64)
        rank[np.lexsort((np.arange(len(frequency)), frequency))] = np.arange(len(frequency))
        self.least, self.prefix = [], np.zeros_like(self.member)
        for t, s in enumerate(self.sets):
            k = min(max(len(s) // 5, 1), self.need[t])
            self.least.append(k)
            self.prefix[t, s[np.argsort(rank[s])][: len(s) - self.need[t] + k]] = True
        self.in_prefix = self.prefix.any(0)

    def known(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary's word (its index) each hash stands for, or -1."""
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.order[at], -1)

    def phrase_places(self, known: np.ndarray, left: np.ndarray, heads: np.ndarray, phrase: list[int]) -> np.ndarray:
        """Where the phrase's words stand consecutively in one text. ``left``: words from a place to its text's end."""
        at = heads[(known[heads] == phrase[0]) & (left[heads] >= len(phrase))]
        for j in range(1, len(phrase)):
            at = at[known[at + j] == phrase[j]]
        return at

    def blocks(self, known: np.ndarray, owner: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Every (template, block's first word, block's end, template words in it) that meets the threshold; places are those of ``known``."""
        hits = np.flatnonzero(self.in_prefix[known])
        if not len(hits):
            return
        word, text = known[hits], owner[hits]
        seen = np.concatenate([[0], np.cumsum(self.in_any[known])])
        for t, length in enumerate(self.lengths):
            mine = np.flatnonzero(self.prefix[t, word])
            if len(mine) < self.least[t]:
                continue
            begin = first[text[mine]]
            b = (hits[mine] - begin) // length
            # a block and the word: one number, so that a word counts once
            both = np.concatenate([begin + b * length, (begin + (b - 1) * length)[b > 0]]), np.concatenate([word[mine], word[mine][b > 0]])
            pairs = np.unique(both[0] * len(self.in_any) + both[1])
            start, n = np.unique(pairs // len(self.in_any), return_counts=True)
            start = start[n >= self.least[t]]
            end = np.minimum(start + 2 * length, first[owner[start] + 1])
            enough = seen[end] - seen[start] >= self.need[t]
            for a, z in zip(start[enough].tolist(), end[enough].tolist(), strict=True):
                block = known[a:z]
                shared = len(np.unique(block[self.member[t, block]]))
                if shared >= self.need[t]:
                    yield t, a, z, shared

    def settled(self, found: list[tuple[int, int, int, int]]) -> set[str]:
        """The labels of one text's blocks, rivals settled."""
        out = set()
        rivals: dict[str, list] = {}
        for m in found:
            rivals.setdefault(self.family[m[0]], []).append(m)
        for group in rivals.values():
            if len({self.labels[m[0]] for m in group}) == 1:
                out.add(self.labels[group[0][0]])
                continue
            group.sort(key=lambda m: m[1])
            reach = max(m[2] - m[1] for m in group)
            begins = np.array([m[1] for m in group])
            for m in group:
                if self.labels[m[0]] in out:
                    continue
                near = group[int(np.searchsorted(begins, m[1] - reach)) : int(np.searchsorted(begins, m[2]))]
                if not any(self._beats(r, m) for r in near if r[2] > m[1] and self.labels[r[0]] != self.labels[m[0]]):
                    out.add(self.labels[m[0]])
        return out

    def _beats(self, r: tuple, m: tuple) -> bool:
        mine, theirs = m[3] * len(self.sets[r[0]]), r[3] * len(self.sets[m[0]])  # shares over one denominator
        return theirs > mine or (theirs == mine and len(self.sets[r[0]]) > len(self.sets[m[0]]) and bool(self.member[r[0], self.sets[m[0]]].all()))


def frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """How often each word of the vocabulary occurs in all texts."""
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.hash), np.int64)
        for part in common.chunks(batches, size=3 << 20):
            k = index.known(words.scan(part.column(1), words.NOT_ALNUM, lower=True).hash)
            total += np.bincount(k[k >= 0], minlength=len(total))
        yield common.batch_of(schema, np.arange(len(total), dtype=np.int32), total)

    out = np.zeros(len(index.hash), np.int64)
    for r in common.texts(docs).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # one row a word of the vocabulary
        out[r.word] = r.n
    return out


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
BLOCKS = "array<struct<template: string, label: string, first_word: long, n_words: long, share: double>>"
_BLOCK = pa.struct([("template", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])
_COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(_BLOCK))])


def scan(docs: DataFrame, containment: float = CONTAINMENT, templates: Iterable[tuple[str, str, str]] = license_texts.TEXTS) -> DataFrame:
    """Labels of every whole text, and every block that meets a template.

    ``templates``: label, name and text of each license text to look for; long ones (whole licenses) are cut into
    pieces. score: 1 with a base phrase or a title, else the largest share of a template in any block of ``blocks``,
    else 0. Null and empty texts have no words, labels (empty strings) or blocks. Repeated rows get equal rows, an
    empty table gives none, other columns stay out. Ties between templates give both labels.
    """
    index = Index(templates, containment)
    index.rank_by(frequencies(docs, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, size=3 << 20):
            w = words.scan(part.column(1), words.NOT_ALNUM, lower=True)
            n, owner, known = part.num_rows, w.owner, index.known(w.hash)
            left = np.repeat(w.first[1:], w.counts) - np.arange(len(owner))
            heads = np.flatnonzero(index.heads[known])
            base: list[set[str]] = [set() for _ in range(n)]
            places = [np.zeros(0, np.int64)]
            for phrase, label in index.phrases:
                places.append(index.phrase_places(known, left, heads, phrase))
                for i in np.unique(owner[places[-1]]).tolist():
                    base[i].add(label)
            at = np.sort(np.concatenate(places))
            n_base = np.bincount(owner[at], minlength=n)
            lo, hi = np.full(n, -1), np.full(n, -1)
            hi[owner[at]] = at  # ascending: the last assignment stays
            lo[owner[at[::-1]]] = at[::-1]
            labels, sure = [set(b) for b in base], n_base > 0
            taken: set[int] = set()
            for title, label in index.titles:  # longest first: a title that begins where a longer one does is part of it
                for p in index.phrase_places(known, left, heads, title).tolist():
                    if p not in taken:
                        taken.add(p)
                        labels[owner[p]].add(label)
                        sure[owner[p]] = True
            found: list[list] = [[] for _ in range(n)]
            for m in index.blocks(known, owner, w.first):
                found[owner[m[1]]].append(m)
            score, blocks = np.where(sure, 1.0, 0.0), []
            for i, f in enumerate(found):
                rows = [{"template": index.names[t], "label": index.labels[t], "first_word": a - int(w.first[i]), "n_words": z - a, "share": k / len(index.sets[t])} for t, a, z, k in f]
                blocks.append(sorted(rows, key=lambda r: (r["first_word"], r["template"])))
                if f:
                    labels[i] |= index.settled(f)
                    score[i] = max(score[i], *(r["share"] for r in rows))
                labels[i] = {x for x in labels[i] if x in base[i] or x not in ("apache", "mpl") or not any(y.startswith(x + "-") for y in labels[i])}
            none = n_base == 0
            join = lambda sets: [",".join(sorted(s)) for s in sets]
            yield common.batch_of(_COLUMNS, part.column(0), w.counts, n_base.astype(np.int64), pa.array(lo - w.first[:-1], mask=none), pa.array(hi - w.first[:-1], mask=none), join(base), join(labels), score, pa.array(blocks, _COLUMNS.field("blocks").type))

    return common.texts(docs).mapInArrow(run, f"{COLUMNS}, blocks {BLOCKS}")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir))
    return found.select(*(c for c in found.columns if c != "blocks"), F.size("blocks").cast("long").alias("n_blocks"))
