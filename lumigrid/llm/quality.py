"""Quality rules by distribution divergence (operator 8).

Two histograms describe a text: character classes (from its bytes) and common words of four languages. The
languages' references are fixed and not gathered from the corpus, so neither a hot source nor copies can pull
them: a verdict depends on its own text only. A text is kept if it passes the base rules and its Jensen-Shannon
distance (square root of the divergence, base 2) to the nearest reference is within the limit, for both
histograms. A short text's histogram is ragged: chance alone adds about a constant over its length to the
divergence, even for a text drawn from the reference. That part (``CHAR_CHANCE``, ``WORD_CHANCE``) is taken off, so
one limit serves all lengths; below a minimum length a test passes. A text whose language column names another language has no reference and passes both tests.

Base rules: at least 20 words; at most 30 % of the words in 8-word windows that occur twice or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

#: Common words of the languages, in the order whose ranks the references use.
COMMON = {
    "en": "the of and to a in is that it for was on are as with his they at be this from or had by not but what all were we when your can said there an which she do how their if will up about then them these so her would him has more who did its than been he you have i",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son lui nous comme mais on leur elle été cette ces si aux même ses sans être deux fait entre",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde",
}
MIN_CHARS, MIN_WORDS = 200, 80
#: What chance adds to the divergence of n characters or words, times n: occupied classes less one over 8 ln 2. Twelve
#: classes of characters; of the listed words some thirty occur in a passage.
CHAR_CHANCE, WORD_CHANCE = 2.0, 6.0
#: About the highest of the languages' 99th percentiles over passages of 200 words of real prose (see ``MEASURED``).
CHAR_LIMIT, WORD_LIMIT = 0.2, 0.38
#: Vowels and consonants among a language's characters (accented letters count as consonants), and the other classes of running prose.
LETTERS = {"en": (0.305, 0.49), "de": (0.305, 0.50), "fr": (0.37, 0.42), "es": (0.37, 0.42)}
REST = (0.02, 0.004, 0.16, 0.004, 0.011, 0.011, 0.001, 0.006, 0.0, 0.0)
#: Shares of all twelve classes, measured over manual pages of a Debian system (en: also Python's language
#: manual and license texts), 9,000 (es) to 280,000 (en) words of each language. The limits come from passages of
#: plain prose: other English pages, but both halves of the other texts, so they aren't wholly held out.
MEASURED = {
    "en": (0.277, 0.452, 0.041, 0.010, 0.155, 0.004, 0.011, 0.010, 0.0, 0.024, 0.016, 0.0),
    "de": (0.288, 0.459, 0.060, 0.010, 0.130, 0.004, 0.011, 0.012, 0.0, 0.018, 0.008, 0.0),
    "fr": (0.305, 0.458, 0.026, 0.010, 0.148, 0.004, 0.012, 0.009, 0.0, 0.022, 0.007, 0.0),
    "es": (0.329, 0.434, 0.026, 0.010, 0.151, 0.004, 0.011, 0.010, 0.0, 0.016, 0.010, 0.0),
}
#: Share of the common words and power of their rank, in texts full of names and terms, in running
#: prose, and fitted to the measured texts of each language.
STYLES = ((0.24, 1.2), (0.5, 1.0))
FITTED = {"en": (0.32, 1.1), "de": (0.28, 0.9), "fr": (0.32, 0.9), "es": (0.32, 1.0)}
_DUP = 8

_CLASSES = 12
_CLASS = np.full(256, 11, np.uint8)
for _i, _set in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"'\"()-", b"#*$%&|<>@^~_\\/=+`[]{}")):
    _CLASS[list(_set)] = _i
_CLASS[0xC0:] = 1  # a letter's first byte
_SKIP = words.table_of((0x80, 0xBF))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_LISTED = sorted({w for text in COMMON.values() for w in text.split()})
_HASH = words.hash_of(_LISTED)
_ORDER = np.argsort(_HASH)
_HASH = _HASH[_ORDER]


def _repeated(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal another one of their text, and which equal an earlier one."""
    both = words.mix(key + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts and both histograms of each text."""
    w = words.scan(texts)
    n = len(texts)
    inside = ~words.SPACES[w.data] & ~_SKIP[w.data]
    starts, ends = words.runs(w.data, w.bounds, words.NEWLINE)
    ink = np.concatenate([[0], np.cumsum(~words.SPACES[w.data])])
    full = ink[ends] > ink[starts]
    starts, ends = starts[full], ends[full]
    owner = np.searchsorted(w.bounds, starts, "right") - 1
    dup = _repeated(owner, words.hashes(w.data, starts, ends))[1]
    window, at = w.windows(_DUP)
    again = at[_repeated(w.owner[at], window)[0]]
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, np.minimum(again + _DUP, len(w.hash)), -1)
    covered = np.cumsum(edge)[:-1] > 0
    lower = words.LOWER[w.data]
    shown = ~_SKIP[w.data]
    text_of = np.repeat(np.arange(n), np.diff(w.bounds))
    chars = np.bincount(text_of[shown] * _CLASSES + _CLASS[w.data[shown]], minlength=n * _CLASSES).reshape(n, _CLASSES)
    h = words.hashes(lower, w.starts, w.ends)
    at = np.minimum(np.searchsorted(_HASH, h), len(_HASH) - 1)
    hit = _HASH[at] == h
    listed = np.bincount(w.owner[hit] * len(_LISTED) + _ORDER[at[hit]], minlength=n * len(_LISTED)).reshape(n, len(_LISTED))
    repeat = words.per_text(covered, w.first)
    return {
        "n_words": w.counts, "word_chars": words.per_text(inside, w.bounds), "n_symbols": words.per_text(_SYMBOL[w.data], w.bounds), "n_dup_lines": np.bincount(owner[dup], minlength=n), "n_repeat_words": repeat,
        "base_failed": (w.counts < 20) | (100 * repeat > 30 * w.counts), "chars": chars, "listed": listed,
    }


def _word_histogram(listed: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.concatenate([listed, (n_words - listed.sum(1))[:, None]], 1).astype(float)


def references() -> tuple[np.ndarray, np.ndarray]:
    """Reference histograms of each language: two of characters, and one of words for each style."""
    words_of = []
    for language, text in COMMON.items():
        ranked = text.split()
        for share, power in (*STYLES, FITTED[language]):
            h = np.zeros(len(_LISTED) + 1)
            rate = np.arange(1, len(ranked) + 1) ** -power
            h[[_LISTED.index(x) for x in ranked]] = share * rate / rate.sum()
            h[-1] = 1 - share
            words_of.append(h)
    chars = np.array([row for n in COMMON for row in ([*LETTERS[n], *REST], MEASURED[n])])
    return chars / chars.sum(1)[:, None], np.array(words_of)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of rows of ``p`` to the histogram ``q`` (both sum to 1), from 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


VERDICTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_VERDICTS = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in _COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])


_CHARS, _WORDS = references()


def _foreign(languages: pa.Array) -> np.ndarray:
    """Which rows name a language without a reference (``en-US`` is ``en``; null, empty and ``und``: not known, so any may be nearest)."""
    code = {x: (x or "und").strip().lower().replace("_", "-").split("-")[0] or "und" for x in set(languages.to_pylist())}
    return np.array([code[x] not in COMMON and code[x] != "und" for x in languages.to_pylist()], bool)


def _verdict(m: dict[str, np.ndarray], foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kept and both distances, from counts and histograms."""
    n = m["n_words"]

    def near(h: np.ndarray, references: np.ndarray, chance: float) -> np.ndarray:
        size = np.maximum(h.sum(1), 1)
        far = np.min([np.ones(len(h)), *(distance(h / size[:, None], r) for r in references)], 0)
        return np.sqrt(np.maximum(far**2 - chance / size, 0))

    c, w = near(m["chars"], _CHARS, CHAR_CHANCE), near(_word_histogram(m["listed"], n), _WORDS, WORD_CHANCE)
    good = foreign | (((m["word_chars"] < MIN_CHARS) | (c <= CHAR_LIMIT)) & ((n < MIN_WORDS) | (w <= WORD_LIMIT)))
    return good & ~m["base_failed"], c, w


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, columns unchanged; the verdicts are those of ``judge``. Null and empty texts go, repeated rows stay or go together."""
    common.ship(docs.sparkSession)
    language = docs.schema.names.index("lang") if "lang" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for part in common.chunks(batches, size=1 << 20):
            foreign = _foreign(part.column(language).cast(pa.string())) if language >= 0 else np.zeros(part.num_rows, bool)
            yield part.filter(pa.array(_verdict(measure(part.column(part.schema.get_field_index("text"))), foreign)[0]))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame) -> DataFrame:
    """The counts, distances and verdict of each document, in one pass.

    Null and empty texts have no words and fail the base rules. The distances are those to the nearest reference less
    the part of chance, also where the language column names another language; they don't decide there. Repeated rows
    get equal rows, an empty table gives none.
    """
    language = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, size=1 << 20):
            m = measure(part.column(1))
            yield common.batch_of(_VERDICTS, part.column(0), *(m[k].astype(np.int64) for k in _COUNTS), m["base_failed"], *_verdict(m, _foreign(part.column(2))))

    return common.texts(docs, language.alias("lang")).mapInArrow(run, VERDICTS)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir))
