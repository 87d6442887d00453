"""Quality, licenses, personal data, mixing, chat and media against plain Python."""

import gzip
import hashlib
import math
import pathlib
import pydoc_data.topics
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumigrid.llm import chat, flac, license_texts, licenses, media, mixing, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    s = text or ""
    w = WORD.findall(s)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in s.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_quality_counts(odd, odd_rows, small, small_rows):
    for docs, rows in ((odd, [(r[0], r[1]) for r in odd_rows]), (small, [(d, r.text) for d, r in small_rows.items()])):
        got = [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in quality.judge(docs).collect()]
        assert sorted(map(str, got)) == sorted(map(str, [(d, _base(t)) for d, t in rows]))


def test_quality_keeps_prose_and_drops_symbols(spark, small):
    verdict = {r.doc_id: r for r in quality.judge(small).collect()}
    good = [r for r in verdict.values() if not r.base_failed]
    assert sum(r.kept for r in good) > 0.8 * len(good)
    junk = small.filter("n_chars > 500").orderBy("doc_id").limit(25).withColumn("text", F.replace("text", F.lit(" "), F.lit("### $$$ "))).withColumn("doc_id", F.col("doc_id") + 10_000)
    out = quality.judge(small.unionByName(junk)).filter("doc_id >= 10000").collect()
    assert not any(r.kept for r in out) and out
    kept = {r.doc_id for r in quality.keep(small).collect()}
    assert kept == {d for d, r in verdict.items() if r.kept}


def test_quality_of_a_hot_junk_source(spark, small):
    """Junk with a third of all rows and over half of one language changes no verdict, and none of it stays."""
    before = {r.doc_id: r.kept for r in quality.judge(small).collect()}
    prose = small.filter("lang = 'en'").count()
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("###w"), i.cast("string"), F.lit("$$$"), (F.col("id") % 9).cast("string"))))
    junk = spark.range(150).select((F.col("id") + 10_000).alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    docs = small.select(junk.columns).unionByName(junk)
    assert 150 > prose and 3 * 150 > docs.count()
    after = {r.doc_id: (r.kept, r.base_failed) for r in quality.judge(docs).collect()}
    assert not any(kept or failed for d, (kept, failed) in after.items() if d >= 10_000)
    assert {d: kept for d, (kept, _) in after.items() if d < 10_000} == before
    assert {r.doc_id for r in quality.keep(docs).collect()} == {d for d, kept in before.items() if kept}
    assert quality.judge(small.limit(0).select(junk.columns).unionByName(junk)).filter("kept").count() == 0


def _plain_verdict(text, language):
    """kept and both distances of one text, from its characters and words."""
    text = text or ""
    w = WORD.findall(text)
    ascii_lower = [x.translate({c: c + 32 for c in range(65, 91)}) for x in w]
    sets = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "'\"()-", "#*$%&|<>@^~_\\/=+`[]{}"]
    chars = [0] * 12
    for ch in text:
        chars[1 if ord(ch) > 127 else next((i for i, x in enumerate(sets) if ch in x), 11)] += 1
    log = lambda p, m: p * math.log2(p / m) if p else 0.0

    def near(counts, references, chance):
        size = max(sum(counts.values()), 1)
        p = {k: v / size for k, v in counts.items()}
        best = 1.0
        for q in references:
            mid = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
            d = sum(log(p.get(k, 0), m) + log(q.get(k, 0), m) for k, m in mid.items()) / 2
            best = min(best, math.sqrt(min(max(d, 0), 1)))
        return math.sqrt(max(best**2 - chance / size, 0))

    char_refs, word_refs = [], []
    for lang, common in quality.COMMON.items():
        for row in ((*quality.LETTERS[lang], *quality.REST), quality.MEASURED[lang]):
            char_refs.append({i: x / sum(row) for i, x in enumerate(row)})
        for share, power in (*quality.STYLES, quality.FITTED[lang]):
            rates = [(i + 1) ** -power for i in range(len(common.split()))]
            word_refs.append({**{x: share * r / sum(rates) for x, r in zip(common.split(), rates, strict=True)}, None: 1 - share})
    listed = {x for t in quality.COMMON.values() for x in t.split()}
    c = near(dict(enumerate(chars)), char_refs, quality.CHAR_CHANCE)
    words_of = {None: 0}
    for x in ascii_lower:
        k = x if x in listed else None
        words_of[k] = words_of.get(k, 0) + 1
    d = near(words_of, word_refs, quality.WORD_CHANCE)
    foreign = (language or "und").lower().split("-")[0] not in (*quality.COMMON, "und")
    inside = sum(map(len, w))
    good = foreign or ((inside < quality.MIN_CHARS or c <= quality.CHAR_LIMIT) and (len(w) < quality.MIN_WORDS or d <= quality.WORD_LIMIT))
    return good and not _base(text)[5], c, d


def test_quality_verdicts_equal_plain_python(odd, odd_rows, small, small_rows):
    for docs, rows in ((odd, [(r[0], r[1], r[2]) for r in odd_rows]), (small, [(d, r.text, r.lang) for d, r in small_rows.items()])):
        key = lambda r: (str(r[0]), r[1:])
        got = sorted(((r.doc_id, r.kept, r.char_distance, r.word_distance) for r in quality.judge(docs).collect()), key=key)
        want = sorted(((d, *_plain_verdict(t, lang)) for d, t, lang in rows), key=key)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-6)


def _paragraphs(text):
    found = (" ".join(p.split()) for p in re.split(r"\n\s*\n", text))
    return [p for p in found if len(p.split()) >= 30 and p.endswith(".") and p[0].isupper() and not p.isupper()]


def _manual_pages(language):
    for f in sorted(pathlib.Path("/usr/share/man", language).glob("man*/*.gz"))[::2]:
        t = re.sub(r"\\f[A-Z(]|\\f\[[A-Z]*\]|\\&", "", gzip.open(f).read().decode("utf-8", "replace")).replace("\\-", "-")
        yield re.sub(r"(?m)^[.'].*$", "\n", re.sub(r"(?m)^\.[BI]R? (.*)$", r"\1", re.sub(r"\\\[..\]|\\\(..|\\.", "", t)))


@pytest.mark.parametrize("language", ["en", "de", "fr", "es"])
def test_quality_keeps_real_prose(language):
    """Under 3 % of passages of 200 words are rejected; the same words with a symbol each all are."""
    texts = list(pydoc_data.topics.topics.values()) if language == "en" else list(_manual_pages(language))
    passages = []
    for t in texts:
        w = " ".join(_paragraphs(t)).split()
        passages += [" ".join(w[i : i + 200]) for i in range(0, len(w) - 199, 200)]
    if len(passages) < 10:
        pytest.skip("too few texts of the language on this machine")
    known = np.zeros(len(passages), bool)
    m = quality.measure(pa.array(passages))
    rejected = ~m["base_failed"] & ~quality._verdict(m, known)[0]
    assert rejected.sum() < 0.03 * len(passages)
    junk = quality.measure(pa.array([p.replace(" ", "### ") for p in passages]))
    assert not quality._verdict(junk, known)[0].any()


def test_quality_passes_languages_without_a_reference(spark):
    text = " ".join(f"日本語{i}文章" for i in range(150))
    docs = spark.createDataFrame([(0, text, "ja"), (1, text, "en"), (2, "short", "ja"), (3, text, "en-US"), (4, text, None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.keep(docs).collect()} == {r.doc_id for r in quality.judge(docs).filter("kept").collect()} == {0}


def test_distance_is_a_distance():
    p, q = np.array([[0.5, 0.5, 0], [0, 0, 1.0]]), np.array([0.5, 0.5, 0])
    assert quality.distance(p, q).tolist() == [0.0, 1.0]


def _phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


def test_licenses(odd, odd_rows, small, small_rows):
    for docs, rows in ((odd, [(r[0], r[1]) for r in odd_rows]), (small, [(d, r.text) for d, r in small_rows.items()])):
        out = licenses.scan(docs).collect()
        got = [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in out]
        assert sorted(map(str, got)) == sorted(map(str, [(d, _phrases(t)) for d, t in rows]))
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)


def _labels(spark, texts, **more):
    return {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more).collect()}


def _template(label, name):
    return next(t for x, n, t in license_texts.TEXTS if (x, n) == (label, name))


def test_license_labels_do_not_cross(spark):
    want = {
        "Released under the MIT license.": "mit",
        "The film was released under a new name after the driver lost the license he had": "",
        "released under the bsd license": "bsd",
        "Under the old rules the bsd kernel team kept the license file elsewhere": "",
        "The BSD vendors released it in spring under the license": "",
        "He studied at MIT and was released under the terms he liked, then wrote about the license of his dog": "",
        "Apache License Version 2.0": "apache-2.0",
        "the Apache License of the project": "apache",
        "Licensed under the Mozilla Public License 2.0": "mpl-2.0",
        "GNU AGPL v3": "agpl",
        "SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: GPL-2.0-only": "gpl",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "cc-by,cc-by-nc-sa",  # the base phrase "cc by" stays
        "Licensed under the GNU Lesser General Public License version 3": "gpl,lgpl",  # so does "general public license"
        _template("lgpl", "notice"): "gpl,lgpl",
        _template("cc-by", "notice"): "cc-by",
        _template("cc-by-nc-sa", "notice"): "cc-by-nc-sa",
        _template("isc", "text"): "isc",
        _template("mit", "text"): "mit",
        _template("bsd", "three clauses"): "bsd",
        _template("gpl", "notice") + " " + _template("lgpl", "notice"): "gpl,lgpl",
        _template("agpl", "notice"): "agpl,gpl",
    }
    got = _labels(spark, want)
    assert {t: got[i].labels for i, t in enumerate(want)} == want


def test_whole_licenses_of_this_machine(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no license texts here")
    known = {"Apache-2.0": "apache-2.0", "Artistic": "artistic", "BSD": "bsd", "CC0-1.0": "cc0", "GFDL-1.2": "gfdl", "GFDL-1.3": "gfdl", "GPL-1": "gpl", "GPL-2": "gpl", "GPL-3": "gpl", "LGPL-2": "lgpl", "LGPL-2.1": "lgpl", "LGPL-3": "lgpl", "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2.0"}
    files = [n for n in known if (folder / n).is_file()]
    whole = [(folder / n).read_text(errors="replace") for n in files]
    got = _labels(spark, whole)
    assert all(known[n] in got[i].labels.split(",") for i, n in enumerate(files))
    # whole licenses as templates: cut in pieces, each found at its place
    got = _labels(spark, ["before " * 300 + t for t in whole], templates=[(known[n], n, t) for n, t in zip(files, whole, strict=True)])
    for i, n in enumerate(files):
        pieces = -(-len(licenses.split(whole[i])) // licenses.PIECE)
        want = {f"{known[n]}: {n}" + (f", piece {k + 1}" if pieces > 1 else "") for k in range(pieces)}
        assert {b.template for b in got[i].blocks if b.share == 1.0} >= want


def test_license_join_is_exact(spark):
    """Blocks, shares, labels and scores equal those of comparing every block with every template."""
    rnd = random.Random(3)
    texts = [None, "", "license"]
    for _, _, t in license_texts.TEXTS:
        w = licenses.split(t)
        for drop in (0, 0.1, 0.25, 0.4):
            kept = [x for x in w if rnd.random() >= drop]
            texts.append(" ".join(["filler", "the", "of"] * rnd.randint(0, 60) + kept + ["more", "and"] * rnd.randint(0, 60)))
    texts += [" ".join(rnd.sample(texts[3:], 5)), texts[9]]
    templates = [(label, f"{label}: {name}", licenses.split(t)) for label, name, t in license_texts.TEXTS]
    for containment in (0.8, 0.6):
        got = _labels(spark, texts, containment=containment)
        for i, text in enumerate(texts):
            w, want = licenses.split(text or ""), {}
            for label, name, t in templates:
                for b in range(0, len(w), len(t)):
                    block = w[b : b + 2 * len(t)]
                    shared = len(set(block) & set(t))
                    if shared >= containment * len(set(t)) - 1e-9:
                        want[name, b] = (label, len(block), shared / len(set(t)), set(t))
            assert {(b.template, b.first_word): (b.label, b.n_words, b.share) for b in got[i].blocks} == {k: v[:3] for k, v in want.items()}
            phrases = _phrases(text)[4]
            labels, titles, taken = set(filter(None, phrases.split(","))), [], set()
            for title, label in sorted(licenses.titles().items(), key=lambda x: -len(x[0].split())):
                p = title.split()
                at = {j for j in range(len(w)) if w[j : j + len(p)] == p} - taken
                taken |= at
                titles += [label] * len(at)
            for (_, b), (label, n, share, t) in want.items():
                rivals = [v for (_, c), v in want.items() if v[0] != label and licenses.family(v[0]) == licenses.family(label) and c < b + n and b < c + v[1]]
                if not any(v[2] > share + 1e-12 or (abs(v[2] - share) < 1e-12 and t < v[3]) for v in rivals):
                    labels.add(label)
            labels |= set(titles)
            labels -= {x for x in ("apache", "mpl") if any(y.startswith(x + "-") for y in labels)}
            assert got[i].labels == ",".join(sorted(labels))
            assert got[i].score == (1.0 if phrases or titles else max((v[2] for v in want.values()), default=0.0))


def test_license_scan_of_a_long_text_and_settings(spark):
    notice = _template("isc", "grant")
    long = "words of a very long text " * 400_000 + notice + " and so on" * 100_000
    r = _labels(spark, [long])[0]
    assert r.labels == "isc" and r.score == 1.0 and r.n_words == len(long.split()) + 1  # "and/or"
    with pytest.raises(ValueError, match="distinct words"):
        licenses.Index([("x", "short", "too short a text")])
    with pytest.raises(ValueError, match="containment"):
        licenses.Index(containment=0)


def _personal(text):
    s, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_personal_data(odd, odd_rows, small, small_rows):
    for docs, rows in ((odd, [(r[0], r[1]) for r in odd_rows]), (small, [(d, r.text) for d, r in small_rows.items()])):
        got, want = [], []
        for r in pii.scan(docs).collect():
            got.append((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
            listed = [x for x in r.spans.split(",") if x]
            assert len(listed) >= r.n_email + r.n_ip + r.n_card + r.n_phone
        for d, t in rows:
            found = _personal(t)
            text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
            want.append((d, *(sum(f[0] == k for f in found) for k in ("email", "ip", "card", "phone")), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_personal_data_own_kinds_and_linear_time():
    base, own = pii.find("IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33; secret token = 0123456789abcdef0123456789abcdef; ssn 123-45-6789; 123-45-6780")
    assert [s[0] for s in own] == ["iban", "key", "ssn", "ssn"]
    assert pii.emails("a" * 300_000 + "@") == [] and pii.emails("a@b@c.de") == [(2, 8)]
    rnd = random.Random(4)
    for _ in range(3000):
        s = "".join(rnd.choice("a@.b-1 +%") for _ in range(rnd.randint(0, 14)))
        assert pii.emails(s) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]


#: Kind, pattern, words, prior, what a right checksum adds.
_PLAIN = [
    ("card15", r"[0-9]([\x20-]?[0-9])+", "card|amex|credit|karte|carte|tarjeta", 0.0, 0.35),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "iban|account|konto|compte|cuenta|bank", 0.2, 0.5),
    ("key", r"(?<![A-Za-z0-9_-])([0-9a-f]{32,}|(sk|pk|ghp|AKIA)[A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])", "token|secret|key|password|passwd|pwd|bearer|auth", 0.2, 0.0),
    ("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "ssn|social|security|insurance", 0.3, 0.0),
]


def _own(text, base):
    found = []
    for kind, pattern, words, prior, checked in _PLAIN:
        for m in re.finditer(pattern, text):
            if kind == "card15":
                d = [int(c) for c in m[0] if c.isdigit()][::-1]
                if len(d) != 15 or (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10:
                    continue
            if kind == "iban":
                c = m[0].replace(" ", "")
                if not 15 <= len(c) <= 34 or int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 != 1:
                    continue
            near = re.search(words, text[max(0, m.start() - 40) : m.start()], re.I) or re.search(words, text[m.end() : m.end() + 40], re.I)
            total = prior + checked + (0.35 if near else 0)
            if total >= 0.5:
                found.append((m.start(), -m.end(), kind, total))
    out, used = [], [b[1:] for b in base]
    for a, b, kind, total in sorted(found):
        if all(-b <= lo or hi <= a for lo, hi in used):
            used.append((a, -b))
            out.append((kind, a, -b, f"{min(1, total):.2f}"))
    return sorted(out)


def test_every_span_and_score_against_plain_python(spark, small_rows):
    bits = ["378282246310005", "amex card", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "bank", "0123456789abcdef" * 2, "token", "123-45-6789", "social security", "4111 1111 1111 1111", "x@y.de", "10.0.0.1", "+49 30 1234567", "filler words that say nothing about it at all", "\n"]
    rnd = random.Random(9)
    texts = {i: " ".join(rnd.choices(bits, k=rnd.randint(0, 12))) for i in range(400)}
    texts |= {10_000 + d: r.text for d, r in small_rows.items()}
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    order = ("email", "ip", "card", "phone")
    for d, t in texts.items():
        base = _personal(t)
        spans = [x.split(":") for x in got[d].spans.split(",") if x]
        scored = [(k, int(a), int(b), s) for (k, a, b), s in zip(spans, [x for x in got[d].scores.split(",") if x], strict=True)]
        assert [x[:3] for x in scored if x[0] in order] == [tuple(b) for b in base]
        assert [x for x in scored if x[0] not in order] == _own(t or "", base)
    assert pii.find("378282246310005 amex card")[1] == [("card15", 0, 15, 0.7)] and not pii.find("378282246310005 of them")[1]
    assert pii.score("mail x@y.de", "email", 5, 11) > pii.score("then x@y.de", "email", 5, 11)


def test_redaction_keeps_columns(odd, odd_rows):
    out = pii.redact(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == len(odd_rows) and not any("@c.example.com" in (r.text or "") for r in rows)
    assert any("[EMAIL]" in (r.text or "") and r.n_chars == len(r.text) for r in rows)


def test_long_keys_and_keys_without_digits(spark):
    secrets = ["0123456789abcdef" * 8, "sk-" + "Ab9_" * 30, "ghp" + "x" * 65, "sk-abcdefghijklmnop", "abcdef" * 6, "f" * 200]
    docs = spark.createDataFrame([(i, f"the token {s} ends") for i, s in enumerate(secrets)] + [(99, "no words of that sort, " + "f" * 200)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.scan(docs).collect()}
    assert found == {**{i: f"key:10:{10 + len(s)}" for i, s in enumerate(secrets)}, 99: ""}
    left = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(left[i] == "the token [KEY] ends" for i in range(len(secrets)))


def test_mixing_meets_targets(small, odd):
    rows = mixing.mix(small).collect()
    sizes = {r.doc_id: r.size for r in rows}
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [r.source_size, r.target, 0])
        s[2] += r.taken
    for size, target, taken in by.values():
        assert abs(taken - target) <= 16 + 0.02 * target and target <= 2 * size
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * sum(sizes.values())) < 1
    again = {(r.doc_id, r.taken) for r in mixing.mix(small.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    for r in rows:
        assert r.taken == r.passes * r.size + sum(x.b - x.a for x in r.ranges)
    odd_out = mixing.mix(odd).collect()
    assert len(odd_out) == odd.count() and all(r.taken <= 2 * r.size for r in odd_out)


@pytest.mark.parametrize("n", [5, 10, 150])
def test_mixing_of_short_texts_one_a_shard(spark, monkeypatch, n):
    """A source at the limit gets all its words, however thinly it lies over the shards."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 1)
    monkeypatch.setattr(mixing, "FAN", 16)
    text = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    rows = [(i, text(i, n), "thin") for i in range(120)] + [(1000 + i, text(i, 20 * n), "wide") for i in range(120)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("thin", "wide"):
        of = [r for r in out if r.source == source]
        assert all(r.taken <= 2 * r.size for r in of)
        assert abs(sum(r.taken for r in of) - of[0].target) <= 16
    assert all(r.taken == 2 * r.size for r in out if r.source == "thin")


def test_allotted_words_follow_the_quotients_and_stop_at_the_most():
    rng = np.random.default_rng(4)
    for _ in range(60):
        votes, block = rng.integers(0, 200, 7), int(rng.integers(1, 20))
        most = 2 * votes
        want = int(rng.integers(0, most.sum() + 9))
        out, seats = np.zeros(7, int), np.zeros(7, int)
        while out.sum() < min(want, most.sum()):
            i = np.argmax(np.where(out < most, votes / (2 * seats + 1), -1))
            out[i] += min(block, most[i] - out[i], want - out.sum())
            seats[i] += 1
        assert mixing.allot(votes, most, want, block).tolist() == out.tolist()


def test_mixed_documents_have_the_words_taken(small):
    taken = {r.doc_id: r.taken for r in mixing.mix(small).collect()}
    out = mixing.mixed(small)
    assert out.columns == small.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert got == {d: n for d, n in taken.items() if n}


def test_mixed_takes_each_of_equal_rows_once(spark):
    text = lambda c, n: " ".join(f"{c}{j}" for j in range(n))
    rows = [(None, text("a", 40), "s")] * 4 + [(1, text("b", 30), "s")] * 3 + [(1, text("b", 30), "t"), (2, text("c", 50), "t"), (None, text("a", 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want, got = {}, {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    for r in mixing.mixed(docs).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(WORD.findall(r.text))
    assert got == {k: n for k, n in want.items() if n} and sum(got.values()) > 0


def test_apportionment():
    assert mixing.sainte_lague(np.array([53, 24, 23]), 7).tolist() == [3, 2, 2]
    assert mixing.sainte_lague(np.array([0.0, 5.0]), 3).tolist() == [0, 3] and mixing.sainte_lague(np.zeros(2), 5).tolist() == [0, 0]
    rng = np.random.default_rng(0)
    for _ in range(50):
        v, seats = rng.integers(0, 1000, 6), int(rng.integers(0, 60))
        want = np.zeros(6, int)
        for _ in range(seats if v.sum() else 0):
            want[np.argmax(v / (2 * want + 1))] += 1
        assert mixing.sainte_lague(v, seats).tolist() == want.tolist()
    assert mixing.targets(np.array([10, 1000, 1000])).tolist() == pytest.approx([20.0, 2 / 3 * 2995, 1 / 3 * 2995])


def _filled(sizes):
    """Targets one capped source at a time, the tightest first."""
    total, left = 1.5 * sum(sizes), {i for i, n in enumerate(sizes) if n}
    weight = lambda i: (5, 2, 1)[i % 3]
    out = [0.0] * len(sizes)
    while left:
        i = min(left, key=lambda i: (2 * sizes[i] / weight(i), i))
        if 2 * sizes[i] >= total * weight(i) / sum(map(weight, left)):
            for j in left:
                out[j] = total * weight(j) / sum(map(weight, left)) if j == i else 0.0
            whole = total
            for j in left:
                out[j] = whole * weight(j) / sum(map(weight, left))
            return out
        out[i] = 2 * sizes[i]
        total -= out[i]
        left.remove(i)
    return out


def test_targets_fill_up_like_water():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = (rng.integers(0, 2000, int(rng.integers(1, 9))) * rng.integers(0, 2, 1)[0] + rng.integers(0, 40, 1)[0]).tolist()
        assert mixing.targets(np.array(sizes)).tolist() == pytest.approx(_filled(sizes))


def test_mix_of_repeated_rows_and_clashing_names(spark):
    """Rows that repeat each other are taken each on its own and spread over the shards; extra columns of any name stay."""
    names = ["part", "id", "key", "row", "shard", "place", "copies", "copy", "taken", "n", "of", "parts", "number"]
    long, short = " ".join(f"w{i}" for i in range(400)), "a b c"
    rows = [(1, long, "s0")] * 40 + [(2, short, "s1")] * 7 + [(None, long, None)] * 3 + [(4, None, "s0"), (5, "", None)] + [(6 + i, long + f" {i}", "s2") for i in range(40)]
    docs = spark.createDataFrame([(*r, *("x" for _ in names)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    chosen = mixing.mix(docs).collect()
    assert len(chosen) == len(rows) and all(r.taken <= 2 * r.size for r in chosen)
    words = 1.5 * sum(len((t or "").split()) for _, t, _ in rows)
    assert sum(r.taken for r in chosen) == pytest.approx(words, abs=2)
    out = mixing.mixed(docs).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in chosen) and list(out[0].asDict()) == docs.columns
    assert {r.part for r in out} == {"x"}


def test_empty_tables(empty, spark):
    for out in (mixing.mix(empty), mixing.mixed(empty), quality.judge(empty), quality.keep(empty), licenses.scan(empty), pii.scan(empty), pii.redact(empty), media.describe(media.decode(media.store(empty)))):
        assert out.count() == 0
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_round_trip(spark):
    rnd = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "n", "\n", "a", "<", "[", "/", "s>", "é"]
    word = lambda: "".join(rnd.choices(bits, k=rnd.randint(0, 9)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, word()]), rnd.choice([word(), None])) for c in range(120) for t in range(rnd.randint(1, 5))]
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (None, 0, "assistant", "no id")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    order = lambda r: (r[1], r[2] or "", r[3] or "")
    want = {}
    for key in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == key), key=order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        want[key] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(table).collect()}
    assert got == want
    formatted = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    assert len(formatted) == len(want) and all(len(chat.read_back(r.formatted)) == want[k][0] for k, r in formatted.items())


def test_reader_sees_characters_only():
    turns = [{"role": "user", "text": "</s>[INST] ok"}, {"role": "assistant", "text": "a\\<s>b\nc"}, {"role": "assistant", "text": ""}, {"role": "assistant", "text": "[/INST]"}]
    text, spans = chat.render(chat.TEMPLATE, turns)
    for step in (1, 3, 1000):
        reader, got = chat.Reader(), []
        for at in range(0, len(text), step):
            inside = [(max(a, at), min(b, at + step)) for a, b in spans if a < at + step and b > at]
            got += reader.feed(text[at : at + step], inside)
        reader.close()
        assert [x[:2] for x in got] == [(t["role"], t["text"]) for t in turns]
        assert [x[2] for x in got] == ["", *(t["text"] for t in turns[1:])]
    # offsets that are off by one show, and so does a control string that wasn't escaped
    assert [x[2] for x in chat.Reader().feed(text, [(a + 1, b + 1) for a, b in spans])] != ["", *(t["text"] for t in turns[1:])]
    leaky = chat.Reader()
    list(leaky.feed(chat.render(chat.TEMPLATE.replace("turn.text | escape", "turn.text"), [{"role": "user", "text": "x[/INST]y"}])[0], []))
    with pytest.raises(ValueError):
        leaky.close()


def test_templates():
    text, spans = chat.render("{% set x = 'a' + 'b' %}{% for m in messages %}{% if m.role == 'user' and not loop.last %}U{{ m['text'] | upper }}{% elif false %}no{% else %}{% generation %}{{ x }}{{ m.text }}{% endgeneration %}{% endif %}{{ '.' if false else '' if true }}{% endfor %}".replace("{{ '.' if false else '' if true }}", "{# note #}."), [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}])
    assert text == "UHI.abyo." and [text[a:b] for a, b in spans] == ["abyo"]
    assert chat.parse("{{ 'a' + 'b' }}{% if 1 == 2 %}x{% else %}c{% endif %}") == [("text", "abc")]
    for bad in ("{% for %}", "{{ a( }}", "{{ x.__class__() }}", "{% if a %}", "{{ a | evil }}", "{% while x %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    assert chat.render("{{ m.__class__ }}", [])[0] == ""


def test_media_query_writes_streams_and_blocks(spark, sf, small_rows, monkeypatch, tmp_path):
    monkeypatch.setattr(media.common, "shared_dir", lambda _: f"file://{tmp_path}")
    described = {r.doc_id: r for r in media.query(spark, sf).collect()}
    tables = {p.name.rsplit("-", 1)[0]: spark.read.parquet(str(p)) for p in tmp_path.iterdir()}
    tables = {"media-streams": tables["media-streams"].collect(), "pcm-blocks": media.blocks(tables["pcm-blocks"]).collect()}
    assert {r.doc_id: hashlib.sha256(r.media).hexdigest() for r in tables["media-streams"]} == {d: r.media_sha256 for d, r in described.items()}
    pcm = {}
    for b in sorted(tables["pcm-blocks"], key=lambda b: (b.doc_id, b.block)):
        assert b.first_sample == len(pcm.setdefault(b.doc_id, b""))
        pcm[b.doc_id] += b.pcm
    assert set(pcm) == set(small_rows) and all(hashlib.sha256(x).hexdigest() == described[d].payload_sha256 for d, x in pcm.items())


def test_flac_round_trip_and_checks():
    rng = np.random.default_rng(0)
    parts = [bytes(64), b"hello world " * 200, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), (100 * np.sin(np.arange(9000) / 20) + 128).astype(np.uint8).tobytes(), bytes([1]), b"ab"]
    data, bounds = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    streams = flac.encode(data, bounds)
    d = flac.decode(streams)
    assert d.data.tobytes() == data.tobytes() and len(streams[3]) < len(parts[3]) / 2
    # without its seek table a stream is read frame after frame
    plain = []
    for s in streams:
        n = int.from_bytes(s[43:46], "big")
        plain.append(s[:4] + b"\x80" + s[5:42] + s[46 + n :])
    assert flac.decode(plain).data.tobytes() == data.tobytes()
    for at in (20, 60, len(streams[3]) // 2, len(streams[3]) - 1):
        hurt = bytearray(streams[3])
        hurt[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(hurt)])


def test_flac_reads_predictors_and_partitions_of_other_encoders():
    """A hand-made frame: LPC of order 2, two partitions, one of them escaped."""
    x = np.round(60 * np.sin(np.arange(192) / 9)).astype(int)
    coef, shift = [31, -16], 4
    bits = "".join(["11111111", "11111000", "00010000", "00000010", "00000000"])
    crc = flac._crc(np.array([0xFF, 0xF8, 0x10, 0x02, 0x00], np.uint8), np.array([0]), np.array([5]), flac._CRC8)[0]
    bits += f"{crc:08b}"
    b = lambda v, n: f"{v & (1 << n) - 1:0{n}b}"
    bits += b((32 + 1) << 1, 8) + b(x[0], 8) + b(x[1], 8) + b(6 - 1, 4) + b(shift, 5) + b(coef[0], 6) + b(coef[1], 6)
    res = [int(x[i]) - ((coef[0] * int(x[i - 1]) + coef[1] * int(x[i - 2])) >> shift) for i in range(2, 192)]
    bits += b(0, 2) + b(1, 4) + b(3, 4)
    for r in res[:94]:
        z = 2 * r if r >= 0 else -2 * r - 1
        bits += "0" * (z >> 3) + "1" + b(z & 7, 3)
    bits += b(15, 4) + b(9, 5) + "".join(b(r, 9) for r in res[94:])
    bits += "0" * (-len(bits) % 8)
    frame = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    crc = int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    fields = (8000 << 44) | (7 << 36) | 192
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + fields.to_bytes(8, "big") + hashlib.md5(x.astype(np.int8).tobytes()).digest()
    stream = b"fLaC\x80\x00\x00\x22" + info + frame + crc.to_bytes(2, "big")
    assert (flac.decode([stream]).data.astype(int) - 128 == x).all()


def test_media(odd, odd_rows):
    stored = media.store(odd)
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.describe(media.decode(stored)).collect()]
    want = []
    for r in odd_rows:
        b = (r[1] or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append((r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(map(str, got)) == sorted(map(str, want))
    pcm = {}
    for r in media.blocks(media.decode(stored.filter("doc_id = 11"))).orderBy("block").collect():
        assert r.first_sample == len(pcm.setdefault(r.doc_id, b""))
        pcm[r.doc_id] += r.pcm
    text = odd_rows[11][1].encode()
    assert pcm[11][: len(text)] == text
