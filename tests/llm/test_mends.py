"""Names that clash inside operators, spans of long texts, templates that ask for what a stream hasn't got."""

import random
import time

import pytest

from lumigrid.llm import chat, common, jaccard, media, pii


@pytest.mark.parametrize("repeated", [False, True])
def test_keep_one_with_its_own_inner_names(spark, repeated):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "a", True, 1, 2, 3, 4), (2, long, "b", False, 5, 6, 7, 8), (3, "", "c", None, 0, 0, 0, 0)]
    rows += [rows[0], (None, "no id", "d", True, 0, 0, 0, 0)] if repeated else []
    names = ["doc_id", "text", "stay", "empty", "own", "key", "id", "number"]
    df = spark.createDataFrame(rows, "doc_id long, text string, stay string, empty boolean, own long, key long, id long, number long")
    got = jaccard.keep_one(df)
    assert got.columns == names
    assert sorted(((r.doc_id, r.stay, r.number) for r in got.collect()), key=str) == sorted([(1, "a", 4), (3, "c", 0), *([(None, "d", 0)] if repeated else [])], key=str)


def _plain(found, taken):
    out, used = [], list(taken)
    for s in sorted(found, key=lambda s: (s[1], -s[2])):
        if all(s[2] <= a or b <= s[1] for a, b in used):
            out.append(s)
            used.append(s[1:3])
    return out


def test_own_spans_among_many(monkeypatch):
    rnd = random.Random(4)
    found = []
    monkeypatch.setattr(pii, "score", lambda *a: 1.0)

    class Spans:
        def __init__(self, spans):
            self.spans = spans

        def finditer(self, text):
            return iter([Match(*s) for s in self.spans])

    class Match:
        def __init__(self, a, b):
            self.a, self.b = a, b

        def span(self):
            return self.a, self.b

        def start(self):
            return self.a

        def end(self):
            return self.b

        def __getitem__(self, i):
            return ""

    for name in ("_CARD", "_IBAN"):
        monkeypatch.setattr(pii, name, Spans([]))
    for _ in range(200):
        spans = {n: [(a, a + rnd.randint(1, 9)) for a in rnd.sample(range(120), 9)] for n in ("_KEY", "_SSN")}
        for n, v in spans.items():
            monkeypatch.setattr(pii, n, Spans(v))
        taken = [(a, a + rnd.randint(1, 30)) for a in rnd.sample(range(120), 4)]
        found = [("key", *s, 1.0) for s in spans["_KEY"]] + [("ssn", *s, 1.0) for s in spans["_SSN"]]
        assert pii.own_spans("", taken) == _plain(found, taken)


def test_own_spans_grow_in_proportion():
    one = "account GB82 WEST 1234 5698 7654 32, "
    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        assert len(pii.find(one * n)[1]) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


def test_templates_may_not_index_the_stream():
    for source in ("{{ messages[0]['text'] }}", "{{ messages.first }}", "{% for t in messages %}{{ messages[1].text }}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.render(source, [{"role": "user", "text": "x"}])
    assert chat.render("{% for t in messages %}{{ t['text'] }}{{ t.role }}{% endfor %}", [{"role": "user", "text": "x"}])[0] == "xuser"


def test_media_query_writes_streams_only(spark, sf, monkeypatch):
    """The streams are stored and read back; what is decoded from them isn't written a second time."""
    written, table = [], common.table
    monkeypatch.setattr(common, "table", lambda df, name, *more: written.append(name) or table(df, name, *more))
    got = media.query(spark, sf)
    assert got.count() == common.documents(spark, sf).count() and written == ["media-streams"]
