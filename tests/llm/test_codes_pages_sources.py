"""Vector codes, HTML extraction and the audit of sources against plain Python and SQL."""

import hashlib
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.llm import common, divergence, vector_codes, wrappers
from lumigrid.llm.pages import Page, numbers

# --- vector codes ------------------------------------------------------------------------------------


def _plain_codes(rows, parts=8, k=16, rounds=6):
    """Every distance, in Python integers."""
    good = [r for r in rows if r[1] is not None and len(r[1]) and len(r[1]) % parts == 0 and all(v is not None and np.isfinite(v) for v in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return {}, []
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    w = len(good[0][1]) // parts
    x = [[[int(np.floor(4096 * v)) for v in r[1][p * w : (p + 1) * w]] for p in range(parts)] for r in good]
    book = [[list(x[i][p]) for i in range(min(k, len(good)))] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(book[p])), key=lambda e: (far(v, book[p][e]), e))
    for _ in range(rounds):
        code = [[near(v[p], p) for p in range(parts)] for v in x]
        for p in range(parts):
            for e in range(len(book[p])):
                own = [v[p] for v, c in zip(x, code, strict=True) if c[p] == e]
                if own:
                    book[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = {}
    for r, v in zip(good, x, strict=True):
        code = [near(v[p], p) for p in range(parts)]
        out.setdefault(r[0], []).append(("".join(f"{c:02x}" for c in code), sum(far(v[p], book[p][code[p]]) for p in range(parts))))
    return {k: sorted(v) for k, v in out.items()}, book


@pytest.mark.parametrize("size", [16, 8])
def test_codes_are_those_of_all_distances(spark, size):
    rnd = random.Random(size)
    vector = lambda: [rnd.choice([-0.5, 0.25, 0.25, 1.5]) + rnd.randint(0, 3) / 4096 for _ in range(size)]  # noqa: E731  many ties
    rows = [(i, vector(), i % 3 if i % 4 else None) for i in range(1, 160)]
    rows += [(5, rows[4][1], 1), (5, rows[9][1], 1), (None, vector(), 2), (900, None, 0), (901, [], 0), (902, [None] * size, 0), (903, [float("nan")] * size, 0), (904, [float("-inf")] * size, 0), (905, [1.0] * (size + 8), 0)]
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "vec_id long, embedding array<double>, label int, code string, x binary").repartition(3)
    found = vector_codes.compress(df)
    want, book = _plain_codes([r[:2] for r in rows])
    got = {}
    for r in found.rows.collect():
        got.setdefault(r.vec_id, []).append((r.code, r.error))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert found.entries.tolist() == book
    assert found.digest == hashlib.sha256(",".join(str(v) for p in book for e in p for v in e).encode()).hexdigest()


def test_codes_of_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(3, [0.5] * 8, 1), (1, [0.25] * 8, 1)], schema)
    assert sorted(map(tuple, vector_codes.compress(few).rows.collect())) == [(1, 1, "00" * 8, 0), (3, 1, "01" * 8, 0)]
    assert vector_codes.compress(spark.createDataFrame([], schema)).rows.count() == 0
    with pytest.raises(Exception, match="2\\^28"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], schema))


def test_pruning_computes_few_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-9000, 9000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 8))
    code, upper, lower = np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros((4000, 16))
    first = vector_codes.assign(x, code, upper, lower, centres, np.zeros(16))
    moved = np.full(16, 3.0)
    second = vector_codes.assign(x, code, upper, lower, centres, moved)
    assert second < first / 20
    exact = np.sqrt(((x[:, None] - centres) ** 2).sum(2))
    assert (lower <= exact + 1e-6).all() and (upper + 1e-6 >= exact[np.arange(4000), code]).all()
    stored = vector_codes._read(vector_codes._stored(exact, False))
    assert (stored <= exact).all() and (vector_codes._read(vector_codes._stored(exact, True)) >= exact).all()


def test_attach_beyond_the_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 2 else i % 3) for i in range(50)], "i long, k long")
    small = spark.createDataFrame([(None, 7), (0, 1), (1, 2), (2, 3)], "k long, v long")
    near = sorted(map(str, common.attach(rows, small, ["k"]).collect()))
    monkeypatch.setattr(common, "SMALL", 0)
    assert sorted(map(str, common.attach(rows, small, ["k"]).collect())) == near and len(near) == 50


# --- extraction --------------------------------------------------------------------------------------


def _template(host, i, style):
    rnd = random.Random(f"{host}{i}")
    prose = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rnd.randint(0, 999)) for _ in range(n))
    paras = [prose(rnd.randint(8, 30)) for _ in range(rnd.randint(1, 6))]
    head = prose(4)
    menu = "".join(f'<li><a href="/{w}">{w}</a>' for w in prose(5).split())
    body = "".join(f"<p>{p}" for p in paras)
    if style == "article":
        page = f"<html><head><title>{head}</title></head><body><nav><ul>{menu}</ul></nav><article><h1>{head}</h1>{body}<div>Support our work today</div><section class='comments'><p>{prose(5)}</section></article><aside>{prose(9)}</aside><footer>{prose(6)}</footer>"
        return page, [head, *paras]
    if style == "content":
        page = f"<body><div id='top'><ul>{menu}</ul></div><div class='post-content'><h2>{head}</h2>{body}</div><div class='cookie-notice'>{prose(5)}</div><form><p>{prose(3)}</form><div>All rights kept</div>"
        return page, [head, *paras]
    page = f"<body><div><ul>{menu}</ul></div><div><p>Read more on our site</p>{body}</div><div>One and the same foot of the page</div></body>"
    return page, paras


def test_extraction_with_wrappers(spark):
    rows, want = [], {}
    for h, (host, style) in enumerate([("a.example", "article"), ("b.example", "content"), ("c.example", "plain")]):
        for i in range(12):
            page, text = _template(host, i, style)
            for k in (0, 1) if i < 2 else (0,):  # copies
                key = h * 1000 + i + 500 * k
                rows.append((key, f"https://{host}/p/{key}?q", page, "t", "x"))
                want[key] = "\n\n".join(text)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, blocks string").repartition(5)
    got = {r.page_id: r for r in wrappers.extract(df).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_extraction_of_odd_pages(spark):
    long = "<article><p>" + "</p><p>".join(f"word{i} é &amp; x" for i in range(30_000)) + "</p></article>"
    pages = {
        1: (None, None, ""), 2: ("no url", "", ""), 3: ("http://x.example/a", "just  text\nhere", "just text here"), 4: ("http://x.example/b", "<article><h1>T</h1><p>A<br>b&nbsp;c<p>d</article>", "T\n\nA b c\n\nd"),
        5: (None, "<div class='ad'>only <b>this</b></div>", "only this"), 6: ("http://x.example/c", "<script>if (a < b) '</p>'", ""), 7: ("http://y.example/", long, "\n\n".join(f"word{i} é & x" for i in range(30_000))),
        8: ("http://y.example/", "<main><p>x &lt;b&gt; y</main><div hidden>no</div>", "x <b> y"), 9: ("http://y.example/", "<form><article><p>kept<input></article></form>", "kept"), 10: (None, "<p>a <", "a <"),
    }
    rows = [(k, u, h) for k, (u, h, _) in pages.items()]
    df = spark.createDataFrame([*rows, rows[3], (None, *rows[3][1:])], "page_id long, url string, html string")
    got = wrappers.extract(df).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=str) == sorted([*((k, v[2]) for k, v in pages.items()), (4, pages[4][2]), (None, pages[4][2])], key=str)
    assert wrappers.extract(df.limit(0)).count() == 0


def test_repeated_lines_of_articles_stay(spark):
    rows = [(i, f"http://z.example/{i}", f"<article><p>The same first line</p><p>own {i}</p></article>") for i in range(9)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"The same first line\n\nown {i}" for i in range(9)}


def test_tree_matching_by_brute_force():
    rnd = random.Random(3)

    def tree(depth):
        return rnd.choice("abc") + (f"({','.join(tree(depth - 1) for _ in range(rnd.randint(1, 3)))})" if depth and rnd.random() < 0.7 else "")

    def best(a, b):
        if a.label != b.label:
            return 0
        if not a.children or not b.children:
            return 1

        def rows(x, y):
            if not x or not y:
                return 0
            return max(rows(x[1:], y), rows(x, y[1:]), rows(x[1:], y[1:]) + best(x[0], y[0]))

        return 1 + rows(a.children, b.children)

    for _ in range(60):
        s, t = "r(" + tree(2) + "," + tree(2) + ")", "r(" + tree(2) + ")"
        a, b = wrappers.Tree.parse(s)[0], wrappers.Tree.parse(t)[0]
        assert a.text() == s and wrappers.match(a, b, {}) == best(a, b) == len(wrappers.align(a, b))
        merged = wrappers.Tree.parse(wrappers.induced([s, t]))[0]
        assert wrappers.match(merged, a, {}) == len(wrappers.Tree.parse(s)[1])


def test_node_numbers_are_those_of_appearance():
    page = Page("<body><div><p>a</p></div><div><p>b</p><ul><li>c</ul></div><div><p>d</p></div>")
    assert page.skeleton == "page(body(div(p),div(p,ul)))"
    assert [(n.number, t) for n, t, _ in page.blocks] == [(3, "a"), (5, "b"), (6, "c"), (3, "d")]
    assert len(numbers(page.skeleton)) + 1 == len(wrappers.Tree.parse(page.skeleton)[1])


# --- the audit of sources ------------------------------------------------------------------------------


def _plain_audit(rows, least, top):
    words = {}
    for lang, source, text in rows:
        words.setdefault(lang or "", {}).setdefault(source or "", []).append([w.decode() for w in divergence.terms(text or "")])
    out = []
    for lang, groups in words.items():
        docs = [set(d) for g in groups.values() for d in g]
        kept = sorted(w for w in set().union(*docs) if sum(w in d for d in docs) >= least)
        count = {s: {w: sum(d.count(w) for d in g) for w in kept} for s, g in groups.items()}
        p = lambda c, n: 1 + int(Fraction(10**9 * (c + 5), n + 5 * len(kept)))
        n = {s: sum(c.values()) for s, c in count.items()}
        whole = {w: sum(count[s][w] for s in groups) for w in kept}
        for s in groups:
            pair = [(-sum(abs(p(count[s][w], n[s]) - p(count[t][w], n[t])) for w in kept), t.encode()) for t in groups if t != s]
            term = [(p(whole[w], sum(n.values())) - p(count[s][w], n[s]), w.encode()) for w in kept if count[s][w]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(f for f in term if f[0] < 0)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least", [2, 30])
def test_audit_by_brute_force(spark, odd, odd_rows, least):
    rnd = random.Random(least)
    vocab = ["the", "Of", "été", "日本", "x-y", "İ", "ab1cd", "zz"] + [f"w{c}" for c in "abcdefghij"]
    rows = [(rnd.choice(["en", None, "de"]), rnd.choice(["s1", "s2", None, "ü", "hot", "hot", "hot"]), " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 30)))) for _ in range(160)]
    rows += [("en", "empty", ""), ("en", "none", None), ("fr", "alone", "un deux"), ("fr", "other", "2 3")]
    df = spark.createDataFrame([(r[2], r[1], r[0], 1, 2) for r in rows], "text string, source string, lang string, z long, value int").repartition(3)
    assert sorted(map(tuple, divergence.audit(df, least, 4).collect())) == _plain_audit(rows, least, 4)
    got = divergence.audit(odd.drop("task"), 2, 50).collect()
    assert sorted(map(tuple, got)) == _plain_audit([(r[2], r[3], r[1]) for r in odd_rows], 2, 50)


def test_audit_of_nothing(spark, empty):
    assert divergence.audit(empty).count() == 0


def test_posting_lists_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    want, pairs = {}, divergence._Pairs("en")
    monkeypatch.setattr(divergence, "PAIRS", 50)
    for size in (1, 2, 7, 300):
        at, p, z = np.sort(rng.choice(400, size, False)), rng.integers(50, 90, size), rng.integers(10, 40, size)
        pairs.add(at, p, z)
        for i in range(size):
            for j in range(i + 1, size):
                v = abs(p[i] - p[j]) + abs(z[i] - z[j]) - abs(p[i] - z[j]) - abs(p[j] - z[i])
                want[at[i], at[j]] = want.get((at[i], at[j]), 0) + v
    got = {(s, t): v for b in pairs.take() for s, t, v in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


# --- the queries against SQL ---------------------------------------------------------------------------


@pytest.mark.parametrize("query, sql, table", [(vector_codes.query, vector_codes.ORACLE, "embeddings"), (divergence.query, divergence.ORACLE, "documents")])
def test_query_against_sql(spark, sf, query, sql, table):
    got = query(spark, sf)
    with duckdb.connect() as con:
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
        want = con.execute(sql).fetchall()
        names = [d[0] for d in con.description]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(names).collect()) and want


def test_extraction_query_keeps_every_page(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = wrappers.query(spark, sf)
    assert got.count() == pages.count()
    joined = got.join(pages.select("page_id", "html"), "page_id").filter(F.length("text") > 0).collect()
    for r in joined:
        plain = " ".join(Page(r.html[r.html.index("<article>") : r.html.index("</article>")]).blocks[0][1].split())
        assert r.text.startswith(plain)


def test_long_child_lists_are_matched_like_short_ones(monkeypatch):
    """One exact method whatever the lists' lengths: the size only says how many rows of scores are held."""
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(260)]
    moved = wrappers.Tree.parse(f"page(div.x,{','.join(f'div.{n}' for n in names)})")[0]
    back = wrappers.Tree.parse(f"page({','.join(f'div.{n}' for n in names)},div.x)")[0]
    assert len(moved.children) * len(back.children) > wrappers.WIDE
    assert wrappers.match(moved, back, {}) == 261 and len(wrappers.align(moved, back)) == 261  # first come first served would give 2
    rnd = random.Random(3)
    for _ in range(40):
        a, b = ([wrappers.Tree.parse(rnd.choice(["p", "div(p)", "div(p,ul)", "div(h1,p,ul)", "ul"]))[0] for _ in range(rnd.randint(1, 14))] for _ in range(2))
        with monkeypatch.context() as m:
            short = wrappers._pairs(a, b, {})
            m.setattr(wrappers, "WIDE", 0)
            assert wrappers._pairs(a, b, {}) == short
