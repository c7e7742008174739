"""Hard negatives, periodic runs and main text against brute force on small tables."""

import hashlib
import html
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from rastermill.llm import hard_negatives, main_text, repetition

DOCS = "doc_id long, text string, lang string, runs string, h long"
VECTORS = "vec_id long, embedding array<float>, label int, id string, v int"


# --- periodic runs


def runs_by_trial(w, least=12):
    """All stretches of every period, the smallest period for each stretch."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in out.items())


def planted_words(r, n, k):
    w = [r.randrange(k) for _ in range(n)]
    if n > 6 and r.random() < 0.6:
        p, a = r.randrange(1, n), r.randrange(n)
        for i in range(a + p, n):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("least", [2, 5, 12, 21])
def test_runs_equal_those_of_a_trial_of_all_periods(least):
    r = random.Random(least)
    texts = [planted_words(r, r.randrange(100), r.choice([1, 2, 3, 6])) for _ in range(400)]
    assert repetition.runs_of(texts, least) == [runs_by_trial(w, least) for w in texts]


def test_words_appended_one_by_one_give_the_same_runs():
    r = random.Random(8)
    for _ in range(150):
        w = planted_words(r, r.randrange(1, 90), r.choice([1, 2, 3]))
        catcher, at = repetition.SquareCatcher(), 0
        while at < len(w):
            step = r.choice([1, 1, 3, 20])
            catcher.append(np.array(w[at : at + step]))
            at += step
        assert catcher.finish() == runs_by_trial(w)


def test_long_periodic_texts_stay_quick():
    assert repetition.runs_of([["a"] * 300_000])[0] == [(0, 300_000, 1)]
    assert repetition.runs_of([["a", "b", "c"] * 40_000])[0] == [(0, 120_000, 3)]


def op12_by_hand(doc_id, text):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    words, g = (text or "").encode().split(), h // 10
    n = len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = runs_by_trial(words)
    drop = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(((-length, s, p) for s, length, p in runs), default=None)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    longest = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op12_equals_the_contract_by_hand(spark, tmp_path):
    r = random.Random(2)
    word = lambda: r.choice(["a", "b", "Éé", "c.", " d"])
    rows = [(k, "".join(word() + r.choice([" ", "\t", "\n", " \x0b "]) for _ in range(r.randrange(120))), "en", "x", k) for k in range(120)]
    rows += [(120, None, "en", None, None), (121, "", None, "x", 1), (None, "a b " * 40, "en", "x", 1), (7, "x y z " * 9, "en", "x", 1), (7, "x y z " * 9, "en", "x", 1), (122, "q " * 11, "en", "", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert {t for _, t in got.dtypes[:6]} == {"bigint"}
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((op12_by_hand(i, t) for i, t, *_ in rows), key=key)


def test_periodic_runs_of_an_empty_table_and_clashing_columns(spark):
    d = spark.createDataFrame([], DOCS)
    assert repetition.periodic_runs(d).count() == 0
    d = spark.createDataFrame([("x", "k " * 20, "other", 1)], "id string, collapsed string, text string, runs int")
    assert repetition.periodic_runs(d, "id", "collapsed").collect()[0][2] == "k"


# --- hard negatives


def op11_by_hand(rows):
    usable = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        usable[i] = min(usable.get(i, (label, v)), (label, v))
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, (_, v) in usable.items()}
    out = set()
    for a in (i for i in usable if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(q[a], q[i])) for i in usable if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if usable[i][0] == usable[a][0]][:5]:
            window = [i for i in order if usable[i][0] != usable[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(window[:5], 1)}
    return out


def vectors(r, n, labels, spread):
    return [(k * 5, [round(r.uniform(-1, 1) * spread, 2) for _ in range(4)], r.randrange(labels), "x", 1) for k in range(n)]


@pytest.mark.parametrize("labels,spread", [(10, 1.0), (2, 0.02), (1, 1.0), (3, 1e4)])
def test_op11_equals_the_contract_by_hand(spark, tmp_path, labels, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 40)
    r = random.Random(labels)
    rows = vectors(r, 160, labels, spread)  # a small spread gives ties
    rows += [(1, None, 1, "x", 1), (2, [1.0, None, 1.0, 1.0], 1, "x", 1), (3, [1.0, float("nan"), 0.0, 0.0], 1, "x", 1), (4, [float("inf")] * 4, 1, "x", 1), (6, [1.0] * 4, None, "x", 1), (None, [1.0] * 4, 1, "x", 1), (8, [1.0, 0.5], 0, "x", 1), (9, [], 0, "x", 1), rows[20], rows[20]]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["op11_hard_negatives"](spark, str(tmp_path))
    assert got.dtypes[:6] == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == op11_by_hand(rows)


def test_op11_sql_equals_the_contract_by_hand(spark, tmp_path):
    rows = vectors(random.Random(4), 200, 3, 1.0) + [(1, None, 1, "x", 1), (6, [1.0] * 4, None, "x", 1)]
    spark.createDataFrame(rows, VECTORS).coalesce(1).write.parquet(f"{tmp_path}/e.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e.parquet/*.parquet'")
    assert set(c.sql(entry.oracle_sql()["op11_hard_negatives"]).fetchall()) == op11_by_hand(rows)


def test_huge_products_and_empty_tables(spark):
    big = [(0, [2.0**60, 1.0], 1, "x", 1), (10, [2.0**60, 2.0], 1, "x", 1), (30, [2.0**60, 0.0], 2, "x", 1)]
    d = spark.createDataFrame(big, VECTORS)
    assert [x.negative_id for x in hard_negatives.hard_negatives(d, "id = 0").collect()] == [30]
    assert hard_negatives.hard_negatives(d.filter("false"), "id = 0").count() == 0
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**13, 1.0]])
    assert hard_negatives.products(a, b)[0, 0] == 2**53 + 3


# --- main text

ARTICLE = "<h1>{title}</h1><p>{one}<p>{two} <a href=x>link</a> end.<ul><li>{title}<li>second</ul>"


def page(title, one, two, nav="", extra=""):
    body = ARTICLE.format(title=html.escape(title), one=html.escape(one), two=html.escape(two))
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var x='</p><p>no'</script></head><body class='no-sidebar'>"
        f"<div class='topMenu'><a href=1>{nav}</a> <a href=2>About</a></div><div id=cookie-bar>We use cookies</div>{extra}<div class=wrap><div class=story>{body}</div></div>"
        f"<div class=box><a href=3>other {nav}</a> <a href=4>more</a></div><div class=last>Made with love</div><section id=comments><p>{two} {two} said a reader</p></section></body>"
    )


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("one two three four five six seven eight nine ten & < > é".split()) + str(r.randrange(100)) for _ in range(n))


def wanted(title, one, two):
    return " ".join(f"{title} {one} {two} link end. {title} second".split())


@pytest.fixture(scope="module")
def site(spark):
    rows, want = [], {}
    for k in range(24):
        title, one, two = f"Title {k} &amp", words(k, 30), words(100 + k, 25)
        extra = "<div class=promoted><div>Only today: a great offer for you</div></div>" if k % 3 else ""
        rows.append((k, f"https://www.Site.example/{k}", page(title, one, two, nav=words(200 + k, 2), extra=extra)))
        want[k] = wanted(title, one, two)
    near = page("Copied", words(1000, 60), words(1001, 40))
    rows += [(100 + k, f"http://copies.example:80/{k}", near.replace("seven", f"seven{k}", 1)) for k in range(6)]
    want |= {100 + k: wanted("Copied", words(1000, 60).replace("seven", f"seven{k}", 1), words(1001, 40)) for k in range(6)}
    rows += [(200, None, "<p>alone</p><nav>menu</nav>"), (201, "no address", ""), (202, "http://x.example/", None), (None, "http://y.example/", "<p>null id"), (3, rows[3][1], rows[3][2])]
    want |= {200: "alone", 201: "", 202: "", None: "null id"}
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, grp string, wrapper long"), want, rows


def test_main_text_of_pages_with_one_template(spark, site, tmp_path):
    pages, want, rows = site
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["op13_main_text"](spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.dtypes[3][1] == "bigint"
    found = got.collect()
    assert sorted((str(r.page_id), r.url or "") for r in found) == sorted((str(i), u or "") for i, u, _ in rows)
    for r in found:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id


def test_wrappers_name_constant_slots_and_the_root(site):
    import json

    pages, _, _ = site
    one = pages.filter("url LIKE '%Site%'").drop("grp", "wrapper").selectExpr("page_id", "'s' AS grp", "html")
    d = json.loads(main_text.induce(one).collect()[0].wrapper)
    wrapper = main_text.Wrapper(json.dumps(d))
    fixed = {slot for slot, _ in d["constant"]}
    last = [s for s, leaf in main_text.blocks_of(main_text.parse(page("a", "b", "c")), wrapper.shape) if leaf.text == "Made with love"]
    assert set(last) <= fixed and len(wrapper.linked) >= 1 and wrapper.root != "0"


def test_wrappers_join_by_shuffle_gives_the_same(site, monkeypatch):
    pages, want, rows = site
    monkeypatch.setattr(main_text, "BROADCAST_BYTES", -1)
    assert {(r.page_id, r.text) for r in main_text.main_text(pages).collect()} == set(want.items())


def test_odd_markup(spark):
    of = lambda h: main_text.Wrapper(None).main_text(h)
    assert of("a&nbsp;&lt;b&gt; <b>c</b>d<br>e<!-- x -->f < g <p>h<script>no") == "a <b> cd ef < g h"
    assert of("<p title='a>b'>x</p><form><p>mail</p></form><p hidden>no</p><p style='display: none'>no</p>") == "x"
    assert of("<table><tr><td>1<td>2<tr><td>3</table><dl><dt>t<dd>d</dl>") == "1 2 3 t d"
    assert of("<article><header><h1>T</h1></header>x<footer>f</footer></article><header>site</header>") == "T x"
    deep = "<div>" * 4000 + "in" + "</div>" * 4000 + "".join(f"<h2>{k}</h2><p>q</p>" for k in range(3000))
    assert of(deep) == "in " + " ".join(f"{k} q" for k in range(3000))
    assert main_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_layout_tables_and_site_headers(spark):
    """Cells stay apart in a shape, so what stands in the same cell of all pages is template; so is a header of the site."""
    rows, want = [], {}
    for k in range(8):
        body = f"<h1>Head {k}</h1>{words(k, 30)}<br><br>{words(50 + k, 20)}".replace("&", "and").replace("<1", "1").replace("<2", "2")
        text = f"Head {k} {words(k, 30)} {words(50 + k, 20)}".replace("&", "and").replace("<1", "1").replace("<2", "2")
        table = f"<div class=site-header><b>Shop</b> {words(80 + k, 3)}</div><table><tr><td colspan=2>Old site</td></tr><tr><td><a href=a>Home</a><br><a href=b>{k}</a></td><td>{body}</td></tr><tr><td colspan=2>Best viewed at {k}</td></tr></table>"
        rows.append((k, f"http://t.example/{k}", table))
        want[k] = " ".join(text.split())
    got = {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: " ".join(main_text.Wrapper(None).main_text(f"<p>{t}").split()) for k, t in want.items()}


def test_shapes_fold_what_repeats():
    shape = lambda h: main_text.shape_of(main_text.parse(h))
    assert shape("<p>a<p>b") == ("html", (("p*", (("#*", ()),)),)) == shape("<p>a")
    assert shape("<div>a</div><div>b</div>") == ("html", (("div", (("#*", ()),)),) * 2)
    assert shape("<div>a</div>" * 4) == ("html", (("div*", (("#*", ()),)),))
    wide = shape("".join(f"<h2>{k}</h2><div>q</div>" for k in range(40)))
    assert [k[0] for k in wide[1]] == ["h2*", "div*"]


def test_alignment_is_simple_tree_matching():
    leaf = ("#", ())
    a = ("body", (("nav", (leaf,)), ("p", (leaf,)), ("div", (("p", (leaf,)), leaf))))
    b = ("body", (("p", (leaf,)), ("div", (leaf,)), ("nav", (leaf,))))
    assert main_text.tree_matching(a, a) == 9 and main_text.tree_matching(a, b) == main_text.tree_matching(b, a) == 5
    assert main_text.aligned(b, a) == ("0", (("0.1", (("0.1.0", ()),)), ("0.2", (("0.2.1", ()),)), ("0+nav", (("0+nav+#", ()),))))
