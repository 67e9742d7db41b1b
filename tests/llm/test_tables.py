"""Vector search, HTML extraction, license scans and the pipeline."""

import random
import re
from collections import Counter
from html import unescape
from math import log, sqrt

import numpy as np
import pytest

import corpus_pipeline
from clickloom.llm import ann, html_text, licenses, near_dups, packing, pii
from clickloom.llm.common import prepare, table

SF = "/root/testdata/sf0.01"

# ---- vectors


def exact(rows, step, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    out = {}
    for q in np.flatnonzero(ids % step == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [j for j in np.argsort(d, kind="stable") if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(d[j])) for j in best]
    return out


def found_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    vectors = table(prepare(spark), sf, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want, got = exact(rows, 20, 10), found_of(ann.search(vectors, query_step=20))
    assert set(want) == set(got)
    hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    distance = {q: dict(exact([r for r in rows if r[0] in {q, *[i for i, _ in got[q]]}], 1, 99)[q]) for q in list(got)[:20]}
    for q in distance:
        assert all(abs(score - distance[q][i]) < 1e-12 for i, score in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))


def test_hot_vector_and_blocks(spark, monkeypatch):
    """A third of all rows are equal; blocks are tiny; every part is probed, so the answer is exact."""
    monkeypatch.setattr(ann, "ROW_BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.standard_normal(3).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_of(ann.search(df, parts=8, probes=8)) == exact(rows, 100, 10)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, [None, 1.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (2, [1.0]), (600, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    assert found_of(ann.search(df)) == {0: [(1, np.sqrt(2.0))]}
    assert ann.search(df.limit(0)).collect() == []


# ---- pages


def test_pages_of_the_table(spark):
    pages = table(prepare(spark), SF, "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    found = html_text.extract(pages).collect()
    assert len(found) == len(html)
    for r in found:
        article = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S).group(1)
        lines = [" ".join(unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="page sidebar">
<div class="top-menu"><a href="/">Home</a></div><div id="x7"><h2>Head {i}</h2><p>Same words on every page</p><p>Body&nbsp;of &amp; page {i}
 <b>bo</b>ld<br>next<p>Second {i}<ul><li>one {i}<li>two</ul></div>
<section class="comments"><p>First! {i}</p></section><div class="cookie-notice">We use cookies</div><form>Name <input></form></body></html>"""


def texts_of(spark, pages, host="h.example"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(html_text.extract(df).collect(), key=lambda r: r["page_id"])]


def test_template_of_a_host_without_article_tags(spark):
    texts = texts_of(prepare(spark), [PAGE.format(i=i) for i in range(12)])
    assert texts == [f"Head {i}\nSame words on every page\nBody of & page {i} bold next\nSecond {i}\none {i}\ntwo" for i in range(12)]


TOP = '<nav><a href="/">News</a><a>Contact</a></nav><div id="logo">Site</div>'
END = '<div class="sidebar">Most read {i}</div><div class="comment-list"><p>So true {i}</p></div><footer>Contact</footer>'
SHAPES = {
    "inner": ("<article><h1>Head {i}</h1><p>Lead {i}</p><div class='body'><p>Long text {i} " + "of words " * 30 + "</p><p>End {i}</p></div></article>"),
    "plain": ("<article><h1>Head {i}</h1><p>Lead {i}</p><p>Long text {i} " + "of words " * 30 + "</p><p>End {i}</p></article>"),
    "named": (
        '<div class="content has-sidebar"><h1 class="entry-header">Head {i}</h1><p>Lead {i}</p><div><p>Long text {i} ' + "of words " * 30 + "</p><p>End {i}</p></div></div>"
    ),
    "search": ('<div id="main" class="search"><h1>Head {i}</h1><p>Lead {i}</p><div><p>Long text {i} ' + "of words " * 30 + "</p><p>End {i}</p></div></div>"),
    "header": ("<main><header><h1>Head {i}</h1></header><p>Lead {i}</p><section class='share-story'><p>Long text {i} " + "of words " * 30 + "</p><p>End {i}</p></section></main>"),
}


@pytest.mark.parametrize("shape", list(SHAPES))
@pytest.mark.parametrize("n", [2, 3, 7, 8, 20])
def test_whole_articles_at_every_host_size(spark, shape, n):
    pages = [f"<html><body>{TOP}{SHAPES[shape]}{END}</body></html>".replace("{i}", str(i)) for i in range(n)]
    want = [f"Head {i}\nLead {i}\nLong text {i} " + ("of words " * 30).strip() + f"\nEnd {i}" for i in range(n)]
    assert texts_of(prepare(spark), pages) == want


@pytest.mark.parametrize("n", [7, 8])
def test_copies_and_headings_like_menu_entries(spark, n):
    prepare(spark)
    page = f"<html><body>{TOP}{SHAPES['inner']}{END}</body></html>"
    same = page.replace("{i}", "1")
    whole = "Head 1\nLead 1\nLong text 1 " + ("of words " * 30).strip() + "\nEnd 1"
    assert texts_of(spark, [same] * n) == [whole] * n  # one page, however often
    mirrors = [same.replace("News", f"News {i}") for i in range(n)]  # copies of the article under other menus
    assert texts_of(spark, mirrors) == [whole] * n
    news = [page.replace("Head {i}", "News").replace("{i}", str(i)) for i in range(n)]
    assert [t.split("\n")[0] for t in texts_of(spark, news)] == ["News"] * n


def test_class_names_vote():
    extra = ["ad", "top-menu", "cookie-notice", "comment-list", "site_footer", "sidebar", "share-links"]
    kept = ["has-sidebar", "with-ads", "search-page", "share-story", "shadow", "reader", "entry", "content", "no-comments", "commentary", ""]
    assert all(html_text.votes_out([n]) for n in extra) and not any(html_text.votes_out([n]) for n in kept)
    attributes = [e for kind, e, _ in html_text.scan('<div data-id="menu" data-class="ad" title="class=ad">x</div>') if kind == "open"]
    assert not attributes[0].voted


def test_classes_against_a_plain_deduction(spark):
    """Occurrence vectors kept whole, classes by equal vectors, the deepest element that holds half of the text."""
    rng = random.Random(4)
    pages = []
    for i in range(9):
        extra = "<div class='x'><p>maybe</p></div>" * rng.randrange(3)
        body = "<div class='t'><div class='u'>" + "".join(f"<p>words {i} {j} " + "w " * rng.randrange(30) + "</p>" for j in range(1 + rng.randrange(4))) + "</div></div>"
        pages.append(f"<html><body><div class='logo'><p>Site</p></div>{extra}{body}<p>by {i}</p></body></html>")
    vectors, kinds = {}, {}
    for i, page in enumerate(pages):
        for token, (kind, depth, home, n, mass, free) in html_text.page_tokens(page).items():
            vectors.setdefault(token, [0] * len(pages))[i] = n
            kinds.setdefault(token, [kind, depth, home, 0])[3] += free
    whole = kinds[html_text.ROOT][3]
    classes = {}
    for token, v in vectors.items():
        if kinds[token][0] != html_text.IS_PAGE and sum(x > 0 for x in v) > 1 and 2 * sum(x > 0 for x in v) >= len(pages):
            classes.setdefault(tuple(v), []).append(token)
    valid = [t for ts in classes.values() if len(ts) >= html_text.LEAST_CLASS for t in ts]
    slots = [
        t for t in valid
        if kinds[t][0] == html_text.IS_TAG and kinds[t][1] > 0 and 2 * kinds[t][3] >= whole and max(vectors[t]) == 1
    ]
    want = max(slots, key=lambda t: (kinds[t][1], kinds[t][3], t))
    written = sorted(t for t, v in vectors.items() if kinds[t][0] == html_text.IS_TEXT and min(v) > 0)
    df = prepare(spark).createDataFrame([("h", i * 7919, p) for i, p in enumerate(pages)], "host string, key long, html string")
    found = html_text.templates(df.repartition(4)).collect()
    assert [(r["main"], r["written"]) for r in found] == [(want, written)]
    inner = [t for t, (kind, e) in ((t, ("open", e)) for p in pages for k, e, _ in html_text.scan(p) if k == "open" for t in [e.token] if e.name == "div") if t == want]
    assert inner  # the slot is one of the div elements
    assert texts_of(spark, pages)[0].endswith("by 0") and "Site" not in texts_of(spark, pages)[0]


def test_pages_without_template_and_odd_rows(spark):
    rows = [
        (1, "http://a.example/", "<article>x <i>y</i></article><footer>f</footer>", 1),
        (None, None, None, 1),
        (2, "not a url", "", 1),
        (3, "http://b.example/", "plain &lt;text&gt; <", 1),
        (3, "http://b.example/", "plain &lt;text&gt; <", 1),
        (4, "http://c.example/", "<p>" * 3_000 + "deep" + "<!-- open", 1),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    found = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    assert found == [("1", "x y", 3), ("2", "", 0), ("3", "plain <text> <", 14), ("3", "plain <text> <", 14), ("4", "deep", 4), ("None", "", 0)]
    assert html_text.extract(df.limit(0)).collect() == []


# ---- licenses


def test_licenses_are_inherited_from_the_nearest_folder(spark):
    prepare(spark)
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", mit),
        (2, "a/x.txt", "nothing here"),
        (3, "a/b/c/y.txt", "nothing here"),
        (4, "a/b/COPYING", gpl),
        (5, "a/z.txt", "words " * 200 + "\n  " + gpl.upper() + "\n" + "words " * 200),
        (6, "q/w.txt", None),
        (7, None, "alone"),
        (7, None, "alone"),
        (8, "top.txt", ""),
        (9, "a/b2/v.txt", "not licensed in any known way at all, sorry"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    found = {r["doc_id"]: r for r in licenses.scan(df, df["path"]).collect()}
    said = {i: (r["own_license"], r["licence_file"], r["license"], r["inherited_from"]) for i, r in found.items()}
    assert said == {
        1: ("MIT", True, "MIT", None),
        2: (None, False, "MIT", "a/LICENSE"),
        3: (None, False, "GPL-3.0", "a/b/COPYING"),
        4: ("GPL-3.0", True, "GPL-3.0", None),
        5: ("GPL-3.0", False, "GPL-3.0", None),
        6: (None, False, None, None),
        7: (None, False, None, None),
        8: (None, False, None, None),
        9: (None, False, "MIT", "a/LICENSE"),
    }
    assert licenses.scan(df, df["path"]).count() == len(rows)
    assert licenses.scan(df.limit(0), df["path"]).collect() == []


def plain_license(text):
    """(license, similarity, licence file) of one text, with loops: whole text, lines, windows."""
    words = lambda t: re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", t.lower())
    tells = lambda w: any(p in w for p in licenses.TELLING)
    bank = [words(t) for _, t in licenses.TEMPLATES]
    n = len(bank)
    df = Counter(w for b in bank for w in set(b))

    def vector(ws):
        raw = {w: (1 + log(c)) * log((n + 1) / (df[w] + 0.5)) for w, c in Counter(ws).items()}
        norm = sqrt(sum(v * v for v in raw.values())) or 1.0
        return {w: v / norm for w, v in raw.items()}

    vectors = [vector(b) for b in bank]

    def said(ws, some):
        v = vector(ws)
        near = {t: round(sum(v[w] * vectors[t].get(w, 0.0) for w in v), 6) for t in some}
        near = {t: x for t, x in near.items() if x >= licenses.THRESHOLD}
        fit = []
        for t, x in near.items():
            name = licenses.TEMPLATES[t][0]
            must, never = licenses.MARKS.get(name, ([], [])) if t < len(licenses.HEADERS) else ([], [])
            if all(set(m) & set(ws) for m in must) and not set(never) & set(ws) and x >= max(near.values()) - licenses.MARGIN:
                fit.append((-x, name))
        return min(fit, default=None)

    if not any(p in text.lower() for p in licenses.TELLING):
        return None, 0.0, False
    if whole := said(words(text), range(n)):
        return whole[1], -whole[0], True
    found, stream = [], []
    for line in text.split("\n"):
        one = said(words(line), range(n)) if any(p in line.lower() for p in licenses.TELLING) else None
        found += [one] if one else []
        stream += [(w, one is not None) for w in words(line)]
    ws = [w for w, _ in stream]
    for k, (w, done) in enumerate(stream):
        if not tells(w) or done:
            continue
        for t, b in enumerate(bank):
            for at, x in enumerate(b):
                if x == w and (
                    at == b.index(w)
                    if len(b) <= licenses.LOOSE_WORDS
                    else any(
                        0 <= i < len(b) - 1 and 0 <= i - at + k < len(ws) - 1 and b[i : i + 2] == ws[i - at + k : i - at + k + 2]
                        and next(j for j in range(len(b)) if tells(b[j]) and (b[j - 1 : j + 1] == b[i : i + 2] or b[j : j + 2] == b[i : i + 2])) == at
                        for i in (at - 1, at)
                    )
                ):
                    one = said(ws[max(0, k - at) : max(0, k - at) + len(b)], [t])
                    found += [one] if one else []
    best = min(found, default=None)
    return (best[1], -best[0], False) if best else (None, 0.0, False)


def test_licenses_against_plain_python(spark):
    rng = random.Random(9)
    prose = lambda k: " ".join(f"w{rng.randrange(500)}" for _ in range(k))
    headers = [t for _, t in licenses.HEADERS]
    texts = ["Licensed under the Apache License Version 2.0 with more words", "released under an MIT license", "a license", "", None]
    for _ in range(25):
        header = rng.choice(headers).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            header[rng.randrange(len(header))] = f"x{rng.randrange(9)}"
        wrapped = " ".join(header[:3]) + rng.choice([" ", "\n"]) + " ".join(header[3:])
        texts.append(prose(rng.choice([0, 4, 40])) + rng.choice(["\n", " "]) + wrapped + rng.choice(["\n", " "]) + prose(rng.choice([0, 30])))
    texts += [prose(100) + "\n" + licenses.TEMPLATES[-1][1][:3_000], prose(20) + " this license " + prose(5)]
    df = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(df, licenses.F.lit(None).cast("string")).collect()}
    for i, text in enumerate(texts):
        name, similarity, whole = plain_license(text or "")
        assert (found[i]["own_license"], found[i]["licence_file"]) == (name, whole), text
        assert abs(found[i]["similarity"] - similarity) < 2e-6


def test_whole_license_texts_wrapped_headers_and_variants(spark):
    full = dict(licenses.TEMPLATES[len(licenses.HEADERS) :])
    gpl3 = next(t for n, t in licenses.HEADERS if n == "GPL-3.0" and "any later version" in t and "WARRANTY" in t)
    prose = "ordinary words about nothing in particular " * 40
    long = " ".join(f"word{i}" for i in range(1_500))
    wrap = lambda t, n: "\n".join(" * " + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [
        (1, "m/LICENSE", full["MIT"].replace("<year> <copyright holders>", "2020 Somebody"), ("MIT", True)),
        (2, "m/x.c", "int main;", (None, False)),
        (3, "g/COPYING", full["GPL-3.0"], ("GPL-3.0", True)),
        (4, "h/COPYING", prose + "\n" + full["Apache-2.0"] + "\n" + prose, ("Apache-2.0", True)),
        (14, "s/h.c", long + "\n" + full["Apache-2.0"] + "\n" + long, ("Apache-2.0", False)),
        (15, "s/i.c", prose * 3 + full["MIT"].replace("\n", " ") + prose * 3, ("MIT", False)),
        (16, "s/j.c", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n" + prose, ("AGPL-3.0", False)),
        (5, "s/a.c", wrap(gpl3, 7) + "\n" + prose, ("GPL-3.0", False)),
        (6, "s/b.c", prose + "Released under the MIT License. " + prose, ("MIT", False)),
        (7, "s/c.c", wrap(gpl3.replace("version 3", "version 2"), 9) + "\n" + prose, ("GPL-2.0", False)),
        (8, "s/d.c", wrap(gpl3.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), 8) + "\n" + prose, ("LGPL-2.1", False)),
        (9, "s/e.c", prose + "\nLicensed under CC BY 4.0.", ("CC-BY-4.0", False)),
        (10, "s/f.c", prose + "\nLicensed under the Apache License, Version 1.1.", (None, False)),
        (11, "p/LICENSE", full["Apache-2.0"], ("Apache-2.0", True)),
        (12, "l/LICENSE", full["BSD-2-Clause"], ("BSD-2-Clause", True)),
        (13, "s/g.c", prose, (None, False)),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")
    found = {r["doc_id"]: r for r in licenses.scan(df, df["path"]).collect()}
    assert {i: (r["own_license"], r["licence_file"]) for i, r in found.items()} == {r[0]: r[3] for r in rows}
    assert found[2]["license"] == "MIT" and found[2]["inherited_from"] == "m/LICENSE" and found[13]["license"] is None


# ---- pipeline


def test_pipeline_stages(spark):
    docs = table(prepare(spark), SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "near_dedup", "pii", "packing"]
    kept, counts = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and [t for _, t in kept.dtypes] == [t for _, t in docs.dtypes]
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        counts.append(kept.count())
    assert docs.count() >= counts[0] > counts[1] > counts[2] == counts[3]
    assert all(r["kept"] for r in near_dups.near_duplicates(kept.join(docs.select("doc_id"), "doc_id")).where("n_shingles = 0").collect())
    assert pii.detect(kept).where("n_email + n_ip + n_card + n_phone > 0").isEmpty()
    key = ["doc_id", "bucket", "batch", "position"]
    assert corpus_pipeline.run(spark, SF).select(key).exceptAll(packing.pack(kept).select(key)).isEmpty()


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, stage):
    docs = table(prepare(spark), SF, "documents").limit(0)
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).collect() == []
