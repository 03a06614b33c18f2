"""Operators of larder.llm against brute force, and on odd rows: nulls, empty tables, repeats, extra columns."""

import hashlib
import itertools
import json
import math
import os
import random
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import chosen_path, html_wrapper, katz, multi_index, packing, queries, substring, tiling, toxicity, words
from larder.llm.chat import joined, preference_pairs, render, stale_replies
from larder.llm.components import components
from larder.llm.licenses import TEMPLATES, scan, templates_of
from larder.llm.queries import byte_bpe
from larder.llm.scratch import Scratch, scope

DOCS = "doc_id long, text string, score string, words int, node long"


def docs(spark, texts):
    """Rows with columns whose names clash with what operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in texts], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 4, 6, 40, 120, 300]))) for _ in range(n)]
    for i in range(0, n, 4):  # near and exact copies, shared passages
        words = texts[r.randrange(n)].split()
        for _ in range(r.randrange(3)):
            if words:
                words[r.randrange(len(words))] = r.choice(vocabulary)
        texts[i] = " ".join(words)
    passage = " ".join(r.choices(vocabulary, k=70))
    for i in range(1, n, 7):
        texts[i] += " " + passage + " tail " + texts[i][:50]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(5, texts[5]), (None, "null id text with a few words"), (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "ünïcode wörds \x0b x\x1cy")]


# toxicity


def test_forward_backward_is_exact():
    r = np.random.default_rng(1)
    e, step = r.normal(size=9), r.normal(size=(2, 2))
    starts = np.zeros(9, bool)
    starts[[0, 4]] = True
    p, pair = toxicity.forward_backward(e, starts, step)
    for a, b in ((0, 4), (4, 9)):
        total, marginal, joint = 0.0, np.zeros(b - a), np.zeros((4, b - a - 1))
        for tags in itertools.product((0, 1), repeat=b - a):
            w = math.exp(sum(t * v for t, v in zip(tags, e[a:b])) + sum(step[x, y] for x, y in zip(tags, tags[1:])))
            total += w
            marginal += w * np.array(tags)
            for i, (x, y) in enumerate(zip(tags, tags[1:])):
                joint[2 * x + y, i] += w
        assert np.allclose(p[a:b], marginal / total) and np.allclose(pair[:, a : b - 1], joint / total)


def test_toxic_documents_are_told_apart(spark):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{r.randrange(300)}" for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for w in ("blarghx" + r.choice("abc"), "fnordle"):
                words.insert(r.randrange(40), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(None, None), (1000, ""), (1001, None), (3, rows[3][1])]
    labels += [(None, 1), (5000, 1), (7, None)]
    df, held = docs(spark, rows), F.col("doc_id") % 4 != 0
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), held)
    out = toxicity.score(df, model).collect()
    assert len(out) == len(rows)
    judged = {x.doc_id: x for x in out}
    assert all((judged[i].score >= 0.5) == (i % 5 == 0) for i in range(400))
    assert judged[1000].score == judged[1001].score < 0.5
    text = dict(rows)[20]
    assert {text[s.start : s.end] for s in judged[20].spans} >= {"fnordle"}
    assert toxicity.score(empty(spark), toxicity.Field()).count() == 0
    assert toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"), held).word == {}


# chat


def test_preference_prefix_and_masks(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "<|im_end|>"),
        (2, "chosen", 0, None, None), (2, "rejected", 0, None, None),
        (3, "chosen", 0, "user", "only"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "pair_id long, side string, turn long, role string, text string, same string")
    got = {r.pair_id: r for r in preference_pairs(df).withColumn("c", joined(F.col("chosen"))).withColumn("r", joined(F.col("rejected"))).collect()}
    assert got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n" and got[1].prompt_turns == 1
    assert got[1].c == "<|im_start|>assistant\nyes<|im_end|>\n" and [s.trained for s in got[1].chosen] == [False, True]
    assert "<| im_end|><|im_end|>" in got[1].r and [s.trained for s in got[1].rejected] == [False, True, False, False]
    assert (got[2].prompt_turns, got[2].c, got[2].r) == (1, "", "")
    assert (got[3].prompt_turns, got[3].r) == (0, "")
    assert preference_pairs(df.limit(0)).count() == 0


def test_stale_replies_differ_in_the_last_reply_only(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q2"), (1, 3, "assistant", "b"), (1, 4, "user", "bye"), (2, 0, "user", "alone"), (3, 0, "assistant", "z"), (None, 0, "assistant", None)]
    got = {r.pair_id: r for r in render(stale_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {1, 3, None} and got[1].prompt_turns == 3
    assert got[1].chosen[1].text == "b<|im_end|>\n" and got[1].rejected[1].text == "a<|im_end|>\n" and got[3].rejected[1].text == "<|im_end|>\n"


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_repeated_and_odd_turns_are_those_of_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a")]
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, 2, "user", None)]
    rows += [(3, 0, "assistant", None), (3, None, "assistant", "first"), (None, 1, "assistant", "x"), (None, 0, "assistant", "y"), (4, 0, None, "no reply"), (5, 0, "assistant", "long " * 50_000)]
    spark.createDataFrame(rows, CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    df = queries.op2_preference_pairs(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.PREFERENCE_SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect()) and len(want) == 5
    kept = render(stale_replies(spark.read.parquet(f"{tmp_path}/conversations.parquet"), only_different=True)).collect()
    assert {r.pair_id for r in kept} == {None, 3} and all(r.differs for r in kept)


# similarity join


def test_similarity_join_is_brute_force(spark):
    rows = corpus()
    out = chosen_path.similarity_join(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    shingles = chosen_path.Shingles(5)
    sets = {i: frozenset(shingles.of((t or "").encode()).tolist()) for i, t in rows if i is not None}
    got = {r.doc_id: r for r in out}
    linked = {i: {sets[j] for j in sets if sets[j] != sets[i] and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    assert any(linked.values())
    for i, s in sets.items():
        assert got[i].copy_id == (min(j for j in sets if sets[j] == s) if s else i)
        assert got[i].n_links == len(linked[i])
        assert all(got[j].class_id == got[i].class_id for j in sets if sets[j] in linked[i])
    assert (got[None].class_id, got[None].n_links) == (None, 0)
    assert chosen_path.similarity_join(empty(spark)).count() == 0


def test_chosen_paths_reach_their_recall():
    p, r = chosen_path.ChosenPath(), np.random.default_rng(3)
    tree, hits = chosen_path.Tree(p), 0
    with np.errstate(over="ignore"):
        for _ in range(300):
            x = r.integers(0, 2**63, 100, dtype=np.int64).view(np.uint64)
            a, b = x[:90], np.concatenate([x[10:], x[:0]])[:90]
            hits += len(np.intersect1d(tree.paths(a)[-1][1], tree.paths(b)[-1][1])) > 0
    assert hits >= 299


def test_blocks_split_large_buckets(spark):
    base = " ".join(f"t{i}" for i in range(60))
    rows = [(i, base + f" x{i}") for i in range(40)]
    out = chosen_path.similarity_join(docs(spark, rows), chosen_path.ChosenPath(limit=5, block=8, exact_block=8)).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 39)}


def test_rows_that_repeat_a_doc_id_have_their_own_texts_result(spark):
    words = [f"t{i}" for i in range(60)]
    a, near, b = " ".join(words), " ".join([*words, "more"]), " ".join(f"u{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, a.replace(" ", "  ")), (2, near), (3, b + " tail"), (3, a)]
    long = [f"v{i}" for i in range(30_000)]
    rows += [(4, " ".join(long)), (5, " ".join(long[:29_000]))]
    out = chosen_path.similarity_join(docs(spark, rows)).collect()
    got = Counter((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in out)
    assert got == Counter({(1, 1, 1, 1): 3, (2, 1, 1 + 1, 1): 1, (3, 1, 3, 1): 1, (3, 1, 1, 1): 1, (4, 4, 4, 1): 1, (5, 4, 5, 1): 1})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 140)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    roots = defaultdict(set)
    for r in got:
        roots[r.root].add(r.id)
    assert sorted(map(len, roots.values())) == [40, 51]


# licences


def test_license_scan(spark):
    rows = [(1, "foo\nReleased under the MIT license!\nbar"), (2, None), (3, ""), (4, "Released under the MIT License."), (None, "licensed under CC BY NC 4 0"), (5, "Released"), (4, "Released under the MIT License.")]
    got = sorted((str(r.doc_id), r.line, r.license, r.dice) for r in scan(docs(spark, rows)).collect())
    assert got == [("1", 2, "MIT", 1.0), ("4", 1, "MIT", 1.0), ("4", 1, "MIT", 1.0), ("None", 1, "CC-BY-NC-4.0", 1.0)]
    plan = scan(docs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert scan(docs(spark, rows), {}).count() == 0 == scan(empty(spark)).count()


def wrapped(text, width=60, prefix=" * "):
    return "\n".join(prefix + line for line in textwrap.wrap(text, width))


def test_notices_are_found_where_they_are_wrapped_or_share_a_line(spark):
    code = "\n".join(f"int f{i}(int x) {{ return x + {i}; }}" for i in range(200))
    whole = [name for name, text in TEMPLATES.items() if len(text.split()) > 12]
    rows = [(i, f"/*\n{wrapped(TEMPLATES[name])}\n */\n{code}") for i, name in enumerate(whole)]
    rows += [(100, "Copyright (c) 2020 Foo. Released under the MIT License."), (101, f"{code}\n{wrapped(TEMPLATES['MIT text'], prefix='# ')}\n{code}\n# Licensed under CC BY-NC 4.0.\n{code}"), (102, (TEMPLATES["MIT"] + " ") * 3000), (103, "the license of the software " * 20_000)]
    got = defaultdict(list)
    for r in scan(docs(spark, rows)).collect():
        got[r.doc_id].append((r.license, r.line, r.last_line, round(r.dice, 6)))
    for i, name in enumerate(whole):
        lines = len(textwrap.wrap(TEMPLATES[name], 60))
        assert got[i] == [(name, 2, 1 + lines, 1.0)]
    assert got[100] == [("MIT", 1, 1, 1.0)]
    assert sorted(x[0] for x in got[101]) == ["CC-BY-NC-4.0", "MIT text"] and min(x[1] for x in got[101]) == 201
    assert len(got[102]) == 1 and got[102][0][0] == "MIT" and 103 not in got


def test_license_scan_is_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(4)
    names = sorted(TEMPLATES)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            words = TEMPLATES[r.choice(names)].split()
            for _ in range(r.randrange(0, 1 + len(words) // 6)):
                words[r.randrange(len(words))] = r.choice(["the", "of", "Software", "other", "license"])
            parts.append(r.choice([" ", "\n"]).join(words[: r.randrange(1, 400)]))
            parts.append(" ".join(r.choices(["some", "other", "of", "the", "words"], k=r.randrange(9))))
        rows.append((i, r.choice(["\n", " "]).join(parts)))
    docs(spark, rows + rows[:3] + [(None, rows[5][1]), (77, None), (78, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op4_license_scan(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.license_sql()})").fetchall()
    short = lambda rows: sorted(str((*x[:4], round(x[4], 9), x[5])) for x in map(tuple, rows))
    assert short(want) == short(df.collect()) and len(want) > 60


def test_templates_come_from_a_table(spark):
    table = spark.createDataFrame([("own", "This text may be used by our friends only."), (None, "x y"), ("none", None)], "license string, text string")
    given = templates_of(table)
    assert given == {"own": "This text may be used by our friends only."} and len(TEMPLATES) >= 25
    got = scan(docs(spark, [(1, "a\nthis text may be used by our\nfriends only"), (2, TEMPLATES["MIT"])]), given).collect()
    assert [(r.doc_id, r.license, r.line, r.last_line) for r in got] == [(1, "own", 2, 3)]


# pages


def test_wrapper_induction(spark):
    def page(i, title):
        return f"<html><body><div>My site</div><div class=x><p>Story {i} &amp; {title}<p>more\n {i}</div><div>Call us now</div></body></html>"

    rows = [(i, f"http://Host.example/{i}", page(i, f"t{i}")) for i in range(8)]
    rows += [(50, "http://other.example/", page(1, "a")), (51, None, page(2, "b")), (52, "http://x.example/", None), (53, "no url", ""), (54, "http://x.example/", "<p>un<b>closed"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_wrapper.extract(df).collect()}
    assert got[3].text == "Story 3 & t3\nmore 3" and got[3].n_chars == len(got[3].text)
    assert got[50].text == "My site\nStory 1 & a\nmore 1\nCall us now"  # one page teaches no template
    assert (got[52].text, got[53].text, got[54].text, got[52].n_chars) == ("", "", "unclosed", 0)
    assert html_wrapper.extract(df).count() == len(rows) and html_wrapper.extract(df.limit(0)).count() == 0


def test_boilerplate_and_deep_markup():
    html = "<nav>n</nav><header>h</header><article><header>Title</header><p>a<!-- c --><script>s</script> b</p><div class='share-buttons'>s</div><section id=comments>c</section><ul><li><a href=x>l</a><li><a href=y>m</a></ul></article><footer>f</footer><p>out</p>"
    assert html_wrapper.main_text(html_wrapper.parse(html)) == "Title\na b"
    assert html_wrapper.main_text(html_wrapper.parse("<div>" * 5000 + "deep")) == "deep"


@pytest.mark.parametrize(
    "html",
    [
        "<body class='no-sidebar'><p>text</p></body>",
        "<body class='search'><p>text</p></body>",
        "<body><div class='content with-sidebar'><p>text</p></div></body>",
        "<div class='has-header-image page'><main class=search>text</main></div>",
        "<div id=search><main><p>text</main></div>",
        "<article class='post comments-open'><p>text</article>",
        "<article class=teaser><p>text</article>",
        "<main><article class=search>text</article></main>",
        "<div class='related'><article><p>text</article></div>",
        "<div data-id='menu' title='a class=menu'>text</div>",
        "<div class=widget><p>text</div>",
        "<article>text</article><div class=related-posts><article>other</article></div>",
        "<article>text</article><article class=comment>other</article>",
        "<main>text<div class='cookie-banner'>c</div><div class='site-header'>h</div><div class='ad ad-728x90'>a</div></main>",
    ],
)
def test_class_filter_keeps_the_article(html):
    assert html_wrapper.main_text(html_wrapper.parse(html)) == "text"


def test_all_outermost_articles_are_kept():
    html = "<div><article>one<article>in one</article></article></div><p>out</p><article class='entry-header'>two, the longest</article><article>three</article>"
    assert html_wrapper.main_text(html_wrapper.parse(html)) == "one\nin one\ntwo, the longest\nthree"


def tree_of(r, depth):
    if depth == 0 or r.random() < 0.3:
        return html_wrapper.Block("t")
    return html_wrapper.Node(r.choice("ab"), r.choice("ab"), children=[tree_of(r, depth - 1) for _ in range(r.randrange(1, 4))])


def matching_by_definition(a, b):
    if a.label != b.label:
        return 0

    def lists(xs, ys):
        if not xs or not ys:
            return 0
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), (matching_by_definition(xs[0], ys[0]) + lists(xs[1:], ys[1:])) if xs[0].label == ys[0].label else 0)

    return 1 + lists(a.kids, b.kids)


def test_tree_matching_is_brute_force():
    r = random.Random(3)
    for _ in range(200):
        a, b = (html_wrapper.folded(html_wrapper.Node("#root", "#root", children=[tree_of(r, 3) for _ in range(3)])) for _ in range(2))
        assert html_wrapper.Matching().score(a, b) == matching_by_definition(a, b)
        pairs = html_wrapper.Matching().align(a, b)
        assert len(pairs) == matching_by_definition(a, b) and all(x.label == y.label for x, y in pairs)


def test_long_lists_are_aligned_in_little_memory():
    r = np.random.default_rng(0)
    pair = r.integers(0, 3, (5, 5))
    for n, m in ((30, 40), (1500, 1700)):
        x, y = r.integers(0, 5, n), r.integers(0, 5, m)
        table = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m if n < 100 else 0):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + pair[x[i], y[j]])
        found = html_wrapper.heaviest(pair, x, y)
        assert all(a < c and b < d for (a, b, _), (c, d, _) in zip(found, found[1:])) and all(s == pair[x[i], y[j]] for i, j, s in found)
        assert sum(s for _, _, s in found) == (table[n, m] if n < 100 else html_wrapper.reach(pair, x, y)[-1])
    long = html_wrapper.folded(html_wrapper.parse("<body>" + "<p>a</p><h2>b</h2>" * 20_000))
    short = html_wrapper.folded(html_wrapper.parse("<body><div>x</div>" + "<p>a</p><h2>b</h2>" * 1000 + "<div>y</div>"))
    began = time.time()
    assert len(html_wrapper.Matching().align(long, short)) == 2 + 4000 and time.time() - began < 20


@pytest.mark.parametrize("html", ["<p>text</p><" + "x" * 200_000 + '"', "<p>text" + "<b>" * 200_000, "<p>text</p><title>" + "</title " * 100_000, "<p>text</p><div class='" + "ad-" * 70_000 + "x'></div>", "<p>text</p>" + '<a "' * 50_001])
def test_odd_markup_is_read_in_linear_time(html):
    began = time.time()
    assert html_wrapper.main_text(html_wrapper.parse(html)).startswith("text") and time.time() - began < 5


def bare_page(i, r, layout=0):
    """A page without a telling tag or class."""
    sentence = lambda n: " ".join(r.choice(("alpha", "beta", "gamma", "delta", "epsilon")) + str(r.randrange(99)) for _ in range(n)) + "."
    paragraphs = [sentence(r.randrange(20, 60)) for _ in range(r.randrange(1, 6))]
    links = "".join(f"<li><a href=/{r.randrange(9)}>{sentence(1)}</a>" for _ in range(5))
    story = f"<div><div>Title {i}</div>{''.join(f'<p>{p}</p>' for p in paragraphs)}<p>Sign up for our weekly letter.</p></div>"
    if layout:
        story = f"<section><div>Title {i}</div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</section>"
    html = f"<html><body><div><ul>{links}</ul></div><div>{sentence(6)}</div>{story}<div>All rights {i}. {sentence(4)}</div></body></html>"
    return html, "\n".join([f"Title {i}", *paragraphs])


def test_the_wrapper_finds_articles_without_telling_tags(spark):
    r = random.Random(0)
    rows, want = [], {}
    for i in range(60):
        html, want[i] = bare_page(i, r, layout=i % 3 == 0)
        rows.append((i, f"https://plain.example/{i}", html))
    rows += [(100 + i, f"https://plain.example/copy/{i}", rows[1][2].replace("<html>", f"<html lang=x{i}>")) for i in range(40)]  # copies of one page
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_wrapper.extract(df).collect()}
    assert all(got[i] == want[i] for i in want)
    assert {got[i] for i in range(100, 140)} == {want[1]}
    one = {x.page_id: x.text for x in html_wrapper.extract(df, references=1).collect()}
    assert all(one[i] == want[i] for i in want if i % 3)  # one reference knows one layout

def pages_of_layouts(nests, each, r, tail="<p>Sign up for our weekly letter.</p>"):
    """Rows and their texts: pages of one host without telling tags, whose stories stand in different elements."""
    rows, want = [], {}
    for nest in nests:
        for _ in range(each):
            i = len(rows)
            html, want[i] = bare_page(i, r, layout=1)
            story = html[html.index("<section>") + 9 : html.index("</section>")]
            inner = "".join(f"<{x}>" for x in nest) + story + tail + "".join(f"</{x}>" for x in reversed(nest))
            rows.append((i, f"https://many.example/{i}", html.replace(f"<section>{story}</section>", inner)))
    return rows, want


NESTS = [n for k in (1, 2) for n in itertools.permutations(("section", "blockquote", "center"), k)]


def test_a_host_with_more_layouts_than_references_is_read_whole(spark):
    rows, want = pages_of_layouts(NESTS, 6, random.Random(2))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_wrapper.extract(df).collect()} == want
    assert {x.page_id: x.text for x in html_wrapper.extract(df, references=1).collect()} == want


def test_trees_of_one_layout_are_all_merged(spark):
    nests = [("div",) * k + (x,) for x in ("address", "fieldset", "figure", "hgroup", "section") for k in (1, 2)]
    rows, want = pages_of_layouts(nests, 6, random.Random(4))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_wrapper.extract(df).collect()} == want


def test_what_does_not_fit_a_wrapper_is_in_a_further_one(spark):
    rows, want = pages_of_layouts(NESTS, 6, random.Random(5))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = df.select(F.lit("many.example").alias("host"), "html")
    trees = [json.dumps(html_wrapper.dumps(html_wrapper.folded(html_wrapper.parse(x[2])))) for x in rows]
    most = max(html_wrapper.folded(html_wrapper.parse(x[2])).weight for x in rows) + 4
    made = list(html_wrapper.unions(((json.loads(t), 0, 1, i) for i, t in enumerate(trees)), most))
    assert len(made) > 1 and sorted(k for u in made for k in u.keys) == list(range(len(rows)))
    for u in made:
        for k in u.keys:
            page = html_wrapper.folded(html_wrapper.parse(rows[k][2]))
            assert html_wrapper.Matching().score(u.tree, page) == page.weight
    wrappers, further = html_wrapper.induce(pages, 6, most, 0.5, 3, Scratch(spark, "wrapper"))
    assert wrappers.count() > 1 and further.count() == further.select("h").distinct().count() > 0
    assert {x.page_id: x.text for x in html_wrapper.extract(df, most_slots=most).collect()} == want


def test_last_children_stay_last():
    long, short = (html_wrapper.folded(html_wrapper.parse(f"<div>{x}</div>")).kids[0] for x in ("<h1>t</h1><p>a</p><h2>b</h2><p>c</p>", "<h1>t</h1><p>c</p>"))
    assert [(i, j) for i, j, _ in html_wrapper.Matching().best(long.kids, short.kids)] == [(0, 0), (3, 1)]


def test_hosts_of_very_long_pages_have_a_wrapper(spark):
    tail = "<p>Sign up for our weekly letter.</p>" + "<!--" + "x" * 1_000_000 + "-->"
    rows, want = pages_of_layouts([("div",)], 4, random.Random(6), tail)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_wrapper.extract(df).collect()} == want


def test_large_wrapper_tables_are_joined_by_salt(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, f"https://plain.example/{i}", bare_page(i, r)[0]) for i in range(12)] + [(50, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html_wrapper.extract(df).collect()), key=str)
    monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, html_wrapper.extract(df).collect()), key=str) == want


# packing


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(byte_bpe()[0])
    rows = corpus() + [(900, "  two  spaces "), (901, "a \n b<|endoftext|>c"), (902, "don't 12,3")]
    out = packing.pack(docs(spark, rows), byte_bpe(), window=64, shard_rows=30).collect()
    want = Counter()
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 64):
            part = ids[s : s + 64]
            want[(i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    windows = defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty(spark), byte_bpe()).count() == 0


def test_best_fit_is_the_tightest():
    r = random.Random(2)
    lengths = sorted((r.randint(1, 99) for _ in range(400)), reverse=True)
    room: list[int] = []
    for n, (at, offset) in zip(lengths, packing.best_fit_decreasing(lengths, 100)):
        fits = [(c, i) for i, c in enumerate(room) if c >= n]
        assert (at, offset) == ((min(fits)[1], 100 - min(fits)[0]) if fits else (len(room), 0))
        room[at:] = [*room[at:], 100] if at == len(room) else room[at:]
        room[at] -= n


# passages


def test_repeats_are_brute_force(spark):
    rows = corpus(4)
    out = substring.drop_repeats(docs(spark, rows), least=50, more=("score", "node")).collect()
    assert len(out) == len(rows) and out[0].score == "x"
    first: dict = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for s in range(len(words) - 49):
            if i is not None:
                key = tuple(words[s : s + 50])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t in rows:
        words = (t or "").encode().split()
        gone = {p for s in range(len(words) - 49) if i is not None and first[tuple(words[s : s + 50])] < i for p in range(s, s + 50)}
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        want[(i, len(words), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out)
    assert got == want and any(k[2] for k in want)
    assert substring.drop_repeats(empty(spark)).count() == 0


# neighbours


def test_nearest_neighbours(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 8))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    x[40:80] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(700, None), (720, [0.0] * 8), (740, [float("nan")] * 8), (760, [None] * 8), (780, [1.0] * 3), (None, [1.0] * 8), (800, [float("inf")] * 8), (7, rows[7][1])]
    df = spark.createDataFrame([(*v, 1) for v in rows + odd], "vec_id long, embedding array<float>, cell int")
    index = multi_index.MultiIndex(centroids=4, chunk_bytes=6400, block=8, group=2)
    got = defaultdict(list)
    for row in multi_index.search(df, F.col("vec_id") % 20 == 0, 5, index).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.rank, row.vec_id, row.score))
    assert set(got) == set(range(0, 600, 20))
    wide, hit = x.astype(float), 0
    for q, found in got.items():
        score = wide @ wide[q]
        best = sorted((-s, i) for i, s in enumerate(score) if i != q)[:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(math.isclose(s, score[i]) for _, i, s in found)
        hit += len({i for _, i in best} & {f[1] for f in found})
    assert hit >= 0.9 * 5 * len(got)
    assert [f[1] for f in got[40]] == [41, 42, 43, 44, 45]
    exact = multi_index.search(df, F.col("vec_id") % 20 == 0, 5, multi_index.MultiIndex(centroids=4, recall=1.0)).collect()
    for q in got:
        score = wide @ wide[q]
        assert [r.vec_id for r in sorted((r for r in exact if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in sorted((-s, i) for i, s in enumerate(score) if i != q)[:5]]
    few = multi_index.search(df.where("vec_id < 3"), F.col("vec_id") == 0, 5).collect()
    assert len(few) == 2 and multi_index.search(df.limit(0), F.lit(True)).count() == 0


def test_clustered_vectors_are_found_in_few_cells(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16))
    x = np.repeat(centres, 50, axis=0) + r.normal(size=(2000, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    walked = []
    whole = multi_index.share_walked
    multi_index.share_walked = lambda *a: walked.append(whole(*a)) or walked[-1]
    try:
        got = defaultdict(set)
        for row in multi_index.search(df, F.col("vec_id") % 20 == 0, 10).collect():
            got[row.query_id].add(row.vec_id)
    finally:
        multi_index.share_walked = whole
    hit = sum(len(set(np.argsort(-(x @ x[q]), kind="stable")[:11].tolist()) - {q} & got[q]) for q in got)
    assert walked[0] < 0.2 and hit >= 0.9 * 10 * len(got) and len(got) == 100


def test_repeated_rows_take_no_neighbours_place(spark):
    x = np.random.default_rng(3).normal(size=(60, 8))
    x[:12] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [rows[0]] * 15 + [rows[1]] * 4, "vec_id long, embedding array<double>")
    found = multi_index.search(df, F.col("vec_id") == 0, 5, multi_index.MultiIndex(centroids=2, chunk_bytes=6400, block=16))
    assert [r.vec_id for r in found.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


# language model


def test_katz_is_brute_force_whatever_is_cached(spark):
    rows = corpus(8, 40) + [(900, "only here once"), (901, "Once only here"), (902, "here once never")]
    df = docs(spark, rows)
    training = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    toks = lambda t: [*(t or "").encode().translate(katz.LOWER).split(), None]
    train = [toks(t) for i, t in rows if i is not None and i % 3]
    c1 = Counter(w for t in train for w in t)
    c2 = Counter(x for t in train for x in zip([None, *t], t))
    total = sum(c1.values())
    d1, d2 = (katz.discounts([0, *(sum(v == r for v in c.values()) for r in range(1, 7))], total) for c in (c1, c2))
    lost = sum(v * (1 - d1[v]) for v in c1.values() if v <= 5)
    p1 = {w: v * (d1[v] if v <= 5 else 1) / total for w, v in c1.items()}
    unknown = lost / total
    after = defaultdict(dict)
    for (h, w), v in c2.items():
        after[h][w] = v * (d2[v] if v <= 5 else 1) / c1[h]
    alpha = {}
    for h, seen in after.items():
        left, mass = 1 - sum(p1[w] for w in seen), sum(seen.values())
        keep = min(mass, 1 - 1e-6)
        after[h] = {w: p * keep / mass for w, p in seen.items()}
        alpha[h] = (1 - keep) / left
        assert math.isclose(sum(after[h].values()) + alpha[h] * (unknown + sum(p for w, p in p1.items() if w not in seen)), 1)
    prob = lambda h, w: after[h][w] if w in after.get(h, {}) else alpha.get(h, 1.0) * p1.get(w, unknown)
    want = {i: sum(math.log10(prob(h, w)) for h, w in zip([None, *toks(t)], toks(t))) for i, t in rows}
    small = katz.score_texts(df, training, katz.Katz(cached=64, hot_pairs=32, run_chars=3000, bucket_chars=5000)).collect()
    assert len(small) == len(rows)
    assert len(c1) > 4 * 64
    by_id = {r.doc_id: r for r in small}
    for i, t in rows:
        w, r = toks(t), by_id[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i is None or i % 3 == 0, len(w), sum(c1[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((c1[x] + 1) / (total + len(c1) + 1)) for x in w), rel_tol=1e-9)
    none = katz.score_texts(df, F.lit(False)).agg(F.max(F.abs("score")), F.max("train_tokens")).first()
    assert none[0] == 0 and none[1] == 0
    assert katz.score_texts(empty(spark), F.lit(True)).count() == 0
    for r in [*small, *katz.score_texts(df, training).collect()]:  # what is cached makes no difference
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9)


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(words.WordScan, "PIECE", 50)
    scan = words.WordScan(lower=True)
    text = "".join(r.choice(["a", "B", "cd ", "É", "\x1c", " ", "\t", "\n", "x" * 70]) for _ in range(5000)).encode()
    hashes, starts = scan.of(text)
    split = text.translate(katz.LOWER).split()
    assert len(hashes) == len(split) and all(text.translate(katz.LOWER)[s:].startswith(w) for s, w in zip(starts.tolist(), split))
    by_word = defaultdict(set)
    for h, w in zip(hashes.tolist(), split):
        by_word[w].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len(set(hashes.tolist())) == len(by_word)
    assert all(len(scan.of(t)[0]) == len(t.split()) for t in (b"", b" ", b"a", b" a", b"a ", b"\x0b\x0c"))


# tiling


def tiles_by_definition(item, doc, least):
    item_free, doc_free, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and item_free[i + n] and doc_free[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        item_free[i : i + n] = [False] * n
        doc_free[j : j + n] = [False] * n


def test_tiles_are_those_of_the_definition():
    r = random.Random(5)
    for _ in range(300):
        words, least = r.choice([1, 2, 3, 4, 8]), r.choice([1, 2, 3])
        item, doc = ([r.randrange(words) for _ in range(r.randrange(n))] for n in (16, 24))
        assert tiling.tile(np.array(item, np.uint64), np.array(doc, np.uint64), least) == tiles_by_definition(item, doc, least)


def test_tiling_of_long_repetitive_texts_is_quick():
    began = time.time()
    assert tiling.tile(np.full(50, 7, np.uint64), np.full(200_000, 7, np.uint64), 5) == [(0, 0, 50)]
    assert tiling.tile(np.full(20_000, 7, np.uint64), np.full(20_000, 7, np.uint64), 5) == [(0, 0, 20_000)]
    assert len(tiling.tile(np.tile(np.arange(3, dtype=np.uint64), 300), np.tile(np.arange(4, dtype=np.uint64), 8000), 2)) == 300
    assert time.time() - began < 10


def test_contamination(spark):
    words = [f"q{i}" for i in range(40)]
    item = " ".join(words)
    moved = " ".join(words[20:] + ["middle"] + words[:20]).upper() + "."
    rows = [(1, f"start {item} end"), (2, moved), (3, " ".join(words[:15])), (4, None), (5, ""), (6, "clean text of other words"), (None, item), (1, item), (7, "short one")]
    bench = spark.createDataFrame([(10, item, 1), (11, "short one", 1), (12, None, 1), (13, "", 1)], "item_id long, text string, doc_id int")
    got = sorted((str(r.doc_id), r.item_id, r.coverage) for r in tiling.contaminated(docs(spark, rows), bench, block_words=3).collect())
    assert got == [("1", 10, 1.0), ("1", 10, 1.0), ("2", 10, 1.0), ("7", 11, 1.0), ("None", 10, 1.0)]
    assert tiling.contaminated(docs(spark, rows), bench.limit(0)).count() == 0 == tiling.contaminated(empty(spark), bench).count()


DIR = "/root/testdata/sf0.001"
driver_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@driver_tables
def test_queries_keep_their_folds_and_columns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    one = queries.op1_toxic_spans(spark, DIR)
    assert one.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert [one.schema[c].dataType.simpleString() for c in one.columns[:4]] == ["bigint", "boolean", "double", "int"]
    rows = one.collect()
    assert len(rows) == len(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    nine = queries.op9_katz_backoff(spark, DIR)
    assert nine.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = nine.collect()
    tokens = {i: len((t or "").encode().split()) + 1 for i, t in texts.items()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.n_tokens == tokens[r.doc_id] and r.score < 0 for r in rows)
    assert {r.train_tokens for r in rows} == {sum(n for i, n in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2)}
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the model beats its base on texts it has not seen


@driver_tables
def test_queries_keep_their_contracts(spark):
    five = queries.op5_wrapper_induction(spark, DIR)
    assert five.columns == ["page_id", "url", "text", "n_chars"] and all(r.n_chars == len(r.text) for r in five.collect())
    six = queries.op6_best_fit_packing(spark, DIR)
    assert six.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    eight = queries.op8_inverted_multi_index(spark, DIR).collect()
    by_query = defaultdict(list)
    for r in sorted(eight, key=lambda r: (r.query_id, r.rank)):
        by_query[r.query_id].append(r)
    assert all(q % 20 == 0 and [r.rank for r in found] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found) for q, found in by_query.items())
    ten = queries.op10_string_tiling(spark, DIR)
    assert ten.columns == ["doc_id", "item_id", "item_words", "covered_words", "coverage"] and all(r.coverage >= 0.5 for r in ten.collect())


@driver_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_give_the_rows_of_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    plain = lambda r: str(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r))
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(plain, want)) == sorted(plain(tuple(r)) for r in df.collect())


def test_marked_tokens_are_those_beyond_chance():
    r = random.Random(2)
    texts, toxic = [], []
    for i in range(300):
        words = [f"w{r.randrange(200)}" for _ in range(30)] + (["vileword"] if i % 6 == 0 else [])
        texts.append(words)
        toxic.append(float(i % 6 == 0))
    for _ in range(40):  # near copies of one harmless text count once
        texts.append([*texts[1][:-1], "copied"])
        toxic.append(1.0)
    labelled = toxicity.Labelled()
    for t, y in zip(texts, toxic):
        labelled.add(t, y)
    forms = list(labelled.number)
    marked = toxicity.mark_tokens(forms, labelled.texts, np.array(labelled.toxic))
    assert [w for w, m in zip(forms, marked) if m] == ["vileword"]


def test_scores_of_very_long_texts(spark):
    model = toxicity.Field(word={"vile": 8.0}, bias=-4.0, link=(-5.0, 3.0, 6.0))
    text = "fine words " * 100_000 + "vile" + " fine words" * 100_000
    out = toxicity.score(docs(spark, [(1, text), (2, "fine words " * 3)]), model).collect()
    got = {r.doc_id: r for r in out}
    assert got[1].score > 0.5 > got[2].score and [(s.start, s.end) for s in got[1].spans] == [(1_100_000, 1_100_004)]


def test_very_long_texts_are_taken_whole(spark):
    r = random.Random(6)
    long = " ".join(f"l{r.randrange(3000)}" for _ in range(150_000))
    leak = " ".join(f"b{i}" for i in range(30))
    rows = [(1, long), (2, f"start {long} {leak} end"), (3, "short"), (4, "same " * 200_000), (5, "x" * 2_000_000)]
    df = docs(spark, rows)
    got = {x.doc_id: x for x in substring.drop_repeats(df).collect()}
    assert (got[2].n_words, got[2].n_removed, got[4].n_removed, got[5].n_words) == (150_032, 150_000, 0, 1)
    scored = {x.doc_id: x for x in katz.score_texts(df, F.col("doc_id") != 2).collect()}
    assert [scored[i].n_tokens for i in range(1, 6)] == [150_001, 150_033, 2, 200_001, 2] and scored[2].n_known == 150_001
    assert all(math.isfinite(x.score) for x in scored.values())
    bench = spark.createDataFrame([(10, leak)], "item_id long, text string")
    assert [(x.doc_id, x.tiles[0].doc_start) for x in tiling.contaminated(df, bench).collect()] == [(2, 150_001)]
    packed = packing.pack(df, byte_bpe()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(x.n == x["all"] for x in packed) and len(packed) == len(rows)


def test_scratch_scopes_drop_what_was_made_in_them(spark):
    with scope():
        inner = Scratch(spark, "inner")
        assert inner.keep(spark.range(3)).count() == 3
        path = inner.root.removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


PIPELINE_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows, labels=(), benchmark=()):
    spark.createDataFrame(rows, PIPELINE_DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).count() == 0


def test_pipeline_judges_rows_that_repeat_a_doc_id_on_their_own(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    text = [" ".join(f"w{r.randrange(900)}" for _ in range(80)) for _ in range(6)]
    leak = " ".join(f"b{i}" for i in range(30))
    rows = [(1, text[0]), (2, text[0] + " more"), (2, text[1]), (3, text[2]), (3, text[2]), (None, text[3]), (None, text[3]), (4, leak), (4, text[4]), (5, None), (5, None)]
    sf = written(spark, tmp_path, [(i, t, "en", "s", len(t or "")) for i, t in rows], benchmark=[(0, leak)])
    now = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(Counter((x.doc_id, x.text) for x in now.collect()))
    clean = Counter({(1, text[0]): 1, (2, text[1]): 1, (3, text[2]): 1, (None, text[3]): 2, (4, text[4]): 1, (4, leak): 1, (5, None): 1})
    assert kept[0] == Counter(rows) and kept[1] == clean
    del clean[(4, leak)]
    assert kept[3] == clean


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    text = [" ".join(f"w{r.randrange(500)}" for _ in range(120)) for _ in range(30)]
    passage = " ".join(f"p{i}" for i in range(60))
    text[10] = text[3] + " more"
    text[11], text[12] = text[11] + " " + passage, passage + " " + text[12]
    leak = " ".join(f"b{i}" for i in range(30))
    text[20] += " " + leak
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(text)] + [(99, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append({x.doc_id for x in now.select("doc_id").collect()})
        if name == "repeated_passages":
            kept = {x.doc_id: x.text for x in now.collect()}
            assert kept[12] == text[12].removeprefix(passage + " ") and kept[11] == text[11] and kept[99] is None
    everything = {*range(30), 99}
    assert ids == [everything, everything - {10}, everything - {10}, everything - {10, 20}, everything - {10, 20}]
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[-1]
