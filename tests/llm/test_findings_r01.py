"""What the first review found cut off, each against brute force or hand-built rows."""

import math
from collections import Counter

import pytest

from labelwright.llm import decontam, html_extract, lm_score


def brute_lm(rows, target, s):
    """doc_id, losses: every word counts, a document's own counts left out."""
    own = [r for r in rows if r[0] in target]

    def counts(some):
        uni, ctx, two = Counter(), Counter(), Counter()
        for _, text in some:
            w = text.split()
            uni.update(w)
            ctx.update([None, *w][: len(w)])
            two.update(zip([None, *w], w))
        return uni, ctx, two

    every, good = counts(rows), counts(own)
    n_every, n_good = sum(every[0].values()), sum(good[0].values())
    v, out = len(every[0]), {}
    for i, text in rows:
        mine, w = counts([(i, text)]), text.split()
        losses = []
        for model, n, scale, member in ((good, n_good, 1.0, i in target), (every, n_every, n_good / n_every, True)):
            uni, ctx, two = ({k: x - member * m[k] for k, x in c.items()} for c, m in zip(model, mine))
            left, loss = n - member * len(w), 0.0
            for a, b in zip([None, *w], w):
                u = (max(uni.get(b, 0) - s.discount, 0) + s.discount * len(model[0]) / v) / left if left > 0 else 1 / v
                loss -= math.log((two.get((a, b), 0) * scale + s.prior * u) / (ctx.get(a, 0) * scale + s.prior))
            losses.append(loss / len(w))
        out[i] = losses
    return out


def test_op4_knows_every_word(spark):
    # one shape and one frame of common words for all; only the rare words tell the two topics apart
    def text(k, topic):
        return " ".join(f"the {topic}{(k * 7 + j) % 30 + 10} of" for j in range(12))

    rows = [(k, text(k, "ab" if k % 2 else "cd")) for k in range(40)]
    target = set(range(1, 20, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    s = lm_score.Setting(vocabulary=2, tokens_block=200)
    got = {r.doc_id: r for r in lm_score.score_corpus(docs, ids, s).collect()}
    want = brute_lm(rows, target, s)
    for i, (a, b) in want.items():
        assert got[i].target_loss == pytest.approx(a) and got[i].background_loss == pytest.approx(b) and got[i].score == pytest.approx(a - b)
    assert max(got[i].score for i in range(21, 40, 2)) < min(got[i].score for i in range(20, 40, 2)) - 0.1


def test_op4_edges(spark):
    rows = [(1, "a b"), (1, "a b c"), (None, "a b"), (2, None), (3, " \n"), (4, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (None,), (9,)], "doc_id long")
    got = lm_score.score_corpus(docs, ids).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 2), (1, 3), (2, 0), (3, 0), (4, 1)]
    assert all((r.score is None) == (r.n_tokens == 0) for r in got)
    assert all(math.isfinite(r.score) for r in lm_score.score_corpus(docs.where("text > ' a'"), ids.limit(0)).collect())


def shown(html):
    return html_extract.text_of(html_extract.parse(html), set())


def test_op5_attribute_values_are_no_names():
    for attrs in ('style="overflow:hidden"', 'title="the hidden cost"', "data-hidden=x", 'alt="a class=nav b"', "data-role='navigation'", "title=hidden"):
        assert shown(f"<p>a</p><div {attrs}><p>kept</p></div>") == "a\n\nkept", attrs
    for attrs in ("hidden", "HIDDEN=''", 'class="x nav"', "id = 'footer'", "role=navigation", "aria-hidden='true'", 'title="x"hidden'):
        assert shown(f"<p>a</p><div {attrs}><p>gone</p></div>") == "a", attrs


def test_op5_raw_elements_cut_nothing_else():
    assert shown('<p>before</p><svg class="i"/><p>after</p>') == "before\n\nafter"
    assert shown('<p>b</p><svg/><p>mid</p><svg><text>t</text><svg>u</svg><title>v</title></svg><p>after</p>') == "b\n\nmid\n\nafter"
    for tag in ("svg", "iframe", "object", "noscript", "template"):
        assert shown(f"<p>before</p><{tag} id=q><p>after</p>") == "before\n\nafter", tag
    assert shown("<p>a</p><svg><p>b</p><svg>c</svg><p>d</p>") == "a\n\nb\n\nd"
    assert shown("<p>a</p><script>if (a < b) x()") == "a"
    assert shown("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> holds</p><p>e <math/> f</p></article>") == "so x=2 holds\n\ne f"


def test_op2_items_without_literals(spark):
    items = [(1, "What is 12 + 15 + 3?"), (2, "Anna Bruno Carla David Emil Frida Gustav Hanna Ida Jonas"), (3, "too short"), (4, "?!"), (5, "Mount Fuji")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "he asked: what is 12 + 15 + 3? and left"), (2, "he asked: what is 12 + 15 + 4? and left"), (3, "list of Anna Bruno Carla David Emil Frida Gustav Hanna Ida Jonas here"),
        (4, "list of Bruno Anna David Carla Frida Emil Hanna Gustav Jonas Ida here"), (5, "it was too short for him"), (6, "it was too, so short"), (7, "Mount Etna"), (8, "?! ?!"), (9, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 2), (5, 3)} and all(r.verbatim and r.n_covered == r.n_tokens for r in got.values())
    assert {r.doc_id for r in decontam.keep_clean(docs, bench).collect()} == {2, 4, 6, 7, 8, 9}
