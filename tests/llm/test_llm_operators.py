"""Every training-data operator against brute force on a small table with nulls, empty and repeated texts and ties."""

import glob
import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import (
    decontaminate,
    fuzzy_lines,
    grouping,
    html_template,
    mixing,
    near_dedup,
    packing,
    quality_mil,
    quality_rules,
    toxicity,
    warc_fixity,
)
from lectern.session import materialise

SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Columns named like those that operators make.
EXTRA = "found string, key string, row string, shards int"


def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " \n\t ", "one", "One", "two words", "é ü ö # $", "x " * 3000]
    base = [rng.choice(words) for _ in range(60)]
    for _ in range(30):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(60)] = f"n{rng.randrange(9999)}"
        out.append(" ".join(w[:30]) + "\n" + " ".join(w[30:]))
    out += [out[-1], out[-2] + " tail", "line one\nline one\nLine, ONE!\n\nother " + " ".join(base[:12])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "ab"[i % 2] if i % 5 else None) for i, t in enumerate(texts())]
    rows += [(None, "no id " + "z " * 20, "en", "a"), rows[-1], (3, "one", None, None)]
    return spark.createDataFrame([(*r, "f", "k", "r", 1) for r in rows], f"doc_id long, text string, lang string, source string, {EXTRA}")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def groups(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ordered = sorted(ids)
    for k, a in enumerate(ordered):
        for b in ordered[:k]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_quality_counts(docs, none):
    got = quality_rules.filter_quality(docs).collect()
    assert len(got) == docs.count()
    by_text = {r.doc_id: r.text for r in docs.filter("doc_id is not null").collect()}
    for r in got:
        if r.doc_id is None:
            continue
        text = by_text[r.doc_id] or ""
        words = re.findall(SPACE_WORD, text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)} if len(words) < 500 else set(range(len(words)))
        lines = [x for x in text.split("\n") if re.search(SPACE_WORD, x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
        )
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.filter_quality(none).count() == 0


def test_sketch_buckets_are_close(spark):
    df = spark.range(0, 100_000, 37)
    for r in df.select("id", quality_rules.bucket_of(df.id).alias("b")).collect():
        assert r.b <= r.id and (r.id - r.b) * 64 <= max(r.id, 64) and (r.id > 127 or r.b == r.id)


def test_near_dedup(docs, none, monkeypatch):
    sets = {}
    for r in docs.filter("doc_id is not null").collect():
        w = re.findall(SPACE_WORD, lower(r.text))
        sets[r.doc_id] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else ({tuple(w)} if w else set())
    want = groups(sets, lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    for crowd in (64, 3):
        monkeypatch.setattr(grouping, "CROWD", crowd)
        monkeypatch.setattr(grouping, "BLOCK", 8)
        got = near_dedup.group_documents(docs).collect()
        assert len(got) == docs.count()
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i in want if want[i] == i}) and ids.count(None) == 1
    assert near_dedup.group_documents(none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in grouping.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, none, block_bytes):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    sample = [t for t in texts() if t]
    items = [(1, " ".join(sample[10].split()[3:25])), (2, "ONE"), (3, None), (4, "..."), (12, "é, Ü"), (12, "é, Ü"), (None, "two words")]
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = re.findall(pattern, lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    found = decontaminate.find_items(docs, table, block_bytes=block_bytes)
    assert set(found.columns) == set(docs.columns)
    got = {r.doc_id: r for r in decontaminate.digest(found).collect()}
    for r in docs.filter("doc_id is not null").collect():
        w, hit, ids = re.findall(pattern, lower(r.text)), set(), set()
        for g, of in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    ids |= of
        names = ",".join(sorted("null" if i is None else str(i) for i in ids))
        x = got[r.doc_id]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert x.items_sha256 == hashlib.sha256(names.encode()).hexdigest()
    assert decontaminate.find_items(none, table).count() == 0
    assert decontaminate.digest(decontaminate.find_items(docs, table.limit(0))).filter("contaminated").count() == 0


def test_decontamination_blocks_hold_no_repeats(spark, docs, monkeypatch):
    blocks, search = [], decontaminate.search_block
    monkeypatch.setattr(decontaminate, "search_block", lambda d, pairs, window: blocks.append(pairs) or search(d, pairs, window))
    items = [(i, f"item number {i} here") for i in range(8)] + [(20, "two words")] * 60
    found = decontaminate.find_items(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=200)
    assert sorted(p for b in blocks for p in b) == sorted({(i, t.encode()) for i, t in items}) and len(blocks) == 1
    assert {r.doc_id for r in decontaminate.digest(found).filter("contaminated").collect()} == {5}


def test_mixing(docs, none):
    plan = mixing.plan_mix(docs, block_words=50, shard_words=400).collect()
    assert len(plan) == docs.count()
    size, taken, target = {}, {}, {}
    for r in plan:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * len(r.shards)
        target[r.source] = r.target
        assert len(r.shards) <= 2 and (r.size or not r.shards)
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rest, open_, want = 1.5 * sum(size.values()), set(order), {}
    while over := [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]:
        want |= {s: 2.0 * size[s] for s in over}
        rest -= sum(2 * size[s] for s in over)
        open_ -= set(over)
    want |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in order:
        assert target[s] == pytest.approx(want[s]) and taken[s] <= target[s] + 1e-6
        # What is still missing is less than any document that could be taken once more.
        spare = [r.size for r in plan if r.source == s and 0 < r.size and len(r.shards) < 2]
        assert target[s] - taken[s] < min(spare, default=1)
    mixed = mixing.mix(docs, block_words=50, shard_words=400)
    assert mixed.columns == [*docs.columns, "shard"]
    assert mixed.count() == sum(len(r.shards) for r in plan)
    again = mixing.plan_mix(docs, block_words=50, shard_words=400).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.key, r.source or "", r.shards)
    assert sorted(map(key, plan)) == sorted(map(key, again))
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 7), (1, 0), (2, 1000), (3, 31)], "source_no int, quota long")
    rows = mixing.split_quotas(quotas, 3, 1).collect()
    by_source, by_shard = {}, {}
    for r in rows:
        assert r.n >= 0
        by_source[r.source_no] = by_source.get(r.source_no, 0) + r.n
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.n
    assert by_source == {0: 7, 1: 0, 2: 1000, 3: 31}
    assert len(by_shard) == 8 and max(by_shard.values()) - min(by_shard.values()) <= 3


def test_hypergeometric_mean(spark):
    from pyspark.sql import functions as F

    lit = lambda x: F.lit(x).cast("bigint")
    df = spark.range(2000).select(mixing.hypergeometric(lit(50), lit(20), lit(10), mixing.uniform("id")).alias("k"))
    got = np.array([r.k for r in df.collect()])
    assert got.min() >= 0 and got.max() <= 10 and abs(got.mean() - 4) < 0.15 and abs(got.var() - 10 * 0.4 * 0.6 * 40 / 49) < 0.25


def test_packing_round_trip(docs, none):
    packed = packing.pack_documents(docs.repartition(1), row_tokens=64, window_tokens=500)
    decode = packing.encoder(open(packing.VOCABULARY, "rb").read()).decode
    parts: dict = {}
    for r in packed.withColumn("at", packing.position_ids(packed.cu_seqlens)).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and r.n_tokens == r.cu_seqlens[-1] == len(r.at) and r.position_resets == r.cu_seqlens[:-1]
        assert [i for i, p in enumerate(r.at) if p == 0] == r.position_resets
        for a, b, d, k in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces, strict=False):
            parts.setdefault((d, k), []).append(ids[a:b])
    for r in docs.filter("doc_id <> 3 and doc_id <> 40").collect():
        whole = np.concatenate([parts[r.doc_id, k][0] for k in range(sum(d == r.doc_id for d, _ in parts))])
        assert whole[-1] == packing.END_ID and decode([int(x) for x in whole[:-1]]) == (r.text or "")
    assert packing.pack_documents(none).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 33) for _ in range(400)]
    rows = packing.pack(lengths, 32)
    assert sorted(i for r in rows for i in r) == list(range(400))
    free: list[int] = []
    for length in sorted(lengths, reverse=True):  # plain best fit
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(32 - length)
    assert len(rows) == len(free) and all(sum(lengths[i] for i in r) <= 32 for r in rows)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 300))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilestuff", "vilething"]) if i % 8 else "Rotten,"
        if i % 5 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en" if i % 8 else "de"))
        marks.append((i, int(i % 5 != 0), int(toxic)))
    rows += [(None, None, None), (900, "", "en"), (5, rows[5][1], "en")]
    marks += [(None, 1, 1), (901, 1, 0), (902, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_classifier_chain(labelled):
    docs, labels = labelled
    train = labels.filter("doc_id % 5 <> 1")
    chain = toxicity.train(docs, toxicity.categories_of(docs, train), toxicity.CATEGORIES)
    assert [len(link.earlier) for link in chain] == list(range(len(toxicity.CATEGORIES)))
    rows = toxicity.score(docs, chain, toxicity.CATEGORIES).collect()
    assert len(rows) == docs.count()
    wrong = sum((r.toxicity[-1] >= 0.5) != (r.doc_id % 4 == 0) for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 1)
    assert wrong <= 4
    assert all(r.toxicity[-1] < 0.5 for r in rows if not r.text)
    kept = toxicity.drop_toxic(docs, docs, train)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert toxicity.score(docs.limit(0), chain, toxicity.CATEGORIES).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, toxicity.categories_of(docs, train.limit(0)), toxicity.CATEGORIES), toxicity.CATEGORIES).count() == docs.count()


def test_multiple_instance_learning(labelled):
    docs, labels = labelled
    model = quality_mil.train(docs, labels.filter(~quality_mil.held_out(labels.doc_id)))
    rows = [r for r in quality_mil.score(docs, model).collect()]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    wrong = sum((r.score >= 0.5) != (r.doc_id % 5 != 0) for r in rows if r.doc_id is not None and r.doc_id < 400)
    assert wrong <= 8
    assert quality_mil.score(docs.limit(0), model).count() == 0
    blank = quality_mil.score(docs, quality_mil.train(docs, labels.limit(0))).collect()
    assert {r.score for r in blank} == {0.5}


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(7, 5)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    m = {"w1": rng.normal(size=(5, 4)), "b1": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "u": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "b": np.zeros(1)}
    weight = np.array([1.0, 2.0, 0.5])

    def loss():
        p = quality_mil.forward(x, first, m)["p"]
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).sum() / weight.sum())

    for name, grad in quality_mil.gradients(x, first, y, weight, m).items():
        for at in np.ndindex(m[name].shape):
            keep, eps = m[name][at], 1e-6
            m[name][at] = keep + eps
            up = loss()
            m[name][at] = keep - eps
            down = loss()
            m[name][at] = keep
            assert grad[at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>Menu {0}</li></ul></nav>"
    '<div class="cookie-notice">We use cookies</div><div class="story"><h1>Title&nbsp;{0}</h1><p>First &amp; <b>bold</b> text {0}'
    "<p>Second<br>line   {0}</p><aside>Side {0}</aside><script>var a='<p>x</p>';</script></div>"
    '<div id="comments"><p>Reader {0}</p></div><form>Send</form><footer>&copy; {0}</footer></body></html>'
)


def test_html_templates(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(i)) for i in range(8)]
    rows += [(90, None, None), (91, "http://h0.org/", ""), (92, "x", "plain &lt; text"), (93, "http://one.org/", "<article><p>Only &#233;</article>"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract(pages).collect()}
    for i in range(8):
        assert got[i] == f"Title {i} First & bold text {i} Second line {i}"
    assert (got[90], got[91], got[92], got[93]) == ("", "", "plain < text", "Only é")
    assert html_template.extract(pages).count() == len(rows) and html_template.extract(pages.limit(0)).count() == 0
    paths = {r.host: r.candidates for r in html_template.deduce_templates(pages).collect()}
    assert paths["h1.org"][0] == path_number("html", "body", "div.story")
    named = pages.withColumns({c: F.lit("x") for c in ("host", "text", "candidates", "dropped", "path")})
    assert {r.page_id: r.text for r in html_template.extract(named).collect()} == got


def path_number(*labels):
    path = html_template.ROOT_PATH
    for label in labels:
        path = html_template.below(path, label)
    return path


SITE = (
    "<html><head><title>Story {0}</title></head><body><nav><ul><li><a href='/{0}'>go {0}</a></li><li><a href='/x'>far {0}</a></li></ul></nav>"
    "<div class='ad'>Buy {0} now {1}</div><article><h1>Story {0}</h1><p>{2}</p><p>{2} <a href='/y'>more</a></p></article>"
    "<div><span>Filed</span> under {0} {1}</div><footer>&copy; site {0} {1}</footer></body></html>"
)


def site(n, **changed):
    rng = random.Random(4)
    words = lambda k: " ".join(f"w{rng.randrange(999)}" for _ in range(k))
    pages = [SITE.format(i, words(rng.randrange(1, 4)), words(rng.randrange(30, 60))) for i in range(n)]
    for old, new in changed.items():
        pages = [p.replace(f"class='{old}'", f"class='{new}'").replace(f"<{old}>", f"<{new}>").replace(f"</{old}>", f"</{new}>") for p in pages]
    return [(i, f"http://{'big' if i % 3 else 'small'}.org/{i}", p) for i, p in enumerate(pages)]


def test_html_results_do_not_hang_on_names(spark):
    """Adverts, menus and footers go by the template, whatever their classes and tags are called."""
    text = lambda rows: {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = text(site(24))
    for i, _, page in site(24):
        body = page[page.index("<p>") + 3 : page.index("</p>")]
        assert want[i] == f"Story {i} {body} {body} more"
    assert text(site(24, ad="zq7")) == want
    assert text(site(24, nav="div", footer="div")) == want
    assert text(site(24, ad="zq7", nav="div", footer="div")) == want


def test_html_classes_equal_a_plain_builder(spark):
    """Classes of tokens by occurrence vectors and their order, against vectors held whole."""
    rows = [r[:2] + (r[2] if r[0] % 4 else r[2].replace("<footer>", "<hr><section>s</section><footer>"),) for r in site(20)]
    rows += [(100 + i, "http://turned.org/", "<body><div class=a>one two</div><div class=b>x y</div></body>" if i % 2 else "<body><div class=b>x y</div><div class=a>one two</div></body>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    given = pages.select(html_template.host_of(F.col("url")).alias("host"), F.col("page_id").alias("page"), "html")
    vectors, orders = {}, {}
    for i, url, page in rows:
        for token, _, _, _, n, *_ in html_template.page_tokens(page):
            vectors.setdefault((url.split("/")[2], token), {})[i] = n
    classes = {}
    for (host, token), vector in vectors.items():
        classes.setdefault((host, frozenset(vector.items())), set()).add(token)
    table = html_template.token_table(given).collect()
    got = {}
    for r in table:
        got.setdefault((r.host, r.vector, r.support), set()).add(r.token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))
    assert all(r.support == len(vectors[r.host, r.token]) and r.most == max(vectors[r.host, r.token].values()) for r in table)
    once = spark.createDataFrame([(r.host, r.token, r.vector) for r in table if r.most == 1], "host string, token long, vector long")
    listed = once.groupBy("host").agg(F.collect_list(F.struct("token", "vector")).alias("classes"))
    for r in html_template.class_orders(given.select("host", "html"), listed).collect():
        orders.setdefault(r.host, []).append((r.in_order, r.words_in_order))
    assert orders["turned.org"] == [(False, False)]  # the two boxes change places, so all of the host's one class does not hold
    assert all(x == (True, True) for host in ("big.org", "small.org") for x in orders[host])
    mains = {r.host for r in html_template.deduce_templates(pages).collect()}
    assert mains == {"big.org", "small.org"}
    assert {r.text for r in html_template.extract(pages).collect() if r.page_id >= 100} == {"one two x y", "x y one two"}


def test_html_deep_markup_costs_its_length():
    deep = "<body>" + "<span>" * 100_000 + "text" + "<p>tail" + "<li>" * 1000
    start = time.perf_counter()
    tokens = html_template.page_tokens(deep)
    assert len(tokens) > 100_000
    assert html_template.main_text(deep, [path_number("body")], []) == "text tail"
    mixed = "<div>" + "<span><p>x" * 30_000
    assert html_template.main_text(mixed, [], []) == " ".join("x" * 30_000)
    assert time.perf_counter() - start < 20


def test_html_titles_and_leads_outside_the_main_element(spark):
    page = "<html><body><div>Daily Post</div><article><h1>Title {0}</h1><p>Lead {0}</p><div class='text'><p>{1}</p></div></article></body></html>"
    bold = "<html><body><article><h1>Head {0}</h1><p><b>{1}</b><p>Later {0}</article></body></html>"
    long = lambda i: " ".join(f"word{i}x{k}" for k in range(50))
    rows = [(i, f"http://a.org/{i}", page.format(i, long(i))) for i in range(6)]
    rows += [(10 + i, f"http://b.org/{i}", bold.format(i, long(i))) for i in range(6)] + [(20, "http://c.org/", bold.format(20, long(20)))]
    rows += [(30, "d", "<article class=a>One</article>or<article class=b>Two</article>")]
    got = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Title {i} Lead {i} {long(i)}"
        assert got[10 + i] == f"Head {i} {long(i)} Later {i}"
    assert (got[20], got[30]) == (f"Head 20 {long(20)} Later 20", "One Two")


def test_fuzzy_lines(spark, none):
    rng = random.Random(1)
    base = " ".join(f"common{i}" for i in range(40))
    rows = [(1, f"{base} alpha\nshort\n\nunique one"), (2, f"{base} alphb\nSHORT!\nsomething else"), (None, "short"), (3, None), (4, ""), (5, " ".join(f"r{rng.randrange(9999)}word" for _ in range(50))), (1, f"{base} alpha\nshort\n\nunique one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    powers = fuzzy_lines.X.Powers()
    forms = sorted({f for _, t in rows for _, f in fuzzy_lines.normal_lines((t or "").encode())})
    sims = [int(fuzzy_lines.lines_of([f], powers)[0][2].view(np.uint64)[0]) for f in forms]

    def linked(a, b):
        x, y = forms[a].decode(), forms[b].decode()
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return bin(sims[a] ^ sims[b]).count("1") <= 3 and row[-1] <= max(len(x), len(y)) * 20 // 100

    group = groups(range(len(forms)), linked)
    seen, want = set(), {}
    in_order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    for _, i, t in in_order:
        want[i] = []
        for n, f in fuzzy_lines.normal_lines(t.encode()):
            g = group[forms.index(f)]
            want[i] += [n] if g in seen else []
            seen.add(g)
    got = fuzzy_lines.duplicate_lines(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.removed == want[r.doc_id or 0]
    clean = {r.doc_id: r.text for r in fuzzy_lines.clean_documents(docs).collect()}
    assert clean[None] == "" and clean[3] is None and clean[4] == "" and clean[1] == rows[0][1]
    assert fuzzy_lines.duplicate_lines(none).count() == 0


def test_fuzzy_lines_are_those_of_edit_similarity_alone(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    forms = []
    for n in (1, 2, 3, 5, 9, 16, 30, 60):
        for _ in range(4):
            words = [word() for _ in range(n)]
            letters, some = list(" ".join(words)), list(words)
            letters[rng.choice([i for i, c in enumerate(letters) if c != " "])] = "7"
            some[n // 2 : n // 2 + max(1, n // 8)] = [word() for _ in range(max(1, n // 8))]
            forms += [" ".join(words), "".join(letters), " ".join(some), " ".join(words[: n - n // 8])]
    unspaced = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    forms += [unspaced, unspaced[:20] + "\u4e00" + unspaced[21:], unspaced[:37], "z " * 90 + "z", "z " * 95 + "z"]
    docs = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "doc_id long, text string")
    group = groups(range(len(forms)), lambda a, b: fuzzy_lines.edit_distance(forms[a], forms[b]) <= max(len(forms[a]), len(forms[b])) // 5)
    assert len(set(group.values())) < len(forms) // 2
    got = {r.doc_id: bool(r.removed) for r in fuzzy_lines.duplicate_lines(docs).collect()}
    assert got == {i: group[i] != i for i in group}


def test_short_lines_that_are_similar_share_a_key():
    rng = random.Random(12)
    forms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, fuzzy_lines.SHORT + 1))) for _ in range(900)})
    keys = [set(k.tolist()) for k in fuzzy_lines.shared_keys([f.encode() for f in forms], fuzzy_lines.X.Powers())[1]]
    near = [(a, b) for a in range(len(forms)) for b in range(a) if fuzzy_lines.similar(forms[a], forms[b])]
    assert len(near) > 100 and all(keys[a] & keys[b] for a, b in near)


def test_edit_distance_and_its_bound():
    rng = random.Random(8)
    words = [f"w{i}" * rng.randrange(1, 4) for i in range(12)]
    tight = 0
    for _ in range(400):
        x = [rng.choice(words) for _ in range(rng.randrange(1, 30))]
        y = [rng.choice(words) if rng.random() < 0.2 else w for w in x if rng.random() < 0.9] or ["z"]
        a, b = " ".join(x), " ".join(y)
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        assert fuzzy_lines.span_edits(a, b) >= row[-1] == fuzzy_lines.edit_distance(a, b)
        assert fuzzy_lines.similar(a, b) == (row[-1] <= max(len(a), len(b)) // 5)
        tight += fuzzy_lines.span_edits(a, b) == row[-1]
    assert fuzzy_lines.edit_distance("", "é") == 1 and fuzzy_lines.edit_distance("", "") == 0
    assert tight and fuzzy_lines.span_edits("same words", "same words") == 0


def test_pairs_that_share_a_phrase_are_settled_by_their_quarters(monkeypatch):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(3, 9)))
    phrase, a, b = " ".join(word() for _ in range(6)), [], []
    for n in [1, 3, 8, 20, 30, 45, 60, 90, 400] * 12:
        x = [word() for _ in range(n)]
        for rate in (0.05, 0.15, 0.22, 1):
            y = [word() if rng.random() < rate else w for w in x]
            a.append(" ".join([*x, phrase]))
            b.append(" ".join(y[1:] + [phrase] if rng.random() < 0.5 else [phrase, *y]))
    want = [fuzzy_lines.similar(x, y) for x, y in zip(a, b)]
    assert fuzzy_lines.all_similar(a, b).tolist() == want == fuzzy_lines.all_similar(b, a).tolist() and 50 < sum(want) < 300
    least = fuzzy_lines.beginnings([x[:70] for x in a], b)
    assert all(m == min(fuzzy_lines.edit_distance(x[:70], y[:j]) for j in range(150)) for m, x, y in list(zip(least, a, b))[:40])
    measured = []
    monkeypatch.setattr(fuzzy_lines, "distances", lambda x, y: measured.extend(x) or np.zeros(len(x), int))
    unlike = [" ".join([*(word() for _ in range(60)), phrase, *(word() for _ in range(20))]) for _ in range(200)]
    fuzzy_lines.all_similar(unlike[:100], unlike[100:])
    assert len(measured) < 5


def test_written_tables_keep_no_shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: sum(1 for d in env.blockManager().diskBlockManager().localDirs() for _ in glob.glob(f"{d}/*/shuffle_*"))
    before = files()
    table = materialise(spark.range(20000).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    ends = time.time() + 20
    while files() > before and time.time() < ends:
        time.sleep(0.2)
    assert files() <= before and table.count() == 700


def test_fixity_audit(spark, tmp_path):
    rows = [(f"a{i % 2}", 40_000 * (i // 2), bytes([i]) * 9) for i in range(60)] + [("c", 0, b""), (None, 0, b"z")]
    a = spark.createDataFrame(rows, "archive string, offset long, record binary")
    other = [r if k != 17 else (*r[:2], b"damaged") for k, r in enumerate(rows) if k not in (4, 60)] + [("d", 5, b"new")]
    b = spark.createDataFrame(other, a.schema)
    got = {(r.archive, r.offset): r.problem for r in warc_fixity.audit(a, b).collect()}
    assert got == {("a1", 320_000): "changed", ("a0", 80_000): "missing", ("c", 0): "missing", ("d", 5): "extra"}
    assert warc_fixity.audit(a, a.union(a)).count() == 0
    assert warc_fixity.audit(a.limit(0), a.limit(0)).count() == 0


def test_warc_reader(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é" * (i * 13 % 400)) for i in range(200)] + [(None, None, None)], "page_id long, url string, html string")
    written = warc_fixity.archive_pages(pages, per_archive=500).orderBy("archive", "offset").collect()
    (tmp_path / "w").mkdir()
    for name in {r.archive for r in written}:
        (tmp_path / "w" / name).write_bytes(b"".join(bytes(r.record) for r in written if r.archive == name))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = warc_fixity.read_records(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.archive.rpartition("/")[2], r.offset, bytes(r.record)) for r in got) == sorted((r.archive, r.offset, bytes(r.record)) for r in written)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.conftest import SMALL

    docs = first = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SMALL), "test")
        assert docs.count() > 0
        if name != names[-1]:
            assert docs.columns == first.columns
    assert set(r.d for r in docs.selectExpr("explode(doc_ids) d").collect()) <= set(r.doc_id for r in first.collect())


def test_lines_with_a_common_phrase_are_compared_by_their_other_runs(spark, monkeypatch):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    phrase, forms = " ".join(word() for _ in range(7)), []
    for _ in range(120):
        words = [word() for _ in range(40)]
        forms.append(" ".join([*words[:20], phrase, *words[20:]]))
    # Near copies: of some of these lines, of one line that has many, and of short lines of the phrase alone.
    unlike = len(forms)
    forms += [x[:80] + "7" + x[81:200] + "7" + x[201:] for x in forms[:12]]
    many = " ".join(word() for _ in range(40))
    forms += [f"{many} {i}" for i in range(40)] + [f"{phrase} {i}" for i in range(30)]
    docs = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "doc_id long, text string")
    compared, confirmed = [], fuzzy_lines.confirmed
    monkeypatch.setattr(fuzzy_lines, "confirmed", lambda pairs, *rest: compared.append(pairs.count()) or confirmed(pairs, *rest))
    got = {r.doc_id: bool(r.removed) for r in fuzzy_lines.duplicate_lines(docs).collect()}
    assert got == {i: i >= unlike and i not in (unlike + 12, unlike + 52) for i in range(len(forms))}
    assert sum(compared) < 20 * len(forms)


def test_pairs_of_a_part_hold_every_two_lines_of_a_key(spark):
    rng = np.random.default_rng(16)
    f = fuzzy_lines
    keys = (f.X.mix(rng.integers(0, 40, 600).astype(np.uint64)) | np.uint64(1 << 63)).view(np.int64)
    lines, sizes = rng.integers(-300, 300, 600), np.full(600, 100)
    sims = f.X.mix(lines.view(np.uint64)).view(np.int64) & 31
    batches = [f.packed(False, 3, keys[a:b], lines[a:b], sizes[a:b], None) for a, b in ((0, 200), (150, 600))]
    batches.append(f.packed(True, 3, np.arange(600) % 90, lines, sizes, sims))
    rows = spark.createDataFrame([tuple(r.values()) for b in batches for r in b.to_pylist()], f.PARTS)
    want, crowds = Counter(), set()
    groups = defaultdict(set)
    for k, x in zip(keys.tolist(), lines.tolist()):
        groups[k].add((x, 0))
    for k, x, s in zip((np.arange(600) % 90).tolist(), lines.tolist(), sims.tolist()):
        groups[k].add((x, s))
    for k, some in groups.items():
        if len(some) > f.COMMON:
            crowds |= {(k >= 0, x, s) for x, s in some}
        else:
            want.update((min(a, b), max(a, b)) for (a, s), (b, t) in itertools.combinations(sorted(some), 2) if (s ^ t).bit_count() <= f.RADIUS)
    got = f.met(rows).collect()
    found = Counter()
    for r in got:
        if r.n:
            found[r.a, r.b] += r.n
    assert found == want and len(want) > 500
    assert {(r.key >= 0, r.a, r.sim) for r in got if not r.n} == crowds
