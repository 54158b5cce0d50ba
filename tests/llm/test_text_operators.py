import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import html_extract, mixing, nbsvm, pii, quality_rules, warc


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Quality rules.


def test_base_rules_equal_sql(docs, rows, labels):
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", [(r[0], r[1]) for r in rows])
    expected = duck.sql(quality_rules.BASE_SQL)
    found = quality_rules.quality_rules(docs, quality_rules.trusted_documents(labels))
    assert sorted(map(tuple, found.select(*expected.columns).collect())) == sorted(expected.fetchall())


@pytest.mark.parametrize("buckets", [256, 1 << 12])
def test_ratio_equals_brute_force(docs, rows, labels, buckets):
    features = {}
    for doc_id, text, *_ in rows:
        crc = [zlib.crc32(w.encode()) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        features[doc_id] = [c % buckets for c in crc] + [(quality_rules.PAIR * a + b) % buckets for a, b in zip(crc, crc[1:])]
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    raw, aim = Counter(), Counter()
    for d, f in features.items():
        raw.update(f)
        aim.update(f if d in trusted else [])
    n_raw, n_aim = sum(raw.values()), sum(aim.values())
    target = [(aim[b] + 50 * n_aim / n_raw) / (n_aim + buckets * 50 * n_aim / n_raw) for b in range(buckets)]
    weight = [math.log(target[b]) - math.log((raw[b] + 50) / (n_raw + buckets * 50)) for b in range(buckets)]
    scores = {d: sum(weight[b] for b in f) / len(f) if f else 0.0 for d, f in features.items()}
    at = sorted(scores.values())[len(scores) // 2] + 1e-5
    found = by_id(quality_rules.quality_rules(docs, quality_rules.trusted_documents(labels), buckets=buckets, threshold=at))
    for d, score in scores.items():
        assert abs(found[d]["score"] - score) < 2e-6
        if abs(score - at) > 2e-6:
            assert found[d]["kept"] == (not found[d]["base_failed"] and score >= at)
    assert len({r["kept"] for r in found.values() if not r["base_failed"]}) == 2


def test_whole_words_are_hashed(spark):
    """Words that differ after many signs only are different n-grams."""
    texts = spark.createDataFrame([("a" * 5000 + "x",), ("a" * 5000 + "y",)], "text string")
    one, other = [r["h"] for r in texts.select(quality_rules._hashes(quality_rules.native_words("text"), 1 << 16).alias("h")).collect()]
    assert one != other


def test_quality_odd_rows(spark, odd_docs, no_docs, labels):
    trusted = quality_rules.trusted_documents(labels)
    found = quality_rules.quality_rules(odd_docs, trusted)
    assert found.count() == odd_docs.count()
    kept = quality_rules.keep_good(odd_docs, trusted)
    assert kept.columns == odd_docs.columns and kept.count() == found.where("kept").count() > 0
    nobody = quality_rules.quality_rules(odd_docs, trusted.limit(0))
    assert all(r["score"] == 0 and r["kept"] != r["base_failed"] for r in nobody.collect())
    assert quality_rules.quality_rules(no_docs, trusted).count() == 0 and quality_rules.keep_good(no_docs, trusted).count() == 0


# HTML.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="home"><header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- x <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div id="page"><aside>Side</aside><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p>First   para<b>graph</b>
 here.<p>Second <a href="x">link</a> one with quite some more text in it &lt;ok&gt; &copy; 5&#x20AC;.<br>After break<ul><li>one<li>two</ul>
<form><input value="x">Form</form><div class="comments"><p>Reader says</p></div><table><tr><td>c1<td>c2</table></article>
<div class="related-posts"><a href="1">r</a></div></div><footer>&copy; foot</footer></body></html>"""


def test_page():
    assert html_extract.main_text(PAGE).split("\n") == [
        "Title & more", "First paragraph here.", "Second link one with quite some more text in it <ok> © 5€.", "After break", "one", "two", "c1", "c2",
    ]


@pytest.mark.parametrize(
    "source,expected",
    [
        (None, ""), ("", ""), ("<html><body><nav>only a menu</nav></body></html>", ""), ("no markup", "no markup"), ("<p>a<p>b", "a\nb"),
        ("<article><p>cut off here and th", "cut off here and th"), ("<article><p>text</p><p class=", "text"), ("a < b and <3", "a < b and <3"),
        ("<div><p>un&closed &am", "un&closed &am"), ("<article><h1>only</h1></article>", "only"), ("<p title='>'>q</p>", "q"), ("<p>x</p><script>never ends", "x"),
        ("<p>x</p><!-- never ends", "x"),
    ],
)
def test_odd_pages(source, expected):
    assert html_extract.main_text(source) == expected


def test_densest_part_without_semantic_elements():
    links = "".join(f'<li><a href="{k}">topic {k}</a></li>' for k in range(30))
    body = "".join(f"<p>Sentence {k} of the story, which goes on for a while so that there is much text.</p>" for k in range(8))
    text = html_extract.main_text(f"<html><body><div><ul>{links}</ul></div><div>{body}</div><div><a href='z'>imprint</a></div></body></html>")
    assert len(text.split("\n")) == 8 and "topic" not in text and "imprint" not in text


@pytest.mark.parametrize("name", ["layout no-sidebar", "has-header", "with-comments", "sidebar", "widget"])
def test_wrappers_with_noisy_names_keep_their_article(name):
    page = f'<body><div class="{name}"><article><h1 class="page-header">Title</h1><p>Some text of it.</p></article></div><div class="ad">Buy</div></body>'
    assert html_extract.main_text(page) == "Title\nSome text of it."


def test_most_of_a_page_is_not_noise_by_its_name():
    page = f'<body><div id="overlay"><p>{"word " * 50}</p><p>more of it</p><div class="comments">No</div></div><div class="ad">Buy</div></body>'
    assert html_extract.main_text(page).split() == ["word"] * 50 + ["more", "of", "it"]


def test_formulas_and_objects_are_text():
    page = "<body><article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.<p><object data='a.swf'>A figure</object> here</article></body>"
    assert html_extract.main_text(page) == "Let x=1 be.\nA figure here"


def plain_choice(page):
    """Densities from their definition over each node's descendants, and the node of the largest sum."""
    n = len(page.tag)
    below = [[j for j in range(i + 1, n) if i in up(page, j) and not page.noise[j]] for i in range(n)]
    size = [sum(len("".join(t.split())) for node, _, t in page.texts if node == i) for i in range(n)]
    in_link = [page.tag[i] == "a" or any(page.tag[j] == "a" for j in up(page, i)) for i in range(n)]
    chars = [size[i] + sum(size[j] for j in below[i]) for i in range(n)]
    link_chars = [sum(size[j] for j in [i, *below[i]] if in_link[j]) for i in range(n)]
    link_tags = [sum(page.tag[j] == "a" for j in below[i]) for i in range(n)]
    body = page.tag.index("body")

    def density(i):
        if page.noise[i] or not chars[i]:
            return 0.0
        c, t, lc, lt = chars[i], max(1, len(below[i])), max(1, link_chars[i]), max(1, link_tags[i])
        base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + link_chars[body] / max(1, chars[body]) * c + math.e)
        ratio = math.log(max(1.0, c / lc * t / lt))
        return c / t * ratio / (math.log(base) if base > 1.000001 and math.log(base) > 1e-6 else 1.0)

    d = [density(i) for i in range(n)]
    block = [i == body or any(page.tag[j] in html_extract.BLOCK - ({"br"} if j != i else set()) for j in [i, *below[i]]) for i in range(n)]
    total = [sum(d[j] for j in below[i] if page.parent[j] == i and block[j]) for i in range(n)]
    inside = [i for i in [body, *below[body]] if block[i]]
    path = [densest := max(inside, key=lambda i: (d[i], -i)), *[j for j in up(page, densest) if j >= body]]
    best = max((i for i in inside if d[i] >= min(d[j] for j in path)), key=lambda i: (total[i], -i))
    return d, total, best if total[best] else body


def up(page, i):
    out = []
    while i > 0:
        i = page.parent[i]
        out.append(i)
    return out


def test_densities_equal_their_definition():
    import pyarrow.parquet as pq

    pages = [r for r in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if r] + [PAGE]
    seen = 0
    for source in pages:
        page = html_extract._Page(source)
        if page.texts and any(t.strip() for _, _, t in page.texts):
            d, total, best = plain_choice(page)
            _, density, sums, _, _ = page.densities()
            assert density == pytest.approx(d) and sums == pytest.approx(total) and page.main()[0] == best
            seen += 1
    assert seen > 200


def part(n, size, **marks):
    return "".join(f"<p>{'word ' * size}{k}</p>" for k in range(n))


@pytest.mark.parametrize("first", [True, False])
def test_density_chooses_between_unmarked_parts(first):
    """Two parts, neither of them named: long paragraphs win over short teasers full of links, wherever they stand."""
    story, teasers = part(6, 40), "".join(f'<p>see <a href="{k}">teaser {k} of the day</a> <a href="m{k}">more</a></p>' for k in range(8))
    parts = [f"<div>{story}</div>", f"<div>{teasers}</div>"]
    text = html_extract.main_text(f"<body>{''.join(parts if first else parts[::-1])}</body>")
    assert len(text.split("\n")) == 6 and "teaser" not in text
    # An article element is no ticket: the denser part is taken.
    text = html_extract.main_text(f"<body><article>{teasers}</article><div>{story}</div></body>")
    assert len(text.split("\n")) == 6 and "teaser" not in text


def test_menus_in_main_and_headlines_in_headers():
    links = "".join(f'<li><a href="{k}">topic {k}</a></li>' for k in range(20))
    page = f"<body><main><header><h1>Title</h1></header>{part(5, 30)}<ul>{links}</ul></main><header>Site</header></body>"
    lines = html_extract.main_text(page).split("\n")
    assert lines[0] == "Title" and len(lines) == 6 and "topic" not in "".join(lines) and "Site" not in lines


def test_open_tags_cost_nothing():
    import time

    for page in ("<b>" * 40_000 + "</i>" * 40_000, "<p><button>" + "<b>" * 20_000 + "<p>x</p>" * 20_000, "<table>" * 20_000 + "<td>x" * 20_000):
        began = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - began < 5


def test_deep_and_long_pages():
    assert html_extract.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(html_extract.main_text("<article>" + "<p>word</p>" * 20_000)) == 5 * 20_000 - 1


def test_pages_in_spark(spark):
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "<p>x", 0)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(found) == 4 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Mixing.


@pytest.mark.parametrize("goal", [{"max_repeats": 2.0}, {"max_repeats": 1.2}, {"max_repeats": 1e9}, {"entropy_share": 0.95}, {"max_repeats": 3.0, "budget": 9000.0}])
def test_mixture_equals_brute_force(spark, docs, rows, goal):
    sizes = {r[0]: len([w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w]) + 1 for r in rows}
    source = {r[0]: r[3] for r in rows}
    total = Counter()
    for d, n in sizes.items():
        total[source[d]] += n
    shares = {s: n / sum(total.values()) for s, n in total.items()}
    plan = mixing.Mixture(docs, **goal)
    weights = mixing.tempered(list(shares.values()), plan.exponent)
    if "entropy_share" in goal:
        assert plan.exponent == 1.0 or mixing.entropy(weights) <= 0.95 * math.log(len(shares)) + 1e-9
    else:
        assert mixing.repeats(list(shares.values()), weights) <= goal["max_repeats"] * (1 + 1e-9)
        assert plan.exponent == 0 or mixing.repeats(list(shares.values()), mixing.tempered(list(shares.values()), plan.exponent - 1e-6)) > goal["max_repeats"]
    budget = goal.get("budget") or max(total[s] / w for s, w in zip(shares, weights))
    keys = {(r["__id"], e): r[f"k{e}"] for r in plan.sized.select("__id", *[mixing._hash(F.lit(0), F.lit(e), F.col("__id")).alias(f"k{e}") for e in range(40)]).collect() for e in range(40)}
    expected = Counter()
    for s, w in zip(shares, weights):
        left, epoch = max(1, round(w * budget)), 0
        while left > 0:
            for d in sorted((d for d in sizes if source[d] == s), key=lambda d: keys[d, epoch]):
                if left > 0:
                    expected[d, epoch] += 1
                    left -= sizes[d]
            epoch += 1
    found = plan.places().collect()
    assert Counter((r["doc_id"], r["epoch"]) for r in found) == expected
    assert all(r["source"] == source[r["doc_id"]] and r["n_tokens"] == sizes[r["doc_id"]] and 0 <= r["block"] < 64 for r in found)
    if "budget" not in goal:
        assert {r["doc_id"] for r in found} == set(sizes)  # nobody is left out
    assert Counter(r["doc_id"] for r in plan.realised().collect()) == Counter(d for d, _ in expected.elements())


@pytest.mark.parametrize("goal", [{"max_repeats": 2.0}, {"max_repeats": 1e9}, {"entropy_share": 0.95}])
def test_many_sources_are_mixed_alike(docs, goal, monkeypatch):
    few = mixing.Mixture(docs, **goal)
    expected = sorted(map(str, few.places().collect()))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    many = mixing.Mixture(docs, **goal)
    assert many.exponent == pytest.approx(few.exponent, abs=2e-9) and many.budget == pytest.approx(few.budget)
    assert sorted(map(str, many.places().collect())) == expected
    assert many.realised().count() == len(expected)


def test_mixing_odd_rows(odd_docs, no_docs):
    plan = mixing.Mixture(odd_docs)
    assert plan.realised().columns == odd_docs.columns and plan.realised().count() == plan.places().count() >= odd_docs.count()
    assert mixing.Mixture(no_docs).places().count() == 0 and mixing.Mixture(no_docs).realised().count() == 0
    assert mixing.bisected([1.0], 2.0) == 0.0


# Personal data.

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            check = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            good = [True, k == 1 and all(int(p) <= 255 for p in m[0].split(".")), 12 <= len(digits) <= 19 and check, 9 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(1)
    pieces = ["a.b", "@", "x-y.com", ".", "..", "+1", " (017) 555-7713", "10.0.0.1", "256.1.1.1", "001.02.3.0004", "4111111111111111", "4111 1111-1111 1111", " ", "-", "é", "%x", "12345", "0", "\n", "+", "1.2.3.4.5.6.7.8", "9" * 25, "@@"]
    for _ in range(3000):
        text = "".join(pieces[k] for k in rng.integers(0, len(pieces), rng.integers(1, 9)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_linear_on_long_texts():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 100_000, "+1(" * 100_000, "1 " * 100_000, "(" * 200_000 + "1"):
        pii.mentions(text, pii.base_spans(text))


def test_contexts_find_unseen_identifiers(spark):
    rng = np.random.default_rng(2)
    docs = [(k, f"{'lorem ' * int(rng.integers(1, 5))}please write to user{k}@mail{k}.example.com today {k}") for k in range(30)]
    docs += [(100, "you may please write to admin@intranet today"), (101, "see note@home for this"), (102, "and also please write to Jörg@büro.example today")]
    docs += [(200 + k, f"order number {1000 + k} was shipped {k}") for k in range(40)]
    found = by_id(pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")))
    text = dict(docs)
    for d, expected in ((100, "admin@intranet"), (102, "Jörg@büro.example")):
        start = text[d].index(expected)
        assert f"email:{start}:{start + len(expected)}" in found[d]["spans"].split(",") and found[d]["n_added"] == 1
    assert found[100]["n_email"] == 0 and found[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(r["n_added"] == 0 for d, r in found.items() if d not in (100, 102))


def plain_accepted(edges, support, confidence, rounds):
    """Round by round: (pattern, kind) and confidence of what is accepted."""
    under = {}
    for pattern, instance, kind, seed in edges:
        under.setdefault(pattern, []).append((instance, kind, seed))
    kinds = {k for _, _, k, _ in edges if k >= 0}
    good = {}
    for _ in range(rounds):
        def score(instance, kind, seed):
            if seed:
                return 1.0
            misses = [1 - c for (p, k), c in good.items() if k == kind and any(i == instance and k2 == kind for i, k2, _ in under[p])]
            return 1 - math.prod(misses)

        now = {}
        for p, own in under.items():
            for k in kinds:
                weight = sum(score(i, k2, seed) for i, k2, seed in own if k2 == k)
                if weight >= support and weight / (len(own) + 1) >= confidence:
                    now[p, k] = weight / (len(own) + 1)
        if len(now) == len(good):
            return now
        good = now
    return good


def test_patterns_equal_a_plain_bootstrap(spark):
    rng = np.random.default_rng(8)
    rate, edges = rng.uniform(0.3, 1.0, 40), []
    for i in range(1200):
        home = int(rng.integers(40))
        kind = home % 3 if rng.random() < 0.95 else -1
        seed = kind >= 0 and bool(rng.random() < rate[home])
        near = {home * 4 + int(rng.integers(4)) for _ in range(3)} | {(home + 3) % 39 * 4 + int(rng.integers(4))}
        edges += [(p, i, kind, seed) for p in near]
    expected = plain_accepted(edges, 3.0, 0.7, 8)
    first = plain_accepted(edges, 3.0, 0.7, 1)
    found = pii.accepted_patterns(spark.createDataFrame(edges, "pattern long, instance long, kind int, seed boolean"), 3.0, 0.7, 8).collect()
    assert {(r["pattern"], r["kind"]) for r in found} == set(expected) and len(expected) > len(first) > 0
    assert all(r["confidence"] == pytest.approx(expected[r["pattern"], r["kind"]], abs=1e-4) for r in found)


def test_found_identifiers_bear_out_further_patterns(spark):
    """Seeds accept one context; what it introduces accepts a second one, which introduces what no seed ever stood by."""
    first = [(k, f"{'a' * (k % 7 + 1)} please write to user{k}@mail{k}.example.com now") for k in range(90)]
    both = [(100 + k, f"{'b' * (k % 5 + 1)} please write to clerk{k}@intranet{k} now, or ask the office at clerk{k}@intranet{k} then") for k in range(12)]
    last = [(200, "you may ask the office at desk@reception then"), (201, "nothing of desk@elsewhere here")]
    found = by_id(pii.find_personal_data(spark.createDataFrame(first + both + last, "doc_id long, text string")))
    assert found[200]["n_added"] == 1 and found[201]["n_added"] == 0 and all(found[100 + k]["n_added"] == 2 for k in range(12))
    assert all(found[k]["n_added"] == 0 and found[k]["n_spans"] == 1 for k in range(90))


def test_keys_by_their_context(spark):
    key = lambda k, case=str: case(hashlib.sha1(str(k).encode()).hexdigest())
    docs = [(k, f"{'x' * (k % 9 + 1)} token = \"{key(k)}\" here") for k in range(20)]
    docs += [(100, f'so TOKEN = "{key(100, str.upper)}" it is'), (101, 'a token = "Zm9vYmFyQmF6MDEyMzQ1Njc4OQ==" too'), (102, f"built from {'a1b2c3d4e5' * 4} of the tree")]
    docs += [(103, 'a token = "aa4111111111111111bb0c1d2e3f405162738495" here')]  # a card number within
    found = by_id(pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")))
    for d, text in docs:
        start = text.find('"') + 1
        own = "" if d == 102 else f"secret:{start}:{text.index(chr(34), start)}"
        assert found[d]["spans"].split(",")[0] == own and found[d]["n_spans"] == (d != 102) + found[d]["n_card"]
    assert found[103]["n_card"] == 1


def test_personal_data_odd_rows(spark, odd_docs, no_docs):
    df = spark.createDataFrame([(1, "a@b.co 10.0.0.1 é +1 (017) 555-7713"), (1, "a@b.co 10.0.0.1 é +1 (017) 555-7713"), (2, None), (None, "c@d.ef")], "doc_id long, text string")
    found = pii.find_personal_data(df).collect()
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in found) == [(0, "email:0:6"), (1, "email:0:6,ip:7:15,phone:18:35"), (1, "email:0:6,ip:7:15,phone:18:35"), (2, "")]
    assert pii.find_personal_data(odd_docs).count() == odd_docs.count() and pii.find_personal_data(no_docs).count() == 0


# Classifier.


def test_classifier(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'good' if y else 'BAD!!'}{rng.integers(40)}" if rng.random() < 0.3 else f"word{rng.integers(500)}" for _ in range(60)) for y in (np.arange(600) % 2)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(10_000, ""), (10_001, None), (None, "word1"), (3, texts[3])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(600)], "doc_id long, quality int, toxic int")
    found = nbsvm.classify(docs, labels).collect()
    assert len(found) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in [*range(600), 10_000, 10_001] if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held if r["doc_id"] < 600]) > 0.95
    flipped = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, 1 - quality, quality) as quality", "toxic")
    assert sorted(map(repr, nbsvm.classify(docs, flipped).collect())) == sorted(map(repr, found))  # held-out labels are not read


def test_classifier_without_two_classes(docs, odd_docs, no_docs, labels):
    assert {r["score"] for r in nbsvm.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in nbsvm.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert nbsvm.classify(odd_docs, labels).count() == odd_docs.count() and nbsvm.classify(no_docs, labels).count() == 0


def plain_features(text):
    found = set()
    for kind, words in enumerate((text.split(), re.sub(r"(A)A+|(a)a+|(0)0+", r"\1\2\3", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", text)))).split())):
        found |= {(kind, w) for w in words} | {(kind, *p) for p in zip(words, words[1:])}
    return found


def test_scores_equal_plain_naive_bayes_support_vectors(spark):
    """Log-count ratios, unit vectors and the largest margin, from n-grams as text, by another way to the optimum."""
    rng = np.random.default_rng(9)
    vocabulary = [["alpha", "Beta", "c3"], ["delta", "EPS", "z"]]
    texts = [" ".join(rng.choice(vocabulary[k % 2] if rng.random() < 0.6 else sum(vocabulary, []), 5)) for k in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(90)], "doc_id long, quality int, toxic int")
    found = by_id(nbsvm.classify(docs, labels))
    learnt = [k for k in range(90) if zlib.crc32(str(k).encode()) % 3 != 1]
    fitted = [k for k in learnt if zlib.crc32(b"calibrate" + str(k).encode()) % 5]
    sign = {k: 1.0 if k % 2 else -1.0 for k in range(90)}
    sides = {y: Counter(f for k in fitted if sign[k] == y for f in plain_features(texts[k])) for y in (1.0, -1.0)}
    size = {y: sum(c.values()) + (1 << nbsvm.BITS) for y, c in sides.items()}
    ratio = lambda f: math.log((sides[1.0][f] + 1) / size[1.0]) - math.log((sides[-1.0][f] + 1) / size[-1.0])
    names = sorted(set().union(*(plain_features(t) for t in texts)))
    x = np.array([[ratio(f) if f in plain_features(t) else 0.0 for f in names] for t in texts])
    x = np.hstack([x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True)), np.ones((90, 1))])
    y = np.array([sign[k] for k in fitted])
    cost = np.array([len(fitted) / 2 / (y == s).sum() for s in y])
    # The dual by projected gradients.
    k = (x[fitted] * y[:, None]) @ (x[fitted] * y[:, None]).T
    alpha, step = np.zeros(len(fitted)), 1 / np.linalg.eigvalsh(k)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (k @ alpha - 1), 0, cost)
    margin = x @ ((alpha * y) @ x[fitted])
    logit = np.array([math.log(found[d]["score"] / (1 - found[d]["score"])) for d in range(90)])
    slope, shift = np.polyfit(margin, logit, 1)
    assert slope > 0 and np.abs(slope * margin + shift - logit).max() < 0.02 * np.ptp(logit)
    held = np.array([d for d in learnt if d not in fitted])  # the logistic function is the likeliest one there
    p, truth = 1 / (1 + np.exp(-logit[held])), np.array([d % 2 for d in held])
    assert abs((truth - p).sum()) < 0.05 and abs(((truth - p) * margin[held]).sum() - 1e-3 * (slope - 1)) < 0.05


def test_clashing_labels_and_bounds(spark):
    docs = spark.createDataFrame([(k, ("good fine " if k % 2 else "bad poor ") * 3) for k in range(200)], "doc_id long, text string")
    rows = [(k, k % 2, 0) for k in range(200)]
    clash = spark.createDataFrame(rows + [(k, 1 - k % 2, 0) for k in range(0, 200, 7)] + rows[1:50], "doc_id long, quality int, toxic int")
    found, y, _ = nbsvm.labelled_features(docs, clash)
    learnt = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 != 1 and k % 7]
    assert len(found) == len(learnt) and y.tolist() == [1.0 if k % 2 else -1.0 for k in learnt]
    assert len(nbsvm.labelled_features(docs, clash, most=30)[0]) == 30
    assert 0 < len(nbsvm.labelled_features(docs, clash, most_bytes=500)[0]) <= 500 / 27


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(80)]
    labels = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    values = [rng.normal(size=8) for _ in rows]
    costs = np.full(80, 0.7)
    w, bias = nbsvm.dual_coordinate_descent(rows, values, labels, costs, epochs=3000)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + sum(c * max(0.0, 1 - y * (w[r] @ v + b)) for r, v, y, c in zip(rows, values, labels, costs))
    least = loss(w, bias)
    assert all(least <= loss(w + d * (np.arange(len(w)) < 30), bias + e) + 1e-4 for d, e in ((rng.normal(size=len(w)) * s, rng.normal() * s) for s in (1e-3, 1e-2, 0.1) for _ in range(20)))


# WARC.


def test_archives_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    page = lambda n: "<html>" + " ".join(f"tag{x}" for x in rng.integers(0, 300, n)) + "é\r\n\r\n</html>"
    big = page(400)
    rows = [(k, f"http://h/{k}", page(int(rng.integers(1, 900))), 0) for k in range(300)] + [(1000 + k, "http://h/x\r\ny", big, 0) for k in range(40)]
    rows += [(2000, None, None, 0), (2001, "u", "", 0), (2002, "u", "same", 0), (2003, "u", "same", 0), (1003, "http://h/x\r\ny", big, 0), (None, "u", "no id", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    manifest = warc.write_archives(pages, str(tmp_path), archive_bytes=100_000)
    assert manifest.count() > 3 and len(list(tmp_path.glob("*.warc.zst"))) == manifest.count() and not list(tmp_path.glob("*.part"))
    found = warc.read_archives(manifest, str(tmp_path)).collect()
    assert len(found) == len(rows)
    text = {r[0]: r[2] or "" for r in rows}
    for r in found:
        payload = text[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        copy = text[r["page_id"]] == big and r["page_id"] != 1039
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1039) if copy else ("response", None))
        assert r["payload"] == (None if copy else payload)
    assert warc.write_archives(pages.limit(0), str(tmp_path)).count() == 0


def test_each_record_is_a_frame_and_damage_shows():
    import zstandard as zstd

    records = [warc.record(k, "u", f"payload {k} ".encode() * 50, 550, hashlib.sha1(b"x").hexdigest(), None) for k in range(50)]
    data = warc.archive(records)
    size = int.from_bytes(data[4:8], "little")
    own = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(data[8 : 8 + size]))
    rest, n = data[8 + size :], 0
    while rest:
        one = zstd.ZstdDecompressor(dict_data=own).decompressobj()
        text, rest, n = one.decompress(rest), one.unused_data, n + 1
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
    assert n == 51 and len(list(warc.records_of(data))) == 51
    for cut in (20, 2000):
        with pytest.raises(ValueError, match="the archive ends"):
            list(warc.records_of(data[:-cut]))
    with pytest.raises(ValueError):
        list(warc.records_of(b"\x28\xb5\x2f\xfd" + data))


def test_archive_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    expected = duck.sql(warc.ORACLE_SQL)
    found = warc.archived(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert sorted(map(tuple, found.select(*expected.columns).collect())) == sorted(expected.fetchall())
