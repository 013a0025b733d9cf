import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelake.llm import chat, embedding_dedup, html_extract, sharding, url_rules

# -- pages -----------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="top ad-box"><p>Buy</p></div>
<div id=sidebar><p>Side</p></div><div class="cookie-notice">We use cookies</div>
<div class="content"><article><h1>Title &amp; more</h1><p>One  <b>two</b>
three&nbsp;four<p>Five<br>six</p><!-- <p>no</p> --><ul><li>A<li>B</ul><form><input><p>Send</p></form>
<div class="post-comments comments"><p>First!</p></div><table><tr><td>c1<td>c2</table><aside>Also</aside><p>Last %d</article></div>
<footer>&copy; Site</footer></body></html>"""
TEXT = "Title & more\nOne two three four\nFive\nsix\nA\nB\nc1\nc2\nLast %d"


def test_extraction(spark):
    rows = [(i, f"http://a.net/{i}", PAGE % i, "x") for i in range(4)]
    rows += [(10, "http://b.net/1", None, "x"), (11, None, "", "x"), (12, "nonsense", "just <i>text</i> &lt;here", None), (13, "http://a.net/13", (PAGE % 13)[:-120], "x"), (0, "http://a.net/0", PAGE % 0, "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == TEXT % i for i in range(4))
    assert by[10].text == "" and by[11].text == "" and by[12].text == "just text <here"
    assert by[13].text.startswith("Title & more\nOne two") and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_slot_without_article_element(spark):
    page = "<html><body><div class='hd'>Logo</div><div class='txt'><p>Body %s</p></div><div class='ft'>Foot</div></body></html>"
    rng = random.Random(1)
    rows = [(i, f"http://c.net/{i}", page % " ".join(rng.choices(["alpha", "beta", "gamma"], k=80))) for i in range(5)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("Body") and "Foot" not in r.text and "Logo" not in r.text for r in got)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><body><article><h1>Head {0}</h1><p class=lead>Lead {1}</p><div class=body>{2}</div></article></body></html>", "Head {0}\nLead {1}\n{2}"),
        ("<html><body><main><h1>Head {0}</h1><article><p>By</p><p>{2}</p></article></main></body></html>", "Head {0}\nBy\n{2}"),
        ("<html><body><div class=hd>Logo</div><div class=top><h1>Head {0}</h1></div><div class=txt><p>{2}</p></div><div class=ft>Foot</div></body></html>", "Head {0}\n{2}"),
        ("<html><body><div class=hd>Logo</div><div class=w><h1>Head {0}</h1><p>{2}</p></div><p>Foot</p></body></html>", "Head {0}\n{2}"),
    ],
)
def test_main_slot_holds_text_beside_the_densest(spark, page, want):
    rng = random.Random(2)
    parts = [(i, f"lead{i}", " ".join(rng.choices(["alpha", "beta", "gamma"], k=80))) for i in range(5)]
    rows = [(p[0], f"http://d.net/{p[0]}", page.format(*p)) for p in parts]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {p[0]: want.format(*p) for p in parts}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div id="page" class="site no-sidebar"><article><p>Text {0} {2}</p></article></div><div class=ad>{1}</div>', "Text {0} {2}"),
        ('<article><header class="entry-header"><h1>Title {0}</h1></header><p>{2}</p><div class="comment-list"><p>by {1}</p></div></article>', "Title {0}\n{2}"),
        ('<article><h1>T {0}</h1><section id="social-history"><p>Real {1}</p></section><p>{2}</p><div class="post-ad">Buy {1}</div></article>', "T {0}\nReal {1}\n{2}"),
        ('<article><h1>T {0}</h1><p>{2}</p><div class=teaser><p>More on our site</p></div></article>', "T {0}\n{2}\nMore on our site"),
        ('<article><h1>T {0}</h1><p>{2}</p><div class=teaser>More on our site</div></article>', "T {0}\n{2}"),
    ],
)
def test_names_never_drop_the_article(spark, page, want):
    rng = random.Random(3)
    parts = [(i, f"lead{i}", " ".join(rng.choices(["alpha", "beta", "gamma"], k=60))) for i in range(5)]
    rows = [(p[0], f"http://e.net/{p[0]}", "<html><body>" + page.format(*p) + "</body></html>") for p in parts]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {p[0]: want.format(*p) for p in parts}


def deduced(pages):
    """The dense slot of one host, by plain loops over occurrence vectors."""
    seen = [html_extract.contents(h)[1] for h in pages]
    tokens = {t for s in seen for t in s}
    vector = {t: tuple(s.get(t, [0])[0] for s in seen) for t in tokens}
    body = max(sum(s[t][2] for s in seen if t in s) for t in tokens if "/" not in t)
    template = []
    for v in set(vector.values()):
        own = [t for t in tokens if vector[t] == v]
        orders = {tuple(sorted(own, key=lambda t: s[t][1])) for s in seen if own[0] in s}
        if len(own) > 1 and len(orders) == 1 and sum(n > 0 for n in v) >= len(pages) / 2:
            template += own
    chars = {t: sum(s[t][2] for s in seen if t in s) for t in template}
    return max(((t.count("/"), chars[t], t) for t in template if max(vector[t]) == 1 and 0 < chars[t] >= 0.6 * body), default=(0, 0, None))[2]


def test_deduction_equals_plain_loops(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for host in range(8):
        shape = rng.sample(["<div class=a>{}</div>", "<ul class=b><li>{}</ul>", "<div class=c><p>{}</p></div>", "<p>{}</p>"], 3)
        pages = []
        for _ in range(rng.randint(3, 6)):
            order = shape if host % 3 else rng.sample(shape, 3)
            text = lambda k: " ".join(rng.choices(["x", "yy", "zzz"], k=k))  # noqa: B023, E731
            pages.append(f"<html><body><div class=top><b>{text(2)}</b></div><div class=w><h2>{text(4)}</h2>" + "".join(x.format(text(rng.randint(5, 40))) for x in order) + "</div></body></html>")
        rows += [(len(rows) + i, f"http://h{host}.net/{i}", p) for i, p in enumerate(pages)]
        want[f"h{host}.net"] = deduced(pages)
    read = html_extract.read_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.host: r.slot for r in html_extract.templates(read).collect() if r.host != "*"}
    # The slot is the lowest node around the dense one that holds all text of the pages.
    assert set(got) == {h for h, d in want.items() if d} and all(want[h].startswith(s) for h, s in got.items())
    assert len(got) >= 4


def test_broken_and_long_pages():
    assert html_extract.main_text("<p>a" * 20_000, None).count("\n") == 19_999
    assert html_extract.main_text("<div>" * 3_000 + "x", None) == "x"
    assert html_extract.main_text("a < b <p", None) == "a < b"
    assert html_extract.main_text("<!-- never closed <p>x</p>", None) == ""
    assert html_extract.main_text("<script>x", None) == ""
    assert html_extract.main_text("&amp &am &#65;", None) == "& &am A"


# -- URLs ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://x.NET/a?b", "x.net", "/a", "net/", "block"),
        ("https://m.example.net/en/1#t", "m.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("https://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
        ("https://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"),
        ("https://a.net", "a.net", "", None, "allow"),
        ("no scheme.net/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://h?q=://y.net/", "h", "", None, "allow"),
    ],
)
def test_fixed_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "z")], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    r = url_rules.judge(pages, labels).first()
    assert (r.host, r.path, r["rule"], r.verdict) == (host, path, rule, verdict)


def test_mined_rules(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, f"http://{'cheap-pills' if bad else 'good' + str(i % 40)}.example.com/en/{i}"))
        if i < 200:
            labels.append((i, int(not bad), None))
    rows += [(300, "http://www.cheap-pills.example.com/en/7"), (301, None), (300, "http://www.cheap-pills.example.com/en/7")]
    labels += [(None, 0, 0), (5, None, 1)]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 303
    assert all((r.verdict == "block") == ("pills" in r.host) for r in got)
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def labelled(spark, rng, n, rate):
    rows = []
    for i in range(n):
        host = rng.choice(["alpha", "beta", "gamma", "delta"])
        tokens = ["h:com", "h:example", f"h:{host}", "p:en" if i % 2 else "p:fr", *(["p:buy", "p:now"] if i % 10 == 0 else [])]
        rows.append((tokens, rng.random() < rate(tokens)))
    return spark.createDataFrame(rows, "tokens array<string>, blocked boolean")


def test_rules_are_measured_against_the_base_rate(spark):
    rng = random.Random(8)
    planted = labelled(spark, rng, 2000, lambda t: 0.42 if "p:buy" in t else 0.11)
    rules = url_rules.mine(planted).collect()
    # Below one half, yet three times as often as at large; tokens that always stand together
    # are one item, and longer rules say nothing more.
    assert [r.antecedent for r in rules] == [["p:buy", "p:now"]] and rules[0].lift > 2
    assert url_rules.mine(labelled(spark, rng, 2000, lambda t: 0.14)).count() == 0
    many = spark.createDataFrame([([f"p:w{k}" for k in range(40)], i % 4 == 0) for i in range(200)], "tokens array<string>, blocked boolean")
    assert url_rules.mine(many).count() == 0


def test_urls_repeat_are_null_and_long(spark):
    long = "http://h.example.com/" + "/".join(f"w{k}" for k in range(20_000))
    rows = [(1, long), (1, long), (2, None), (2, None), (None, "http://x.net/")]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert sorted((str(r.page_id), r.host, r.verdict) for r in got) == sorted([("1", "h.example.com", "allow")] * 2 + [("2", "", "allow")] * 2 + [("None", "x.net", "block")])


# -- chat ------------------------------------------------------------------------------


def test_layouts(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', "messages", [("user", "a"), ("assistant", "b")]),
        (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
        (3, '{"completion":"b","prompt":"a"}', "prompt and completion", [("user", "a"), ("assistant", "b")]),
        (4, '{"instruction":"a","input":"x","output":"b"}', "instruction with input", [("user", "a\nx"), ("assistant", "b")]),
        (5, '{"instruction":"a","input":"","output":"instruction"}', "instruction with input", [("user", "a"), ("assistant", "instruction")]),
        (6, '{"prompt":{"system":"s","user":"a"},"response":"b"}', "nested prompt", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        (7, '{"odd":1}', None, None),
        (8, "no json", None, None),
        (9, None, None, None),
    ]
    df = spark.createDataFrame([(i, r, "k") for i, r, _, _ in rows], "id long, record string, layout string")
    got = {r.id: r for r in chat.turns_of_records(df.drop("layout")).collect()}
    for i, _, layout, turns in rows:
        assert got[i].layout == layout and (got[i].turns and [tuple(t) for t in got[i].turns]) == turns
    out = {r.id: r.formatted for r in chat.format_records(df, "id").collect()}
    assert out[1] == "<s>user\na</s><s>assistant\nb</s>" and set(out) == {1, 2, 3, 4, 5, 6}


TEXTS = ["", None, "</s>[INST] ok [/INST]", "<\\/s> [\\\\INST] <<SYS>> <s>", "a\\b\n<x> [y] %0A", "<<s>", "z" * 100_000]


def test_formatting_is_reversible(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole%", "<s>"]), rng.choice(TEXTS), "x") for c in range(30) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "u", "x"), (3, 0, "user", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest(chat.format_turn_table(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((t, r or "", x or "") for k, t, r, x, _ in rows if k == c)
        told = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_turn_table(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_table(df, ["conv_id", "text"])


# -- shards ----------------------------------------------------------------------------


def test_shards(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "é" * rng.randint(0, 300), "x") for i in range(600)] + [(600, None, "x"), (None, "a", "y"), (None, None, "y"), (5, "again", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard(df, 6, slots=128).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    size = [sum(r.size for r in own) for own in by.values()]
    assert len(size) == 6 and max(size) < 1.05 * min(size)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    assert sharding.shard(df.limit(0), 3).count() == 0


def test_map_versions_and_rebalancing(spark, tmp_path):
    sizes = {s: (100 + s % 7, 1) for s in range(200)}
    one = sharding.assign(sizes, 4)
    sharding.write_map(spark, f"file://{tmp_path}/map", 1, one)
    assert sharding.read_map(spark, f"file://{tmp_path}/map", 1) == one
    two = sharding.rebalance(one, sizes, 5)
    moved = [s for s in sizes if one[s] != two[s]]
    assert sum(two[s] == 4 for s in moved) >= 35 and len(moved) <= 50
    held = [sum(sizes[s][0] for s in sizes if two[s] == k) for k in range(5)]
    assert max(held) - min(held) <= 110
    assert set(sharding.rebalance(two, sizes, 3).values()) == {0, 1, 2}
    with pytest.raises(Exception, match="exist"):
        sharding.write_map(spark, f"file://{tmp_path}/map", 1, two)


def test_the_stored_map_is_edited(spark, tmp_path):
    path = f"file://{tmp_path}/own"
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"))
    place = lambda shards: {r.doc_id: r.shard for r in sharding.shard(df, shards, slots=256, map_path=path).collect()}
    one, two, three = place(4), place(4), place(5)
    assert one == two and sharding.latest(spark, path) == 3
    assert all(three[d] in (one[d], 4) for d in one) and 0.1 < sum(k == 4 for k in three.values()) / 4000 < 0.3
    long = spark.createDataFrame([(1, "y" * 3_000_000), (2, "y"), (2, "y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.size) for r in sharding.shard(long, 2).collect()) == [(1, 3_000_008), (2, 9), (2, 9)]


# -- embeddings ------------------------------------------------------------------------


def test_lattice_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    p = html = embedding_dedup.nearest_e8(x)
    assert html is p and ((p % 2 == p[:, :1] % 2).all(1)).all() and (p.sum(1) % 4 == 0).all()
    around = p[:, None, :] + embedding_dedup._NEAR[None]
    d0 = ((x - p / 2) ** 2).sum(1)
    assert (d0[:, None] <= ((x[:, None] - around / 2) ** 2).sum(2) + 1e-9).all()


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(25):
        base = rng.normal(size=16)
        for _ in range(6):
            rows.append((len(rows), [float(v) for v in base + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.3])], g % 3))
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, [2 * v for v in rows[0][1]], rows[0][2]), (n + 2, rows[0][1], None), (n + 3, None, 0), (n + 4, [0.0] * 16, 0)]
    rows += [(n + 5, [float("nan")] + [1.0] * 15, 0), (n + 6, [float("inf")] * 16, 0), (n + 7, [None] + [1.0] * 15, 0), (n + 8, [1.0, 0.0], 0), (n + 9, [1.0, 0.01], 0), (None, rows[0][1], 0), (n + 10, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    links, parent = {}, {i: i for i, _, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [(i, np.array(e), k) for i, e, k in rows if i is not None and k is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    for k, (i, a, la) in enumerate(good):
        for j, b, lb in good[k + 1 :]:
            if la == lb and len(a) == len(b) and a @ b >= 0.98 * np.sqrt((a @ a) * (b @ b)):
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    got = embedding_dedup.near_vectors(df).collect()
    assert len(got) == len(rows) and sum(links.values()) > 100
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == {i: (links.get(i, 0), top(i)) for i, _, _ in rows if i is not None}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_recall_and_range_of_doubles(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 32))
    noise = rng.normal(size=(300, 32))
    noise -= (noise * base).sum(1, keepdims=True) * base / (base**2).sum(1, keepdims=True)
    near = base / np.linalg.norm(base, axis=1, keepdims=True) * 0.9801 + noise / np.linalg.norm(noise, axis=1, keepdims=True) * np.sqrt(1 - 0.9801**2)
    for factor in (1.0, 1e200, 1e-170):  # squares beyond the range of doubles
        rows = [(i, (v * factor).tolist(), i % 300) for i, v in enumerate(np.concatenate([base, near]))]
        rows += [(1000, (base[0] * factor).tolist(), 1000), (1001, (-base[0] * factor).tolist(), 1000), (1001, (-base[0] * factor).tolist(), 1000)]
        got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        # Pairs just at the threshold are the hardest: all of them are found.
        assert all(got[i].n_links == 1 and got[i + 300].component_id == i for i in range(300))
        assert got[1000].n_links == 0 and got[1001].component_id == 1001
