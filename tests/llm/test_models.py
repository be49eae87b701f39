import math
import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemill.llm import html_text, language, neighbours, pii, quality, registry, wordhash

SF = "/root/testdata/sf0.01"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    def find(p):
        return [(m.start(), m.end(), m[0]) for m in re.finditer(p, t, re.A)]

    email = find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = [x for x in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in x[2].split("."))]
    card = [x for x in find(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(d := re.sub("[^0-9]", "", x[2])) <= 19 and luhn(d)]
    phone = [x for x in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(re.sub("[^0-9]", "", x[2])) <= 15]
    found = [email, ip, card, phone]
    base = ",".join(f"{k}:{a}:{b}" for k, own in zip(("email", "ip", "card", "phone"), found) for a, b, _ in own)
    return [len(x) for x in found], sha256(base.encode()).hexdigest()


def test_pii_by_brute_force(spark):
    texts = [
        None, "", "é🙂 a.b@c.de and a@b.c_d@e.f.g x@y", "@@a@b..c a+b%c@d-e.f-g.h.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0000255.0.0.01 1.2.3",
        "4111 1111 1111 1111, 4111-1111-1111-1112; 378282246310005 4111111111111111222", "+1 (212) 555-7890 ++4930 1234567) +1 2 +123456789012345678",
        "call +44 20 7946 0958. card: 5500-0000-0000-0004 ip 10.0.0.1", "IBAN DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE89370400440532013001", 'token = "abcdefgh12345678" api_key: "x"',
        "9" * 3000, "a" * 20_000, "a." * 9000 + "@", "1 " * 9000, "a@b" + ".c" * 9000, "1.1." * 5000, "+" + "1(" * 5000, "x@" * 3000,
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[2], "y")], "doc_id long, text string, email string")
    got = pii.find_pii(docs.drop("email")).select("doc_id", *[pii.F.size(k.name).alias(k.name) for k in pii.KINDS], pii.F.sha2(pii.joined(*[k.name for k in pii.BASE]), 256).alias("d"), "iban", "secret").collect()
    assert len(got) == len(texts) + 1
    for r in got[: len(texts)]:
        n, digest = brute_pii(texts[r.doc_id] or "")
        assert [r.email, r.ip, r.card, r.phone] == n and r.d == digest, r.doc_id
    assert pii.find_pii(docs.limit(0)).count() == 0
    assert pii.find_pii(docs).count() == len(texts) + 1


def test_pii_context(spark):
    """Words before or after raise a score, and decide on what its pattern alone doesn't show."""
    texts = ["my card is 4111111111111111", "number 4111111111111111", "IBAN DE89 3704 0044 0532 0130 00.", "4111111111111111 (visa)", "ssn 123-45-6789", "code 123-45-6789", "123-45-6789 is the SOCIAL number", "ssn 000-45-6789, ssn 666-45-6789 ssn 912-45-6789", "1-123-45-6789 tax", "discard 4111111111111111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert [r.card[0].score for i, r in sorted(got.items()) if r.card] == [80, 60, 80, 60]
    assert [(s.start, s.end) for s in got[2].iban] == [(5, 32)] and [(s.start, s.end) for s in got[0].card] == [(11, 27)]
    assert [[(s.start, s.end, s.score) for s in got[i].ssn] for i in range(4, 9)] == [[(4, 15, 60)], [], [(0, 11, 60)], [], []]


def test_pii_of_very_many_matches(spark):
    docs = spark.createDataFrame([(1, "a@b.c " * 200_000)], "doc_id long, text string")
    assert pii.find_pii(docs).select(pii.F.size("email"), pii.F.element_at("email", -1).start).first() == (200_000, 6 * 199_999)


PAGES = {
    "": "",
    "<p>A &amp; B<p>C&nbsp; &lt;d&gt;": "A & B\n\nC <d>",
    "<html><body><nav><a href=x>m</a></nav><article><h1>T</h1><p><b>x.<br><p>yy  \n z</article><footer>f</footer>": "T\n\nx.\n\nyy z",
    "<body><div class='sidebar'>side bar text</div><div id=main><p>one two three four</p><p>five six seven</p></div><div class=comments><p>nice post, thank you</p></div></body>": "one two three four\n\nfive six seven",
    "<main><ul><li>a b<li>c</ul><form><p>sign up</p></form><table><tr><td>x<td>y</table></main>": "a b\n\nc\n\nx\n\ny",
    "<article><p>t1</p><script>if (a<b) document.write('<p>no</p>')</script><p>t2</p></article>": "t1\n\nt2",
    "<article>a<!-- <p>b</p> -->c <i>d</i>e": "ac de",
    "just text & more": "just text & more",
    "<nav>menu</nav>": "",
    "<p>a < b and <unclosed": "a < b and",
    "<div class='cookie-notice'>ok?</div><p>body text here</p>": "body text here",
    "<article><p>first words</p><div class='related-work'><p>Others did it too.</p></div><p>last</p></article>": "first words\n\nOthers did it too.\n\nlast",
    "<article><p>The <span class='search term'>token</span> stays</p></article>": "The token stays",
    "<article><p>He said:</p><blockquote class='reply'>No reply is lost.</blockquote></article>": "He said:\n\nNo reply is lost.",
    "<article><p>Press <button>Start</button> to begin</p></article>": "Press Start to begin",
    "<article><p>one two three</p><div class='ad'>Buy this now</div><p>four five</p><section id='comments'><p>so nice</p><p>thank you all</p></section></article>": "one two three\n\nfour five",
    "<article><p>one two three</p><ul class='share'><li><a href=1>like it</a></li><li><a href=2>send it on</a></li></ul></article>": "one two three",
    "<article><p>the text itself</p></article><article class='comment'><p>a reader's own long comment on it, longer than the text</p></article>": "the text itself",
    "<body><div class='comments'>" + "<p>many words of many readers</p>" * 30 + "</div><div><p>one short text</p><p>of two blocks</p></div></body>": "one short text\n\nof two blocks",
    "<body><header>site</header><main><header><h1>T</h1></header><p>text</p><aside>more</aside></main><footer>f</footer></body>": "T\n\ntext",
    "<p>a</p><select><option>x</select><p hidden>b</p><p style='display: none'>c</p>": "a",
}


@pytest.mark.parametrize("html", list(PAGES))
def test_html(html):
    assert html_text.extract(html) == PAGES[html]


PROSE = "The water rose slowly over the fields that lay below the mill. Nobody in the village had expected this. It took them a whole night to move the sheep. "


@pytest.mark.parametrize("name", ["div class='cookie-recipe'", "section id='ad-hoc-networks'", "section class='comment'", "div class='related-work'", "div class='menu'", "div class='sidebar-story'", "div"])
@pytest.mark.parametrize("times", [2, 5])
@pytest.mark.parametrize("frame", ["article", "div", "main"])
def test_names_alone_drop_no_text(name, times, frame):
    """Blocks of prose stay whatever they are called, within an article and without one; adverts and comments beside them go."""
    text, tag = (PROSE * times).strip(), name.split()[0]
    page = f"<body><nav><a href=a>home</a></nav><div class='ad'>Buy it now, cheap.</div><{frame}><p>{text}</p><{name}><p>{text}</p></{tag}><p>{text}</p></{frame}><div class='comments'><div class='comment'><p>Nice.</p></div><div class='comment'><p>{PROSE}</p></div></div></body>"
    assert html_text.extract(page) == "\n\n".join([text] * 3)


@pytest.mark.parametrize("page", ["<b>", "<div>", "<div class='menu x'>", "<p><i>", "<li><div>", "<div><i></div></i>", "<td>x<section class='ad'>", "<header>", "<div role=search>"])
def test_depth_costs_no_more_than_length(page):
    """200,000 nested tags without an end, text at the bottom."""
    import time

    began = time.perf_counter()
    html_text.extract(page * (200_000 // page.count("<")) + "some words")
    assert time.perf_counter() - began < 12  # seconds grow with the length alone; in proportion a page of 80 KB takes one


def random_page(rng, depth=0):
    tags = ["div", "p", "section", "ul", "li", "a", "b", "span", "table", "blockquote"]
    out = []
    for _ in range(rng.randint(1, 4)):
        if depth > 3 or rng.random() < 0.4:
            out.append(" ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(0, 12))))
        else:
            tag = rng.choice(tags)
            name = rng.choice(["", "", "", " class='sidebar'", " class='related'", " id=ad"])
            out.append(f"<{tag}{name}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_density_by_brute_force():
    """Every node's figures by walking all that lies below it, and the subtree by trying all nodes."""
    rng = random.Random(5)

    def below(node):
        return [x for k in node.kids if not isinstance(k, str) and not k.gone for x in (k, *below(k))]

    def texts(node):
        return [(k, node) for k in node.kids if isinstance(k, str)] + [p for k in node.kids if not isinstance(k, str) and not k.gone for p in texts(k)]

    def linked(node):
        return node is not None and (node.tag == "a" or linked(node.up))

    def figures(node):
        c = sum(len("".join(t.split())) for t, _ in texts(node))
        return c, len(below(node)), sum(len("".join(t.split())) for t, at in texts(node) if linked(at)), sum(x.tag == "a" for x in below(node))

    def density(node, body):
        (c, t, lc, lt), (bc, _, blc, _) = figures(node), figures(body)
        t, base = max(t, 1), math.log(c / max(c - lc, 1) * lc + blc / max(bc, 1) * c + math.e)
        return node.weight * c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1)) / (math.log(base) if base > 1 + 1e-9 else 1)

    def up(node):
        return [] if node is None else [node, *up(node.up)]

    for _ in range(60):
        root = html_text.parse(f"<body>{random_page(rng)}</body>")
        html_text.prune(root)
        body, nodes = html_text.weigh(root)
        for node in nodes:
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == figures(node)
            assert node.density == pytest.approx(density(node, body))
            assert node.total == pytest.approx(sum(density(k, body) for k in node.kids if not isinstance(k, str) and not k.gone))
            names = {x.named and ("ad" in x.names and html_text._LOST or html_text._NOISY) for x in up(node)} - {False}
            assert node.weight == min(names, default=1)
        inside = [body, *below(body)]
        densest = max(inside, key=lambda x: x.total)
        least = min(x.density for x in up(densest) if body in up(x))
        assert html_text.threshold(body, inside) == least
        far = {id(x) for x in inside if x.named and x.density * (1 - x.link_chars / max(x.chars, 1)) <= html_text._FAR * least}
        best = html_text.main_node(root)
        assert {id(x) for x in inside if x.gone} == far
        left = [x for x in [body, *below(body)] if not any(y.gone for y in up(x))]
        least = html_text.threshold(body, left)
        most = max((x.total for x in left if x.density >= least), default=0)
        assert body in up(best) and (best is body or best.total >= most or any(x.total == pytest.approx(most) and best in up(x) for x in left))


def test_html_frame(spark):
    long = "<article>" + "<div>" * 3000 + "deep" + "<p>w x" * 20_000
    rows = [(1, None, "x"), (2, long, "x"), (2, long, "x"), (3, "<p> </p>", None)]
    got = html_text.with_main_text(spark.createDataFrame(rows, "page_id long, html string, text2 string")).collect()
    assert [len(r.text) for r in got] == [0, 6 - 2 + 20_000 * 5, 6 - 2 + 20_000 * 5, 0]
    assert html_text.with_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_quality(spark, duck):
    got = registry.QUERIES["op8_quality"](spark, SF).toPandas().merge(duck.execute("SELECT doc_id, quality FROM labels").df())
    own = got[got.held_out]
    assert len(own) > 50 and (own.predicted == own.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_by_brute_force():
    """Features word by word and character by character, and scores pair by pair."""
    texts = ["", "A b, c!", "one two  two\n\nthree | 7%", "ßé x" * 30, "word " * 400]
    chars = np.array([0, 7, 5, -3, 2000])
    bags, stats = (np.concatenate(x) for x in zip(*quality.features([t.encode() for t in texts], chars.astype(float))))
    rng = np.random.default_rng(2)
    width = quality.BUCKETS + quality.STATS
    m = quality.Machine(0.1, rng.normal(0, 0.1, width).astype(np.float32), rng.normal(0, 0.1, (width, 3)).astype(np.float32), stats.mean(0), stats.std(0) + 1e-6)
    scores = m.score(bags, stats)
    for t, n, bag, own, score in zip(texts, chars, bags, stats, scores):
        raw = t.encode()
        words = raw.split()
        hashes = [int(h) % quality.BUCKETS for w in words for h in wordhash.words([w])[3]]
        want = np.zeros(quality.BUCKETS)
        for h in hashes:
            want[h] += 1
        want = np.log1p(want)
        assert bag == pytest.approx(want / max(np.sqrt((want**2).sum()), 1e-9), abs=1e-5)
        size, count = len(raw), len(words)
        shares = [sum(b in c for b in raw + b" ") / (size + 1) for c in quality._CLASSES.values()]
        shares[2] -= (0 if b" " in quality._CLASSES["space"] else 1) / (size + 1)
        assert own[6:] == pytest.approx(shares) and own[:5] == pytest.approx([np.log1p(size), np.log1p(count), sum(map(len, words)) / max(count, 1), len(set(hashes)) / max(count, 1), np.log1p(size / (1 + raw.count(b"\n")))], rel=1e-4)
        assert own[5] == pytest.approx(np.log1p(max(n, 0)))
        x = np.concatenate((bag, np.clip((own - m.mean) / m.std, -4, 4) * 0.25))
        on = np.flatnonzero(x)
        logit = m.bias + x @ m.linear + sum(float(m.factors[i] @ m.factors[j]) * x[i] * x[j] for a, i in enumerate(on) for j in on[:a])
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-3)


def test_quality_of_repeated_ids(spark):
    """The rows learnt from are the same whatever their order, and no more than twice the bound."""
    rows = [(i % 3, f"{'good text here' if i % 3 else 'bad !!! 111'} {i}", i, "x", "y") for i in range(60)]
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    docs = [spark.createDataFrame(x, "doc_id long, text string, n_chars long, o string, y string") for x in (rows, rows[::-1])]
    a, b = (quality.train(d, labels, most=3) for d in docs)
    assert (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "a"), (2, "", 0, "a"), (None, "x y", 3, "b"), (3, "long " * 50_000, 5, "c"), (3, "long " * 50_000, 5, "c")], "doc_id long, text string, n_chars long, score string")
    labels = "doc_id long, quality int, toxic int"
    m = quality.train(docs, spark.createDataFrame([], labels))
    got = quality.with_score(docs, m, "q").collect()
    assert [r.q for r in got] == [0.5] * 5 and got[0].score == "a"
    m = quality.train(docs, spark.createDataFrame([(2, 1, None), (2, 0, None), (3, None, 1), (None, 1, 1)], labels))
    assert m.bias == 0
    assert quality.with_score(docs.limit(0), m).count() == 0
    x = np.random.default_rng(0).random((4, 30)).astype(np.float32)
    f = quality.Machine(0.3, np.arange(30, dtype=np.float32), np.random.default_rng(1).normal(size=(30, 3)).astype(np.float32), np.zeros(1), np.ones(1))
    pairs = [0.3 + r @ f.linear + sum(f.factors[i] @ f.factors[j] * r[i] * r[j] for i in range(30) for j in range(i)) for r in x]
    assert f.logits(x) == pytest.approx(np.array(pairs), rel=1e-4)


def test_language_gradient():
    rng = np.random.default_rng(0)
    net = language.Network.new(["a", "b", "c"], 3, rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    mask = (np.arange(6)[:, None] < np.array([6, 3, 5, 1])).astype(float)
    _, g = net.step(x, y, mask)
    for k in net.w:
        for at in [tuple(rng.integers(0, s) for s in net.w[k].shape) if k[0] != "x" else (int(x[0, 0]), 1) for _ in range(3)]:
            old = net.w[k][at]
            loss = []
            for d in (1e-3, -1e-3):
                net.w[k][at] = old + d
                loss.append(net.step(x, y, mask)[0])
            net.w[k][at] = old
            assert g[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, abs=2e-3), k


def test_language(spark, duck):
    got = registry.QUERIES["op10_language"](spark, SF).toPandas().merge(duck.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").df())
    own = got[got.held_out]
    assert len(own) > 100 and (own.lang_pred == own.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, f"{'der die das und' if i % 2 else 'the and of it is'} {i}", "de" if i % 2 else "en", "l") for i in range(40)]
    odd = [(100, None, None, "l"), (101, "", "en", "l"), (102, "123 !?", None, "l"), (103, "the and of it is " * 8000, None, "l"), (104, "the", None, "l"), (104, "the", None, "l"), (None, "und der", "de", "l")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, said string")
    net = language.train(docs)
    assert net.langs == ["de", "en"]
    got = [r for r in language.with_language(docs, net).collect()]
    said = {(r.doc_id, r.text): r.lang_pred for r in got}
    assert said[100, None] == said[101, ""] == said[102, "123 !?"] == "und" and said[103, odd[3][1]] == "en" and said[104, "the"] == "en"
    assert language.with_language(docs.limit(0), net).count() == 0
    none = language.train(docs.where("lang = 'xx'"))
    assert none is None and {r.lang_pred for r in language.with_language(docs, none).collect()} == {"und"}
    text = "der die das und the é" * 40
    p = net.pooled([text.encode()[:70], b"", text.encode()])
    q = net.pooled([text.encode()])
    assert p[2] == pytest.approx(q[0]) and p[1].sum() == 0 and p[0].sum() == pytest.approx(1)


def test_language_by_brute_force():
    """Byte by byte through both cells, window by window, against all windows at once."""
    rng = np.random.default_rng(4)
    net = language.Network.new(["a", "b", "c"], 5, rng)
    w = {k: v.astype(float) for k, v in net.w.items()}
    sigma = lambda v: 1 / (1 + np.exp(-v))

    def states(data, d):
        h, out = np.zeros(5), []
        for byte in data:
            x, u = w["x" + d][byte], h @ w["u" + d]
            z, r = sigma(x[:5] + u[:5]), sigma(x[5:10] + u[5:10])
            n = np.tanh(x[10:] + r * (u[10:] + w["c" + d]))
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 7, 63, 64, 65, 130, 300)]
    got = net.pooled(texts)
    for text, p in zip(texts, got):
        around, total = bytes(language.LAP) + text + bytes(2 * language.SPAN), np.zeros(3)
        for at in range(0, len(text), language.WINDOW):
            window = around[at : at + language.SPAN]
            ahead, back = states(window, "f"), states(window[::-1], "b")[::-1]
            for i in range(language.LAP, language.LAP + min(language.WINDOW, len(text) - at)):
                e = np.exp(np.concatenate((ahead[i], back[i])) @ w["out"] + w["off"])
                total += e / e.sum()
        assert p == pytest.approx(total / max(len(text), 1), abs=1e-4)


def test_language_costs_few_passes():
    """A byte costs few times what the exponentials of its gates and contents do; a kernel of slow reductions, strided slices and positions that don't count takes 7 to 9 times."""
    import time

    net = language.Network.new(["a", "b", "c", "d"], language.HIDDEN, np.random.default_rng(1))
    text = [np.random.default_rng(2).integers(1, 256, 1 << 19).astype(np.uint8).tobytes()]
    v = np.random.default_rng(3).normal(size=(2 * 3 * language.HIDDEN, 4096)).astype(np.float32)
    out, spent = np.empty_like(v), {}
    for _ in range(4):
        for name, run in (("net", lambda: net.pooled(text)), ("exp", lambda: [np.exp(v, out=out) for _ in range((1 << 19) // 4096)])):
            began = time.thread_time()
            run()
            spent[name] = min(spent.get(name, 1e9), time.thread_time() - began)
    assert spent["net"] < 5 * spent["exp"], spent


def test_language_positions():
    """Only positions that count are answered, and gates far out of range are 0 or 1 without a warning."""
    import warnings

    rng = np.random.default_rng(6)
    net = language.Network.new(["a", "b", "c"], 4, rng)
    x = rng.integers(0, 256, (language.SPAN, 9)).astype(np.uint8)
    for far in (1, 1000):
        net.w |= {k: (net.w[k] * far).astype(np.float32) for k in ("xf", "xb", "uf", "ub")}
        hs = []
        for d, order in (("f", range(language.SPAN)), ("b", range(language.SPAN - 1, -1, -1))):
            h, states = np.zeros((9, 4), np.float32), {}
            for t in order:
                states[t] = h = language._cell(x[t], h, net.w, d)[0]
            hs.append(np.stack([states[t] for t in range(language.LAP, language.LAP + language.WINDOW)]))
        e = np.exp(np.concatenate(hs, 2) @ net.w["out"] + net.w["off"])
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            got = net.positions(x)
        assert got.shape == (language.WINDOW, 3, 9) and got == pytest.approx((e / e.sum(2, keepdims=True)).transpose(0, 2, 1), abs=1e-4)


def exact_nearest(ids, x, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    d[ids == q] = np.inf
    return ids[np.lexsort((ids, d))[:k]].tolist()


def test_neighbours(spark, duck):
    got = registry.QUERIES["op4_neighbours"](spark, SF).toPandas()
    e = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").df()
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding.to_numpy()).astype(float)
    hits = sum(len(set(exact_nearest(ids, x, q, 10)) & set(got.vec_id[got.query_id == q])) for q in ids[ids % 100 == 0])
    assert hits / (10 * (ids % 100 == 0).sum()) >= 0.9
    for r in got.itertuples():
        assert r.score == pytest.approx(np.sqrt(((x[ids == r.query_id][0] - x[ids == r.vec_id][0]) ** 2).sum()), rel=1e-12)
    assert (got.sort_values(["query_id", "rank"]).groupby("query_id").score.diff().fillna(0) >= 0).all()


def test_neighbours_exactly(spark, monkeypatch):
    """All leaves opened: brute force, for each width, over one region and part or many."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4))
    x[300:600] = x[0]  # a hot vector
    y = rng.normal(size=(60, 3))
    rows = [(i, v.tolist(), "x", "y") for i, v in enumerate(x)] + [(1000 + i, v.tolist(), "x", "y") for i, v in enumerate(y)]
    rows += [(2000, None, "x", "y"), (2001, [], "x", "y"), (2100, [0.0] * 4, "x", "y"), (2200, [1.0, None, 0.0, 0.0], "x", "y"), (2300, [float("nan")] * 4, "x", "y"), (2400, [float("inf"), 0.0, 0.0, 0.0], "x", "y"), (2500, [1.0], "x", "y"), (None, [1.0] * 4, "x", "y"), rows[100], rows[100], rows[1]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, region string")
    ids, query = np.arange(900), pii.F.col("id") % 100 == 0
    for part in (neighbours.PART, 100):
        monkeypatch.setattr(neighbours, "PART", part)
        got = neighbours.search(frame, query, k=5, opened=(10**6, 1.0)).toPandas()
        for q in range(0, 900, 100):
            assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == exact_nearest(ids, x, q, 5)
        assert got[got.query_id == 1000].sort_values("rank").vec_id.tolist() == [1000 + i for i in exact_nearest(ids[:60], y, 0, 5)]
        assert set(got.query_id) == {*range(0, 1100, 100)} - {900} and len(got) == 50
    assert neighbours.search(frame.limit(0), query).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.search(few, query).collect()) == [(0, 1, 1), (0, 2, 2)]
    alone = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert neighbours.search(alone, query).count() == 0


def test_tree():
    """Leaves grow in number with the rows, hold each once, and come nearest first; few of them hold the neighbours."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 16)) + 4 * rng.normal(size=(10, 16))[rng.integers(0, 10, 4000)]
    for n in (4, 40, 400, 4000):
        tree = neighbours.Tree(x[:n], neighbours.LEAF)
        assert tree.leaves >= n / neighbours.LEAF and sorted(tree.order) == list(range(n)) and sorted(tree.visits(x[0])) == list(range(tree.leaves))
        assert len(tree.rows(x[0], 0.0, 3)) >= min(n, 3)
    hits = 0
    for i in range(0, 4000, 40):
        d = ((x - x[i]) ** 2).sum(1)
        seen = tree.rows(x[i], 0.05, 10)
        assert len(seen) < 0.15 * len(x)
        hits += len(set(np.argsort(d)[:10]) & set(seen))
    assert hits >= 0.9 * 1000
    same = neighbours.Tree(np.ones((500, 3)), 4)
    assert same.leaves == 1 and len(same.rows(np.ones(3), 0.0, 1)) == 500


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_neighbours_of_queries_that_lie_elsewhere(spark, tmp_path):
    """Most rows lie in tight clusters, the queries and a few others among no structure: visits follow the queries."""
    rng = np.random.default_rng(7)
    ids = np.arange(8000)
    x = rng.normal(size=(80, 64))[rng.integers(0, 80, len(ids))] + rng.normal(size=(len(ids), 64)) * 0.05
    lone = (ids % 100 == 0) | (ids % 20 == 1)
    x[lone] = rng.normal(size=(lone.sum(), 64))
    pd.DataFrame({"vec_id": ids, "embedding": list(x)}).to_parquet(tmp_path / "embeddings.parquet")
    got = registry.QUERIES["op4_neighbours"](spark, str(tmp_path)).toPandas().groupby("query_id").vec_id.apply(set)
    hits = [len(set(exact_nearest(ids, x, q, 10)) & got[q]) for q in ids[::100]]
    assert sum(hits) >= 0.95 * 10 * len(hits) and np.mean(np.array(hits) >= 8) >= 0.9
