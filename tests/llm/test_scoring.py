import collections
import math
import random
import re
import zlib

import numpy as np
import xxhash

from cellarium.llm import lm, quality, url_filter, warc


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_quality_on_held_out(spark, documents):
    random.seed(1)
    good = lambda: " ".join(random.choice(("the", "house", "walks", "slowly,", "home.")) for _ in range(80))
    bad = lambda: " ".join(random.choice(("BUY!!", "###", "NOW$$$", "win%%%")) for _ in range(80))
    texts = [good() if i % 3 else bad() for i in range(300)] + ["", None]
    labels = spark.createDataFrame([(i, int(i - 1 in range(300) and (i - 1) % 3 != 0), 0) for i in range(1, 301)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(documents(*texts), labels).collect()
    assert len(rows) == 302
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id <= 300 and r.held_out:
            assert r.predicted == int((r.doc_id - 1) % 3 != 0)


def test_quality_awkward(spark, awkward, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(awkward, labels).count() == 12
    assert {r.score for r in quality.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0


def test_isotonic_rises():
    counts, ones = np.zeros(quality.BINS), np.zeros(quality.BINS)
    for b, (n, y) in {100: (10, 1), 200: (10, 5), 300: (10, 3), 400: (10, 9)}.items():
        counts[b], ones[b] = n, y
    assert quality.isotonic(counts, ones)[1].tolist() == [0.1, 0.4, 0.9]


def test_language_model(documents, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_CHARS", 2000)
    random.seed(3)
    texts = [" ".join(random.choice(("The", "cat", "sat", "on", f"w{i % 7}")) for _ in range(random.choice((0, 3, 60)))) for i in range(200)] + [None, "unseen words only"]
    rows = {r.doc_id: r for r in lm.language_model_scores(documents(*texts)).collect()}
    tokens = {i: [*words(t), None] for i, t in enumerate(texts, 1)}
    c = collections.Counter(x for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 10 for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = rows[i]
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and r.score < 0
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 5


def brute_scores(tokens, train, counts_of):
    """Log10 probabilities by interpolation as the module says, with the weights that EM finds from the deleted documents."""
    single, pair, begins = collections.Counter(), collections.Counter(), 0
    for i in train:
        begins += 1
        for x, y in zip([BEGIN, *tokens[i][:-1]], tokens[i], strict=True):
            single[y] += 1
            pair[x, y] += 1
    total, distinct = sum(single.values()), len(single)

    def parts(w):
        for x, y in zip([BEGIN, *w[:-1]], w, strict=True):
            context = single[None] if x is BEGIN else single[x]  # a text begins as often as one ends
            kind = min(math.ceil(math.log2(context + 1)), lm.CLASSES - 1)
            yield kind, pair[x, y] / context if context else 0.0, single[y] / max(total, 1), 1 / (distinct + 1)

    return parts


BEGIN = object()


def test_scores_against_brute_force(documents, monkeypatch):
    """Scores are those of the interpolated model, whose probabilities over all next words sum to one."""
    held = lambda i: i > 160
    random.seed(8)
    texts = [" ".join(random.choice(("a", "b", "c", "d")) for _ in range(random.choice((1, 4, 9)))) for _ in range(160)]
    texts += [f"a {w}" for w in ("a", "b", "c", "d", "zz")] + ["a", "zz a", "b c d"]
    seen = {}
    real = lm.mixture
    monkeypatch.setattr(lm, "mixture", lambda cells, n: seen.setdefault("weight", real(cells, n)))
    docs = documents(*texts)
    rows = {r.doc_id: r.score for r in lm.language_model_scores(docs, held_out=docs["doc_id"] > 160).collect()}
    tokens = {i: [*words(t), None] for i, t in enumerate(texts, 1)}
    parts = brute_scores(tokens, [i for i in tokens if not held(i)], None)
    weight = seen["weight"]
    for i, w in tokens.items():
        want = sum(math.log10(weight[k][0] * p + weight[k][1] * u + weight[k][2] * v) for k, p, u, v in parts(w))
        assert abs(rows[i] - want) < 1e-9 * max(1, abs(want))
    # After "a": every known word, the end, and one unknown word that stands for all others.
    after = [list(parts(w))[1] for w in (["a", "a"], ["a", "b"], ["a", "c"], ["a", "d"], ["a", None], ["a", "unknown"])]
    assert abs(sum(weight[k][0] * p + weight[k][1] * u + weight[k][2] * v for k, p, u, v in after) - 1) < 1e-9


def test_quality_against_numpy(spark, documents):
    """Features, ridge weights, isotonic levels and scores recomputed from the same rows, by plain loops and one solve."""
    random.seed(6)
    good = lambda: " ".join(random.choice(("the", "house", "walks", "slowly,", "home.")) for _ in range(random.randrange(20, 90)))
    bad = lambda: " ".join(random.choice(("BUY!!", "###", "house", "NOW$$$", "win%%%")) for _ in range(random.randrange(20, 90)))
    texts = [good() if i % 3 else bad() for i in range(200)] + ["", None]
    label = {i: int((i - 1) % 3 != 0) for i in range(1, 181)}
    labels = spark.createDataFrame([(i, y, 0) for i, y in label.items()], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.quality_scores(documents(*texts), labels).collect()}

    def stats(text):
        data = (text or "").encode()
        kinds = collections.Counter(int(quality.CLASS[b]) for b in data)
        w = words(text)
        pairs = [tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))] if w else []
        double = sum(a == b and 3 <= quality.CLASS[b] <= 4 for a, b in zip(data, data[1:], strict=False))
        least = max(len(w), 1)
        return [*(kinds[k] / max(len(data), 1) for k in range(quality.CLASSES)), math.log1p(len(data)), math.log1p(len(w)), len(data) / least, len(set(w)) / least,
                max(collections.Counter(w).values(), default=0) / least, len(set(pairs)) / max(len(pairs), 1), double / max(len(data), 1)]

    x = np.array([stats(t) for t in texts])
    part = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(1, len(texts) + 1)])
    known = np.array([i in label for i in range(1, len(texts) + 1)])
    y = np.array([label.get(i, 0) for i in range(1, len(texts) + 1)], float)
    fit, test = known & (part > 1), known & (part == 1)
    spread = x[fit].std(axis=0)
    z = quality.Kernel(x[fit].mean(axis=0), np.where(spread > 1e-9, spread, 1.0))(x)
    weights = np.linalg.solve(z[fit].T @ z[fit] / fit.sum() + quality.RIDGE * np.eye(z.shape[1]), z[fit].T @ y[fit] / fit.sum())
    raw = z @ weights
    bins = np.floor((np.clip(raw, quality.LOWEST, quality.HIGHEST - 1e-9) - quality.LOWEST) * quality.BINS / (quality.HIGHEST - quality.LOWEST)).astype(int)
    counts, ones = (np.bincount(bins[test], weights=w, minlength=quality.BINS) for w in (np.ones(test.sum()), y[test]))
    at = np.flatnonzero(counts)
    # Isotonic levels by their max-min formula, not by pooling.
    mean = lambda i, j: ones[at[i : j + 1]].sum() / counts[at[i : j + 1]].sum()
    level = np.array([max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))])
    centres, levels = quality.isotonic(counts, ones)
    assert np.allclose(np.unique(level), np.unique(levels))
    for i, row in rows.items():
        assert abs(row.score - np.clip(np.interp(raw[i - 1], centres, levels), 0, 1)) < 1e-6, i


def test_mixture_prefers_what_predicts():
    step = lambda x: int(round(lm.STEP * math.log2(x)) + 33)
    cells = np.array([(5 << 16) | (step(1000.0) << 8) | step(2.0), (3 << 16) | step(50.0)])
    weight = lm.mixture(cells, np.array([1000.0, 1000.0]))
    assert weight[5].argmax() == 0 and weight[3].argmax() == 1 and np.allclose(weight.sum(axis=1), 1)


def test_language_model_awkward(awkward, none):
    assert lm.language_model_scores(awkward).count() == 12
    assert lm.language_model_scores(none).count() == 0


URLS = ["http://A.Example.com/en/7198#top", "https://x.com/en/1", "http://example.net/de/81", "http://b.net/de/1?q", "https://c.org/es/", "http://notcom/en/", "http://xcom/en/1", "no scheme", None, "http://free-casino.win/slots", "http://h.com", "a://b://c/d", "http://com/en/x", "http://q.example.com/EN/7", "http://long.org/" + "z" * 20000]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.pattern)) if fits else None


def bucket(name, gram):
    h = xxhash.xxh64_intdigest(gram.encode(), seed=xxhash.xxh64_intdigest(name.encode(), seed=42))
    return h % url_filter.BUCKETS if h < 1 << 63 else (h - (1 << 64)) % url_filter.BUCKETS


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    labelled = url_filter.labelled_urls(spark)
    weights = url_filter.train(labelled)
    for r in url_filter.url_filter(pages, labelled).collect():
        host, path, rule = brute(URLS[r.page_id])
        grams = [bucket(k, s[i : i + n]) for k, s in (("host", f"^{host}$"), ("path", f"^{path}$")) for n in url_filter.GRAMS for i in range(len(s) - n + 1)]
        score = 1 / (1 + math.exp(-(weights[-1] + sum(weights[g] for g in grams) / math.sqrt(max(1, len(grams))))))
        assert (r.host, r.path, r.rule) == (host, path, rule.pattern if rule else None) and abs(r.score - score) < 1e-9
        assert r.verdict == (rule.verdict if rule else "block" if score > 0.5 else "allow")
    assert url_filter.url_filter(pages.limit(0), labelled).count() == 0


def test_url_classifier_on_held_out_urls(spark):
    """Trained on three quarters of the labelled urls, the method alone judges the others."""
    part = lambda u: zlib.crc32(u.encode()) % 4 == 0
    table = list(url_filter.labelled())
    train = spark.createDataFrame([r for r in table if not part(r[0])], "url string, blocked int")
    test = [r for r in table if part(r[0])]
    rows = url_filter.url_filter(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(test)], "page_id long, url string"), train, rules=()).collect()
    hits = sum(r.verdict == "block" and test[r.page_id][1] for r in rows)
    precision, recall = hits / max(1, sum(r.verdict == "block" for r in rows)), hits / sum(y for _, y in test)
    assert len(test) > 80 and precision > 0.9 and recall > 0.9, (precision, recall)


def test_urls_awkward(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.org/x"), (2, None), (3, ""), (4, "http://" + "long." * 9000 + "org/p")], "page_id long, url string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "hit", "score", "cells")})
    labels = spark.createDataFrame([("http://a.org/x", 1), (None, 1), ("http://b.org/", None), ("http://c.org/", 0)], "url string, blocked int")
    rows = url_filter.url_filter(pages, labels).collect()
    assert len(rows) == 6 and len({(r.host, r.path, r.verdict, r.score) for r in rows if r.host == "a.org"}) == 1 and sum(r.host == "a.org" for r in rows) == 3
    assert {(r.host, r.path) for r in rows if r.page_id in (2, 3)} == {("", "")}


def test_url_classifier_learns(spark):
    table = list(url_filter.labelled())
    rows = url_filter.url_filter(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(table)], "page_id long, url string"), url_filter.labelled_urls(spark), rules=())
    assert sum(r.verdict == ("block" if table[r.page_id][1] else "allow") for r in rows.collect()) > 0.98 * len(table)
    assert set(url_filter.train(url_filter.labelled_urls(spark).limit(0))) == {0.0}


def test_warc_round_trip(spark, tmp_path):
    html = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><script>x("</p>")</script></head><body><p>Un<br>deux</p><a href="/x">trois</a><!-- no --> &lt;4&gt;</body></html>'
    pages = spark.createDataFrame([(1, "http://e.org/a", html, "c"), (2, None, None, "c"), (1, "http://e.org/a", html, "c")], "page_id long, url string, html string, headers string")
    responses = warc.responses(pages)
    rows = warc.derivatives(responses).collect()
    assert len(rows) == 6
    text = next(r for r in rows if r.page_id == 1 and r.record_type == "conversion")
    assert text.block == "A & B\nUn\ndeux\ntrois <4>"
    about = next(r for r in rows if r.page_id == 1 and r.record_type == "metadata")
    assert "language: fr\r\n" in about.block and "outlinks: 1\r\n" in about.block and "httpHeader: HTTP/1.1 200 OK\r\n" in about.block
    assert about.refers_to == text.refers_to == responses.filter("page_id = 1").first().record_id and about.record_id != text.record_id
    warc.write(warc.derivatives(responses).unionByName(warc.response_records(responses), allowMissingColumns=True), f"{tmp_path}/w")
    back = warc.read(spark, f"{tmp_path}/w").collect()
    assert len(back) == 9
    found = {(r.headers["warc-record-id"], bytes(r.block)) for r in back}
    assert all((r.record_id, r.block.encode()) in found for r in rows)
    assert all(r.headers["warc-refers-to"] == text.refers_to for r in back if r.headers["warc-type"] == "conversion" and r.headers["warc-target-uri"])
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_entities_and_headers(spark):
    """Entities are decoded once, as the standard library decodes them; a url can't start a header line."""
    import html

    from pyspark.sql import functions as F

    texts = ["caf&#233; &eacute; &#xE9;&#XE9;", "&amp;lt; &lt;b&gt; &quot;&apos;&#39;", "a & b && c &unknown; &copy &copy; &;", "&#0; &#xD800; &#9999999; &#x1F600;", "no marks", "&", "&euro;&nbsp;5", "x" * 50_000 + "&szlig;", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.decoded(F.col("t"))).collect()]
    want = [html.unescape(t.replace("&copy ", "&copy\0 ")).replace("\0", "") if "&copy " not in t else "a & b && c &unknown; &copy \u00a9 &;" for t in texts]
    assert got == want
    urls = ["http://e.org/a\r\nWARC-Type: warcinfo", "http://e.org/\x00\x7f\u00e9", "plain"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.header_safe(F.col("u"))).collect()]
    assert got == ["http://e.org/a%0D%0AWARC-Type: warcinfo", "http://e.org/%00%7F\u00e9", "plain"]
    pages = spark.createDataFrame([(1, urls[0], "<p>" + "word &amp; " * 20_000), (1, None, None)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("block", "headers", "text", "payload", "record_id", "record_type")})
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 4 and all(line.count(": ") >= 1 and not line.startswith("WARC-Type: warcinfo") for r in rows for line in r.headers.split("\r\n")[1:-1] if line)
    assert max(len(r.block) for r in rows if r.record_type == "conversion") == 7 * 20_000 - 1


def test_warc_entities_are_looked_for_once_a_part(spark):
    """Line elements by their tree are those of the list, and a name is extracted at one place of the plan."""
    import re

    names = [*warc.LINE_TAGS.split("|"), "a", "t", "head", "thead", "f", "o", "h7", "preq", "link", "dx"]
    assert [bool(re.fullmatch(warc.LINE_TREE, n)) for n in names] == [n in warc.LINE_TAGS.split("|") for n in names]
    pages = spark.createDataFrame([(1, "u", "<P>a &amp;&#x41;&#65;&nope;&amp<br/>b<hr>c")], "page_id long, url string, html string")
    found = warc.derivatives(warc.responses(pages))
    rows = {r.record_type: r for r in found.collect()}
    assert rows["conversion"].block == "a &AA&nope;&amp\nb\nc" and f"textDigest: {rows['conversion'].block_digest}" in rows["metadata"].block
    assert found._jdf.queryExecution().optimizedPlan().toString().count("#[xX]") == 1


def test_warc_texts_are_made_once_and_equal_the_sql(spark, tmp_path):
    """A page's tags are looked for at one place of the plan, and pages with signs that Java takes for word ends, white space or line ends give the SQL's rows."""
    import duckdb

    htmls = [
        "<b>a  </b>", "a \u0085", "x<pé>y<h́>z<hŕ>", "<styleª>q</style>r", "<script>s</script\x0b>t</script \n>u", "<title>v\x0b\t w</title>", "<html élang=fr>", "<html x lang='de'>",
        "<aé href=x><a éhref=y><A HREF=z>", " \t&nbsp;&#10; \r\n\f  ", " a\t\tb  c &#32;&#9; d　 e <br> f  ", "&thetasym;&thetasymx;&#1234567;&#12345678;&&amp", "<x <p> y> < z", "", "\n", None,
    ]
    spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").selectExpr("page_id", "'http://e.org/' || page_id AS url", "html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = warc.op9_warc_derivatives(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({warc.SQL})").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) == 2 * len(htmls)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("</script") == 1


def test_warc_texts_beyond_a_megabyte(spark, tmp_path):
    """Long texts take another way, which gives the SQL's rows too and has no value for each line of a page of twelve million line ends."""
    import duckdb

    long = "\n \u0085" + "<p>a \t\u00a0<br>\n\r b\f  c\u3000 \n\n" * 130_000 + "\u0085 \u2028"
    spark.createDataFrame([(1, "u", long), (2, "u", long[: len(long) // 9] + " \n ")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = warc.op9_warc_derivatives(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({warc.SQL})").fetchall()
    sizes = sorted(len(r.block.encode()) > warc.LONG for r in found.collect() if r.record_type == "conversion")
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and sizes == [False, True]
    ends = spark.range(1).selectExpr("id AS page_id", "'u' AS url", "concat('a', repeat('\\n', 12000000), 'b') AS html")
    assert [r.block for r in warc.derivatives(warc.responses(ends)).filter("record_type = 'conversion'").collect()] == ["a\nb"]
