"""Toxicity, url rules and HTML extraction."""

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import queries, template, toxic, url_rules


def labelled(n=400, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in ("ba", "ke", "lu", "mi") for b in ("no", "ra", "si", "tu") for c in ("da", "fel", "gor", "hin")]
    rows = []
    for i in range(n):
        w = list(rng.choice(words, int(rng.integers(5, 60))))
        label = int(i % 4 == 0)
        if label:
            w.insert(int(rng.integers(len(w))), ["moronic", "scumbag", "zwirbel" + str(rng.choice(words))][i // 4 % 3])
        rows.append((" ".join(w), label))
    return rows


def test_learns_terms_stems_and_misspellings(spark):
    learn = lambda rows: toxic.learn(spark.createDataFrame(rows, "text string, label int"))
    model = learn(labelled())
    assert {"moronic", "scumbag"} <= set(model.parts[0]) and any("zwirbel".startswith(s) for s in model.parts[1])
    assert all((model.score(t) >= 0.5) == bool(y) for t, y in labelled(200, 9))
    assert model.score("banoda kerafel moronci lusigor") >= 0.5
    assert model.score("banoda kerafel scumbbag, lusigor") >= 0.5
    plain, quoted = model.score("banoda you moronic kerafel"), model.score('banoda they reported the word "moronic" kerafel')
    assert quoted < plain
    assert model.score(None) == model.score("") < 0.5
    assert learn([]).score("anything") == 0.0


def distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_is_the_edit_distance():
    rng = np.random.default_rng(1)
    terms = ["abcab", "bcabcabca", "cab", "abcabcab"]
    lexicon = toxic.Lexicon(dict.fromkeys(terms, 5.0), {}, {})
    for _ in range(3000):
        w = "".join(rng.choice(list("abc"), int(rng.integers(1, 11))))
        near = [t for t in terms if distance(w, t) <= toxic.allowed(t)]
        got = lexicon.match(w)
        assert (got is not None) == bool(near) and (got is None or got[1] in near)
        assert (w in terms) == (got == ("word", w))


def test_terms_against_brute_force(spark):
    rows = labelled(200, 4)
    sample = spark.createDataFrame(rows, "text string, label int")
    got = {(r["stem"], r["term"]): (r["t"], r["c"]) for r in toxic.term_counts(sample).collect()}
    want = {}
    for text, label in rows:
        words = set(text.split())
        for key in {(False, w) for w in words} | {(True, w[:k]) for w in words for k in range(3, 9) if len(w) > k}:
            t, c = want.get(key, (0, 0))
            want[key] = (t + label, c + 1 - label)
    assert got == want
    nt, nc = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    odds, ratio = toxic._telling(nt, nc)
    for r in toxic.term_counts(sample).select("t", "c", odds.alias("o"), ratio.alias("r")).collect():
        # Twice the log of how much likelier the counts are with a share for each class than with one share.
        def log(k, n, p):
            return sum(m * np.log(x) for m, x in ((k, p), (n - k, 1 - p)) if m)

        p = (r["t"] + r["c"]) / (nt + nc)
        want = 2 * (log(r["t"], nt, r["t"] / nt) + log(r["c"], nc, r["c"] / nc) - log(r["t"], nt, p) - log(r["c"], nc, p)) if p < 1 else 0
        assert abs(r["r"] - want) < 1e-9 and abs(r["o"] - np.log((r["t"] + 0.5) / (nt + 1) * (nc + 1) / (r["c"] + 0.5))) < 1e-12


def test_context_and_evidence():
    lexicon = toxic.Lexicon({"moronic": 4.0}, {}, {})
    words = [f"w{i}" for i in range(40)]
    for before, after, want in (("", "", 1.0), ("you", "", 1.2), ("", "said", 0.6), ("you", "said", 0.72), ('"', '"', 0.3), ('you "', '" said', 0.18)):
        text = " ".join([*words, before, "moronic", after, *words]).split()
        assert abs(toxic.context(text, text.index("moronic")) - want) < 1e-12
        top, total, length = toxic.evidence(" ".join(text), lexicon)
        assert abs(top - 4 * want) < 1e-12 and abs(total - np.log1p(4 * want)) < 1e-12 and abs(length - np.log1p(len(text))) < 1e-12
    # Words beyond the window say nothing.
    far = ["you", *words[: toxic.WINDOW], "moronic", *words[: toxic.WINDOW], "said"]
    assert toxic.context(far, toxic.WINDOW + 1) == 1.0
    assert toxic.evidence("", lexicon) == toxic.evidence(None, lexicon) == (0.0, 0.0, 0.0)


def test_toxicity_operator(spark):
    rows = [(i, t, "x", y) for i, (t, y) in enumerate(labelled())] + [(9000, None, "x", 0), (9001, "", "x", 0), (9002, "kerafel " * 300_000, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, y int").withColumn("toxic", F.lit(1)).withColumn("label", F.lit("l")).withColumn("_text", F.lit("t"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.col("y").alias("toxic")).unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int"))
    model = toxic.fit(docs, labels, rows=60)
    got = {r["doc_id"]: r["s"] for r in toxic.score(docs, model, result="s").collect()}
    held = {r["doc_id"] for r in docs.filter(toxic.held_out(F.col("doc_id"))).select("doc_id").collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, _, y in rows if i in held]
    assert len(got) == len(rows) and np.mean(right) > 0.95
    assert toxic.score(docs.limit(0), model).count() == 0


def best_rules(rows, least, confidence, lift):
    """The best (confidence, support, verdict) of all rules that fit each row, over all subsets of its tokens."""
    total, count = len(rows), {}
    share = {v: sum(x == v for _, x in rows) / total for v in ("allow", "block")}
    for tokens, verdict in rows:
        for bits in range(1, 1 << len(tokens)):
            part = frozenset(t for k, t in enumerate(tokens) if bits >> k & 1)
            n = count.setdefault(part, {"allow": 0, "block": 0})
            n[verdict] += 1
    rules = {}
    for part, n in count.items():
        for verdict, both in n.items():
            c = both / sum(n.values())
            if both >= least and c >= confidence and c / share[verdict] >= lift:
                rules[part] = max(rules.get(part, (0, 0, "")), (c, both / total, verdict))
    return [max((r for part, r in rules.items() if part <= set(tokens)), default=None) for tokens, _ in rows]


def test_mined_rules_against_brute_force(spark):
    rng = np.random.default_rng(5)
    for seed in range(3):
        rows = []
        for _ in range(160):
            host = ["a.b.c", "d.b.c", "b.c", "e.c", "f.g.h.c", "g.h.c"][int(rng.integers(6))]
            labels = host.split(".")
            tokens = ["host:" + ".".join(labels[k:]) for k in range(len(labels))] + ["word:" + w for w in labels[:1]]
            tokens += [f"path:{p}" for p in "xyz" if rng.random() < 0.4]
            odds = 0.9 if host == "a.b.c" or "path:x" in tokens and host.endswith("h.c") else 0.1 * seed
            rows.append((tokens, "block" if rng.random() < odds else "allow"))
        df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
        rules = url_rules.mine(df, support=0.0, evidence=4, confidence=0.7, lift=1.1)
        kinds = {" ".join(t): t for t, _ in rows}
        got = {r["k"]: r for r in url_rules.judge(spark.createDataFrame(list(kinds.items()), "k string, tokens array<string>"), rules, "k").collect()}
        for (tokens, _), want in zip(rows, best_rules(rows, 4, 0.7, 1.1), strict=True):
            r = got.get(" ".join(tokens))
            assert (r is None) == (want is None)
            if r:
                assert r["mined"] == want[2] and abs(r["confidence"] - want[0]) < 1e-12


def test_deep_hosts_are_mined_at_once(spark):
    deep = ".".join(f"l{i}" for i in range(40))
    rows = [(i, f"http://{deep}/{'x' if i % 3 else 'y'}/{i}", int(i % 3 > 0)) for i in range(300)]
    # Each of 20 domains has urls of its own, so that none says the same as another.
    rows += [(1000 + i, f"http://{deep.split('.', i % 20)[-1]}/z/{i}", i // 20 % 2) for i in range(800)]
    df = spark.createDataFrame(rows, "page_id long, url string, quality int")
    by = {r["page_id"]: r for r in url_rules.filter_urls(df, (), df.select("page_id", "quality")).collect()}
    assert all(by[i]["verdict"] == ("allow" if i % 3 else "block") for i in range(300))


def test_url_rules(spark):
    rows = [(i, f"https://{'bad' if i % 3 == 0 else 'ok'}.example.net/{'x' if i % 2 else 'y'}/{i}?a=1", 0 if i % 3 == 0 else 1) for i in range(300)]
    rows += [(1000, None, None), (1001, "nothing", 1), (1002, "HTTP://A.Example.ORG/", 0), (1003, "http://example.org/en/15?x", 0), (1004, "x://b.com", 1), (1003, "http://example.org/en/15?x", 0)]
    rows += [(1005, "", 0), (1006, "http://long.com/" + "/".join(["part"] * 300_000), 1), (None, "http://n.org/", 1)]
    df = spark.createDataFrame([(*r, "k", "r", "t") for r in rows], "page_id long, url string, quality int, _kind string, rule string, tokens string")
    got = url_rules.filter_urls(df, queries.GIVEN_RULES, df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["verdict"] == ("block" if i % 3 == 0 else "allow") and by[i]["rule"] is None for i in range(300))
    assert all((by[i]["host"], by[i]["path"], by[i]["verdict"]) == ("", "", "allow") for i in (1000, 1001, 1005))
    assert (by[1002]["host"], by[1002]["rule"]) == ("a.example.org", "org/")
    assert (by[1003]["path"], by[1003]["rule"], by[1003]["verdict"]) == ("/en/15", "example.org/en/1", "block")
    assert (by[1004]["host"], by[1004]["path"]) == ("b.com", "") and len(by[1006]["path"]) == 1_500_000
    for labels in (df, None):
        assert url_rules.filter_urls(df.limit(0), queries.GIVEN_RULES, labels).count() == 0


def test_given_rules_are_carried_over(spark):
    rows = [(i, f"https://h{i % 7}.example.{('org', 'com', 'net')[i % 3]}/{('de', 'fr', 'en')[i // 3 % 3]}/{i}") for i in range(270)]
    by = {r["page_id"]: r for r in url_rules.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), (("allow", "org/"), ("block", "com/de/"), ("block", "org/de/"), ("allow", "com/fr/"))).collect()}
    # No given rule names net; the path decides there as it does among the urls that the list judges.
    assert all(by[i]["rule"] is None and by[i]["verdict"] == "block" and by[i]["confidence"] == 1 for i, u in rows if ".net/de/" in u)
    assert all(by[i]["rule"] is None and by[i]["verdict"] == "allow" and by[i]["confidence"] == 1 for i, u in rows if ".net/fr/" in u)


PAGE = "<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>menu</a></ul></nav><div class='ad'>buy</div>{main}<div id='comments'><p>first!</p></div><aside>side</aside><footer>&copy; foot</footer></body></html>"


def extracted(htmls):
    found = template.host_template([h for h in htmls if h])
    return [template.main_blocks(template.Page(h), found) for h in htmls]


def test_extraction():
    main = "<article><h1>Ti&amp;tle</h1><p title=it's><b>One\n two<br>three<p>A<i>B</i> &lt;C&gt;<!-- no --><ul><li>x<li>y</ul><form><p>mail</form></article>"
    assert extracted([PAGE.format(main=main), None, ""]) == [["Ti&tle", "One two three", "AB <C>", "x", "y"], [], []]
    assert extracted(["just <b>text</b>"]) == [["just text"]]


def test_names_that_only_resemble_surroundings_stay():
    inside = "<h2 id='side-effects'>Side effects</h2><section id='legal-history'><p>law</p></section><p class='share-price'>12</p><div id='search-results-analysis'>found</div><section id='related-work'><p>others</p></section>"
    outside = "<div class='share-buttons'>share</div><div class='cookie-notice'>cookies</div><ul class='comment-list'><li>reader</ul>"
    assert extracted([PAGE.format(main=f"<article>{inside}{outside}</article>")]) == [["Side effects", "law", "12", "found", "others"]]


BARE = "<html><body><div><a href='/1'>one</a> <a href='/2'>two</a></div><div><div>{ad}</div></div><section><h2>{head}</h2><div>{main}<div>More from us every week</div></div></section><div>{foot}</div></body></html>"


def bare_pages(n, seed=0):
    rng = np.random.default_rng(seed)
    word = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 500, k))
    pages, want = [], []
    for i in range(n):
        body = [word(int(rng.integers(3, 60))) for _ in range(int(rng.integers(1, 6)))]
        pages.append(BARE.format(ad=word(6), head=f"Head {i}", main="".join(f"<p>{b}</p>" for b in body), foot=word(4)))
        want.append([f"Head {i}", *body])
    return pages, want


def test_the_template_alone_decides():
    # Neither article elements nor names: what holds most of the text of all pages is the article, also on
    # a page where an advert is longer; the line that all pages have goes.
    pages, want = bare_pages(12)
    pages.append(BARE.format(ad="a very long advert " * 30, head="Short", main="<p>few words</p>", foot="x"))
    want.append(["Short", "few words"])
    assert extracted(pages) == want
    without = [template.main_blocks(template.Page(p), None) for p in pages]
    assert sum(a != b for a, b in zip(without, want, strict=True)) == len(pages)


def naive_classes(pages):
    """Tokens by occurrence vector, and whether a class's tokens alternate in one order on every page."""
    tokens = {t for t in pages[0].tokens if all(t in p.tokens for p in pages)}
    groups = {}
    for t in tokens:
        groups.setdefault(tuple(p.tokens.count(t) for p in pages), set()).add(t)
    found = set()
    for vector, group in groups.items():
        order = [t for t in dict.fromkeys(pages[0].tokens) if t in group]
        if all([t for t in p.tokens if t in group] == order * n for p, n in zip(pages, vector, strict=True)):
            found.add(tuple(order))
        else:
            for t in order:
                if not t.startswith(">") and f">{t}" in group and all([x for x in p.tokens if x in (t, f">{t}")] == [t, f">{t}"] * n for p, n in zip(pages, vector, strict=True)):
                    found.add((t, f">{t}"))
    return found


def test_classes_and_nesting_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        shape = [str(rng.choice(["<div>{}</div>", "<ul>{}</ul>", "<p>{}</p>", "<b>x</b><i>y</i>", "<i>y</i><b>x</b>"])) for _ in range(4)]
        pages = []
        for _ in range(4):
            parts = [s.replace("{}", "".join(rng.choice(["<li>a</li>", "<em>q</em>", "text"], int(rng.integers(0, 4))))) for s in shape]
            if rng.random() < 0.3:
                rng.shuffle(parts)
            pages.append(template.Page("<html><body>" + "".join(parts) + "</body></html>"))
        classes = template.classes_of(pages)
        assert {c.tokens for c in classes} == naive_classes(pages)
        for c in template.nested(classes):
            spans = lambda c, p: [[i for i, t in enumerate(p.tokens) if t in c.tokens][k : k + len(c.tokens)] for k in range(0, sum(t in c.tokens for t in p.tokens), len(c.tokens))]
            for p in pages:
                for own in spans(c, p):
                    if c.parent is not None:
                        inside = [s for s in spans(c.parent, p) if s[c.slot - 1] < own[0] and own[-1] < s[c.slot]]
                        assert len(inside) == 1


def test_extraction_operator(spark):
    rows = [(i, f"http://h{i % 2}.x/{i}" if i else None, PAGE.format(main=f"<article><p>page {i}</p></article>"), "c") for i in range(40)] + [(50, "http://h0.x/", None, None), (50, "http://h0.x/", None, None)]
    rows += [(51, "http://h1.x/", PAGE.format(main=f"<article><p>{'long ' * 400_000}</p></article>"), "c")] + [(60, "http://copies.x/", PAGE.format(main="<article><p>same</p></article>"), "c")] * 120
    got = template.extract(spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, text string, _host string, _key int")).collect()
    want = [(i, f"page {i}", len(f"page {i}")) for i in range(40)] + [(50, "", 0)] * 2 + [(51, "long " * 399_999 + "long", 1_999_999)] + [(60, "same", 4)] * 120
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == sorted(want)
    assert template.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hot_hosts_have_the_template_of_one_task(spark, monkeypatch):
    pages, want = bare_pages(300, 1)
    rows = [(i, f"http://one.x/{i}", h) for i, h in enumerate(pages)] + [(1000 + i, f"http://h{i}.x/", "<p>lone</p>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    cut = {r["page_id"]: r["text"] for r in template.extract(df).collect()}
    monkeypatch.setattr(template, "HOT", 1)
    whole = {r["page_id"]: r["text"] for r in template.extract(df).collect()}
    assert cut == whole == {i: "\n\n".join(w) for i, w in enumerate(want)} | {1000 + i: "lone" for i in range(30)}


def test_evidence_has_the_classes_of_all_pages():
    rng = np.random.default_rng(5)
    for _ in range(30):
        shape = [str(rng.choice(["<div id=a>{}</div>", "<ul>{}</ul>", "<p>{}</p>", "<b>x</b>", "<i>y</i>"])) for _ in range(5)]
        pages = [template.Page("<html><body>" + "".join(s.replace("{}", "".join(rng.choice(["<li>a</li>", "<em>q</em>", "text"], int(rng.integers(0, 4))))) for s in rng.permutation(shape)) + "</body></html>") for _ in range(5)]
        evidence, halves = template.Evidence(), [template.Evidence(), template.Evidence()]
        for k, page in enumerate(pages):
            evidence.add(page, 1000**k)
            halves[k % 2].add(page, 1000**k)
            evidence.add(page, 1000**k)
            evidence.add(page, 1000**k, -1)
        once = {t for t in pages[0].tokens if t[0] != ">" and all(p.tokens.count(t) == 1 for p in pages)}
        assert {t for c in evidence.classes() for t in c} == once
        nested = [c for c in template.nested(template.classes_of(pages)) if all(len(p) == len(c.tokens) for p in c.places)]
        assert {t for c in nested for t in c.tokens if t[0] != ">"} <= once
        for path, sums in evidence.sums.items():
            # The sums of parts add up, and a copy that is taken back leaves no trace.
            assert sums == [sum(x) for x in zip(*(h.sums.get(path, [0] * 9) for h in halves), strict=True)]
            if path:
                assert sums[2] == sum(p.tokens.count(path) * 1000**k for k, p in enumerate(pages))


def test_a_template_comes_from_all_pages():
    pages, want = bare_pages(30)
    later, wanted = bare_pages(170, 1)
    # What the first 30 pages have in common is text, since the later ones differ there.
    later = [h.replace("More from us every week", f"Ending {i}") for i, h in enumerate(later)]
    want = [[*w, "More from us every week"] for w in want] + [[*w, f"Ending {i}"] for i, w in enumerate(wanted)]
    assert extracted(pages + later) == want
    # Many pages without text and an odd page do not hide it either.
    pages, want = bare_pages(200)
    assert extracted([" "] * 150 + pages + ["<p>odd</p>"]) == [[]] * 150 + want + [["odd"]]


def test_copies_count_once_in_a_template(spark, monkeypatch):
    pages, want = bare_pages(120, 2)
    pages, want = [*pages, *["<html><body><p>gone</p></body></html>"] * 400, *[pages[0]] * 9, None, " "], [*want, *[["gone"]] * 400, *[want[0]] * 9, [], []]
    df = spark.createDataFrame([(i, f"http://one.x/{i}", h) for i, h in enumerate(pages)] + [(1000 + i, f"http://h{i}.x/", "<p>lone</p>") for i in range(30)], "page_id long, url string, html string")
    expected = {i: "\n\n".join(w) for i, w in enumerate(want)} | {1000 + i: "lone" for i in range(30)}
    assert {r["page_id"]: r["text"] for r in template.extract(df).collect()} == expected
    monkeypatch.setattr(template, "TWINS", 0)
    assert {r["page_id"]: r["text"] for r in template.extract(df).collect()} == expected
    monkeypatch.setattr(template, "HOT", 1)
    assert {r["page_id"]: r["text"] for r in template.extract(df).collect()} == expected
