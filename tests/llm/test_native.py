"""Operators 2, 4, 7, 8 and 9 against brute force or held-out rows."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from cases import TEXTS, documents, prose, stored

from tracewell.llm import decontaminate, pii, quality_model, quality_rules, url_filter
from tracewell.llm.common import table

SMALL = "/root/testdata/sf0.001"


def bag(rows):
    return collections.Counter(map(repr, rows))


@pytest.fixture
def docs(spark, tmp_path):
    return stored(documents(spark), tmp_path)


# ---- 2 -----------------------------------------------------------------------------------------------------------------


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def naive_hits(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        size = min(len(v), 10)
        for win in {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else ():
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) == win:
                    hit |= set(range(i, i + size))
                    names |= {str(name)} if name is not None else set()
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, prose(14, 1)), (2, prose(30, 1)), (10, "Éou, STONE"), (3, None), (None, "x1 co-op 42 x1"), (4, " .. "), (5, prose(14, 1)), (6, "ß Über")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination_matches_brute_force(spark, docs, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_TEXTS", 0)
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, window string")
    want = bag((r["doc_id"], *naive_hits(r["text"], ITEMS)) for r in docs.collect())
    got = decontaminate.contamination(docs, bench).collect()
    assert bag((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in got) == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert bag(map(tuple, clean.collect())) == bag(tuple(r) for r in docs.collect() if not naive_hits(r["text"], ITEMS)[-1])
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert cut.count() == docs.count()
    assert bag(r["text"] for r in clean.collect()) - bag(r["text"] for r in cut.collect()) == collections.Counter()


def test_no_benchmark_hits_nothing(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontaminate.contamination(docs, bench).collect()} == {False}
    assert decontaminate.contamination(docs.where("doc_id < 0"), bench).count() == 0


# ---- 4 -----------------------------------------------------------------------------------------------------------------


def luhn(digits):
    return sum(v - 9 * (v > 9) for v in ((int(d) * (1 + i % 2)) for i, d in enumerate(reversed(digits)))) % 10 == 0


NAIVE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t, d: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t, d: all(int(x[-400:]) <= 255 and not x[:-400].strip("0") for x in t.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda t, d: 14 <= len(d) <= 19 and luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t, d: 10 <= len(d) <= 15),
]


def naive_pii(text):
    found = []
    for k, (pattern, good) in enumerate(NAIVE):
        if k == 0 and "@" not in (text or ""):
            continue
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if good(m.group(), re.sub("[^0-9]", "", m.group()))]
    return sorted(found)


def test_base_spans_match_plain_regexes(spark, docs):
    names = [*pii.BASE, "like"]
    want = []
    for r in docs.collect():
        found = naive_pii(r["text"])
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)
        want.append((r["doc_id"], *[sum(f[1] == k for f in found) for k in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    got = pii.personal_data(docs).collect()
    assert bag((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == bag(want)
    assert sum(w[1] + w[2] + w[3] + w[4] for w in want) > 10
    assert pii.personal_data(docs.where("doc_id < 0")).count() == 0


def test_patterns_in_random_noise(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("a.@+-_% 1234(0)é😀") for _ in range(rng.randrange(5, 120))) for _ in range(400)]
    texts += [" ".join(rng.choice(["4111-1111 1111 1111", "+12 345 6789 01", "1.2.3.4", "01.002.3.255.6", "a@b.c-d.e"]) for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = list(pii.BASE)
    got = {r["doc_id"]: r["base_sha256"] for r in pii.personal_data(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in naive_pii(t)).encode()).hexdigest(), t


def test_boosted_trees_learn():
    counts = {(f, d, 0, 0, c, 0, 0, 0, 0): (50, 50 if d > 8 and c else 0) for f in range(3) for d in range(12) for c in (0, 1)}
    start, trees = pii.fit_trees(counts)
    for x, (n, p) in counts.items():
        assert (start + sum(pii._value(t, x) for t in trees) > 0) == (p == n)
    assert set(pii.calibrate(start, trees, counts)) == {0, 1, 2}
    alike = {(0, 1, 0, 0, 0, 0, 0, 0, 0): (30, 30), (0, 2, 0, 0, 0, 0, 0, 0, 0): (30, 0)}
    assert pii.calibrate(0.0, [], alike) == {}  # equal scores fall together


def personal_texts(n, seed):
    """Texts with one proven span each, as (text before, span, text after)."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(digits + str(c) for c in range(10) if luhn(digits + str(c)))
        phone = f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        mail = f"{rng.choice(['ann', 'b.o', 'cy'])}{i}@mail{i % 7}.example.{rng.choice(['com', 'org'])}"
        ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        word = rng.choice(["call", "contact", "see", "the", "or"])
        out.append((f"{prose(8, seed + i)} {word} ", [mail, ip, card, phone][i % 4], " " + prose(6, i)))
    return out


def disguised(i, span):
    """The span of ``personal_texts`` hidden in one of the ways people write it, and its family."""
    if "@" in span:
        ways = [span.replace("@", " [at] ").replace(".com", " [dot] com"), span.replace("@", "(at)"), span.replace("@", "\u00f1@"), span.replace("@", " AT ").replace(".", " DOT ") if span.count(".") == 2 else span.replace("@", "[at]")]
        return ways[i // 4 % 4], "address" if i // 4 % 4 == 2 else "spelled"
    if "555-" in span:
        return [span[1:], span.split(" ", 1)[1]][i // 4 % 2], "number"
    if "." in span:
        return span.replace(".", ["[.]", "(dot)"][i // 4 % 2]), "defanged"
    return [".", "  "][i // 4 % 2].join(span[k : k + 4] for k in range(0, 16, 4)), "number"


NEUTRAL = ["on 2023-11-25 we", "from 1987-2004 on", "isbn 978-3-4085-2217-1 is", "at 1693526400 the", "04.11.1987 was", "4417 1234 5678 9112 is", "look at this dot", "see (12) or [3.4]", "x@y", "2.10.4 build 20230115"]


def test_hidden_spans_of_each_family_are_added_and_neutral_ones_are_not(spark):
    rows = [(i, a + s + b) for i, (a, s, b) in enumerate(personal_texts(400, 1))]
    planted = [(a, disguised(i, s), b) for i, (a, s, b) in enumerate(personal_texts(160, 2))]
    assert not any(naive_pii(t) for _, (t, _), _ in planted)
    rows += [(1000 + i, a + t + b) for i, (a, (t, _), b) in enumerate(planted)]
    rows += [(2000 + i, f"{prose(5, i)} {NEUTRAL[i % len(NEUTRAL)]} {prose(5, i + 1)}") for i in range(100)] + [(3000, None)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = collections.defaultdict(list)
    for i, (a, (t, family), _) in enumerate(planted):
        caught[family].append(any(s.startswith("like:") and int(s.split(":")[1]) <= len(a) + 1 and int(s.split(":")[2]) >= len(a + t) - 1 for s in got[1000 + i].split(",")))
    assert set(caught) == set(pii.WIDE)
    assert all(np.mean(v) >= 0.9 for v in caught.values()), {k: np.mean(v) for k, v in caught.items()}
    assert sum("like" in got[2000 + i] for i in range(100)) <= 2 and got[3000] == ""
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "[LIKE]" in out[1000] and out[2000] == rows[560][1] and out[3000] is None


def test_examples_and_scores_match_plain_python(spark):
    rows = [(i, a + s + b) for i, (a, s, b) in enumerate(personal_texts(200, 3))]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    start, trees, _ = pii.fit(found)
    F = url_filter.F
    e = pii.examples(found).select("s.*", F.array(*pii.features(F.col("s"))).alias("x"), pii._cell(pii.features(F.col("s"))).alias("cell"), pii.score_of(F.col("s"), start, trees).alias("score")).collect()
    sizes = list(pii.FEATURES.values())
    for r in e:
        digits = re.sub("[^0-9]", "", r["text"])
        assert all(0 <= v < n for v, n in zip(r["x"], sizes, strict=True)) and pii.uncell(r["cell"]) == tuple(r["x"])
        assert r["x"][1] == max(min(len(digits), 17) - 6, 0) and r["x"][7] == (14 <= len(digits) <= 19 and luhn(digits))
        assert r["score"] == pytest.approx(start + sum(pii._value(t, r["x"]) for t in trees), abs=1e-9)
        if r["y"]:
            assert not naive_pii(r["text"]), r["text"]
            assert re.fullmatch(list(pii.WIDE.values())[r["kind"] - 4].replace(r"(?:(?<![0-9])|\G)", "").replace(r"\G", "(?!)"), r["text"])
    ways = collections.Counter((r["kind"], r["y"]) for r in e)
    assert all(ways[4 + i, 1] >= 40 for i in range(4)) and ways[5, 0] >= 40


def test_redaction_leaves_clean_rows_alone(spark, docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    clean = [r for r in docs.collect() if not naive_pii(r["text"])]
    assert bag(map(tuple, clean)) - bag(map(tuple, out.collect())) == collections.Counter()
    assert not any("@mail7" in (r["text"] or "") for r in out.collect())


# ---- 7 -----------------------------------------------------------------------------------------------------------------


def naive_rule(url):
    m = re.search(r"://", url or "")
    if not m:
        return "", "", None
    rest = url[m.end() :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [t for _, t in url_filter.RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_rules_and_models(spark, tmp_path):
    urls = [None, "", "no scheme", "http://Example.COM", "http://EXAMPLE.com/EN/x", "https://a.example.com/en/?q#f", "http://www.example.com/en/1", "x://net/es/", "http://é.net/fr/é?x", "http://h?x://y/z", "a\nb://c.com/d\ne?f"]
    urls += [f"http://h{i}.com/good/{i}" for i in range(60)] + [f"http://s{i}.net/es/casino-{i}" for i in range(60)] + ["http://x.org/good/7", "http://y.org/es/casino-9"] + ["http://x.org/good/7"] * 20
    pages = stored(spark.createDataFrame([(i if i != 5 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string"), tmp_path, "pages")
    got = url_filter.judge(pages).collect()
    action = {t: a for a, t in url_filter.RULES}
    want = bag((i if i != 5 else None, *naive_rule(u)) for i, u in enumerate(urls))
    assert bag((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    assert all(r["verdict"] == action[r["rule"]] for r in got if r["rule"])
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[len(urls) - 22] == "allow" and by[len(urls) - 21] == "block" and by[len(urls) - 1] == "allow"
    assert {r["verdict"] for r in url_filter.judge(pages.where("url like 'http://h%'")).collect()} == {"allow"}
    assert url_filter.judge(pages.where("page_id < 0")).count() == 0


def test_models_do_not_read_what_rules_read(spark):
    seen = {
        "http://m.Shop.example.net/es/7?q#f": "http://.m.shop./7?q#f", "https://www.example.com/en/": "https://./", "https://org/fr/es/x": "https://.org./x",
        "http://a.company.net": "http://.a.company.", "h://netto.com/essen/en/": "h://.netto./essen/en/", "no scheme/en/": "no scheme/en/", None: None,
    }
    df = spark.createDataFrame([(u,) for u in seen], "u string")
    F = url_filter.F
    assert {r["u"]: r["seen"] for r in df.select("u", url_filter.masked(F.col("u"), url_filter.host_of(F.col("u"))).alias("seen")).collect()} == seen
    plain = df.select(url_filter.masked(F.col("u"), url_filter.host_of(F.col("u")), [("allow", "/")]).alias("seen")).where("seen like '%essen%'")
    assert plain.collect()[0]["seen"] == "h://.netto.com./essen/en/"


def test_model_ratios_match_the_formula(spark):
    urls = [("ab://c.com/x1", "allow", False), ("zz://q.net/es/", "block", True), ("ab://d.net/es/", "block", False)]
    df = spark.createDataFrame(urls, "u string, _action string, _held boolean").withColumn("_symbols", url_filter.symbols(url_filter.F.col("u")))
    table_ = {r["_gram"]: (r["full"], r["fit"]) for r in url_filter.model(df).collect()}
    size, order = len(url_filter.ALPHABET) + 3, url_filter.ORDER
    for j, rows in enumerate([urls, [u for u in urls if not u[2]]]):
        grams = {a: collections.Counter() for a in ("allow", "block")}
        for u, a, _ in rows:
            s = "^" * order + re.sub("[0-9]", "0", u) + "$"
            grams[a].update(s[i : i + order + 1] for i in range(len(s) - order))

        def p(label, gram):
            odds = 1 / size
            for k in range(order + 1):
                n = sum(c for g, c in grams[label].items() if g.endswith(gram[order - k :]))
                total = sum(c for g, c in grams[label].items() if g[: order][order - k :] == gram[:order][order - k :])
                odds = (n + url_filter.WEIGHT * odds) / (total + url_filter.WEIGHT)
            return odds

        for gram, v in table_.items():
            assert v[j] == pytest.approx(np.log(p("allow", gram) / p("block", gram)), abs=1e-9)


# ---- 8 -----------------------------------------------------------------------------------------------------------------


def synthetic(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.choice([0, 1, 2, 2, 2])
        text = [rng.choice(["the", "ration", "stone", "water", "light", "often"]) for _ in range(rng.randrange(20, 80))]
        text = [w + "$$$" for w in text] if kind == 0 else text + ["nasty", "vile"] if kind == 1 else text
        out.append((i, " ".join(text), kind))
    return out


def plain_features(text):
    """{place: value} by dictionaries, place by place."""
    import zlib

    raw = (text or "").encode()
    counts, mask = collections.Counter(), (1 << quality_model.BITS) - 1
    words = ["".join(c for c in w if c not in ".,;:!?\"'()[]|") for w in (text or "").split(" ")]
    words = collections.Counter("".join(c.lower() if c.isascii() else c for c in w) for w in words if w)
    shape = lambda w: re.sub(rb"(.)\1+", rb"\1", bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in w))
    shapes = collections.Counter(map(shape, raw.split()))
    counts = [(zlib.crc32(w.encode()) & mask, n) for w, n in words.items()] + [(zlib.crc32(w, 1) & mask, n) for w, n in shapes.items()]
    counts.append((zlib.crc32(b"%d" % (10 * len(words) // max(1, sum(words.values()))), 2) & mask, 10))
    total, out = max(1.0, sum(np.log1p(n) for _, n in counts)) ** 0.25, collections.Counter()
    for place, n in counts:
        out[place] += np.log1p(n) / total
    return out


def test_scores_match_plain_python(spark):
    data = synthetic(300, 5) + [(900, "", 0), (901, "ONE one, (two) \u00e9t\u00e9 42 aaa!!", 2), (902, prose(400, 1), 2)]
    model = quality_model.fit([quality_model.features(t) for _, t, _ in data], np.array([k for *_, k in data]))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_model._scored(docs, model, "text").collect()}
    for i, t, _ in data:
        score = sum(v * model.weights[p] for p, v in plain_features(t).items())
        tails = [1 / (1 + np.exp(-(score - x))) for x in model.theta]
        assert got[i]["expected_grade"] == pytest.approx(sum(tails), abs=1e-4), t
        assert got[i]["tail_probability"] == pytest.approx(tails[-1], abs=1e-4)
        assert got[i]["accepted"] == (got[i]["tail_probability"] >= model.keep)


def test_slopes_are_those_of_the_plain_likelihood():
    def likelihood(score, theta, y):
        tails = [1.0, *[1 / (1 + np.exp(-(score - t))) for t in theta], 0.0]
        return quality_model.WEIGHTS[y] * np.log(tails[y] - tails[y + 1])

    rng, theta, eps = np.random.default_rng(4), np.array([-0.7, 1.1]), 1e-6
    score, y = rng.normal(0, 2, 60), rng.integers(0, 3, 60)
    pull, to = quality_model.slopes(score, theta, y)
    for s, g, p, t in zip(score, y, pull, to, strict=True):
        assert p == pytest.approx((likelihood(s + eps, theta, g) - likelihood(s - eps, theta, g)) / (2 * eps), abs=1e-5)
        for k in range(2):
            step = eps * np.eye(2)[k]
            assert t[k] == pytest.approx((likelihood(s, theta + step, g) - likelihood(s, theta - step, g)) / (2 * eps), abs=1e-5)


def test_ordinal_model_on_held_out_rows(spark):
    data = synthetic(500, 1)
    model = quality_model.fit([quality_model.features(t) for _, t, _ in data], np.array([k for *_, k in data]))
    assert (np.diff(model.theta) >= 0).all()
    tails = model.tails([t for _, t, _ in synthetic(200, 2)])
    assert (tails[:, 0] >= tails[:, 1]).all()
    want = np.array([k for *_, k in synthetic(200, 2)])
    assert np.mean((tails >= 0.5).sum(axis=1) == want) > 0.95


def test_classify_and_select(spark, tmp_path):
    data = synthetic(400, 3)
    docs = stored(spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in data] + [(None, None, "x", 0.0), (5, "", None, 0.0), (7, "b" * 40_000, "x", 2.0)], "doc_id long, text string, accepted string, value double"), tmp_path)
    labels = spark.createDataFrame([(i, int(k > 0), int(k == 1)) for i, _, k in data] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_model.classify(docs, labels).where("doc_id > 10").collect()}
    assert np.mean([got[i]["accepted"] == (k == 2) for i, _, k in data if i > 10]) > 0.95
    kept = quality_model.select(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert quality_model.classify(docs, labels.where("doc_id < 0")).where("not accepted").count() == 0
    assert quality_model.classify(docs.where("doc_id < 0"), labels).count() == 0


# ---- 9 -----------------------------------------------------------------------------------------------------------------


def naive_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def test_counts_match_brute_force(spark, docs, tmp_path):
    extra = [(i, " ".join(random.Random(i).choice("abcd") for _ in range(60)), "", "en") for i in range(50)]
    df = docs.select("doc_id", "text", "_row").withColumn("lang", url_filter.F.lit(None).cast("string")).unionByName(spark.createDataFrame(extra, "doc_id long, text string, _row string, lang string"))
    got = quality_rules.assess(df).collect()
    assert bag((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == bag((r["doc_id"], *naive_rules(r["text"])) for r in df.collect())
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules.assess(df.where("doc_id < 0")).count() == 0


def test_distance_is_jensen_shannon(spark):
    rng = np.random.default_rng(1)
    for p, q in [(rng.integers(0, 9, 7), rng.integers(0, 9, 7)) for _ in range(5)] + [(np.zeros(7), np.ones(7)), (np.ones(7), np.ones(7))]:
        df = spark.createDataFrame([(p.astype(float).tolist(), q.astype(float).tolist())], "p array<double>, q array<double>")
        got = df.select(quality_rules.js_distance(quality_rules.F.col("p"), quality_rules.F.col("q")).alias("d")).first()["d"]
        a, b = p / max(p.sum(), 1), q / max(q.sum(), 1)
        kl = lambda x, m: sum(u * np.log2(u / v) for u, v in zip(x, m, strict=True) if u > 0)
        assert got == pytest.approx(np.sqrt(max(0, (kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2)), abs=1e-7)


def test_each_language_is_judged_by_its_own_text(spark):
    def text(i, letters):
        r = random.Random(f"{i}{letters}")
        return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(150))

    cyrillic, latin = "абвгдежзийклмнопрст", "abcdefghilmnopqrstu"
    rows = [(i, text(i, cyrillic), "ru") for i in range(60)] + [(100 + i, text(i, latin), "pt") for i in range(25)]
    rows += [(200, text(200, latin), "ru"), (201, text(201, cyrillic), "pt"), (202, text(202, cyrillic), None), (203, text(203, latin), "xx")]
    got = {r["doc_id"]: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in [*range(60), *range(100, 125), 202, 203]) and not got[200]["kept"] and not got[201]["kept"]
    assert got[0]["word_distance"] is None and got[202]["char_distance"] is None and got[203]["char_distance"] is None


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_odd_texts_diverge(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, " ".join(f"{w.upper()}$$$###" for w in prose(200, i).split()), "en") for i in range(3)], docs.schema)
    got = {r["doc_id"]: r for r in quality_rules.assess(docs.unionByName(odd)).collect()}
    assert not got[-1]["kept"]


def test_texts_cover_the_edge_cases():
    assert None in TEXTS and "" in TEXTS and max(len(t or "") for t in TEXTS) > 40_000
