"""Operators 1, 3, 5, 6 and 10 against brute force."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("tokenizers")
from cases import documents, stored

from tracewell.llm import pack, secret_scan, simhash, tokens, warc


@pytest.fixture
def docs(spark, tmp_path):
    return stored(documents(spark), tmp_path)


def bag(rows):
    return collections.Counter(map(repr, rows))


def test_token_counts_match_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    want = bag((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert bag((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs).collect()) == want
    assert tokens.token_counts(docs.where("doc_id < 0")).count() == 0


def test_scan_stitches_blocks_and_reports_an_unclosed_tail(spark, tmp_path):
    import gzip

    stream = np.array([5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 13, 0, 14], "<u2")
    (tmp_path / "any.gz").write_bytes(gzip.compress(stream.tobytes()))
    for block in (1, 2, 3, 5, 100):
        got = sorted((r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in tokens.scan_flat(spark, str(tmp_path), block=block).collect())
        assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 7, True), (3, 12, 1, False)]


def test_chunks_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    own = tokens.Chunks(tokens.tokenizer_path())
    texts = ["a\x1cb c\x85d e f", "it's we're <|endoftext|>x", "é ́a ΑΣ ΣΑΣ. İ", "10,000 naïve x\tl'eau", "\x00\x01 \x7f", ""]
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path(name)
    t, own = Tokenizer.from_file(path), tokens.Chunks(path)
    texts = ["Two  words, it's\n\nNEW lines 12345", " lead", "", "<|endoftext|>"]
    assert own.by_word == name.startswith("word")
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_files_close_at_their_bounds_and_mismatches_fail(spark, docs, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_ROWS", 3)
    want = bag((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs).collect())
    monkeypatch.setattr(tokens, "FILE_TOKENS", 50)
    monkeypatch.setattr(tokens, "BLOCK", 7)
    assert bag((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs).collect()) == want
    whole = tokens.scan_flat
    monkeypatch.setattr(tokens, "scan_flat", lambda *a: whole(*a).where("ordinal <> 1"))
    with pytest.raises(Exception, match="do not match"):
        tokens.token_counts(docs).collect()


def naive_secrets(text):
    text = text or ""
    found = []
    for k, (pattern, flags, group, least) in enumerate([(secret_scan.RULES[0][1], re.A | re.I, 2, 6), (r"AKIA[A-Z0-9]+", re.A, 0, 20), (r"[0-9a-f]+", re.A, 0, 24)]):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    kinds = [sum(f[1] == k for f in found) for k in range(3)]
    return *kinds, hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)).encode()).hexdigest()


def test_secrets_match_plain_regexes(spark, docs):
    want = bag((r["doc_id"], *naive_secrets(r["text"])) for r in docs.collect())
    got = secret_scan.scan(docs).collect()
    assert bag((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    assert any("github:" in r["spans"] for r in got) and any("jwt:" in r["spans"] for r in got)
    assert secret_scan.scan(docs.where("doc_id < 0")).count() == 0


def test_trigram_queries_never_miss_a_match():
    own = secret_scan.Scanner()
    hits = ["PassWD = abcdef", "api_key:'abcdef'", "APIKEY=abcdef", "AKIA" + "A" * 16, "-----BEGIN EC PRIVATE KEY-----", "gho_" + "a" * 36, "xoxb-" + "1" * 12, "AIza" + "b" * 35, "ftp://u:pass@h"]
    for text, spans in zip(hits, own.scan([f"é {h} é" for h in hits]), strict=True):
        assert spans, text
    assert secret_scan.trigram_query("[0-9a-f]+") is True
    assert secret_scan.trigram_query("abc(d|e)?x+yz") != True  # noqa: E712


def test_warc_round_trip(spark, tmp_path):
    htmls = ["<p>a</p>", "", None, "é" * 30_000, "<p>a</p>", "x" * 100_000, "<p>a</p>\r\n\r\n", "", "é" * 30_000, "\0\0 odd \r\n"]
    rows = [(i if i != 6 else None, None if i == 3 else f"http://h/\r\n{i} é", h, "z") for i, h in enumerate(htmls)] + [(1, "http://again", "", "z")]
    pages = stored(spark.createDataFrame(rows, "page_id long, url string, html string, record_type string"), tmp_path, "pages")
    groups = collections.defaultdict(list)
    for p, _, h, _ in rows:
        groups[h or ""].append(p)
    want = []
    for p, _, h, _ in rows:
        raw, ids = (h or "").encode(), [x for x in groups[h or ""] if x is not None]
        again = bool(ids) and p != max(ids)
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", max(ids) if again else None, "ok"))
    for segment in (64, 5_000, 1 << 20):
        assert bag(map(tuple, warc.round_trip(pages, segment).collect())) == bag(want)
    assert warc.round_trip(pages.where("page_id < 0")).count() == 0


def test_warc_tells_of_missing_segments(spark, tmp_path):
    rec = list(warc._records(7, "http://a", b"x" * 5000, None, False, "n", 1000))
    warc_dir = tmp_path / "w"
    warc_dir.mkdir()
    import gzip

    (warc_dir / "a.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in rec[:2] + rec[3:])))
    assert [r["status"] for r in warc.read_archives(spark, str(warc_dir)).collect()] == ["segment missing"]


def test_warc_gives_payloads_and_checks_revisits(spark, tmp_path):
    htmls = ["<p>a</p>", "", None, "é" * 30_000] + ["<p>a</p>"] * 500
    pages = stored(spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string"), tmp_path, "pages")
    warc.write_archives(pages, path := str(tmp_path / "w"))
    got = warc.read_archives(spark, path).collect()
    assert bag((r["page_id"], r["url"], bytes(r["payload"]), r["status"]) for r in got) == bag((i, f"http://h/{i}", (h or "").encode(), "ok") for i, h in enumerate(htmls))


def test_warc_from_elsewhere(spark, tmp_path):
    def record(kind, block, **more):
        return warc._head(WARC_Type=kind, **more, Content_Length=len(block)) + block + b"\r\n\r\n"

    head, sha1 = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", f"sha1:{warc._digest(b'plain')}"
    lost = list(warc._records(7, "http://lost", b"x" * 5000, None, False, "n", 1000))[1:]
    (warc_dir := tmp_path / "w").mkdir()
    content = [
        record("warcinfo", b"software: other", WARC_Record_ID="<urn:uuid:0>"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:uuid:1>", WARC_Target_URI="http://a"),
        record("response", head + b"plain", WARC_Record_ID="<urn:uuid:2>", WARC_Target_URI="http://a", WARC_Payload_Digest=sha1, Content_Type="application/http; msgtype=response"),
        record("response", head + b"other", WARC_Record_ID="<urn:uuid:3>", WARC_Target_URI="http://b", WARC_Payload_Digest=sha1, Content_Type="application/http; msgtype=response"),
        record("revisit", head, WARC_Record_ID="<urn:uuid:4>", WARC_Target_URI="http://c", WARC_Payload_Digest=sha1),
        record("revisit", head, WARC_Record_ID="<urn:uuid:5>", WARC_Target_URI="http://d", WARC_Refers_To="<urn:uuid:2>"),
        record("revisit", head, WARC_Record_ID="<urn:uuid:6>", WARC_Target_URI="http://e", WARC_Payload_Digest="sha1:" + "A" * 32),
        *(x + b"\r\n\r\n" for x in lost),
    ]
    (warc_dir / "a.warc").write_bytes(b"".join(content))
    got = {(r["url"], r["page_id"], r["payload"] and bytes(r["payload"]), r["status"]) for r in warc.read_archives(spark, str(warc_dir)).collect()}
    assert got == {("http://a", None, b"plain", "ok"), ("http://b", None, b"other", "digest differs"), ("http://c", None, b"plain", "ok"), ("http://d", None, b"plain", "ok"), ("http://e", None, None, "response missing"), (None, 7, None, "segment missing")}


def test_packing_is_gapless_and_keeps_every_token(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    want = []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want += [(r["doc_id"], k, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for k, i in enumerate(range(0, len(ids), 2048))]
    got = pack.pack(docs).collect()
    assert bag((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == bag(want)
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r["length"] for r in got) // 2048) + 2
    assert pack.pack(docs.where("doc_id < 0")).count() == 0


def test_sequences_hold_the_tokens(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    own = {(r["doc_id"], tuple(t.encode(r["text"] or "", add_special_tokens=False).ids + [0])) for r in docs.collect()}
    made = pack.write_sequences(docs, str(tmp_path / "sequences"))
    rows = made.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) > 0
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["n_tokens"] == sum(p["length"] for p in r["parts"]) <= 2048
        for p in r["parts"]:
            part = tuple(ids[p["offset"] : p["offset"] + p["length"]])
            assert any(d == p["doc_id"] and x[p["start"] : p["start"] + p["length"]] == part for d, x in own)
    placed = "doc_id", "piece", "start", "length", "sequence_id", "offset"
    found, packed = pack.segments(made).collect(), pack.pack(docs).collect()
    assert bag((*(r[c] for c in placed), bytes(r["ids"])) for r in found) == bag((*(r[c] for c in placed), bytes(r["ids"])) for r in packed)
    assert pack.sequences(pack.pack(docs.where("doc_id < 0"))).count() == 0


def optimum(sizes, capacity):
    """Least number of bins by trying all (small instances)."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= sizes[i]}.values():
            bins[k] -= sizes[i]
            go(i + 1, bins)
            bins[k] += sizes[i]
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_dominance_reduction_never_costs_a_sequence():
    rng = np.random.default_rng(5)
    reduced = 0
    for _ in range(150):
        capacity = int(rng.integers(8, 30))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 10))).tolist()
        fixed, left = pack.reduce_instance(dict(collections.Counter(sizes)), capacity)
        packed = [s for many, held in fixed for s, each in held for _ in range(many * each)] + [s for s, c in left.items() for _ in range(c)]
        assert sorted(packed) == sorted(sizes)
        assert all(sum(s * e for s, e in held) <= capacity for _, held in fixed)
        rest = [s for s, c in left.items() for _ in range(c)]
        assert sum(m for m, _ in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(sizes, capacity), (sizes, capacity)
        reduced += bool(fixed)
    assert reduced > 100


def test_fingerprint_by_the_letter():
    for text in [None, "", "one", "One TWO", "a b c d a b c É é\x85x", "x " * 3000]:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_best_fit(sizes, capacity):
    """Best-fit decreasing piece by piece: each into the open sequence with the least room that it fits."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= s]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(s)
        else:
            bins.append([s])
    return bins


def test_best_fit_on_counts_equals_best_fit_piece_by_piece():
    rng = np.random.default_rng(8)
    for n, high in ((1, 5), (40, 30), (200, 64), (300, 20), (150, 100)):
        sizes = rng.integers(1, high + 1, n).tolist()
        made = pack.best_fit(dict(collections.Counter(sizes)), 100)
        assert sum(many for many, _ in made) == len(plain_best_fit(sizes, 100))
        assert all(sum(s * k for s, k in held) <= 100 for _, held in made)
        assert collections.Counter(s for many, held in made for s, k in held for _ in range(many * k)) == collections.Counter(sizes)


def test_rows_stay_told_apart_when_a_later_scan_is_split_otherwise(spark, tmp_path, monkeypatch):
    texts = [" ".join(hashlib.sha1(f"{i}/{k}".encode()).hexdigest() for k in range(3 + i)) for i in range(16)]
    rows = [(i, texts[i % 12]) for i in range(16)]
    for i in range(0, 16, 2):
        spark.createDataFrame(rows[i : i + 2], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs, key = spark.read.parquet(str(tmp_path / "docs")), "spark.sql.files.maxPartitionBytes"
    near, scan = simhash.near_duplicates, tokens.scan_flat

    def again(f):
        def run(*args, **more):
            out = f(*args, **more)
            out.count()
            spark.conf.set(key, "1")
            return out

        return run

    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **b: again(lambda: near(*a, **b).checkpoint())())
    monkeypatch.setattr(tokens, "scan_flat", again(scan))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        spark.conf.set(key, "1m")
        assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == list(range(12))
        spark.conf.set(key, "1m")
        got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs).collect()}
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    own = tokens.Chunks(tokens.tokenizer_path(), 1, True)
    assert got == {i: len(own.encode([t])[0]) // 2 for i, t in rows}


def brute_components(points, radius=2):
    up = {p: p for p in points}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if bin(a ^ b).count("1") <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {p: root(p) for p in points}


def clustered(n, seed, spread):
    """Points around few centres, so that many agree on whole bands."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    out = set()
    for _ in range(n):
        x = int(centres[rng.integers(0, 4)])
        for b in rng.integers(0, 64, int(rng.integers(0, spread))):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


def joined(points, edges):
    up = {p: p for p in points}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {p: root(p) for p in points}


@pytest.mark.parametrize(("radius", "spread"), [(2, 6), (2, 14), (2, 3), (1, 6), (3, 8)])
def test_tree_search_finds_all_links(radius, spread, monkeypatch):
    monkeypatch.setattr(simhash, "BRUTE", 8)
    points = clustered(500, radius, spread)
    arr, edges, asked = np.array(points, np.uint64), [], 0
    for mask, near in zip(simhash.band_masks(), (radius - 1, 0), strict=True):
        tree = simhash.Tree(arr[::3], mask, near, 3, 40)
        which, shard, home = tree.shards(arr)
        assert sorted(which[home].tolist()) == list(range(len(arr)))  # each is stored once
        assert tree.leaves > 1 and (near > 0 or home.all())
        asked += (~home).sum()
        for s in np.unique(shard):
            own = shard == s
            a, b = simhash.shard_links(arr[which[own]], home[own], mask, near, radius)
            edges += zip(a.tolist(), b.tolist(), strict=True)
    assert (asked > 0) == (radius > 1)  # the boundaries overlap
    assert joined(points, edges) == brute_components(points, radius)


@pytest.mark.parametrize(("levels", "spread"), [(6, 8), (6, 3), (0, 5)])
def test_links_of_many_shards_match_all_pairs(spark, levels, spread, monkeypatch):
    for name, value in {"LEAF": 60, "SHARD": 50, "SUBSAMPLE": 40, "REDEALT": 3, "BRUTE": 8, "LEVELS": levels}.items():
        monkeypatch.setattr(simhash, name, value)  # several shards, some parted anew or, with no levels, in a grid
    points = clustered(300, levels + spread, spread)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df).collect()]
    assert joined(points, edges) == brute_components(points)


def test_near_duplicates_match_brute_force(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    monkeypatch.setattr(simhash, "SHARD", 6)  # so that shards are dealt anew
    rows = docs.select("doc_id", "text").collect()
    fps = [simhash.fingerprint(r["text"]) for r in rows]
    comp = brute_components(sorted(set(fps)))
    least = collections.defaultdict(list)
    for r, fp in zip(rows, fps, strict=True):
        least[comp[fp]].append(r["doc_id"])
    want = bag((r["doc_id"], fp, min((d for d in least[comp[fp]] if d is not None), default=None)) for r, fp in zip(rows, fps, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert bag((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(least) == sum(r["keep"] for r in got)
    assert simhash.near_duplicates(docs.where("doc_id < 0")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(149, 90)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 90 for i in range(100, 150)}
