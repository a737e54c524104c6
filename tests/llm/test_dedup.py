import hashlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import LONG, documents, sample

from runstore.llm import exact_dedup, near_dedup, warc


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [exact_dedup.MAX_BITS, 1 << 18])
def test_exact_report(spark, bits):
    for docs in (documents(spark), sample(spark), documents(spark, [])):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = [tuple(r) for r in exact_dedup.report(docs, max_bits=bits).collect()]
        assert sorted(got, key=str) == brute_exact(rows)


def test_exact_dedup_keeps_columns_and_one_row_a_text(spark):
    docs = documents(spark)
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = {(keep, t) for t, keep in {t or "": k for t, k in [(r.text, b[1]) for r in docs.collect() for b in brute_exact([(x.doc_id, x.text) for x in docs.collect()]) if b[4] == hashlib.sha256((r.text or "").encode()).hexdigest()]}.items()}
    assert {(i, t or "") for i, t in kept} == want and len(kept) == len(want)


def test_filter_never_misses_a_repeat_and_passes_most_others(spark):
    hashes = spark.range(20_000).selectExpr("xxhash64(if(id < 1000, id div 2, id)) AS h")
    bitmap = exact_dedup.repeated_filter(hashes, exact_dedup.filter_bits(20_000))
    marked = hashes.withColumn("m", exact_dedup.maybe_repeated(spark, bitmap)("h"))
    assert marked.where("m").count() >= 1000 and marked.where("m").count() < 1500
    assert marked.join(spark.range(1000).selectExpr("xxhash64(id div 2) AS h").distinct(), "h").where("NOT m").count() == 0


def brute_near(rows, size, percent):
    """Components by comparing every pair of word-shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (same_id or 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("size", [2, 5])
def test_near_report(spark, size):
    for docs in (documents(spark), sample(spark), documents(spark, [])):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = near_dedup.report(docs, size=size, percent=80).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, size, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_families_around_the_threshold(spark):
    """A star (copies like the original but not like each other), a chain, and pairs just over and under 0.8."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows, n = [(0, " ".join(base))], 1
    for _ in range(60):
        w = list(base)
        for at in rng.choice(200, 8, replace=False):
            w[at] = f"x{n}y{at}"
        rows.append((n, " ".join(w)))
        n += 1
    chain = [f"c{i}" for i in range(100)]
    for step in range(15):
        rows.append((n, " ".join(chain[step * 5 :] + [f"d{k}" for k in range(step * 5)])))
        n += 1
    for tail in (24, 25, 26):
        rows += [(n, " ".join(f"{tail}e{i}" for i in range(101))), (n + 1, " ".join(f"{tail}e{i}" for i in range(101 + tail)))]
        n += 2
    got = near_dedup.report(documents(spark, rows), size=2, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, 2, 80)


def test_crowded_regions_are_divided(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", 8)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(60)] + [(60 + i, "alone " + " ".join(f"z{i}v{k}" for k in range(30))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in near_dedup.report(documents(spark, rows), size=2).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[i] == i for i in range(60, 80))


def test_near_dedup_keeps_columns(spark):
    docs = documents(spark, [(1, LONG), (2, LONG + " x"), (3, "other text")])
    out = near_dedup.dedup(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_near_dedup_of_rows_without_doc_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    texts = [(5, one), (None, one + " x"), (None, one), (None, two), (None, two + " x"), (None, two + " x y"), (None, "alone"), (None, ""), (None, None)]
    out = near_dedup.dedup(documents(spark, texts)).collect()
    assert [r.doc_id for r in out if (r.text or "").startswith("a0")] == [5]
    assert sum((r.text or "").startswith("b0") for r in out) == 1 and sorted(r.text or "" for r in out if len(r.text or "") < 9) == ["", "", "alone"]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 260)}


PAGES = [(1, "u1", "same"), (2, "u2", "same"), (2, "u2", "same"), (3, "u\r\n3", None), (4, None, ""), (5, "u5", "é" * 100_000), (None, "n", "same"), (None, "n", "only")]


def test_archive_round_trip(spark, tmp_path):
    import base64
    import gzip

    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, payload int")
    path = str(tmp_path / "archive")
    warc.write(pages, path)
    got = sorted((tuple(r) for r in warc.read(spark, path).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        ids = [p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None]
        win = max(ids, default=None)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == win else "revisit", None if i == win else win))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == len({p[2] or "" for p in PAGES})
    built = warc.rebuilt(spark, path).collect()
    assert sorted(bytes(r.payload) for r in built) == sorted((p[2] or "").encode() for p in PAGES)
    for r in built:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        body = bytes(r.payload) if r.record_type == "response" else b""
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest == body + b"\r\n\r\n" and f"Content-Length: {len(body)}".encode() in head
    files = warc.export(spark, path, str(tmp_path / "out")).collect()
    assert sum(f.n for f in files) == len(PAGES)
    assert sum(gzip.open(f.file).read().count(b"WARC/1.1\r\n") for f in files if f.n) == len(PAGES)
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    warc.write(pages, str(tmp_path / "large"), min_bytes=5)
    assert sorted(r.record_type for r in warc.read(spark, str(tmp_path / "large")).collect()) == ["response"] * 8


def test_urls_forge_no_header(spark, tmp_path):
    urls = [f"u{end}{field}" for end in ("\u0085", "\u2028", "\u2029", "\r\n", "\n", "\x0b", " ") for field in ("WARC-Refers-To: <urn:page:77>", "WARC-Payload-Digest: sha1:AAAA", "WARC-Type: revisit", "Content-Length: 9")]
    pages = spark.createDataFrame([(i, u, f"text {i % 20}\r\n\r\nWARC-Type: revisit\r\n") for i, u in enumerate(urls)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "archive"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "archive")).collect()}
    assert got == {i: ("revisit", i + 20) if i + 20 < len(urls) else ("response", None) for i in range(len(urls))}


def test_a_corrupt_payload_fails(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('other' AS binary) AS payload").collect()
    spark.createDataFrame(bad, "digest binary, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="corrupt payload"):
        warc.read(spark, path).collect()


def test_a_crowded_region_in_several_components_is_searched_whole(spark, monkeypatch):
    """Families that share most of their words but aren't alike enough: deep prefixes part them, blocks must not."""
    monkeypatch.setattr(near_dedup, "CROWD", 6)
    shared_words = [f"s{i}" for i in range(150)]
    rows = []
    for f in range(6):
        own = [f"f{f}w{i}" for i in range(45)]
        rows += [(f * 10 + k, " ".join(shared_words + own[:k] + [f"x{f}y{k}"] + own[k + 1 :])) for k in range(7)]
    got = near_dedup.report(documents(spark, rows), size=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, 2, 80)


def exact_components(rows, size, percent):
    """Components by an exact similarity join: sets of a pair at the threshold share one of their rarest shingles."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.setdefault(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None, []).append(d)
    sets.pop(None, None)
    count = defaultdict(int)
    for s in sets:
        for g in s:
            count[g] += 1
    low = {s: min(ids) for s, ids in sets.items()}
    parent = {d: d for d in low.values()}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index, links = defaultdict(list), 0
    for s in sorted(sets, key=len):
        met = set()
        for g in sorted(s, key=lambda g: (count[g], g))[: len(s) - -(-percent * len(s) // 100) + 1]:
            met.update(o for o in index[g] if 100 * len(o) >= percent * len(s))
            index[g].append(s)
        for o in met:
            both = len(s & o)
            if 100 * both >= percent * (len(s) + len(o) - both):
                links += 1
                a, b = find(low[s]), find(low[o])
                parent[max(a, b)] = min(a, b)
    return {d: find(low[s]) for s, ids in sets.items() for d in ids}, links


def test_components_of_a_whole_table_equal_an_exact_join(spark, monkeypatch):
    """Every link at sf0.1, in ranges so small that regions go on from one to the next."""
    size = 2
    monkeypatch.setattr(near_dedup, "RANGE_ROWS", 9000)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want, links = exact_components([tuple(r) for r in docs.collect()], size, 80)
    got = {r.doc_id: r.component_id for r in near_dedup.report(docs, size=size, percent=80).collect()}
    assert links > 400 and {d: got[d] for d in want} == want and all(got[d] == d for d in got if d not in want)


def test_depth_adapts_in_a_crowd_of_default_size(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "RANGE_ROWS", 20_000)
    base = [f"w{i}" for i in range(200)]
    n = near_dedup.CROWD + 400
    docs = documents(spark, [(i, " ".join(base[: i % 200] + [f"x{i}"] + base[i % 200 + 1 :])) for i in range(n)] + [(n, " ".join(base[:120]))])
    classes = near_dedup._described(docs.select("doc_id", "text"), 2).selectExpr("doc_id AS node", "signature", "sketch")
    kinds = {r.kind: r.n for r in near_dedup.forest(classes, 80).groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert kinds[near_dedup.CROWDED] > near_dedup.CROWD and kinds[near_dedup.OPEN]
    got = {r.doc_id: r.component_id for r in near_dedup.report(docs, size=2).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[n] == n


def test_parity_rejects_no_link():
    """Sets of random sizes and overlaps, many at the threshold exactly."""
    rng = np.random.default_rng(11)
    rejected = unlike = 0
    for _ in range(3000):
        size, percent = int(rng.integers(1, 3000)), int(rng.choice([50, 80, 95]))
        pool = rng.integers(0, 1 << 64, 2 * size + 2, dtype=np.uint64)
        cut = int(rng.integers(0, size + 1)) if rng.random() < 0.5 else size * (100 - percent) // 100
        one, two = np.unique(pool[:size]), np.unique(pool[cut : size + int(rng.integers(0, cut + 1))])
        common = len(np.intersect1d(one, two))
        linked = 100 * common >= percent * (len(one) + len(two) - common)
        a, b = (np.frombuffer(near_dedup.parity(s), np.uint64)[None, :] for s in (one, two))
        may = near_dedup.possible(np.array([len(one)]), np.array([len(two)]), a, b, percent)[0]
        assert may or not linked
        unlike, rejected = unlike + (not linked), rejected + (not may)
    assert rejected > 0.7 * unlike > 500


def test_sets_are_shuffled_for_likely_links_alone(spark, monkeypatch):
    """A region of pairs just under the threshold, whose sketches pass, must not carry its sets pair by pair."""
    seen, confirmed = [], near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, sets, percent: seen.append((pairs.count(), sets.count())) or confirmed(pairs, sets, percent))
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(f"x{i}y{k}" if (k + i) % 25 == 0 else w for k, w in enumerate(base))) for i in range(60)]
    rows += [(100, "tail " + rows[7][1])]
    got = near_dedup.report(documents(spark, rows), size=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, 2, 80)
    assert sum(n for n, _ in seen) < 200 and sum(n for _, n in seen) < 200


def test_near_dedup_keeps_one_of_rows_that_share_a_doc_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    rows = [(5, one), (5, one), (5, one + " x"), (9, one + " y"), (7, two), (7, "alone"), (None, two), (8, "free")]
    out = near_dedup.dedup(documents(spark, rows).withColumnRenamed("key", "_key").withColumnRenamed("h", "a.b"))
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert [g for g in got if g[1].startswith("a0")] == [(9, one + " y")] and sum(g[1].startswith("b0") for g in got) == 1
    assert (7, "alone") in got and (8, "free") in got and len(got) == 4 and "a.b" in out.columns
