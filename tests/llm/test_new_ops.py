"""Prefix trie, centroid clustering and URL rules against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import DATA

SF = f"{DATA}/sf0.001"


# op11


def brute_trie(rows):
    """Every node from the definition alone; rows of (conv, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn, role or "", text or ""))

    def order(t):
        turn, role, text = t
        return turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    seqs = {c: [t[1:] for t in sorted(v, key=order)] for c, v in convs.items()}
    new = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        new[c] = tuple(seqs.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in new.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(new[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got_trie(df):
    return sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(-130, 60), 100, 101, 150, 230, 250, 299, 5000]:
        for t in range(int(rng.integers(1, 9))):
            kind = int(rng.integers(0, 2)) if t else 0
            rows.append((c, t, ["user", "assistant"][t % 2], f"said {t} {kind}" + "x" * kind))
    rows += [(7, 3, "user", "again")] * 2 + [(8, None, None, "first"), (8, None, "b", None), (None, 0, "user", "lost"), (9, 1, "", ""), (9, 1, None, None)]
    rows += [(300, t, "user", f"said {t % 3} 0") for t in range(60)] + [(c, t, "user", f"said {t % 3} 0") for c in (301, 302, 365) for t in range(57 + c % 2)]
    rows += [(400, 0, "r", "w" * 200_000), (401, 0, "r", "w" * 200_000), (501, 0, "a", "b")]
    return rows


def test_op11_against_brute_force(spark, talks, monkeypatch):
    from tallframe.llm import prefix_trie as t

    df = spark.createDataFrame([(*r, 1, "x") for r in talks], "conv_id long, turn long, role string, text string, depth int, n string")
    want = brute_trie(talks)
    assert got_trie(t.trie(df)) == want
    monkeypatch.setattr(t, "LONG", 7)  # most of the long conversations become chains
    assert got_trie(t.trie(df.repartition(5))) == want


def test_op11_tables(spark):
    from tallframe.llm import queries, prefix_trie

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(queries.op11_prefix_trie(spark, SF)) == brute_trie(rows)
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# op12


def brute_clusters(rows, k=40, rounds=5, dim=64):
    """Plain Python integers throughout."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [int(x) * 256 if abs(x) >= 2.0**53 else math.floor(x * 256) for x in v]))
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    c = [x for _, x in named[:k]]

    def assign():
        out = []
        for _, x in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c)))
        return out

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [x for (_, x), (_, a) in zip(kept, at) if a == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    at, each = assign(), Counter()
    for d, j in at:
        each[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    fit = lambda v: v if v < 1 << 63 else None
    return sorted(((i, j, fit(d), fit(each[j]), fit(sum(each.values())), sha[j]) for (i, _), (d, j) in zip(kept, at)), key=str)


def got_clusters(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e7, 1e30])
def test_op12_against_brute_force(spark, scale):
    """Each scale takes another arithmetic: float64, mixed, int64, Python integers."""
    from tallframe.llm import centroids

    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(64) * scale).tolist()) for i in range(120)]
    rows += [(500, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (501, None), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [1.0] * 63 + [float("nan")]), (505, [1.0] * 63 + [float("inf")]), (506, [0.0] * 64)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(3)
    assert got_clusters(centroids.cluster(df)) == brute_clusters(rows)


def test_op12_tables(spark):
    from tallframe.llm import centroids, queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got_clusters(queries.op12_centroids(spark, SF)) == brute_clusters(rows)
    few = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    assert [r[1] for r in got_clusters(centroids.cluster(few))] == [r[1] for r in brute_clusters([(i, [float(i)] * 64) for i in range(3)])]
    assert centroids.cluster(few.limit(0)).count() == 0


def test_op12_nearest_is_exact_at_the_bounds():
    from tallframe.llm.centroids import nearest

    rng = np.random.default_rng(0)
    for top in (1 << 22, 1 << 23, 1 << 27, 1 << 28, 1 << 40):
        x, c = rng.integers(-top, top, (50, 64)), rng.integers(-top, top, (7, 64))
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, m)), j) for j, m in enumerate(c)) for r in x]
        at, d = nearest(x, c)
        assert [(int(v), int(j)) for v, j in zip(d, at)] == want


# op13


STATED = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    None, "", "no scheme", "http://", "://a.net/x", "HTTP://A.Example.NET/en/1?q#f", "http://example.net/EN/", "http://xexample.net/en/", "http://net/", "http://net", "http://net?x/",
    "http://a.example.com/de/9#", "http://example.com/den", "http://b.org/fr/", "http://b.org/fr", "http://b.org#/fr/", "http://Ünï.net/ü", "http://x.net:80/", "a://b.net://c.org/fr/",
    "http://x.org/" + "long/" * 20_000, "http://c.com/\n?z", "http://o.org/fr/\u2028x", "http://free-bets.example.org/xx/1", "ftp://casino.example.com/en/22?p=1&q",
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min((rest.find(s) for s in "/?#" if s in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    tail = rest[n:]
    return host, tail[: min((tail.find(s) for s in "?#" if s in tail), default=len(tail))]


def brute_stated(host, path):
    best = None
    for verdict, h, p in STATED:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return best or (None, None)


def brute_rules(labelled, least, confidence):
    """Every combination of items of every labelled URL, counted one by one."""
    n, both = Counter(), Counter()
    for items, verdict in labelled:
        for k in range(1, len(items) + 1):
            for some in combinations(sorted(items), k):
                n[some] += 1
                both[some, verdict] += 1
    return {(s, v): (m / n[s], m) for (s, v), m in both.items() if m >= least and m / n[s] >= confidence}


def test_op13_stated_rules_and_parts(spark):
    from tallframe.llm import url_rules as u

    df = spark.createDataFrame([(i, x, "a", 1) for i, x in enumerate([*URLS, *URLS])] + [(None, URLS[5], None, None)], "page_id long, url string, host string, items int")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in u.judge(df, [u.Stated(*s) for s in STATED], None).collect()}
    want = set()
    for i, x in [*enumerate([*URLS, *URLS]), (None, URLS[5])]:
        host, path = brute_parts(x)
        rule, verdict = brute_stated(host, path)
        want.add((i, host, path, rule, verdict or "allow"))
    assert got == want


def planted(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        bad = rng.random() < 0.3
        word = ["casino", "bets"][i % 2] if bad else ["news", "blog", "shop"][i % 3]
        host = f"{word}-{i % 7}.example.{['com', 'org'][i % 2]}"
        noise = rng.random() < 0.05
        rows.append((f"http://{host}/{['en', 'de'][i % 2]}/{i}?ref={i}", "block" if bad != noise else "allow"))
    rows += [("http://casino-1.example.com/en/1", "block")] * 40 + [(None, "block"), ("http://a.com/", None), ("nothing", "block")]
    return rows


def test_op13_mined_rules_equal_all_combinations(spark):
    from tallframe.llm import url_rules as u

    rows = planted(spark)
    df = spark.createDataFrame(rows, "url string, verdict string")
    items = {r.url: r["items"] for r in u.described(df).collect()}
    assert items["http://casino-1.example.com/en/1"] == ["host=casino-1.example.com", "host=example.com", "host=com", "word=casino", "word=1", "word=example", "word=com", "path=en", "path=#"]
    assert items["nothing"] == []
    rules = u.mine(df, least=15, mined=99)
    want = brute_rules([(items[x], v) for x, v in rows if x is not None and v is not None], 15, u.CONFIDENCE)
    got = {(tuple(r["items"]), r.verdict): (r.confidence, r.support) for r in rules.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    # the index finds the surest rule of each URL
    fired = {r.url: r.learned for r in u.fired(u.described(df), rules).collect()}
    for x, have in items.items():
        best = max(((c, m, len(s), v == "block", v) for (s, v), (c, m) in want.items() if set(s) <= set(have)), default=None)
        assert fired.get(x) == (best[-1] if best else None)
    less = u.undominated(rules)
    assert 0 < less.count() < rules.count()
    assert {r.url: r.learned for r in u.fired(u.described(df), less).collect()} == fired
    few = u.mine(df, least=15)  # twelve items a URL
    new = spark.createDataFrame([(1, "http://casino-3.example.org/de/9"), (2, "http://news-2.example.com/en/8"), (3, None)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in u.judge(new, [], few).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_op13_urls_of_many_items(spark):
    """More items than FP-growth takes, and a rule on two that alone say little:
    the same rules that matter as from all combinations."""
    from tallframe.llm import url_rules as u

    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        path = [c for c in "pqrst" if rng.random() < 0.7] + ["thirds"] * (i % 3 == 0) + ["halves"] * (i % 2 == 0)
        bad = i % 6 == 0 or rng.random() < 0.05
        rows.append((f"http://a.example.com/{'/'.join(path)}?k={i}", "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "url string, verdict string")
    items = {r.url: r["items"] for r in u.described(df).collect()}
    assert max(map(len, items.values())) > u.MINED
    got = {(tuple(r["items"]), r.verdict): (r.confidence, r.support) for r in u.undominated(u.mine(df, least=15)).collect()}
    all_ = brute_rules([(items[x], v) for x, v in rows], 15, u.CONFIDENCE)
    want = {(s, v): c for (s, v), c in all_.items() if not any((p, v) in all_ and all_[p, v][0] >= c[0] for p in combinations(s, len(s) - 1))}
    assert (("path=halves", "path=thirds"), "block") in want and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)


def test_op13_tables(spark):
    from tallframe.llm import queries, url_rules as u

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.op13_url_filter(spark, SF).collect()}
    rows = pages.select("page_id", "url").collect()
    assert len(got) == len(rows)
    for r in rows:
        host, path = brute_parts(r.url)
        rule, verdict = brute_stated(host, path)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule) and (g.verdict == verdict or rule is None and g.verdict in ("block", "allow"))
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, None, None), (4, 1, 1), (4, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    urls = spark.createDataFrame([("http://a.b/en/1",), ("http://a.b/2.html?5",), ("http://a.b/3",), ("http://a.b/9/4#top",), (None,), ("http://a.b/" + "9" * 40,)], "url string")
    assert {r.url: r.verdict for r in u.labelled_pages(urls, labels).collect()} == {"http://a.b/en/1": "block", "http://a.b/2.html?5": "allow", "http://a.b/9/4#top": "block"}
    empty = urls.limit(0).withColumn("verdict", urls["url"])
    assert u.mine(empty).count() == 0
    assert u.judge(urls.limit(0).selectExpr("1L as page_id", "url"), [], u.mine(empty)).count() == 0


# op9, nested escapes


def test_op9_nested_escapes_against_the_slow_reference():
    from test_ops import slow_spans

    from tallframe.llm import secrets

    hexes = "2525" * 9
    for t in [
        "%" + "25" * 40 + "41", "pass%2577ord%253Dhunter2hunter2", "token=abcdef%252541bc and %2541", "%25252570assword=%2541bcdefgh %41", "%" + hexes + "ab12 token: %2525256162636465",
        "%25" * 3 + "2525412541", "\\u005cu005cu005c0041KIA" + "B" * 16, "\\x5cu005cx5cU0000005cu0041KIA" + "B" * 16 + " \\u005cu0041", "%25%2525" + "a" * 30, "%252525%41", "%2525252525f0" + "0" * 24 + "%2541",
        "é %2525" + "ab" * 20 + " x%2525" + "cd" * 14, "%255cu0041 \\u00252541",
    ]:
        assert secrets.form(secrets.all_spans(t)) == secrets.form(slow_spans(t)), t


def test_op9_deep_nesting_takes_linear_time():
    import time

    from tallframe.llm import secrets

    for t in ("%" + "25" * 500_000, "\\" + "u005c" * 200_000 + "u0041", "%" + "25" * 100_000 + "41 x%" + "25" * 50_000 + "3d"):
        start = time.time()
        secrets.all_spans(t)
        assert time.time() - start < 4, t[:20]


def test_op9_raw_deflate_and_utf16():
    import base64
    import zlib

    from tallframe.llm import secrets

    inner = b"some words, then password=hunter2hunter2 and more words"
    d = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = d.compress(inner * 3) + d.flush()
    for data in (raw, inner.decode().encode("utf-16-le"), inner.decode().encode("utf-16-be")):
        t = base64.b64encode(data).decode()
        assert secrets.all_spans("see " + t + " end") == [(4, 0, 4 + len(t.rstrip("=")) + (len(t) - len(t.rstrip("="))))]
    rng = np.random.default_rng(0)
    for _ in range(300):  # noise stays noise
        t = base64.b64encode(rng.bytes(200)).decode()
        assert set(secrets.all_spans(t)) == set(secrets.base_spans(t))


def test_op2_hot_anchors_and_odd_columns(spark, monkeypatch):
    """One passage in many documents with different surroundings, with and without splitting its anchors."""
    from tallframe.llm import suffix

    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghij "))
    noise = lambda n: "".join(rng.choice(letters, n))
    passage = noise(450)
    rows = [(i, noise(int(rng.integers(0, 300))) + passage + noise(int(rng.integers(0, 300)))) for i in range(60)]
    rows += [(None, passage[:230]), (None, None), (70, noise(400)), (70, "short")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, digest int").repartition(4)
    seen = Counter((t or "")[i : i + 200] for _, t in rows for i in range(len(t or "") - 199))
    want = []
    for k, t in rows:
        t = t or ""
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = "".join(c for c, g in zip(t, gone) if not g)
        want.append((k, len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept.encode()).hexdigest()))
    for hot in (suffix.HOT, 10):
        monkeypatch.setattr(suffix, "HOT", hot)
        assert sorted(map(tuple, suffix.dedup(df).collect()), key=str) == sorted(want, key=str)


def test_near_copies_keep_columns_of_any_name_and_order_frequent_shingles_last(spark):
    from tallframe.llm import near

    rng = np.random.default_rng(6)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    common = words(40)
    rows = []
    for i in range(120):
        own = words(60)
        rows.append((i, " ".join(own[:30] + common + own[30:])))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(own[:30] + common + own[30:-1] + words(1))))
    df = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "doc_id long, text string, __tk string, __hit boolean, tk int")
    shared = set(near.shingles(" ".join(common)).tolist())
    order = near.rarity(near._texts(df, "text"))
    assert shared <= set(order.keys.tolist())
    for _, t in rows[:20]:
        h = near.shingles(t)
        first = h[np.argsort(order.of(h), kind="stable")[: len(h) - -(-4 * len(h) // 5) + 1]]
        assert not shared & set(first.tolist())
    kept = near.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(120))
    assert {(r["__tk"], r["__hit"], r["tk"]) for r in kept.collect()} == {("x", True, 1)}


def test_heavy_hitters_are_within_their_bound(monkeypatch):
    from tallframe.llm import near

    monkeypatch.setattr(near, "HITTERS", 50)
    rng = np.random.default_rng(7)
    often, all_ = near.Hitters(), []
    for _ in range(40):
        x = np.concatenate([rng.integers(0, 10, 60), rng.integers(100, 10**6, 300)]).astype(np.uint64)
        often.add(x)
        all_.append(x)
    often.fold()
    true = Counter(np.concatenate(all_).tolist())
    got = dict(zip(often.keys.tolist(), often.n.tolist()))
    assert set(range(10)) <= set(got) and len(got) <= 50
    assert all(true[k] - sum(true.values()) / 50 <= n <= true[k] for k, n in got.items())


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeated rows, long texts and clashing columns pass all stages."""
    import corpus_pipeline as cp

    long = " ".join(f"the word {i}" for i in range(30_000))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()[:40]]
    rows += [(900, None, None, None, None, None, None), (900, None, None, None, None, None, None), (None, "a null key", "en", "s", 3, "y", 2), (901, "", "en", "s", 0, "y", 2), (902, long, "en", "s", 9, "z", 3), (903, long, "en", "s", 9, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, item_id int")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = sorted(map(tuple, out.collect()), key=str)
        assert len(got) <= docs.count() and {r[0] for r in got} <= {r[0] for r in rows}
        docs = spark.createDataFrame(got, docs.schema)
    ids = [r[0] for r in got]
    assert ids.count(902) + ids.count(903) <= 1  # copies of each other
    assert cp.STAGES[-1][1](spark, docs, SF).count() == len(got)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_centroids", "op13_url_filter"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_queries_match_their_sql(spark, name, size):
    import duckdb

    from tallframe.llm import queries

    con = duckdb.connect()
    for t in ("pages", "labels", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{size}/{t}.parquet'")
    got = queries.queries()[name](spark, f"{DATA}/{size}")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_op8_records_that_repeat(spark, monkeypatch):
    from tallframe.llm import shards

    monkeypatch.setattr(shards, "REPEAT", 7)
    rows = [(1, "same text")] * 60 + [(1, "other"), (2, "same text"), (None, None), (None, None)] + [(i, "t" * i) for i in range(3, 40)]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((k, len(t or "") + 1) for k, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert all(r.grown_shard in (r.shard, 4) for r in got)
