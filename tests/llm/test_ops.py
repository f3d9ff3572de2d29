"""Training-data operators against brute force, with hard cases in each table."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
LONG = "wort " * 40_000
HARD = ["", None, " ", "one", "one", "a  b", "\n \nfoo", "x \n y", "<|endoftext|> a", "日本語 テキスト🙂", "'s it's I'll 12", "  lead", "ſ K", "ab" * 300, "ü" * 150, LONG]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of the test table, hard texts, a null id, repeated rows and a clashing column."""
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()[:60]]
    rows += [(1000 + i, t, None) for i, t in enumerate(HARD)] + [(None, "null id", "y"), (1003, "one", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def union_find(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_covering_masks_cover_every_triple():
    from itertools import combinations

    from tallframe.llm.simhash import covering_masks

    masks = covering_masks(list(range(64)), 3, 42)
    assert len(masks) == 15
    for c in combinations(range(64), 3):
        bits = sum(1 << i for i in c)
        assert any(not m & bits for m in masks)


def test_op1_components(docs, empty, monkeypatch):
    import xxhash

    from tallframe.llm import simhash

    def brute(t):
        w = t.encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    t = [x for x in texts(docs) if x[0] is not None]
    for heavy in (4096, 2):  # the second sends buckets down the splitting path
        monkeypatch.setattr(simhash, "HEAVY", heavy)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(docs.where("doc_id is not null")).collect()}
        fp = {i: brute(x) for i, x in t}
        comp = union_find(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
        assert got == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}
    assert simhash.components(docs).count() == docs.count()
    assert simhash.components(empty).count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, empty):
    from tallframe.llm import near

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words, 150)) for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        rows.append((i, b))
        w = b.split()
        w[75] = "changed"
        rows.append((100 + i, " ".join(w)))
        rows.append((200 + i, b))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.keep_one(df).collect()) == list(range(12))
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    seen = Counter((r.text or "") for r in kept.collect())
    assert max(seen.values()) == 1
    assert near.keep_one(empty).count() == 0


def kept_by_brute_force(rows):
    """Smallest key of each group that hangs together by similarity of at least 0.8."""
    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    s = {k: shingles(t) for k, t in rows}
    linked = [(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    return sorted(set(union_find(s, linked).values())), len(linked)


def test_near_duplicate_stage_on_families_of_edited_copies(spark):
    from tallframe.llm import near

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(4):
        base = rng.choice(words, 300).tolist()
        for _ in range(60):
            w = list(base)
            for at in rng.choice(300, rng.integers(3, 9), replace=False):
                w[at] = f"e{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(w)))
    kept, n = kept_by_brute_force(rows)
    assert n > 20 and len(kept) > 100  # most pairs fail, so they crowd out the others in a forest
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.keep_one(df).collect()) == kept


def test_near_duplicate_stage_on_short_texts_with_other_ends(spark):
    from tallframe.llm import near

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for n in [*range(1, 30), 62, 63, 64, 75, 80]:
        for _ in range(4):
            w = rng.choice(words, n).tolist()
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w, "more"])), (len(rows) + 2, " ".join([*w[:-1], "other"]))]
    kept, n = kept_by_brute_force(rows)
    assert n > 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.keep_one(df).collect()) == kept


def test_near_duplicate_stage_on_repeated_lines(spark):
    from tallframe.llm import near

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for times in (20, 60):
        for _ in range(10):
            body, line = " ".join(rng.choice(words, 250)), " ".join(rng.choice(words, 10))
            rows += [(len(rows), f"{body} {line}"), (len(rows) + 1, body + f" {line}" * times)]
    kept, n = kept_by_brute_force(rows)
    assert n == 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.keep_one(df).collect()) == kept


def test_op2_repeated_bytes(spark, empty):
    from tallframe.llm import suffix

    base = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()[:70]]
    extra = ["ab" * 300, None, "", "x" * 199, "x" * 200, "y" * 250, "z" * 100 + "q" * 100 + "z" * 100, "ü" * 150, "ab" * 90 + "c" * 40, base[0], base[1][:500] + "!" + base[2][:400]]
    pattern = "".join(f"{i} {i * i % 7919}," for i in range(30_000))
    extra += [pattern, pattern[262_000:263_000] + "?", pattern[200_000:]]  # over one piece, and repeats across the cut
    rows = list(enumerate(base + extra))
    got = {r[0]: tuple(r)[1:] for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    for (k, _), t in zip(rows, data):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        assert got[k] == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffix.dedup(empty).count() == 0


def test_suffix_array_and_common_prefixes():
    from tallframe.llm import sais

    rng = np.random.default_rng(1)
    for _ in range(300):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 60)))
        s = t.tolist()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert sais.suffix_array(t).tolist() == want
        assert sais.suffix_array(t * 5000).tolist() == want  # large alphabet
        if len(t):
            p = sais.permuted_lcp(t.astype(np.uint8), np.array(want), len(t) - np.arange(len(t)), 9, 4)
            for q, x in zip(want[1:], want):
                m = 0
                while m < 9 and max(q, x) + m < len(s) and s[q + m] == s[x + m]:
                    m += 1
                assert p[q] == m


def test_op2_blocks_compare_only_where_a_string_fits(monkeypatch):
    """The repeated starts of a block by brute force; bytes are compared only at the starts of whole strings (most
    positions of a block have fewer bytes left), once for 32 of them and a few more."""
    from tallframe.llm import sais, suffix

    rng = np.random.default_rng(8)
    common = [bytes(rng.integers(97, 123, 260, dtype=np.uint8)) for _ in range(30)]
    stretches = []
    for i in range(900):
        left, right = (bytes(rng.integers(97, 123, int(rng.integers(0, 40)), dtype=np.uint8)) for _ in range(2))
        stretches.append((left + common[i % 30] + right)[: int(rng.integers(200, 340))])
    stretches = list(dict.fromkeys([*stretches, b"x" * 300, b"y" * 200, b"\0" * 210, b"only once" * 30 + b"!" * 200]))
    counts = rng.integers(1, 3, len(stretches))
    seen = Counter()
    for s, n in zip(stretches, counts.tolist()):
        for i in range(len(s) - 199):
            seen[s[i : i + 200]] += n
    want = {}
    for k, s in enumerate(stretches):
        starts = [i for i in range(len(s) - 199) if seen[s[i : i + 200]] > 1]
        if starts:
            want[k] = [x for i in starts for x in [i] * ((i - 1 not in starts) + (i + 1 not in starts))]
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(sais.np, "bitwise_count", lambda x: compared.append(len(x)) or count(x))
    which, offsets, runs = suffix.repeated_runs(stretches, counts)
    assert {k: runs[a:b].tolist() for k, a, b in zip(which.tolist(), offsets, offsets[1:])} == want
    fits = sum(len(s) - 199 for s in stretches)
    assert fits < sum(map(len, stretches)) / 4
    assert sum(compared) < 3 * fits
    which, offsets, runs = suffix.repeated_runs([b"a" * 100 + b"b" * 100], np.array([1]))  # none
    assert len(which) == len(runs) == 0 and offsets.tolist() == [0]


def test_op2_names_longer_than_a_number_and_keys_too_wide_to_pack():
    from tallframe.llm import sais

    rng = np.random.default_rng(9)
    for _ in range(100):
        # long rises and falls: what lies between two leftmost S positions is longer than 7 or 15 symbols
        t = np.concatenate([np.sort(rng.integers(0, 250, int(rng.integers(1, 40))))[:: int(rng.choice([1, -1]))] for _ in range(12)] * 2)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sais.suffix_array(t).tolist() == want
        assert sais.suffix_array(t + (1 << 14)).tolist() == want
        assert sais.suffix_array(t + (1 << 60)).tolist() == want


@pytest.mark.parametrize("split", [6000, 60])
def test_op3_links(spark, monkeypatch, split):
    from tallframe.llm import embed_graph

    monkeypatch.setattr(embed_graph, "SPLIT", split)  # the second sends shards down the splitting path
    monkeypatch.setattr(embed_graph, "HELD", split)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 16))
    x[:120] = x[0] + 0.02 * rng.standard_normal((120, 16))  # a dense ball
    x[200:230] = x[200] + 0.25 * rng.standard_normal((30, 16))  # a loose one
    x[300] = x[301]
    vec = [v.tolist() for v in x] + [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, x[5].tolist(), [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(vec)), "vec_id long, embedding array<double>")
    res = embed_graph.links(df)
    got = {r.vec_id: r for r in res.collect()}
    good = [i for i, v in enumerate(vec) if embed_graph.usable(v) and len(v) == 16]
    u = np.array([vec[i] for i in good])
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = u @ u.T >= 0.95
    n = dict(zip(good, (c.sum(1) - 1).tolist()))
    comp = union_find(range(len(vec)), [(good[a], good[b]) for a, b in zip(*np.nonzero(np.triu(c, 1)))])
    true = sum(n.values())
    assert sum(min(got[i].n_links, n[i]) for i in good) >= 0.98 * true
    assert all(got[i].n_links <= n.get(i, 0) for i in range(len(vec)))
    assert sum(got[i].component_id != comp[i] for i in range(len(vec))) <= 2
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert embed_graph.audit(df, res) >= 0.9
    assert embed_graph.links(df.limit(0)).count() == 0


def test_op4_files_round_trip(docs, empty):
    from tokenizers import Tokenizer

    from tallframe.llm import token_output as to

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    t = sorted((x for x in texts(docs) if x[0] is not None), key=lambda x: x[0])
    got = sorted(to.token_positions(docs.where("doc_id is not null"), path).collect(), key=lambda r: r.start)
    at = 0
    assert len(got) == len(t)
    for (k, x), r in zip(t, got):
        ids = np.array([*lib.encode(x, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert to.token_positions(docs, path).count() == docs.count()
    assert to.token_positions(empty, path).count() == 0


def test_op4_equals_the_library_on_whole_texts(spark):
    from tokenizers import Tokenizer

    from tallframe.llm import token_output as to

    path = P.path("byte_bpe_50k.json")
    lib, enc = Tokenizer.from_file(path), to.Encoder(path)
    t = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for x, ids in zip(t, enc.encode(t)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids


def shard_file(rows):
    import pyarrow as pa

    from tallframe.llm import token_output as to

    class Kept(pa.BufferOutputStream):
        def close(self):
            pass

    out = Kept()
    w = to.ShardWriter(out)
    for k, ids in rows:
        w.add(k, ids)
    w.close()
    return pa.BufferReader(out.getvalue())


def test_perfect_hash_is_minimal_and_turns_strangers_away(monkeypatch):
    from tallframe.llm import token_output as to

    rows = [(k, np.arange(i % 5)) for i, k in enumerate([None, *range(3000), 3000, 3000, "x" * 9])]
    for weak in (False, True):
        if weak:  # fingerprints that meet under the first seeds
            real = to.fingerprint
            monkeypatch.setattr(to, "fingerprint", lambda k, seed=0: real(k, seed) & (0xFF if seed < 3 else (1 << 64) - 1))
        s = to.Shard(shard_file(rows))
        assert s.seed == (3 if weak else 0)
        keys = [None, *range(3001), "x" * 9]
        first, many = s.find(keys)
        assert first.tolist() == [*range(3002), 3003] and many.tolist() == [1] * 3001 + [2, 1]
        assert (s.find([-1, "y", 99999])[0] == -1).all() and s.lookup(-1) == [] and s.lookup("y") == []
        for i in (0, 1, 77, 3001):
            assert [x.tolist() for x in s.lookup(keys[i])] == [r.tolist() for k, r in rows if k == keys[i]]
        assert [x.tolist() for _, x in s.documents(0, len(rows), 7)] == [r.tolist() for _, r in rows]
    calls = []
    real_read = s.read
    s.read = lambda n, at: calls.append(n) or real_read(n, at)
    s.lookup(1500)
    assert len(calls) < 16 and sum(calls) < 4096  # whatever the size of the shard
    assert to.Shard(shard_file([])).find([1])[0].tolist() == [-1]


def test_op5_against_tiktoken(docs, empty):
    import tiktoken

    from tallframe.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = Counter(tuple(r) for r in bpe.digests(docs, path, P.PATTERN).collect())
    want = Counter()
    for k, x in texts(docs):
        ids = np.array(enc.encode_ordinary(x), "<u4")
        want[k, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digests(empty, path, P.PATTERN).count() == 0


def test_op6_archives(spark):
    from tallframe.llm import warc

    body = "WARC/1.1\r\n\r\n" + "<p>é</p>" * 30
    rows = [(1, "u1", "short"), (2, "u2", "short"), (3, "u3", body), (4, "u4\r\nX: y", body), (5, None, None), (6, "u6", body + "!"), (7, "u7", body), (8, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for k, _, h in rows:
        b = (h or "").encode()
        refers = 3 if k in (4, 7) else None
        assert tuple(got[k]) == (k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if refers else "response", refers)
    assert warc.round_trip(pages.limit(0)).count() == 0
    # null and repeated ids, repeated rows, a payload of some MB, a column named like a result
    long = "<p>lang</p>" * 300_000
    rows = [(None, "u", body, "x"), (9, "u", body, "y"), (9, "u", body, "y"), (10, "u", body, None), (None, "u", None, "z"), (11, None, long, "z"), (12, None, long, "z")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(odd).collect())
    n = len(body.encode())
    assert got == Counter([(None, n, "revisit", 9), (9, n, "response", None), (9, n, "response", None), (10, n, "revisit", 9), (None, 0, "response", None),
                           (11, len(long), "response", None), (12, len(long), "revisit", 11)])


def test_op6_archive_forms():
    import gzip

    from tallframe.llm import warc

    records = [warc._record("response", str(i), "d", None, "u", b"\r\n\r\nWARC/1.1" * i) for i in range(5)]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        for size in (7, 1 << 20):
            found = list(warc.parse(iter([data[i : i + size] for i in range(0, len(data), size)])))
            assert [h["WARC-Record-ID"] for h, _ in found] == [f"<urn:tallframe:page:{i}>" for i in range(5)]
            assert [b.split(b"\r\n\r\n", 1)[1] for _, b in found] == [b"\r\n\r\nWARC/1.1" * i for i in range(5)]


def test_op7_edit_matches(spark, docs, empty):
    from tallframe.llm import decontam

    rng = np.random.default_rng(3)
    item = "".join(rng.choice(list("abcdefgh ij"), 120))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item.upper()), (5, "zq")], "item_id long, text string")
    k = int(decontam.ERROR_RATE * len(decontam.normalise(item).strip()))

    def edited(n):
        s = list(item)
        for at in rng.choice(np.arange(3, 117), n, replace=False):
            s[at] = "Z"
        return "".join(s)

    rows = [(0, "x " * 50 + item + " y" * 50), (1, edited(k)), (2, edited(k + 4)), (3, None), (4, item.replace(" ", "\n")), (5, item[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r["items"], r["distances"]) for r in decontam.matches(df, bench).collect()}

    def brute(a, w):
        d = [0] * (len(w) + 1)
        for i, c in enumerate(a, 1):
            p, d = d, [i]
            for j, x in enumerate(w, 1):
                d.append(min(p[j - 1] + (c != x), p[j] + 1, d[j - 1] + 1))
        return min(d)

    n = decontam.normalise(item).strip()
    for i, t in rows:
        b = brute(n, decontam.normalise(t or ""))
        assert got[i] == (([1, 4], [b, b]) if b <= k else ([], []))
    assert decontam.decontaminate(df, bench).count() == sum(not v[0] for v in got.values())
    assert decontam.matches(empty, bench).count() == 0
    assert decontam.matches(df, bench.limit(0)).where("size(items) > 0").count() == 0


def test_op7_blocks_of_items_give_one_row_per_document(spark, monkeypatch):
    from tallframe.llm import decontam

    items = [f"item {i} asks how many {i * 7919} apples a shop {i * 31} sells before it closes" for i in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(items)), (1, " ".join(items)), (2, items[3]), (3, "clean"), (4, None)], "doc_id long, text string")
    want = sorted(map(tuple, decontam.matches(df, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    assert len([b for b in decontam.item_blocks(bench) if b]) > 1
    got = sorted(map(tuple, decontam.matches(df, bench).collect()))
    assert got == want and [r[0] for r in got] == [1, 1, 2, 3, 4]
    assert set(got[0][1]) == set(range(12))


def test_op8_positions_and_growth(docs, empty):
    from tallframe.llm import shards

    got = shards.assign(docs, 16).collect()
    size = Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in got) == size
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert sizes == {(k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts(docs)}
    assert shards.assign(empty, 16).count() == 0
    for n in (1, 5, 16, 17):
        held = Counter(shards.slot_map(n))
        assert len(held) == n and max(held.values()) - min(held.values()) <= n
    many = shards.assign(docs.unionByName(docs), 16).collect()
    assert {r.doc_id: r.shard for r in many} == by_id and len(many) == 2 * len(got)
    bytes_ = {s: 1 + (s % 7) * 100 for s in range(shards.SLOTS)}
    load = Counter()
    for s, o in enumerate(shards.rebalance(shards.slot_map(16), bytes_, 16)):
        load[o] += bytes_[s]
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 16 + 1


def test_op9_spans(docs, empty):
    import base64
    import gzip
    import re
    from urllib.parse import quote

    from tallframe.llm import secrets

    secret = "password=hunter2hunter2"
    b64 = base64.b64encode(secret.encode()).decode()
    layers = [secret, "see " + b64 + " end", quote(b64 + "/+", safe=""), base64.b64encode(gzip.compress(b64.encode())).decode(),
              "".join(f"\\u{ord(c):04x}" for c in secret), base64.b64encode(b64.encode()).decode()]
    for t in layers:
        spans = secrets.all_spans("é " + t)
        assert any(k == 0 for _, k, _ in spans), t
        assert all(0 <= a < b <= len(t) + 2 for a, _, b in spans)
        assert "hunter2" not in secrets.redact_text("é " + t)
    for t in ["token: abc", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "f" * 23, "f" * 24, "ſecret=abcdefgh", "apiKEY='abcdef'", "secret=ab token=abcdefg"]:
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i)([Pp][Aa]ssword|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secrets.base_spans(t) == sorted(want), t
    for _, t in texts(docs):
        assert set(secrets.base_spans(t)) <= set(secrets.all_spans(t))
    got = secrets.scan(docs)
    assert got.count() == docs.count() and secrets.scan(empty).count() == 0
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == docs.count()
    assert secrets.redact(docs).where("text is null").count() == docs.where("text is null").count()


def test_op9_runs_in_their_context():
    import base64
    import gzip

    from tallframe.llm import secrets

    inner = b"some words and password=hunter2hunter2 here"
    enc = base64.b64encode(inner).decode()
    packed = base64.b64encode(gzip.compress(b"first member ") + gzip.compress(inner)).decode()
    wrapped = base64.encodebytes(b"x" * 45 + b" password=hunter2hunter2 and more").decode()
    for t in ["blob_" + enc, "id-" + enc, "/v1/x/" + enc, "data" + enc, "blob_" + packed, wrapped, '"password"%3A"hunter2hunter2"',
              "password %3D hunter2hunter2", '"password"%253A"hunter2hunter2"', "password \\u003d hunter2hunter2", base64.b64encode(b'x "password"%3A"hunter2hunter2"').decode()]:
        spans = secrets.all_spans("é " + t + " at the end")
        assert spans and all(k == 0 and s >= 2 and e <= 2 + len(t) for s, k, e in spans), (t, spans)
        assert "hunter2" not in secrets.redact_text("é " + t)
    assert secrets.all_spans("50%25 of plain/words-and_paths/with/slashes 100%") == []


def test_op8_stored_map(docs, tmp_path):
    from tallframe.llm import shards

    spark = docs.sparkSession
    got = shards.assign(docs, 16, path=str(tmp_path / "map")).collect()
    store = shards.SlotMap(spark, str(tmp_path / "map"))
    first, n_bytes = store.owners(1)
    second, _ = store.owners(2)
    assert first == shards.slot_map(16) and second == shards.slot_map(17)
    want = Counter()
    for r in got:
        assert (r.shard, r.grown_shard) == (first[r.vslot], second[r.vslot])
        want[r.vslot] += r.size
    assert {s: n for s, n in n_bytes.items() if n} == dict(want)
    third = store.rebalance(store.rebalance(2))
    owner, _ = store.owners(third)
    load = Counter()
    for s, o in enumerate(owner):
        load[o] += n_bytes[s]
    assert third == 4 and max(owner) == 16 and sum(load.values()) == sum(want.values())


def test_op7_ids_and_white_space(spark):
    from tallframe.llm import decontam

    item = "which of the two trains reaches the town before noon today"
    df = spark.createDataFrame([(None, "a " + item.replace(" ", "\u3000"), 1), (5, item.replace(" ", "\u2003"), 2), (5, item.upper(), 3), (6, "x " * 200_000 + item, 4)], "doc_id long, text string, items long")
    bench = spark.createDataFrame([(None, item), ("b", item + "?"), ("a", item), ("a", item), (None, item)], "item_id string, text string")
    got = decontam.matches(df, bench).collect()
    assert len(got) == 4 and all(r["items"] == ["a", "b", None] and r["distances"] == [0, 1, 0] for r in got)
    assert decontam.decontaminate(df, bench).columns == df.columns


def slow_spans(text):
    """Every escape decoded sign by sign, every run of base64 signs decoded from each offset."""
    import base64
    import re
    import zlib

    from tallframe.llm import secrets

    def escapes(t, place, sign):
        out, i = [], 0
        while i < len(t):
            m = re.compile("(?:%[0-9A-Fa-f]{2})+" if sign == "%" else r"\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|U[0-9A-Fa-f]{8})").match(t, i)
            if not m:
                out.append((t[i], place[i]))
                i += 1
            elif sign == "%":
                for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
                    n = 3 * len(c.encode("utf-8", "surrogateescape"))
                    out.append((c, (place[i][0], place[i + n - 1][1])))
                    i += n
            else:
                out.append((chr(int(m[0][2:], 16)), (place[i][0], place[m.end() - 1][1])))
                i = m.end()
        return "".join(c for c, _ in out), [p for _, p in out]

    def unpack(data):
        try:
            return unpack(zlib.decompressobj(47).decompress(data))
        except zlib.error:
            return data

    found, seen, work = set(), set(), [(text, [(i, i + 1) for i in range(len(text))])]
    while work:
        t, place = work.pop()
        if not t or (t, tuple(place)) in seen:
            continue
        seen.add((t, tuple(place)))
        found |= {(place[s][0], k, place[e - 1][1]) for s, k, e in secrets.base_spans(t)}
        work += [escapes(t, place, sign) for sign in "%\\"]
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}=*", t):
            run, where = m[0].rstrip("=").replace("-", "+").replace("_", "/"), (place[m.start()][0], place[m.end() - 1][1])
            for at in range(len(run) - 15):
                part = run[at:][: len(run[at:]) - (len(run[at:]) % 4 == 1)]
                new = unpack(base64.b64decode(part + "=" * (-len(part) % 4))).decode("utf-8", "replace")
                work.append((new, [where] * len(new))) if re.search("[ -~\\s]{12}", new) else None
    return sorted(found)


def test_op9_scan_against_a_slow_reference(spark, docs):
    import base64
    import gzip

    from tallframe.llm import secrets

    inner = "x password=hunter2hunter2 and token: abcdefgh"
    enc = base64.b64encode(inner.encode()).decode()
    rows = [(i, t) for i, (_, t) in enumerate(texts(docs)) if t != LONG]
    rows += [(1000 + i, t) for i, t in enumerate([
        f"é {enc} x", f"a/b_{enc}", "pass%77ord%3Dhunter2%68unter2 %C3%A9 token\\u003dabcdef\\x67", "%5Cu0041KIA" + "B" * 16,
        "q " + base64.b64encode(gzip.compress(enc.encode())).decode(), "%41%4b%49%41" + "C" * 20, "tail " + base64.b64encode(enc.encode()).decode()])]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        r, base = got[k], secrets.base_spans(t)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x == n for _, x, _ in base) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(secrets.form(base).encode()).hexdigest()
        assert r.spans == secrets.form(slow_spans(t)), t[:200]


def test_op9_long_runs_take_linear_time_and_streams_are_read_to_the_end(monkeypatch):
    import base64
    import gzip
    import time

    from tallframe.llm import secrets

    for t in ("% " + "a." * 500_000, "\\ " + "a" * 1_000_000, "-a" * 500_000 + "\n", "%41" * 300_000):
        start = time.time()
        secrets.all_spans(t)
        assert time.time() - start < 5
    assert secrets.all_spans("xx password%3dhunter2hunter2 y") == [(3, 0, 28)]
    monkeypatch.setattr(secrets, "WINDOW", 100_000)
    for filler in (b"no line ends here ", b"line\n", b"\0"):
        data = gzip.compress(filler * 40_000) + gzip.compress(b"\npassword=hunter2hunter2")
        t = base64.b64encode(data).decode()
        assert secrets.all_spans("a " + t) == [(2, 0, 2 + len(t))]


def test_op10_quality(spark, docs, empty):
    from tallframe.llm import quality

    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(d, lab)
    got = quality.score(d, model).join(lab, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95
    for r in quality.score(d, model).limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    odd = quality.score(docs, model)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(empty, model).count() == 0 and quality.keep_good(docs, model).columns == docs.columns
    none = quality.fit(d, lab.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_components_of_long_chains(spark):
    from tallframe.llm.common import connected_components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wide_maps_never_rule_out_a_similar_pair():
    from tallframe.llm import near

    rng = np.random.default_rng(5)
    ruled_out = 0
    for n in (1, 2, 40, 63, 64, 65, 700, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for changed in (0.0, 0.05, 0.1, 0.12, 0.5, 1.0):
            kept = x[rng.random(len(x)) >= changed]
            for extra in (0, len(x) // 10, len(x)):
                y = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, extra).astype(np.uint64)]))
                if not len(y):
                    continue
                passes = near.may_be_alike(near.wide_parity(x), near.wide_parity(y), len(x) + len(y))
                assert passes or not near.alike(x, y)
                ruled_out += not passes
    assert ruled_out > 40


def test_batch_bound_leaves_a_setting_of_the_session_alone(spark):
    from tallframe.llm.common import bound_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "9m")
        bound_batches(spark)
        assert spark.conf.get(name) == "9m"
        spark.conf.unset(name)
        bound_batches(spark)
        assert spark.conf.get(name) == "4m"
    finally:
        spark.conf.set(name, before)


def test_op10_training_starts_anew_after_divergence():
    from tallframe.llm import quality

    rng = np.random.default_rng(3)
    words = [["good", "clear", "plain", "words"], ["spam", "cheap", "click", "offer"]]
    labels = [int(k % 3 == 0) for k in range(120)]
    texts = [" ".join(rng.choice(words[1 - y], 30)) for y in labels]
    calm = quality.train(texts, labels, buckets=1 << 12)
    for rate in (1.0, 300.0):
        model = quality.train(texts, labels, rate=rate, buckets=1 << 12)
        scores = model.scores([*texts, "", "unseen"])
        assert np.isfinite(scores).all() and all((s >= 0.5) == (y == 1) for s, y in zip(scores, labels)), rate
    # what never settles says nothing, and a run that settles is the plain descent
    assert set(quality.train(texts, labels, rate=1e30, buckets=1 << 12).scores(texts)) == {0.5}
    rows = [quality._counted(t, 1 << 12) for t in texts]
    vectors, out, _ = quality._descend(rows, np.array(labels), 8, 1.0, 1 << 12, quality.DIM, 7)
    assert np.array_equal(calm.bucket_score, (vectors @ (out[1] - out[0])).astype(np.float64))
    one = quality.train(["a b", "c d"], [1, 1], buckets=1 << 12).scores(["a b", ""])
    assert np.isfinite(one).all() and (one >= 0.5).all()


def test_op3_range_search_and_flat_buffers():
    import pyarrow as pa

    from tallframe.llm import embed_graph as G

    rng = np.random.default_rng(5)
    x = G.unit(np.repeat(rng.normal(size=(60, 8)), 5, 0) + 0.05 * rng.normal(size=(300, 8)))
    nbrs = G.robust_prune(x)
    flat = G.padded(np.repeat(np.arange(300), [len(b) for b in nbrs]), np.concatenate(nbrs), 300)
    assert all(np.array_equal(row[row >= 0], b) for row, b in zip(flat, nbrs))
    queries, need = np.arange(0, 300, 3), np.full(100, 0.95)
    got = [G.range_search(x, n, queries, 0, need) for n in (nbrs, flat)]
    assert all(np.array_equal(a, b) for a, b in zip(*got))
    near = x[queries] @ x.T >= 0.95
    found = set(zip(got[0][0].tolist(), got[0][1].tolist()))
    assert found <= set(zip(*map(np.ndarray.tolist, np.nonzero(near)))) and len(found) >= 0.99 * near.sum()
    # one point without neighbours, and a column in chunks and slices
    assert len(G.range_search(x[:1], [np.array([], int)], np.array([0]), 0, np.array([0.9]))[0]) == 1
    chunks = pa.chunked_array([pa.array(x[:7].tolist()).slice(2), pa.array(x[7:9].tolist(), pa.list_(pa.float32()))
                               .cast(pa.list_(pa.float64()))])
    assert np.allclose(G.unit_column(chunks), x[2:9], atol=1e-6)
