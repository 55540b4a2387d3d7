"""Web archives, hard negatives and periodic runs against brute force, on the small tables and on awkward rows."""

import base64
import gzip
import hashlib
import io
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm import CLASHING, KIND, ROWS, rows

from skyquilt.llm import negatives, runs, warc
from skyquilt.llm.common import written
from skyquilt.llm.queries import ORACLES, QUERIES

EXTRA = [f"'{n}!' AS `{n}`" for n in dict.fromkeys([*CLASHING, "file", "record", "sha256", "offset", "length", "anchor", "low", "v", "n_words", "runs", "collapsed", "positive_id"])]


def brute_runs(words, least=12):
    """Maximal stretches by every period; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapse(words, found):
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def looped(doc_id, words):
    n = len(words)
    h = -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h < 0 or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def found_runs(texts):
    """Runs of a batch of word lists."""
    ids = np.array([w for t in texts for w in t], np.int32)
    firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out = [[] for _ in texts]
    for s, e, q in zip(*map(np.ndarray.tolist, runs.periodic_runs(ids, firsts))):
        k = int(np.searchsorted(firsts, s, "right")) - 1
        out[k].append((s - int(firsts[k]), e - s, q))
    return out


@given(st.lists(st.lists(st.integers(0, 2), max_size=50), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_of_few_words(texts):
    assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_runs_of_loops_and_copies():
    rng, texts = random.Random(4), []
    for _ in range(150):
        n = rng.choice([12, 40, 150, 300])
        words = [rng.randrange(rng.choice([2, 5, 400])) for _ in range(n)]
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if rng.random() < 0.5:
            words[rng.randrange(n)] = 7
        texts.append(words + words[: rng.choice([0, n // 2, n])])
    assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_runs_of_words_with_many_runs():
    fibonacci, thue = [[0], [0, 1]], [0]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(thue) < 512:
        thue += [1 - x for x in thue]
    texts = [fibonacci[-1], thue, [3] * 700, [1, 2] * 300, list(range(500)) * 2, [5] * 11, [5] * 12]
    assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_every_rule_once_and_places_of_all():
    """A grammar's rules stand for what they say, at all their places, and a passage of copies halves from round to round."""
    rng = random.Random(2)
    symbols = np.array(([rng.randrange(900) for _ in range(2_000)]) * 2, np.int64)
    grammar, starts, _ = runs.repair(symbols)
    assert len(grammar.begin) < 30 and len(starts) < 300
    for begin, middle, end, places, uses in zip(grammar.begin, grammar.middle, grammar.end, grammar.places, grammar.uses):
        assert (begin < middle).all() and (middle < end).all() and (uses >= 2).all()
        at = 0
        for b, e, n in zip(begin, end, uses):
            for place in places[at : at + n]:
                assert (symbols[place : place + e - b] == symbols[b:e]).all()
            at += n


def test_wrong_hashes_are_found_out(monkeypatch):
    """With hashes that take all for equal the search is done again."""
    seeds = []
    equal = runs.Same.equal
    make = runs.Same.__init__
    monkeypatch.setattr(runs.Same, "__init__", lambda self, ids, seed: (seeds.append(seed), make(self, ids, seed))[1])
    monkeypatch.setattr(runs.Same, "equal", lambda self, x, y, n: np.ones(len(x), bool) if len(seeds) == 1 else equal(self, x, y, n))
    words = [1, 2, 3, 4, 5, 6, 7] * 2 + [9] + [1, 2, 3, 4, 5, 6, 8] * 2
    assert found_runs([words]) == [brute_runs(words)] and seeds == [0, 1]


def test_very_long_text_in_bounded_time():
    ids = np.concatenate([np.zeros(300_000, np.int32), np.arange(300_000, dtype=np.int32), np.arange(300_000, dtype=np.int32)])
    got = list(zip(*map(np.ndarray.tolist, runs.periodic_runs(ids, np.array([0, len(ids)])))))
    assert got == [(0, 300_001, 1), (300_000, 900_000, 300_000)]


def check_collapse(out, docs, change=lambda _, w: w):
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    want = {}
    for doc_id, text in docs:
        words = change(doc_id, split(text))
        found = brute_runs(words)
        want.setdefault(doc_id, []).append((len(words), found, brute_collapse(words, found)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_collapse_odd_rows(spark):
    own = [(*r[:1], r[1] if r[1] is None or len(r[1]) < 10_000 else "lorem ipsum dolor " * 300 + "x", *r[2:]) for r in ROWS]
    own += [(20, "one " * 13 + "end", "en", "s", 0), (21, "\n".join(["a b c d e f g"] * 4) + "\x0bx", "en", "s", 0), (22, " \t ", "en", "s", 0), (22, None, "en", "s", 0)]
    odd = written(spark.createDataFrame(own, KIND).selectExpr("*", *EXTRA), "odd-runs")
    check_collapse(rows(runs.collapse_runs(odd)), [(r[0], r[1]) for r in own])
    assert rows(runs.collapse_runs(spark.createDataFrame([], KIND))) == []
    with pytest.raises(ValueError):
        runs.collapse_runs(odd, least=4)


def test_op13(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in rows(QUERIES["op13_periodic_runs"](spark, sf_dir))}
    assert len(got) == len(docs)
    several = 0
    for doc_id, text in docs:
        words = looped(doc_id, split(text))
        if len(words) > 4_000:
            continue  # the plain search is quadratic
        found, r = brute_runs(words), got[doc_id]
        several += bool(found)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want and r["n_runs"] == len(found)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapse(words, found).encode()).hexdigest()
    assert several > 10


# Hard negatives


def brute_negatives(table, positives=5, negatives=5, share=80):
    """table: (vec_id, label, vector of whole numbers)."""
    out = []
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, (anchor, label, v) in enumerate(table):
        if anchor is None or math.fmod(anchor, 100):
            continue
        scored = [(dot(v, w), j, lab) for k, (j, lab, w) in enumerate(table) if k != i]
        own = sorted([(s, j) for s, j, lab in scored if lab == label], key=order)[:positives]
        other = sorted([(s, j) for s, j, lab in scored if lab != label], key=order)
        for p, pid in own:
            hits = [(s, j) for s, j in other if share * p <= 100 * s <= 100 * p][:negatives]
            out += [(anchor, pid, k + 1, j, p, s) for k, (s, j) in enumerate(hits)]
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df):
    return sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in df.collect())))


def test_negatives_odd_rows(spark):
    rng, own = random.Random(7), []
    for i in range(420):
        v = [rng.choice([-0.3, 0.0, 0.11, 0.2, 0.2, 0.3]) for _ in range(6)]
        own.append((i if i % 11 else i // 2, rng.randrange(3), v))
    own += [(500, None, [1.0]), (600, 1, None), (700, 1, [1.0, None]), (800, 1, [float("nan")] * 6), (900, 1, [float("inf")] * 6), (1000, 1, []), (1100, 2, [0.1, 0.2])]
    own += [(None, 1, [0.3] * 6), (None, 2, [0.3] * 6), (-100, 1, [0.3] * 6), (1200, 1, [-0.5] * 6), (1300, 9, [0.2] * 6), (1400, 0, [3e6] * 6), (1401, 0, [2e6] * 6), (1402, 1, [1.9e6] * 6), (1500, 1, [3.0e17] * 6), (1501, 1, [3.0e17] * 6), (1502, 2, [3.0e17] * 6)]
    rng.shuffle(own)
    odd = spark.createDataFrame(own, "vec_id long, label int, embedding array<double>").selectExpr("*", *EXTRA).repartition(4)
    good = [(i, lab, v) for i, lab, v in own if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    table = [(i, lab, [min(max(math.floor(x * 256), -(2**63)), 2**63 - 1) for x in v]) for i, lab, v in good]
    want = sorted(map(str, brute_negatives(table)))
    got = negatives.vectors(odd)
    assert mined(negatives.hard_negatives(got, F.expr("vec_id % 100 = 0"))) == want and len(want) > 100
    assert mined(negatives.hard_negatives(got, F.expr("vec_id % 100 = 0"), block=2)) == want


def test_negatives_empty(spark):
    none = negatives.vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert negatives.hard_negatives(none, F.expr("vec_id % 100 = 0")).count() == 0
    one = negatives.vectors(spark.createDataFrame([(0, 1, [0.5])], "vec_id long, label int, embedding array<float>"))
    assert mined(negatives.hard_negatives(one, F.expr("vec_id % 100 = 0"))) == []


def test_combiner_keeps_the_best():
    rng, best, every = np.random.default_rng(1), negatives.Best(5, 3), []
    best.most = 40
    for _ in range(30):
        n = 17
        part = [rng.integers(0, 5, n), rng.integers(-4, 4, n), rng.integers(0, 50, n), rng.random(n) < 0.1, rng.integers(0, 10**6, n)]
        every += list(zip(*(x.tolist() for x in part)))
        best.add(*part)
    want = [x for g in range(5) for x in sorted([r for r in every if r[0] == g], key=lambda r: (-r[1], r[3], r[2], r[4]))[:3]]
    assert list(zip(*(x.tolist() for x in best.best()))) == want


# Web archives


def page_table(spark, own):
    return spark.createDataFrame(own, "page_id long, url string, html string").selectExpr("*", *EXTRA)


def archived(spark, pages, **options):
    raw, out = (warc.uri(warc.shared_dir(spark, f"test-{n}")) for n in ("crawl", "warc"))
    crawl = warc.write_archives(pages, raw, **options)
    archives = warc.normalise_archives(crawl, warc.revisits(crawl), raw, out)
    return rows(warc.read_archives(archives, out)), rows(crawl), rows(archives), out


def expected(own):
    first = {}
    for page, _, html in own:
        key = html or ""
        if key not in first or (page is not None and (first[key] is None or page < first[key])):
            first[key] = page
    return first


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdef <>\r\n", k=400_000))
    own = [(1, "http://a/ä b\r\nX-Evil: 1", "<p>é</p>\r\n\r\n"), (2, None, None), (3, "http://c", ""), (4, "http://d", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (None, "http://e", "only"), (None, "http://f", "<p>é</p>\r\n\r\n")]
    own += [(5, "http://g", long), (6, "http://h", long), (6, "http://h", long), (7, "http://i", "same"), (7, "http://i", "same"), (-5, "http://j", "same"), (8, "%zz", "\x00\x01")] + [(100 + i, "u", "hot") for i in range(60)]
    got, crawl, archives, _ = archived(spark, page_table(spark, own).repartition(3), file_bytes=50_000)
    assert len(got) == len(own) and len(archives) == len({r["file"] for r in crawl}) > 3
    first, kept = expected(own), {}
    for r in got:
        html = next(h or "" for p, _, h in own if p == r["page_id"] and digest(h) == r["payload_digest"])
        assert r["payload_bytes"] == len(html.encode())
        if r["record_type"] == "response":
            assert r["refers_to"] is None and r["page_id"] == first[html]
            kept[html] = kept.get(html, 0) + 1
        else:
            assert r["refers_to"] == first[html]
    assert kept == dict.fromkeys({h or "" for _, _, h in own}, 1)


def test_archives_empty(spark):
    got, crawl, archives, _ = archived(spark, page_table(spark, []))
    assert got == crawl == archives == []


def test_small_payloads_are_no_revisits(spark):
    crawl = spark.createDataFrame([("f", i, i, n, h) for i, (n, h) in enumerate([(3, b"a"), (3, b"a"), (9, b"b"), (9, b"b"), (9, b"b")])], warc.CRAWL)
    assert sorted((r["record"], r["first"]["record"]) for r in warc.revisits(crawl, 4).collect()) == [(3, 2), (4, 2)]


def record(number, body):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", warc.record_id("f", number)), ("WARC-Payload-Digest", "sha1:x"), ("Content-Length", len(block))]
    return warc.head(fields) + warc.END + block + warc.END


BODIES = st.lists(st.one_of(st.binary(max_size=300), st.sampled_from([b"", b"\r\n\r\n" * 9, b"WARC/1.1\r\n", b"z" * 700_000])), min_size=1, max_size=6)


@given(BODIES, st.sampled_from(["one", "many", "plain"]))
@settings(max_examples=60, deadline=None)
def test_normalised_members(bodies, form):
    """Each member is a record by itself, whatever the archive was; what it held comes back byte for byte."""
    own = [record(i, b) for i, b in enumerate(bodies)]
    data = {"one": gzip.compress(b"".join(own)), "many": b"".join(map(gzip.compress, own)), "plain": b"".join(own)}[form]
    out = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(data), out, {0: {"file": "f", "record": 9, "page_id": None}}))
    raw = out.getvalue()
    assert sum(n for _, n, _, _ in index) == len(raw) and len(index) == len(bodies)
    for i, (at, n, kind, name) in enumerate(index):
        fields, _, payload = warc.read_record(raw[at : at + n])
        assert name == fields["warc-record-id"] == warc.record_id("f", i)
        assert (kind, payload) == (("revisit", b"") if i == 0 else ("response", bodies[i]))
        assert gzip.decompress(raw[at : at + n]).startswith(b"WARC/1.1\r\n")


def test_broken_archives_say_so():
    data = gzip.compress(record(0, b"x" * 5_000) + record(1, b"y"))
    for bad in (data[:-30], gzip.compress(record(0, b"x")[:-20]), b"no archive at all, but long enough\r\n\r\n", gzip.compress(record(0, b"x")[:-4] + b"more" + warc.END)):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.normalise(io.BytesIO(bad), io.BytesIO()))


def test_members_are_reached_by_the_sidecar(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got, _, archives, out = archived(spark, pages)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    store, root = pa.fs.FileSystem.from_uri(out)
    for r in got[::7]:
        with store.open_input_file(f"{root}/{r['file']}") as f:
            fields, _, payload = warc.read_record(f.read_at(r["length"], r["offset"]))
        assert int(fields["page-id"]) == r["page_id"] and payload == html[r["page_id"]].encode()
    assert sum(a["n_records"] for a in archives) == len(got) + len(archives)  # each archive begins with a record about itself


@pytest.mark.parametrize("name", ["op11_warc", "op12_hard_negatives"])
def test_sql_says_the_same(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert got == sorted(map(str, want)) and got
