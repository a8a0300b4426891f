"""Each operator against brute force, a round trip or held-out accuracy, and on odd rows."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.llm import jaccard, linededup, media, mixing, packing, secrets, sharding, topk, toxicity, warc
from siftmark.llm.common import components, stored, tidy
from siftmark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long, repeated and tied rows, and a null id."""
    r = random.Random(5)
    vocabulary = ["ab", "cd", "été", "naïve", "x.", "idiot", "Straße", "'s", "<|endoftext|>", "1234", "—", "the", "THE"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", "en", "a", 3), (3, "word", "en", "b", 4), (3, "word", "en", "b", 4), (None, "no id here", "de", None, 1)]
    rows += [(4, text(9000), "en", "z", 1), (5, "x" * 50_000, "en", "z", 1), (6, "\x1c a\xa0b   c\x85d", "fr", "é", 1)]
    base = text(60)
    rows += [(100 + k, base if k % 3 else base + f" tail{k}", "en", r.choice(["a", "b", None, "🙂"]), 1) for k in range(20)]
    rows += [(200 + k, text(r.randint(1, 200)), "en", r.choice("abc"), 1) for k in range(80)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The same rows with extra columns named like those the operators make."""
    names = ("size", "shard", "key", "class", "unit", "rank", "_lines", "n", "bytes", "page", "copies", "_host", "held_out", "score", "block", "n_bytes", "media", "v", "id", "row", "_kept", "_drop", "lines_in", "_id", "_copies", "at", "class_", "comp", "draw")
    return df.select("*", *[F.lit("extra").alias(c) for c in names])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1 ----------------------------------------------------------------------------------------------
def test_secrets_forest_on_held_out_findings():
    forest = secrets.train(secrets.labelled_findings(3000, seed=1))
    held = secrets.labelled_findings(1500, seed=2)
    x = np.array([secrets.features(f) for f in held])
    score, labels = forest.score(x), np.array([f.label for f in held])
    assert ((score >= 0.5) == labels).mean() > 0.98

    def walk(tree, row):  # one tree, one row, node by node
        feature, cut, left, right, share = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[feature[at]] <= cut[at] else right[at]
        return share[at]

    assert np.allclose(score[:200], [sum(walk(t, row) for t in forest.trees) / len(forest.trees) for row in x[:200]])
    one = secrets.train([f for f in held if f.label == 1])
    assert one.score(x[:1])[0] == 1 and secrets.train([]).score(np.zeros((2, 3))).tolist() == [0, 0]


def test_secrets_forest_on_kinds_it_never_saw():
    for kind in ("forge token", "web token", "payment key", "identifier", "long word", "commit", "number"):
        forest = secrets.train(secrets.labelled_findings(without=[kind]))
        held = secrets.labelled_findings(200, seed=3, only=[kind])
        assert held and np.mean([(s >= 0.5) == f.label for f, s in zip(held, forest.score(np.array([secrets.features(f) for f in held])), strict=True)]) > 0.85, kind


def test_secrets_path_and_words_decide_between_equal_values():
    forest = secrets.train(secrets.labelled_findings())
    value = hashlib.sha1(b"v").hexdigest()
    score = lambda path, before: forest.score(np.array([secrets.features(secrets.Finding(path, before, value, '" end'))]))[0]
    assert score("app/settings.py", 'so api_key = "') > 0.5 > max(score("tests/test_client.py", 'so api_key = "'), score("app/settings.py", "at commit "))
    many = [secrets.Finding("p", "token = ", f"{k:032x}", " ", k % 2) for k in range(secrets.MAX_FINDINGS + 50)]
    grown = []
    grow, secrets.grow_forest = secrets.grow_forest, lambda x, y, seed: grown.append(len(y))
    try:
        secrets.train(many)
    finally:
        secrets.grow_forest = grow
    assert grown == [secrets.MAX_FINDINGS]


def plain_candidates(text, least=16):
    """The rules of candidates, a character at a time."""
    spans, low, n = [], text.lower(), len(text)
    blank = lambda i: i < n and text[i].isspace()
    for i in range(n):  # blocks
        if text.startswith("-----BEGIN ", i):
            end = text.find("-----", i + 11)
            kind = text[i + 11 : end]
            if end > 0 and (kind.endswith("PRIVATE KEY") or kind.endswith("PRIVATE KEY BLOCK")) and all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 " for c in kind):
                close = min((x for x in (text.find("-----BEGIN ", end + 5), text.find("-----END ", end + 5)) if x >= 0), default=-1)
                if close >= 0 and text.startswith(f"-----END {kind}-----", close):
                    spans.append((i, close + len(f"-----END {kind}-----")))
    for i in range(n):  # addresses
        if text.startswith("://", i):
            user = next((j for j in range(i + 3, n) if text[j] in "/:@" or blank(j)), n)
            if user > i + 3 and text[user : user + 1] == ":":
                end = next((j for j in range(user + 1, n) if text[j] in "/@" or blank(j)), n)
                if end > user + 1 and text[end : end + 1] == "@":
                    spans.append((user + 1, end))
    names = ["password", "passwd", "passphrase", "pwd", "secret", "token", *(a + b + "key" for a in ("api", "access", "private") for b in ("_", "-", "")), "credentials", "credential", "bearer"]
    i = 0
    while i < n:  # values
        name = next((x for x in names if low.startswith(x, i)), None)
        j = i + len(name or "")
        i += 1
        if name is None:
            continue
        j += text[j : j + 1] in ("'", '"')
        k = j
        while blank(k) and k < j + 4:
            k += 1
        if text[k : k + 2] in ("=>", ":="):
            k += 2
        elif text[k : k + 1] in ("=", ":"):
            k += 1
        elif k == j:
            continue
        at = k
        while blank(k) and k < at + 4:
            k += 1
        quote = text[k : k + 1]
        if quote in ("'", '"') and quote:
            close = next((x for x in range(k + 1, n) if text[x] in (quote, "\n")), n)
            if close < n and text[close] == quote and close > k + 1:
                spans.append((k + 1, close))
                i = close + 1
            continue
        end = k
        if text[k : k + 1] in ("=", ":", ">"):
            continue
        while end < n and not blank(end) and text[end] not in "\"',;":
            end += 1
        if end > k:
            i = end
            while end > k and text[end - 1] in ".,;:!?)]}-":
                end -= 1
            if end > k:
                spans.append((k, end))
    i = 0
    while i < n:  # runs
        j = i
        while j < n and text[j].isascii() and (text[j].isalnum() or text[j] in "+/_=.~-"):
            j += 1
        if j - i >= least:
            end = j
            while end > i and text[end - 1] in ".-_~":
                end -= 1
            if end - i >= least:
                spans.append((i, end))
        i = max(j, i + 1)
    kept = []
    for a, b in sorted(spans, key=lambda x: x[0]):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b))
    return kept


def test_secrets_candidates_follow_the_plain_rules():
    r = random.Random(6)
    block = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\nabc+/=\n-----END RSA PRIVATE KEY-----"
    bits = [block, block[:60], "-----BEGIN PGP PRIVATE KEY BLOCK-----\nxx\n-----END PGP PRIVATE KEY BLOCK-----", "-----END RSA PRIVATE KEY-----", "-----BEGIN CERTIFICATE-----", "://user:pa$s@host/", "://user@", "://:x@", "password", "Api_Key", "secret_token", "privatekey", " = ", "=", ": ", "=>", " ", "\n", '"', "'", "hunter2!", "x", "é", ",", ".", "-", "abcdefghijklmnop", "0123456789abcdef", "==", "bearer "]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert secrets.candidates(text) == plain_candidates(text), repr(text)
    found = lambda t: [t[a:b] for a, b in secrets.candidates(t)]
    assert found('db password = "hunter2!" and postgres://app:s3cr3t!@db.host/x') == ["hunter2!", "s3cr3t!"] and found(f"so {block} end") == [block]


def test_secrets_scan(spark, odd, empty):
    key = hashlib.sha1(b"k").hexdigest()
    text = f'start token = "{key}" then sha256 {hashlib.sha256(b"x").hexdigest()} and areasonablylongwordhere.'
    docs = spark.createDataFrame([(1, text, "en", "src1", 1), (2, None, "en", None, 0)], DOCS)
    found = {r["start"]: r for r in secrets.secret_scan(docs).collect()}
    assert set(found) == {a for a, _ in plain_candidates(text)} and len(found) == 3
    hit = found[text.index(key)]
    assert hit["is_secret"] == 1 and hit["sha256"] == hashlib.sha256(key.encode()).hexdigest()
    assert sum(r["is_secret"] for r in found.values()) == 1
    want = [(r["doc_id"], a, b) for r in odd.collect() for a, b in plain_candidates(r["text"] or "")]
    got = secrets.secret_scan(clashing(odd)).select("doc_id", "start", "stop").collect()
    assert Counter(map(tuple, got)) == Counter(want) and secrets.secret_scan(empty).count() == 0


# 2 ----------------------------------------------------------------------------------------------
def plain_line_dedup(rows, ratio, least):
    pages, held = Counter(), Counter()
    for host, text in rows:
        pages[host] += 1
        held.update({(host, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")} if text is not None else set())
    drop = {k for k, n in held.items() if n >= least and n > ratio * pages[k[0]]}
    return [(h, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in drop)) for h, t in rows]


def test_line_dedup(spark, odd, empty):
    r = random.Random(3)
    rows = []
    for k in range(300):
        host = r.choice(["h1", "h1", "h2", None])
        lines = ["menu", f"own {k}", " footer ", "", f"rare {k % 40}"]
        rows.append((k, host, None if k % 50 == 0 else "\n".join(x for x in lines if r.random() < 0.8)))
    docs = spark.createDataFrame([(k, t, "en", h, 1) for k, h, t in rows], DOCS).repartition(4)
    got = linededup.drop_boilerplate(clashing(docs), "doc_id", "source", "text", ratio=0.3, min_pages=3)
    have = {x["doc_id"]: x["text"] for x in got.collect()}
    want = plain_line_dedup([(h, t) for _, h, t in rows], 0.3, 3)
    assert have == {k: t for (k, _, _), (_, t) in zip(rows, want, strict=True)} and any("menu" in (t or "") for _, _, t in rows)
    assert set(got.columns) == {*clashing(docs).columns, "lines_dropped"} and got.select("lines_in", "_lines").distinct().first() == ("extra", "extra")
    assert linededup.drop_boilerplate(odd, "doc_id", "source", "text").count() == odd.count()
    assert linededup.drop_boilerplate(empty, "doc_id", "source", "text").count() == 0


def test_line_dedup_counts_whole_copies_once(spark, odd, empty):
    """A text that holds a third of a source's rows stays; lines that different texts share go."""
    import corpus_pipeline as pipeline

    page = "a clean line\nand another"
    rows = [(k, page if k % 3 == 0 else f"own {k}\nfooter", "en", "s", 1) for k in range(90)]
    rows += [(100 + k, "few copies", "en", "t", 1) for k in range(3)] + [(200 + k, f"other {k}", "en", "t", 1) for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    have = {x["doc_id"]: x["text"] for x in pipeline.line_dedup(spark, docs, "").collect()}
    assert have == {k: t.removesuffix("\nfooter") for k, t, *_ in rows}
    assert pipeline.line_dedup(spark, odd, "").count() == odd.count() and pipeline.line_dedup(spark, empty, "").count() == 0


def test_page_lines(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><!-- x --><p>a &amp; b</p><p>c<br>d <b>e</b></p></body></html>'
    pages = spark.createDataFrame([(1, "http://Ex.com:80/a?b", page), (2, None, None), (3, "nohost", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in linededup.page_line_dedup(pages).collect()}
    assert got[1]["text"] == "T\na & b\nc\nd e" and got[1]["host"] == "ex.com"
    assert (got[2]["text"], got[2]["host"], got[2]["lines_in"]) == (None, None, 0) and got[3]["host"] == ""


def test_page_text_is_linear(spark):
    """A megabyte of blanks, of line ends, of open brackets or of unclosed scripts takes no longer than other text."""
    import time

    odd_pages = [" " * 1_000_000, "\n" * 1_000_000, " \n" * 500_000, "<" * 1_000_000, "<p" * 500_000, "<script>" * 125_000, "<!--" * 250_000, "a" * 1_000_000, "x\ty " * 200_000 + "\n \t z"]
    pages = spark.createDataFrame([(k, h) for k, h in enumerate(odd_pages)], "page_id long, html string").repartition(1)
    pages.select(linededup.html_text("html")).first()
    began = time.perf_counter()
    got = {r["page_id"]: r["t"] for r in pages.select("page_id", linededup.html_text("html").alias("t")).collect()}
    assert time.perf_counter() - began < 9 * 2
    assert [got[k] for k in (0, 1, 2, 5, 6)] == [""] * 5 and got[7] == "a" * 1_000_000 and got[8] == ("x\ty " * 200_000).strip() + "\nz"


# 3 ----------------------------------------------------------------------------------------------
def test_best_fit_is_tightest():
    r = random.Random(2)
    sizes = sorted((r.randint(1, 60) for _ in range(400)), reverse=True)
    rooms, want = [], []
    for s in sizes:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= s]
        k = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(100)
        rooms[k] -= s
        want.append(k)
    assert sharding.best_fit(sizes, 100) == (want, len(rooms))


def check_shards(docs, got):
    text = lambda t: b"" if t is None else t.encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d["doc_id"], len(text(d["text"])) + 1, zlib.crc32(text(d["text"]))) for d in docs)
    slots, places = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        places[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots, places


def test_sharding(spark, odd, empty):
    slots, _ = check_shards(odd.collect(), sharding.shard_documents(clashing(odd)).collect())
    assert set(slots) <= set(range(8))
    r = random.Random(9)
    rows = [(k, "same text " * 3 if k % 3 == 0 else "w" * r.randint(0, 300), "en", "a", 1) for k in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    got = sharding.shard_documents(docs).collect()
    slots, places = check_shards(docs.collect(), got)
    assert all(len(p) == 1 for p in places.values()) and set(slots) == set(range(8))
    load = Counter()
    for x in got:
        load[x["shard"]] += x["size"]
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 8 + 400
    assert rows_of(sharding.shard_documents(docs.repartition(3))) == sorted(map(tuple, got), key=repr)
    bins = {x["shard"] for x in sharding.shard_documents(docs, capacity=40_000).collect()}
    assert len(bins) <= -(-sum(x["size"] for x in got) // 40_000) + 1
    assert sharding.shard_documents(empty).count() == 0


def test_groups_over_a_fair_share_leave_the_rest_even(spark):
    small = [20] * 1000
    for large in ([10_000], [15_000, 9_000], [10_000, 2_600]):
        sizes = np.array(small + large)
        where, _ = sharding.fewest_shards(sizes, 8)
        load = np.bincount(where, sizes, 8)
        alone = [x for x in large if x > 2_800] or large
        rest = sorted(load)[: 8 - len(alone)]
        assert sorted(load)[8 - len(alone) :] == sorted(alone) and rest[-1] - rest[0] <= 80 and load.sum() == sizes.sum()
    assert sharding.fewest_shards(np.array([5, 5]), 1)[0].tolist() == [0, 0] and len(sharding.fewest_shards(np.array([], np.int64), 8)[0]) == 0
    assert sorted(sharding.fewest_shards(np.array([9, 1, 1]), 8)[0]) == [0, 1, 2]
    rows = [(k, "same text " * 3 if k % 3 == 0 else f"{k:030}", "en", "a", 1) for k in range(3000)]
    load = Counter()
    for x in sharding.shard_documents(spark.createDataFrame(rows, DOCS)).collect():
        load[x["shard"]] += x["size"]
    *rest, large = sorted(load.values())
    assert large == 31_000 and len(rest) == 7 and rest[-1] - rest[0] < 0.02 * sum(rest) / 7


# 4 ----------------------------------------------------------------------------------------------
def test_warc(spark):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "http://a/\n9", "<p>é</p>"), (9, "u", "<p>é</p>"), (4, "u", None), (5, "u", ""), (None, "u", "q"), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_sha", F.lit(1)).repartition(3)
    got = warc.warc_round_trip(pages, keep_payload=True).collect()
    body = lambda h: (h or "").encode()
    keeper = {}
    for p, _, h in rows:
        keeper[body(h)] = max(keeper.get(body(h), -1), -1 if p is None else p)
    want = Counter()
    for p, _, h in rows:
        k = keeper[body(h)]
        again = p is not None and p != k
        want[p, len(body(h)), base64.b32encode(hashlib.sha1(body(h)).digest()).decode(), "revisit" if again else "response", k if again else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["verified"] == (r["record_type"] == "response") for r in got) and {r["payload"] for r in got if r["payload"] is not None} == {body(h) for _, _, h in rows}
    alone = warc.warc_round_trip(pages, min_bytes=100).collect()
    assert all(r["record_type"] == "response" for r in alone)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_archives_roll_and_bad_records_raise(spark):
    pages = spark.createDataFrame([(k, "u", f"page {k} " * 50) for k in range(200)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, roll_bytes=4000)
    assert manifest.count() > 5 and manifest.agg(F.sum("records")).first()[0] == 200
    assert warc.read_archives(spark, manifest, manifest._siftmark_folder).count() == 200
    record = zlib.decompress(warc.encode_record(1, "u", b"payload"), 31)
    assert warc.decode_record(record)["payload"] == b"payload"
    for bad in (record.replace(b"payload\r\n", b"pazload\r\n"), record[:-1], b"HTTP/1.1\r\n\r\n", record.replace(b"WARC/", b"KARC/")):
        with pytest.raises(ValueError):
            warc.decode_record(bad)

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:7], self.data[7:]
            return out

    two = warc.encode_record(1, "u", b"a" * 1000) + warc.encode_record(2, "u", b"")
    assert [warc.decode_record(m)["page_id"] for m in warc.members(Stream(two))] == [1, 2]
    with pytest.raises(ValueError):
        list(warc.members(Stream(two[:-3])))


# 5 ----------------------------------------------------------------------------------------------
def plain_top(vectors, k, every):
    q = {i: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v] for i, v in vectors}
    out = []
    for i, v in q.items():
        if i % every == 0:
            score = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q.items() if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(score[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in r.normal(0, 0.2, 8 if i != 30 else 5)]) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(20)] + [(500, [0.0] * 8), (600, [5.0, -5.0] * 4)]
    rows = [*vectors, (1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (None, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("v", F.lit(0)).repartition(4)
    got = topk.top_k(table, k=10, every=20).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == plain_top(vectors, 10, 20)
    few = [(0, [1.0]), (100, [2.0])]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect())) == plain_top(few, 10, 100)
    assert topk.top_k(table.limit(0)).count() == 0
    asked = spark.createDataFrame([(5, [float(x) for x in r.normal(0, 1, 8)])], "vec_id long, embedding array<float>")
    assert topk.top_k(table, asked).count() == 10


def test_top_k_of_huge_components(spark, monkeypatch):
    """Scaled values and scores beyond 64 bits are the largest or smallest long; chunks of a few queries agree."""
    monkeypatch.setattr(topk, "CHUNK_BYTES", 40)
    vectors = [(0, [1e300, 1.0]), (100, [-1e300, 2.0]), (200, [3.0, 4.0]), (7, [1e15, -1e15]), (8, [-1e300, -1e300]), (9, [0.0, 0.0])]
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    q = {i: [clip(int(1024 * np.float64(x))) for x in v] for i, v in vectors}
    want = []
    for i in (0, 100, 200):
        score = sorted((-clip(sum(a * b for a, b in zip(q[i], w))), j) for j, w in q.items() if j != i)
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(score[:3], 1)]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=3)
    assert sorted(map(tuple, got.collect())) == want


def test_bit_slices_add_like_numbers():
    r = np.random.default_rng(1)
    x, w = r.integers(0, 50, (128, 6)), r.integers(-40, 40, 6)
    for weight in range(-70, 70):
        assert sum(sign << shift if sign > 0 else -(1 << shift) for shift, sign in topk._digits(weight)) == weight
    adder = topk.Adder(2)
    constant = 0
    for d in range(6):
        for shift, sign in topk._digits(int(w[d])):
            for b in range(6):
                plane = np.packbits((x[:, d] >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64)
                adder.add(shift + b, plane if sign > 0 else ~plane)
                constant += 0 if sign > 0 else 1 << (shift + b)
    slices = adder.total()
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(np.int64) << k for k, s in enumerate(slices))
    assert (total - constant == x @ w).all()
    everyone = np.full(2, ~np.uint64(0))
    for k in (1, 5, 128):
        kth = topk.kth_largest(slices, everyone, k)
        assert kth == sorted(total)[-k]
        assert np.unpackbits(topk.at_least(slices, everyone, kth).view(np.uint8), bitorder="little").tolist() == (total >= kth).astype(int).tolist()


# 6 ----------------------------------------------------------------------------------------------
def test_media_round_trip(spark, odd, empty):
    got = media.media_round_trip(clashing(odd)).collect()
    seen = {}
    for r, d in zip(sorted(got, key=lambda r: (r["doc_id"] or -1, r["payload_sha256"])), sorted(odd.collect(), key=lambda d: (d["doc_id"] or -1, "")), strict=True):
        assert r["doc_id"] == d["doc_id"]
    by_sha = {}
    for d in odd.collect():
        data = (d["text"] or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        by_sha[hashlib.sha256(padded).hexdigest()] = (len(data), len(padded), zlib.crc32(padded[-64:]))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"])[1:] == by_sha[r["payload_sha256"]][1:]
        same = seen.setdefault((r["payload_sha256"], r["n_bytes"]), (r["media_bytes"], r["media_sha256"], r["feature"]))
        assert same == (r["media_bytes"], r["media_sha256"], r["feature"])
    assert media.media_round_trip(empty).count() == 0
    clips = media.media_clips(media.encode_media(odd))
    assert clips.filter("doc_id = 5").count() >= 1


def test_every_byte_survives_and_shots_are_found():
    r = np.random.default_rng(0)
    for data in (bytes(range(256)) * 64, r.integers(0, 256, 64 * 131, dtype=np.uint8).tobytes(), bytes(64), b"\xff" * 640):
        payload, clip, frames = media.read_avi(media.encode_avi(data))
        assert payload == data and clip.width == 512 and clip.fps == 25
        assert frames[0].shape[1] == 64 and len(media.encode_avi(data)) < 1.6 * len(data) + 1000
    scenes = np.concatenate([r.integers(0, 20, 4096 * 5), r.integers(200, 220, 4096 * 4), r.integers(90, 110, 4096 * 3)]).astype(np.uint8)
    _, clip, frames = media.read_avi(media.encode_avi(scenes.tobytes()))
    assert [(a, b) for a, b, _ in media.shots(frames)] == [(0, 5), (5, 9), (9, 12)]
    for bad in (b"RIFF", media.encode_avi(bytes(64)).replace(b"\xff\xc0", b"\xff\xc2"), media.encode_avi(bytes(64))[:300]):
        with pytest.raises((ValueError, KeyError, struct.error)):
            media.read_avi(bad)


def test_general_jpeg_path_agrees():
    """The block-constant frames through the bit-by-bit decoder."""
    data = bytes(random.Random(1).randrange(256) for _ in range(64 * 4))
    jpeg = media.parse_avi(media.encode_avi(data)).frames[0]
    fast, _ = media.decode_frame(jpeg)
    scan = jpeg[jpeg.index(b"\xff\xda") + 10 : jpeg.rindex(b"\xff\xd9")]
    quant = {0: np.array([8] + [1] * 63)}
    huff = {0: media._codes(bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))), 0x10: media._codes(bytes([1] + [0] * 15), b"\0")}
    slow, pixels = media._decode_general(scan, 8 * 4, 512, [(1, 0x11, 0)], quant, huff, {1: 0}, 0)
    assert (slow == fast).all() and (pixels[::8, ::8] == fast).all() and pixels.shape == (32, 512)
    assert media.zigzag()[:6] == [0, 1, 8, 16, 9, 2] and sorted(media.zigzag()) == list(range(64))


class JpegWriter:
    """A baseline JPEG of given quantised coefficients: several components, AC codes, restarts; Huffman tables as usual, or left out."""

    def __init__(self, width, height, sampling, quant, restart, tables):
        self.size, self.sampling, self.quant, self.restart, self.tables = (width, height), sampling, quant, restart, tables
        self.codes = {}
        for number, (counts, symbols) in media.USUAL_TABLES.items():
            code, k, mine = 0, 0, {}
            for n in range(16):
                for _ in range(counts[n]):
                    mine[symbols[k]] = format(code, f"0{n + 1}b")
                    code, k = code + 1, k + 1
                code *= 2
            self.codes[number] = mine

    @staticmethod
    def number(x):
        n = abs(x).bit_length()
        return n, "" if not n else format(x if x > 0 else x + (1 << n) - 1, f"0{n}b")

    def block(self, c, before, table):
        n, bits = self.number(c[0] - before)
        out, run = self.codes[table][n] + bits, 0
        last = max((k for k in range(64) if c[k]), default=0)
        for k in range(1, last + 1):
            if not c[k]:
                run += 1
                continue
            while run > 15:
                out, run = out + self.codes[0x10 | table][0xF0], run - 16
            n, bits = self.number(c[k])
            out, run = out + self.codes[0x10 | table][16 * run + n] + bits, 0
        return out + ("" if last == 63 else self.codes[0x10 | table][0])

    def write(self, blocks):
        """blocks[part][y, x]: 64 numbers in zigzag order."""
        w, h = self.size
        most = max(a for a, _ in self.sampling), max(b for _, b in self.sampling)
        wide, tall = -(-w // (8 * most[0])), -(-h // (8 * most[1]))
        data, bits, before = b"", "", [0] * len(blocks)
        flush = lambda bits: bytes(int(bits[k : k + 8].ljust(8, "1"), 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        for unit in range(wide * tall):
            if self.restart and unit and unit % self.restart == 0:
                data, bits, before = data + flush(bits) + bytes([0xFF, 0xD0 + (unit // self.restart - 1) % 8]), "", [0] * len(blocks)
            for part, (a, b) in enumerate(self.sampling):
                for cell in range(a * b):
                    c = blocks[part][unit // wide * b + cell // a, unit % wide * a + cell % a]
                    bits += self.block([int(v) for v in c], before[part], min(part, 1))
                    before[part] = int(c[0])
        data += flush(bits)
        segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
        out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes(self.quant))
        out += segment(0xC0, struct.pack(">BHHB", 8, h, w, len(blocks)) + b"".join(bytes([k, a << 4 | b, 0]) for k, (a, b) in enumerate(self.sampling)))
        if self.tables:
            out += b"".join(segment(0xC4, bytes([k]) + counts + symbols) for k, (counts, symbols) in media.USUAL_TABLES.items())
        if self.restart:
            out += segment(0xDD, struct.pack(">H", self.restart))
        scan = bytes([len(blocks)]) + b"".join(bytes([k, 0x11 * min(k, 1)]) for k in range(len(blocks))) + bytes([0, 63, 0])
        return out + segment(0xDA, scan) + data + b"\xff\xd9"


@pytest.mark.parametrize("sampling,restart,tables", [([(1, 1)], 0, True), ([(2, 2), (1, 1), (1, 1)], 0, False), ([(2, 1), (1, 1), (1, 1)], 2, True), ([(1, 1)], 3, False)])
def test_foreign_frames_decode(sampling, restart, tables):
    """Colour frames with AC coefficients and restarts against a cosine transform written out; tables may be missing."""
    r = np.random.default_rng(restart + len(sampling))
    width, height = 40, 24
    most = max(a for a, _ in sampling), max(b for _, b in sampling)
    wide, tall = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    quant = [int(q) for q in r.integers(1, 12, 64)]
    blocks = []
    for a, b in sampling:
        c = r.integers(-6, 7, (tall * b, wide * a, 64)) * (r.random((tall * b, wide * a, 64)) < 0.2)
        c[..., 0] = r.integers(-60, 60, c.shape[:2])
        c[0, 0, 63] = 5
        blocks.append(c)
    jpeg = JpegWriter(width, height, sampling, quant, restart, tables).write(blocks)
    means, pixels = media.decode_frame(jpeg)
    zigzag = media.zigzag()
    for y in range(0, height, 5):
        for x in range(0, width, 3):
            total = 0.0
            for k in range(64):
                v, u = divmod(zigzag[k], 8)
                scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                total += scale * blocks[0][y // 8, x // 8, k] * quant[k] * np.cos((2 * (x % 8) + 1) * u * np.pi / 16) * np.cos((2 * (y % 8) + 1) * v * np.pi / 16)
            assert abs(int(pixels[y, x]) - min(255, max(0, total + 128))) <= 0.51
    assert pixels.shape == (height, width) and means.shape == (3, 5)


def test_broken_media_are_rows_of_their_own(spark):
    good = media.encode_avi(bytes(range(256)) * 40)
    rows = [(1, good), (2, b"RIFF"), (3, good[:700]), (4, None), (None, good.replace(b"\xff\xc0", b"\xff\xc2")), (5, b"")]
    got = media.media_clips(spark.createDataFrame([(k, None if m is None else bytearray(m)) for k, m in rows], "doc_id long, media binary")).collect()
    assert {(r["doc_id"], r["clip"], r["error"] is None) for r in got} == {(1, 0, True), (2, None, False), (3, None, False), (None, None, False), (5, None, False)}


# 7 ----------------------------------------------------------------------------------------------
def plain_targets(sizes, share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        full |= above


def test_mixing(spark, odd, empty):
    r = random.Random(8)
    rows = [(k, " ".join("w" * r.randint(1, 300 if k % 9 == 0 else 20)), "en", r.choice(["hot"] * 6 + ["b", "c", "é", "🙂", None, "tiny"][: 1 + k % 6]), 1) for k in range(4000)]
    for docs in (spark.createDataFrame(rows, DOCS).repartition(5), odd):
        got = mixing.mix(clashing(docs)).collect()
        sizes, taken = Counter(), Counter()
        for d in docs.collect():
            sizes[d["source"]] += len(words_of(d["text"]))
        want = plain_targets(dict(sizes))
        longest = defaultdict(int)
        for x in got:
            assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]]) and x["taken"] <= 2 * x["size"]
            assert x["taken"] == x["copies"] * x["size"]
            taken[x["source"]] += x["taken"]
            longest[x["source"]] = max(longest[x["source"]], x["size"])
        assert len(got) == docs.count()
        for s, t in want.items():
            assert abs(taken[s] - t) <= longest[s]
        assert rows_of(mixing.mix(docs.repartition(2))) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(empty).count() == 0
    copies = {x["doc_id"]: x["copies"] for x in mixing.mix(docs).collect()}
    assert Counter(x["doc_id"] for x in mixing.mixed_documents(clashing(docs)).filter("doc_id >= 100").collect()) == Counter({k: c for k, c in copies.items() if k is not None and k >= 100 and c})


def test_mix_gives_no_document_without_words(spark):
    rows = [(k, " ".join("w" * (k % 7)), "en", "ab"[k % 2], 1) for k in range(300)] + [(400, " \t\n", "en", "a", 1), (401, None, "en", "b", 1), (1, "", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert mixing.mix(docs).filter("size = 0").count() and not mixing.mix(docs).filter("size = 0 and copies > 0").count()
    got = mixing.mixed_documents(docs).collect()
    assert got and all(words_of(x["text"]) for x in got)


def plain_mix(rows, share=1.5, most=2.0, damping=0.25):
    """Words taken of each source and copies of each (doc_id, text), by sorting whole sources."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words_of(text))
    targets, copies = plain_targets(dict(sizes)), Counter()
    for source, target in targets.items():
        mine = [(i, t, len(words_of(t))) for i, t, s in rows if s == source and words_of(t)]
        share_of = lambda n, level: min(most, level * 2 ** (-damping * (n.bit_length() - 1)))
        low, high = 0.0, 1e6
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(n * share_of(n, level) for *_, n in mine) < target else (low, level)
        expected = {n: round(share_of(n, high), 9) for *_, n in mine}
        goal, drawn = target - sum(n * int(expected[n]) for *_, n in mine), []
        for i, t, n in mine:
            copies[i, t] += int(expected[n])
            chance = expected[n] - int(expected[n])
            if chance > 0:
                u = (int(hashlib.md5(f"{'' if i is None else i}:mix:{t}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                drawn.append((u / (1 - u) / (chance / (1 - chance)), i, t, n))
        upto = 0
        for _, i, t, n in sorted(drawn, key=lambda d: d[0]):
            upto += n
            copies[i, t] += upto - n / 2 <= goal
    return targets, +copies


def test_mixed_documents_are_those_the_mix_takes(spark):
    """Null ids, ids on several texts, and rows that repeat id and text: a third of all are one."""
    r = random.Random(12)
    rows = [(None if k % 2 else k % 40, " ".join(["w"] * r.randint(1, 60)) + f" {k % 97}", "b" if k % 40 == 0 else r.choice(["a", "c", None])) for k in range(1200)]
    rows += [(None, "hot text " * 4, "b")] * 600
    docs = spark.createDataFrame([(i, t, "en" if k % 3 else "de", s, k % 5) for k, (i, t, s) in enumerate(rows)], DOCS).repartition(4)
    taken = defaultdict(int)
    found = mixing.mix(docs).collect()
    for x in found:
        taken[x["source"]] += x["taken"]
    emitted, copies = defaultdict(int), Counter()
    kept = mixing.mixed_documents(clashing(docs))
    for x in kept.collect():
        emitted[x["source"]] += len(words_of(x["text"]))
        copies[x["doc_id"], x["text"]] += 1
    targets, want = plain_mix(rows)
    assert emitted == taken and copies == want and kept.columns == clashing(docs).columns and len(found) == len(rows)
    assert all(abs(taken[s] - t) <= 61 for s, t in targets.items()) and 600 < copies[None, "hot text " * 4] < 1200


# 8 ----------------------------------------------------------------------------------------------
def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(clashing(odd), tokenizer_path(), capacity=512).collect()
    want, total = Counter(), 0
    for d in odd.collect():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[d["doc_id"], k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
    assert len(spans) <= -(-total // 512) + 1 and packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_ids_are_those_of_whole_texts():
    """Signs after letters whose lower case is longer, marks, every blank; and tokenizers of another kind."""
    from tokenizers import Tokenizer

    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff"]
    letters = [*"abzABZ059'!.,<|>-_#", "\u0130", "ß", "é", "\u0301", "\u0307", "Σ", "ς", "ǅ", "ﬁ", "中", "\u1100", "\u1161", "\u212b", "\u212a", "𐐀", "🙂", "٣", "½", "'s", "'RE", "<|endoftext|>", "<|", "|>", "ʰ"]
    r = random.Random(3)
    texts = ["".join(r.choice(blanks if r.random() < 0.15 else letters) if r.random() < 0.8 else " " for _ in range(r.randint(1, 30))) for _ in range(15_000)]
    for name, kind in (("word_bpe_49k.json", packing.WordIds), ("byte_bpe_50k.json", packing.WholeIds)):
        words, tokenizer = packing.worker_words(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
        assert type(words) is kind
        assert [t for t in texts if np.frombuffer(words.ids(t), "<u4").tolist() != tokenizer.encode(t, add_special_tokens=False).ids] == []


def test_no_task_packs_more_than_its_bound(spark, monkeypatch):
    """Lengths that never fill a bin reopen most bins; rows that repeat are dealt apart."""
    seen, packed = [], packing._packed
    monkeypatch.setattr(packing, "_packed", lambda groups, *a: (out := packed(groups, *a), seen.append(out))[0])
    r = random.Random(2)
    rows = [(None if k % 3 == 0 else k, 0, 0, 800 if k % 3 == 0 else r.randint(750, 850), 7) for k in range(9000)]
    pieces = stored(spark.createDataFrame(rows, packing.PIECES), "p")
    got = packing.pack_pieces(pieces, per_partition=1000).collect()
    assert len(got) == 9000 and 2 <= len(seen) < 13
    assert all(max(x["count"] for x in out.groupBy("part").count().collect()) <= 1000 for out in seen)
    fill = Counter()
    for x in got:
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= 1.01 * packing.best_fit_decreasing(np.array([x[3] for x in rows]), 4096)[1] + 1


def test_packing_exchanges_between_partitions(spark):
    r = random.Random(6)
    rows = [(k, 0, 0, r.choice([700, 900, 1365, 1366, 2049, 3000, 4096, r.randint(1, 4096)]), k) for k in range(3000)]
    pieces = stored(spark.createDataFrame(rows, packing.PIECES), "p")
    got = packing.pack_pieces(pieces, per_partition=200).collect()
    fill = Counter()
    for x in got:
        fill[x["sequence_id"]] += x["length"]
    lengths = np.array([x[3] for x in rows])
    assert len(got) == 3000 and max(fill.values()) <= 4096
    whole, bins = packing.best_fit_decreasing(lengths, 4096)
    assert packing.lower_bound(lengths, 4096) <= len(fill) <= 1.01 * bins + 1


def test_lower_bounds_hold():
    r = random.Random(7)
    for _ in range(200):
        lengths = np.array([r.randint(1, 12) for _ in range(r.randint(1, 9))])

        def fewest(items, rooms):
            if not items:
                return len(rooms)
            best = fewest(items[1:], [*rooms, 12 - items[0]])
            for k, room in enumerate(rooms):
                if room >= items[0]:
                    best = min(best, fewest(items[1:], rooms[:k] + [room - items[0]] + rooms[k + 1 :]))
            return best

        real = fewest(sorted(lengths.tolist(), reverse=True), []) if len(lengths) < 8 else packing.best_fit_decreasing(lengths, 12)[1]
        assert packing.lower_bound(lengths, 12) <= real
    assert packing.lower_bound(np.array([2049, 2049, 2049]), 4096) == 3


# 9 ----------------------------------------------------------------------------------------------
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_components(docs, k, num, den):
    sets = []
    for i, t in docs:
        w = words_of((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                parent[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        root = find(a)
        low[root] = min((v for v in (low.get(root), i) if v is not None), default=None)
    return Counter((i, len(s), low[find(a)]) for a, (i, s) in enumerate(sets))


def near_copies(seed, groups, sizes, edits):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, k = [], 0
    for g in range(groups):
        base = [word() for _ in range(r.choice(sizes))]
        for _ in range(r.randint(1, 12)):
            text = base[:]
            for _ in range(int(len(base) * r.random() * edits)):
                text[r.randrange(len(text))] = word()
            rows.append((k * 7 % 10_007, " ".join(text)))
            k += 1
    return rows


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard(spark, odd, k, num, den):
    rows = near_copies(k, 60, [1, 3, 6, 8, 12, 20, 40, 90, 200], 0.08) + [(r["doc_id"], r["text"]) for r in odd.collect()]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS).repartition(5)
    got = jaccard.jaccard_components(clashing(docs), words=k, num=num, den=den)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == plain_components(rows, k, num, den)


@pytest.mark.parametrize("salted", [False, True])
def test_jaccard_dense_group(spark, monkeypatch, salted):
    """Many copies round the threshold: the draws, the rounds and the blocks all have work."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4096)
    if salted:  # every fingerprint of more than a few classes is dealt to salts
        for name, value in (("SAMPLE", 2), ("SAMPLED", 3), ("SALT_CLASSES", 20)):
            monkeypatch.setattr(jaccard, name, value)
        bands, docs = jaccard.Bands(85, 100), spark.createDataFrame([(" ".join(f"w{j}" for j in range(60)) + f" {i}",) for i in range(300)], "text string")
        assert max(jaccard._hot_keys(docs, 4, bands).values()) > 10
    r = random.Random(1)
    base = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    rows = []
    for i in range(250):
        text = base[:]
        for _ in range(r.randint(0, 5)):
            text[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS).repartition(3)
    got = jaccard.jaccard_components(docs, words=4, num=85, den=100)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == plain_components(rows, 4, 85, 100)


def test_pieces_never_miss():
    """Two sets within the bound share a key, whatever falls on empty pieces."""
    r = random.Random(4)
    for num, den in ((85, 100), (4, 5), (1, 2)):
        bands = jaccard.Bands(num, den)
        for _ in range(400):
            n = r.choice([6, 7, 9, 12, 13, 14, 20, 22, 23, 60, 150, 400])
            whole = [r.getrandbits(64) for _ in range(n)]
            cut = r.randint(0, n)
            x, y = np.unique(np.array(whole, np.uint64)), np.unique(np.array(whole[cut // 2 :] + [r.getrandbits(64) for _ in range(r.randint(0, n // 4))], np.uint64))
            both = len(np.intersect1d(x, y))
            if len(x) + len(y) - 2 * both and den * both >= num * (len(x) + len(y) - both):
                assert len(np.intersect1d(jaccard.piece_keys(x, bands), jaccard.piece_keys(y, bands)))
                sx, sy = jaccard.sketch(x), jaccard.sketch(y)
                size = min(len(sx), len(sy))
                apart = np.bitwise_count(jaccard.folded(sx, size).view(np.uint64) ^ jaccard.folded(sy, size).view(np.uint64)).sum()
                assert apart <= len(x) + len(y) - 2 * both <= bands.bound(len(x) + len(y))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 102), (102, 101)]
    ids = [*range(0, 42), *range(100, 105)]
    got = components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["comp"] for r in got.collect()} == {i: 0 if i <= 40 else 41 if i == 41 else 100 if i < 104 else 104 for i in ids}


def test_near_duplicates_leave_one_each(spark, odd, empty):
    kept = jaccard.drop_near_duplicates(clashing(odd), words=5, num=4, den=5)
    found = jaccard.jaccard_components(odd).collect()
    want = {r["component_id"] for r in found if r["doc_id"] is not None}
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(want) and kept.columns == clashing(odd).columns
    assert kept.filter("doc_id is null").count() == 1 and jaccard.drop_near_duplicates(empty).count() == 0


def test_null_and_repeated_ids_link_like_others(spark):
    """A text that only null ids hold bridges two others; ids that repeat hold texts of their own."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(100)]
    a, b, c = ([f"x{j}" for j in range(n)] + base[n:] for n in (0, 6, 12))  # a and c are too far apart
    other, clean, alone = ([word() for _ in range(50)] for _ in range(3))
    rows = [(1, a), (None, b), (2, c), (None, other), (None, other), (None, [*other, "end"]), (3, a), (3, clean), (3, clean), (4, other[1:]), (5, []), (None, []), (None, []), (None, alone), (None, alone)]
    rows = [(i, " ".join(t)) for i, t in rows]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS).repartition(3)
    got = jaccard.jaccard_components(clashing(docs), words=5, num=4, den=5)
    have = Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()))
    assert have == plain_components(rows, 5, 4, 5) and have[2, 96, 1] == 1
    kept = jaccard.drop_near_duplicates(clashing(docs)).select("doc_id", "text").collect()
    text = " ".join
    assert Counter(map(tuple, kept)) == Counter([(1, text(a)), (3, text(clean)), (4, text(other[1:])), (5, ""), (None, ""), (None, ""), (None, text(alone))])


def test_near_duplicates_of_rows_that_repeat_very_often(spark):
    """A third of all rows is one id and text, another third a null id and one text: one row of each stays."""
    rows = [(7, f"one text that repeats {'x ' * 5}", "en", "a", k % 4) for k in range(150)] + [(None, f"another that has no id {'y ' * 5}", "en", "b", k % 4) for k in range(150)]
    rows += [(k, f"own words {k} {k + 1} {k + 2} {k + 3} {k + 4}", "en", "c", 1) for k in range(100, 200)] + [(150, f"own words {150} {151} {152} {153} {154}", "en", "d", 2)]
    kept = jaccard.drop_near_duplicates(clashing(spark.createDataFrame(rows, DOCS).repartition(5))).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter({(i, t) for i, t, *_ in rows})


# 10 ---------------------------------------------------------------------------------------------
def toxic_rows(n, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["na", "ve", "lo", "mi"]) + r.choice(["ra", "to", "si"]) + r.choice(["n", "s", ""])
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        text = [word() for _ in range(r.randint(5, 120))]
        if toxic:
            for _ in range(2):
                text.insert(r.randrange(len(text)), r.choice(["moron", "scum", "zzqax" + word(), "Idiot!"]))
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rows, labels = toxic_rows(3000, 1)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    right = sum(got[i]["predicted"] == labels[i][2] for i in held) / len(held)
    assert right > 0.98 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert rows_of(toxicity.toxicity(docs, flipped)) == sorted((tuple(r) for r in got.values()), key=repr)
    assert toxicity.toxicity(clashing(odd), marks).count() == odd.count()
    clean = toxicity.drop_toxic(docs, marks)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["predicted"]}
    none = marks.limit(0)
    assert max(r["score"] for r in toxicity.toxicity(odd, none).collect()) < 1e-12
    assert toxicity.toxicity(empty, marks).count() == 0


def test_machine_learns_a_pair():
    """Label 1 only where two terms meet: weights alone can't tell."""
    r = random.Random(3)
    known, rows, labels = toxicity.TermIds(), [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(known.of(" ".join(["fill", "er"] + ["group"] * a + ["insult"] * b)))
        labels.append(int(a and b))
    m = toxicity.fit(rows, np.array(labels))
    score = lambda t: m.score(known.of(t))
    assert score("filler group insult") > 0.9 > 0.2 > max(score("filler group"), score("filler insult"))
    plain = m.bias + sum(m.weights[i] for i in range(len(m.terms)) if m.terms[i] in known.of("group insult"))
    v = m.factors[np.isin(m.terms, known.of("group insult"))]
    pairs = sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i))
    assert score("group insult") == pytest.approx(1 / (1 + np.exp(-(plain + pairs))), rel=1e-4)


def test_machine_learns_a_pair_whose_terms_are_clean_or_mild():
    """Label 1 by a slur, or where an insult meets a group: the group alone is clean, the insult alone mild."""
    r = random.Random(4)
    known, rows, labels = toxicity.TermIds(), [], []
    fill = ["la", "na", "ve", "to", "mi", "ra", "si", "zu"]
    for _ in range(6000):
        slur, insult, group = r.random() < 0.05, r.random() < 0.1, r.random() < 0.2
        if r.random() < 0.3:
            group = not (slur or insult)  # groups are named in clean texts more than elsewhere
        words = r.sample(fill, 4) + ["slurword"] * slur + ["dolt"] * insult + ["folk"] * group
        rows.append(known.of(" ".join(r.sample(words, len(words)))))
        labels.append(int(slur or (insult and group) or (insult and r.random() < 0.1)))
    m = toxicity.fit(rows, np.array(labels))
    score = lambda t: m.score(known.of(t))
    assert score("la ve dolt folk mi") > 0.7 and score("slurword na") > 0.7
    assert score("la ve folk mi") < 0.1 and score("la ve dolt mi") < 0.5 and score("la ve mi") < 0.1 and score("") < 0.1


def test_training_is_bounded_and_takes_one_row_an_id(spark):
    rows, labels = toxic_rows(600, 2)
    docs = spark.createDataFrame(rows + [(5, "again " * 40, "en", "a", 1)] * 50, DOCS).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda ids, y: seen.append((ids, y)) or fit(ids, y)
    try:
        toxicity.train(docs, marks, max_rows=300)
        toxicity.train(docs, marks, max_ids=2000)
    finally:
        toxicity.fit = fit
    assert len(seen[0][0]) == 300 == len(seen[0][1]) and sum(map(len, seen[1][0])) <= 2000 and len(seen[1][0]) > 5
    assert toxicity.train(docs, marks).score(np.empty(0, np.int32)) < 0.5


def test_tidy_hands_every_batch_on(spark):
    rows = spark.range(0, 1000, numPartitions=4)
    out = rows.mapInArrow(tidy(lambda batches: iter(batches)), "id long")
    assert sorted(r["id"] for r in out.collect()) == list(range(1000))
    assert rows.limit(0).mapInArrow(tidy(lambda batches: iter(batches)), "id long").count() == 0
