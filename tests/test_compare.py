"""Every module on the two-payload cases, run as one batch of pairs."""

import json
import math

import pytest

from siftmark import cli
from siftmark.operators import bytediff, entropy, fileformat, fuzzy, patterns
from siftmark.options import MODULES, CompareOptions, parse_modules
from siftmark.plans.compare import compare, overall, results, scores
from siftmark.plans.report import check_json, modules_of, rendered, text_bar, to_json, write_reports
from siftmark.sources.images import image_info, images_from_bytes, load_images, pairs_from, size_warnings
from tests.payloads import minimal_elf, minimal_pe, pseudo, seeded


def frames(spark, cases):
    """cases: {pair: (bytes, bytes)} -> images, pairs"""
    payloads = {f"{k}/{s}.bin": v for k, ab in cases.items() for s, v in zip("ab", ab, strict=True)}
    return images_from_bytes(spark, payloads), pairs_from(spark, [(k, f"{k}/a.bin", f"{k}/b.bin") for k in cases])


def run(spark, section, cases, opts=None):
    images, pairs = frames(spark, cases)
    return {r["pair_id"]: r.asDict(recursive=True) for r in section(images, pairs, opts or CompareOptions()).collect()}


def test_bytediff(spark):
    p = pseudo(80_000, 42)
    r = run(spark, bytediff.section, {
        "same": (pseudo(50_000, 1), pseudo(50_000, 1)), "other": (pseudo(50_000, 100), pseudo(50_000, 999)), "one": (pseudo(10_000, 7), b""),
        "none": (b"", b""), "tiny": (b"\1\2\3", b"\1\2\3"), "shift": (p, b"\xde\xad\xbe\xef\0" + p),
    })
    s = r["same"]
    assert s["similarity_percent"] == 100 and s["cosine_percent"] == pytest.approx(100) and s["only_a"] == s["only_b"] == 0 and s["total_a"] > 1
    assert all(x["shared"] for x in s["map_a"] + s["map_b"]) and sum(x["length"] for x in s["map_a"]) == 50_000
    assert [x["offset"] for x in s["map_a"]] == sorted(x["offset"] for x in s["map_a"])
    assert r["other"]["similarity_percent"] < 5 and r["other"]["common"] == 0
    assert r["one"]["similarity_percent"] == 0 and r["one"]["cosine_percent"] == 0
    assert (r["none"]["similarity_percent"], r["none"]["cosine_percent"], r["none"]["map_a"], r["none"]["total_a"]) == (100, 100, [], 0)
    assert r["tiny"]["similarity_percent"] == 100 and r["tiny"]["total_a"] == 1
    assert r["shift"]["similarity_percent"] == pytest.approx(93.10, abs=0.01) and r["shift"]["total_a"] == 28


def test_fuzzy(spark):
    r = run(spark, fuzzy.section, {
        "same": (seeded(4096, 42), seeded(4096, 42)), "other": (seeded(4096, 1), seeded(4096, 999)), "none": (b"", b""), "one": (seeded(1024, 7), b""),
        "tiny": (b"\x4d\x5a\x90", b"\x4d\x5a\x90"), "append": (seeded(8192, 123), seeded(8192, 123) + seeded(256, 55)), "range": (seeded(2000, 3), seeded(2000, 4)),
    })
    assert r["same"]["minhash_percent"] == 100 and r["same"]["ctph_percent"] >= 99 and r["same"]["digest_a"] == r["same"]["digest_b"]
    assert r["other"]["minhash_percent"] < 20 and r["other"]["ctph_percent"] < 50
    assert (r["none"]["minhash_percent"], r["none"]["ctph_percent"], r["none"]["digest_a"]) == (100, 100, "0::")
    assert (r["one"]["minhash_percent"], r["one"]["ctph_percent"], r["one"]["digest_b"]) == (0, 0, "0::") and r["one"]["digest_a"] != "0::"
    assert r["tiny"]["minhash_percent"] == 100 and r["append"]["minhash_percent"] >= 90
    assert 0 <= r["range"]["similarity_percent"] <= 100 and r["range"]["shingle_k"] == 8


def test_numbers_are_written_by_their_exact_values(spark):
    from pyspark.sql import functions as F

    from siftmark.functions.expressions import fixed_text, number_text, percent_text

    ties = [(2 * k + 1) / n for n in (200, 2000) for k in (*range(0, 3000, 7), 9999, 99_999, 10**6)]
    values = [*(y for x in ties for y in (x, math.nextafter(x, 0), math.nextafter(x, 1e9))), *(k / 16 for k in range(200)), 0.0, 1.5625, 100.0, 0.1 + 0.2]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", fixed_text(F.col("x"), 2).alias("two"), number_text(F.col("x")).alias("three"), percent_text(F.col("x")).alias("percent")).collect()
    assert [r["two"] for r in got] == [f"{x:.2f}" for x in values]
    assert [r["three"] for r in got] == [f"{x:.3f}".rstrip("0").rstrip(".") for x in values]
    assert [r["percent"] for r in got] == [f"{(math.floor(x * 100) + (x * 100 - math.floor(x * 100) >= 0.5)) / 100:.2f} %" for x in values]


def test_entropy_metrics_equal_their_sql(spark, tmp_path):
    import duckdb

    from siftmark.oracles import ORACLES
    from siftmark.queries import QUERIES

    some = "abcdefghijklmnopqrstuvwxyzABCDEFGH"
    wide = "".join(map(chr, range(32, 128))) + "".join(chr((2 + i % 30) << 6 | i % 64) for i in range(80))  # 256 bytes, over 7 bits each
    # 4.8125 bits, 4.5625 bits, and a share of 1 in 64 blocks: exact halves of the third decimal
    texts = ["abc" + some[:29], "abcdefg" + some[:25], wide + "a" * (256 * 63), "abcdefgh" * 4, "", "a" * 700 + "bc"]
    spark.createDataFrame([*enumerate(texts + texts[::-1] + texts[::2])], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, QUERIES["r8_entropy"](spark, str(tmp_path)).collect())) == sorted(duck.execute(ORACLES["r8_entropy"]).fetchall())


def test_digest_similarity_rules(spark):
    from pyspark.sql import functions as F

    cases = [("3:abc:de", "3:abd:zz", 200 / 3), ("6:abc:de", "3:zz:abc", 100.0), ("3:zz:abc", "6:abc:de", 100.0), ("3:a:b", "12:a:b", 0.0), ("x", "3:a:b", 0.0), ("q:a:b", "q:a:b", 0.0), ("3::", "3::", 100.0)]
    rows = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(fuzzy.digest_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in rows] == pytest.approx([c[2] for c in cases])


def test_entropy(spark):
    low, high = bytes, lambda n: bytes(i & 255 for i in range(n))
    r = run(spark, entropy.section, {"same": (high(4096), high(4096)), "other": (low(8192), high(8192)), "none": (b"", b""), "one": (b"", high(1024)), "high": (high(8192), high(8192)), "flat": (low(8192), low(8192)), "range": (high(3000), low(5000))})
    assert r["same"]["similarity_percent"] > 99.9 and r["other"]["similarity_percent"] < 5
    assert r["other"]["mean_a"] < 0.01 and r["other"]["mean_b"] > 7
    assert r["none"]["similarity_percent"] == 100 and r["one"]["similarity_percent"] == 0
    assert r["high"]["high_a"] > 0.5 and 7.5 < r["high"]["max_a"] <= 8
    assert r["flat"]["high_a"] == 0 and r["flat"]["similarity_percent"] == 100
    assert all(0 <= v <= 8 for v in r["range"]["profile_a"] + r["range"]["profile_b"]) and math.isfinite(r["range"]["similarity_percent"])


def plain_resample(src, n):
    if len(src) in (n, 0):
        return src
    out, w = [], len(src) / n
    for i in range(n):
        a, b = min(int(i * w), len(src) - 1), min(int((i + 1) * w), len(src))
        b = max(b, a + 1)
        out.append(sum(src[a:b]) / (b - a))
    return out


def test_resample(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 11, 15, 100):
        src = [float((i * 37) % 11) for i in range(n)]
        frame = spark.createDataFrame([(src,)], "p array<double>")
        for points in (1, 2, 5, 11, 15):
            got = frame.select(entropy.resample(F.col("p"), F.lit(points)).alias("r"), entropy.downsample(F.col("p"), points).alias("d")).first()
            assert got["r"] == pytest.approx(plain_resample(src, points))
            assert got["d"] == pytest.approx(plain_resample(src, points) if n > points else src)


def test_format(spark):
    filled = lambda n, v: bytes([v]) * n
    cut = b"MZ" + bytes(0x3A) + b"\0\x10\0\0"
    r = run(spark, fileformat.section, {
        "same": (minimal_pe(b".text", filled(128, 0x41)),) * 2, "names": (minimal_pe(b".text", filled(64, 0x11)), minimal_pe(b".data", filled(64, 0x22))),
        "cosine": (minimal_pe(b".text", bytes(256)), minimal_pe(b".text", filled(256, 255))), "none": (b"", b""), "cut": (cut, cut), "one": (minimal_pe(b".text", filled(32, 0x90)), b""),
        "imports": (minimal_pe(b".text", b"x", imports=(b"kernel32.dll", b"User32.dll", b"KERNEL32.dll")), minimal_pe(b".text", b"y", imports=(b"kernel32.dll",))),
        "elf": (minimal_elf([(b".text", 1, b"abc"), (b".bss", 8, b"zz")]), minimal_elf([(b".text", 1, b"abc")], wide=False, big=True, machine=8)),
    })
    s = r["same"]
    assert s["similarity_percent"] == 100 and s["comparisons"] == [{"name": ".text", "in_a": True, "in_b": True, "similarity_percent": 100.0}]
    assert (s["a"]["format"], s["a"]["machine"], s["a"]["subsystem"], s["a"]["time_stamp"], s["a"]["entry_point"]) == ("PE", "x64", "Console", "2020-09-13T12:26:40Z", "0x1000")
    assert s["a"]["sections"][0]["raw_size"] == 128 and s["a"]["sections"][0]["flags"] == "R-X"
    assert r["names"]["similarity_percent"] == 0 and [(c["name"], c["similarity_percent"]) for c in r["names"]["comparisons"]] == [(".text", None), (".data", None)]
    assert r["cosine"]["comparisons"][0]["similarity_percent"] == 0
    for k in ("none", "cut"):
        assert not r[k]["applicable"] and r[k]["similarity_percent"] is None and r[k]["a"]["format"] == "Unknown"
    assert r["one"]["applicable"] and r["one"]["similarity_percent"] == 0
    i = r["imports"]
    assert i["a"]["imports"] == ["KERNEL32.DLL", "USER32.DLL"] and i["imports_common"] == ["KERNEL32.DLL"] and i["imports_only_a"] == ["USER32.DLL"]
    assert i["similarity_percent"] == 75
    e = r["elf"]
    assert [x["name"] for x in e["a"]["sections"]] == ["", ".text", ".bss", ".shstrtab"] and e["a"]["sections"][2]["raw_size"] == 0
    assert (e["a"]["machine"], e["b"]["machine"], e["a"]["subsystem"], e["a"]["entry_point"], e["b"]["entry_point"]) == ("x86-64", "MIPS", "EXEC", "0x401000", "0x401000")
    assert e["similarity_percent"] == 75
    assert [c["name"] for c in e["comparisons"]] == ["", ".text", ".bss", ".shstrtab"]
    assert next(c for c in e["comparisons"] if c["name"] == ".text")["similarity_percent"] == 100


def test_patterns(spark):
    shared, ta, tb = bytes(range(0xA0, 0xB0)), bytes(range(0x10, 0x20)), bytes(range(0xE0, 0xF0))
    seq = bytes((i * 31 + 7) & 255 for i in range(1024))
    r = run(spark, patterns.section, {
        "same": (seq, seq), "other": (bytes(512), b"\xff" * 512), "one": (bytes(64), b""), "none": (b"", b""), "tiny": (b"\1\2\3", b"\1\2\3"), "tiny2": (b"\1\2\3", b"\x09\x09\x09"),
        "run": (shared * 3 + ta * 3, shared * 3 + tb * 3),
    })
    assert r["same"]["similarity_percent"] == 100 and not r["same"]["unique_a"] and r["same"]["common_patterns"]
    assert r["other"]["similarity_percent"] == 0 and not r["other"]["common_patterns"]
    assert r["one"]["similarity_percent"] == 0 and r["one"]["unique_a"][0]["count_a"] == 49
    assert [r[k]["similarity_percent"] for k in ("none", "tiny", "tiny2")] == [100, 100, 0]
    hexes = lambda k: {h["hex"]: h for h in r["run"][k]}
    assert shared.hex().upper() in hexes("common_patterns")
    a, b = hexes("unique_a")[ta.hex().upper()], hexes("unique_b")[tb.hex().upper()]
    assert (a["count_a"], a["count_b"], a["first_offset_a"], a["first_offset_b"]) == (3, 0, 48, -1) and (b["count_a"], b["first_offset_a"]) == (0, -1)
    images, pairs = frames(spark, {"run": (shared * 3 + ta * 3, shared * 3 + tb * 3), "seq": (seq, seq[:700] * 2)})
    by_join = patterns.top_hits(patterns.paired(pairs, patterns.grams(images, CompareOptions())), CompareOptions())
    assert sorted(map(tuple, by_join.collect())) == sorted(map(tuple, patterns.hit_rows(patterns.compared(images, pairs, CompareOptions())).select(*by_join.columns).collect()))
    raw = run(spark, patterns.section, {"eq": (b"x", b"x"), "ne": (b"x", b"y")}, CompareOptions(pattern_length=0))
    assert (raw["eq"]["similarity_percent"], raw["ne"]["similarity_percent"]) == (100, 0)
    few = run(spark, patterns.section, {"same": (seq, seq)}, CompareOptions(max_patterns=3))
    assert len(few["same"]["common_patterns"]) == 3
    capped = run(spark, patterns.section, {"same": (seq, seq)}, CompareOptions(max_distinct_patterns=5, max_patterns=50))
    assert sorted(h["first_offset_a"] for h in capped["same"]["common_patterns"]) == [0, 1, 2, 3, 4]


def shuffled_bytes(spark, frame):
    """Bytes that a run of the frame writes for exchanges."""
    sc, jvm = spark.sparkContext, spark._jvm

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    frame.collect()
    return total() - before


@pytest.mark.parametrize("query", ["p4_gram_join", "p5_hits_by_join"])
def test_joins_of_patterns_ship_less_than_their_input(spark, tmp_path, query):
    from siftmark.queries import QUERIES

    words = [f"{x:x}" for x in range(3000)]
    rows = [(i, " ".join(words[(i * 7919 + k * k * 31) % 3000] for k in range(1500))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    size = sum(p.stat().st_size for p in (tmp_path / "documents.parquet").glob("*.parquet"))
    assert 0 < shuffled_bytes(spark, QUERIES[query](spark, str(tmp_path))) < 4 * size


@pytest.mark.parametrize(("length", "most"), [(5, 2_000_000), (16, 30)])
def test_packed_patterns_meet_as_tables_do(spark, monkeypatch, length, most):
    text = pseudo(900, 5).hex().encode()
    images, pairs = frames(spark, {"parts": (text * 3 + text[:100], text[700:] + text), "few": (b"abcabc" * 40, b"xabcabcabcab" * 9), "short": (b"abc", text), "none": (b"", b""), "one": (b"", b"a" * 200)})
    monkeypatch.setattr(patterns, "PIECE_BYTES", 300)
    monkeypatch.setattr(patterns, "PART_BYTES", 1500)
    opts = CompareOptions(pattern_length=length, max_distinct_patterns=most, max_patterns=20)
    met = patterns.paired(pairs, patterns.grams(images, opts)).cache()
    assert sorted(patterns.overlap(images, pairs, opts).collect()) == sorted(patterns.gram_jaccard(pairs, met).collect())
    assert sorted(patterns.top_hits(patterns.best_met(images, pairs, opts), opts).collect()) == sorted(patterns.top_hits(met, opts).collect())


def test_overall_and_reports(spark, tmp_path):
    images, pairs = frames(spark, {"x": (minimal_pe(b".text", pseudo(3000, 1)), minimal_pe(b".text", pseudo(3000, 1)[:2000])), "y": (b"", b""), "z": (bytes(range(1, 13)), bytes(range(1, 13)))})
    odd = CompareOptions(weights={"ByteDiff": math.inf, "FuzzyHash": 1.7e308, "Format": math.nan, "Entropy": -1.0})
    for opts in (CompareOptions(), odd):
        got = {r["pair_id"]: r["overall_percent"] for r in overall(images, pairs, opts).collect()}
        assert all(math.isfinite(v) and 0 <= v <= 100 for v in got.values()) and got["y"] == got["z"] == pytest.approx(100)
    only = CompareOptions(modules=frozenset({"Entropy"}), large_file_bytes=10)
    assert list(compare(images, pairs, only)) == ["Entropy"]
    assert {r["warnings"][0] for r in size_warnings(images, pairs, 10).collect() if r["warnings"]} >= {"File A is large (12 bytes); analysis may take time."}
    found = results(images, pairs).cache()
    assert modules_of(found) == list(MODULES)
    for row in to_json(found).collect():
        report = check_json(row["json"])
        assert [s["kind"] for s in report["Sections"]] == ["byteDiff", "fuzzyHash", "format", "entropy", "patterns"]
        assert [s["Module"] for s in report["Sections"]] == [0, 1, 2, 3, 4]
        assert "Error" in report["Sections"][0] and report["FileA"]["Size"] >= 0 and json.dumps(report)
    pages = {r["pair_id"]: r["body"] for r in rendered(found, "html").collect()}
    assert all(p.startswith("<!doctype html>") and p.endswith("</html>") for p in pages.values()) and "<svg" in pages["x"]
    assert "OVERALL SIMILARITY (weighted): 100.00 %" in {r["pair_id"]: r["body"] for r in rendered(found, "text").collect()}["y"]
    write_reports(found, str(tmp_path / "json"), "json")
    assert spark.read.parquet(str(tmp_path / "json")).count() == 3
    assert text_bar(50) == "[" + "#" * 20 + "." * 20 + "]"


def test_failed_module_is_an_error_row(spark):
    images, pairs = frames(spark, {"x": (b"abc", b"abc")})

    def broken(*_):
        raise RuntimeError("no luck")

    rows = {r["module"]: r for r in scores(compare(images, pairs, analyzers={"ByteDiff": broken, "Entropy": entropy.section, "FuzzyHash": lambda *_: None})).collect()}
    assert (rows["ByteDiff"]["kind"], rows["ByteDiff"]["title"], rows["ByteDiff"]["error"]) == ("error", "ByteDiff (Error)", "no luck")
    assert rows["FuzzyHash"]["error"] == "Analyzer returned null." and rows["Entropy"]["similarity_percent"] == 100


def test_images(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    row = image_info(load_images(spark, str(tmp_path / "a.bin"))).first()
    assert (row["name"], row["size"], row["sha256"][:8]) == ("a.bin", 5, "2CF24DBA")
    with pytest.raises(ValueError):
        load_images(spark, " ")
    with pytest.raises(Exception, match="(?i)path"):
        load_images(spark, str(tmp_path / "none")).count()
    with pytest.raises(ValueError):
        images_from_bytes(spark, {"x": None})


def test_a_failing_payload_is_a_row_of_its_own(spark):
    """One payload fails, in a kernel and in a comparison; the others are scored, and reports tell."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from siftmark.functions.expressions import kernel, with_error
    from siftmark.plans.compare import ANALYZERS
    from siftmark.sources.images import both_sides

    def first_byte(images, pairs, opts):
        def each(data):
            return [(data[0],)]  # raises on an empty payload

        sides = both_sides(pairs, kernel(images, each, {"first": pa.int64()}, "first long", errors=True))
        score = F.when(F.col("a.first") == F.col("b.first"), 100.0).otherwise(0.0)
        rows = sides.select("pair_id", score.alias("similarity_percent"), F.coalesce("a.error", "b.error").alias("error"), F.array(F.struct(F.lit("First").alias("Key"), F.lit("byte").alias("Value"))).alias("metrics"))
        return with_error(rows, F.col("error"))

    images, pairs = frames(spark, {"good": (b"abc", b"axe"), "bad": (b"abc", b""), "other": (b"a", b"b")})
    opts = CompareOptions(modules=frozenset({"ByteDiff", "First"}))
    rows = {(r["pair_id"], r["module"]): r for r in scores(compare(images, pairs, opts, {**ANALYZERS, "First": first_byte})).collect()}
    assert [rows[p, "First"]["similarity_percent"] for p in ("good", "bad", "other")] == [100, None, 0]
    bad = rows["bad", "First"]
    assert (bad["kind"], bad["title"], bad["metrics"][0]["Key"]) == ("error", "First (Error)", "Error") and "index out of range" in bad["error"]
    assert all(rows[p, "ByteDiff"]["error"] is None for p in ("good", "bad", "other"))
    found = compare(images, pairs, opts, {**ANALYZERS, "First": first_byte})["First"]
    row = results(images, pairs, opts).join(found.select("pair_id", F.struct(*[c for c in found.columns if c != "pair_id"]).alias("First")), "pair_id")
    texts = {r["pair_id"]: r["body"] for r in rendered(row, "text").collect()}
    assert "First (Error)" in texts["bad"] and "First (Error)" not in texts["good"]
    kinds = {r["pair_id"]: [x["kind"] for x in check_json(r["json"])["Sections"]] for r in to_json(row).collect()}
    assert kinds["bad"] == ["byteDiff", "error"] and kinds["good"] == ["byteDiff", "First"]


def test_built_in_modules_keep_a_failing_pair_apart(spark, monkeypatch):
    from siftmark.functions import kernels

    data = seeded(300, 3)
    with pytest.raises(TypeError):
        patterns.compare_payloads(data, None, CompareOptions())
    tables = patterns.Tables(CompareOptions())
    for _ in range(3):
        assert tables.of("a", data)[0].tolist() == kernels.gram_index(data, 16, 10**6)[0].tolist()
    assert tables.made == 1
    monkeypatch.setattr(patterns, "KEPT_BYTES", 10)
    tables.of("b", data[:100])
    assert list(tables.kept) == ["b"] and tables.bytes == sum(x.nbytes for x in tables.kept["b"])


def test_stream(spark, tmp_path):
    from siftmark.streaming.features import stream_images, write_features

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.bin").write_bytes(seeded(500, k))
    query = write_features(stream_images(spark, str(tmp_path / "in")), lambda i: fuzzy.sketches(i, CompareOptions()), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_cli(spark, tmp_path, capsys):
    a, b = tmp_path / "a.bin", tmp_path / "b.bin"
    a.write_bytes(seeded(300, 1))
    b.write_bytes(seeded(300, 2))
    out = tmp_path / "r.json"
    assert cli.main(["--help"]) == 0 and cli.main([str(a)]) == 2 and cli.main([str(a), str(tmp_path / "no")]) == 1
    assert cli.main([str(a), str(b), "--pattern-len", "4", "--modules", "byte, sig", "--json", str(out), "--html", str(tmp_path / "r.html")]) == 0
    assert [s["kind"] for s in json.loads(out.read_text())["Sections"]] == ["byteDiff", "patterns"] and "OVERALL" in capsys.readouterr().out
    for bad in (["x", "y", "--what"], ["x", "y", "--pattern-len", "0"], ["x", "y", "--json"], ["x", "y", "--modules", "zip"]):
        with pytest.raises(cli.UsageError):
            cli.parse(bad)
    assert parse_modules(" , ") == frozenset(MODULES) and cli.lenient_options({"pattern-len": "x", "shingle-k": "5"}).shingle_k == 5
