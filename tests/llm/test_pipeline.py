"""The pipeline's stages, each on its own input, and the registry without the subpackage."""

import math
import os
import shutil
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftmark.llm import toxicity
from siftmark.llm.common import stored
from siftmark.llm.queries import tokenizer_path
from tests.llm.test_operators import LOWER, clashing, plain_mix, words_of

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    frames = {"documents": docs}
    now = docs
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, SMALL).write.parquet(path)
        now = spark.read.parquet(path)
        frames[name] = now
    ids = lambda n: [r["doc_id"] for r in frames[n].select("doc_id").collect()]
    assert set(ids("toxicity")) < set(ids("documents")) and sorted(ids("line_dedup")) == sorted(ids("toxicity"))
    assert set(ids("near_duplicates")) < set(ids("line_dedup")) and len(set(ids("near_duplicates"))) == len(ids("near_duplicates"))
    assert max(map(ids("mixing").count, set(ids("mixing")))) == 2 and set(ids("mixing")) <= set(ids("near_duplicates"))
    assert set(ids("packing")) == set(ids("mixing"))
    for n in ("toxicity", "line_dedup", "near_duplicates", "mixing"):
        assert frames[n].columns == docs.columns
    assert frames["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert pipeline.run(spark, SMALL).count() == frames["packing"].count()


def plain_stages(rows, machine):
    """The rows after each stage but the last, and the pieces, by plain Python: ``rows`` of (doc_id, text, lang, source)."""
    out = {}
    known = toxicity.TermIds()

    def score(text):
        mine = set(known.of(text or "").tolist())
        at = [k for k, term in enumerate(machine.terms.tolist()) if term in mine]
        z = machine.bias + sum(float(machine.weights[k]) for k in at) + sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(at) for b in at[:i])
        return 1 / (1 + math.exp(-max(-40, min(40, z))))

    rows = out["toxicity"] = [r for r in rows if score(r[1]) < 0.7]
    pages, held = Counter(), Counter()
    for source, text in {(r[3], r[1]) for r in rows}:
        pages[source] += 1
        held.update({(source, x.strip(" ")) for x in ("" if text is None else text).split("\n") if x.strip(" ")})
    gone = {k for k, n in held.items() if n >= 3 and n > 0.02 * pages[k[0]]}
    clean = lambda text, source: None if text is None else "\n".join(x for x in text.split("\n") if (source, x.strip(" ")) not in gone)
    rows = out["line_dedup"] = [(i, clean(t, s), lang, s) for i, t, lang, s in rows]

    sets = []
    for _, t, *_ in rows:
        w = words_of((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                group[find(a)] = find(b)
    groups = defaultdict(list)
    for a, r in enumerate(rows):
        # texts without words: one of each id, and all without an id
        groups[find(a) if sets[a] else ("blank", r[0]) if r[0] is not None else ("blank", a, "")].append(a)
    out["groups"] = [[rows[a] for a in g] for g in groups.values()]
    return out


def odd_rows():
    return [(None, None, "en", None), (None, "", "en", "src1"), (7_000_001, " \t", "de", None), (7_000_002, "one", "en", "odd"), (7_000_002, "one", "en", "odd"), (7_000_002, "quite another text under the same id", "en", "odd"), (None, "a text that has no id but some words", "en", "odd"), (7_000_003, "ab cd " * 6000, "en", "odd")]


def test_stages_against_plain_versions(spark):
    """sf0.01 and odd rows, under clashing names, through every stage; each is judged on its own input."""
    import corpus_pipeline as pipeline

    folder = SMALL
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in odd_rows()], docs.schema)
    docs = stored(clashing(docs.unionByName(more)), "docs")
    plain = lambda df: [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    machine = toxicity.train(docs, labels, learn_from=~toxicity.held_out("doc_id"))
    now, frames = docs, {}
    for name, stage in pipeline.STAGES:
        now = frames[name] = stored(stage(spark, now, folder), name)
    rows = plain(docs)
    want = plain_stages(rows, machine)
    assert Counter(plain(frames["toxicity"])) == Counter(want["toxicity"]) and len(rows) > len(want["toxicity"]) > 0.7 * len(rows)
    assert Counter(plain(frames["line_dedup"])) == Counter(want["line_dedup"]) != Counter(want["toxicity"])
    kept = plain(frames["near_duplicates"])
    left = Counter(kept)
    for group in want["groups"]:  # one row of each group stays, of its smallest id
        ids = [r[0] for r in group if r[0] is not None]
        mine = [r for r in set(group) if left[r]]
        assert sum(left[r] for r in mine) == 1 and mine[0][0] == min(ids, default=None), group
    assert len(kept) == len(want["groups"])
    targets, copies = plain_mix([(i, t, s) for i, t, _, s in kept])
    mixed = plain(frames["mixing"])
    assert Counter((i, t) for i, t, *_ in mixed) == copies
    tokenizer, pieces = Tokenizer.from_file(tokenizer_path()), Counter()
    for i, t, *_ in mixed:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            pieces[i, k, at, len(ids[at : at + 4096]), zlib.crc32(np.asarray(ids[at : at + 4096], "<u4").tobytes())] += 1
    packed = frames["packing"].collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1
    for name in ("toxicity", "line_dedup", "near_duplicates", "mixing"):
        assert frames[name].columns == docs.columns


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as pipeline

    now = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        now = stored(stage(spark, now, "/root/testdata/sf0.001"), name)
        assert now.count() == 0, name


def test_a_stage_begins_with_little_heap_and_small_batches(spark):
    """Executors (here the driver's JVM) return the heap that others left."""
    import corpus_pipeline as pipeline

    key, jvm = "spark.sql.execution.arrow.maxBytesPerBatch", spark._jvm
    was, memory = spark.conf.get(key), jvm.java.lang.Runtime.getRuntime()
    try:
        spark.conf.unset(key)
        held = [jvm.java.nio.ByteBuffer.allocate(250_000_000) for _ in range(6)]
        grown = memory.totalMemory()
        for x in held:
            spark.sparkContext._gateway.detach(x)
        pipeline.begin(spark)
        assert memory.totalMemory() < grown - 500_000_000
        assert spark.conf.get(key) == "4194304b"
    finally:
        spark.conf.set(key, was)


def test_every_stage_begins_so(spark, monkeypatch):
    import corpus_pipeline as pipeline

    class Begun(Exception):
        pass

    def begin(session):
        raise Begun

    monkeypatch.setattr(pipeline, "begin", begin)
    for _, stage in pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, spark.range(0), SMALL)


@pytest.mark.parametrize("leftover", [False, True])
def test_registry_works_without_the_subpackage(tmp_path, leftover):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    if leftover:  # what git leaves behind: folders of compiled files
        (tmp_path / "r/siftmark/llm/__pycache__").mkdir(parents=True)
        (tmp_path / "r/siftmark/llm/__pycache__/queries.cpython-313.pyc").write_bytes(b"")
    code = "import __spark_entry__ as e; assert 'a5_overall' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
