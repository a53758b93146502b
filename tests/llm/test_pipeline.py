import random
import time

import pyarrow as pa

import corpus_pipeline
from signalframe.llm import common, packing
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_parity_join import brute as components


def test_stages_against_plain_code(spark, tmp_path):
    rng = random.Random(3)
    docs, labels = [], []
    items = [(n, " ".join(f"b{rng.randrange(500)}" for _ in range(30))) for n in range(5)]
    for n in range(400):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(5, 90))]
        if n % 9 == 0:
            words.insert(rng.randrange(len(words)), "nasty")
        if n % 11 == 0:
            words += items[n % 5][1].split()
        if n % 7 == 0 and docs:
            words = docs[rng.randrange(len(docs))][1].split()
            if n % 2:
                words[rng.randrange(len(words))] = f"e{n}"
        docs.append((n, (" " if n % 2 else "\n").join(words), "en", f"src{n % 3}", 7))
        labels.append((n, 1, int("nasty" in words)))
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    table, rows = {d[0]: d for d in docs}, given
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in rows.collect()}
        out = stage(spark, rows, str(tmp_path))
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in out.collect()} == before
            break
        assert out.schema == given.schema
        out.write.parquet(f"{tmp_path}/out-{name}")
        rows = spark.read.parquet(f"{tmp_path}/out-{name}")
        after = {r["doc_id"] for r in rows.collect()}
        kept = [table[k] for k in sorted(before)]
        if name == "quality_classifier":
            assert after == {d[0] for d in kept if "nasty" not in d[1].split()}
        elif name == "exact_dedup":
            first = {}
            for d in kept:
                first.setdefault(" ".join(d[1].split()), d[0])
            assert after == set(first.values())
        elif name == "ngram_jaccard_join":
            assert after == {k for k, _, c in components([(d[0], d[1]) for d in kept], 5, 80, 100) if k == c}
        else:
            assert after == {r[0] for r in contaminated([(d[0], d[1]) for d in kept], items) if not r[5]}
        assert after < before
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in ran.collect()} == before
    assert ran.count() >= len(before) and packing.CAPACITY == 4096


def tables(spark, path, docs, more=""):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long" + more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "some benchmark words that stand in no document of this table"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_nulls_repeated_ids_and_clashing_columns(spark, tmp_path):
    text = " ".join(f"w{n}" for n in range(40))
    docs = [(1, text, None, None, None, "k"), (1, text, None, None, None, "k"), (2, text + " ", "en", "a", 3, None), (None, "alone here", "en", "a", 3, None), (None, text, None, None, None, None), (5, None, None, None, None, None), (6, "", None, None, None, None), (7, "word " * 50_000, "en", "a", 1, "k")]
    tables(spark, tmp_path, docs, ", quality string")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(str(r["doc_id"]) for r in rows.collect()) == ["1", "5", "7", "None"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {1, 5, 7, None} and sum(r["doc_id"] == 7 for r in pieces) > 1


def test_empty_documents(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packing_tasks_keep_no_tokenizer(spark, monkeypatch):
    class Task:
        """Stands for documents and gives the task that is to run on them."""

        schema = spark.createDataFrame([], "doc_id long, text string").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, task, schema):
            return task

    texts = [None, "", " ".join(f"word{n}" for n in range(5000)), *(f"text {n % 40}, of Words." for n in range(1500))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    expected = pa.Table.from_batches(packing.pieces(Task())(iter([batch])))
    monkeypatch.setattr(packing, "materialise", lambda x: x)
    monkeypatch.setattr(packing, "pack", lambda parts, *a: parts)
    task = corpus_pipeline.best_fit_packing(spark, Task(), "")
    assert pa.Table.from_batches(task(iter([batch, batch.slice(0, 0)]))) == expected and len(expected) > len(texts)
    assert not packing._encoders and common._cache[0] == ""


def test_decontamination_tasks_release_their_memory(spark, tmp_path):
    tables(spark, tmp_path, [(n, f"text {n}", "en", "a", 3) for n in range(200)])
    assert corpus_pipeline.benchmark_decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").repartition(8), str(tmp_path)).count() == 200

    def owner(it):
        for _ in it:
            time.sleep(0.02)
        yield pa.RecordBatch.from_arrays([pa.array([str(common._cache[0])])], ["owner"])

    owners = {r["owner"] for r in spark.range(64).repartition(64).mapInArrow(owner, "owner string").collect()}
    assert "decontamination" not in owners


def test_stages_begin_with_a_full_collection(spark, tmp_path):
    tables(spark, tmp_path, [(n, f"text {n}", "en", "a", 3) for n in range(20)])
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if b.getName() not in ("G1 Young Generation", "PS Scavenge", "Copy"))

    for name, stage in corpus_pipeline.STAGES:
        before = collections()
        stage(spark, rows, str(tmp_path))
        assert collections() > before, name


def test_packing_plans_start_no_python_workers(spark, tmp_path, monkeypatch):
    def parallelize(*a, **b):
        raise AssertionError("a list of rows goes through Python workers of a second pool")

    parts = spark.range(50).selectExpr("id as doc_id", "0 as piece", "id % 7 + 1 as length", "id as ids_crc32")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    rows = packing.pack(parts, ["doc_id"]).collect()
    assert len(rows) == 50 and packing.pack(parts.limit(0), ["doc_id"]).count() == 0
    assert {(r["sequence_id"], r["offset"] + n) for r in rows for n in range(r["length"])} == {(0, n) for n in range(sum(r["length"] for r in rows))}
