import hashlib
import random

import pytest

from signalframe.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, version string, keep int, `a.b` int"


def brute(rows, least_chars=40, least_docs=5):
    """(id, n_lines, n_dropped, sha256 of what stays) of each (id, text)."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    order = lambda k: (k is not None, k or 0)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(found := holders.get(key(x), ())) < least_docs or doc == max(found, key=order)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def ran(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x", 3, 4) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in line_dedup.report(docs, **options).collect()), key=str)


def corpus(rng, n):
    common = [f"Line {k} É{'xY' * rng.randint(15, 30)}" for k in range(12)]
    rows = []
    for doc in range(n):
        lines = ["".join(rng.choice("aBcÉ é\t") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(common)
            line = line.upper() if rng.random() < 0.3 and "É" not in line else line.swapcase() if rng.random() < 0.1 else line
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", " ", "\t\r"]) + line + rng.choice(["", "  ", "\x0b"]))
        rows.append((doc, "\n".join(lines)))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = corpus(rng, 120)
    assert ran(spark, rows) == brute(rows)
    assert ran(spark, rows, least_chars=3, least_docs=2) == brute(rows, 3, 2)


def test_nulls_repeated_ids_and_empty_texts(spark):
    line = "this line is quite a lot longer than forty characters"
    rows = [(n, f"{line}\nown {n}\n{line.title()}") for n in range(4)] + [(None, line), (None, line + "\n"), (2, line), (2, f"{line}\nown 2\n{line.title()}"), (7, None), (8, ""), (9, "\n\n"), (-5, f"x\n{line}")]
    assert ran(spark, rows) == brute(rows)
    gone = {r[0]: r[2] for r in ran(spark, rows) if r[0] in (0, 1, 3)}
    assert gone == {0: 2, 1: 2, 3: 0}


def test_a_line_that_most_rows_hold_and_a_very_long_text(spark):
    line = "a common line that nearly every document of the table holds"
    rows = [(n, f"{line}\nbut number {n}") for n in range(600)] + [(1000, "\n".join([line, "short", f"{line} other"] * 3000))]
    rows += [(2000 + n, f"{line} other") for n in range(3)]
    assert ran(spark, rows) == brute(rows)
    rows += [(3000, f"{line} other")]
    assert ran(spark, rows) == brute(rows)


def test_hot_hashes_are_found(spark):
    lines = spark.range(40_000).selectExpr("if(id % 3 = 0, 5, id) AS h1", "id AS h2", "id", "id AS version", "id AS pos")
    assert [r["h1"] for r in line_dedup.frequent(lines, 4).collect()] == [5]
    assert line_dedup.frequent(lines.limit(0), 4).count() == 0


def test_bitmaps_list_only_words_that_lose_lines(spark):
    line = "this line is quite a lot longer than forty characters"
    rows = [(n, "\n".join(["s"] * 130 + [line])) for n in range(5)] + [(9, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: r for r in line_dedup.keep_bitmaps(docs).collect()}
    assert sorted(found) == [0, 1, 2, 3]
    assert [tuple(w) for w in found[0]["keep"]] == [(2, ~(1 << 2))] and found[0]["n_dropped"] == 1


def test_texts_and_other_columns(spark):
    line = "this line is quite a lot longer than forty characters"
    docs = spark.createDataFrame([(n, f"{line}\n{n}", "v", n, 1) for n in range(5)] + [(8, None, None, None, None)], SCHEMA)
    found = line_dedup.without_repeated_lines(docs)
    assert found.schema == docs.schema
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {0: "0", 1: "1", 2: "2", 3: "3", 4: f"{line}\n4", 8: None}


def test_empty_table(spark):
    assert ran(spark, []) == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = line_dedup.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    with pytest.raises(Exception, match="doc_id"):
        line_dedup.report(docs.drop("doc_id"))
