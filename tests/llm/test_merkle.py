import hashlib
import random
import zlib

import pytest

from signalframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, words int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, forged=False):
    doc, text, lang, source, n, *_ = row
    text = text.translate(LOWER) if forged and text is not None else text
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def grown(nodes):
    """All levels of a tree, the leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][at : at + 16])) for at in range(0, len(out[-1]), 16)])
    return out


def climbed(tree, at, node):
    """The siblings on the way up, and the root that ``node`` at place ``at`` gives."""
    siblings = ""
    for level in tree[:-1]:
        low = at - at % 16
        run = level[low : low + 16]
        siblings += "".join(run[: at - low] + run[at - low + 1 :])
        node = sha("".join([*run[: at - low], node, *run[at - low + 1 :]]))
        at //= 16
    return siblings, node


def brute(rows):
    order = lambda v: (v is not None, v if v is not None else 0)
    by_source = {}
    for row in rows:
        ids = by_source.setdefault(row[3], {})
        ids[row[0]] = min(ids.get(row[0], "z"), leaf(row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([by_source[s][d] for d in sorted(by_source[s], key=order)]) for s in sources}
    top = grown([trees[s][-1][0] for s in sources])
    root, out = top[-1][0] if rows else None, []
    for row in rows:
        doc, source = row[0], row[3]
        at = sorted(by_source[source], key=order).index(doc)
        own = leaf(row)
        forged = leaf(row, True) if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 else own
        low, found = climbed(trees[source], at, forged)
        high, found = climbed(top, sources.index(source), found)
        out.append((doc, own, trees[source][-1][0], root, sha(low + high), found, found == root))
    return sorted(out, key=str)


def ran(spark, rows):
    return sorted((tuple(r) for r in merkle.report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def rows_of(rng, n, sources, ids=None):
    ids = ids or list(range(n))
    rng.shuffle(ids)
    return [(d, rng.choice([None, "", "Abc É\n", "x" * rng.randint(0, 50), "QQ q"]), rng.choice(["en", None, "fr"]), rng.choice(sources), rng.choice([None, 3, 70]), "r", 1) for d in ids]


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = rows_of(rng, 700, ["a", "a", "a", "a", "b", None, "", "Ä", "z"]) + [(5000, "only", "en", "lone", 4, "r", 1)]
    assert ran(spark, rows) == brute(rows)


def test_wide_and_negative_ids_and_many_sources(spark):
    rng = random.Random(5)
    ids = [-(1 << 63), (1 << 63) - 1, -1, 0, 1, 1 << 40, *{rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)}, *range(-40, -5)]
    rows = rows_of(rng, 0, [f"s{k}" for k in range(40)] + ["big"] * 60, ids)
    assert ran(spark, rows) == brute(rows)


def test_nulls_and_repeated_rows(spark):
    rng = random.Random(6)
    rows = rows_of(rng, 60, ["a", None])
    rows += [rows[0], rows[0], (*rows[1][:1], "another text", *rows[1][2:]), (None, "T", "en", "a", 1, "r", 1), (None, "T", "en", "a", 1, "r", 1), (None, None, None, None, None, None, None)]
    assert ran(spark, rows) == brute(rows)
    assert any(not r[-1] and zlib.crc32(str(r[0]).encode()) % 5 for r in ran(spark, rows))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_tree_sizes(spark, n):
    rows = rows_of(random.Random(n), n, ["a"])
    assert ran(spark, rows) == brute(rows)


def test_empty_table_and_other_ids(spark):
    assert ran(spark, []) == []
    with pytest.raises(TypeError):
        merkle.report(spark.createDataFrame([("x", "t", "en", "a", 1, "r", 1)], SCHEMA.replace("doc_id long", "doc_id string")))


def test_directory_ranks(spark):
    ids = sorted(random.Random(7).sample(range(-5000, 500_000), 3000))
    rows = spark.createDataFrame([("a", d) for d in ids], "source string, id long")
    found = {r["id"]: r["run"] * 16 + r["slot"] for r in merkle.ranked(rows).collect()}
    assert found == {d: n for n, d in enumerate(ids)}
