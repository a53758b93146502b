import random
from itertools import permutations
from math import factorial

from signalframe.llm import filter_audit
from signalframe.llm.filter_audit import Diagram, steps_of, transpositions

DOCS = "doc_id long, text string, source string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int, part string"
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def failures(docs):
    """The letters that each (id, text, part) fails."""
    out = []
    for doc, text, _ in docs:
        text = text or ""
        words = words_of(text)
        less = lambda other, own=doc: other is not None and (own is None or other < own)
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": any(less(d) and (t or "") == text for d, t, _ in docs),
        }
        out.append({k for k, failed in tests.items() if failed})
    return out


def brute(docs, labels):
    good, toxic = ({d for d, *v in labels if v[n] == 1 and d is not None} for n in (0, 1))
    failed = failures(docs)
    out = []
    for part in sorted({p or "" for *_, p in docs}):
        mine = [(d, f) for (d, _, p), f in zip(docs, failed, strict=True) if (p or "") == part]
        rows, shares = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone, left = [x for x in left if letter in x[1]], [x for x in left if letter not in x[1]]
                shares[letter] += len(gone)
                fails = sum(letter in f for _, f in mine)
                rows.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(f == {letter} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(*r, shares[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def ran(spark, docs, labels):
    rows = filter_audit.audit(spark.createDataFrame([(d, t, s, "p", 1) for d, t, s in docs], DOCS), spark.createDataFrame([(*r, "q") for r in labels], LABELS))
    return sorted(tuple(r) for r in rows.collect())


def corpus(rng, n):
    docs = []
    for doc in range(n):
        size = rng.choice([0, 3, 150, 199, 200, 260])
        words = [rng.choice(["a", "B", "é", f"w{k}", f"W{k}"]) if rng.random() < 0.5 else f"x{k}" for k in range(size)]
        text = rng.choice([" ", "\n", "\t \x0b", "\x85", " "]).join(words) + rng.choice(["", "", "$", "#|"])
        if docs and rng.random() < 0.3:
            text = docs[rng.randrange(len(docs))][1]
        docs.append((doc, rng.choice([text, text, text, None]), rng.choice(["a", "a", "b", "Ä", "", None])))
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark):
    rng = random.Random(2)
    docs = corpus(rng, 150)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in rng.sample(range(170), 120)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    assert ran(spark, docs, labels) == brute(docs, labels)


def test_nulls_and_repeated_rows(spark):
    text = "copy of a text"
    docs = [(3, text, "a"), (3, text, "b"), (4, text, None), (None, text, "a"), (None, "alone", "a"), (None, "alone", "b"), (3, "other", "a"), (3, "other", "a"), (1, None, "b"), (2, "", "b"), (9, "word " * 100_000, "a")]
    labels = [(3, 1, 1), (4, None, 1), (None, 1, 1)]
    assert ran(spark, docs, labels) == brute(docs, labels)
    assert ran(spark, docs, []) == brute(docs, [])


def test_empty_table(spark):
    assert ran(spark, [], [(1, 1, 1)]) == []


def test_plain_changes_visit_every_order():
    for k in range(1, 7):
        order, seen = list(range(k)), {tuple(range(k))}
        for at in transpositions(k):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.add(tuple(order))
        assert len(seen) == factorial(k)


def test_swaps_keep_every_mask_and_share_nodes():
    rng = random.Random(8)
    counts = {m: (rng.randint(0, 3), rng.randint(0, 1), 0) for m in rng.sample(range(32), 20)}
    diagram = Diagram(5, counts, 3)
    for at in transpositions(5):
        diagram.swap(at)
        assert all(diagram.at(m) == counts.get(m, (0, 0, 0)) for m in range(32))
        for level, table in enumerate(diagram.tables[:5]):
            assert len(table) <= 1 << level and len(set(table.values())) == len(table)
    same = Diagram(5, {m: (1, 0, 0) for m in range(32)}, 3)
    assert [len(t) for t in same.tables] == [1] * 6


def test_steps_of_one_mask():
    rows = list(steps_of({0b00011: (7, 2, 1)}, "ABCDE"))
    assert len(rows) == 600
    assert {r["shapley"] for r in rows if r["filter_order"][r["step"] - 1] in "AB"} == {7 * 60}
