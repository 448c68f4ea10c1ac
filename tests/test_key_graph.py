"""Deletions through references against a brute-force walk over rows."""

import random

import pytest
from frames import plan, rows

from parley.operators.key_graph import Link, Reference, components, delete_rows


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """The tables are tiny and the rounds many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def brute(tables, references, asked):
    """(what is left, verdicts) by walking row by row; tables are lists of dicts."""
    cascades = [x for x in references if not x.restrict]

    def closure(seeds):
        seen, todo = set(seeds), list(seeds)
        while todo:
            table, at = todo.pop()
            for x in cascades:
                if x.parent != table or tables[table][at][x.parent_key] is None:
                    continue
                for i, row in enumerate(tables[x.child]):
                    if row[x.child_key] == tables[table][at][x.parent_key] and (x.child, i) not in seen:
                        seen.add((x.child, i))
                        todo.append((x.child, i))
        return seen

    def restricted(node):
        table, at = node
        return any(
            x.restrict and x.parent == table and tables[table][at][x.parent_key] is not None
            and any(r[x.child_key] == tables[table][at][x.parent_key] for r in tables[x.child])
            for x in references
        )

    gone, verdicts = set(), set()
    for table, (column, keys) in asked.items():
        for key in set(keys) - {None}:
            reached = closure([(table, i) for i, r in enumerate(tables[table]) if r[column] == key])
            blocked = any(restricted(n) for n in reached)
            verdicts.add((table, str(key), blocked))
            gone |= set() if blocked else reached
    left = {t: [r for i, r in enumerate(rs) if (t, i) not in gone] for t, rs in tables.items()}
    return left, sorted(verdicts)


SCHEMAS = {
    "person": "id long, boss long, home long",
    "place": "id long, mayor long",
    "note": "person long, text string",
    "loan": "place long, amount double",
}
REFERENCES = [
    Reference("person", "boss", "person", "id"),
    Reference("person", "home", "place", "id"),
    Reference("place", "mayor", "person", "id"),
    Reference("note", "person", "person", "id"),
    Reference("loan", "place", "place", "id", restrict=True),
]


def run(spark, tables, references, asked):
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rs], SCHEMAS[t]) for t, rs in tables.items()}
    wanted = {t: (c, spark.createDataFrame([(k,) for k in keys], f"{c} long")) for t, (c, keys) in asked.items()}
    return delete_rows(frames, references, wanted)


def check(spark, tables, references, asked):
    done = run(spark, tables, references, asked)
    left, verdicts = brute(tables, references, asked)
    assert rows(done.verdicts) == rows_of(verdicts)
    for name, want in left.items():
        assert rows(done.left[name]) == rows_of([tuple(r.values()) for r in want]), name


def rows_of(tuples):
    return sorted(tuples, key=lambda r: tuple((x is None, str(x)) for x in r))


def people(*triples):
    return [{"id": i, "boss": b, "home": h} for i, b, h in triples]


def test_components_follow_the_links():
    links = [Link("b", "x", "c", "x"), Link("a", "x", "b", "x"), Link("c", "x", "d", "x"), Link("d", "x", "c", "x")]
    assert components("abcde", links) == [["a"], ["e"], ["b"], ["c", "d"]]


def test_cycles_self_references_and_restrictions(spark):
    rnd = random.Random(1)

    def some(n):
        return rnd.choice([None, *range(n)])

    tables = {
        "person": people(*[(some(12), some(12), some(6)) for _ in range(14)]),
        "place": [{"id": i, "mayor": some(14) if rnd.random() < 0.5 else None} for i in range(6)],
        "note": [{"person": some(12), "text": rnd.choice(["a", None])} for _ in range(10)],
        "loan": [{"place": rnd.choice([1, None]), "amount": 1.0}],
    }
    asked = {"person": ("id", [2, 5, 5, None, 99]), "place": ("id", [0, 1, 4])}
    check(spark, tables, REFERENCES, asked)


def test_a_blocked_key_keeps_only_what_nothing_else_takes(spark):
    """2 and 3 work for 1; the loan on the place of mayor 3 blocks 1 and 3, but 2 may go on its own."""
    tables = {
        "person": people((1, None, None), (2, 1, None), (3, 1, None)),
        "place": [{"id": 7, "mayor": 3}],
        "note": [{"person": 2, "text": "x"}, {"person": 2, "text": "x"}, {"person": 1, "text": "y"}],
        "loan": [{"place": 7, "amount": 2.0}],
    }
    done = run(spark, tables, REFERENCES, {"person": ("id", [1, 2])})
    assert rows(done.verdicts) == [("person", "1", True), ("person", "2", False)]
    assert rows(done.left["person"]) == [(1, None, None), (3, 1, None)]
    assert rows(done.left["note"]) == [(1, "y")]
    assert all("NestedLoop" not in plan(df) and "Cartesian" not in plan(df) for df in done.left.values())


def test_a_long_chain_and_a_row_that_refers_to_itself(spark):
    chain = people(*[(i, i - 1 if i else 0, None) for i in range(6)])
    tables = {"person": chain, "place": [{"id": 1, "mayor": 5}], "note": [], "loan": []}
    tables["note"] = [{"person": 5, "text": "last"}]
    tables["loan"] = [{"place": None, "amount": 0.0}]
    check(spark, tables, REFERENCES, {"person": ("id", [3])})


def test_nothing_asked_for_and_unknown_tables(spark):
    tables = {
        "person": people((1, None, None), (None, 1, None)),
        "place": [{"id": None, "mayor": None}],
        "note": [{"person": None, "text": None}],
        "loan": [{"place": None, "amount": None}],
    }
    check(spark, tables, REFERENCES, {"person": ("id", [None]), "place": ("id", [])})
    frames = {"person": spark.createDataFrame([(1, None, None)], SCHEMAS["person"])}
    with pytest.raises(ValueError, match="place"):
        delete_rows(frames, REFERENCES[:2], {"person": ("id", frames["person"])})
