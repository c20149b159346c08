"""The ledger against the SQL and a plain count of repeated windows."""

import random

import duckdb
import pytest

from lookalike.llm import quality_rules as q


def texts():
    r = random.Random(5)
    vocabulary = ["ab", "c#d", "é", "Über", "|", "the", "x" * 40]
    rows = [None, "", " \n\t\n", "one", "a\nb\na\n\n a\nb", "w " * 19, "w " * 20, "Ｗ " * 30, "A\x0bB\x0cC\rD\x85E"]
    for n in (7, 8, 9, 40, 400):
        rows.append(" ".join(r.choice(vocabulary) for _ in range(n)))
        rows.append("\n".join(r.choice(["a b c d", "same line", "", "X Y"]) for _ in range(n)))
        part = [r.choice(vocabulary) + str(r.random()) for _ in range(n)]
        rows.append(" ".join(part + part[: n // 2] + ["z"] + part[n // 3 :]))
    return rows + ["long " + "word " * 30_000]


def frame(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    rows += [rows[4], (None, "null id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, failed string")


def test_report_equals_sql(spark):
    df = frame(spark)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in df.collect()])
    result = con.execute(q.oracle())
    names = [d[0] for d in result.description]
    got = sorted(map(tuple, q.report(df).select(*names).collect()), key=str)
    assert got == sorted(result.fetchall(), key=str)
    assert q.report(df.limit(0)).count() == 0


def test_repeated_windows_equal_plain_counting(spark):
    for row in q.measured(frame(spark)).join(frame(spark).select("doc_id", "text"), "doc_id").collect():
        words = (row.text or "").encode().split()
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen, inside = {}, set()
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        for i, w in enumerate(windows):
            inside |= set(range(i, i + 8)) if seen[w] > 1 else set()
        assert row.n_repeat_words == len(inside)


def test_policies_and_ablation_read_the_bits(spark):
    entries = q.ledger(frame(spark)).cache()
    rows = [r.failed for r in entries.collect()]
    for policy in (q.BASE, q.STRICT):
        mask = policy.mask()
        for r in q.ablation(entries, policy).collect():
            bit = 1 << [x.name for x in q.RULES].index(r.rule)
            assert r.n_failed == sum(f & bit > 0 for f in rows)
            assert r.n_only == sum(f & mask == bit for f in rows)
            assert r.n_kept == sum(f & mask & ~bit == 0 for f in rows)
            assert r.version == policy.version


def test_keep_returns_whole_rows(spark):
    df = frame(spark)
    kept = q.keep(df)
    assert kept.columns == df.columns
    good = {r.doc_id for r in q.report(df).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and good


@pytest.mark.parametrize("policy", [q.BASE, q.STRICT])
def test_no_python_in_the_plan(spark, policy):
    plan = q.keep(frame(spark), policy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
