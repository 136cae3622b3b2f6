"""Line dedup: no Python in tasks, and pairs that do not grow with the square of unlike lines."""

import random

import pytest

from fleetlens.llm import lines


@pytest.fixture
def staged(monkeypatch):
    """(name, plan, table) of what is staged."""
    seen, stage = [], lines.stage

    def noted(df, name):
        table = stage(df, name)
        seen.append((name, df._jdf.queryExecution().executedPlan().toString(), table))
        return table
    monkeypatch.setattr(lines, "stage", noted)
    return seen


def _similar(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def _brute(texts):
    """Lines that go from each text: those similar to an earlier one."""
    before, gone = [], []
    for text in texts:
        n = 0
        for line in text.split("\n"):
            words = set(line.split())
            if words:
                n += any(_similar(words, b) for b in before)
                before.append(words)
        gone.append(n)
    return gone


def test_no_python_in_tasks(spark, staged):
    docs = spark.createDataFrame([(1, "a b c d e\nf"), (2, "e d c b a")], "doc_id long, text string").coalesce(1)
    kept = lines.dedup_lines(docs)
    plans = [p for _, p, _ in staged] + [kept._jdf.queryExecution().executedPlan().toString()]
    assert len(plans) > 5 and not any(w in p for p in plans for w in ("MapInArrow", "Python", "Pandas"))


def test_long_unlike_lines_make_few_pairs(spark, staged):
    pick = random.Random(5)
    texts = [" ".join(f"w{i}" for i in pick.sample(range(1500), 110)) for _ in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(r.n_removed for r in lines.dedup_lines(docs).collect()) == 0
    assert sum(t.count() for name, _, t in staged if name == "pairs") < 25


@pytest.mark.parametrize("size", [4, 9, 58, 63, 200])
def test_near_lines_of_all_sizes(spark, size):
    pick = random.Random(size)
    texts = []
    for _ in range(12):
        words = [f"w{i}" for i in pick.sample(range(3 * size + 20), size)]
        for changed in (0, 1, max(1, size // 10), size // 9, size // 9 + 1, size // 5):
            line = words[changed:] + [f"x{pick.random()}" for _ in range(pick.choice((0, changed)))]
            pick.shuffle(line)
            texts.append(pick.choice((" ", "\t", " \v", "\f\r ")).join(line) + pick.choice(("", "\n \t\n")))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == _brute(texts)
