"""The join of keys with their ends does not sort the lines of all keys."""

from lexiquarry.llm import lines


def test_ends_of_keys_meet_their_lines_without_a_sort(spark, monkeypatch):
    plans, write = [], lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), write(df, label))[1])
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words[:i], "other", *words[i + 1 :]])) for i in range(12)], "doc_id long, text string")
    assert lines.drop_near_lines(docs).where("n_removed = 1").count() == 11
    plan = next(p for label, p in plans if label == "candidates")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
