"""The segment join of problem 1 is carried out before its exact check."""

from lexiloom.llm import overlap


def test_pairs_within_an_edit_are_formed(spark, monkeypatch):
    kept = []
    checkpointed = overlap.checkpointed
    monkeypatch.setattr(overlap, "checkpointed", lambda df: kept.append(checkpointed(df)) or kept[-1])
    rows = [(1, "Q1234", "train"), (2, "Q1234", "test"), (3, "Q1235", "test"), (4, "Q98", "validation")]
    stated = spark.createDataFrame([(i, s, "P7", "Q55", split, "x") for i, s, split in rows], "row_id long, s string, p string, o string, split string, source string")
    monkeypatch.setattr(overlap, "stated_facts", lambda *a: stated)
    found = overlap.cross_split_overlaps(None, None).select("eval_row", "train_row").collect()
    assert [tuple(r) for r in found] == [(2, 1)]
    assert sorted(r.distance for r in kept[0].collect()) == [0, 1]
