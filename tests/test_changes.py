"""Change batches."""

import pytest

from tidemark.plans.changes import ChangeError, apply_batch

COLUMNS = "k int, v string"


@pytest.fixture
def loaded(spark, store):
    store.load({"t": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], COLUMNS)})
    return store


def changes(spark, rows):
    return spark.createDataFrame(rows, COLUMNS + ", op string, seq int")


def content(store):
    return sorted((r.k, r.v) for r in store.read("t").collect())


def test_counts_and_content(spark, loaded):
    report = apply_batch(loaded, "t", changes(spark, [
        (1, "A", "update", 1), (2, None, "delete", 2), (9, "n", "insert", 3),
        (7, "x", "update", 4), (8, None, "delete", 5)]), ["k"], ["seq"])
    assert report == {"insert": 1, "update": 1, "delete": 1}
    assert content(loaded) == [(1, "A"), (3, None), (9, "n")]


def test_update_can_set_null(spark, loaded):
    apply_batch(loaded, "t", changes(spark, [(1, None, "update", 1)]), ["k"])
    assert (1, None) in content(loaded)


def test_last_change_to_a_key_counts(spark, loaded):
    apply_batch(loaded, "t", changes(spark, [
        (1, "x", "update", 1), (1, None, "delete", 3), (1, "y", "update", 2)]), ["k"], ["seq"])
    assert [k for k, _ in content(loaded)] == [2, 3]


I, U, D = "insert", "update", "delete"


@pytest.mark.parametrize("key", [1, 50])
@pytest.mark.parametrize("ops", [(U, D), (D, I), (D, U), (I, U), (I, D), (D, I, U), (D, I, D),
                                 (U, D, I), (I, U, D, I, U), (U, U)])
def test_changes_to_a_key_take_effect_in_order(spark, loaded, key, ops):
    """Against the same operations one by one, for a key that exists and one that does not."""
    rows = dict(content(loaded))
    if ops[0] == I and key in rows or ops[:2] == (U, I):
        return
    for i, op in enumerate(ops):
        if op == D:
            rows.pop(key, None)
        elif op == I or key in rows:
            rows[key] = f"v{i}"
    apply_batch(loaded, "t", changes(
        spark, [(key, f"v{i}", op, i) for i, op in enumerate(ops)]), ["k"], ["seq"])
    assert content(loaded) == sorted(rows.items())


def test_order_may_be_a_column_of_the_table(spark, store):
    store.load({"t": spark.createDataFrame([(1, 0)], "k int, at int")})
    apply_batch(store, "t", spark.createDataFrame(
        [(1, 5, U), (1, 3, U)], "k int, at int, op string"), ["k"], ["at"])
    assert [tuple(r) for r in store.read("t").collect()] == [(1, 5)]


@pytest.mark.parametrize("rows", [
    [(1, "x", "insert", 1)], [(1, "x", "replace", 1)], [(None, "x", "insert", 1)],
    [(1, "x", None, 1)], [(2, "x", "update", 1), (2, "y", "update", 2)]])
def test_refused_batches_change_nothing(spark, loaded, rows):
    before = content(loaded)
    good = (3, "good", "update", 9)
    with pytest.raises(ChangeError):
        apply_batch(loaded, "t", changes(spark, rows + [good]), ["k"])
    assert content(loaded) == before and loaded.state()[0] == 0
    apply_batch(loaded, "t", changes(spark, [good]), ["k"])
    assert (3, "good") in content(loaded)


def test_deleted_rows_stay_gone_after_later_batches(spark, loaded):
    apply_batch(loaded, "t", changes(spark, [(1, None, "delete", 1)]), ["k"])
    apply_batch(loaded, "t", changes(spark, [(2, "B", "update", 1)]), ["k"])
    assert content(loaded) == [(2, "B"), (3, None)]
    assert loaded.hot("t").columns == ["k", "v"]
