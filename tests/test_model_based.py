"""Random operations against a dict."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.model import Entry, Mutation, Options
from tidemark.operators.memtable import Memtable
from tidemark.operators.reads import successor
from tidemark.sources.store import Database


def test_random_operations_match_a_dict(spark, tmp_path):
    rng, model = random.Random(42), {}
    options = Options(memtable_max_entries=200, compaction_trigger=4, sync_writes=False)
    db = Database(spark, str(tmp_path), options)
    for n in range(1, 5001):
        key = f"key-{rng.randrange(250):03d}"
        if rng.randrange(5) == 0:
            db.erase(key)
            model.pop(key, None)
        else:
            db.put(key, f"value-{n}")
            model[key] = f"value-{n}"
        if n % 1249 == 0:
            db.flush()
        if n % 2111 == 0:
            db.compact()
        if n % 1900 == 0:
            db = Database(spark, str(tmp_path), options)
    assert db.scan() == sorted(model.items())
    asked = spark.createDataFrame([(f"key-{k:03d}",) for k in range(250)], "key string")
    assert {r.key: r.value for r in db.multi_get(asked).collect()} == {f"key-{k:03d}": model.get(f"key-{k:03d}") for k in range(250)}
    for k in rng.sample(range(250), 5):
        assert db.get(f"key-{k:03d}") == model.get(f"key-{k:03d}")


@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from("abcde"), st.booleans())))
def test_memtable_keeps_the_greatest_sequence(rows):
    table, model = Memtable(), {}
    for sequence, key, gone in rows:
        e = Entry(sequence, gone, key, "" if gone else str(sequence))
        table.upsert(e)
        if key not in model or sequence >= model[key].sequence:
            model[key] = e
    assert table.entries() == [model[k] for k in sorted(model)]


@given(st.binary(max_size=4), st.binary(max_size=4))
def test_successor_bounds_a_prefix(prefix, key):
    end = successor(prefix)
    assert key.startswith(prefix) == (prefix <= key and (end is None or key < end))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcd"), st.one_of(st.none(), st.text(max_size=2))), max_size=4), max_size=4))
def test_batches_match_a_dict(spark, tmp_path_factory, batches):
    db, model = Database(spark, str(tmp_path_factory.mktemp("db")), Options(memtable_max_entries=3, sync_writes=False)), {}
    for b in batches:
        db.write_batch([Mutation(*m) for m in b])
        for k, v in b:
            model.pop(k, None) if v is None else model.update({k: v})
    assert db.scan() == sorted(model.items())
