"""Suffix-array, substring and near duplicates against brute force."""

import pytest
from pyspark.sql import functions as F

from loomstream.llm import near_dedup, substring_dedup, suffix_dedup

from . import brute


def suffix_rows(docs):
    out = suffix_dedup.deduplicate(docs)
    return sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


def substring_rows(docs, batches):
    out = substring_dedup.deduplicate(docs, batches=batches)
    return sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=str)


def near_rows(docs, **k):
    return sorted(map(tuple, near_dedup.find_components(docs, **k).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_suffix_dedup_of_tricky_rows(as_table, tricky):
    assert suffix_rows(as_table(tricky)) == brute.suffix_dedup(tricky)


def test_suffix_dedup_of_documents(as_table, real):
    assert suffix_rows(as_table(real)) == brute.suffix_dedup(real)


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup_of_tricky_rows(as_table, tricky, batches):
    assert substring_rows(as_table(tricky), batches) == brute.substring_dedup(tricky)


def test_substring_index_compacts(as_table, real):
    assert substring_rows(as_table(real), 7) == brute.substring_dedup(real)


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup_with_frequent_anchors(as_table, tricky, monkeypatch, batches):
    monkeypatch.setattr(substring_dedup, "FREQUENT", 2)
    assert substring_rows(as_table(tricky), batches) == brute.substring_dedup(tricky)


def thue_morse(n=1024):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("batches", [1, 2])
def test_substring_dedup_of_repeated_null_and_text_ids(spark, batches):
    text = " ".join(f"w{i * i % 71}" for i in range(60))
    one, other = thue_morse()
    docs = [(7, text), (7, "a b c"), (7, text), (8, "x y " + text[10:90]), (None, text), (9, None), (3, text[30:]), (10, " ".join([one] * 13)), (11, " ".join([other] * 13))]
    table = lambda rows, kind: spark.createDataFrame(rows, f"doc_id {kind}, text string")
    known = [(i, t) for i, t in docs if i is not None]
    expected = sorted([*brute.substring_dedup(known), (None, len(text.split()), 0, brute.sha(" ".join(text.split())))], key=str)
    assert substring_rows(table(docs, "long"), batches) == expected
    named = [(None if i is None else f"d{i:02}", t) for i, t in docs]
    shown = sorted(((None if i is None else f"d{i:02}", *rest) for i, *rest in expected), key=str)
    assert substring_rows(table(named, "string"), batches) == shown


def test_substring_index_is_opened_by_a_later_job(spark, as_table, real):
    index = substring_dedup.FingerprintIndex(fanout=1)
    docs, got = sorted(real), []
    for k in range(0, len(docs), 80):
        out = index.add(as_table(docs[k : k + 80]))
        got += map(tuple, out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())
        index = substring_dedup.FingerprintIndex.open(spark, index.path)
        assert len(index.runs) == 1
    assert sorted(got, key=str) == brute.substring_dedup(real)


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_of_tricky_rows(as_table, tricky, width):
    assert near_rows(as_table(tricky), width=width) == brute.near_dedup(tricky, width)


def test_near_dedup_of_documents(as_table, real):
    assert near_rows(as_table(real), width=2) == brute.near_dedup(real)


@pytest.mark.parametrize("most", [1, 16])
def test_near_dedup_in_many_blocks(as_table, tricky, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "MOST_BLOCKS", most)
    assert near_rows(as_table(tricky), width=2) == brute.near_dedup(tricky, 2)


def test_components_of_chains_stars_and_rings(spark):
    import random

    r = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(300, 300 + k) for k in range(1, 40)] + [(500 + k, 500 + (k + 1) % 30) for k in range(30)]
    links += [tuple(r.sample(range(1000, 1200), 2)) for _ in range(150)] + [(2000, 2000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long"), near_dedup.Scratch()).collect()
    assert {x["node"]: x["label"] for x in got} == {x: find(x) for x in list(root)} and len(got) == len(root)
    assert near_dedup.components(spark.createDataFrame([], "a long, b long"), near_dedup.Scratch()).count() == 0


def test_near_dedup_of_repeated_null_and_text_ids(spark):
    text = " ".join(f"w{i * i % 71}" for i in range(60))
    one, other = thue_morse()
    docs = [(7, text), (7, "quite another text here"), (7, text), (3, text + " more"), (None, text + " and more"), (None, "alone"), (9, None), (None, ""), (10, one), (11, other), (None, "alone")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    expected = sorted([(7, 59, 3), (7, 3, 7), (7, 59, 3), (3, 60, 3), (None, 61, 3), (None, 1, None), (9, 0, 9), (None, 0, None), (10, 1, 10), (11, 1, 11), (None, 1, None)], key=str)
    n = len(near_dedup.shingle_texts(text, 2))
    shown = sorted([(i, k if k < 50 else n + k - 59, c) for i, k, c in expected], key=str)
    assert near_rows(table, width=2) == shown
    kept = sorted(map(tuple, near_dedup.deduplicate(table, width=2).collect()), key=str)
    assert kept == sorted([(7, "quite another text here"), (3, text + " more"), (None, "alone"), (9, None), (None, ""), (10, one), (11, other)], key=str)
    named = spark.createDataFrame([(None if i is None else f"d{i:02}", t) for i, t in docs], "doc_id string, text string")
    assert near_rows(named, width=2) == sorted([(*(None if x is None else f"d{x:02}" for x in (i,)), k, None if c is None else f"d{c:02}") for i, k, c in shown], key=str)


def test_near_dedup_keeps_one_of_each_group_with_all_columns(as_table, tricky):
    docs = as_table(tricky)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in brute.near_dedup(tricky, 5) if i == c)


def test_empty_tables(as_table):
    docs = as_table([])
    assert suffix_rows(docs) == [] and substring_rows(docs, 2) == [] and near_rows(docs) == []


def test_registers_merge_and_bands_agree():
    import numpy as np

    h = near_dedup.mix(np.arange(1, 301, dtype=np.uint64))
    a, b = np.sort(h[:200]), np.sort(h[100:])
    ra, rb = (near_dedup.registers(x, np.array([0, len(x)])) for x in (a, b))
    union = near_dedup.registers(np.sort(h), np.array([0, len(h)]))
    assert (near_dedup.merge_registers(ra, rb) == union).all()
    assert near_dedup.unlikely(ra, rb, np.array([200.0]), np.array([200.0]), 0.8).all()
    assert not near_dedup.unlikely(ra, ra, np.array([200.0]), np.array([200.0]), 0.8).any()


@pytest.mark.parametrize(("bucket", "together"), [(3, 50_000), (40, 2)])
def test_suffix_dedup_with_many_boundaries_and_hot_anchors(as_table, tricky, monkeypatch, bucket, together):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(suffix_dedup, "PIECES", 5)
    assert suffix_rows(as_table(tricky)) == brute.suffix_dedup(tricky)


def test_suffix_dedup_of_repeated_null_and_text_ids(spark):
    long, other = "".join(chr(97 + (i * i) % 23) for i in range(700)), "short one"
    docs = [(7, long), (7, other), (None, long[100:600]), (8, "unlike " * 3), (None, None), (7, other)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert suffix_rows(table) == brute.suffix_dedup(docs)
    named = [(None if i is None else f"d{i}", t) for i, t in docs]
    assert suffix_rows(spark.createDataFrame(named, "doc_id string, text string")) == brute.suffix_dedup(named)


def test_strings_with_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "byte_runs", lambda data, n: np.zeros(max(0, len(data) - n + 1), np.uint64))
    data = np.frombuffer(b"abcdefgh" + b"xbcdex", np.uint8)
    first, second = suffix_dedup.repeated_runs(data, np.array([0, 8, 14]), 4)
    assert first.tolist() == [False, True, False, False, False] and second.tolist() == [False, True, False]


def test_bytes_are_compared_in_parts(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "COMPARED", 16)
    data = np.frombuffer(b"abcdefghijabcdefghijabcdefghiX", np.uint8)
    a = np.arange(0, 15)
    good = suffix_dedup.same_strings(data, a, a + 10, 5)
    assert good.tolist() == [data[i : i + 5].tobytes() == data[i + 10 : i + 15].tobytes() for i in a]


def test_buckets_stay_bounded():
    for total in (0, 1, 10**6, 10**10, 10**13):
        n = suffix_dedup.bucket_count(total)
        assert total <= n * suffix_dedup.LARGE and n <= max(suffix_dedup.MANY, total / suffix_dedup.LARGE + 1)


def test_stretch_at_a_boundary_between_buckets():
    """Two copies of one key dealt apart, beside another stretch with the same leading bytes."""
    from types import SimpleNamespace

    import pyarrow as pa

    head, one, two = b"h" * suffix_dedup.LEAD, b"\x05" * suffix_dedup.DIGEST, b"\xfb" * suffix_dedup.DIGEST
    compare = suffix_dedup.compare_bucket(suffix_dedup.LEAD, SimpleNamespace(value=({head + one}, set())))

    def kinds(*rows):
        keys, ids = zip(*rows)
        place = pa.array([1] * len(rows), pa.int32())
        out = compare(pa.table({"key": pa.array(keys, pa.binary()), "row": pa.array(ids, pa.int64()), "at": place, "n": place}))
        return set(zip(out.column("row").to_pylist(), out.column("kind").to_pylist()))

    before, after = (b"g" * suffix_dedup.LEAD + one, 8), (b"i" * suffix_dedup.LEAD + one, 9)
    assert kinds(before, (head + one, 1)) == {(1, suffix_dedup.REPEATED)}
    assert kinds((head + two, 3), (head + one, 2), after) == {(2, suffix_dedup.REPEATED), (3, suffix_dedup.OPEN), (2, suffix_dedup.PARTNER)}
