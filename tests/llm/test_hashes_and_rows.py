"""Words made to collide in polynomial hashes, stored words, repeated rows, order of ties."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kinweave.llm import _flat, bpe, cws, license_scan, line_dedup, ngram_jaccard, packing, substring_dedup, vector_range
from kinweave.llm.queries import vocabulary


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


A, B = thue_morse(1024, 0), thue_morse(1024, 1)


def ids_of(encoder, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return encoder.encode(data, np.array([0, len(data)]))[0].tolist()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def test_words_that_collide_in_polynomials_differ():
    data = np.frombuffer(f"{A} {B} {A}".encode(), np.uint8)
    for h in _flat.Words(data, np.array([0, len(data)]), _flat.separators("space"), hashes=2).hash:
        assert h[0] == h[2] != h[1]


def test_hash_of_a_word_is_that_of_its_bytes_alone():
    whole = np.frombuffer(f" foo\n{A}  bar ".encode(), np.uint8)
    h = _flat.Words(whole, np.array([0, len(whole)]), _flat.separators("space")).hash[0]
    for i, w in enumerate(("foo", A, "bar")):
        own = np.frombuffer(w.encode(), np.uint8)
        assert _flat.Words(own, np.array([0, len(own)]), _flat.separators("space")).hash[0][0] == h[i]


def test_encoder_tells_such_words_apart(library):
    encoder = bpe.load(vocabulary())
    for text in (A, B, f"x {A} {B}", thue_morse(200, 0), thue_morse(200, 1)):
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_encoder_is_right_when_stored_words_share_a_hash(library, monkeypatch):
    encoder = bpe.ByteBpe(vocabulary())
    monkeypatch.setattr(encoder, "_hashes", lambda data, starts: np.full(len(starts), 12345, np.uint64))
    encoder._clear()
    for text in ("one two three two", "four one " + "y" * 300, "two"):
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_operators_on_such_words(spark, library):
    rest = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{A} {rest}"), (2, f"{B} {rest}"), (3, f"{A} {rest}")], "doc_id long, text string")
    cut = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df).collect()}
    assert cut == {1: 35, 2: 0, 3: 35}
    near = {r.doc_id: r.class_id for r in ngram_jaccard.ngram_jaccard_join(df.select("doc_id", "text")).collect()}
    assert near == {1: 1, 2: 2, 3: 1}
    packed = {r.doc_id: r.length for r in packing.best_fit_packing(df, vocabulary()).collect()}
    assert packed == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in df.collect()}


def test_one_line_stays_of_repeated_rows_too(spark):
    line = "the very same line stands in all of these rows"
    rows = [(1, f"{line}\n\nown line one", "x"), (1, f"{line}\n\nown line one", "x"), (1, f"{line}\n\nown line one", "y"), (None, line, "x"), (None, line, "x"), (2, None, "x"), (2, None, "x"), (3, "\n", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = line_dedup.line_dedup(df, carry=["row"]).collect()
    assert Counter((r.doc_id, r.row) for r in got) == Counter((i, x) for i, _, x in rows)
    kept = Counter(x for r in got for x in r.kept_text.split("\n") if x.strip())
    assert kept == {line: 1, "own line one": 1}
    assert all(r.kept_text.count("\n") == 1 for r in got if r.doc_id == 3)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_near_lines_of_many_blocks_make_one_component(spark, monkeypatch):
    """Near copies over many blocks, and very long lines beside short ones."""
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 4)
    rng = random.Random(3)
    base = "".join(rng.choices("abcdefghij ", k=400)).strip()
    rows = [(i, base[: 10 * i] + "#" + base[10 * i + 1 :]) for i in range(30)] + [(100, "z" * 200_000), (101, "z" * 200_000 + "end"), (102, "zzz")]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: int(i not in (0, 100, 102)) if i != 101 else 0 for i, _ in rows}


def test_next_text_with_ties_and_null_ids(spark):
    rng = random.Random(1)
    rows = [(i if i % 3 else 7 if i % 2 else None, " ".join(rng.choices(["ab", "c", "déf", "ghij"], k=rng.randint(0, 30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [tuple(r) for r in df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()]
    order.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2] % (1 << 64) >> 1, r[2]))
    want = Counter()
    for i, (d, t, _) in enumerate(order):
        n, k = order[(i + 1) % len(order)][1], len(t) // 2
        want[d, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in cws.edited_fingerprints(df).collect()) == want


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [1.0, 1.0], 1), (4, [0.0, 0.0], 1), (5, [1.0, -1.0], 1), (6, [float("nan"), 1.0], 1), (7, None, 1), (8, [1.0, 1.0], None), (9, [5e-324, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_range.vector_range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), **{i: (0, i) for i in (4, 5, 6, 7, 8, 9)}}


def test_other_versions_are_other_licences(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0 (the \"License\")"), (2, "Licensed under the Apache License, Version 1.1"), (3, None)]
    got = {r.doc_id: (r.base_labels, r.labels) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("apache", "apache,apache-2.0-notice"), 2: ("apache", "apache"), 3: ("", "")}


def test_lines_come_with_their_buckets_by_band():
    """Lines that are asked for in buckets of bands 2 and 0, of one bucket in bands 1 and 2, and of none."""
    hot = [[(2, 7, 1, False), (0, 9, 3, True)], [(2, 5, 2, True), (1, 5, 2, True)], []]
    asked = [[{"place": p, "hi": p, "lo": -p, "hot": [dict(zip(("band", "who", "blocks", "pivot"), x)) for x in own]} for p, own in zip((0, 2, 3), hot)], []]
    kind = pa.list_(pa.struct({"place": pa.int32(), "hi": pa.int64(), "lo": pa.int64(), "hot": pa.list_(pa.struct({"band": pa.int32(), "who": pa.int64(), "blocks": pa.int32(), "pivot": pa.bool_()}))}))
    batch = pa.RecordBatch.from_arrays([pa.array([" a\n\nb \nc", "d"]), pa.array(asked, kind)], names=["text", "asked"])
    for part in (batch, pa.concat_batches([batch, batch]).slice(2, 2)):
        got = [r for out in line_dedup._asked_lines(3)(iter([part])) for r in out.to_pylist()]
        assert [(r["hi"], r["lo"], r["line"], r["buckets"]) for r in got] == [(0, 0, "a", [9, 0, 7]), (2, -2, "b", [0, 5, 5]), (3, -3, "c", [0, 0, 0])]
        assert [[tuple(x.values()) for x in r["hot"]] for r in got] == [[(7, 1, False), (9, 3, True)], [(5, 2, True)], []]


def test_buckets_name_their_band():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([bytes(16)], pa.binary()), pa.array(["a line of text\nanother line\na line of text"])], names=["id", "row", "text"])
    for bands in (1, 2, 11):
        rows = [r for out in line_dedup._signatures(8, bands, 3)(iter([batch])) for r in out.to_pylist()]
        bits = line_dedup._band_bits(bands)
        assert [[r[f"band{b}"] & bits for b in range(bands)] for r in rows] == [list(range(bands))] * 3
        assert rows[0]["band0"] == rows[2]["band0"] != rows[1]["band0"]
