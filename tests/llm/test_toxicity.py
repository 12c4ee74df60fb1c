"""The classifier against a plain kernel, its operators on odd rows, and the pipeline as a whole."""

import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from kinweave.llm import toxicity

PLAIN = ["plain", "house", "tree", "water", "light", "river", "stone", "paper", "garden", "window", "morning", "letter"]
INSULTS = ["blorgface", "snarkwit"]


def inserted(word):
    """A mark after each letter: the word is met with gaps."""
    return "*".join(word)


def labelled(n, seed):
    """(text, label): one text of three holds three insults."""
    rng, out = random.Random(seed), []
    for i in range(n):
        w = rng.choices(PLAIN, k=30)
        if i % 3 == 0:
            for at in (4, 11, 23):
                w[at] = rng.choice(INSULTS)
        out.append((" ".join(w), int(i % 3 == 0)))
    return out


def margins_by_force(model, text):
    """The best margin of each token, highest first, triple by triple."""
    table, found = toxicity._symbol_table(), []
    tokens = [s for s in ([int(table[ord(c)]) for c in t if table[ord(c)]] for t in text.lower().split()) if s]
    joined = []
    for t in tokens:
        if len(t) == 1 and joined and joined[-1][1]:
            joined[-1][0].extend(t)
        else:
            joined.append((list(t), len(t) == 1))
    for t, _ in joined:
        s, best = [0, *t], -np.inf
        for unit in range(len(s)):
            got = own = 0.0
            for i in range(unit, min(unit + toxicity.UNIT, len(s))):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(len(s), i + toxicity.REACH + 1)):
                        w = toxicity.DECAY ** (k - i - 2)
                        got += w * float(model.weights[(s[i] << 14) | (s[j] << 7) | s[k]])
                        own += w * w
            best = max(best, got / max(own, toxicity._FLOOR) ** 0.5)
        found.append(best)
    return sorted(found, reverse=True)


def test_margins_by_force():
    model = toxicity.train(*map(list, zip(*labelled(120, 1))))
    texts = ["house snarkwit tree", "b l o r g face water", inserted("blorgface"), "", "?? !", "a", "Öl house é 12 letters", *(t for t, _ in labelled(6, 2))]
    want = np.full((len(texts), toxicity.TOP), toxicity._EMPTY)
    for i, t in enumerate(texts):
        top = margins_by_force(model, t)[: toxicity.TOP]
        want[i, : len(top)] = np.maximum(top, toxicity._EMPTY)
    assert np.allclose(model.margins(texts), want, atol=1e-5)


def tables(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(labelled(240, 3))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), rows


def test_gapped_insults_and_clean_texts(spark):
    docs, labels, _ = tables(spark)
    model = toxicity.fit_toxicity(docs, labels)
    clean = [t for t, y in labelled(60, 4) if not y]
    foul = [t for t, y in labelled(60, 4) if y]
    gapped = [t.replace("blorgface", inserted("blorgface")).replace("snarkwit", "s n a r k w i t") for t in foul]
    assert (model.scores(clean) < 0.5).all() and (model.scores(foul) >= 0.5).all()
    assert (model.scores(gapped) >= 0.5).mean() >= 0.9


def test_held_out_labels_are_never_learned_from(spark):
    docs, labels, rows = tables(spark)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    turned = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs, turned)
    assert (a.weights == b.weights).all() and (a.slopes == b.slopes).all() and a.shift == b.shift
    got = {r.doc_id for r in docs.filter(toxicity.held_out()).collect()}
    assert held and got == held


def test_odd_rows(spark):
    docs, labels, _ = tables(spark)
    model = toxicity.fit_toxicity(docs, labels)
    long = "house " * 200_000 + "blorgface snarkwit blorgface"
    rows = [(1, "blorgface snarkwit blorgface", 9.0), (1, "blorgface snarkwit blorgface", 9.0), (2, None, 9.0), (3, "", None), (None, "tree", 1.0), (5, long, 0.0)]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3), model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    want = {t: float(model.scores([t or ""])[0]) for _, t, _ in rows}
    assert Counter((r.doc_id, r.text, r.score, r.predicted) for r in got.collect()) == Counter((i, t, want[t], int(want[t] >= 0.5)) for i, t, _ in rows)
    assert want[rows[0][1]] >= 0.5 and want[long] >= 0.5 and want[None] == want[""] < 0.5
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.fit_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.scores(["house", ""]).tolist() == [0.5, 0.5]


def test_pipeline_as_a_whole(spark, tmp_path):
    """What `run` gives is what its stages give one after the other; rejected documents have no piece, and the others have all theirs."""
    docs, labels, rows = tables(spark)
    docs = docs.withColumn("n_chars", docs.doc_id * 0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit_toxicity(docs, labels)
    left = {i for i, t, _ in rows if model.scores([t])[0] < 0.5}
    assert 0 < len(left) < len(rows)
    first = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == left
    want = docs
    for name, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, str(tmp_path))
        want.write.parquet(str(tmp_path / f"out-{name}"))
        want = spark.read.parquet(str(tmp_path / f"out-{name}"))
    kept = spark.read.parquet(str(tmp_path / "out-substring_dedup"))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(key, got)) == Counter(map(key, want.collect()))
    assert {r.doc_id for r in got} == {r.doc_id for r in kept.collect()} <= left


_KEEPS = """
import random, re
from kinweave.llm.toxicity import train

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()).group(1)) / 1024

rng = random.Random(2)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
texts = [" ".join(rng.choices(words, k=170) + ["zorgblat"] * (i % 2)) for i in range(1200)]
train(texts[:20], [i % 2 for i in range(20)])  # tables that stay
before = held()
train(texts, [i % 2 for i in range(1200)])
print(held() - before)
"""


def test_training_gives_its_memory_back():
    """The driver, which trains, runs the stages after it too."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    kept = subprocess.run([sys.executable, "-c", _KEEPS], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout
    assert float(kept) < 25
