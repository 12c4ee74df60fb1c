"""Each operator against brute force on small tables with nulls, empty texts, ties,
repeated rows and clashing column names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from kinweave.llm import _flat, bpe, cws, license_scan, line_dedup, ngram_jaccard, packing, substring_dedup, token_counts, toxicity, vector_range
from kinweave.llm.queries import vocabulary

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, row long, cls string"


def corpus(seed=1):
    rng = random.Random(seed)
    passage = rng.choices(WORDS, k=60)
    docs = []
    for i in range(60):
        w = rng.choices(WORDS, k=rng.randint(0, 120))
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randint(0, 5) : rng.randint(45, 60)]
        docs.append(" ".join(w[:30]) + "\n" + " ".join(w[30:]))
    for i in range(20):
        w = docs[i].split(" ")
        if w:
            w[rng.randrange(len(w))] = "changed"
        docs.append(" ".join(w) if i % 2 else docs[i])
    rows = [(i, t, 7, "x") for i, t in enumerate(docs)]
    return [*rows, (900, None, 1, None), (901, "", 1, None), (902, "one two", 1, None), (None, "one two", 1, None), (903, "\n \n", 1, None), rows[3]]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def test_ngram_jaccard(spark, table):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    rows = corpus()
    sets = [grams(r[1]) for r in rows]
    links = [sum(bool(j != i and a and b and len(a & b) / len(a | b) >= 0.8) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = ngram_jaccard.ngram_jaccard_join(table).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((r[0], n) for r, n in zip(rows, links))
    assert ngram_jaccard.ngram_jaccard_join(table.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Rows repeated whole, other texts with a kept row's id, and null ids."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS, k=60)) for _ in range(5)]
    near = [t.rsplit(" ", 1)[0] + " changed" for t in texts]
    rows = [(1, texts[0])] * 3 + [(1, near[0]), (0, near[0]), (2, texts[1]), (2, near[1]), (2, texts[2]), (None, texts[3]), (None, near[3]), (None, texts[3]), (None, texts[4]), (7, near[4]), (7, near[4])]
    group = [0] * 5 + [1, 1, 2] + [3] * 3 + [4] * 3
    blank = [(8, None), (8, None), (None, ""), (9, "...")]
    df = spark.createDataFrame([(i, t, 5, n % 2) for n, (i, t) in enumerate(rows + blank)], "doc_id long, text string, n_chars long, other int").repartition(3)
    of = {t: g for (_, t), g in zip(rows, group)}
    want = {0: 0, 1: 2, 2: 2, 3: None, 4: 7}

    kept = [r for r in ngram_jaccard.ngram_jaccard_join(df).collect() if r.kept]
    assert Counter(r.doc_id for r in kept) == Counter([*want.values(), *(i for i, _ in blank)])
    stage = corpus_pipeline.near_duplicates(spark, df, "")
    got = stage.collect()
    assert stage.columns == df.columns and {tuple(r) for r in got} <= {tuple(r) for r in df.collect()}
    assert Counter((of[r.text], r.doc_id) for r in got if r.text in of) == Counter(want.items())
    assert Counter((r.doc_id, r.text) for r in got if r.text not in of) == Counter(blank)
    # a passage that only repeated rows had is no repeat any more
    cut = corpus_pipeline.substrings(spark, stage, "").collect()
    assert Counter(r.text for r in cut if r.text) == Counter(r.text for r in got if r.text)


@pytest.mark.parametrize("least", [1000, 2])  # 2: most repeated blocks are dealt over partitions
def test_substring_dedup(table, monkeypatch, least):
    monkeypatch.setattr(substring_dedup, "LEAST", least)
    rows = corpus()
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, words):
        drop = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[r[0], len(w), len(drop), " ".join(x for j, x in enumerate(w) if j not in drop)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(table).collect())
    assert got == want


def test_line_dedup_exact(spark):
    df = spark.createDataFrame([(1, "same line here it is\nother words stand there"), (2, "same line here it is\n\nnew"), (3, None), (4, "new")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(df).collect()}
    assert got == {1: "same line here it is\nother words stand there", 2: "\nnew", 3: "", 4: ""}


def fuzzy_lines(seed=11):
    """Documents of lines of which some are changed in a letter or two."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefghij ", k=rng.randint(40, 90))).strip() for _ in range(12)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(base)
            for _ in range(rng.randint(0, 2)):
                at = rng.choice([0, len(x) - 1, rng.randrange(len(x))])
                x = x[:at] + rng.choice("xyz") + x[at + 1 :]
            lines.append(rng.choice([x, x, "", "short", f" {x}\t"]))
        docs.append((i if i != 7 else None, "\n".join(lines)))
    return docs


def lines_by_force(docs, k=8, threshold=0.8):
    """{(id, text): (lines removed, kept text)}: the first line of each component stays."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    lines = [(i, p, x.strip(" \t\r\f\v")) for i in order for p, x in enumerate(docs[i][1].split("\n"))]
    lines = [x for x in lines if x[2]]
    sets = [{x[i : i + k] for i in range(max(1, len(x) - k + 1))} for _, _, x in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    gone = {lines[a][:2] for a in range(len(lines)) if root[a] != a}
    return {d: (sum(g[0] == i for g in gone), "\n".join(x for p, x in enumerate(d[1].split("\n")) if (i, p) not in gone)) for i, d in enumerate(docs)}


@pytest.mark.parametrize("block", [None, 3])
def test_line_dedup_fuzzy(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(line_dedup, "BLOCK_ROWS", block)
    docs = fuzzy_lines()
    want = lines_by_force(docs)
    assert sum(n for n, _ in want.values()) > 30
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_removed, r.kept_text) for r in got) == Counter((d[0], *want[d]) for d in docs)


def test_ngram_jaccard_in_blocks(spark, monkeypatch):
    """Groups cut into blocks of a few classes, against every pair."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", 3)
    rng = random.Random(12)
    docs = []
    for i in range(3):
        w = rng.choices(WORDS, k=100)
        for j in range(12):
            docs.append((20 * i + j, " ".join(w)))
            w[rng.choice([0, 50, 98])] = rng.choice(WORDS)
    sets = [{tuple(t.split()[p : p + 5]) for p in range(96)} for _, t in docs]
    near = [[j for j in range(36) if j != i and len(a & sets[j]) / len(a | sets[j]) >= 0.8] for i, a in enumerate(sets)]
    first = list(range(36))
    for _ in range(36):
        first = [min([first[i], *(first[j] for j in near[i])]) for i in range(36)]
    got = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert max(map(len, near)) > 3
    assert {r.doc_id: (r.n_links, r.component_id, r.kept) for r in got} == {d[0]: (len(near[i]), docs[first[i]][0], first[i] == i) for i, d in enumerate(docs)}


def test_pipeline_stages(spark):
    """Stages after the classifier, each on what the one before kept; the other columns stay with their rows."""
    docs = [(i, t, "en", len(t)) for i, t in fuzzy_lines(13)]
    rng = random.Random(14)
    passage, words = " ".join(rng.choices(WORDS, k=40)), lambda n: " ".join(rng.choices(WORDS, k=n))
    docs += [(100 + i, f"{words(30)} {passage} {words(30)}", f"l{i}", None) for i in range(3)]
    docs += [(110, docs[-1][1].rsplit(" ", 1)[0] + " changed", "l9", None), (120, "  kept \n\n layout ", "l8", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").repartition(3)

    cut = corpus_pipeline.lines(spark, df, "").localCheckpoint()
    want = lines_by_force([d[:2] for d in docs])
    assert Counter(map(tuple, cut.collect())) == Counter((d[0], t := want[d[:2]][1], d[2], len(t)) for d in docs)
    kept = corpus_pipeline.near_duplicates(spark, cut, "").localCheckpoint()
    rows = [tuple(r) for r in cut.collect()]
    grams = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(re.findall(r"[0-9a-z]+", r[1])) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    root = {i: i for i in order}
    for n, i in enumerate(order):
        for j in order[:n]:
            if root[i] != root[j] and grams[i] and grams[j] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8:
                old, new = sorted((root[i], root[j]), key=order.index, reverse=True)
                root = {k: new if v == old else v for k, v in root.items()}
    stay = [rows[i] for i in order if root[i] == i]
    assert Counter(map(tuple, kept.collect())) == Counter(stay)
    thin = corpus_pipeline.substrings(spark, kept, "").localCheckpoint()
    seen = Counter(tuple(w[i : i + 35]) for w in (r[1].split() for r in stay) for i in range(len(w) - 34))
    left = Counter()
    for r in stay:
        w = r[1].split()
        drop = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        t = " ".join(x for j, x in enumerate(w) if j not in drop) if drop else r[1]
        left[r[0], t, r[2], len(t)] += 1
    assert Counter(map(tuple, thin.collect())) == left and left != Counter(stay)
    own, tokens = bpe.ByteBpe(vocabulary()), Counter()
    for i, t, _, _ in left.elements():
        tokens[i] += len(own.encode(*_flat.utf8(pa.array([t])))[0]) + 1  # and the end id
    packed = Counter()
    for r in corpus_pipeline.packing(spark, thin, "").collect():
        packed[r.doc_id] += r.length
    assert packed == tokens


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in base[i % 30] + (rng.normal(size=8) * 0.05 if i > 40 else 0)], i % 2 if i != 5 else None) for i in range(120)]
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [None] * 8, 1), (504, [], 1)]
    got = {r.vec_id: r for r in vector_range.vector_range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([r[1] for r in rows[:120]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = [r[2] for r in rows[:120]]
    for i in range(120):
        near = [j for j in range(120) if j != i and label[i] is not None and label[i] == label[j] and x[i] @ x[j] >= 0.98]
        assert got[i].n_links == len(near)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 505))


def test_bpe_matches_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    own = bpe.ByteBpe(vocabulary())
    rng = random.Random(4)
    pool = ["'s", "'", " ", "  ", "\n", "abc", "The", "1", "²", "é", "中文", "😀", "<|endoftext|>", "aaaa", " ", "...", "\x1c"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(3000)]
    from kinweave.llm import _flat

    ids, off = own.encode(*_flat.utf8(pa.array(texts)))
    for t, a, e, w in zip(texts, off[:-1], off[1:], library.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:e].tolist() == w.ids
        assert own.decode(ids[a:e]) == library.decode(w.ids, skip_special_tokens=False) == t


def test_packing(table):
    got = packing.best_fit_packing(table, vocabulary(), capacity=64).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(by_sequence) <= 1.1 * total / 64 + 1


def test_plan_loses_nothing():
    rng = random.Random(2)
    for capacity in (10, 97, 2048):
        counts = Counter(rng.randint(1, capacity) for _ in range(3000))
        runs = packing.plan(dict(counts), capacity)
        put = Counter()
        for r in runs:
            assert sum(x * k for x, k in r.items) + r.room == capacity and r.room >= 0
            for x, k in r.items:
                put[x] += k * r.times
        assert put == counts
    assert packing.plan({}, 10) == []


def test_longest_match():
    rng = random.Random(3)
    for _ in range(200):
        first, later = ({"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(6)} for _ in range(2))
        automaton = token_counts.LongestMatch(first, later)
        for _ in range(20):
            word, i, n, pieces = "".join(rng.choices("abc", k=rng.randint(1, 10))), 0, 0, first
            while i < len(word):
                j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
                if j is None:
                    n = 0
                    break
                i, n, pieces = j, n + 1, later
            assert automaton.count(word) == n


def test_token_counts_real_vocabulary():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    longest = max(map(len, pieces))

    def greedy(word):
        rest, n = "▁" + word, 0
        while rest:
            j = next((j for j in range(min(longest, len(rest)), 0, -1) if rest[:j] in pieces), None)
            if j is None:
                return 0
            rest, n = rest[j:], n + 1
        return n

    rng = random.Random(6)
    pool = [*"0123456789.,-%çñßéüøÅ中文шяaetx", "The", "ing", "tion", "nique", "\x01", "\ue000"]
    words = ["".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(5000)]
    automaton = token_counts.load(path).automaton
    assert (automaton.count("2024"), automaton.count("0.5"), automaton.count("a\ue000")) == (5, 4, 0)
    assert [automaton.count(w) for w in words] == [greedy(w) for w in words]
    assert automaton.count("") == 0


def test_license_scan(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, "the mit licenses"), (3, None), (4, "Apache License, GNU General Public License"), (5, "Licensed under a CC BY-NC 4.0")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].labels) == (1, 3, "mit,mit-notice")
    assert got[2].n_base == got[3].n_base == 0 and got[3].first_word is None
    assert (got[4].base_labels, got[4].first_word, got[4].last_word) == ("apache,gpl", 0, 3)
    assert got[5].labels == "cc-by-nc-4.0-notice"


def test_fingerprints(spark, table):
    got = [r for r in cws.edited_fingerprints(table).collect()]
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in corpus()))
    want = Counter()
    for i, (_, _, t) in enumerate(rows):
        nxt, half = rows[(i + 1) % len(rows)][2], len(t) // 2
        want[len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


@pytest.mark.parametrize("samples", [cws.SAMPLES, 256])
def test_fingerprints_estimate_generalised_jaccard(table, samples):
    def exact(x, y):
        a, b = (Counter(w for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if w) for t in (x, y))
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in corpus()))
    want, got = {}, {}
    for i, (some, n, t) in enumerate(rows):
        nxt, half = rows[(i + 1) % len(rows)][2], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.setdefault((n if some else None, hashlib.sha256(edited.encode()).hexdigest()), []).append((exact(t, edited), exact(t, nxt)))
    for r in cws.edited_fingerprints(table, samples).collect():
        got.setdefault((r.doc_id, r.edited_sha256), []).append((r.near_edited, r.near_next))
    assert got.keys() == want.keys()
    pairs = [(g, w) for k in want for gs, ws in zip(sorted(got[k]), sorted(want[k])) for g, w in zip(gs, ws)]
    assert len(pairs) == 2 * len(rows) and any(0.2 < w < 0.8 for _, w in pairs)
    assert all(abs(g - w) <= 5 * (w * (1 - w) / samples) ** 0.5 + 1e-9 for g, w in pairs)
    inner = [(g - w) / (w * (1 - w) / samples) ** 0.5 for g, w in pairs if 0.1 < w < 0.9]
    assert 0.5 < (sum(z * z for z in inner) / len(inner)) ** 0.5 < 1.5


def test_toxicity_learns():
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(240):
        w = rng.choices(WORDS[:60] + ["plain", "house", "tree", "water", "light"], k=40)
        if i % 3 == 0:
            w[5], w[20] = rng.choice(["blorgface", "snarkwit"]), "blorgface"
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts[:180], labels[:180])
    scores = model.scores([*texts[180:], ""])
    right = sum((s >= 0.5) == bool(y) for s, y in zip(scores, labels[180:]))
    assert right >= 55 and scores[-1] < 0.5
    assert toxicity.train(["a"], [0]).scores(["x"])[0] < 0.5
