"""Whitening against a dense solver, toxic passages against all segments, turn repair against a search over whole conversations."""
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mattone.llm import toxicity, turn_repair, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, x string, component string"


def vectors(spark, data):
    return spark.createDataFrame([(i, v, 1, "x", "c") for i, v in data], VECTORS)


def dense(data, k=4):
    x = np.array([[math.floor(256.0 * float(np.float32(c))) for c in v] for _, v in data])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ turned[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]), values[::-1][:k] / values.sum()


def test_whitening_equals_a_dense_solver(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((200, 7)) * np.arange(1, 8))]
    data += [(1000 + i, data[0][1]) for i in range(300)] + [(None, data[1][1])] * 2
    odd = [(1, None), (2, []), (3, [1.0, None] + [0.0] * 5), (4, [float("nan")] * 7), (5, [float("inf")] * 7), (6, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, data + odd)).toPandas()
    n, deviation, whitened, explained = dense(data)
    assert len(got) == 4 * len(data) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    place = {ident: i for i, (ident, _) in enumerate(data)}
    rows = [place[None if np.isnan(v) else int(v)] for v in got.vec_id]
    assert (deviation[rows] == got.deviation).all()
    for c in range(4):
        mine = got[got.component == c + 1]
        want = whitened[[rows[i] for i in mine.index], c]
        assert min(np.abs(want - mine.whitened).max(), np.abs(want + mine.whitened).max()) < 1e-9
        assert np.abs(mine.explained / explained[c] - 1).max() < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.5]) for i in range(5)])).collect()
    assert len(line) == 5 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    one = sorted(whitening.whiten(vectors(spark, [(i, [float(i)]) for i in (1, 3)])).collect(), key=lambda r: r.whitened)
    assert [abs(round(r.whitened, 12)) for r in one] == [1.0, 1.0] and {r.deviation for r in one} == {512 ** 2}


def test_exact_far_beyond_doubles():
    x = np.array([[1 << 40, 5], [-(1 << 40), 7]])
    n, sums = 1000, tuple(int(v) for v in x.sum(axis=0))
    assert whitening.deviations(x, n, sums) == [None, None]
    assert whitening.deviations(np.array([[3, 4]]), 10, (5, 5)) == [25 ** 2 + 35 ** 2]
    assert whitening.exact_sum(np.array([[1 << 61], [1 << 61], [1 << 61]])) == [3 << 61]


@pytest.mark.parametrize("matrix", [np.eye(6) * 3, np.diag([5.0, 5, 5 - 1e-9, 1, 1, 0]), np.ones((5, 5)), np.array([[2.0]]), np.kron(np.eye(4), np.ones((2, 2)))])
def test_eigenvectors_of_equal_eigenvalues(matrix):
    k = min(4, len(matrix))
    values, turned = whitening.eigen(matrix, k)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], atol=1e-12)
    assert np.allclose(turned @ turned.T, np.eye(k), atol=1e-10) and np.allclose(turned @ matrix, values[:, None] * turned, atol=1e-10)


def all_segments(scores):
    """The definition: the best segment (shortest, then first), then the same on what lies left and right of it."""
    best = max(((sum(scores[i:j]), i - j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    return all_segments(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in all_segments(scores[j:])]


def test_segments_equal_the_definition():
    rng = random.Random(4)
    for _ in range(300):
        # Powers of two apart, so no two sums are equal.
        scores = [rng.choice([-1, 1]) * rng.randrange(1, 1 << 20) / 7 for _ in range(rng.randrange(12))]
        got, want = toxicity.segments(scores), all_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([s for *_, s in got], [s for *_, s in want])


def test_passages_skip_what_tells_nothing():
    places, weights = np.array([3, 5, 100]), np.array([2.0, 2.0, 3.0])
    assert toxicity.passages(places, weights) == [(3, 6, 4 + toxicity.NEUTRAL), (100, 101, 3.0)]
    assert toxicity.passages(places[:0], weights[:0]) == []


def test_tokens_are_words_and_their_beginnings():
    texts = ["Ärger, ärger!! ÄRGERLICH—idiot x9y", "", None, "ärger"]
    (t,) = toxicity.tokens(pa.array(texts))
    assert list(t.first) == [0, 6, 6, 6, 7]
    same = t.hashes[0]
    assert (t.hashes[1] == same).all() and (t.hashes[6] == same).all()  # case and marks tell nothing
    assert t.hashes[2][0] != same[0] and (t.hashes[2][1:3] == same[1:3]).all() and same[3] == 0
    (i,) = toxicity.tokens(pa.array(["idiot"]))
    assert (t.hashes[3] == i.hashes[0]).all()


DOCS = "doc_id bigint, text string, lang string, source string, score string, toxic int"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus(n=900):
    rng = random.Random(9)
    clean = [a + b + c for a in "ba de fi go lu".split() for b in "ran sel tim von wup".split() for c in "a e i o u".split()]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.15
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["zorkel", "zorkeling", "quabbers", "mufftonic", "Grubnik!!"]) + rng.choice(["", "", "s", "."]) for _ in range(rng.randrange(2, 6))]
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_on_held_out_rows(spark):
    texts, toxic = corpus()
    odd = [(10_000, None, None, None, None, None), (10_001, "", None, None, None, None), (None, texts[0], None, None, None, None), (10_002, "zorkel " * 50_000, None, None, None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", "x", 1 - y) for i, (t, y) in enumerate(zip(texts, toxic))] + odd + [(5, texts[5], None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(i, 1, y, "t") for i, y in enumerate(toxic)] + [(None, None, 1, None), (10_000, 1, None, None)], LABELS)
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(texts) + len(odd) + 1
    held = [r for r in got if r.doc_id is not None and r.doc_id < len(texts) and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    caught = [r.predicted for r in held if toxic[r.doc_id]]
    assert sum(caught) >= 0.95 * len(caught) and sum(r.predicted for r in held if not toxic[r.doc_id]) <= 0.01 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[10_000].score == by[10_001].score < 0.5 and not by[10_000].passages and by[10_002].predicted == 1
    assert not by[None].held_out and by[None].score == by[0].score
    # The passage covers the planted words and little else.
    for r in held:
        if toxic[r.doc_id] and r.predicted:
            words = re.findall(r"[a-z]+", texts[r.doc_id].lower())
            marked = {p for s in r.passages for p in range(s.start, s.end)}
            planted = {p for p, w in enumerate(words) if w.startswith(("zork", "quab", "muff", "grub"))}
            assert len(marked & planted) >= 0.5 * len(planted) and len(marked - planted) <= 5


def test_toxicity_reads_no_held_out_label(spark):
    texts, toxic = corpus(300)
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)], DOCS)
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    one = spark.createDataFrame([(i, 1, y, None) for i, y in enumerate(toxic)], LABELS)
    other = spark.createDataFrame([(i, 1, 1 - y if i in held else y, None) for i, y in enumerate(toxic)], LABELS)
    scores = lambda labels: sorted((r.doc_id, round(r.score, 12)) for r in toxicity.scores(docs, labels).collect())
    assert scores(one) == scores(other)


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, None, None)], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert [(r.score, r.predicted) for r in toxicity.scores(docs, labels).collect()] == [(0.0, 0)]
    one, two = [i for i in range(2, 20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    assert [r.score for r in toxicity.scores(docs, spark.createDataFrame([(one, 1, 1, None), (two, 1, 0, None)], LABELS)).collect()] == [0.5]
    assert toxicity.scores(docs.limit(0), labels).count() == 0


TURNS = "conv_id bigint, turn bigint, role string, text string, key string, pos string"


def order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, role, text)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def searched(rows):
    """All edit scripts, the cheapest of each (row, state), then the least letters."""
    rows = sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=order)
    seen, told, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        inside = re.sub(r"[\x20\x09-\x0d]+", "", text)
        fault = "blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        told.append(fault)
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    states = {"": (0, "", [])}

    def better(found, state, way):
        if state not in found or way[:2] < found[state][:2]:
            found[state] = way

    def inserted(states):
        found = dict(states)
        for _ in range(4):
            for state, (cost, audit, lines) in list(found.items()):
                better(found, due[state], (cost + 3, audit + "I", lines + [full[due[state]] + ":"]))
        return found

    for (_, _, role, text), fault in zip(rows, told):
        found = {}
        for state, (cost, audit, lines) in inserted(states).items():
            better(found, state, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                stay = 3 if fault == "truncated" else 0
                if role[:1] and (role[0] == due[state] or role[0] == "s" and state == ""):
                    better(found, role[0], (cost + stay, audit + "K", lines + [f"{role}:{text}"]))
                better(found, due[state], (cost + 3 + stay, audit + "R", lines + [f"{full[due[state]]}:{text}"]))
        states = found
    ends = inserted(states)
    cost, audit, lines = min((ends[s] for s in ("", "a") if s in ends), key=lambda w: w[:2])
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    known = {t for _, t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def talk(seed, n, roles=("user", "assistant", "system", "tool", "", None)):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "", " \t", None, "So?", "It was. ", "Ends here.\n", "Open end"]
    rows = []
    for c in [*range(n), None]:
        for t in range(rng.randrange(1, 14)):
            turn = None if rng.random() < 0.05 else t if rng.random() < 0.9 else t // 2
            role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((c, turn, role, rng.choice(texts) if rng.random() < 0.3 else f"Said {rng.randrange(40)}{rng.choice(['.', '', '?'])}"))
    return rows


def reported(spark, rows):
    given = spark.createDataFrame([(*r, "k", "p") for r in rows], TURNS)
    out = turn_repair.report(given, turn_repair.damage(given)).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def wanted(rows):
    after = damaged(rows)
    return {c: searched([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("chunk, passes, seed", [(1024, 3, 1), (4, 3, 2), (1, 1, 3), (2, 0, 4)])
def test_repair_equals_search(spark, monkeypatch, chunk, passes, seed):
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    monkeypatch.setattr(turn_repair, "PASSES", passes)
    rows = talk(seed, 60)
    assert reported(spark, rows) == wanted(rows)


def test_runs_that_never_converge(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "CHUNK", 2)
    monkeypatch.setattr(turn_repair, "PASSES", 1)
    rows = [(c, t, role, f"Line {t}.") for c, (n, role) in enumerate([(40, "tool"), (41, "tool"), (37, "user"), (33, "system"), (29, "assistant")]) for t in range(n)]
    rows += [(9, t, ("user", "assistant")[t % 2], "Same." if t > 20 else f"Line {t}") for t in range(50)]
    assert reported(spark, rows) == wanted(rows)


def test_repair_of_odd_conversations(spark):
    rows = [(1, None, None, None), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (3, 5, "ünder", "é."), (None, 1, "assistant", "A. "), (4, -3, "user", "x" * 100_000 + ".")]
    dropped = next(i for i in itertools.count(10) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    got = reported(spark, rows)
    assert got == wanted(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert reported(spark, []) == {}
