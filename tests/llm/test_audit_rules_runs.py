"""Operators 11 to 13 against brute force and held-out accuracy, with the awkward cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import boosted_rules, divergence_audit, period_runs, queries, textkernels
from folioflow.llm.common import table

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AWKWARD = [None, "", "   \n\t ", "one", "é", "x" * 5000, "naïve café 漢字 \U0001f600 ok", "a\x0bb\x0cc\x1cd", "tab\tsep\r\nline", "\n", "a\n\na\n a\na\n", "# $ %|<>\n# $ %|<>"]
CLASHING = "doc_id long, text string, lang string, source string, term string, count long, rank int, runs string, words string, score string, label int, c0 string, kept string"


def frame(spark, rows):
    """(id, text, lang, source) rows with further columns whose names clash with what the operators make."""
    return spark.createDataFrame([(*row, "t", 1, 2, "r", "w", "s", 3, "c", "k") for row in rows], CLASHING)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Operator 11


def audit(rows, least, top=10):
    """The contract by plain loops over (id, text, lang, source)."""
    docs = [(lang or "", source or "", Counter(TERM.findall(lower(text)))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        frequency, groups = Counter(), defaultdict(Counter)
        for other, source, bag in docs:
            if other == lang:
                frequency.update(bag.keys())
                groups[source].update(bag)
        kept = [t for t, n in frequency.items() if n >= least]
        total = Counter()
        for bag in groups.values():
            total.update({t: bag[t] for t in kept})
        parts = lambda bag: {t: 1 + 10**9 * (bag[t] + 2) // (sum(bag[x] for x in kept) + 2 * len(kept)) for t in kept}
        every, whole = {s: parts(bag) for s, bag in groups.items()}, parts(total)
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for source, p in every.items():
            pairs = [("pair", other, sum(apart(p[t], q[t]) for t in kept)) for other, q in every.items() if other != source]
            terms = [("term", t, apart(p[t], whole[t])) for t in kept if groups[source][t] and p[t] > whole[t]]
            for found, most in ((pairs, len(pairs)), (terms, top)):
                ranked = sorted(found, key=lambda r: (-r[2], r[1].encode()))[:most]
                out += [(lang, source, *r, i + 1) for i, r in enumerate(ranked)]
    return sorted(out)


def made_sources(n, seed):
    rng, names = np.random.default_rng(seed), [None, "", "s1", "S1", "é", "\U0001f600", "zz", "￮"]
    words = [f"{'abcdefghij'[i % 10]}{'xyzéÉA'[i // 10]}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 20 + 5 * int(rng.integers(0, 9))], int(rng.integers(0, 60)))), ["en", None, "fr"][int(rng.integers(0, 3))], names[int(rng.integers(0, 8))]) for i in range(n)]
    return rows + [(n + i, t, "en", "s1") for i, t in enumerate(AWKWARD)] + [(0, rows[0][1], "en", "s1")] * 3 + [(None, None, "xx", "only"), (None, "word", "yy", None), (5, "word", "yy", "b")]


@pytest.mark.parametrize("block, evaluations", [(256, 1 << 28), (2, 60), (3, 1 << 28)])
def test_audit_by_brute_force(spark, block, evaluations):
    rows = made_sources(150, block)
    got = divergence_audit.audit_sources(frame(spark, rows), block=block, evaluations=evaluations, least_docs=6).collect()
    assert sorted(map(tuple, got)) == audit(rows, 6)


def test_audit_of_hot_terms_in_small_blocks(spark, monkeypatch):
    """A term of every document over many blocks and Arrow batches: runs that batches cut are put together again."""
    rows = [(i, "same " * (i % 5 + 1) + f"own{i % 7}", "en", f"s{i % 3}") for i in range(2000)]
    monkeypatch.setattr(divergence_audit.kept_terms, "__defaults__", (4,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = divergence_audit.audit_sources(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == audit(rows, 10)


def test_audit_of_no_rows_and_of_no_kept_terms(spark):
    assert divergence_audit.audit_sources(frame(spark, [])).count() == 0
    rows = [(1, "a", "en", "x"), (2, None, "en", "y"), (3, "", "en", "z")]
    got = divergence_audit.audit_sources(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == audit(rows, 10) and {r["value"] for r in got} == {0} and len(got) == 6


def test_parts_of_large_counts(spark):
    pairs = [(0, 2), (5, 19), (7_999_999_999_999, 8_000_000_000_003), (4_000_000_000_000_000, 8_900_000_000_000_000)]
    want = [1 + 10**9 * (c + 2) // n for c, n in pairs]
    df = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(pairs)], "i int, c long, n long")
    assert [r["p"] for r in df.select("i", divergence_audit.parts_of(F.col("c"), F.col("n")).alias("p")).orderBy("i").collect()] == want
    assert divergence_audit.parts_array(*np.array(pairs).T).tolist() == want


# Operator 12


def text_counts(text, k=8):
    words, seen, repeated = SPACED.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            repeated += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    hit = {j for i in range(len(words) - k + 1) if count[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(hit)]


def test_counts_by_brute_force(spark, sf_dir):
    rng = np.random.default_rng(4)
    texts = [r["text"] for r in table(spark, sf_dir, "documents").select("text").collect()] + AWKWARD
    texts += ["".join(rng.choice(list("ab \n#é"), int(rng.integers(0, 200)))) for _ in range(200)] + ["w " * 200_000, "a b c d e f g h i\n" * 3]
    counts, statistics = boosted_rules.counts_and_statistics(pa.array(texts, pa.string()))
    assert counts.T.tolist() == [text_counts(t) for t in texts]
    assert statistics.shape == (len(texts), len(boosted_rules.STATISTICS)) and np.isfinite(statistics).all()
    empty, none = boosted_rules.counts_and_statistics(pa.array([], pa.string()))
    assert empty.shape == (5, 0) and none.shape == (0, len(boosted_rules.STATISTICS))


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    """With a hash that says the same of all windows the words decide, and another hash is taken."""
    words = textkernels.words_of(pa.array([" ".join(f"w{i}" for i in range(40))]), textkernels.SPACED, lower=False)
    numbers, _ = textkernels.word_numbers(words, textkernels.SPACED)
    real, calls = textkernels.window_codes, []

    def first_is_blind(*args):
        codes, at = real(*args)
        calls.append(1)
        return (codes * np.uint64(0) if len(calls) == 1 else codes), at

    monkeypatch.setattr(textkernels, "window_codes", first_is_blind)
    assert boosted_rules.repeated_words(words, numbers, 8).tolist() == [0] and len(calls) == 2


def walk(model, row):
    """One row down all trees, node by node."""
    total = model.base
    for root in model.roots.tolist():
        node = root
        while np.isfinite(model.threshold[node]):
            node = int(model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node])
        total += model.value[node]
    return total


def test_trees_fit_and_keep_their_directions():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(1500, 4))
    labels = (rows[:, 0] - 1.5 * rows[:, 1] + np.sin(3 * rows[:, 2]) + rng.normal(size=1500) > 0).astype(float)
    direction = np.array([1, -1, 0, -1])
    model = boosted_rules.fit_trees(rows, labels, direction)
    assert ((model.scores(rows) > 0.5) == labels).mean() > 0.85
    assert np.allclose(model.logits(rows[:50]), [walk(model, r) for r in rows[:50]])
    free = boosted_rules.fit_trees(rows, labels, np.zeros(4))
    for feature, way in ((0, 1), (1, -1), (3, -1)):
        moved = np.repeat(rows[:200], 41, axis=0)
        moved[:, feature] = np.tile(np.linspace(-3, 3, 41), 200)
        steps = np.diff(model.logits(moved).reshape(200, 41), axis=1) * way
        assert steps.min() >= -1e-12 and steps.max() > 0 or feature == 3
        assert (np.diff(free.logits(moved).reshape(200, 41), axis=1) * way).min() < 0


def test_first_split_by_brute_force():
    """The root of one tree of depth one has the greatest gain of all cuts, found by plain loops."""
    rng = np.random.default_rng(8)
    rows = rng.integers(0, 9, (120, 3)).astype(float)
    labels = (rows[:, 1] + rng.normal(size=120) > 4).astype(float)
    model = boosted_rules.fit_trees(rows, labels, np.zeros(3), trees=1, depth=1, rate=1.0, least_rows=5)
    base = labels.mean()
    gradient, hessian = base - labels, np.full(120, base * (1 - base))
    score = lambda m: gradient[m].sum() ** 2 / (hessian[m].sum() + 1) / 2
    best = max(((score(rows[:, f] <= c) + score(rows[:, f] > c), f, c) for f in range(3) for c in range(8) if min((rows[:, f] <= c).sum(), (rows[:, f] > c).sum()) >= 5))
    assert (model.feature[0], model.threshold[0]) == best[1:]
    left = rows[:, best[1]] <= best[2]
    assert np.isclose(model.value[model.left[0]], -gradient[left].sum() / (hessian[left].sum() + 1))


def test_rules_on_held_out_labels(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op12_boosted_rules(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        counts = text_counts(texts[i])
        assert [r[c] for c in boosted_rules.COUNTS] == counts
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.3)
    marks = [(r["doc_id"], r["quality"]) for r in table(spark, sf_dir, "labels").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = ([rows[i]["score"] for i, q in marks if q == label] for label in (1, 0))
    assert min(good) >= 0.3 and (not bad or np.mean([s < 0.3 for s in bad]) >= 0.5)


def test_rules_of_awkward_rows(spark):
    texts = [*AWKWARD, "fine words in a text of no rank " * 3, "junk ### " * 30]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "no id", "en", "s")] * 2 + [(3, "other text", None, None)])
    labels = spark.createDataFrame([(12, 1), (13, 0), (13, None), (3, 1), (3, 0), (99, 1), (None, 1), (8, 7)], "doc_id long, quality int")
    rows = boosted_rules.judge_documents(docs, labels).collect()
    assert len(rows) == len(texts) + 3 and all(0 <= r["score"] <= 1 for r in rows) and sum(r["doc_id"] is None for r in rows) == 2
    assert {r["score"] for r in boosted_rules.judge_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert boosted_rules.judge_documents(docs.limit(0), labels).count() == 0


def test_rules_of_many_rows_on_one_labelled_id(spark):
    """A third of all rows on one labelled id: one row of numbers for it reaches the driver."""
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (10, 1)], "doc_id long, quality int")
    model = boosted_rules.fit_quality_rules(docs, labels, least_rows=1)
    assert len(model.roots) <= 80 and boosted_rules.judge_documents(docs, labels).count() == 30_000


# Operator 13


def runs(words, least=24, times=3):
    """All runs by looking at every period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def woven(rng):
    n, k = int(rng.integers(0, 200)), int(rng.integers(1, 6))
    words = [f"w{x}" for x in rng.integers(0, k, n)]
    for _ in range(int(rng.integers(0, 4)) if n > 9 else 0):
        a = int(rng.integers(0, n))
        p, e = int(rng.integers(1, max(2, n // 3))), int(rng.integers(a, n + 1))
        for i in range(a, e):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least", [24, 1, 5, 40])
def test_runs_by_brute_force(least):
    rng = np.random.default_rng(least)
    texts = [woven(rng) for _ in range(300)]
    got, kept, counts = period_runs.batch_runs(pa.array([" ".join(t) for t in texts]), least, 3)
    want = [runs(t, least) for t in texts]
    assert got == want and sum(map(len, want)) > 50 and counts == [len(t) for t in texts]
    for words, mine, text in zip(texts, want, kept):
        gone = {i for s, n, q in mine for i in range(s + q, s + n)}
        assert text == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_very_long_texts():
    """Runs of runs: seeds grow with the words, so these take seconds."""
    texts = ["a " * 100_000, ("a " * 30_000 + "b ") * 3, " ".join(f"w{i % 997}" for i in range(60_000)), " ".join(f"w{i}" for i in range(60_000))]
    got, kept, _ = period_runs.batch_runs(pa.array(texts), 24, 3)
    assert got[0] == [(0, 100_000, 1)] and got[2] == [(0, 60_000, 997)] and got[3] == [] and kept[0] == "a"
    assert got[1] == [(0, 30_000, 1), (0, 90_003, 30_001), (30_001, 30_000, 1), (60_002, 30_000, 1)]


def digest(doc_id, text):
    """The contract by plain loops, the planted tail included."""
    words = SPACED.findall(text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs(words)
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    share = None if best is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), share, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_by_brute_force(spark, sf_dir):
    rows = queries.op13_periodic_runs(spark, sf_dir).collect()
    texts = table(spark, sf_dir, "documents").collect()
    key = lambda r: r[0]
    assert sorted(map(tuple, rows), key=key) == sorted((digest(r["doc_id"], r["text"]) for r in texts), key=key)
    assert any(r["n_runs"] for r in rows)


def test_runs_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, "en", "s") for i, t in enumerate(AWKWARD)] + [(None, "a b " * 30, "en", "s")] * 2 + [(7, "a b " * 30, "en", "s"), (7, "  x " * 40, None, None)] + [(i, " ".join(woven(rng)), "en", "s") for i in range(100, 160)]
    got = period_runs.run_digest(period_runs.find_periodic_runs(period_runs.with_repeated_tails(frame(spark, rows).select("doc_id", "text")))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digest(i, t) for i, t, *_ in rows), key=str)
    found = period_runs.find_periodic_runs(frame(spark, rows))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and found.count() == len(rows)
    assert period_runs.find_periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        period_runs.find_periodic_runs(frame(spark, []), times=2)
