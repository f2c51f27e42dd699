"""Learned scores, secrets, sharding, decontamination, packing and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnlab.llm import contract, decontamination, ngram_join, packing, quality, secret_scan, sharding, toxicity

from . import brute
from .conftest import SCHEMA, prose

SF = "/root/testdata/sf0.01"


def held_out_auc(found, labels, name):
    rows = found.where("held_out").join(labels.select("doc_id", F.col(name).alias("y")), "doc_id").toPandas()
    rank = rows.score.rank()
    pos, neg = (rows.y == 1).sum(), (rows.y == 0).sum()
    return (rank[rows.y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg), rows


def test_toxicity_held_out(spark):
    found = contract.op6_toxicity(spark, SF)
    auc, rows = held_out_auc(found, spark.read.parquet(f"{SF}/labels.parquet"), "toxic")
    assert auc > 0.9 and rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id)


def test_quality_held_out(spark):
    auc, rows = held_out_auc(contract.op9_quality_classifier(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    assert auc > 0.9 and rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    assert all(zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id)


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_scores_of_odd_rows(spark, docs, empty, score):
    name = score.__name__.replace("toxicity", "toxic")
    known = spark.createDataFrame([*((i, i % 2, None if i % 9 == 0 else i % 2) for i in [*range(44), 3]), (None, 1, 1)],
                                  "doc_id long, quality int, toxic int")
    found = score(docs, known).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all() and found.predicted.isin((0, 1)).all()
    nothing = known.limit(0)
    assert score(docs, nothing).count() == docs.count(), name
    assert score(empty, known).count() == 0


def test_scores_do_not_see_held_out_labels(spark):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    flipped = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    one, two = (quality.quality(docs, x).orderBy("doc_id").toPandas() for x in (known, flipped))
    assert (one.score - two.score).abs().max() < 1e-9


def test_base_secrets(docs, pairs, empty):
    found = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    for d, text in pairs:
        assert [(x.s, x.k, x.e) for x in found[d].base] == brute.base_secrets(text), d
    assert secret_scan.digest(secret_scan.secret_scan(empty)).count() == 0


def test_failing_assign_match_uses_up_its_text(spark):
    docs = spark.createDataFrame([(1, "secret=token:abcdefgh"), (2, "é password: x9y8z7"), (3, "a token=abc")], "doc_id long, text string")
    rows = {r.doc_id: r for r in secret_scan.digest(secret_scan.secret_scan(docs)).collect()}
    assert [rows[i].n_assign for i in (1, 2, 3)] == [0, 1, 0] and rows[2].spans == "assign:2:18"


def test_random_spans(spark):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, wanted = [], {}
    for i in range(40):
        key = "".join(rng.choice(alphabet) for _ in range(40))
        rows.append((i, f"some words {key} and more"))
        wanted[i] = f"random:11:{11 + 40}"
    for i in range(40, 160):
        rows.append((i, f"see {'version1' * 5} and aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 or a-long-name-of-a-page-in-2024-and-so-on-{'x' * 20}"))
    found = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sum(found[i] == wanted[i] for i in wanted) >= 34
    assert not any("random" in found[i] for i in range(40, 160))


def test_random_runs_beside_other_text(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ["x AWS_SECRET_ACCESS_KEY={}/{} y", "x client_id={}{} y", "x ?sig={}+{}== y", "x /my-files/{}{}/a-b y",
             "x 00112233445566778899aabbccddeeff_{}_{} y"]
    rows, wanted = [], {}
    for i in range(100):
        halves = ["".join(rng.choice(alphabet) for _ in range(24)) for _ in range(2)]
        text = forms[i % 5].format(*halves)
        rows.append((i, text))
        end = text.index(halves[1]) + 24
        wanted[i] = (text.index(halves[0]) - (i % 5 == 4), end + 2 * (i % 5 == 2))
    rows += [(i, f"see {'version1' * 5}={'a-b/c' * 9}1") for i in range(100, 150)]
    found = {r.doc_id: [(x.s, x.e) for x in r.added] for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for form in range(5):
        assert sum(found[i] == [wanted[i]] for i in range(form, 100, 5)) >= 15, forms[form]
    assert not any(found[i] for i in range(100, 150))


def test_redacted(spark):
    docs = spark.createDataFrame([(1, "x password=abcdef1 y"), (2, None), (3, "clean")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()} == {1: "x [SECRET] y", 2: None, 3: "clean"}


def test_redacted_rows_without_or_with_shared_ids(spark):
    rows = [(None, "x password=abcdef1 y", 1), (None, "clean text", 2), (None, "token: zyxwvu9", 3), (4, "secret=qwerty12", 4), (4, "clean", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans int")
    found = secret_scan.redacted(docs)
    assert found.columns == docs.columns
    assert {r._spans: (r.doc_id, r.text) for r in found.collect()} == {
        1: (None, "x [SECRET] y"), 2: (None, "clean text"), 3: (None, "[SECRET]"), 4: (4, "[SECRET]"), 5: (4, "clean")}


def battery(run):
    """(p, bits) of the three tests in plain Python."""
    letters = next((a for p, a in secret_scan.ALPHABETS if re.match(p, run)), None)
    if letters is None:
        return None
    k, n = len(letters), len(run)
    v = [letters.index(c) for c in run]

    def tail(z):
        return 1 / (1 + math.exp(1.5976 * z + 0.070565992 * z ** 3))
    x2 = sum((c - n / k) ** 2 / (n / k) for c in Counter(v).values()) + (k - len(set(v))) * n / k
    df = k - 1
    uniform = tail(((max(x2, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [x >= k / 2 for x in v]
    n1 = sum(high)
    mu = 2 * n1 * (n - n1) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    runs_p = min(1, 2 * tail(abs(runs - mu) / math.sqrt(var))) if 0 < n1 < n and var > 0 else 1e-12
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    lag = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False))
    serial = min(1, 2 * tail(abs(lag / spread + 1 / n) * math.sqrt(n))) if spread > 0 else 1e-12
    half = -sum(math.log(max(p, 1e-12)) for p in (uniform, runs_p, serial))
    return math.exp(-half) * (1 + half + half * half / 2), n * math.log2(k)


def test_battery_against_plain_python(spark):
    rng = random.Random(21)
    runs = ["".join(rng.choice(a) for _ in range(rng.randint(20, 90))) for _, a in secret_scan.ALPHABETS for _ in range(6)]
    runs += ["a1" * 15, "0" * 40, "abcdefghijklmnopqrstuvwxyz0123456789", "A9" + "B" * 30, "a-b+c" * 8]
    made = spark.createDataFrame(list(enumerate(runs)), "i int, run string").select("i", secret_scan.randomness(F.col("run")).alias("t"))
    found = {r.i: r.t for r in made.collect()}
    for i, run in enumerate(runs):
        wanted = battery(run)
        assert (found[i] is None) == (wanted is None)
        if wanted:
            assert found[i].p == pytest.approx(wanted[0], rel=1e-6, abs=1e-12) and found[i].bits == pytest.approx(wanted[1])


def test_rejection_against_benjamini_hochberg(spark):
    rng = random.Random(22)
    rows = [(s, math.ceil(math.log10(rng.random() ** (4 if i % 5 == 0 else 1)) * secret_scan.GRID)) for s in range(3) for i in range(60 * (s + 1))]
    rows += [(4, 0)] * 5
    found = secret_scan.rejection_steps(spark.createDataFrame(rows, "stratum int, step int"))
    wanted = {}
    for s in {s for s, _ in rows}:
        steps = sorted(x for t, x in rows if t == s)
        hits = [x for i, x in enumerate(steps) if 10 ** (x / secret_scan.GRID) <= secret_scan.ALPHA * (i + 1) / len(steps)]
        if hits:
            wanted[s] = max(hits)
    assert found == wanted


def test_preference_pairs_and_weights(spark):
    from pyspark.ml.classification import LogisticRegression
    rng = np.random.default_rng(4)
    good = rng.normal(size=(9, 3)) + [1, 0, -1]
    bad = rng.normal(size=(4, 3))
    rows = spark.createDataFrame([(i, int(i < 9), [float(x) for x in v]) for i, v in enumerate([*good, *bad])], "id long, label int, f array<double>")
    pairs = [(r.label, r.features.toArray()) for r in quality.preference_pairs(rows, 3).collect()]
    assert len(pairs) == 2 * 9 * 3
    every = {tuple(np.round(g - b, 9)) for g in good for b in bad}
    won = [tuple(np.round(d, 9)) for y, d in pairs if y == 1]
    assert set(won) <= every and sorted(won) == sorted(tuple(np.round(-d, 9)) for y, d in pairs if y == 0)
    assert all(sum(np.allclose(np.array(w), g - b) for w in won for b in bad) == 3 for g in good)
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=50, standardization=False).fit(quality.preference_pairs(rows, 3))
    w, d = model.coefficients.toArray(), np.array([x for y, x in pairs if y == 1])
    gradient = -(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 1e-4 * w
    assert np.abs(gradient).max() < 1e-4


def test_quality_threshold_is_the_quantile_of_the_bad_share(spark):
    known = spark.read.parquet(f"{SF}/labels.parquet").where("quality in (0, 1)")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = quality.quality(docs, known).join(known.select("doc_id", "quality"), "doc_id").where("not held_out").toPandas()
    assert abs((found.score < 0.7).mean() - (found.quality == 0).mean()) < 0.06


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    rows = spark.range(28_000).selectExpr("id as doc_id", "concat(if(id % 3 = 0, 'one | two ## ', 'three four, '), id, if(id % 6 < 3, '.', ' !')) as text")
    labels = rows.selectExpr("doc_id", "cast(doc_id % 3 != 0 as int) as quality")
    training = {i for i in range(28_000) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(training) > 20_000
    seen, made = [], quality.preference_pairs
    monkeypatch.setattr(quality, "preference_pairs", lambda rows, *rest: seen.extend(r.id for r in rows.collect()) or made(rows, *rest))
    assert quality.quality(rows, labels).count() == 28_000
    assert sorted(seen) == sorted(training)


def test_quality_numbers_and_quantiles_need_no_single_task(spark):
    rows = spark.range(500).selectExpr("id", "cast(id % 3 = 0 as int) as label")
    one, many = ({(r.label, r.id): r["at"] for r in quality.numbered(rows, 500, n).collect()} for n in (500, 40))
    assert one == many and all(sorted(v for (y, _), v in many.items() if y == x) == list(range(n)) for x, n in ((0, 333), (1, 167)))
    values = np.random.default_rng(3).normal(size=301).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for share in (0.0, 0.137, 0.5, 0.86, 1.0):
        assert quality.quantile(df, "v", share) == pytest.approx(np.percentile(values, 100 * share), abs=1e-12)


def test_toxicity_features_against_a_plain_reading(spark):
    words, stems = frozenset({"vile", "horridfool"}), frozenset({"wret", "stupi"})
    rng = random.Random(6)
    vocab = ["vile", "Horridfool", "wretched", "stupidity", "you", "fine", "day", "v1le", "vi.le", "v!le", "DEIN", "x9", "end.", "no!", "a_b", "<b>", "ok?"]
    for _ in range(60):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))
        got = dict(zip(toxicity.FEATURES, toxicity.text_features(text, words, stems), strict=True))
        found = re.findall(r"[^\W_]+", text.lower())
        n = len(found) or 1
        is_word = [w in words for w in found]
        is_stem = [any(w[:k] in stems for k in (4, 5, 6)) for w in found]
        person = [w in toxicity.SECOND_PERSON for w in found]
        hit = [a or b for a, b in zip(is_word, is_stem, strict=True)]
        hidden = re.findall(r"[^\W\d_]+(?:[@$*!|0-9._-]+[^\W\d_]+)+", text)
        plain = [w.lower().translate(toxicity.LOOKALIKES) in words for w in hidden]
        size = len(text.encode()) or 1
        wanted = {"word_density": sum(is_word) / n, "stem_density": sum(is_stem) / n, "hits": math.log1p(sum(hit)),
                  "near_density": sum(h and any(person[max(0, i - 5):i + 6]) for i, h in enumerate(hit)) / n,
                  "plain_density": sum(plain) / n, "obfuscated": len(hidden) / n,
                  "capitals": sum("A" <= c <= "Z" for c in text) / size, "exclaim": text.count("!") / n,
                  "stops": sum(c in ".!?" for c in text) / n, "words": math.log1p(len(found))}
        for name, value in wanted.items():
            assert got[name] == pytest.approx(value), (name, text)


def test_toxic_lexicon_against_counts(spark):
    docs = [(f"{'badword horrid' if i % 3 == 0 else 'good day'} common{i % 4} w{i}", int(i % 3 == 0)) for i in range(60)]
    train = spark.createDataFrame(docs, "text string, label int")
    found = toxicity.learn_lexicon(train)
    pos, neg = Counter(), Counter()
    for text, label in docs:
        terms = set(re.findall(r"[^\W_]+", text.lower()))
        terms |= {f"{k}:{w[:k]}" for w in terms if w.isalpha() for k in toxicity.STEMS if len(w) > k}
        (pos if label else neg).update(terms)
    n_pos, n_neg = sum(y for _, y in docs), sum(1 - y for _, y in docs)
    wanted = {t: math.log((pos[t] + 0.5) / (n_pos + 1)) - math.log((neg[t] + 0.5) / (n_neg + 1)) for t in pos if pos[t] >= max(3, 0.01 * n_pos)}
    assert found == pytest.approx({t: v for t, v in wanted.items() if v >= toxicity.MIN_LOG_ODDS})


def test_sharding(docs, pairs, empty):
    placed = sharding.place(docs, "doc_id")
    assert set(placed.columns) == set(docs.columns)
    rows = placed.collect()
    assert len(rows) == len(pairs) + 1 and all(r.shard in sharding.SHARDS for r in rows)
    assert sharding.place(empty, "doc_id").count() == 0
    table = sharding.lookup_table()
    owned = Counter(table)
    assert min(table) >= 0 and max(owned.values()) - min(owned.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * len(table)


def test_null_keys_are_placed_and_bad_tables_refused(spark):
    df = spark.createDataFrame([(None, 1), (5, 2)], "k long, v int")
    assert sharding.place(df, "k").where("shard is null").count() == 0
    for shards, size in ((["a"], 8), (["a", "a"], 7), ([], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, size)


def test_decontamination(spark, docs, empty):
    items = [(1, "What is the name of the river that runs past the old stone mill? The river Tarn."),
             (2, prose(77, 30) + ". " + prose(78, 25) + "."), (3, None), (4, ""), (None, "no id"), (5, prose(79, 80) + "\n" + prose(80, 5))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = prose(81, 400)
    leaked = [(900, f"{long} {items[0][1].upper()} {long}"), (901, f"{prose(82, 90)}\n{items[1][1]}\n{long}"), (902, items[5][1]),
              (903, prose(83, 300) + " the river that runs past"), (904, " ".join(items[1][1].split()[:12]) + " " + long)]
    made = spark.createDataFrame([(i, t, *[None] * 12) for i, t in leaked], SCHEMA)
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs.union(made), bench).collect()}
    assert found == {(900, 1), (901, 2), (902, 5)}
    two = decontamination.leaks(made, bench, max_items=2)
    assert {(r.doc_id, r.item_id) for r in two.collect()} == found
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(made, bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontamination.without_leaks(made, bench).collect()} == {903, 904}


def test_long_items_and_questions_alone_leak(spark):
    long, split = prose(90, 400), (prose(91, 20), prose(92, 60))
    bench = spark.createDataFrame([(1, prose(93, 200), prose(94, 200)), (2, *split), (3, long, "")],
                                  "item_id long, question string, answer string")
    items = {r.item_id: r for r in bench.collect()}
    docs = spark.createDataFrame([(10, f"{prose(95, 37)} {items[1].question} {items[1].answer} {prose(96, 300)}"),
                                  (11, f"{prose(97, 150)} {split[0]} {prose(98, 300)}"), (12, f"{prose(99, 100)} {long}"),
                                  (13, f"{prose(101, 90)} {split[1]}"), (14, prose(102, 900))], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
    assert set(found) == {(10, 1), (11, 2), (12, 3)}
    assert found[11, 2].question_overlap == 1 and found[11, 2].answer_overlap < 0.5 and found[10, 1].answer_overlap == 1


def test_short_questions_alone_are_no_leak(spark):
    bench = spark.createDataFrame([(1, f"Why?\nBecause {prose(750, 20)}"), (2, f"who am i\n{prose(751, 30)}"), (3, prose(752, 8) + "\n" + prose(753, 20))],
                                  "item_id long, text string")
    items = {r.item_id: r.text for r in bench.collect()}
    docs = spark.createDataFrame([(1, f"{prose(754, 60)} why {prose(755, 90)}"), (2, "who am i " * 20), (3, f"{prose(756, 50)} {items[1]} {prose(757, 20)}"),
                                  (4, items[2]), (5, f"{prose(758, 99)} {prose(752, 8)} {prose(759, 70)}")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == {(3, 1), (4, 2), (5, 3)}
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench, max_chars=150).collect()} == {(3, 1), (4, 2), (5, 3)}


def words_of(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def test_shares_against_sets_of_grams():
    def share(part, around):
        k = min(3, len(part))
        grams = {tuple(part[i:i + k]) for i in range(len(part) - k + 1)} if k else set()
        held = {tuple(around[i:i + k]) for i in range(max(1, len(around) - k + 1))}
        return len(grams & held) / len(grams) if grams else 0

    rng = random.Random(12)
    for i in range(60):
        vocab = [f"w{j}" for j in range(rng.choice([3, 8, 40]))]
        question, answer, around = (" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(3))
        index = decontamination.ItemIndex([1], [question], [answer], decontamination._hashed([f"{question} {answer}"]))
        got = index.judge(0, decontamination._hashed([around])[0])
        assert got == pytest.approx((share(question.split(), around.split()), share(answer.split(), around.split())))
        long = len(question.split()) >= decontamination.QUESTION_WORDS
        assert index.leaked(0, *got, 0.5, 0.8) == (min(got) >= 0.5 or long and got[0] >= 0.8)


def test_leaks_on_the_given_tables_hold_much_of_the_item(spark):
    bench = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: set(words_of(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = contract.op4_benchmark_decontamination(spark, SF).collect()
    assert found
    for r in found:
        item = set(bench[r.item_id])
        assert len(item & texts[r.doc_id]) >= min(decontamination.QUESTION_WORDS, len(item)) and len(item & texts[r.doc_id]) >= 0.5 * len(item)


def test_passes_do_not_change_scores(spark):
    common = prose(110, 30).split()
    texts = [f"{' '.join(common[i % 20:i % 20 + 8])} {prose(120 + i, 6 + i)}. {prose(160 + i, 5)}" for i in range(12)]
    bench = spark.createDataFrame([*enumerate(texts), (None, "no id")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{prose(200 + i, 70)} {' '.join(t.split()[1 + i % 4:])} {prose(300 + i, 70)}")
                                  for i, t in enumerate(texts)], "doc_id long, text string")
    one, five = (sorted(map(tuple, decontamination.leaks(docs, bench, max_items=m).collect())) for m in (100, 3))
    assert len(one) >= 8 and any(r[2] < 0.99 for r in one) and one == five


def test_retrieval_is_exact():
    rng = random.Random(9)
    vocab = [f"t{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 20))) for _ in range(40)]
    everything = decontamination._hashed(items)
    index = decontamination.ItemIndex(list(range(40)), items, [""] * 40, everything)
    texts = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (0, 3, 16, 17, 40, 100)]
    words = decontamination._hashed(texts)
    rows = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    got = {(r, s, i): round(x, 6) for r, s, i, x in index.retrieve(np.concatenate(words), rows, 16, 0.3)}
    expected = {}
    impact = {}
    for t in range(len(index.terms)):
        for j in range(index.first[t], index.first[t + 1]):
            impact[index.terms[t], index.items[j]] = index.impacts[j]
    for r, w in enumerate(words):
        for s in range(0, len(w), 8):
            if s and s + 8 >= len(w):
                continue
            inside = set(w[s:s + 16].tolist())
            for i in range(40):
                score = sum(v for (t, k), v in impact.items() if k == i and int(t) in inside)
                if score >= 0.3:
                    expected[r, s, i] = round(score, 6)
    assert {k[0::2] for k in got} == {k[0::2] for k in expected}
    assert all(abs(got[k] - expected[k]) < 1e-5 for k in set(got) & set(expected))


def check_packing(rows, texts, window):
    from tokenizers import Tokenizer
    import public_tokenizers
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*bpe.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts}
    at, of = {d: 0 for d in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {d: len(x) for d, x in ids.items()}
    for pieces in of.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window
    return [sum(n for _, n in x) for x in of.values()]


@pytest.mark.parametrize("window,shard_docs", [(2048, 2048), (64, 16)])
def test_packing(docs, pairs, empty, window, shard_docs):
    rows = packing.pack(docs.dropDuplicates(["doc_id"]), window=window, shard_docs=shard_docs).collect()
    fills = check_packing(rows, pairs, window)
    assert sum(n < window for n in fills) <= -(-len(pairs) // shard_docs)
    assert packing.pack(empty).count() == 0


def test_neighbours_share_words():
    topic = [np.arange(100 * t, 100 * t + 40, dtype=np.uint16) for t in (1, 2, 3)]
    tails = [topic[i % 3] for i in range(30)]
    for parts in packing.fill_windows(tails, 400, 16):
        assert len({i % 3 for i, _, _ in parts}) == 1


def test_neighbours_meet_whatever_the_number_of_shards(spark):
    rng = random.Random(17)
    topics = [[prose(500 + 40 * t + i, 2) for i in range(12)] for t in range(8)]
    docs = [(8 * i + t, " ".join(rng.choice(topics[t]) for _ in range(14))) for i in range(30) for t in range(8)]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    for shard_docs in (2048, 30):
        rows = packing.pack(made, window=512, shard_docs=shard_docs).collect()
        fills = check_packing(rows, docs, 512)
        held = Counter((r.sequence_id, r.doc_id % 8) for r in rows)
        most = {}
        for (sequence, _), n in held.items():
            most[sequence] = max(n, most.get(sequence, 0))
        assert sum(most.values()) > 0.6 * sum(held.values()) and len(fills) == len(most)


def test_one_hot_key_is_dealt_out():
    key = 5 << 48 | 6 << 32 | 7 << 16 | 8
    levels = [{5: 100, 9: 3}, {5 << 16 | 6: 100}, {5 << 32 | 6 << 16 | 7: 100}, {key: 100}]
    shards = packing.Shards(levels, 10)
    assert shards.number == 11 and len({shards.of(key, i) for i in range(100)}) == 10 and shards.of(9 << 48, 0) == 10


def test_all_ids_of_the_seed_are_asked_with_counts_of_all_tails():
    tails = [np.arange(i, 300 + i, dtype=np.uint16) for i in range(5)]
    counts = packing.Counts.of(tails + [np.arange(250, 300, dtype=np.uint16)] * 40)
    index = packing.TailIndex(tails, packing.QUERY_TERMS, counts)
    assert np.diff(index.query_at).tolist() == [300] * 5
    _, term, weight = packing._weights(tails, counts)
    for seed, tail in enumerate(tails):
        wanted = [sum(weight[(term == x) & (packing._pairs(tails)[0] == d)].sum() for x in tail) for d in range(5)]
        assert np.allclose(index.scores(seed), wanted)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == {d for d, (_, c) in brute.components(before.items()).items() if c == d}
        if name == "lines":
            gone = brute.repeated_lines(before.items())
            assert all(before[d] == after[d] for d in after if d not in gone)
        if name != "lines":
            assert all(before[d] == after[d] for d in after)
    assert len(after) > 100
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), after.items(), 2048)


def test_rows_without_an_id_are_filtered(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def left(df):
        assert df.columns == ["doc_id", "text", "lang"]
        return sorted((r.doc_id is None, r.doc_id or 0, r.text, r.lang) for r in df.collect())

    item, clean, copy = prose(700, 40) + ". " + prose(701, 9), prose(702, 90), prose(703, 90)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"{clean} {item}", "a"), (None, clean, "b"), (5, clean, "c"), (6, item, "d")]
    assert left(decontamination.without_leaks(frame(rows), bench)) == [(False, 5, clean, "c"), (True, 0, clean, "b")]

    rows = [(7, copy, "a"), (None, copy, "b"), (None, clean, "c"), (None, clean, "c"), (None, "short text", "d")]
    assert left(ngram_join.keep_one_per_component(frame(rows))) == [
        (False, 7, copy, "a"), (True, 0, clean, "c"), (True, 0, "short text", "d")]

    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    rng = random.Random(8)
    rows = [(i, prose(i, 20) + (" you are vilewretch horridfool" if i % 2 else " fine day"), "x") for i in range(400)]
    rows += [(None, prose(5000 + i, 20) + (" you are vilewretch horridfool" if i % 2 else " fine day"), "y") for i in range(40)]
    rng.shuffle(rows)
    kept = left(toxicity.without_toxic(frame(rows), labels))
    assert sum(r[0] for r in kept) == 20 and not any("vilewretch" in r[2] for r in kept)


def test_pipeline_runs_as_a_query(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
