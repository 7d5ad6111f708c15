"""Language, quality, mixing, personal data and toxicity on small tables, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import ODD
from waybill.llm import ftrl, language, mixing, personal_data, quality, toxicity


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


# Language


@pytest.fixture(scope="module")
def predicted(spark, sf_dir):
    return language.predict_all(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()


def test_language_of_held_out_rows(predicted, documents):
    lang = {i: x for i, _, x, _ in documents}
    assert len(predicted) == len(documents)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in predicted)
    held = [r for r in predicted if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in predicted)


def test_language_learns_from_text_and_lang_of_other_folds_only(spark, make, documents, predicted):
    """Other labels in the held-out fold, other sources and other ids of the same fold change nothing."""
    rows = [(i, t, "xx" if fold(i, 5) == 0 else x, "other") for i, t, x, _ in documents]
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_all(make(rows)).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in predicted}


def test_language_of_odd_rows(odd, empty, spark):
    rows = language.predict_all(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3, 4)} == {("und", 0.0)}
    assert {r.lang_pred for r in rows if r.doc_id not in (1, 2, 3, 4)} == {"en"}
    assert language.predict_all(empty).count() == 0


def test_ftrl_gives_sparse_weights_and_temperature_the_right_scale():
    r = np.random.default_rng(1)
    data = []
    for _ in range(1500):
        y = int(r.integers(3))
        at = np.sort(r.choice(np.arange(3, 300), 5, replace=False))
        data.append((np.concatenate(([y if r.random() < 0.9 else int(r.integers(3))], at)), np.ones(6), y))
    w = ftrl.FollowTheLeader(300, 3, l1=5.0).fit(data, 2).weights()
    assert (w[3:] == 0).mean() > 0.8 and all(w[k].argmax() == k for k in range(3))
    p = r.dirichlet([1, 1], 4000)
    y = (r.random(4000) < p[:, 1]).astype(int)
    assert abs(ftrl.temperature(3 * np.log(p), y) - 3) < 0.3


# Quality


def plain_statistics(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    repeated = {k + d for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for d in range(5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(repeated)


def test_statistics(documents):
    r = random.Random(1)
    odd = ["\n".join(r.choices(["a b c d e f", "x", "", " ", "a b c d e", "#$ é"], k=8)) for _ in range(300)]
    for text in [*odd, *(t for _, t, *_ in ODD), *(t for _, t, *_ in documents)]:
        assert quality.statistics(text or "")[:5] == plain_statistics(text)


def test_forest_is_deeper_for_ordinary_rows():
    r = np.random.default_rng(2)
    rows = r.normal(size=(3000, 4))
    forest = quality.grow_forest(rows, 64)
    assert forest.scores(np.full((1, 4), 8.0))[0] > 0.65 > 0.5 > forest.scores(np.zeros((1, 4)))[0]
    # Path lengths by walking the tree row by row.
    for row in rows[:5]:
        total = 0.0
        for f, s, p in zip(forest.feature, forest.split, forest.path):
            node = 0
            while f[node] >= 0:
                node = 2 * node + 1 + int(row[f[node]] >= s[node])
            total += p[node]
        assert np.isclose(forest.scores(row[None])[0], 2 ** (-total / 64 / forest.norm))
    assert quality.grow_forest(rows[:1]) is None


def test_threshold_keeps_good_rows():
    good, bad = np.zeros(10, int), np.zeros(10, int)
    good[[2, 3, 7]], bad[[3, 7, 8]] = (500, 495, 5), (1, 4, 5)
    assert quality.threshold(good, bad) == 4
    assert quality.threshold(good, bad, 0.001) == 8
    assert quality.threshold(good, np.zeros(10, int)) == 10


def test_quality(spark, sf_dir, odd, empty, documents):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rows = {r.doc_id: r for r in quality.judge_quality(read("documents"), read("labels")).collect()}
    for i, text, *_ in documents:
        n = plain_statistics(text)
        assert tuple(rows[i])[1:6] == n
        assert rows[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (rows[i].base_failed and rows[i].kept)
    good = [r.doc_id for r in read("labels").where("quality = 1").collect()]
    assert np.mean([rows[i].kept for i in good]) > 0.9
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, 1), (None, 1), (8, None)], "doc_id long, quality int")
    assert quality.judge_quality(odd, labels).where("doc_id <> 6 or doc_id is null").count() == len(ODD) - 1
    assert quality.judge_quality(odd, labels.limit(0)).where("kept").count() == 0
    assert quality.judge_quality(empty, labels).count() == 0


# Mixing


def test_targets():
    from waybill.session import build_session

    spark = build_session()
    sizes = {"a": 1000, "b": 10, "c": 400, "d": 0, None: 500}
    rows = mixing.with_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    got = {r.source: r.target for r in rows}
    # Water filling: the full sources stop, what they leave is dealt again.
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * share for s in open_}
    assert got == pytest.approx(target)


def test_mix(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing.plan(docs).collect()
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in plan:
        taken[r.source] += r.copies * r["size"]
        target[r.source], longest[r.source] = r.target, max(longest[r.source], r["size"])
        assert 0 <= r.copies <= 2
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * longest[s]
    assert sorted(map(tuple, plan)) == sorted(map(tuple, mixing.plan(docs.repartition(7)).collect()))
    copies = Counter({r.doc_id: r.copies for r in plan})
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    assert mixing.mixed(odd).columns == odd.columns
    assert sum(r.copies for r in mixing.plan(odd).collect()) == mixing.mixed(odd).count()
    assert mixing.mixed(empty).count() == mixing.plan(empty).count() == 0


# Personal data

#: The patterns of the contract.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    doubled = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits))))
    return {
        "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in value.split(".")),
        "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    return sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text or "") if valid(kind, m[0]))


def test_base_spans(spark, documents):
    r = random.Random(5)
    odd = ["".join(r.choices("ab1 2.3@-+4()é😀0\n_", k=r.randint(0, 80))) for _ in range(1500)]
    fixed = ["4111 1111 1111 1111", "1" * 3000 + ".2.3.4", "1 " * 20_000, "000255.1.1.1 256.1.1.1 1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "@" * 3000 + "+" * 3000]
    texts = [*odd, *fixed, *(t for _, t, *_ in ODD), *(t for _, t, *_ in documents)]
    rows = personal_data.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = base_spans(texts[row.doc_id])
        assert [row[f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in spans) for k in BASE]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))


def test_contexts_find_unseen_identifiers(spark, odd, empty):
    seeds = ["+1 (974) 555-3436", "+44 20 7946 0958", "+1 (974) 555-1111", "+49 30 901820 11", "+49 30 901820 22", "+1 (201) 555-0000"]
    texts = [f"please call {x} now" for x in seeds] + ["please call 030 901820 now", "version 030 901820 is out", "mail 12 34"]
    rows = spark.createDataFrame([(k, t, "keep") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in personal_data.personal_data(rows).collect()}
    assert got[6] == "phone:12:22" and got[7] == got[8] == ""
    clean = {r.doc_id: (r.text, r.spans) for r in personal_data.redacted(rows).collect()}
    assert clean[6] == clean[0] == ("please call [PHONE] now", "keep") and clean[7] == (texts[7], "keep")
    assert personal_data.personal_data(odd).count() == len(ODD)
    assert personal_data.redacted(odd).columns == odd.columns
    assert personal_data.redacted(empty).count() == personal_data.personal_data(empty).count() == 0


def luhn(body):
    digits = [int(c) * (1 + (i + len(body)) % 2) for i, c in enumerate(body)]
    return body + str(-sum(d - 9 * (d > 9) for d in digits) % 10)


def test_words_beside_everything_find_no_decoys(spark):
    """Numbers after "the" are cards or decoys; "the" stands before much else, so it tells nothing."""
    r = random.Random(1)
    cards = [luhn("".join(r.choice("123456789") for _ in range(15))) for _ in range(60)]
    decoys = [c[:-1] + str((int(c[-1]) + 3) % 10) for c in cards[:25]]
    texts = [f"we saw the {c} and the house on the hill" for c in cards + decoys] + ["the words and the rest of the day"] * 40 + cards[:9] + decoys[:9]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.personal_data(rows).collect()}
    assert all(got[k].startswith("card:") and "," not in got[k] for k in range(60))
    assert not any(got[k] for k in range(60, 125)) and not any(got[k] for k in range(len(texts) - 9, len(texts)))


@pytest.mark.parametrize("hidden", [5, 8])
def test_hidden_identifiers_are_found_by_their_contexts(spark, hidden):
    """One in `hidden` numbers is written so that no fixed pattern finds it; of these 90 % and more are found, and nothing else is added."""
    r = random.Random(hidden)
    frames = ["reach me at {} any day", "telefon: {} (office)", "my mobile {} works", "call {} for help"]
    texts, want = [], set()
    for k in range(200):
        number = "".join(r.choice("0123456789") for _ in range(8))
        if k % hidden == 0:
            value = f"0{number[:3]} {number[3:]}"
            want.add(k)
        else:
            value = f"+49 {number[:3]} {number[3:]}"
        texts.append(r.choice(frames).format(value) + " and other words at any day for the help of me")
    texts += [f"order {r.randrange(10 ** 8, 10 ** 9)} left at noon, version 1{r.randrange(10 ** 7)} of {r.randrange(10 ** 8)}" for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.personal_data(rows).collect()}
    added = {k for k, spans in got.items() if spans and (k in want or k >= 200)}
    assert len(added & want) >= 0.9 * len(want) and len(added & want) >= 0.9 * len(added)


def test_doubled_letters_of_words_that_count(letters):
    suspects = {toxicity.collapsed(w): w for w in ("idiot", "worthless", "scum")}
    texts = ["an iddiot and a letter", "worthless book", "worthles", "sccum"]
    assert toxicity.restore(texts, letters, {}, suspects) == ["an idiot and a letter", "worthless book", "worthles", "scum"]
    assert toxicity.restore(texts, letters, {}) == texts


@pytest.mark.parametrize("text", ["good book!", "(see it)", "%%% *** ###", "money$$$ noise***", "a b", "1999 and 2001", "e.g. this", "what?!", "* item * item"])
def test_plain_texts_stay(letters, text):
    assert toxicity.restore([text], letters, {}) == [text]


def test_native(spark, sf_dir):
    plan = personal_data.personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Toxicity


@pytest.fixture(scope="module")
def letters(documents):
    totals = np.zeros((2, toxicity.COUNTERS), np.int64)
    toxicity.gram_totals([t for _, t, *_ in documents] + ["idiot worthless stupid scum"] * 50, totals)
    return toxicity.LetterModel(totals.astype(float))


@pytest.mark.parametrize("seen, meant", [
    ("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("iiidiooot", "idiot"), ("w0rthl3ss", "worthless"), ("$cum", "scum"),
    ("stuuupid", "stupid"), ("S-C-U-M", "scum"), ("i  d  i  o  t", "idiot"), ("i . d . i . o . t", "idiot"), ("s\nc\nu\nm", "scum"), ("sc*m", "scum"),
    ("worthle$$", "worthless")])
def test_restores_disguised_words(letters, seen, meant):
    assert toxicity.restore([f"the {seen} and that"], letters, {}) == [f"the {meant} and that"]


def test_leaves_plain_text_alone(letters):
    plain = "the plain text, as it is: 12 34 a b; élan!! ###"
    assert toxicity.restore([plain, "", "x" * 2], letters, {}) == [plain, "", "xx"]


def test_viterbi_finds_the_best_path(letters):
    """All paths of a small lattice, one by one."""
    def paths(token):
        if not token:
            return [((0, 0, 0), 0.0, "")]
        out = []
        for (a, b, c), cost, text in paths(token[:-1]):
            char = token[-1]
            for x, extra in [(y, toxicity.SWAP) for y in toxicity.LEET.get(char, "")] + ([(char, 0.0)] if char.isalpha() else []):
                d = toxicity._symbol(x)
                out.append(((b, c, d), cost + extra + letters.cost(a, b, c, d), text + x))
                if text.endswith(x) and (char in "" or not char.isalpha() and len(toxicity.LEET.get(char, "")) > 1):
                    out.append(((a, b, c), cost + extra + toxicity.REPEAT, text))
        return out
    for token in ("th1s", "1d10t", "l1!t"):
        best = min(paths(token), key=lambda p: p[1] + letters.cost(*p[0], 0))
        assert toxicity.decode(token, letters) == best[2]


def test_toxicity(spark, make, odd, empty):
    r = random.Random(8)
    plain = ["".join(r.choices("aeioustrn", k=6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join([*r.choices(plain, k=30), *([r.choice(["idiot", "scum", "moron"])] if bad else [])]), "en", "a"))
        labels.append((i, int(bad)))
    hidden = [(1000, " ".join([*plain[:20], "1d10t"]), None, None), (1001, " ".join([*plain[:20], "s c u m"]), None, None), (1002, " ".join(plain[:20]), None, None)]
    labels = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    docs = make([*rows, *hidden, (1003, None, None, None), (1004, "", None, None)])
    scored = {x.doc_id: x for x in toxicity.score_all(docs, labels).collect()}
    assert all(scored[i].held_out == (fold(i, 3) == 1) for i in scored)
    held = [i for i in range(600) if scored[i].held_out]
    assert [scored[i].predicted for i in held] == [int(i % 5 == 0) for i in held]
    assert [scored[i].predicted for i in range(1000, 1005)] == [1, 1, 0, 0, 0]
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in scored.values())
    assert toxicity.score_all(odd, labels.limit(0)).where("predicted = 0").count() == len(ODD)
    assert toxicity.score_all(empty, labels).count() == 0


# Plain versions of the language model's parts


def plain_grams(text):
    """Features of a text's 1- to 3-grams, in whole numbers of 32 bits."""
    kept = []
    for c in f" {text.lower()} ":
        if c.isalpha():
            kept.append(c)
        elif not kept or kept[-1] != " ":
            kept.append(" ")
    found = Counter()
    for n in (1, 2, 3):
        for k in range(len(kept) - n + 1):
            h = 0
            for c in kept[k:k + n]:
                h = (h * 0x01000193 + ord(c)) % 2 ** 32
            h = ((h ^ h >> 15) * 0x2C1B3C6D + n) % 2 ** 32
            found[h * 0x9E3779B1 % 2 ** 32 >> 16] += 1
    return found


@pytest.mark.parametrize("texts", [["Ab, b--a!"], ["x", "", "12", "Ünï 中文 a b c"], ["The quick brown fox"] * 2 + ["  spaces\n\tand\x00more  "]])
def test_gram_counts(texts):
    for text, (found, counts) in zip(texts, language.gram_counts(texts), strict=True):
        expected = plain_grams(text) if any(c.isalpha() for c in text) else {}
        assert dict(zip(found.tolist(), counts.tolist())) == dict(expected)


def test_tf_idf_row():
    idf = np.linspace(1, 3, language.FEATURES)
    rows, values = language.tf_idf(np.array([3, 70]), np.array([1, 5]), idf)
    plain = [(1 + np.log(1)) * idf[3], (1 + np.log(5)) * idf[70]]
    size = sum(v * v for v in plain) ** 0.5
    assert rows.tolist() == [3, 70, language.FEATURES] and values.tolist() == pytest.approx([plain[0] / size, plain[1] / size, 1.0], rel=1e-6)


def test_steps_of_the_leader():
    """Two steps against the rule, one coordinate and class at a time."""
    rate, offset, l1, l2 = 0.7, 1.3, 0.04, 0.02
    leader = ftrl.FollowTheLeader(4, 3, rate, offset, l1, l2)
    z, n = [[0.0] * 3 for _ in range(4)], [[0.0] * 3 for _ in range(4)]

    def weight(i, c):
        sign = 1 if z[i][c] > 0 else -1
        return 0.0 if abs(z[i][c]) <= l1 else (sign * l1 - z[i][c]) / ((offset + n[i][c] ** 0.5) / rate + l2)

    for rows, values, label in (([0, 2], [0.6, -0.8], 1), ([2, 3], [1.0, 0.5], 0), ([0, 3], [0.2, 0.9], 1)):
        leader.learn(np.array(rows), np.array(values), label)
        w = {(i, c): weight(i, c) for i in rows for c in range(3)}
        logits = [sum(v * w[i, c] for i, v in zip(rows, values)) for c in range(3)]
        total = sum(np.exp(x) for x in logits)
        for i, v in zip(rows, values):
            for c in range(3):
                g = v * (np.exp(logits[c]) / total - (c == label))
                z[i][c] += g - ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / rate * w[i, c]
                n[i][c] += g * g
    np.testing.assert_allclose(leader.weights(), [[weight(i, c) for c in range(3)] for i in range(4)], rtol=1e-9)


def test_temperature_is_within_its_limits():
    r = np.random.default_rng(1)
    labels = r.integers(0, 3, 400)
    logits = r.normal(size=(400, 3)) + 2 * np.eye(3)[labels]
    heat = ftrl.temperature(logits * 5, labels)
    loss = lambda t: -np.log(ftrl.softmax(logits * 5 / t)[np.arange(400), labels]).mean()
    assert loss(heat) <= min(loss(heat * 1.01), loss(heat * 0.99)) + 1e-9 and 2 < heat < 10
    assert ftrl.temperature(np.eye(3)[labels], labels) == 1.0  # no error to learn from


def plain_decode(token, model, least_run=3):
    """All readings of a disguised word, the cheapest first."""
    apart = [c for c in re.split(r"[ .\-_*\n\t]+", token)]
    if len(apart) > 2 and all(len(c) == 1 for c in apart):
        token = "".join(apart)
    runs = {m[1] for m in re.finditer(r"(.)\1+", token) if len(m[0]) >= least_run}
    readings = [("", 0.0)]
    for c in token:
        options = [(x, toxicity.SWAP) for x in toxicity.LEET.get(c, "")] + ([(c, 0.0)] if c.isalpha() else [])
        if not options:
            options = [("", toxicity.DROP)] + [(v, toxicity.HIDE) for v in toxicity.VOWELS if c in toxicity.HIDING]
        readings = [x for word, cost in readings for letter, extra in options for x in (
            [(word + letter, cost + extra)] + ([(word, cost + extra + toxicity.REPEAT)] if letter and word.endswith(letter) and (c in runs or len(options) > 1) else []))]

    def total(word, cost):
        s = [0, 0, 0, *map(toxicity._symbol, word), 0]
        return cost + sum(model.cost(*s[k:k + 4]) for k in range(len(s) - 3))

    return min(total(*x) for x in readings), {w for w, c in readings if abs(total(w, c) - min(total(*x) for x in readings)) < 1e-9}


@pytest.mark.parametrize("token", ["i d i o t", "i  d.i -o t", "iiidiot", "stuuupid", "sc*m", "w0rth1ess", "a$$", "$cuuum", "1l1l"])
def test_decoding_is_the_cheapest_reading(letters, token):
    _, best = plain_decode(token, letters)
    assert toxicity.decode(token, letters) in best
    _, best = plain_decode(token, letters, 2)
    assert toxicity.decode(token, letters, 2) in best
