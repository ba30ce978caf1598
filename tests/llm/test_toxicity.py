import math
import random
import re

import pytest

from covenant.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_automaton_like_distances():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    terms = sorted({(word(rng.randint(3, 11)), rng.random() < 0.4) for _ in range(40)})
    lexicon = toxicity.Lexicon(terms)
    for _ in range(1500):
        w = word(rng.randint(0, 13)) if rng.random() < 0.5 else rng.choice(terms)[0] + word(rng.randint(0, 2))
        near = {}
        for k, (t, stem) in enumerate(terms):
            d = min(distance(t, w)) if stem else distance(t, w)[-1]
            if d <= toxicity.edits(t):
                near[k] = d
        assert lexicon.find(w) == {k: d for k, d in near.items() if d == min(near.values())}


def test_mention():
    at = lambda t: toxicity.mention(t, t.index("idiot"), t.index("idiot") + 5)
    assert at('he wrote "you idiot" twice') and at("« idiot »") and at("the word idiot is old") and at("“an idiot”")
    assert not at("you are an idiot") and not at('"fine" you idiot') and not at('an idiot, "he" is')


def frame(spark):
    rng = random.Random(4)
    plain = ["ka", "lo", "mira", "tessa", "ulo", "venda", "orin", "pal", "quib", "rasto"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) + rng.choice(plain) for _ in range(rng.randint(5, 40))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zzbadword", "grimble", "zwork" + rng.choice(plain)]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_and_scores(spark):
    rows, labels = frame(spark)
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marked)
    assert {t for t, _ in model.terms} >= {"zzbadword", "grimble"} and any(t.startswith("zwor") for t, stem in model.terms if stem)
    truth = dict(labels)
    got = toxicity.score(docs, model).collect()
    assert sum((r.score >= 0.7) == truth[r.doc_id] for r in got) / len(got) > 0.98
    odd = [(1, "some zzbadw0rd here grimbl"), (2, 'they wrote "zzbadword" in it'), (3, None), (4, ""), (None, "x " * 90000 + "grimble zzbadword"), (6, "GRIMBLEİ")]
    extra = spark.createDataFrame([(i, t, "old", 1) for i, t in odd], "doc_id long, text string, score string, term int")
    by = {r.doc_id: r for r in toxicity.score(extra, model).collect()}
    assert len(by) == len(odd) and by[3].score == by[4].score == model.base < 0.7
    assert by[1].score >= 0.7 and by[None].score >= 0.7 and by[6].score >= 0.7 and by[2].score < 0.7 and by[2].hits[0].mention
    assert toxicity.score(extra.limit(0), model).count() == 0
    none = toxicity.learn(docs.limit(0), marked)
    assert none.terms == [] and toxicity.score(extra, none).count() == len(odd)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op2_toxicity"](spark, sf)
    both = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in both)
    assert hit / sum(r.toxic for r in both) > 0.9 and hit / sum(r.predicted for r in both) > 0.7


@pytest.mark.parametrize(("sf", "recall", "precision", "by_language"), [("sf0.1", 0.9, 0.9, 0.8), ("sf0.01", 0.75, 0.95, None)])
def test_held_out_by_language(spark, sf, recall, precision, by_language):
    """Precision and recall of held-out rows, on both sizes, and in each language of the larger."""
    folder = f"/root/testdata/{sf}"
    got = queries.QUERIES["op2_toxicity"](spark, folder).where("held_out").select("doc_id", "predicted")
    marked, docs = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "documents"))
    rows = got.join(marked.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()

    def shares(some):
        hit = sum(r.predicted and r.toxic for r in some)
        return hit / sum(r.toxic for r in some), hit / max(1, sum(r.predicted for r in some))

    found, right = shares(rows)
    assert found >= recall and right >= precision
    for lang in {r.lang for r in rows} if by_language else ():
        assert min(shares([r for r in rows if r.lang == lang])) >= by_language, lang


def chance(count, expected):
    """Of a Poisson law, that as many or more come: its tail added up."""
    return math.fsum(math.exp(i * math.log(expected) - expected - math.lgamma(i + 1)) for i in range(count, count + int(4 * expected) + 400))


def test_levels():
    rng = random.Random(8)
    for _ in range(3000):
        count, expected = rng.randint(1, 60), 10 ** rng.uniform(-6, 1.7)
        got = -math.log10(max(chance(count, expected), 1e-300))
        if min(abs(got - x) for x in toxicity.LEVELS) > 1e-6:
            assert toxicity.level(count, expected) == sum(got > x for x in toxicity.LEVELS)
    # one hit says more in a short text than in a long one, and many say more than one
    assert toxicity.level(1, 0.02) > toxicity.level(1, 2.0) == 0 < toxicity.level(12, 2.0)
    assert toxicity.level(10**6, 1.0) == len(toxicity.LEVELS) and toxicity.level(3, 10.0**6) == 0


def test_one_stem_instead_of_its_words():
    words = [("grimbleka", False, 5), ("grimblelo", False, 6), ("grimbly", False, 4), ("other", False, 7)]
    stems = [("grim", True, 20), ("grimb", True, 20), ("grimbl", True, 20), ("grimble", True, 16), ("othe", True, 7)]
    assert toxicity.choose(words + stems) == [("grimbl", True), ("other", False)]
    assert toxicity.choose([]) == []


def quoted(text, start, end, reporting):
    """Mention from its definition: a pair of marks on the line around the hit, in
    the window, or a word of reporting among the three before it."""
    before = text[max(0, start - 60) : start].split("\n")[-1]
    after = text[end : end + 60].split("\n")[0]
    for opening, closing in {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’", "‹": "›"}.items():
        shut = any(c in after for c in closing)
        if opening == closing:
            is_open = before.count(opening) % 2 == 1
        else:
            is_open = opening in before and not set(closing) & set(before[before.rfind(opening) + 1 :])
        if is_open and shut:
            return True
    return bool(set(re.findall(r"[^\W\d_]+", before)[-3:]) & reporting)


def brute_score(text, model, near):
    """Hits by edit distances, their weights by density joined as independent causes."""
    counts = {}
    text = (text or "").lower()
    words = len(re.findall(r"[^\W\d_]+", text))
    for m in re.finditer(r"[^\W\d_]+", text):
        for k, e in near(m[0]).items():
            at = (k, e, quoted(text, m.start(), m.end(), model.reporting))
            counts[at] = counts.get(at, 0) + 1
    best = {}
    for (k, e, q), n in counts.items():
        rare = chance(n, model.rates[k, e] * words)
        for step, power in enumerate((0, 1, 3, 6, 10)):
            if rare <= 10.0**-power or not step:
                best[k, q] = max(best.get((k, q), 0), model.weights.get((k, e, step, q), 0))
    clean = 1 - model.base
    for w in best.values():
        clean *= 1 - w
    return 1 - clean


def test_query_like_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    known = {}

    def near(word):
        if word not in known:
            found = {}
            for k, (t, stem) in enumerate(model.terms):
                most = toxicity.edits(t)
                # fewer letters shared than this cannot be within the edits
                if len(word) < len(t) - most or not stem and len(word) > len(t) + most or sum(c in word for c in t) < len(t) - most:
                    continue
                row = distance(t, word)
                d = min(row) if stem else row[-1]
                if d <= most:
                    found[k] = d
            known[word] = {k: d for k, d in found.items() if d == min(found.values())}
        return known[word]

    got = {r.doc_id: r.score for r in queries.QUERIES["op2_toxicity"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys() and model.terms
    for i, t in texts.items():
        assert got[i] == pytest.approx(brute_score(t, model, near), abs=1e-9), i


def test_learned_reporting(spark):
    """A word that stands before hits in clean rows only turns them into mentions."""
    rows, labels = frame(spark)
    rng = random.Random(6)
    for i in range(1000, 1020):
        rows.append((i, " ".join(rng.choice(["mira", "ulo"]) + rng.choice(["ka", "orin", "pal", "lo"]) + str(rng.random())[2:6].translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(12)) + " vorgaf grimble"))
        labels.append((i, 0))
    rows += [(i, f"{rows[j][1]} grimble") for i, j in zip(range(2000, 2400), range(400), strict=True)]
    labels += [(i, 1) for i in range(2000, 2400)]
    # few clean rows hold the term, so that it stays one of the lexicon
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "grimble" in {t for t, _ in model.terms} and "vorgaf" in model.reporting and "vorgaf" not in toxicity.REPORTING
    given = [(1, "mira vorgaf grimble"), (1, "mira vorgaf grimble"), (2, "mira ulo grimble")]
    got = toxicity.score(spark.createDataFrame(given, "doc_id long, text string"), model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.score, r.hits[0].mention))
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and by[1][0][1] and not by[2][0][1] and by[1][0][0] < by[2][0][0]
