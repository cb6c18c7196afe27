import math
from collections import Counter

import numpy as np
import pytest

from corpus_kb.llm import toxicity
from corpus_kb.llm.common import fold_of

N = toxicity.ORDER


def letters_of(word):
    padded = b" " * (N - 1) + word + b" "
    return [padded[i : i + N] for i in range(len(word) + 1)]


def plain_ratio(counts):
    """Log ratio of the classes for a letter after seven others, straight from the recursion; ``counts`` are Counters of grams by class."""
    kinds = set(counts[0]) | set(counts[1])
    orders = [kinds]
    continued = []
    for _ in range(N - 1):
        continued.append(Counter(g[1:] for g in orders[-1]))
        orders.append(set(continued[-1]))

    def shared(gram, level):
        if level == len(continued):
            return 1 / 256
        same = [n for g, n in continued[level].items() if g[:-1] == gram[:-1]]
        if not same:
            return shared(gram[1:], level + 1)
        n = continued[level][gram]
        return (max(n - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(same) * shared(gram[1:], level + 1)) / sum(same)

    def of_class(c, gram):
        same = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        backoff = shared(gram[1:], 0)
        if not same:
            return backoff
        return (max(c[gram] - toxicity.DISCOUNT, 0) + sum(min(n, toxicity.DISCOUNT) for n in same) * backoff) / sum(same)

    return lambda gram: math.log(of_class(counts[1], gram) / of_class(counts[0], gram))


WORDS = [("moron", 9, 0), ("moor", 0, 4), ("more", 2, 7), ("morning", 0, 5), ("idiot", 6, 1), ("größe", 1, 8), ("a", 3, 9), ("extraordinarily", 0, 1)]


@pytest.fixture(scope="module")
def model(spark):
    counts = toxicity.letter_counts(spark.createDataFrame([(bytearray(w.encode()), t, o) for w, t, o in WORDS], "word binary, toxic long, ordinary long"))
    found = toxicity.letter_ratios(counts, toxicity.lower_orders(counts)).toArrow()
    order = np.argsort(found["gram"].to_numpy().view(np.uint64))
    return toxicity.Ratio(found["gram"].to_numpy().view(np.uint64)[order], found["ratio"].to_numpy()[order], found["unseen"].to_numpy()[order])


def test_letter_model_against_the_plain_recursion(model):
    counts = (Counter(), Counter())
    for w, t, o in WORDS:
        for g in letters_of(w.encode()):
            for y, n in ((1, t), (0, o)):
                if n:
                    counts[y][g] += n
    plain = plain_ratio(counts)
    words = [w.encode() for w in ("moron", "morons", "moo", "more", "mort", "größe", "größer", "zz", "a", "extraordinarily", "ordinarily", "\U0001f600", "")]
    want = [sum(plain(g) for g in letters_of(w)) for w in words]
    assert model.of_words(words) == pytest.approx(want, abs=1e-4)

    text = " ".join(["Moron!", "more", "zz", "größer"])
    values = [math.log1p(toxicity.SHARE * math.expm1(sum(plain(g) for g in letters_of(w.encode())))) for w in ("moron", "more", "zz", "größer")]
    assert model.figures([text.encode(), b"", b" ,. "]) == pytest.approx([sum(values) / 4, 0, 0], abs=1e-5)


def test_seen_letters_leave_mass_to_the_backoff(spark):
    counts = toxicity.letter_counts(spark.createDataFrame([(bytearray(w.encode()), t, o) for w, t, o in WORDS], "word binary, toxic long, ordinary long"))
    lower = {r.lower.to_bytes(7, "big"): r.shared for r in toxicity.lower_orders(counts).collect()}
    sums: Counter = Counter()
    for gram, p in lower.items():
        sums[gram[:-1]] += p
    assert all(0 < s < 1 for s in sums.values())


def test_an_unseen_form_of_a_word_takes_after_the_class_of_its_letters(model):
    new_toxic, new_ordinary, unknown = model.of_words([b"morony", b"mornings", b"qqqq"])
    assert new_toxic > 1 > -0.5 > new_ordinary and abs(unknown) < 1


def test_contexts_beyond_16_bits_are_all_counted(spark):
    doc = next(i for i in range(100) if fold_of(i) == 1)
    many = 70_000
    docs = spark.createDataFrame([(doc, " ".join(f"w{k} often" for k in range(many)))], "doc_id long, text string")
    found = toxicity.continuations(docs, spark.createDataFrame([(doc, 0)], "doc_id long, label int")).where("word = cast('often' as binary)").collect()
    assert [(r.toxic, r.ordinary) for r in found] == [(0, many)]


def test_the_curve_never_falls():
    x = np.linspace(-1, 1, 200)
    for y in ((x > 0.2).astype(float), (x < 0.2).astype(float), np.zeros(200), np.ones(200)):
        p = toxicity.calibrate(x, y).score(np.array([-5, *x, 5, 1e9]))
        assert (np.diff(p) >= 0).all() and (0 <= p).all() and (p <= 1).all()
    assert toxicity.calibrate(np.zeros(0), np.zeros(0)).score(np.zeros(1))[0] == pytest.approx(0.5)
