import math
import re
from collections import Counter

from tessera.llm import kneser_ney
from tests.llm import docs


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def discounts(n):
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
    out = {}
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else k / 2
        out[k] = min(max(d, 0.05), k)
    return lambda c: out[min(c, 3)] if c else 0.0


class Brute:
    def __init__(self, texts):
        self.c, self.b = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            self.b.update(zip([None, *w], w))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.again = Counter(w for _, w in self.b)
        self.d = discounts(Counter(self.b.values()))
        self.e = discounts(Counter(self.again.values()))
        total = sum(self.again.values())
        self.unseen = sum(self.e(a) for a in self.again.values()) / total / (self.v + 1) if total else 1 / (self.v + 1)
        self.cont = {w: (a - self.e(a)) / total + self.unseen for w, a in self.again.items()}
        self.ctx, self.back = Counter(), Counter()
        for (h, _), c in self.b.items():
            self.ctx[h] += c
            self.back[h] += self.d(c)

    def p(self, h, w):
        low = self.cont.get(w, self.unseen)
        if h not in self.ctx:
            return low
        return (self.b[h, w] - self.d(self.b[h, w])) / self.ctx[h] + self.back[h] / self.ctx[h] * low

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(h, x)) for h, x in zip([None, *w], w))

    def base(self, text):
        return sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in tokens(text))


TRAIN = ["the cat sat on the mat", "The cat ran", "a dog sat on the cat", None, "", "été là été là", "a b a b a b c d e f g h"] * 2 + [docs.LONG]
TEST = ["the cat sat", "unknown words here", None, "", "the THE the", "été", docs.LONG, "cat\tsat\n on   the mat"]


def test_scores_against_brute_force(spark, monkeypatch):
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3))
    brute = Brute(TRAIN)
    got = kneser_ney.score(spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEST)], "doc_id long, text string, score int"), model).collect()
    assert len(got) == len(TEST)
    for r in got:
        t = TEST[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(w in brute.c for w in tokens(t)), brute.n)
        assert math.isclose(r.score, brute.score(t), rel_tol=1e-9) and math.isclose(r.base_score, brute.base(t), rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    brute = Brute(TRAIN)
    for h in (None, "the", "a", "never seen"):
        total = sum(brute.p(h, w) for w in brute.c) + brute.p(h, "a word outside")
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_awkward_rows_and_empty_training(spark):
    d = docs.table(spark)
    got = kneser_ney.score(d, kneser_ney.fit(d)).collect()
    assert len(got) == len(docs.ROWS) and all(r.n_known == r.n_tokens and r.score < 0 for r in got)
    nothing = kneser_ney.score(d, kneser_ney.fit(docs.empty(spark))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in nothing)
    assert kneser_ney.score(docs.empty(spark), kneser_ney.fit(d)).count() == 0
