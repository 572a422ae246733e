import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from snapscope.llm import quality

from tests.llm.cases import documents, odd_texts, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


def test_base_counts_of_odd_texts(spark):
    texts = odd_texts() + ["a b c a b c d", "x\x1cy z\x85w", "one\n\n one\none\none"]
    got = {r.doc_id: r for r in quality.quality(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)
        assert not (r.base_failed and r.kept)


def test_junk_goes_and_clean_stays(spark):
    clean = [prose(k, 60 + 7 * k) for k in range(150)]
    junk = ["".join(w + "$$$ " for w in prose(900 + k, 120).split()) for k in range(8)] + [prose(950 + k, 150).upper() + "!! !!" for k in range(8)]
    docs = documents(spark, clean + junk).union(documents(spark, clean[:40], list(range(1000, 1040)), None, None))
    kept = {r.doc_id for r in quality.kept(docs).collect()}
    assert kept == set(range(150)) | set(range(1000, 1040))
    assert quality.kept(docs).columns == docs.columns
    assert quality.quality(docs.limit(0)).count() == 0


def test_estimate_agrees_with_a_plain_concentration_of_all_rows(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 0.3, (400, quality.DIM)) @ np.tril(r.normal(0, 1, (quality.DIM, quality.DIM))) + 1
    x[:60] += 8
    rows = spark.createDataFrame([("l", "s", v.tolist()) for v in x], "g_lang string, g_source string, x array<double>")
    model = quality.estimate(rows).first()
    inside = x[60:]
    assert np.abs(np.array(model.center) - inside.mean(axis=0)).max() < 0.25
    whiten = np.array(model.whiten).reshape(quality.DIM, quality.DIM)
    d2 = (((x - model.center) @ whiten.T) ** 2).sum(axis=1)
    assert (d2[:60] > quality.CUTOFF).all() and (d2[60:] <= quality.CUTOFF).mean() > 0.97


def test_normal_rows_are_rejected_as_the_cutoff_means(spark):
    x = [F.randn(7 + i) * 3 for i in range(quality.DIM)]
    rows = spark.range(0, 100_000, 1, 4).select(F.lit("l").alias("g_lang"), F.lit("s").alias("g_source"), F.array(*x[:-1], x[-1] + 2 * x[0]).alias("x"))
    far = rows.crossJoin(quality.estimate(rows).drop("g_lang", "g_source")).where(quality._distance2() > quality.CUTOFF).count()
    assert 65 <= far <= 140


def plain_estimate(x, language):
    """Concentration with the language's rows counted in, by whole sorted rows instead of bins."""
    floors = np.diag(np.square(quality.FLOORS))
    def quartiles(v):
        q = np.quantile(v, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
        return q[1], ((q[2] - q[0]) / 1.349) ** 2 + np.diag(floors)
    (m0, v0), (m, v) = quartiles(language), quartiles(x)
    k, n = quality.PRIOR, len(x)
    w = n / (n + k)
    center, cov, logdet = w * m + (1 - w) * m0, np.diag(w * v + (1 - w) * v0), np.inf
    t = np.diag(v0 * quality.NEAREST_VARIANCE)
    while True:
        d2 = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
        order, h = np.argsort(d2), quality.SHARE * n
        part = np.clip(h - np.arange(n), 0, 1)
        near = x[order]
        c = (part @ near + k * m0) / (h + k)
        s = ((near * part[:, None]).T @ near + k * (t + np.outer(m0, m0))) / (h + k) - np.outer(c, c) + floors
        new = np.linalg.slogdet(s)[1]
        if new >= logdet - quality.FALL:
            scale = max(1, (n * np.median(d2) / quality.CHI2_MEDIAN + k / quality.NEAREST_VARIANCE) / (n + k))
            return center, cov * scale
        center, cov, logdet = c, s, new


def test_every_group_is_estimated_whatever_its_size(spark):
    """Against the plain estimate: groups of one row, of some and of many, in a language of their own or not."""
    r = np.random.default_rng(3)
    mix = np.tril(r.normal(0, 0.4, (quality.DIM, quality.DIM)))
    sizes = {("l", "one"): 1, ("l", "two"): 2, ("l", "few"): 9, ("l", "some"): 60, ("l", "many"): 700, ("m", "alone"): 1, ("m", "three"): 3, ("n", "own"): 99, ("o", "own"): 101}
    x = {g: r.normal(0, 1, (n, quality.DIM)) @ mix + k / 3 for k, (g, n) in enumerate(sizes.items())}
    x[("l", "few")][0] += 30
    x[("l", "one")] += 30
    rows = spark.createDataFrame([(*g, v.tolist()) for g, values in x.items() for v in values], "g_lang string, g_source string, x array<double>")
    got = {(m.g_lang, m.g_source): m for m in quality.estimate(rows).collect()}
    assert got.keys() == sizes.keys()
    for g, values in x.items():
        center, cov = plain_estimate(values, np.concatenate([v for other, v in x.items() if other[0] == g[0]]))
        whiten = np.array(got[g].whiten).reshape(quality.DIM, quality.DIM)
        plain = np.einsum("ij,jk,ik->i", values - center, np.linalg.inv(cov), values - center)
        ours = (((values - got[g].center) @ whiten.T) ** 2).sum(axis=1)
        limit = quality.CUTOFF * (1 + quality.SLACK / got[g].lang_rows)
        clear = np.abs(plain / limit - 1) > 0.15  # bins round distances
        assert ((plain <= limit) == (ours <= limit))[clear].all() and clear.mean() > 0.9 or len(values) < 3
        assert np.allclose(ours, plain, rtol=0.25, atol=0.5)
        if g in (("l", "few"), ("l", "one")):
            assert ours[0] > limit
