"""Language ID and the quality classifier against plain loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Row

from venuelake.llm import language_id, quality

WORDS = {"de": "der hund und die katze mit dem haus", "en": "the cat and the dog with this house", "fr": "le chat et le chien avec la maison"}


def brute(pages, docs):
    """(lang, probability) of each page, from the definition."""
    languages = sorted({lang for _, lang in docs if lang is not None})
    counts = {lang: Counter() for lang in languages}
    for text, lang in docs:
        if text is not None and lang is not None:
            counts[lang].update(language_id.trigram_buckets(text).tolist())
    size = 1 << language_id.BUCKET_BITS
    log_of = {lang: (lambda b, c=c, t=sum(c.values()) + 0.5 * size: math.log((c[b] + 0.5) / t)) for lang, c in counts.items()}
    seen = []
    for url, html in pages:
        found = language_id._LANG_ATTR.search(html or "")
        logs = [language_id.TEMPER * sum(log_of[lang](b) for b in language_id.trigram_buckets(language_id.visible_text(html)).tolist()) for lang in languages]
        logs = [x - max(logs) for x in logs]
        p = [math.exp(x) for x in logs]
        p = [x / sum(p) for x in p]
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = rest.split("/")[0].lower()
        folder = rest.split("/")[1] if rest.count("/") and len(rest.split("/")[1]) == 2 and rest.split("/")[1].isalpha() else ""
        seen.append((host, ".".join(host.split(".")[-2:]), f"{host.split('.')[-1]}/{folder.lower()}", found[1].lower() if found else "", logs, p))
    n = len(languages)
    whole = [sum(s[5][i] for s in seen) for i in range(n)]
    base = [(w + 1) / (sum(whole) + n) for w in whole]
    sums = [defaultdict(lambda: [0.0] * n) for _ in range(4)]
    for s in seen:
        for k in range(4):
            sums[k][s[k]] = [a + b for a, b in zip(sums[k][s[k]], s[5], strict=True)]
    out = []
    for host, domain, address, declared, logs, p in seen:
        fused = []
        for i in range(n):
            h, d, a, dd = sums[0][host], sums[1][domain], sums[2][address], sums[3][declared]
            less = lambda v, i=i: max(v[i] - p[i], 0.0)
            level = (less(d) + language_id.PRIOR_WEIGHT * base[i]) / (sum(d) - 1 + language_id.PRIOR_WEIGHT)
            prior = (less(h) + language_id.PRIOR_WEIGHT * level) / (sum(h) - 1 + language_id.PRIOR_WEIGHT)
            of = max(whole[i], 1.0) + 1
            fused.append(math.log(prior) + logs[i] + (math.log((less(dd) + 0.5) / of) if declared else 0) + (math.log((less(a) + 0.5) / of) if host else 0))
        best = max(fused)
        out.append((languages[fused.index(best)], 1 / sum(math.exp(x - best) for x in fused)))
    return out


def test_language_id_equals_brute_force(spark):
    rng = random.Random(4)
    docs = [(" ".join(rng.choices(w.split(), k=20)), lang) for lang, w in WORDS.items() for _ in range(4)] + [(None, "en"), ("x", None)]
    pages = []
    for i in range(40):
        lang = rng.choice(sorted(WORDS))
        declared = rng.choice(["", f' lang="{rng.choice(sorted(WORDS))}"'])
        pages.append((rng.choice([f"https://{rng.choice('ab')}.site{i % 3}.org/{lang}/x", f"https://one.{lang}/p", None]), f"<html{declared}><p>{' '.join(rng.choices(WORDS[lang].split(), k=rng.randint(0, 6)))}</p></html>"))
    pages += [(None, None), ("https://a.site0.org/", "<p>" + "the cat " * 40_000 + "</p>")]
    frame = spark.createDataFrame([Row(page_id=i, url=u, html=h, domain=1, n=2) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, domain int, n int")
    got = {r.page_id: r for r in language_id.identify(frame, spark.createDataFrame(docs, "text string, lang string")).collect()}
    assert len(got) == len(pages)
    for i, (lang, p) in enumerate(brute(pages, docs)):
        assert abs(got[i].probability - p) < 1e-3 and (got[i].lang == lang or p < 0.51)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 4] + rng.normal(size=400) * 0.2 > 0).astype(float)
    model = quality.fit(x, y)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.intercept
        for j, table in enumerate(model.tables):
            total += table[sum(row[j] >= e for e in model.edges[j])]
        for a, b, table in model.pairs:
            total += table[sum(row[a] >= e for e in model.pair_edges[a]), sum(row[b] >= e for e in model.pair_edges[b])]
        assert abs(score - 1 / (1 + math.exp(-max(-50, min(50, total))))) < 1e-9
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_very_long_odd_and_clashing_rows_are_scored(spark):
    rows = [(i, ("Good prose stands here, sentence after sentence. " if i % 2 else "JUNK!! !! ") * (3 + i % 5), "clash", 1.0) for i in range(80)]
    rows += [(90, None, "c", 0.0), (91, "", "c", 0.0), (92, "word " * 400_000, "c", 0.0), (None, "no id", "c", 0.0), (92, "word", "c", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(5, 0), (7, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and all(r.doc_id % 2 for r in kept.collect() if r.doc_id is not None and r.doc_id < 80)
