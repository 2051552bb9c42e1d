"""Page languages against a plain version of the whole fusion."""

from __future__ import annotations

from collections import defaultdict
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest

from tallyroom.llm import langid
from tallyroom.llm.quality import term_counts
from tallyroom.llm.words import groups


def plain(rows, docs):
    names, model = langid.text_model(docs)
    facts = []
    for page_id, url, declared, html in rows:
        (texts,) = groups(pa.array([langid.visible_text(html)], pa.large_string()))
        likelihood = langid.TEXT_WEIGHT * (term_counts(texts).astype(np.float64) @ model)[0]
        text = np.exp(likelihood - likelihood.max())
        host = (urlsplit(url or "").hostname or "").rstrip(".")
        last = host.rsplit(".", 1)[-1]
        facts.append((page_id, declared, "#" if last.isdigit() else last, host, likelihood, text / text.sum()))
    n = len(names)
    by = [defaultdict(lambda: np.zeros(n)) for _ in range(3)]
    for f in facts:
        for level, key in zip(by, f[1:4]):
            level[key] += f[5]
    every, kinds, out = sum(f[5] for f in facts), len(by[0]), {}
    for page_id, declared, suffix, host, likelihood, text in facts:
        def left(total):
            return np.maximum(total - text, 0), max(total.sum() - 1, 0)
        (a, pages), (s, of_suffix), (h, of_host), (d, _) = map(left, (every, by[1][suffix], by[2][host], by[0][declared]))
        overall = (a + 1) / (pages + n)
        of = (h + langid.HOST_PULL * (s + langid.SUFFIX_PULL * overall) / (of_suffix + langid.SUFFIX_PULL)) / (of_host + langid.HOST_PULL)
        said = (d + langid.DECLARED_PULL / kinds) / (a + langid.DECLARED_PULL)
        log = likelihood + np.log(of) + np.log(said)
        share = np.exp(log - log.max())
        share /= share.sum()
        out[page_id] = (names[int(share.argmax())], float(share.max()))
    return out


def test_the_posterior_is_the_plain_one(spark, small_docs):
    """One host has most of the pages; some pages have little text."""
    texts = [r["text"][:400] for r in small_docs.orderBy("doc_id").limit(60).collect()]
    hosts = ["hot.example.de"] * 6 + ["a.example.com", "b.example.fr", "10.0.0.1"]
    said = ["de", "fr", "", "en", "xx"]
    rows = [(i, f"https://{hosts[i % 9]}/{i}", said[i * 7 % 5], f"<html lang='{said[i * 7 % 5]}'><p>{texts[i % 60][: 5 + i * 11 % 300]}</p></html>")
            for i in range(120)]
    rows.append((500, None, "", ""))
    pages = spark.createDataFrame([(i, u, h) for i, u, _, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: (r["lang"], r["posterior"]) for r in langid.languages(pages, small_docs).collect()}
    wanted = plain(rows, small_docs)
    assert got.keys() == wanted.keys()
    for page_id, (lang, share) in wanted.items():
        assert got[page_id][0] == lang and got[page_id][1] == pytest.approx(share, rel=1e-6)


@pytest.mark.parametrize("page", ["<" * 1_000_000, "<a " * 400_000, "<!-- " * 200_000, "a<b" * 300_000 + ">", "<script>" * 100_000])
def test_long_broken_pages_take_no_long(page):
    assert isinstance(langid.visible_text(page), str)
