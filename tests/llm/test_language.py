import math
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import language
from gridloom.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf):
    got = QUERIES["op5_language_id"](spark, sf).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pages = {r.page_id: re.search('lang="(..)', r.html)[1] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(docs)
    assert sorted(r.page_id for r in got if r.page_id is not None) == sorted(pages)
    right = [r.language == (docs[r.doc_id] if r.doc_id is not None else pages[r.page_id]) for r in got]
    assert sum(right) >= 0.98 * len(right)


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    return df.withColumn("language", F.lit(1)).withColumnRenamed("id", "key")


def brute(scored, languages, strength=language.STRENGTH):
    """Posterior of every row from its text scores, declaration and host."""
    names = [*languages, "und"]
    n = len(names)

    def softmax(x):
        w = [math.exp(v - max(x)) for v in x]
        return [v / sum(w) for v in w]

    # A text without letters has no scores and adds to no table.
    p = [softmax(r.scores) if any(r.scores) else [0.0] * n for r in scored]

    def part(host, kind):
        if host is None:
            return None
        labels = host.split(".")
        if kind == "suffix":
            return labels[-1] if len(labels) > 1 else None
        return ".".join(labels[-2:]) if len(labels) > 2 else host

    overall = [(sum(q[i] for q in p) + 1) / (sum(map(sum, p)) + n) for i in range(n)]

    def smooth(counts, parent):
        return [(c + strength * q) / (sum(counts) + strength) for c, q in zip(counts, parent)]

    def others(value, values, own):
        if value is None:
            return [0.0] * n
        return [sum(q[i] for q, v in zip(p, values) if v == value) - own[i] for i in range(n)]

    hosts = [r.host for r in scored]
    domains = [part(h, "domain") for h in hosts]
    out = []
    for r, q in zip(scored, p):
        prior = smooth(others(r.host, hosts, q), smooth(others(part(r.host, "domain"), domains, q), overall))
        total = [s + math.log(x) for s, x in zip(r.scores, prior)]
        for value, values in ((r.declared, [x.declared for x in scored]), (part(r.host, "suffix"), [part(h, "suffix") for h in hosts])):
            if value is not None and any(any(q2) for q2, v in zip(p, values) if v == value):
                known = [(q2, v) for q2, v in zip(p, values) if v is not None]
                alls = [sum(q2[i] for q2, _ in known) for i in range(n)]
                mine = [sum(q2[i] for q2, v in known if v == value) for i in range(n)]
                total = [t + math.log((m + strength * sum(mine) / sum(alls)) / (a + strength)) for t, m, a in zip(total, mine, alls)]
        out.append(softmax(total))
    return out


def test_fusion_against_brute_force(spark):
    en, de = "the and of that with this have from ", "der die das und nicht mit einen auch "
    rows = []
    for i in range(40):
        base = en if i % 2 else de
        rows.append((i, (base * 9)[i : i + 60 + 5 * i], "en" if i % 2 else "de", f"h{i % 5}.{'a' if i % 2 else 'b'}.{'com' if i % 2 else 'de'}"))
    rows += [(100, "", "en", "h1.a.com"), (101, None, None, "h0.b.de"), (102, "and die", "de", None), (None, "12 34 !!", "xx", "localhost"), (7, *rows[7][1:])]
    df = rows_of(spark, rows)
    got = language.identify(df, ("de", "en")).collect()
    inner = df.select("key", F.coalesce("text", F.lit("")).alias("text"), "declared", "host")
    scored = language.text_scores(inner, language.fit_trigrams(inner, ("de", "en"))).collect()
    want = brute(scored, ("de", "en"))
    key = lambda r: (str(r[0]), r[1:])
    # The row without an id has neither letters nor company: no evidence.
    expected = sorted(((s.key, "und" if s.key is None else ["de", "en", "und"][w.index(max(w))], max(w)) for s, w in zip(scored, want)), key=key)
    found = sorted(((r.key, r.language, r.probability) for r in got), key=key)
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert [f[2] for f in found] == pytest.approx([e[2] for e in expected], abs=1e-6)
    by_key = {r.key: r for r in got}
    assert by_key[100].language == "en" and by_key[101].language == "de"
    assert all(r.accepted == (r.language != "und" and r.probability >= 0.5) for r in got)


def test_empty_and_addresses(spark):
    assert language.identify(rows_of(spark, [])).count() == 0
    only_null = language.identify(rows_of(spark, [(1, None, None, None)])).first()
    assert only_null.accepted is False
    page = spark.createDataFrame(
        [("https://u:p@A.example.DE:80/x?y", "<!doctype html><HTML class=x LANG='pt-BR'><script>no</script><p>a<!-- b -->c</p>"), (None, None)],
        "url string, html string",
    )
    first, second = language.page_rows(page, F.lit(1)).collect()
    assert (first.declared, first.host, first.text.split()) == ("pt", "a.example.de", ["a", "c"])
    assert (second.declared, second.host, second.text) == (None, None, "")


def test_no_evidence_is_not_accepted(spark):
    en, de = "the and of that with this have from ", "der die das und nicht mit einen auch "
    rows = [(i, (de if i % 3 == 0 else en) * 4, "de" if i % 3 == 0 else "en", "h.com") for i in range(60)]
    rows += [(100 + i, t, None, h) for i, (t, h) in enumerate([("123 $$$", None), ("!!! ??? 42", "lone.xyz"), ("", "zz"), (None, "zz"), ("1", "zz")])]
    rows += [(200, "12", None, "h.com"), (201, None, "de", None), (202, "7", "xx", None)]
    got = {r.key: r for r in language.identify(rows_of(spark, rows)).collect()}
    assert all(got[i].language == "und" and not got[i].accepted for i in [*range(100, 105), 202])
    assert got[200].language == "en" and got[201].language == "de" and got[201].accepted


def test_languages_follow_the_table(spark):
    words = {"en": "the and of that with ", "pt": "nao uma para com mais ", "xx": "zz qq "}
    rows = [(i, words[c] * 3 + str(i), c, None) for i, c in enumerate(["en"] * 30 + ["pt"] * 25 + ["xx"] * 3)]
    df = rows_of(spark, rows).withColumn("declared", F.lower("declared"))
    assert language.declared_languages(df) == ["en", "pt"]
    got = {r.key: r.language for r in language.identify(df).collect()}
    assert all(got[i] == ("en" if i < 30 else "pt") for i in range(55))


def test_tag_behind_a_long_comment(spark):
    html = "<!-- <html lang='de'> " + "x" * 3000 + " -->\n<html class=y lang=fr><body>a"
    page = spark.createDataFrame([(html,), ("<html><p lang='de'>a",)], "html string")
    assert [r[0] for r in page.select(language.declared_in_markup(F.col("html"))).collect()] == ["fr", None]
