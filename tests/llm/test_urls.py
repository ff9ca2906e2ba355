import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mdframe.llm import urls as module
from mdframe.llm.urls import OP1_SQL, filter_urls, mined_rules, op1_url_filters, url_tokens


def listed(mined):
    """Mined rules, the most confident first; a rule's tokens are the first of each class."""
    rules = [{"tokens": frozenset(t[0] for t in r["tokens"]), "classes": r["tokens"], "verdict": r["verdict"], "confidence": r["confidence"], "support": r["support"]} for r in mined.collect()]
    return sorted(rules, key=lambda r: (-r["confidence"], -r["support"], sorted(r["tokens"])))


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "m", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, tokens string, rule string")


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[k:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), path[:end]


URLS = [
    None, "", "no scheme", "http://", "http://X.Example.NET/en/1?q=1#f", "https://example.net/fr/2", "http://a.net", "http://a.net/", "http://b.example.com/de/x://y", "http://example.com/de", "http://x.org/fr/9",
    "http://x.org?/fr/", "http://notexample.com/de/1", "https://ÄB.net/é", "ftp://h#frag/x", "http://example.net/en/../de/",
]


def test_hosts_paths_and_rules(spark):
    got = filter_urls(pages(spark, URLS), None).orderBy("page_id").collect()
    assert [(r["host"], r["path"]) for r in got] == [brute(u) for u in URLS]
    rules = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert rules[4] == ("example.net/en/", "allow") and rules[5] == ("net/", "block") and rules[6] == (None, "allow") and rules[7] == ("net/", "block")
    assert rules[8] == ("example.com/de/", "block") and rules[9] == (None, "allow") and rules[10] == ("org/fr/", "allow") and rules[11] == (None, "allow") and rules[12] == (None, "allow")
    assert filter_urls(pages(spark, []).limit(0), None).collect() == []


def test_mining(spark):
    urls = [f"http://spam-farm.example.org/en/{i}" for i in range(30)] + [f"http://good.example.org/{['en', 'fr'][i % 2]}/{i}" for i in range(60)] + [None]
    labels = spark.createDataFrame([(i, 0 if i < 30 else 1, "x") for i in range(90)] + [(0, 0, "x"), (None, 1, "x"), (3, None, "x")], "doc_id long, quality int, url string")
    frame = pages(spark, urls)
    mined = mined_rules(frame, labels)
    rules = listed(mined)
    assert rules and all(r["confidence"] >= 0.6 for r in rules)
    kept = [(r["tokens"], r["verdict"]) for r in rules]
    assert not any(a < b and v == w for a, v in kept for b, w in kept if a != b and rules[0]["confidence"] == 1.0 and v == "block" and w == "block")
    out = filter_urls(frame, mined)
    assert out.where("page_id < 30 and verdict = 'block'").count() == 30 and out.where("page_id >= 30 and verdict = 'block'").count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
    assert listed(mined_rules(frame, labels.limit(0))) == [] and listed(mined_rules(frame.limit(0), labels)) == []


@pytest.fixture(scope="module")
def hot(spark):
    frame, labels = hot_site(spark)
    return frame, mined_rules(frame, labels)


def hot_site(spark):
    """A third of the pages share 13 tokens, 12 of them with other pages of both labels; a smaller site has block labels only."""
    hot = "http://a-b.own.example.org/x/y/{}.html?p=1&q=2"
    other = ["http://a-b.example.org/x/{}?p=1", "http://own.example.org/y/{}.html?q=2"]
    urls = [hot.format(i) for i in range(60)] + [other[i % 2].format(i) for i in range(80)] + [f"http://farm.example.org/{i}" for i in range(40)]
    return pages(spark, urls), spark.createDataFrame([(i, int(i < 60 or i < 140 and i % 4 < 2)) for i in range(180)], "doc_id long, quality int")


def test_rules_of_a_hot_site_leave_others(hot):
    frame, mined = hot
    rules = listed(mined)
    assert any(r["verdict"] == "block" and len(r["classes"]) == 1 and "host:farm" in r["classes"][0] for r in rules)
    for a in rules:
        assert not any(b["verdict"] == a["verdict"] and b["tokens"] < a["tokens"] and b["confidence"] >= a["confidence"] for b in rules)
    out = filter_urls(frame, mined)
    assert out.where("page_id >= 140 and verdict = 'block'").count() == 40 and out.where("page_id < 60 and verdict = 'allow'").count() == 60


def test_tokens_that_go_together_are_one(hot):
    frame, mined = hot
    rules = listed(mined)
    assert any(len(c) > 1 for r in rules for c in r["classes"])
    assert all(len(r["tokens"]) == len(r["classes"]) for r in rules)


def brute_rules(rows, least, total):
    """Best confidence of every combination that a rule may have, over all combinations of tokens."""
    counts = {}
    for y, tokens in rows:
        for n in range(1, len(tokens) + 1):
            for t in itertools.combinations(sorted(tokens), n):
                counts.setdefault(t, [0, 0])[y] += 1
    out = {}
    for t, (block, allow) in counts.items():
        for verdict, both in (("block", block), ("allow", allow)):
            if both >= least:
                out[t, verdict] = (both / (block + allow), both / total)
    return out


@pytest.mark.parametrize("most", [module.BROADCAST_CHARS, 1])
def test_verdicts_equal_all_combinations(spark, monkeypatch, most):
    """Each URL has the best rule among all combinations of tokens, as if nothing were merged or indexed."""
    monkeypatch.setattr(module, "BROADCAST_CHARS", most)
    rng = random.Random(3)
    sites = [f"{rng.choice('ab')}-{rng.choice('xy')}.{rng.choice(['org', 'com'])}" for _ in range(4)]
    urls = [f"http://{rng.choice(sites)}/{rng.choice(['p', 'q', 'p/r'])}/{i}{rng.choice(['', '.html', '?k=1'])}" for i in range(160)]
    labels = spark.createDataFrame([(i, int(rng.random() < 0.4 + 0.4 * ("p" in u))) for i, u in enumerate(urls[:110])], "doc_id long, quality int")
    frame = pages(spark, urls + URLS + urls[:3])
    host, path = module.host_and_path(F.col("url"))
    tokens = [(r["url"], tuple(r["t"])) for r in frame.select("url", url_tokens(F.col("url"), host, path).alias("t")).collect()]
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    known = [(y[i], tokens[i][1]) for i in y]
    rules = brute_rules(known, 8, len(known))
    share = {"block": sum(v == 0 for v, _ in known) / len(known), "allow": sum(v == 1 for v, _ in known) / len(known)}
    usable = {k: v for k, v in rules.items() if v[0] >= 0.6 and v[0] / share[k[1]] > 1}
    best = [max((v for (t, _), v in usable.items() if set(t) <= set(own)), default=None) for _, own in tokens]
    out = filter_urls(frame, mined_rules(frame, labels))
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == out.count() == len(tokens) and "Python" not in out._jdf.queryExecution().toString()
    for i, want in enumerate(best):
        verdicts = {k[1] for k, v in usable.items() if v == want and set(k[0]) <= set(tokens[i][1])}
        assert (got[i]["mined"] is None) == (want is None) and (got[i]["rule"] is not None or got[i]["verdict"] in (verdicts or {"allow"}))
    assert {r["verdict"] for r in got.values()} == {"allow", "block"}


def test_query_equals_sql(spark, tmp_path):
    frame, labels = hot_site(spark)
    frame = frame.union(pages(spark, URLS).selectExpr("page_id + 1000", "url", "host", "tokens", "rule"))
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for name in ("pages", "labels"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got, want = (sorted(map(tuple, rows), key=str) for rows in (op1_url_filters(spark, str(tmp_path)).collect(), c.sql(OP1_SQL).fetchall()))
    assert got == want and {r[4] for r in got} == {"allow", "block"}
