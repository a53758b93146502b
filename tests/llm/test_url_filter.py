import random
import re

from signalframe.llm import url_filter as u

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr"), ("block", "", "/x"), ("allow", "net", "/fr")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, "allow"))


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["com", "a.com", "EXAMPLE.com", "www.example.com", "x.www.example.com", "xexample.com", "net", "a.b.net", "org", "", "a.b.", "É.net:80"]
    paths = ["", "/", "/en/", "/en", "/en/a?x=1", "/es/q#f", "/fr", "/fr/x", "?q=/es/", "#/fr/", "/EN/", "/xx"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "a://b://c/d"]
    pages = [(n, url, "row") for n, url in enumerate(urls)] + [(1, urls[1], "row"), (None, "http://a.net/es/", "row")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    got = u.url_verdicts(df, spark.createDataFrame(RULES, "verdict string, host string, path string"))
    expected = [(n, *judge(url)) for n, url, _ in pages]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_empty_list_and_table(spark):
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string")
    assert [tuple(r) for r in u.url_verdicts(pages, rules).collect()] == [(1, "a.com", "/b", None, "allow")]
    assert u.url_verdicts(pages.limit(0), spark.createDataFrame(RULES, rules.schema)).count() == 0


def test_bloom_passes_every_listed_key_and_few_others(spark):
    from pyspark.sql import functions as F

    keys = spark.range(2000).select(F.concat(F.lit("host"), F.col("id")).alias("key"))
    bloom = u.blocked_bloom(keys, 64)
    others = keys.union(spark.range(4000).select(F.concat(F.lit("other"), F.col("id"))))
    hit = F.lit(True)
    for i, b in enumerate(u.bloom_bits(F.col("key"))):
        hit &= F.col(f"w{i}").bitwiseAND(b) != 0
    passed = others.withColumn("block", u.bloom_block(F.col("key"), 64)).join(bloom, "block").where(hit)
    assert passed.where("key like 'host%'").count() == 2000
    assert passed.where("key like 'other%'").count() < 400


def test_equal_rules_of_different_verdicts_block(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.a.com/"), (3, "http://c.org/")], "page_id long, url string")
    rules = spark.createDataFrame([("allow", "a.com", "/"), ("block", "a.com", "/")], "verdict string, host string, path string")
    got = {r["page_id"]: r["verdict"] for r in u.url_verdicts(pages, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_clashing_columns_and_nulls(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "p", "q", "r"), (1, "http://a.com/x", "p", "q", "r"), (None, None, None, None, None)], "page_id long, url string, rule string, verdict string, path string")
    rules = spark.createDataFrame([("block", "a.com", "/")], "verdict string, host string, path string")
    got = u.url_verdicts(pages, rules).collect()
    assert sorted((str(r["page_id"]), r["verdict"], str(r["rule"])) for r in got) == [("1", "block", "a.com/"), ("1", "block", "a.com/"), ("None", "allow", "None")]
    long = spark.createDataFrame([(2, "http://a.com/" + "x" * 2_000_000)], "page_id long, url string")
    assert u.url_verdicts(long, rules).first()["verdict"] == "block"
