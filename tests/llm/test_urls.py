import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logloom.llm import urls

RULES = [*((r, a, False) for a, r in urls.CONTRACT_RULES), *((r, "block", True) for r in urls.LISTED_HOSTS)]


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(raw) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    best = spam = None
    for rule, action, listed in RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if listed:
                spam = "block"
            elif best is None or len(rule) > len(best[0]):
                best = (rule, action)
    return host, path, best and best[0], best[1] if best else spam or "allow"


URL = st.builds(
    lambda scheme, host, path, tail: scheme + host + path + tail,
    st.sampled_from(["http://", "https://", "", "x://y://"]),
    st.sampled_from(["example.com", "A.Example.COM", "com", "notexample.net", "m.example.net", "org", "b.org", "spam-farm.example.org", "", "example.com:80"]),
    st.sampled_from(["", "/", "/en/", "/en", "/en/7", "/en/71", "/de/", "/de/8", "/de/88/x", "/es/", "/fr/1"]),
    st.sampled_from(["", "?q=/en/", "#a", "?a#b", "\n/en/"]),
)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), URL), min_size=30, max_size=60))
def test_verdicts(spark, given_urls):
    pages = spark.createDataFrame(list(enumerate(given_urls)), "page_id long, url string")
    got = urls.judge_pages(pages, urls.default_rules(spark)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judged(u) for i, u in enumerate(given_urls)}


def test_same_verdicts_without_the_filter(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    with_filter, without = (sorted(map(str, urls.judge_pages(pages, urls.default_rules(spark), n).collect())) for n in (1000, 0))
    assert with_filter == without


def test_filter_has_no_false_negatives_and_drops_most(spark):
    keys = spark.range(2000).selectExpr("concat('h', id, '.org/') as key")
    words = urls.bloom_filter(keys, 500)
    other = spark.range(5000).selectExpr("concat('other', id, '/') as key")
    assert keys.where(~urls.might_hold(keys.key, words)).isEmpty()
    assert other.where(urls.might_hold(other.key, words)).count() < 500


def test_a_million_rules_travel_as_one_literal(spark):
    rules = spark.range(1_000_000).selectExpr("concat('h', id, '.org/') as rule", "if(id % 2 = 0, 'block', 'allow') as action", "false as listed")
    rows = [(i, f"http://www.h{i * 77777}.org/x/{i}") for i in range(20)] + [(100 + i, f"http://h{i}.com/") for i in range(20)]
    made = urls.judge_pages(spark.createDataFrame(rows, "page_id long, url string"), rules)
    assert "h77777" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.page_id: (r.rule, r.verdict) for r in made.collect()}
    want = {i: (f"h{i * 77777}.org/", "allow" if i * 77777 % 2 else "block") if i * 77777 < 10**6 else (None, "allow") for i in range(20)}
    assert got == want | {100 + i: (None, "allow") for i in range(20)}


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (None, "http://a.com/en/", "y"), (1, None, "x"), (2, "", "z")], "page_id long, url string, host string")
    got = urls.judge_pages(pages, urls.default_rules(spark)).collect()
    assert sorted((str(r.page_id), r.host, r.rule, r.verdict) for r in got) == sorted([("1", "", None, "allow"), ("1", "", None, "allow"), ("2", "", None, "allow"), ("None", "a.com", "com/en/", "block")], key=str)
    assert urls.judge_pages(pages.where("false"), urls.default_rules(spark)).collect() == []
    none = spark.createDataFrame([(None, "block", False), ("noslash", "block", False)], "rule string, action string, listed boolean")
    assert {r.verdict for r in urls.judge_pages(pages, none).collect()} == {"allow"}
    twice = spark.createDataFrame([("a.com/", "allow", False), ("a.com/", "block", False)], "rule string, action string, listed boolean")
    assert {r.page_id: r.verdict for r in urls.judge_pages(pages, twice).collect()}[None] == "block"
