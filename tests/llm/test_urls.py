import random
import re

import pytest

from barquality.llm import urls

EDGE = [
    None, "", "no scheme", "http://", "://", "http://ORG/", "http://x.Org/a", "http://notorg/", "http://example.org", "http://example.org/", "http://a.example.org/es/1",
    "http://example.org/es", "http://example.org/en/12?x=/es/", "http://example.org/en/2", "http://example.org/EN/1", "http://a.com/fr/", "http://a.com/de/x#y", "http://a.com?x=/de/",
    "ftp://casino.example.net/x", "http://www.free-bets.example.net", "http://freebets.net/", "http://éorg/", "http://a.b://org/", "http://xxx.example.net/", "http://a.net/ads/click",
    "http://user@Example.ORG:80/es/", "http://example.org:80/es/", "http://spam-farm.example.net/" + "p/" * 20000,
]


def plain(url):
    """Every rule against every url."""
    m = re.search("://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate(urls.ASCII_LOWER), m[2]) if m else ("", "")
    fit = [r for r in urls.SITE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    hit = any(re.search(r.pattern, (host + path).translate(urls.ASCII_LOWER)) for r in urls.PATTERN_RULES)
    return host, path, None, "block" if hit else "allow"


def made(n):
    rng = random.Random(2)
    hosts = ["org", "com", "example", "net", "www", "casino", "casinos2", "cheap-pills", "pills-now", "bets-x", "spam-farm", "m", "quick-loan", "ads", "adsl", "x-tracking-1", "adult", "é"]
    parts = ["es", "en", "fr", "de", "1", "12", "ad", "ads", "banner", "click", "clicks", "click2", "clickthrough", "casino."]
    for _ in range(n):
        yield f"http://{'.'.join(rng.choices(hosts, k=rng.randint(1, 4)))}/{'/'.join(rng.choices(parts, k=rng.randint(0, 4)))}{rng.choice(['', '/', '?q=1', '#t'])}"


def test_judgements_match_all_rules_on_all_urls(spark):
    cases = EDGE + list(made(10_000)) + ["http://x.net/ads/clicks", "http://x.net/ad/click2", "http://x.net/banner/clickthrough?x"]
    pages = spark.createDataFrame([(i, u, "html", "allow") for i, u in enumerate(cases)], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge(pages).collect()}
    for i, u in enumerate(cases):
        assert got[i] == plain(u), u


def test_index_fetches_few_candidates():
    index = urls.RuleIndex(urls.SITE_RULES, urls.PATTERN_RULES, {"org": 1000, "com": 1000, "example": 5000, "en": 400, "es": 90})
    assert {e[1].name for e in index.by_token["es"]} == {"example.org/es/"}
    assert {e[1].name for e in index.by_token["en"]} == {"example.org/en/1"}
    assert "1" not in index.by_token
    assert index.judge("http://a.net/x")[5] == 0


def test_empty_table_and_repeated_rows(spark):
    schema = "page_id long, url string"
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    assert urls.judge(spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None)], schema)).count() == 3


GO_ON = [
    "http://a.net/ads/clicks", "http://a.net/banner/click2/x", "http://cheap-pillsx.net/", "http://cheaper-pills.net/", "http://pills-nows.net/", "http://casinos.net/", "http://casino2-x.net/",
    "http://free-betss.net/", "http://bets-xs.net/", "http://spam-farms.net/", "http://adults.net/", "http://xxx2.net/", "http://quick-loanss.net/", "http://adsl.net/", "http://tracks.net/", "http://a.net/ads.x",
]


def test_index_and_rules_agree_where_literals_go_on(spark):
    pages = spark.createDataFrame(list(enumerate(GO_ON)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge(pages).collect()}
    assert [got[i] for i in range(len(GO_ON))] == [plain(u) for u in GO_ON]
    assert [u for i, u in enumerate(GO_ON) if got[i][3] == "block"] == [*GO_ON[:2], "http://pills-nows.net/", "http://bets-xs.net/"]


def test_all_families_of_hosts_are_blocked():
    index = urls.RuleIndex(urls.SITE_RULES, urls.PATTERN_RULES, {})
    for host in ("ads-track.example.com", "adult-x.example.net", "www.ad.example.net", "tracker.example.net", "x-tracking-1.example.net"):
        assert index.judge(f"http://{host}/x")[3] == "block", host
    for host in ("adsl.example.net", "soundtrack.example.net", "racetracks.example.net", "example.ad"):
        assert index.judge(f"http://{host}/ads.html")[3] == "allow", host


def test_literals_are_derived_and_bounded():
    assert urls.literal_tokens(r"^(?:[^/]*[.-])?cheap-pills(?:-[a-z0-9]+)*\.") == ("cheap", "pills")
    assert urls.literal_tokens(r"/ads/click") == ("ads",)
    assert urls.literal_tokens(r"/(?:ads|ad)/click/") == ("click",)
    for pattern in ("click", "/click", "click/", "[/x]click/", "/?click/", "/a?click/", r"\bclick\b", "/(click)?/", "x+/", "click$", ".*click.*"):
        assert urls.literal_tokens(pattern) == (), pattern
    for pattern in ("/(?:ads|banner)x", "[a-z]+"):
        with pytest.raises(ValueError):
            urls.RuleIndex((), (urls.PatternRule("p", pattern),), {})
    with pytest.raises(ValueError):
        urls.literal_tokens("(?i)/ads/")


def test_rules_from_a_table_of_filter_lines(spark):
    lines = [("a", "||bad.example^"), ("b", "/banners/*"), ("c", "|www.start."), ("d", "/^[^/]*[.-]regex\\./"), ("e", None), ("b", "/banners/*")]
    rules = urls.rules_of(spark.createDataFrame(lines, "name string, line string"))
    assert [r.name for r in rules] == ["a", "b", "c", "d"]
    index = urls.RuleIndex((), rules, {})
    hit = {u: index.judge(f"http://{u}")[4] for u in ("bad.example/x", "x.bad.example", "notbad.example/", "bad.examples/", "q.net/banners/1", "q.net/mybanners/1", "www.start.com/", "a.www.start.com/", "a.regex.net/")}
    assert hit == {"bad.example/x": "a", "x.bad.example": "a", "notbad.example/": None, "bad.examples/": None, "q.net/banners/1": "b", "q.net/mybanners/1": None, "www.start.com/": "c", "a.www.start.com/": None, "a.regex.net/": "d"}
    with pytest.raises(ValueError):
        urls.rules_of(spark.createDataFrame(lines, "name string, line string"), most=2)


def test_lines_of_filter_lists(spark):
    lines = ["! a comment", "[Adblock Plus 2.0]", "", "  ", "example.com##.banner", "a.com#@#div", "b.com#?#x:has(y)", "||ads.example.com^", "@@||ads.example.com/fine^", "||track.net^$document,important", "/^stats\\./", None]
    rules = urls.rules_of(spark.createDataFrame([(None, x) for x in lines], "name string, line string"))
    assert sorted((r.name, r.verdict) for r in rules) == [("/^stats\\./", "block"), ("@@||ads.example.com/fine^", "allow"), ("||ads.example.com^", "block"), ("||track.net^$document,important", "block")]
    index = urls.RuleIndex((), rules, {})
    judged = {u: index.judge(u)[3:5] for u in ("http://ads.example.com/x", "http://ads.example.com/fine/1", "http://www.track.net/", "http://stats.org/", "http://acomment.org/")}
    assert judged == {
        "http://ads.example.com/x": ("block", "||ads.example.com^"), "http://ads.example.com/fine/1": ("allow", "@@||ads.example.com/fine^"),
        "http://www.track.net/": ("block", "||track.net^$document,important"), "http://stats.org/": ("block", "/^stats\\./"), "http://acomment.org/": ("allow", None),
    }
    for line in ("||ads.example.com^$third-party", "||a.com^$script,document", "||a.com^$domain=b.com|c.com"):
        with pytest.raises(ValueError, match="option"):
            urls.rule_of(None, line)


def test_the_index_agrees_with_all_rules_of_a_list():
    rng = random.Random(4)
    names = [f"{a}{b}" for a in ("ads", "cdn", "news", "track") for b in ("one", "two", "")]
    lines = [f"||{n}.{t}^" for n in names for t in ("com", "net")] + [f"@@||{n}.com/ok^" for n in names[:5]] + [f"/{n}/click" for n in names]
    rules = [r for x in lines if (r := urls.rule_of(None, x))]
    index = urls.RuleIndex((), rules, {})
    for _ in range(3000):
        url = f"https://{rng.choice(['', 'www.', 'x-'])}{rng.choice(names)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['', 'ok', 'ok/1', rng.choice(names) + '/click', 'a'])}"
        low = "".join(urls.host_and_path(url)).lower()
        hits = [(r.verdict, r.name) for r in rules if re.search(r.pattern, low)]
        assert index.judge(url)[3:5] == min(hits, default=("allow", None))
