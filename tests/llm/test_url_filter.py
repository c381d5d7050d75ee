import random
import re

from strandwise.llm.url_filter import RULES, compiled, matches, safe_tokens


def test_rule_syntax():
    assert safe_tokens("||ads-track.example.com^") == ["ads", "com", "example", "track"]
    assert safe_tokens("/casino-") == ["casino"] and safe_tokens("casino") == [] and safe_tokens("*-pills.*") == ["pills"]
    assert safe_tokens("|http://a*b.c|") == ["c", "http"]
    assert re.search(compiled("||a.b^"), "https://x.a.b/") and re.search(compiled("||a.b^"), "http://a.b") and not re.search(compiled("||a.b^"), "http://xa.b/")


def test_matches_equal_every_rule_on_every_url(spark):
    rng = random.Random(4)
    parts = ["ads", "track", "m", "blog", "casino-win", "x", "de", "7", "page=2", "ref=x", "a.b", "[z]", "c+d", "éa"]
    pages = [(i, rng.choice(["http://", "https://"]) + ".".join(rng.choices(parts, k=3)) + "/" + rng.choice("/?&").join(rng.choices(parts, k=3)) + rng.choice(["", "#top", ".html"])) for i in range(300)]
    pages += [(900, None), (901, ""), (None, "http://casino-win.example.com/"), (902, "HTTP://WWW.ADS-TRACK.EXAMPLE.COM"), (902, "HTTP://WWW.ADS-TRACK.EXAMPLE.COM"), (903, "http://" + "a/" * 50000 + "casino-")]
    rules = [*RULES, "casino", "*", "||a.b^", "[z]", "c+d", "x^de", "|http://m.", "éa", ".html|", "7/m"]
    rules += ["".join(rng.choice([*parts, "*", "^", "/", "."]) for _ in range(3)) for _ in range(60)]
    docs = spark.createDataFrame(pages, "page_id long, url string").selectExpr("page_id", "url", "'c' token", "1 n", "'q' rule")
    got = {(r.page_id, r.rule) for r in matches(docs, rules).collect()}
    want = {(i, r) for i, u in pages if u is not None for r in rules if re.search(compiled(r), u.lower())}
    assert got == want and len(want) > 500
    assert matches(docs.limit(0), rules).count() == 0 and matches(docs, []).count() == 0


def by_hand(rule, url):
    """Whether a rule matches, without regular expressions."""
    rule, url = rule.lower(), url.lower()

    def fits(p, u, end):
        if p == "":
            return u == "" if end else True
        if p[0] == "*":
            return any(fits(p[1:], u[i:], end) for i in range(len(u) + 1))
        if p[0] == "^":
            separates = u and not (u[0].isascii() and u[0].isalnum() or u[0] in "_.%-")
            return bool(separates) and fits(p[1:], u[1:], end) or u == "" and fits(p[1:], "", end)
        return u[:1] == p[0] and fits(p[1:], u[1:], end)

    if rule.startswith("||"):
        body, scheme = rule[2:], url.split("://", 1)
        if len(scheme) < 2 or not scheme[0] or not scheme[0][0].isalpha() or any(not (c.isascii() and (c.isalnum() or c in "+.-")) for c in scheme[0]):
            return False
        host = re.split("[/?#]", scheme[1])[0]
        starts = [len(scheme[0]) + 3 + i for i in range(len(host) + 1) if i == 0 or host[i - 1] == "."]
    elif rule.startswith("|"):
        body, starts = rule[1:], [0]
    else:
        body, starts = rule, range(len(url) + 1)
    end = body.endswith("|")
    return any(fits(body[:-1] if end else body, url[i:], end) for i in starts)


def test_rules_mean_what_they_say(spark):
    rng = random.Random(11)
    parts = ["ads", "track", "m", "x", "de", "7", ".", "/", "?", "=", "&", "-", "_", "%", "a.b", "://", "http://", "+"]
    urls = ["".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(120)] + ["http://" + "".join(rng.choices(parts[:14], k=rng.randint(0, 6))) for _ in range(120)]
    rules = list({rng.choice(["", "", "||", "|"]) + "".join(rng.choices([*parts, "*", "^", "^"], k=rng.randint(1, 4))) + rng.choice(["", "", "|"]) for _ in range(150)})
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {(r.page_id, r.rule) for r in matches(pages, spark.createDataFrame([(r,) for r in [*rules, None]], "rule string")).collect()}
    want = {(i, r) for i, u in enumerate(urls) for r in rules if by_hand(r, u)}
    assert got == want and len(want) > 300, (list(got - want)[:5], list(want - got)[:5], [urls[i] for i, _ in list(got ^ want)[:5]])
