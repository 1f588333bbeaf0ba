import re

from sparkloom.llm import queries, url_rules as U

URLS = [
    None, "", "no scheme/a", "http://A.Example.COM/en/7?x=1", "https://example.com/en/8#t", "http://com/en/", "http://xcom/en/", "http://a.net/de/1", "http://example.net/de/8/x",
    "http://b.example.net:80/de/8", "ftp://q.org/es/", "http://q.org/es", "http://É.org/es/", "a://b://c.com/en/1", "http://x.com\n/en/1", "http://?q", "://", "http://m.example.com/en/71" + "a" * 5000,
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def fixed(host, path, rules):
    best = None
    for rule, what in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, what)
    return best or (None, None)


def test_fixed_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "url string, blocked boolean")
    got = {r["page_id"]: r for r in U.judge(df, none, queries.FIXED_RULES).collect()}
    for i, u in enumerate(URLS):
        h, p = split(u)
        rule, what = fixed(h, p, queries.FIXED_RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (h, p, rule, what or "allow"), u
    assert U.judge(df.limit(0), none, queries.FIXED_RULES).count() == 0


def test_mined_rules_against_brute_force(spark):
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        host = "spam.biz" if i % 6 == 0 else f"site{i % 7}.org"
        rows.append((f"https://{host}/{'buy' if bad else 'read'}/{i}?{'ref' if i % 2 else 'q'}=1", bad or i % 50 == 1))
    rows += [(None, True), ("https://spam.biz/x/1", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = U.mine(labelled, 0.02, 0.9, 2, 5).collect()
    urls = [u for u, b in rows if u and b is not None]
    toks = {r["url"]: set(r["t"]) for r in labelled.filter("url is not null").select("url", U.tokens(labelled["url"]).alias("t")).collect()}
    want = {}
    from itertools import combinations

    every = sorted({t for u in urls for t in toks[u]})
    for k in (1, 2):
        for c in combinations(every, k):
            of = [b for u, b in rows if u in toks and b is not None and set(c) <= toks[u]]
            hits = sum(of)
            if of and hits >= max(5, 0.02 * len(urls)) and hits / len(of) >= 0.9:
                want[c] = hits / len(of)
    want = {c: v for c, v in want.items() if not (len(c) == 2 and any(want.get((x,), -1) >= v for x in c))}
    assert {tuple(r["tokens"]): round(r["confidence"], 9) for r in rules} == {c: round(v, 9) for c, v in want.items()} and rules
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for limit in (10_000, 0):  # broadcast and shuffled index
        found = {r["page_id"]: r["confidence"] for r in U.match(pages, U.mine(labelled, 0.02, 0.9, 2, 5), broadcast_rules=limit).collect()}
        for i, u in enumerate(urls):
            best = max((v for c, v in want.items() if set(c) <= toks[u]), default=None)
            assert (round(found[i], 9) if i in found else None) == (round(best, 9) if best is not None else None)


def test_a_template_of_many_keys_makes_few_itemsets(spark):
    keys = "&".join(f"k{i}={{0}}" for i in range(30))
    rows = [(f"https://t.biz/a/{i}?" + keys.format(i), i % 2 == 0 or i % 5 == 0) for i in range(400)] + [(f"https://ok.org/b/{i}", False) for i in range(400)]
    rules = U.mine(spark.createDataFrame(rows, "url string, blocked boolean"), 0.01, 0.5, 3, 5).collect()
    assert {len(r["tokens"]) for r in rules} == {1} and {"key:k0", "key:k29", "host:t.biz"} <= {r["tokens"][0] for r in rules}


def test_rules_that_fail_on_held_out_urls_go_and_repeated_pages_are_judged_alone(spark):
    rows = [(f"https://bad.biz/x/{i}", True) for i in range(200)] + [(f"https://ok.org/y/{i}", i % 9 == 0) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    held = labelled.filter(U.hold(labelled["url"]))
    good = U.tested(U.mine(labelled.filter(~U.hold(labelled["url"])), 0.01, 0.6), held, 0.6).collect()
    assert good and all(r["held_out"] == r["held_out_blocked"] > 20 for r in good)
    wrong = spark.createDataFrame([(["host:ok.org"], 0.9, 0.1), (["host:none.org"], 0.9, 0.1)], U.RULE)
    assert [r["tokens"] for r in U.tested(wrong, held, 0.6).collect()] == [["host:none.org"]]
    pages = spark.createDataFrame([(1, "https://bad.biz/x/999"), (1, "https://ok.org/y/1"), (None, "https://bad.biz/x/999"), (2, None)], "page_id long, url string")
    got = sorted((str(r["page_id"]), r["host"], r["verdict"]) for r in U.judge(pages, labelled, []).collect())
    assert got == [("1", "bad.biz", "block"), ("1", "ok.org", "allow"), ("2", "", "allow"), ("None", "bad.biz", "block")]


def rules_by_brute_force(rows, least, min_confidence, most):
    """Confidence by rule, from rows (set of tokens, blocked)."""
    from itertools import combinations

    want = {}
    for k in range(1, most + 1):
        for c in combinations(sorted(set().union(*(x for x, _ in rows))), k):
            of = [b for x, b in rows if x.issuperset(c)]
            if sum(of) >= least and sum(of) / len(of) >= min_confidence:
                want[c] = sum(of) / len(of)
    return {c: v for c, v in want.items() if not any(want.get(p, -1) >= v for p in combinations(c, len(c) - 1))}


def test_no_item_of_a_long_url_is_left_out(spark):
    """URLs of more items than FP-growth takes: all, some and too few for rules of their own, against brute force."""
    import random

    random.seed(3)
    for keys, short, long in ((18, 0, 90), (16, 60, 50), (16, 120, 4)):
        rows = []
        for i in range(short + long):
            have = sorted(random.sample(range(keys), random.randint(2, 5) if i < short else random.randint(13, keys - 1)))
            bad = {2, 5, 11} <= set(have) or {1, 4} <= set(have) and i % 3 > 0 or i % 11 == 0
            rows.append((f"https://a.biz/{i}?" + "&".join(f"k{k}={i}" for k in have), bad))
        labelled = spark.createDataFrame(rows, "url string, blocked boolean")
        sets = [(set(r["t"]), r["blocked"]) for r in labelled.select(U.tokens(labelled["url"]).alias("t"), "blocked").collect()]
        assert max(len(x) for x, _ in sets) > U.MOST_ITEMS
        for least, confidence in ((6, 0.7), (13, 0.5)):
            got = {tuple(r["tokens"]): round(r["confidence"], 9) for r in U.mine(labelled, 0.002, confidence, 3, least).collect()}
            want = {c: round(v, 9) for c, v in rules_by_brute_force(sets, least, confidence, 3).items()}
            assert got == want and (long < 5 or any(len(c) == 3 for c in want)), (keys, short, long, least)
