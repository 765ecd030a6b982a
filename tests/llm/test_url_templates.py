from critiq.llm import url_templates as U

COLUMNS = "page_id long, url string, verdict string"


def judge(spark, urls, **options):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], COLUMNS)
    return {r["page_id"]: r for r in U.judge_urls(pages, **options).collect()}


def test_host_path_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://h.com/de/1": ("h.com", "/de/1", "com/de/", "block"),
        "x://h.com/fr/": ("h.com", "/fr/", "com/fr/", "allow"),
        "x://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
        "x://h.org": ("h.org", "", None, "allow"),
        "x://h.org?a=/b://c": ("h.org", "", None, "allow"),
        "x://É.net/a": ("É.net", "/a", None, "allow"),
        "no scheme/de/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "x://h.com:80/de/": ("h.com:80", "/de/", None, "allow"),
    }
    found = judge(spark, list(cases))
    for i, expected in enumerate(cases.values()):
        row = found[i]
        assert (row["host"], row["path"], row["rule"]) == expected[:3]
        if expected[2] is not None:
            assert row["verdict"] == expected[3]


def test_longest_rule_wins_and_ties(spark):
    rules = [U.Rule("b.c", "/aa", "allow"), U.Rule("a.b.c", "/", "block"), U.Rule("c", "/aa/bb/cc", "block")]
    found = judge(spark, ["x://a.b.c/aa", "x://a.b.c/aa/bb/cc/d", "x://z.b.c/aa"], rules=rules)
    assert [found[i]["rule"] for i in range(3)] == ["a.b.c/", "c/aa/bb/cc", "b.c/aa"]


def labelled(spark, rows):
    pages = spark.createDataFrame([(i, u, label) for i, (u, label) in enumerate(rows)], "page_id long, url string, bad int")
    return {r["page_id"]: r for r in U.judge_urls(pages, rules=[], label=pages["bad"]).collect()}


def test_impure_templates_go(spark):
    rows = [(f"x://h.net/spam/{i}.html", 1) for i in range(40)] + [(f"x://h.net/news/{i}.html", 0) for i in range(40)]
    rows += [("x://h.net/spam/999.html", None), ("x://h.net/news/999.html", None), ("x://h.net/other/1", None)]
    found = labelled(spark, rows)
    assert [found[i]["verdict"] for i in (80, 81, 82)] == ["block", "allow", "allow"]
    assert found[80]["template"] == "/spam/{n}.html" and found[80]["purity"] > 0.9 > 0.1 > found[81]["purity"]


def test_many_values_become_a_wildcard_and_alike_branches_one(spark):
    rows = [(f"x://h.net/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/page", i % 2) for i in range(60)]
    found = labelled(spark, rows)
    assert {r["template"] for r in found.values()} == {"/*/page"}
    assert len({r["purity"] for r in found.values()}) == 1
    few = [(f"x://h.net/{name}/{i}", i % 2) for name in ("aa", "bb", "cc") for i in range(30)]
    found = labelled(spark, few)
    assert {r["template"] for r in found.values()} == {"/aa/{n}", "/bb/{n}", "/cc/{n}"}
    assert len({r["purity"] for r in found.values()}) == 1  # merged, because their labels do not differ


def test_templates_that_differ_at_the_fifth_segment(spark):
    rows = [(f"x://h.net/a/b/c/d/{kind}/{i}", bad) for kind, bad in (("spam", 1), ("news", 0)) for i in range(40)]
    rows += [("x://h.net/a/b/c/d/spam/999", None), ("x://h.net/a/b/c/d/news/999", None), ("x://h.net/a/b", None)]
    pages = spark.createDataFrame([(i, u, label) for i, (u, label) in enumerate(rows)], "page_id long, url string, bad int")
    found = {r["page_id"]: r for r in U.judge_urls(pages, rules=[], label=pages["bad"], depth=None).collect()}
    assert len(found) == 83 and [found[i]["verdict"] for i in (80, 81, 82)] == ["block", "allow", "allow"]
    assert [found[i]["template"] for i in (80, 81, 82)] == ["/a/b/c/d/spam/{n}", "/a/b/c/d/news/{n}", "/a/b"]


def test_query_reads_whole_paths(spark, tmp_path):
    from critiq.llm.queries import QUERIES

    urls = [(1, "x://h.com/a/b/c/d/e/f"), (2, "x://h.com/a"), (3, None)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["op2_url_templates"](spark, str(tmp_path)).collect()
    assert {r["page_id"]: r["template"] for r in found} == {1: "/a/b/c/d/e/f", 2: "/a", 3: ""}


def test_edge_cases(spark):
    urls = ["x://h.com/de/1"] * 3 + [None, None, "x://h.com//a///b/c/d/e/f"]
    assert judge(spark, urls)[5]["template"] == "/a/b/c/d/e/f"  # to the last segment, unless a depth is named
    found = judge(spark, urls, depth=3)
    assert len(found) == 6 and found[5]["path"] == "//a///b/c/d/e/f" and found[5]["template"] == "/a/b/c"
    empty = spark.createDataFrame([], COLUMNS)
    assert U.judge_urls(empty).count() == 0


def test_a_very_long_path(spark):
    long = "/".join(f"s{i}" for i in range(500))
    urls = [(i, f"http://a.net/x/{i % 3}/y/{long if i == 1 else 'z'}/{i}", i % 2) for i in range(40)]
    pages = spark.createDataFrame(urls, "page_id long, url string, bad int")
    found = {r["page_id"]: r for r in U.judge_urls(pages, rules=[], label=pages["bad"]).collect()}
    assert found[1]["template"].count("/s{n}") == 500 and found[1]["purity"] > 0.99 and found[1]["verdict"] == "block"


def test_paths_followed_alone_get_the_purity_of_every_level(spark, monkeypatch):
    urls = [(i, f"http://h{i % 2}.net/a/b/c{i % 4}/d{i % 5}/e{i}/f/g", i % 3 > 0) for i in range(60)]
    pages = spark.createDataFrame([(i, u, int(b)) for i, u, b in urls], "page_id long, url string, bad int")
    judge = lambda: {r["page_id"]: (r["template"], round(r["purity"], 12)) for r in U.judge_urls(pages, rules=[], label=pages["bad"]).collect()}
    at_once = judge()
    monkeypatch.setattr(U, "_one_path_left", lambda tree, k: (tree, tree.limit(0)))
    assert judge() == at_once
