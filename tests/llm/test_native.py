import hashlib

from pyspark.sql import functions as F

from gneiss.llm.chat import escaped, formatted, read_back, unescaped
from gneiss.llm.components import components
from gneiss.llm.members import with_ids, without_ids
from gneiss.llm.url_rules import OP8_SQL, declared_links, host_of, judged, path_of, resolved

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip(spark):
    rows = [
        (1, 0, "user", "a <|end|> b", ""), (1, 1, "user", None, ""), (1, 2, "assistant", "</s>[INST] ok [/INST]", ""), (1, 2, "assistant", "tie\\", ""), (1, 3, None, "<|sep|><\\|", ""),
        (2, 0, "assistant", "", ""), (None, None, "us|er", "x|>", ""), (3, 0, "user", "y" * 50000, ""), (3, 0, "user", "y" * 50000, ""),
    ]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in read_back(formatted(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a <|end|> b"), ("user", ""), ("assistant", "</s>[INST] ok [/INST]"), ("assistant", "tie\\"), ("", "<|sep|><\\|")]
    assert got[1].learned == "</s>[INST] ok [/INST]tie\\" and got[2].learned == "" and len(got[3].turns) == 2 and tuple(got[None].turns[0]) == ("us|er", "x|>")
    assert got[1].formatted.count("<|end|>") == 3
    assert formatted(df.limit(0)).count() == 0


def test_escapes(spark):
    texts = ["\\", "\\\\", "<|", "|>|>", "[INST][/INST]", "<s></s>", "<<SYS>>\\<</SYS>>", "<\\|", "plain", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in got) and not any(c in r.e for r in got for c in ("<|", "|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>"))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_members(spark):
    rows, ids = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "doc_id long, text string"), spark.createDataFrame([(2,), (9,)], "doc_id long")
    assert sorted(r.text for r in with_ids(rows, ids).collect()) == ["b", "d"] and sorted(r.text for r in without_ids(rows, ids).collect()) == ["a", "c"]


def test_url_parts(spark):
    urls = [None, "", "no-scheme/x", "http://A.org/x?y#z", "https://b.com", "x://c.net?q=/p", "http://d.org#f/g", "a://b://c"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")), path_of(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("", ""), ("", ""), ("", ""), ("a.org", "/x"), ("b.com", ""), ("c.net", ""), ("d.org", ""), ("b:", "//c")]


def test_rules_and_aliases(spark):
    canonical = '<link rel="canonical" href="https://example.org/es/1">'
    rows = [
        (1, "http://x.example.org/es/9", ""), (2, "http://example.org/en/12", ""), (3, "http://example.org/en/2", ""), (4, "http://other.net/a", canonical), (5, "http://other.net/a/?utm_source=f#top", None),
        (6, "http://third.net/b", '<meta http-equiv="refresh" content="0; url=http://other.net/a">'), (7, "https://example.org/es/1", ""), (8, "http://a.com/de/x", ""), (9, "http://a.com/fr/x", canonical), (10, None, None),
        (11, "http://free.net/", canonical.replace("org/es/1", "org/en/2")), (12, "http://notexample.org/es/1", ""), (12, "http://notexample.org/es/1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.rule, r.verdict) for r in judged(pages, declared_links(pages)).collect()}
    # 9 allows its own address, and its link makes it an alias of 7, so 4, 5 and 6, which no rule fits, aren't blocked with 7.
    assert got == {
        1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("example.org/es/", "block"),
        8: ("com/de/", "block"), 9: ("com/fr/", "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: ("org/", "allow"),
    }
    fewer = pages.where("page_id <> 9")
    got = {r.page_id: r.verdict for r in judged(fewer, declared_links(fewer)).collect()}
    assert got[4] == got[5] == got[6] == "block" and got[11] == "allow"
    assert judged(pages.limit(0), declared_links(pages.limit(0))).count() == 0


def test_rules_reach_pages_through_addresses_that_are_no_pages(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://one.net/a", link.format("https://shop.com/de/7/")), (2, "http://two.net/a", link.format("http://one.net/a")), (3, "http://three.net/a", link.format("https://shop.com/xx/7")),
        (4, "http://four.net/a", link.format("https://shop.com/de/8") + link.format("https://b.org/")), (5, "http://five.net/a", link.format("/de/relative")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in judged(pages, declared_links(pages)).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow")}


def test_targets_are_resolved(spark):
    cases = [
        ("https://b.org/x?y", "https://b.org/x?y"), ("//b.org/x", "http://b.org/x"), ("/de/7?u=http://c.net/#f", "http://a.com/de/7?u=http://c.net/#f"), ("7", "http://a.com/d/7"), ("./7/../8", "http://a.com/d/8"),
        ("../../..", "http://a.com/"), ("?z", "http://a.com/d/p?z"), ("#f", "http://a.com/d/p?q=1"), ("", "http://a.com/d/p?q=1"), ("mailto:x", "mailto:x"), ("..", "http://a.com/"), ("7..8/.x", "http://a.com/d/7..8/.x"),
    ]
    got = spark.createDataFrame(cases, "t string, want string").select("t", "want", resolved(F.col("t"), F.lit("http://a.com/d/p?q=1")).alias("got"))
    assert got.where("not got <=> want").collect() == []
    assert spark.range(1).select(resolved(F.lit("x"), F.lit("http://a.com"))).first()[0] == "http://a.com/x"


def test_relative_and_quoted_links_are_aliases(spark):
    link, moved = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0;url={}">'
    rows = [
        (1, "http://shop.com/xx/7", moved.format("/de/7")), (2, "http://shop.com/xx/8", link.format("../de/8")), (3, "http://one.net/a", link.format("//shop.com/de/9")), (4, "http://two.net/a", moved.format("'https://shop.com/de/7'")),
        (5, "http://three.net/a", '<base href="http://shop.com/de/">' + link.format("5")), (6, "http://four.net/a", link.format("b?u=http://shop.com/de/7")), (7, "http://four.net/b", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in judged(pages, declared_links(pages)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}


def test_links_that_only_look_like_links_and_the_sql(spark):
    """Comments, scripts, styles and titles declare nothing; rel holds tokens; quotes hold brackets. SQL and expressions agree on all pages."""
    import duckdb

    bad, also = '<link rel="canonical" href="https://shop.com/de/7">', '<LINK href=https://shop.com/de/7 REL=canonical>'
    rows = [
        (1, "http://p1.net/", f"<!-- {bad} -->"), (2, "http://p2.net/", f"<script>var t='{bad}';</script>"), (3, "http://p3.net/", f"<style>{bad}</style><title>{bad}</title><template>{bad}</template>"), (4, "http://p4.net/", f"<!-- open {bad}"),
        (5, "http://p5.net/", '<link title="a > b" rel="alternate canonical" href="https://shop.com/de/7">'), (6, "http://p6.net/", also), (7, "http://p7.net/", "<link rel='canonical' href='/x' data-href='https://shop.com/de/1'>"), (8, "http://p8.net/", bad.replace("canonical", "canonical-not")),
        (9, "http://p9.net/", f"<!-- a --><p>{bad}"), (10, "http://p10.net/", "<meta content=\"3; URL='https://shop.com/de/7?a=1&amp;b=2'\" http-equiv='Refresh'>"), (11, "http://p11.net/", f"<base target=_top><base href='https://shop.com/de/'><link rel=canonical href=9>"), (12, "no host", bad),
        (13, "http://p13.net/d/e", '<link rel=canonical href="../../.././de/..">'), (14, "http://shop.com/fr", '<link rel="canonical" href="./../de/x?y#z">'), (15, "http://p15.net/a", '<link rel="canonical" href="?q=1">'), (15, "http://p15.net/a?q=1", bad), (16, None, bad), (17, "http://p17.net/", None),
        (18, "http://p18.net/", '<link rel="canonical" href="//shop.com/de/7">' + "<i a='x'>" * 3000), (19, "http://p19.net/" + "a" * 5000, bad), (20, "http://p20.net/", '<link rel="canonical" href="">'), (21, "http://p21.net/b", "<textarea>" + bad),
    ]
    rows += [(100 + i, f"http://hub{i}.net/", '<link rel="canonical" href="http://hub.net/">') for i in range(60)] + [(99, "http://hub.net/", bad)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("host", F.lit("h"))
    got = sorted(tuple(r) for r in judged(pages, declared_links(pages)).collect())
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toArrow())
    assert got == sorted(con.execute(OP8_SQL).fetchall())
    blocked = {r[0] for r in got if r[4] == "block"}
    assert blocked == {5, 6, 9, 10, 11, 14, 15, 18, 19, 99, *range(100, 160)}


def test_long_conversations_and_texts_over_pages(spark):
    """Ten thousand turns, runs of them and pages of text, characters of four bytes: turns and mask come back."""
    turn = lambda i: (9, i, ("user", "assistant", "assistant", "system")[i * i % 4 if i % 7 else 1], "é😀<|x|>"[: i % 8] + f"t{i}\\" + "z" * (5000 if i % 2500 == 1 else i % 30), "")
    rows = [turn(i) for i in range(10_000)] + [(10, i, "assistant", "😀" * n, "") for i, n in enumerate([4096, 0, 4083, 4096, 1, 9000])] + [(11, i, "assistant", f"{i}", "") for i in range(256)]
    got = {r.conv_id: r for r in read_back(formatted(spark.createDataFrame(rows, TURNS))).collect()}
    for conv in (9, 10, 11):
        want = [(r[2], r[3]) for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv].turns] == want and got[conv].learned == "".join(t for role, t in want if role == "assistant")
