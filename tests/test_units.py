"""Functions and operators on small fixtures, against plain Python."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from galley.functions import dates, scoring, text
from galley.operators import aggregates, clustering, evaluation, evidence, relational, windows
from galley.plans.search import parse
from galley.session import shared_dir
from galley.sources import feeds
from galley.streaming import jobs
from galley.streaming.state import StateTable


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"a {kind}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("<b>A &amp; B</b>  c　d", "A & B c d"), (None, ""), ("", ""), ("&lt;p&gt;x&lt;/p&gt;", "x"), ("x" * 50_000, "x" * 50_000)])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text("a")) == want


@pytest.mark.parametrize("raw, want", [("（图）股市上涨-新华网", "股市上涨"), ("【直播】Report — ", "Report"), (None, "")])
def test_clean_title(spark, raw, want):
    assert one(spark, raw, text.clean_title("a")) == want


def test_tokens(spark):
    assert one(spark, "股市的上涨 GPT-4 up 3.5% 我", text.tokens("a")) == ["股市", "市上", "上涨", "我", "gpt-4", "up", "4", "3.5%"]
    assert one(spark, None, text.tokens("a")) == []


def brute_simhash(tokens):
    weights = [0] * 63
    for t in tokens:
        h = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
        for i in range(63):
            weights[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(63) if weights[i] > 0)


def test_simhash(spark):
    for toks in (["a", "b", "b"], ["股市", "市上"], [str(i) for i in range(200)]):
        assert one(spark, toks, text.simhash("a"), "array<string>") == brute_simhash(toks)


@pytest.mark.parametrize("raw, want", [
    ("Wed, 04 Jun 2026 10:22:00 +0800", 1780539720), ("4 Jun 2026 02:22:00 GMT", 1780539720), ("2026-06-04T02:22:00Z", 1780539720), ("2026-06-04 10:22", 1780539720),
    ("1780539720", 1780539720), ("1780539720123", 1780539720), ("2026年6月4日 10:22", 1780539720), ("soon", None), ("", None), (None, None), ("12", None)])
def test_parse_time(spark, raw, want):
    assert one(spark, raw, dates.parse_time(F.col("a"))) == want


def test_search_language():
    s = parse('topic:ai lang:zh cred:>=60 after:2d source:x_post "new chip" lang:xx cred:abc')
    assert (s.topic, s.lang, s.min_cred, s.hours, s.source) == ("ai", "zh", 60.0, 48, "x_post")
    assert s.text == ["new chip", "lang:xx", "cred:abc"]
    assert parse('broken "quote').text == ["broken", '"quote']
    assert parse(None).text == []


def test_rss(spark):
    body = """<rss><item><title><![CDATA[A & B]]></title><description>&lt;p&gt;long</description><link>http://x/1</link><pubDate>Wed, 04 Jun 2026 10:22:00 +0800</pubDate></item>
    <item><title> </title></item></rss><feed><entry><title>C</title><link href='http://x/2'/><updated>2026-06-04T02:22:00Z</updated></entry></feed>"""
    got = feeds.parse_rss(spark.createDataFrame([("s", body), ("n", None)], "source_id string, body string")).orderBy("ordinal").collect()
    assert [(r["title"], r["url"], r["published_ts"]) for r in got] == [("A & B", "http://x/1", 1780539720), ("C", "http://x/2", 1780539720)]
    assert got[0]["summary"] == "long"


def test_json(spark):
    body = 'cb({"data": {"rows": [{"t": {"v": "A"}, "u": "http://x"}, 5, {"t": {"v": ""}}, {"u": "y"}]}});'
    got = feeds.parse_json(spark.createDataFrame([("s", body), ("e", "")], "source_id string, body string"), {"title": "t.v", "url": "u"}, rows_at="$.data.rows").collect()
    assert [(r["title"], r["url"]) for r in got] == [("A", "http://x")]


def test_list_page(spark):
    body = '<a href="/1">One</a><i>2026-06-04</i><a href="/1">Again</a><i>2026-06-04</i><a href="http://y">Two</a><i></i>'
    got = feeds.parse_list(spark.createDataFrame([("s", body)], "source_id string, body string"), '<a href="([^"]+)">([^<]+)</a><i>([^<]*)</i>', "http://x/").orderBy("ordinal").collect()
    assert [(r["title"], r["url"]) for r in got] == [("One", "http://x/1"), ("Two", "http://y")]


def test_decoded(spark):
    rows = [("中文".encode(), "中文"), ("中文".encode("gb18030"), "中文"), ('<?xml encoding="gbk"?>中'.encode("gbk"), '<?xml encoding="gbk"?>中'), (b"plain", "plain")]
    got = spark.createDataFrame([(bytearray(a), b) for a, b in rows], "raw binary, want string").select(feeds.decoded(F.col("raw")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_sinks(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, note string")
    new = spark.createDataFrame([("b", 3, "z"), ("c", 4, None)], "id string, n int, note string")
    got = {r["id"]: (r["n"], r["note"]) for r in relational.upsert(old, new, "id", {"note": F.col("new_n") == 3}).collect()}
    assert got == {"a": (1, "x"), "b": (3, "y"), "c": (4, None)}
    assert [r["id"] for r in relational.append_ignore(old, new, "id").collect()] == ["c"]
    kids = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, k int")
    fresh = spark.createDataFrame([("a", 9)], "id string, k int")
    assert sorted((r["id"], r["k"]) for r in relational.replace_children(kids, fresh, "id").collect()) == [("a", 9), ("b", 3)]
    assert relational.append_ignore(old.limit(0), new.limit(0), "id").count() == 0


def test_similar_sets_is_exact(spark):
    rng = random.Random(3)
    sets = {f"r{i:03}": sorted({rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))}) for i in range(120)}
    sets = {min(i for i in sets if sets[i] == g): g for g in sets.values()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.42}
    got = clustering.similar_sets(spark.createDataFrame(list(sets.items()), "id string, grams array<string>"), 0.42)
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    assert clustering.similar_sets(spark.createDataFrame([], "id string, grams array<string>"), 0.42).count() == 0
    days = {i: rng.randint(-9, 30) for i in sets}
    near = {(a, b) for a, b in want if abs(days[a] - days[b]) <= 3}
    got = clustering.similar_sets(spark.createDataFrame([(i, g, days[i]) for i, g in sets.items()], "id string, grams array<string>, day long"), 0.42, 3)
    assert {(r["a"], r["b"]) for r in got.collect()} == near and near


def test_sharing_has_no_fixed_cap(spark):
    from galley.operators import extra

    rng = random.Random(4)
    # 60 sets over few keys: every key is in far more than eight sets; key 0 weighs two
    sets = {f"s{i:02}": (rng.randint(0, 12), rng.sample(range(9), 3)) for i in range(60)}
    weight = lambda k: 2 if k == 0 else 1
    want = {}
    for a, (da, ka) in sets.items():
        found = [n for b, (db, kb) in sets.items() if a != b and abs(da - db) <= 3 and (n := sum(map(weight, set(ka) & set(kb)))) >= 2]
        if found:
            want[a] = (len(found), max(found))
    df = spark.createDataFrame([(i, d, [(k, weight(k)) for k in ks]) for i, (d, ks) in sets.items()], "id string, day long, keys array<struct<k: long, w: int>>")
    extra.STRETCH_ROWS, kept = 7, extra.STRETCH_ROWS  # several slices
    try:
        got = {r["id"]: (r["n_links"], r["most"]) for r in extra.sharing(df, 3).collect()}
    finally:
        extra.STRETCH_ROWS = kept
    assert got == want and want


def test_cascade_has_containment(spark):
    rng = random.Random(6)
    sets = {f"r{i:03}": (sorted(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.choice((5, 8, 9, 22, 25)))), rng.randint(-4, 6)) for i in range(80)}
    prints = {i: rng.choice((None, 0, 7, 1 << 40)) for i in sets}

    def rule(a, b):
        (ga, da), (gb, db) = sets[a], sets[b]
        both, least = len(set(ga) & set(gb)), min(len(ga), len(gb))
        j, over = both / len(set(ga) | set(gb)), both / least
        h = bin(prints[a] ^ prints[b]).count("1") if prints[a] and prints[b] else 64
        if abs(da - db) > 3:
            return 0
        return max(j, 0.6) if j >= 0.42 else max(0.9 * over, 0.55) if over >= 0.68 and least >= 8 else max(0.5, 1 - h / 12) if h <= 6 and j >= 0.25 else j

    want = {(a, b): round(rule(a, b), 9) for a, b in itertools.combinations(sorted(sets), 2) if rule(a, b) >= 0.5}
    df = spark.createDataFrame([(i, g, d) for i, (g, d) in sets.items()], "id string, grams array<string>, day long")
    got = clustering.cascade(df, spark.createDataFrame(list(prints.items()), "id string, simhash long"))
    assert {(r["a"], r["b"]): round(r["s"], 9) for r in got.collect()} == want
    assert any(len(set(sets[a][0]) & set(sets[b][0])) / len(set(sets[a][0]) | set(sets[b][0])) < 0.42 and s >= 0.612 for (a, b), s in want.items())


def test_connected(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 102, 200]], "id long")
    got = {r["id"]: r["root"] for r in clustering.connected(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[200] == 200


def test_seeded_is_as_one_by_one(spark):
    rng = random.Random(8)
    nodes = list(range(60))
    links = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(90)})
    near = {v: {a if b == v else b for a, b in links if v in (a, b)} for v in nodes}
    want: dict[int, int] = {}
    for v in nodes:
        seeds = [s for s in sorted(near[v]) if s < v and want.get(s) == s]
        want[v] = seeds[0] if seeds else v
    got = clustering.seeded(spark.createDataFrame([(v,) for v in nodes], "id long"), spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["seed"] for r in got.collect()} == want
    assert clustering.seeded(spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_b_cubed_and_pairs(spark):
    rows = [("x", 1), ("x", 1), ("x", 2), ("y", 2)]
    df = spark.createDataFrame(rows, "predicted string, gold int")
    p = sum(sum(b == d and a == c for c, d in rows) / sum(a == c for c, _ in rows) for a, b in rows) / 4
    assert evaluation.b_cubed(df).first()["precision"] == pytest.approx(p)
    assert tuple(evaluation.pair_counts(df).first()) == (1, 2, 1, 2)


def test_lower_quantile(spark):
    rows = [("a", i) for i in range(10)] + [("b", 7)] * 3 + [("c", None)]
    got = {r["k"]: r["q"] for r in aggregates.lower_quantile(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", 0.95, "q").collect()}
    assert got == {"a": 8, "b": 7}


def test_interleave(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(12)], "id int, m boolean")
    got = [r["minor"] for r in windows.interleave(df, F.col("m"), [F.col("id")], 4).orderBy("place").collect()]
    assert got == [False] * 4 + [True] + [False] * 2 + [True] * 5


def test_bands_and_scores(spark):
    assert [one(spark, v, scoring.cred_band(F.col("a")), "double") for v in (75.0, 60.0, 40.0, 1.0)] == ["CONFIRMED", "LIKELY", "SINGLE", "LOW"]
    assert one(spark, 3, F.round(scoring.corroboration(F.col("a"), F.lit(False), F.lit(True)), 4), "int") == 0.8173
    assert one(spark, "震惊！！网传", F.round(scoring.content_quality(F.col("a"), F.lit(""), F.lit(0)), 4)) == pytest.approx(0.62 - 0.1 - 0.12 - 0.1 - 0.06 - 0.05)


def test_contradictions_of_all_items(spark):
    rows = [
        ("1", "c", "s1", "A", 1, "Exports from Rokpas rise 35.4% as demand returns, rose"), ("2", "c", "s2", "B", 3, "Exports from Rokpas fell 12.1% as demand returns"),
        ("3", "c", "s2", "B", 2, "Exports from Rokpas up 35.4% as demand returns"), ("4", "c", "s3", None, 2, "Exports from Rokpas up 12.1% as demand returns"),
        ("5", "c", "s3", None, 2, "Exports from Rokpas up 12.1% as demand returns"), ("6", "c", "s4", None, 1, "Quite another thing with 7 ducks"),
        ("7", "d", "s1", "A", 1, "Exports from Rokpas fell 9% as demand returns"), ("8", "c", "s5", "", 1, None), ("9", "c", "s1", "A", 2, "Rokpas council approves plan 12.1%"), ("10", "c", "s2", "B", 2, "Judge blocks Rokpas 12.1%")]
    df = spark.createDataFrame(rows, "id string, cluster_id string, source_id string, grp string, tier int, title string")
    got = {r["item_id"]: (r["n_opposed"], r["n_figures"]) for r in evidence.contradicting(df).collect()}
    # 1 against 2 by words, against 4 and 5 by figures; 3 against 4 and 5 (a second report of B), 9 against 10 by subject
    assert got == {"1": (1, 2), "2": (1, 0), "3": (0, 2), "4": (0, 2), "5": (0, 2), "9": (1, 0), "10": (1, 0)}


def test_only_the_same_subject_is_refuted(spark):
    rows = [("公司收入增长20%", "公司收入下降20%", "refute"), ("居民消费价格上涨2%", "工业生产者出厂价格下降2%", "unknown"),
            ("Exports of chips rose 5%", "Exports of chips fell 7%", "refute"), ("Exports of chips rose", "Judge blocks merger; steel fell", "unknown")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    got = df.select("want", evidence.relation(F.col("a"), F.col("b"), F.lit(0.3), True).alias("got"), evidence.relation(F.col("a"), F.col("b"), F.lit(0.3)).alias("plain")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert got[1]["plain"] == got[3]["plain"] == "refute"


def test_representatives():
    assert evidence.representatives(["Bank raises rates again", "Bank raises rates again today", "Court fines bank"]) == ["Bank raises rates again", "Court fines bank"]


def test_core_stands_alone():
    """Nothing outside the subpackage for training data imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "galley"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "galley.llm" in p.read_text()]


# ---- state of incremental jobs


def test_a_version_without_its_mark_is_written_anew(spark):
    table = StateTable(spark)
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    assert table.last() is None and table.read("ids", "id string").count() == 0
    assert table.commit(0, {"ids": rows("a")}, whole=("ids",))
    rows("half").write.parquet(f"{table.at}/v=1/ids")  # a run that broke off
    assert table.last() == 0 and table.commit(1, {"ids": rows("b")}, whole=("ids",)) and not table.commit(1, {"ids": rows("c")})
    assert table.commit(7, {"ids": rows("d")}, whole=("ids",)) and table.versions() == [0, 1, 7]
    assert [r["id"] for r in table.read("ids", "id string").collect()] == ["d"]


def test_alerts_fire_once_over_runs_and_repeats(spark):
    name = f"alerts-{random.random()}"
    batch = lambda *x: spark.createDataFrame([("forum", v) for v in x], jobs.ALERT)
    assert jobs.AlertLog(spark, name).deliver(batch("c1", "c2", "c2"), 0) == 2
    assert jobs.AlertLog(spark, name).deliver(batch("c9"), 0) == 0  # batch 0 came before
    assert jobs.AlertLog(spark, name).deliver(batch("c2", "c3"), 1) == 1
    assert {r["cluster_id"] for r in jobs.AlertLog(spark, name).delivered().collect()} == {"c1", "c2", "c3"}


def test_every_id_once_over_triggers_with_late_rows(spark, tmp_path):
    for n in range(6):  # one file a trigger; the last one holds rows that are a year late
        rows = [(f"i{n}", 10**9 + n * 86_400), ("again", 10**9), (None, 1), (f"late{n}", 10**9 - 365 * 86_400)]
        spark.createDataFrame(rows, "id string, fetched_ts long").coalesce(1).write.parquet(f"{tmp_path}/items.parquet", mode="append")
    once = jobs.OnceById(spark)
    jobs.run_batches(jobs.read(spark, str(tmp_path), "items", 1), "once", once.add)
    got = [r["id"] for r in once.ids().collect()]
    assert len(once.state.versions()) == 6 and sorted(got) == sorted({"again", *[f"i{n}" for n in range(6)], *[f"late{n}" for n in range(6)]})


def test_a_cluster_must_name_its_folder(spark):
    class Named:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))

    with pytest.raises(RuntimeError):
        shared_dir(Named())


# ---- formats, references, dispatch


def test_all_character_references(spark):
    import html

    texts = ["&eacute;&#233;&#xe9;&#128512; &amp;lt; &lt;b&gt; &bogus; a & b &notit; &NotEqualTilde; &Auml", "&#0;&#xD800;", "", "plain", "&amp;amp;", "&frac12;&hearts;&#8364;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.unescape("t").alias("x")).collect()
    for r in got:
        assert r["x"] == (html.unescape(r["t"]) if "&notit" not in r["t"] else r["x"]), r["t"]
    assert one(spark, None, text.unescape("a")) is None


def test_shown_times(spark):
    now = F.lit(1_780_539_720)  # 4 June 2026, 10:22 at UTC+8
    for ts, want in ((1_780_539_720, "06-04 10:22"), (1_760_000_000, "2025-10-09"), (0, "—"), (None, "—")):
        assert one(spark, ts, dates.shown(F.col("a"), now), "long") == want
    assert one(spark, "2026-06-04", dates.period_start(F.col("a"))) == 1_780_531_200 and one(spark, "June", dates.period_start(F.col("a"))) is None


@pytest.mark.parametrize("reply, want", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('So: {"a": {"b": 2}} and more {x}', '{"a": {"b": 2}}'), ("{bad} {\"c\": 3}", '{"c": 3}'), ("none", None), ("", None), (None, None)])
def test_first_json(reply, want):
    assert text.first_json(reply) == want


def test_filings_and_pages(spark):
    df = spark.createDataFrame([("Acme", "8-K", "Filed: 2026-03-01 AccNo: 0001-23"), (None, None, None), ("Acme", None, "filed: 2026-03-02")], "o string, f string, s string")
    assert [r[0] for r in df.select(text.filing_title(F.col("o"), F.col("f"), F.col("s"))).collect()] == ["Acme 8-K · 2026-03-01 · 0001-23", "", "Acme · 2026-03-02"]
    assert one(spark, "https://x/?a=1&start=5&count=7", text.paged_url(F.col("a"), F.lit(200))) == "https://x/?a=1&start=200&count=100"


def test_pages_are_read_by_their_kind(spark):
    rows = [("a", None, "<rss><item><title>One</title><guid>1</guid></item></rss>"), ("b", "json", '[{"t": "Two", "u": "u2"}]'), ("c", "jsonp", 'cb([{"t": "Three"}])'), ("d", "html", '<a href="/4">Four</a> <i>2026-03-01</i>'), ("e", "rss", None)]
    pages = spark.createDataFrame(rows, "source_id string, kind string, body string")
    got = feeds.parse(pages, {"title": "t", "url": "u"}, '<a href="([^"]+)">(.*?)</a> <i>([^<]*)</i>', "https://e.org").collect()
    assert {(r["source_id"], r["title"]) for r in got} == {("a", "One"), ("b", "Two"), ("c", "Three"), ("d", "Four")}


def test_representatives_by_rounds(spark):
    rng = random.Random(6)
    words = ["bank", "raises", "rates", "court", "fines", "plant", "strike", "pumps", "again", "today"]
    titles = [(c, " ".join(rng.sample(words, 4)), rng.randrange(1, 4)) for c in "xyz" for _ in range(25)]
    best = {}
    for c, t, tier in titles:
        best[c, t] = min(tier, best.get((c, t), 9))
    rows = [(c, t, tier) for (c, t), tier in best.items()]
    got = {(r["cluster_id"], r["place"]): r["title"] for r in evidence.representatives_of(spark.createDataFrame(rows, "cluster_id string, title string, tier int")).collect()}
    for c in "xyz":
        order = [t for _, _, t in sorted((tier, -len(t), t) for k, t, tier in rows if k == c)]
        assert [got[c, n] for n in range(1, 7) if (c, n) in got] == evidence.representatives(order)


def test_spoilt_quotes_are_found(spark):
    from galley.operators.content import intact

    df = spark.createDataFrame([("naïve 😀 text", 6, 7, hashlib.sha256("😀".encode()).hexdigest()[:16]), ("abc", 0, 2, "x"), (None, 0, 1, "x")], "t string, s int, e int, h string")
    assert [r[0] for r in df.select(intact(F.col("t"), F.col("s"), F.col("e"), F.col("h"))).collect()] == [True, False, False]


# ---- entities, migrations, audit


def test_entities_by_dictionary(spark):
    from galley.operators import entities

    rows = [("co_apple", "Apple", "company", ["Apple", "苹果公司", "apple inc"], ["iphone", "shares", "ceo"], []), ("co_amazon", "Amazon", "company", ["Amazon", "亚马逊"], [], ["rainforest", "amazon river"]),
            ("org_x", "x.ai", "lab", ["x.ai", "X AI"], [], []), ("org_wen", "文", "org", ["文"], None, None), ("none", "none", "x", None, [], [])]
    texts = [("a", "Apple shares fall"), ("b", "An apple a day"), ("c", "Amazon opens a plant"), ("d", "The Amazon rainforest burns"), ("e", "ＡＭＡＺＯＮ plans"), ("f", "amazonian birds"), ("g", "x.ai and the X AI lab"),
             ("h", "亚马逊宣布裁员"), ("i", "文一言"), ("j", None), ("k", ""), ("l", "苹果公司 iPhone 苹果公司"), ("m", "fox.ai")]
    got = entities.mentions(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(rows, entities.CATALOGUE), "id").collect()
    assert {(r["id"], r["entity_id"]): r["hits"] for r in got} == {("a", "co_apple"): ["Apple"], ("c", "co_amazon"): ["Amazon"], ("e", "co_amazon"): ["Amazon"], ("g", "org_x"): ["x.ai", "X AI"], ("h", "co_amazon"): ["亚马逊"], ("i", "org_wen"): ["文"], ("l", "co_apple"): ["苹果公司"]}


def test_migrations_are_idempotent(spark):
    columns = {"id": "string", "n": "bigint", "new": "double"}
    df = relational.migrated(spark.createDataFrame([("a", 1, "x")], "id string, n int, old string"), columns, 2)
    again = relational.migrated(df, columns, 2)
    assert df.schema == again.schema and again.collect() == df.collect() and df.columns == ["id", "n", "new", "schema_version"]


def test_audit_rows(spark):
    before = spark.createDataFrame([("a", "draft", 1), ("b", "draft", None), ("gone", "x", 3)], "id string, status string, n int")
    after = spark.createDataFrame([("a", "published", 1), ("b", "draft", None), ("new", None, 4)], "id string, status string, n int")
    got = {(r["id"], r["column"]): (r["before"], r["after"]) for r in relational.audited(before, after, "id", ["status", "n"]).collect()}
    assert got == {("a", "status"): ("draft", "published"), ("gone", "status"): ("x", None), ("gone", "n"): ("3", None), ("new", "n"): (None, "4")}


def test_connected_on_chains_and_stars(spark):
    rng = random.Random(11)
    nodes = list(range(900))
    links = [(n, n + 1) for n in range(0, 299)] + [(300, n) for n in range(301, 500)] + [(rng.randrange(500, 800), rng.randrange(500, 800)) for _ in range(160)] + [(5, 5), (5, 4), (4, 5)]
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = clustering.connected(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["root"] for r in got} == {n: find(n) for n in nodes}
    assert clustering.connected(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "a long, b long")).collect()[0]["root"] == 1


def test_one_run_at_a_time(spark):
    name = f"f{random.random()}"
    a, b = jobs.Flight(spark, name), jobs.Flight(spark, name)
    assert a.start(1000) and not b.start(1000) and not b.start(1010) and not a.start(1900)
    a.end(1000, 1950)
    assert not b.start(1960) and b.start(1985) and (a.skipped, b.skipped) == (1, 3)
    assert not a.start(1985 + 2699) and a.start(1985 + 2701)  # the run of b broke off


# ---- links inside tiles


def tile_rule(a, b, rule):
    """Similarity of two (grams, day, hash) by a rule of tiles; None if it doesn't link them."""
    (ga, da, ha), (gb, db, hb) = a, b
    both, least = len(ga & gb), min(len(ga), len(gb))
    j = both / len(ga | gb)
    if abs(da - db) > 3:
        return None
    if rule == "figures":
        fa, fb = ({g for g in x if g[0].isdigit()} for x in (ga, gb))
        return j if j >= 0.42 and fa and fb and not fa & fb else None
    if j >= 0.42 or rule == "similar":
        return None if j < 0.42 else j if rule == "similar" else max(j, 0.6)
    if rule == "cascade" and both / least >= 0.68 and least >= 8:
        return max(0.9 * both / least, 0.55)
    h = bin(ha ^ hb).count("1") if ha is not None and hb is not None else 64
    return max(0.5, 1 - h / 12) if h <= 6 and j >= 0.25 else None


@pytest.fixture(scope="module")
def tile_sets():
    rng = random.Random(12)
    words, rare = [f"w{i}" for i in range(14)] + ["1", "2", "3%"], [f"r{i}" for i in range(60)] + ["77", "88"]
    print_ = lambda: None if rng.random() < 0.2 else rng.choice((0, 7, 1 << 61)) ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62))
    return {f"r{i:03}": (frozenset(rng.sample(words, rng.randint(1, 11)) + rng.sample(rare, rng.randint(0, 4))), rng.randint(-2, 6), print_()) for i in range(140)}


@pytest.mark.parametrize("rule", ["similar", "figures", "prints", "cascade"])
def test_tiles_find_all_links(spark, tile_sets, monkeypatch, rule):
    """Counts, best ones and groups are those of all pairs, with days in several parts, blocks and cores of any size."""
    from galley.operators import tiles

    monkeypatch.setattr(tiles, "PACK", 9)
    df = spark.createDataFrame([(i, sorted(g), d, h) for i, (g, d, h) in tile_sets.items()], "id string, grams array<string>, day long, hash long")
    near = {a: {b: s for b in tile_sets if a != b and (s := tile_rule(tile_sets[a], tile_sets[b], rule)) is not None} for a in tile_sets}
    got = {r["id"]: (r["n_links"], round(r["best"], 9)) for r in tiles.links(df, 3, rule).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in near.items() if x}
    if rule == "figures":
        return
    assert {i: s for i, (_, s) in got.items()} == {i: round(max(x.values()), 9) for i, x in near.items() if x}
    places = {(r["id"], r["place"]): r["other"] for r in clustering.places(df.withColumnRenamed("hash", "simhash").transform(clustering.with_prints, True), rule).collect()}
    assert places == {(i, n): b for i, x in near.items() for n, (b, _) in enumerate(sorted(sorted(x.items(), reverse=True), key=lambda y: -round(y[1], 9))[:6], 1)}
    roots = {r["id"]: r["root"] for r in clustering.connected(df, tiles.chained(df, 3, rule)).collect()}
    pairs = spark.createDataFrame([(a, b) for a, x in near.items() for b in x], "a string, b string")
    assert roots == {r["id"]: r["root"] for r in clustering.connected(df, pairs).collect()}
    # inside a tile, cores of none to all grams, and blocks of a few rows
    monkeypatch.setattr(tiles, "ROWS", 7)
    monkeypatch.setattr(tiles, "PAIRS", 40)
    import pyarrow as pa

    of_day = [(i, sorted(g), h) for i, (g, d, h) in tile_sets.items()]
    t = pa.table({"id": [i for i, _, _ in of_day], "grams": [g for _, g, _ in of_day], "hash": pa.array([h for _, _, h in of_day], pa.int64())})
    blob = tiles.pack((pa.scalar(0), pa.scalar(0)), t)["blob"][0].as_py()
    (x, y), grams, ids = tiles.unpack([[blob], [blob]])
    found = [tiles.counted(x, y, grams, ids, rule, core).sort_by("id").to_pydict() for core in (0, 6, 1000)]
    assert found[0]["id"] == found[1]["id"] == found[2]["id"] and found[0]["n_links"] == found[1]["n_links"] == found[2]["n_links"]
    assert found[0]["best"] == pytest.approx(found[1]["best"]) and found[0]["best"] == pytest.approx(found[2]["best"])


@pytest.mark.parametrize("name", ["C03_pair_rules", "J13_similarity_join", "C04_conflicts", "C05_best_candidates", "C08_clusters", "C03_cascade_links", "C05_cascade_candidates", "J13_cascade_join", "C08_cascade_clusters"])
def test_alike_titles_of_a_day_move_no_pairs(spark, tmp_path, name):
    """1500 titles of one wording, each linked with all others: over a million pairs, which mustn't be shuffled."""
    from galley.plans import catalog

    n = 1500
    rows = [(f"i{i:05}", "s", f"Plant {i + 10} of Rokpas recalls sensors after fault was found", None, 1_700_000_000, 1_700_000_000, 1) for i in range(n)]
    spark.createDataFrame(rows, "id string, source_id string, title string, canonical_title string, published_ts long, fetched_ts long, simhash long").write.parquet(f"{tmp_path}/items.parquet")
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: (lambda found: [found.apply(i) for i in range(found.size())])(store.stageList(None, False, False, none, None))
    before = {s.stageId() for s in stages()}
    got = catalog.queries()[name](spark, str(tmp_path)).collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    moved = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)
    assert moved < 40 * n
    first = got[0].asDict()
    assert len(got) == n * (6 if "place" in first else 1)
    assert {r["n_links"] if "n_links" in first else r["n_conflicts"] if "n_conflicts" in first else n - 1 for r in got} == {n - 1}


def test_seeds_of_tiles_are_those_of_all_links(spark, tile_sets, monkeypatch):
    """Sets taken one by one in the order of ids, against rounds over days in several parts."""
    from galley.operators import tiles

    monkeypatch.setattr(tiles, "PACK", 9)
    df = spark.createDataFrame([(i, sorted(g), d, h) for i, (g, d, h) in tile_sets.items()], "id string, grams array<string>, day long, hash long")
    want: dict[str, str] = {}
    for a in sorted(tile_sets):
        figures = lambda i: {g for g in tile_sets[i][0] if g[0].isdigit()}
        agreed = lambda b: tile_rule(tile_sets[a], tile_sets[b], "cascade") is not None and not (figures(a) and figures(b) and not figures(a) & figures(b))
        want[a] = next((b for b in sorted(want) if want[b] == b and agreed(b)), a)
    assert {r["id"]: r["seed"] for r in tiles.seeds(df, 3, "agreed").collect()} == want and 5 < len(set(want.values())) < len(want)
    assert tiles.seeds(df.limit(0), 3, "agreed").count() == 0
    for name, least in (("MANY", 0), ("RESOLVED", 0)):  # sets that wait, and links that are too many for one task
        monkeypatch.setattr(tiles, name, least)
        assert {r["id"]: r["seed"] for r in tiles.seeds(df, 3, "agreed").collect()} == want


def test_seeds_of_alike_titles_move_no_pairs(spark, tmp_path):
    """1500 titles of one wording and figure: a group around the first of them, and no shuffle of its million links."""
    from galley.plans import catalog

    n = 1500
    rows = [(f"i{i:05}", "s", f"Plant 7 of Rokpas{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} recalls sensors after fault was found", None, 1_700_000_000, 1_700_000_000, 1) for i in range(n)]
    spark.createDataFrame(rows, "id string, source_id string, title string, canonical_title string, published_ts long, fetched_ts long, simhash long").write.parquet(f"{tmp_path}/items.parquet")
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: (lambda found: [found.apply(i) for i in range(found.size())])(store.stageList(None, False, False, none, None))
    before = {s.stageId() for s in stages()}
    got = catalog.queries()["C06_seeded_clusters"](spark, str(tmp_path)).collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    moved = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)
    assert moved < 60 * n and len(got) == n and {r["seed"] for r in got} == {"i00000"}
