"""Claims, periods, bridges and events on statements whose relation is known."""

import calendar

import pytest

from galley.functions import headlines
from galley.operators import claims, evidence

REFUTE = [
    ("公司收入增长20%", "公司收入下降20%"),
    ("美联储2026年9月降息25个基点", "美联储2026年9月加息25个基点"),
    ("2024年前三季度营业收入增长5.9%", "2024年前三季度营业收入增长7.2%"),
    ("2024年8月份居民消费价格同比上涨0.6%", "国家统计局：8月份居民消费价格同比上涨0.8%"),
]
UNKNOWN = [
    ("公司收入增长20%", "公司收入可能增长20%"),
    ("2025年1月份工业生产者出厂价格同比下降2.3%", "2025年5月份工业生产者出厂价格同比下降3.3%"),
    ("2024年前三季度营业收入增长5.9%", "2024年全年营业收入增长6.0%"),
    ("记账式附息国债第五十七期发行", "记账式附息国债第五十八期发行"),
    ("因暴雨周三全市停课", "因暴雨周四全市停课"),
    ("2024年8月份居民消费价格同比上涨0.6%", "2024年8月份，全国工业生产者出厂价格同比下降1.8%"),
    ("2024年1—6月份全国固定资产投资增长3.9%", "2024年全国固定资产投资增长3.2%"),
    ("2026年一季度全国规模以上文化及相关产业企业营业收入增长6.4%", "2026年上半年全国规模以上文化及相关产业企业营业收入增长4.6%"),
    ("甲骨文 2027 财年第一财季归母净利润 46.79 亿美元，同比增长 60%", "Adobe 2026 财年第三财季归母净利润 18.27 亿美元，同比增长 3.1%"),
]


@pytest.mark.parametrize("claim, title, want", [(*p, "refute") for p in REFUTE] + [(*p, "unknown") for p in UNKNOWN] + [
    ("美联储宣布降息25个基点", "美联储宣布降息25基点", "support"),
    ("French AI startup Mistral valued at over 21 billion euros after funding", "French AI firm Mistral valued at 21 bn euros after funding", "support")])
def test_relations(claim, title, want):
    assert headlines.relation(claim, title, "") == want


@pytest.mark.parametrize("claim, title", [
    ("稳定版发布进入最后倒计时，苹果 iOS / iPadOS 27 RC 推送", "苹果 iOS / iPadOS 26.7 正式版发布"), ("华为 HarmonyOS 7 正式发布", "HMD Asha 305 手机正式发布"),
    ("DeepSeek V4 Pro 0813 vs Claude Fable 5 on DeepSWE: Cost and Routing", "Kimi K3 vs GPT-5.6 Sol on DeepSWE: Cost and Routing")])
def test_version_numbers_refute_nothing(claim, title):
    assert headlines.relation(claim, title, "") != "refute"


def test_years_left_out():
    at = calendar.timegm((2026, 9, 9, 0, 0, 0))
    title = "国家统计局：8月份居民消费价格同比上涨0.8%"
    assert headlines.relation("2024年8月份居民消费价格同比上涨0.6%", title, "", at) == "unknown"
    assert headlines.relation("2026年8月份居民消费价格同比上涨0.6%", title, "", at) == "refute"
    assert headlines.years(frozenset(), "", calendar.timegm((2026, 1, 9, 0, 0, 0))) == {"y:2026", "y:2025"}
    assert headlines.years(frozenset({"y:2024"}), "2023年", at) == frozenset() and headlines.years(frozenset(), "2023年", at) == {"y:2023"}
    assert headlines.years(frozenset(), "", None) == frozenset()


def test_period_of_the_title_counts_beside_the_quote():
    summary = "工业生产者出厂价格指数（PPI）环比由上月下降0.7%转为上涨0.4%，同比涨幅扩大至3.8%。"
    assert headlines.relation("2026年4月份工业生产者出厂价格同比上涨2.8% 环比上涨1.7%", "2026年8月份工业生产者出厂价格同比上涨3.8%", summary) == "unknown"


BRIDGED = [
    ("美联储宣布降息25个基点", "Federal Reserve cuts interest rates by 25 basis points"), ("微软宣布新一轮裁员", "Microsoft announces new round of layoffs"),
    ("苹果公司因违规被罚款5亿美元", "Apple fined $500 million for violations"), ("日本央行宣布加息25个基点", "Bank of Japan raises interest rates by 25 basis points"),
    ("台积电上调全年业绩预期", "TSMC raises full-year earnings forecast"), ("世界卫生组织批准新疫苗", "WHO approves a new vaccine"),
    ("亚马逊宣布新一轮裁员", "Amazon announces another round of layoffs"), ("特斯拉在美国召回汽车", "Tesla recalls vehicles in the United States"),
]
APART = [
    ("美联储宣布降息25个基点", "Federal Reserve cuts interest rates by 50 basis points"), ("苹果公司发布新产品iPhone", "Apple launches new Mac product"),
    ("微软宣布收购游戏公司", "Microsoft acquires a cybersecurity company"), ("苹果公司因隐私违规被罚款", "Apple fined for antitrust violations"),
    ("苹果公司因违规被罚款5亿元人民币", "Apple fined $500 million for violations"), ("美国宣布新的经济政策", "US announces a new economic policy"),
    ("欧洲央行宣布降息", "European Central Bank raises interest rates"), ("日本央行宣布加息", "Bank of Japan cuts interest rates"), ("亚马逊宣布裁员", "Microsoft announces layoffs"),
    ("欧洲宣布新制裁", "Europe announces new sanctions"), ("特斯拉召回2万辆汽车", "Tesla recalls 30,000 vehicles"),
]


@pytest.mark.parametrize("a, b, linked", [(*p, True) for p in BRIDGED] + [(*p, False) for p in APART])
def test_bridges(a, b, linked):
    assert (headlines.bridge(headlines.features(a), headlines.features(b)) >= 0.5) == linked


DIGEST = "IT早报 0914：马斯克、奥尔特曼响应 Anthropic 呼吁放缓前沿 AI 开发；华为麒麟 9050 Pro 能效实测出炉；智谱官宣 50 亿美元融资"
SAME = [
    ("OpenAI's Sam Altman says it would be 'ill-advised' to go public in 2026", "Altman tells Fortune OpenAI will not go public in 2026"),
    ("智谱宣布完成约 50 亿美元融资，用于下一代 GLM 基础模型研发", "智谱获 50 亿美元融资，押注完全自训练与算力"),
    ("Künstliche Intelligenz: OpenAI-Chef verschiebt den Börsengang", "Künstliche Intelligenz: OpenAI-Chef: Börsengang nicht mehr in diesem Jahr"),
]
OTHER = [
    ("纽约股市三大股指12日上涨", "纽约股市三大股指13日上涨"),
    ("部分 AMD 用户反馈 9 月微软 Win11 更新遇兼容问题，引发死机等故障", "部分联想笔记本用户反馈不兼容微软 8 月 Win11 更新，导致随机断电"),
    (DIGEST, "Anthropic CEO outlines plan to slow AI development"),
]


def test_events_of_titles(spark):
    """Every pair stands on days of its own; round-ups merge within one owner only."""
    rows, want = [], {}
    for n, (a, b, one) in enumerate([(*p, True) for p in SAME + BRIDGED] + [(*p, False) for p in OTHER + APART]):
        rows += [(f"{n:02}a", a, f"o{n}", 0, 100 * n), (f"{n:02}b", b, f"p{n}", 0, 100 * n + 1)]
        want[n] = one
    rows += [("90a", DIGEST, "one", 0, 9000), ("90b", DIGEST, "one", 0, 9001), ("91a", DIGEST, "one", 0, 9100), ("91b", DIGEST, "two", 0, 9100), ("92a", None, None, None, 1), ("93a", "", "x", 0, None)]
    want |= {90: True, 91: False}
    _, classes = claims.titled_classes(spark.createDataFrame(rows, "id string, title string, grp string, simhash long, day long"))
    seeds = {r["id"]: r["seed"] for r in claims.clustered(classes).collect()}
    assert {n: seeds[f"{n:02}a"] == seeds[f"{n:02}b"] for n in want} == want


def test_rare_words_are_a_conflict():
    a, b = "贵州省委主要负责同志职务调整", "天津市委主要负责同志职务调整"
    got = headlines.conflict(headlines.features(a), headlines.features(b), headlines.grams(a), headlines.grams(b), frozenset({"贵州"}), frozenset({"天津"}))
    assert got == "words"


def test_cards(spark):
    rows = [("c", "a", "paper-a", "reporting", "公司收入增长20%"), ("c", "b", "b", "reporting", "公司收入下降20%"), ("c", "x", "x", "reporting", "公司收入可能增长20%"),
            ("d", "a", "paper-a", "reporting", "美联储宣布降息25个基点"), ("d", "b", "paper-b", "wire", "美联储宣布降息25基点"),
            ("e", "a", "fed", "official", "美联储发布利率决定"), ("f", "a", "paper", "reporting", "公司发布季度业绩"), ("f", "b", "portal", "aggregator", "公司发布季度业绩")]
    claim = {c: t for c, _, _, _, t in reversed(rows)}
    df = spark.createDataFrame([(c, i, g, r, claim[c], t, None, 1_000_000) for c, i, g, r, t in rows], "cluster_id string, item_id string, grp string, role string, claim string, title string, summary string, published long")
    found = claims.held_against(df)
    quotes = {(r["cluster_id"], r["item_id"]): r for r in found.collect()}
    q = quotes["d", "a"]
    assert (q["quote_field"], q["quote"], q["relation"], len(q["quote_hash"])) == ("title", "美联储宣布降息25个基点"[q["quote_start"] : q["quote_end"]], "support", 16)
    got = {r["cluster_id"]: r for r in evidence.status_of(found).collect()}
    assert {c: r["status"] for c, r in got.items()} == {"c": "disputed", "d": "independently_reported", "e": "official_statement", "f": "single_report"}
    assert (got["c"]["n_support"], got["c"]["n_refute"], got["c"]["n_unknown"]) == (1, 1, 1) and got["f"]["independent_groups"] == 1


def test_gates_of_the_evaluation(spark):
    """Linked pairs as gold: the engine's own events must reach the desk's gates."""
    rows, gold = [], []
    for n, (a, b, one) in enumerate([(*p, True) for p in SAME + BRIDGED] + [(*p, False) for p in OTHER + APART]):
        rows += [(f"{n:02}a", a, f"o{n}", 0, 100 * n), (f"{n:02}b", b, f"p{n}", 0, 100 * n + 1)]
        gold += [(f"{n:02}a", f"g{n}"), (f"{n:02}b", f"g{n}" if one else f"h{n}")]
    members, classes = claims.titled_classes(spark.createDataFrame(rows, "id string, title string, grp string, simhash long, day long"))
    events = members.join(claims.clustered(classes).withColumnRenamed("id", "class"), "class").select("id", "seed")
    got = claims.evaluated(events.withColumnRenamed("seed", "predicted").join(spark.createDataFrame(gold, "id string, gold string"), "id")).first()
    assert got["pair_precision"] >= 0.95 and got["pair_recall"] >= 0.80 and got["b_f1"] >= 0.88


def test_links_by_rare_words_are_those_of_all_pairs(spark):
    """Titles with rare words, without, and with bridges: the same links as from every pair of like wording."""
    import random

    rng = random.Random(5)
    names, common = [f"Zor{chr(97 + i)}pel" for i in range(26)], "plant recalls sensors after fault found near the old port and river".split()
    titles = [" ".join(rng.sample(names, rng.choice((0, 0, 1, 2))) + rng.sample(common, rng.randint(3, 9))) for _ in range(150)] + [t for pair in SAME + BRIDGED + APART for t in pair]
    rows = [(f"t{n:03}", t, f"o{n % 7}", rng.choice((0, None, 9, 11)), n % 5) for n, t in enumerate(titles)]
    _, classes = claims.titled_classes(spark.createDataFrame(rows, "id string, title string, grp string, simhash long, day long"))
    want = {(r["a"], r["b"]): r["s"] for r in claims.event_links(classes).filter("against is null and s >= 0.5").collect()}
    assert {(r["a"], r["b"]): r["s"] for r in claims.linked(classes).collect()} == want and len(want) > 50


def test_conflicts_inside_tiles_are_those_of_all_pairs(spark, monkeypatch):
    """Counts by reason, with days in several parts, round-ups, figures, entities and rare words."""
    import random
    from collections import Counter

    from galley.operators import tiles

    monkeypatch.setattr(tiles, "PACK", 9)
    rng = random.Random(8)
    names, common = [f"Zor{chr(97 + i)}pel" for i in range(12)], "plant recalls iPhone sensors after fault found near old port Apple Microsoft launches fined 12 14% 苹果公司 发布".split()
    titles = [" ".join(rng.sample(names, rng.choice((0, 0, 1, 2))) + rng.sample(common, rng.randint(4, 11))) + rng.choice(("", "", "", "; a; b")) for _ in range(150)] + [t for pair in SAME + BRIDGED + APART + OTHER for t in pair]
    rows = [(f"t{n:03}", t, f"o{n % 3}", rng.choice((0, None, 9, 11)), n % 5) for n, t in enumerate(titles)]
    _, classes = claims.titled_classes(spark.createDataFrame(rows, "id string, title string, grp string, simhash long, day long"))
    want = Counter()
    for r in claims.event_links(classes).filter("against is not null and s >= 0.5").collect():
        want[r["a"], r["against"]] += 1
        want[r["b"], r["against"]] += 1
    assert {(r["id"], r["against"]): r["n"] for r in claims.opposing(classes).collect()} == want
    assert {why for _, why in want} == set(claims.REASONS)


@pytest.mark.parametrize("t", ["Apple Launches new iPhone", "ＡＰＰＬＥ 苹果公司", "Tesla recallſ cars in the uK", "ENTRÉE EN BOURSE", "mıcrosoft probe", "", "Börsengang VERSCHOBEN"])
def test_possible_labels_are_all_that_match(t):
    for kind, patterns in headlines._NAMES.items():
        assert {label for label, p in patterns.items() if p.search(t)} <= set(headlines.possible(t, kind))
