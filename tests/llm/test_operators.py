"""Each operator against brute force, an exact round trip or held-out accuracy."""

import itertools
import random
import unicodedata

import fixture
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.llm import caps, conduct, encodings, languages, mixing, neardup, pages, tokens, truncation, unify

# ---- 1


def test_cut_texts(spark):
    names = ["Alder", "Birch", "Cedar", "Dunes", "Elmwood", "Fallow", "Grove", "Heath"]
    whole = [f"The plant near {n} employs {k} people and ships pumps to {k + 3} customers. Suppliers in {n} expect {k} new contracts this year." for k, n in enumerate(names * 6)]
    rows = [(f"w{i}", "full", t) for i, t in enumerate(whole)]
    rows += [(f"s{i}", "bare", t[:-1]) for i, t in enumerate(whole[:20])]  # never a full stop
    rows += [(f"c{i}", "cut", t[:48]) for i, t in enumerate(whole[:24])]
    rows += [(f"d{i}", "dots", t[: t.rindex(" ", 0, 90)] + "…") for i, t in enumerate(whole[:12])]
    rows += [("tag", "full", whole[0][:60] + '<a href="http'), ("half", "full", whole[1][:61] + "�"), ("null", "full", None), ("empty", "full", "")]
    got = truncation.truncated(spark.createDataFrame(rows, "item_id string, source string, text string")).filter("odds > 1")
    found = {r["item_id"] for r in got.collect()}
    assert not {i for i, s, _ in rows if s == "bare"} & found and not {i for i in found if i.startswith("w")}
    assert len([i for i in found if i.startswith("c")]) == 24 and len([i for i in found if i.startswith("d")]) == 12
    assert {"tag", "half"} <= found


def test_long_words_and_garbled_ends(spark):
    long = "Donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichenverordnungsentwurf"
    whole = [f"Die Stadt {n} beriet am Abend über den {long} der Kammer {k}." for k, n in enumerate(["Alder", "Birke", "Ceder", "Dunes"] * 90)]
    rows = [(f"w{i}", "a", t) for i, t in enumerate(whole)]
    rows += [("cut", "b", whole[0][: whole[0].index(long) + 70]), ("early", "b", whole[1][: whole[1].index(long) + 26])]
    rows += [("garbled", "c", "Die Stadt Alder beriet am Abend über die M�tze der K�mm�r"), ("fine", "c", whole[2])]
    got = truncation.truncated(spark.createDataFrame(rows, "item_id string, source string, text string")).collect()
    assert {r["item_id"] for r in got if r["odds"] > 1} == {"cut", "early"} and all(r["mid"] for r in got if r["item_id"] in ("cut", "early"))
    assert [r["end"] for r in got if r["item_id"] == "garbled"] == [truncation.BLURRED]


@pytest.mark.parametrize("text, want", [("Go on...", ("Go on", "dots")), ("x [...]", ("x", "dots")), ("vis<a href=", ("vis", "tag")), ("caf�", ("caf", "half")), ("done.", ("done.", "")), ("a &#82", ("a", "tag"))])
def test_split_end(text, want):
    assert truncation.split_end(text) == want


# ---- 2


def _variants(rng, n):
    vocabulary = [f"w{i}" for i in range(3000)]
    out = {}
    for i in range(n):
        base = [" ".join(rng.choices(vocabulary, k=14)) for _ in range(6)]
        out[f"a{i:03}"] = base
        if i % 3 == 0:
            edited = base[1:] + base[:1]  # another order
            words = edited[0].split()
            words[4] = "changed"
            out[f"b{i:03}"] = [" ".join(words), *edited[1:]]
        if i % 5 == 0:
            out[f"c{i:03}"] = list(base)
        if i % 4 == 0:
            out[f"d{i:03}"] = base[:5] + ["one more sentence at the end of it"]
    return {k: ". ".join(v) for k, v in out.items()}


def test_near_duplicates_against_all_pairs(spark):
    texts = _variants(random.Random(1), 60)
    rows = [(k, None, v) for k, v in texts.items()] + [("short", "t", "too short"), ("null", None, None), (None, "x", "y " * 200)]
    members, links = neardup.members_and_links(spark.createDataFrame(rows, "id string, title string, summary string"))
    reps = {r["id"]: r["rep"] for r in members.collect()}
    linked = {frozenset((r["a"], r["b"])) for r in links.collect()}
    sets = {k: neardup.shingles(neardup.tokens("\n" + v)) for k, v in texts.items()}
    want = [(x, y) for x, y in itertools.combinations(texts, 2) if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= neardup.THRESHOLD]
    got = [(x, y) for x, y in want if reps[x] == reps[y] or frozenset((reps[x], reps[y])) in linked]
    assert len(want) > 40 and len(got) >= 0.98 * len(want)
    assert "short" not in reps and len(linked) <= len(want)


def _sketched(spark, rows):
    reps = [(i, t, neardup.signature(neardup.shingle_codes(t.split(" "), {}))) for i, t in rows]
    return spark.createDataFrame(reps, "rep long, text string, sig binary")


def _near_threshold(n_pairs):
    rows = []
    for n in range(n_pairs):
        words = [f"w{n}x{i}" for i in range(120)]
        other = [f"{w}e" if i % 10 == 5 and i < 110 else w for i, w in enumerate(words)]  # eleven edits, each breaks five shingles
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    return rows


def test_pairs_near_the_threshold_are_candidates(spark):
    rows = _near_threshold(200)
    a, b = (neardup.shingles(t.split(" ")) for _, t in rows[:2])
    assert neardup.THRESHOLD < len(a & b) / len(a | b) < 0.36
    got = {(r["a"], r["b"]) for r in neardup.similar_reps(_sketched(spark, rows)).collect()}
    assert got <= {(2 * n, 2 * n + 1) for n in range(200)} and len(got) >= 196
    assert 1 - (1 - neardup.THRESHOLD**neardup.ROWS) ** neardup.BANDS >= 0.989


def test_hot_band_keys_lose_nothing(spark, monkeypatch):
    rows = _near_threshold(30)
    stem = " ".join(f"s{i}" for i in range(90))
    rows += [(1000 + n, f"{stem} " + " ".join(f"e{n}x{i}" for i in range(10))) for n in range(60)]  # sixty that share most keys
    reps = _sketched(spark, rows)
    want = {(r["a"], r["b"]) for r in neardup.similar_reps(reps).collect()}
    assert len(want) >= 60 * 59 // 2 + 28
    key, rep = np.repeat([3, 5, 9], [7, 25, 4]), np.arange(36)
    monkeypatch.setattr(neardup, "HOT", 8)
    met = neardup.paired(spark.createDataFrame(list(zip(key.tolist(), rep.tolist())), "key long, rep long")).collect()
    assert {(r["a"], r["b"]) for r in met if r["key"] is None} == {p for part in (range(7), range(32, 36)) for p in itertools.combinations(part, 2)}
    assert {(r["key"], r["a"]) for r in met if r["b"] is None} == {(5, k) for k in range(7, 32)}
    members = spark.createDataFrame([(5, 1000 + n) for n in range(60)], "key long, rep long")
    got = [(r["a"], r["b"]) for r in neardup.hot_pairs(members, reps.select("rep", "sig")).collect()]
    assert len(got) == len(set(got)) and set(got) == set(itertools.combinations(range(1000, 1060), 2))


def test_runs_are_the_same_wherever_batches_end(spark):
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 60, 900))
    rows = spark.createDataFrame([(int(k), n) for n, k in enumerate(key)], "key long, rep long").coalesce(1)
    want = {p for k in set(key) for p in itertools.combinations(np.flatnonzero(key == k).tolist(), 2)}
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert {(r["a"], r["b"]) for r in neardup.paired(rows).collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pruning_keeps_what_it_must():
    rng = np.random.default_rng(5)
    for s in (0.45, 0.6, 0.8):
        a = rng.integers(0, 256, (3000, neardup.SIGNATURE)).astype(np.uint8)
        b = np.where(rng.random(a.shape) < s, a, rng.integers(0, 256, a.shape).astype(np.uint8))
        assert neardup.survives(a, b).mean() > 0.99
    b = np.where(rng.random(a.shape) < 0.05, a, rng.integers(0, 256, a.shape).astype(np.uint8))
    assert neardup.survives(a, b).mean() < 0.02


def test_groups_of_a_long_chain(spark, dirty):
    words = [f"c{i}" for i in range(1500)]
    chain = spark.createDataFrame([(f"k{n:03}", None, " ".join(words[n * 20 : n * 20 + 60])) for n in range(70)], "id string, title string, summary string")
    members, links = neardup.members_and_links(chain)
    from galley.operators.clustering import connected

    got = connected(members.select("rep"), links, "rep")
    assert got.select("root").distinct().count() == 1


# ---- 3


def test_caps_against_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaaaaab") if i % 2 else "c", rng.choice([None, 0.5, 0.5, 0.501, rng.random()]), f"{rng.randrange(16**6):06x}{i}") for i in range(900)]
    for cap in (0, 1, 7, 150, 5000):
        want = set()
        for c in "abc":
            mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
            want |= {r[2] for r in mine[:cap]}
        state = caps.CapState(spark, cap)
        for part in (rows[:300], rows[300:650], rows[650:]):
            state.add(spark.createDataFrame(part, caps.KEPT))
        assert {r["record"] for r in state.kept.collect()} == want
        lost = [r["record"] for r in state.log().collect()]
        assert len(lost) == len(set(lost)) == len(rows) - len(want)


def test_cap_state_outlives_its_run(spark):
    import uuid

    name = f"caps-{uuid.uuid4().hex}"
    batches = [[("a", float(10 * n + k), f"r{n}{k}") for k in range(5)] for n in range(4)]
    for n, rows in enumerate(batches):  # a new handle every time, as in a new run
        state = caps.CapState(spark, 3, name)
        assert state.add(spark.createDataFrame(rows, caps.KEPT), n)
        assert not state.add(spark.createDataFrame([("a", 999.0, "again")], caps.KEPT), n)
    state = caps.CapState(spark, 3, name)
    assert {r["record"] for r in state.kept.collect()} == {"r34", "r33", "r32"}
    assert state.log().count() == 17 == state.log().select("record").distinct().count()


# ---- 4


def test_languages_held_out():
    import duckdb

    rows = duckdb.sql("select lang, text from '/root/testdata/sf0.01/lang_samples.parquet' order by sample_id").fetchall()
    train, test = [r for k, r in enumerate(rows) if k % 4], [r for k, r in enumerate(rows) if not k % 4]
    tagger = languages.train(train)
    got = languages.languages_of(tagger, [t for _, t in test])
    assert np.mean([len(g) == 1 and g[0][0] == lang for g, (lang, _) in zip(got, test)]) >= 0.95
    pairs = [(a, b) for a, b in zip(test, test[17:]) if a[0] != b[0] and min(len(a[1]), len(b[1])) > 40]
    both = languages.languages_of(tagger, [f"{a[1]} | {b[1]}" for a, b in pairs])
    assert np.mean([{s[0] for s in g} == {a[0], b[0]} for g, (a, b) in zip(both, pairs)]) >= 0.8
    assert all(0 <= s[3] <= 1 for g in both for s in g)


@pytest.mark.parametrize("label, want", [("en-US", "en"), ("ENG", "en"), ("zh_Hans", "zh"), ("und", None), (" ", None), (None, None), ("n/a", None), ("ja", "ja"), ("deu", "de"), ("xx", None)])
def test_labels(label, want):
    assert languages.label_language(label) == want


def test_the_language_before_the_damage():
    import duckdb

    rows = duckdb.sql("select lang, text from '/root/testdata/sf0.01/lang_samples.parquet' order by sample_id").fetchall()
    tagger = languages.train([r for k, r in enumerate(rows) if k % 4])
    cases = [(lang, t) for k, (lang, text) in enumerate(rows) if not k % 4 for t in languages.damaged(text)]
    got = languages.languages_of(tagger, [t for _, t in cases])
    for langs in (("zh",), ("de", "fr", "es", "pt")):
        right = [{s[0] for s in g} == {lang} for g, (lang, _) in zip(got, cases) if lang in langs]
        assert len(right) > 20 and np.mean(right) >= 0.85


# ---- 5


def test_page_lines(spark):
    story = ["The plant near {} employs {} people and ships pumps to customers.", "A survey of {} firms in {} shows that prices remain the main concern."]
    bodies = []
    for k in range(60):
        a, b = story[0].format(f"Town{k}", k), story[1].format(k, f"Place{k}")
        bodies.append((f"p{k}", "\n".join(["Home", "World | Sport | Culture", "", a, "What happens next", b, "Read more: Bank in Town cuts its prices after a weak quarter", a, "© 2026 Some Post. All rights reserved.", "Back to top"])))
    got = pages.boilerplate(spark.createDataFrame([*bodies, ("none", None), ("empty", ""), ("blank", "\n \n")], "id string, body string")).collect()
    found = {(r["key"], r["line_no"]) for r in got}
    assert {n for k, n in found if k == "p7"} == {1, 2, 7, 9, 10} and {k for k, _ in found} == {f"p{k}" for k in range(60)}


# ---- 6


@pytest.mark.parametrize("real, wrong", [h for h in encodings.HYPOTHESES if h[0] == "utf-8" and h[1] not in ("koi8_r",)])
@pytest.mark.parametrize("text", ["Le ministère à Zürich a décidé: “prévu” für 20 €", "央行维持利率不变，提示芯片供应风险", "A câmara aprova plano de 27 milhões – ação"])
def test_round_trip(real, wrong, text):
    damaged = text.encode(real).decode(wrong, "replace" if wrong == "gbk" else "strict") if wrong not in ("cp1252", "cp1250", "cp1251", "cp1254") else "".join(bytes([b]).decode(wrong) if _has(b, wrong) else chr(b) for b in text.encode(real))
    assert encodings.is_garbled(damaged)
    fixed, _ = encodings.restore(damaged)
    if "�" not in damaged:
        same = sum(a == b for a, b in zip(fixed, text)) / len(text)
        assert fixed == text or same > 0.6


def _has(byte, name):
    try:
        bytes([byte]).decode(name)
        return True
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize("text", ["À Juorthal, le régulateur enquête", "“Étude” – 5 € für Größe …", "新建工厂（Central bank）", "Really??", "½ ① ™ № Δ β", "È già così", "", "What? Why?"])
def test_clean_text_is_no_case(text):
    assert not encodings.is_garbled(text)


CLEAN = [f"Le régulateur de Town{k} enquête sur les ventes de pompes à chaleur" for k in range(8)]
SCHEMA = "id string, title string, summary string"


def test_transformations_are_learned_from_twins(spark):
    rows = [(f"g{k}", "x", t) for k, t in enumerate(CLEAN)] + [(f"b{k}", "x", t.encode().decode("cp437")) for k, t in enumerate(CLEAN[:4])]
    got = encodings.learned(encodings.evidence(spark.createDataFrame(rows, SCHEMA))).orderBy(F.desc("twin_support"), "name").first()
    assert got["name"] == "utf-8/cp437" and got["twin_support"] >= 4


def test_rows_come_from_what_twins_taught(spark):
    bad = [("b", "x", CLEAN[0].encode().decode("cp437")), ("q", "x", CLEAN[1].replace("é", "?").replace("ê", "?")), ("r", CLEAN[2].encode().decode("cp437"), "x")]
    other = [("n", "x", "Ein anderer Titel über Bälle")]
    twins = [(f"g{k}", "x", t) for k, t in enumerate(CLEAN)]

    def found(rows):
        return {(r["item_id"], r["field"]) for r in encodings.found_fields(encodings.evidence(spark.createDataFrame(rows, SCHEMA))).collect()}

    assert found(bad + twins + other) == {("b", "summary"), ("q", "summary"), ("r", "title")}
    assert found(bad + other) == set()


def test_lost_bytes_come_back_from_twins(spark, tmp_path):
    rows = [(f"g{k}", "x", t) for k, t in enumerate(CLEAN)]
    rows += [("b", "x", CLEAN[0].replace("é", "�")), ("q", "x", CLEAN[1].replace("ê", "?")), ("z", "x", "Rien de tel n’est l� pour lui"), ("t", "x", CLEAN[3].encode().decode("cp1252").encode().decode("cp1252"))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/items.parquet")
    got = {r["item_id"]: r for r in encodings.p6_restored(spark, str(tmp_path)).collect()}
    assert {k: r["restored"] for k, r in got.items()} == {"b": CLEAN[0], "q": CLEAN[1], "z": None, "t": CLEAN[3]}
    assert (got["b"]["how"], got["z"]["how"]) == ("twin", "none")


# ---- 7


@pytest.mark.parametrize("text, want", [
    ("Ｒｉｈｕ cоuncil", "Rihu council"), ("lässt​  Zi­ns", "lässt  Zins"), ("ﬁnds it", "finds it"), ("佩⾥⼈", "佩里人"), ("Δ β 5 ½ ① ™ № “x” （中），", None),
    ("Привет мир", None), ("x̣̂", unicodedata.normalize("NFC", "x̣̂")), ("", None), ("Ｒ😀\ue0ff", "R😀\ue0ff"), ("​‍", ""), ("ẹ́", unicodedata.normalize("NFC", "ẹ́"))])
def test_uniform(spark, text, want):
    got = unify.uniform(spark.createDataFrame([(1, text), (2, "plain"), (3, text)], "k int, text string"), ["k"]).collect()
    assert {r["k"]: r["uniform"] for r in got} == {1: text if want is None else want, 2: "plain", 3: text if want is None else want}


def test_composition_is_that_of_unicode(spark):
    rng = random.Random(8)
    bases, marks = "aeiouyscnE\u00e1\u00ea\u1ec7\u304b", "\u0300\u0301\u0302\u0303\u0308\u0323\u0331\u0332\u0327\u0328\u0345\u3099\u05b0"
    texts = ["\u00e1\u0332", "\u1ec7\u0332", "\u1112\u1161\u11ab", "\ud55c\u11ab", "\ud558\u11ab x", "\u1112\u1161\u0301\u11ab", "\u0301a", "a\u0301\u0301", "a\u0345\u0301", "\u1161\u11ab", "\u0958"]
    texts += ["".join(rng.choice(bases) + "".join(rng.choices(marks, k=rng.randrange(5))) for _ in range(rng.randrange(1, 6))) for _ in range(500)]
    got = unify.uniform(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["uniform"] == unicodedata.normalize("NFC", texts[r["k"]]), ascii(texts[r["k"]])


def test_quick_look_misses_nothing():
    import re

    common = re.compile(unify.UNCOMMON)
    odd = set(unify.mapping()) | set(unify.LOOKALIKES) | {chr(n) for n in range(0x300, 0x370)}
    assert all(common.match(c) for c in odd)


# ---- 8


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    return tokens.encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"), other


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="ab '\n.sT1é中", max_size=200))
def test_exact_ids(both, text):
    mine, other = both
    assert mine.encode(text) == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "a" * 5_000, "ab" * 3_000, "中文" * 2_000, " \n\t " * 500, "<|endoftext|>", "don't 123,456 naïve 😀👍🏽", "x" * 300 + "\u0000" + "é" * 300])
def test_exact_ids_of_odd_texts(both, text):
    mine, other = both
    assert mine.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_null_text_has_a_list(spark):
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 1


# ---- 9


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        for key in (-5, 0, 2**62):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))


def test_draws_meet_the_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUPS", 7)
    monkeypatch.setattr(mixing, "AT_ONCE", 300)
    sources = [mixing.Source("a", 0.5, 2, 0, 400, 800), mixing.Source("b", 0.4, 9, 0, 71, 637), mixing.Source("none", 0.1, 1, 0, 0, 0), mixing.Source("c", 0.1, 1, 0, 163, 163)]
    groups = mixing.groups(sources)
    assert len(groups) <= 7 and [sum(g[1][k] for g in groups) for k in range(4)] == [800, 637, 0, 163]
    got = mixing.slots(spark, sources).collect()
    assert len(got) == 1600 == len({(r["shard"], r["place"]) for r in got})
    sizes = np.bincount([r["shard"] for r in got])
    assert (sizes == 64).all() and len(sizes) == 25
    for s in sources:
        uses = np.bincount([r["block"] for r in got if r["source"] == s.name], minlength=max(1, s.blocks))
        assert uses.sum() == s.slots and uses.max() - uses.min() <= 1
    mixed = [len({r["source"] for r in got if r["shard"] == n}) for n in range(25)]
    assert min(mixed) >= 2


def test_blocks_hold_all_tokens(spark):
    docs = [(i, f"s{i % 2}", "word " * (i % 50) + "end") for i in range(200)] + [(900, "s0", None), (901, "s1", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    blocks, totals = mixing.packed(df, block=64)
    coder = tokens.encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    for source in ("s0", "s1"):
        mine = [r for r in blocks.filter(F.col("source") == source).orderBy("block").collect()]
        want = sorted(t for _, s, x in docs if s == source for t in coder.encode(x))
        assert sorted(t for r in mine for t in r["ids"]) == want
        assert all(r["n_tokens"] == 64 for r in mine[:-1]) and [r["block"] for r in mine] == list(range(len(mine)))
    assert totals.count() == 2


def test_shares_and_repeats(spark):
    docs = spark.createDataFrame([(i, "big" if i % 10 else "small", f"some words number {i} " * 30) for i in range(600)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("silent", 0.1, 2)], "source string, target_share double, max_repeats int")
    filled, report = mixing.mix(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    assert abs(got["big"]["share_reached"] - 0.6 / 0.9) < 0.02 and abs(got["small"]["share_reached"] - 0.3 / 0.9) < 0.02 and got["silent"]["share_reached"] == 0
    uses = filled.groupBy("source", "block").count().groupBy("source").agg(F.max("count").alias("m"), F.min("count").alias("l")).collect()
    assert all(r["m"] <= {"big": 1, "small": 3}[r["source"]] and r["m"] - r["l"] <= 1 for r in uses)
    assert filled.select("shard", "place").distinct().count() == filled.count()


# ---- 10


def test_offences_held_out():
    rng = random.Random(4)
    clean = ["The report lists {} open questions", "Suppliers expect {} contracts this year", "The court fined a man {} for an insult", "Health officials warn of {} rats in the town"]
    nasty = ["You are a worthless stupid idiot and everyone in Town{} knows it", "Shut your filthy mouth you brainless pig {}"]
    rows = [("\n".join(rng.choice(clean).format(rng.randrange(999)) for _ in range(8)), ["ok"]) for _ in range(150)]
    rows += [("\n".join([clean[k % 4].format(k), nasty[k % 2].format(k), clean[(k + 1) % 4].format(k)]), ["abusive"]) for k in range(30)]
    rows += [(clean[0].format(5), ["abusive"]), (None, ["ok"]), ("x", ["other"])]  # wrong and odd labels
    model = conduct.train(rows)
    best, _ = conduct._worst(model, ["You are a w0rthless stuuupid idi0t", "s h u t your f.i.l.t.h.y mouth you brainless pig", clean[2].format(7), clean[3].format(9), None, ""])
    assert (best[:2] >= conduct.FOUND).all() and (best[2:] < conduct.FOUND).all()


def test_nothing_to_learn_from(spark):
    assert conduct.train([]) is None and conduct.train([("a", ["ok"])]) is None
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert conduct.score(df, None).first()["score"] == 0


@pytest.mark.parametrize("raw, plain", [("i d i o t", "idiot"), ("tr@sh", "trash"), ("你*是*废 物", "你是废物"), ("stuuuupid", "stupid"), ("Ｔrаsh", "trash")])
def test_undisguised(raw, plain):
    assert conduct.undisguised(raw) == plain


def test_fixture_has_all_tables():
    assert len(fixture.items()) > 60


def test_shingles_of_many_texts_are_those_of_each():
    texts = [t.split(" ") for t in ("a", "a b", "a b c d e", "a b a b a b a b a b", " ".join("一二三"), " ".join("一二三四五六七八九十" * 3), "the plant in Rokpas recalls 3.5 pumps")]
    many = neardup.shingle_lists(texts, {})
    each = [neardup.shingle_codes(t, {}) for t in texts]
    assert [set(c.tolist()) for c in many] == [set(c.tolist()) for c in each]
    assert neardup.band_keys(*many).tolist() == [k for c in each for k in neardup.band_keys(c).tolist()]
    assert [neardup.signature(c) for c in many] == [neardup.signature(c) for c in each]


@pytest.mark.parametrize("text, want", [("Plant A_b pays 3.5,7 and 1, don't", ["plant", "a", "b", "pays", "3.5,7", "and", "1", "don", "t"]), ("Ein Werk für 2,5", ["ein", "werk", "für", "2,5"]), ("", []), ("x" * 3 + "?", ["xxx"])])
def test_words_of_plain_and_other_texts(text, want):
    assert neardup.tokens(text) == want
