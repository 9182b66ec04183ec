import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import boost, langid, leakage, lookalike, mojibake, packing, pii, splitting


# ---- language

def test_label_language(spark):
    cases = {"en-GB": "en", "DEUTSCH": "de", " fr ": "fr", "한국어": "ko", "日本語": "ja", "pt_BR": "pt", "jpn": "ja", "??": None, "und": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", langid.label_language(F.col("l")).alias("c"))
    assert {r.l: r.c for r in df.collect()} == cases


def test_language_runs():
    rng = random.Random(1)
    lines = [(" ".join(rng.choices(words.split(), k=12)), lang) for lang, words in langid.SEED.items() for _ in range(40)]
    model = langid.fit(*map(list, zip(*lines)))
    text = "the letter was not ready and we have to wait for it before this can be done\n\nder Brief ist noch nicht da und wir sind nicht fertig mit der Arbeit\n12:40\nэто не так и мы уже не будем ждать после того как он был здесь"
    runs = langid.segments(model, [text, "", "12:40", None])
    assert [r[2] for r in runs[0]] == ["en", "de", "ru"] and runs[1:] == [[], [], []]
    assert (runs[0][1][0], runs[0][1][1]) == (2, 2)


# ---- look-alikes

def test_same_look():
    known = {"Corwin", "Grace", "Castellow", "C", "ab"}
    form = lambda t: lookalike.repaired(lookalike.clean(t), known)
    for a, b in [("Corwin", "Cоrwin"), ("Grace", "Grａce"), ("é", "é"), ("a b", "a b"), ("10-2", "10‑2"), ("fi", "ﬁ"), ("ab", "a​b"), ("ミナギ", "ﾐﾅｷﾞ"), ("С. Castellow", "C. Castellow")]:
        assert form(a) == form(b)
    for a, b in [("Grace", "GRACE"), ("a b", "a  b"), ("e", "é"), ("1", "l"), ("a", "b")]:
        assert form(a) != form(b)
    assert form("Cоrwin сорт") == "Corwin сорт" and lookalike.repaired("Cоrwin", set()) == "Cоrwin"


def test_the_vocabulary_decides(spark):
    rows = [("t", "1", "Cоrwin left"), ("t", "2", "Corwіn left"), ("u", "3", "ask Corwin"), ("t", "4", "С. Hale"), ("t", "5", "C. Hale")]
    pairs = lambda given: sorted(map(tuple, lookalike.same_pairs(spark.createDataFrame(given, "tab string, m string, v string"), ["tab"], "m", "v").collect()))
    assert pairs(rows) == [("1", "2"), ("4", "5")]
    assert pairs([r for r in rows if r[1] != "3"]) == [("4", "5")]


def test_same_classes(spark):
    rows = [("t", "1", "Grace"), ("t", "2", "Grａce"), ("t", "2", "Grａce"), ("t", "3", "Grace"), ("t", "7", "G​race"), ("u", "4", "Grace"), ("t", "5", None), ("u", "8", "é")]
    df = spark.createDataFrame(rows, "tab string, m string, v string")
    got = {r.rec: tuple(r)[1:] for r in lookalike.same_classes(df, ["tab"], "m", "v").collect()}
    assert got == {"1": ("1", 4, 3, 2), "3": ("1", 4, 3, 2), "2": ("1", 4, 3, 3), "7": ("1", 4, 3, 3)}
    pairs = lookalike.same_pairs(df, ["tab"], "m", "v").count()
    assert 2 * pairs == sum(v[3] for v in got.values())


def test_same_pairs(spark):
    rows = [("t", "1", "Grace"), ("t", "2", "Grａce"), ("t", "2", "Grａce"), ("t", "3", "Grace"), ("u", "4", "Grace"), ("t", "5", None), ("t", "6", "GRACE")]
    df = spark.createDataFrame(rows, "tab string, m string, v string")
    assert sorted(map(tuple, lookalike.same_pairs(df, ["tab"], "m", "v").collect())) == [("1", "2"), ("2", "3")]
    assert lookalike.same_pairs(df.limit(0), ["tab"], "m", "v").count() == 0


def test_same_pairs_of_line_ends(spark):
    df = spark.createDataFrame([("t", "1", "Grace\n"), ("t", "2", "Grace\r\n"), ("t", "3", "Grace")], "tab string, m string, v string")
    assert list(map(tuple, lookalike.same_pairs(df, ["tab"], "m", "v").collect())) == [("1", "2")]


# ---- splitting

@pytest.mark.parametrize("text", ["word " * 3000, "x" * 9001, "A sentence here. " * 700 + "\n\n" + "Another line\n" * 400, "あ。" * 5000, "a\n\n" * 4001])
def test_pieces(text):
    cut = splitting.pieces(text)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for (a, b, _, _), (c, d, r, _) in zip(cut, cut[1:]):
        assert a < b and c <= b < d and 0 <= b - c <= 200 and r == b - c
    assert all(0 < b - a <= 4000 for a, b, _, _ in cut)
    assert "".join([text[cut[0][0] : cut[0][1]]] + [text[b - (b - a - r) : b] for a, b, r, _ in cut[1:]]) == text


def test_short_items_stay(spark):
    df = spark.createDataFrame([(1, "short", 0), (2, None, 0), (3, "", 0), (4, "y " * 2500, 0)], "id int, text string, piece int")
    got = splitting.split_items(df, ["id"], "text").collect()
    assert {r.id for r in got} == {4} and len(got) == 2


# ---- personal data

def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = boost.fit(x, y, trees=30, depth=3)
    assert ((m.predict(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_shadow_places():
    text = "a​b Grａcе é"
    s, starts, ends = pii.shadow(text)
    assert s == "ab Grace é" and (starts[1], ends[1]) == (2, 3) and ends[-1] == len(text)


def test_candidates_are_found():
    counts = pii.Counts(np.zeros(2 * pii.BUCKETS, np.float32))
    s = "mail ada [at] x-y [dot] example [dot] org or bob @ z.test, call +44 7700 900436 or id X12345678Z"
    got = {s[a:b] for a, b, _, _ in pii.candidates(s, counts)}
    assert {"ada [at] x-y [dot] example [dot] org", "bob @ z.test", "+44 7700 900436", "X12345678Z"} <= got
    assert pii.redacted("call 1 now", [(5, 6, 2, 0.9)]) == "call [PRIVATE_PHONE] now"


def _known(**words):
    """Counts of words by role: n stored, ten times as often in texts where ``t`` asks."""
    table = np.zeros(2 * pii.BUCKETS, np.float32)
    for role, listed in words.items():
        for w in listed.split():
            for b in pii.buckets(role, w):
                table[b] += 50
    return pii.Counts(table)


def test_placeholders_are_no_candidates():
    counts = _known(p="Person Phone Ada")
    s = "Hello [PRIVATE_PERSON:3], ask Ada or [PERSON] at [Private Phone:ab12cd] [ADA] [MY RULE:7]"
    assert [s[a:b] for a, b in pii.placeholders(s)] == ["[PRIVATE_PERSON:3]", "[PERSON]", "[MY RULE:7]"]
    assert {s[a:b] for a, b, k, _ in pii.candidates(s, counts) if k == pii.PERSON} == {"Ada", "Phone", "ADA"}


def test_candidates_of_any_length():
    counts = _known(p="Ana Berta Carla Dora Eva Frida Gomez", f="Calle", l="Norte")
    local = "a" * 200 + ".b"
    row = "Ana Berta Carla Dora Eva Frida Gomez"
    street = "Calle de la muy larga y vieja plaza mayor, 12, 28001 Norte"
    s = f"mail {local}@x.org to {row}. En {street}."
    got = {s[a:b] for a, b, _, _ in pii.candidates(s, counts)}
    assert {f"{local}@x.org", row, "Ana Berta", "Frida Gomez", street} <= got
    far = "House 3 on the old road by the long grey wall behind mill, 1234 Norte"
    assert far[6:] in {far[a:b] for a, b, _, _ in pii.candidates(far, counts)}


def test_candidates_grow_in_proportion():
    counts = _known(p="Ana Berta", f="Calle", l="Norte")
    n = [len(pii.candidates("Ana Berta\nAna Berta " * k + "a@" * k + "Calle 1 " * k, counts)) for k in (200, 400)]
    assert n[1] < 2.2 * n[0]


def test_words_share_no_columns_by_chance():
    table = np.zeros(2 * pii.BUCKETS, np.float32)
    for i in range(50_000):
        for b in pii.buckets("t", f"word{i}"):
            table[b] += 3
    counts = pii.Counts(table)
    assert sum(counts("p", f"other{i}") > 0 for i in range(10_000)) < 100


def test_threshold_follows_the_label_rate():
    p, y = np.repeat([0.6, 0.02], 200), np.tile([1.0, 0.0], 200)
    y[200:] = 0
    assert pii.threshold(p, y) == pytest.approx(0.2) and pii.threshold(p[:10], y[:10]) == pytest.approx(1 / 3)


def test_long_values_are_counted(spark):
    long = "Ana " * 60 + "Berta"
    counts = pii.count_words(spark.createDataFrame([("Ana",)], "text string"), spark.createDataFrame([(long, 0)], "value string, kind int"))
    assert (counts("p", "Berta"), counts("p", "Ana"), counts("t", "Ana")) == (1, 60, 1)


def test_detector_on_labelled_texts():
    rng = random.Random(3)
    texts, spans = [], []
    for i in range(120):
        number, order = f"+44 7700 9{rng.randint(0, 99999):05d}", f"{rng.randint(100, 999)}-{rng.randint(0, 999999):06d}-00"
        t = f"Call {number} before noon. Order {order} is late."
        texts.append(t)
        spans.append([(5, 5 + len(number), pii.PHONE)])
    d = pii.fit(texts, spans, pii.Counts(np.zeros(2 * pii.BUCKETS, np.float32)))
    assert [[(a, b, k) for a, b, k, _ in r] for r in d.find(["Call +44 7700 912345 before noon. Order 123-456789-00 is late.", ""])] == [[(5, 20, pii.PHONE)], []]


# ---- packing

def test_packing_bounds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        c = int(rng.integers(5, 40))
        z = rng.integers(1, c + 1, int(rng.integers(1, 30)))
        w = packing.best_fit_decreasing(z, c)
        assert np.bincount(w, z).max() <= c and packing.lower_bound(z, c) <= w.max() + 1


def test_containers_hold_every_text_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("word" for _ in range(rng.randint(1, 40)))) for i in range(300)] + [(1000, "long text here " * 60), (1001, ""), (1002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.fill_containers(df, capacity=64).collect()
    texts = dict(rows)
    assert {r.doc_id for r in got} == {k for k, v in texts.items() if v}
    for k in texts:
        parts = sorted((r.piece_no, r.start, r.end) for r in got if r.doc_id == k)
        assert "".join(texts[k][a:b] for _, a, b in parts) == (texts[k] or "")
    fill = {}
    for r in got:
        fill[r.box] = fill.get(r.box, 0) + r.tokens
    assert max(fill.values()) <= 64 and sum(fill.values()) / (64 * len(fill)) > 0.95
    assert all(r.pieces == 1 for r in got if r.doc_id != 1000)


def test_partitions_exchange_until_nothing_is_gained(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("word" for _ in range(rng.randint(1, 40)))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    filled = packing.fill_containers(df, capacity=64, items_per_part=60).cache()
    one = packing.certificate(packing.fill_containers(df, capacity=64), 64).where("part IS NULL").first()
    report = {r.part: r for r in packing.certificate(filled, 64).collect()}
    whole = report.pop(None)
    assert len(report) > 10 and sum(r["items"] for r in report.values()) == whole["items"] == 900
    assert sum(r.containers for r in report.values()) == whole.containers == filled.select("box").distinct().count()
    assert all(r.gap == r.containers - r.bound >= 0 for r in (whole, *report.values())) and whole.bound == one.bound
    assert filled.select("doc_id").distinct().count() == 900 and filled.groupBy("box").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] <= 64
    first = sum(int(packing.best_fit_decreasing(np.array(g), 64).max()) + 1 for g in _parts(filled, 15))
    alone = int(packing.best_fit_decreasing(np.array([r.tokens for r in filled.collect()]), 64).max()) + 1
    assert whole.containers < first and whole.containers <= alone + 3
    empty = packing.fill_containers(df.limit(0), capacity=64)
    assert empty.count() == 0 and packing.certificate(empty, 64).count() == 0


def _parts(filled, n):
    groups = {}
    for r in filled.select("doc_id", "tokens").collect():
        groups.setdefault(r.doc_id % n, []).append(r.tokens)
    return groups.values()


# ---- leakage

def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    for i in range(15):
        words = rng.choice(items)[1].split()
        n = rng.randint(8, 20)
        docs.append((100 + i, f"{docs[i][1]} -- {' ,'.join(words[:n]).upper()} {docs[i][1]}"))
    docs += [(998, None), (999, "")]
    grams = lambda t: {tuple(w[k : k + 13]) for w in [(t or "").lower().replace(",", " ").replace("-", " ").split()] for k in range(len(w) - 12)}
    want = {(d, i) for d, t in docs for i, q in items if grams(t) & grams(q)}
    got = leakage.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.where("match_type = 'exact'").collect()} == want and want


def test_near_leaks_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))) for i, n in enumerate([12, 13, 20, 40, 60, 30])]
    docs = []
    for i in range(120):
        w = rng.choice(items)[1].split()
        a = rng.randint(0, max(0, len(w) - 16))
        part = w[a : a + 16]
        for k in rng.sample(range(len(part)), rng.randint(0, 5)):
            part[k] = f"w{rng.randint(0, 400)}"
        docs.append((i, " ".join(part)))
    docs += [(900, items[3][1]), (900, "another text of the same id"), (901, None), (902, "")]
    want = {}
    for d, t in docs:
        for i, q in items:
            x, y = (t or "").split(), q.split()
            for delta in range(-len(y), len(x)):
                m = [0 <= k + delta < len(x) and x[k + delta] == w for k, w in enumerate(y)]
                hits = max((sum(m[k : k + 13]) for k in range(len(y) - 12)), default=0)
                run = max(map(len, "".join("01"[b] for b in m).split("0")))
                if hits >= 10:
                    old = want.get((d, i), (0, 0))
                    want[d, i] = (max(run, old[0]), max(hits, old[1]))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = leakage.matches(d, q).collect()
    assert {(r.doc_id, r.item_id): (r.run, r.hits) for r in got} == want and len(got) == len(want)
    assert all((r.match_type == "exact") == (r.run >= 13) for r in got) and {r.match_type for r in got} == {"exact", "proximity"}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, q).collect()} == {(r.doc_id, r.item_id) for r in got if r.run >= 13}
    assert leakage.gram_size(13, 10) == (3, 2) and leakage.gram_size(13, 13) == (13, 1)


# ---- encodings

def test_round_trips():
    for text, read in [("Grüße aus Köln", "cp1252"), ("isn’t “later”", "cp1252"), ("Проверка связи", "cp1251"), ("migración", "cp437"), ("이든솔 자료", "latin-1")]:
        bad = text.encode().decode(read, "strict") if read != "cp1252" else "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in text.encode())
        assert mojibake.repair(bad)[0] == text and mojibake.repair(bad)[1] > 0
    twice = "Grüße".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.repair(twice)[:1] == ("Grüße",) and mojibake.repair(twice)[2] == 2


@pytest.mark.parametrize("text", ["", "plain", "Âge, pâte, «naïveté» : 12 €", "├── a\n└── √ 2.0", "ATENÇÃO À REVISÃO, NÃO", "ÍÑIGO NUÑO", "Проверка «СССР»", "黒い猫と 한국어 자료"])
def test_right_texts_stay(text):
    assert mojibake.repair(text)[:2] == (text, 0)


def test_legacy_words_and_losses(spark):
    rows = [(i, "Der Prüfbericht wurde geprüft, Rückfragen bitte") for i in range(40)] + [(90, "R\x81ckfragen"), (91, "gepr�ft"), (92, None), (93, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in mojibake.repair_documents(df, mojibake.corpus_pairs(df)).collect()}
    assert set(got) == {90, 91} and got[90].restored == "Rückfragen" and got[91].lost == 1


def test_garbled_copies_and_sources(spark):
    right = ["Проверка связи уже готова", "Готова ли проверка связи", "Уже готова проверка", "Связи уже готова проверка"]
    copied, source = "Проверка готова", [f"Проверка связи готова {i}" for i in range(30)]
    bad = lambda t: t.encode("cp1251").decode("cp1252")
    texts = [f"{t} {i}" for t in right for i in range(10)] + [bad(copied)] * 40 + [bad(t) for t in source]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.restored for r in mojibake.repair_documents(df, mojibake.corpus_pairs(df)).collect()}
    assert got == {40 + i: t for i, t in enumerate([copied] * 40 + source)}


def _garbled(text, read, written="utf-8"):
    chars = {b: chr(o) for o, b in mojibake._page(read).items()}
    return "".join(chars[b] for b in text.encode(written))


def test_any_number_of_layers():
    text = bad = "Grüße"
    for n in range(1, 7):
        bad = _garbled(bad, "cp1252")
        assert mojibake.repair(bad)[0] == text and mojibake.repair(bad)[2] == n


def test_cost_of_the_whole_word_from_its_neighbours():
    rng = random.Random(9)
    for _ in range(300):
        parts = ["".join(rng.choices("aÃ漢字語é—ñЖ한", k=rng.randint(0, 60))) for _ in range(3)]
        new = "".join(rng.choices("üé漢", k=rng.randint(1, 9)))
        text, a = "".join(parts), len(parts[0])
        b = a + len(parts[1])
        left, right = mojibake._around(text, a, b)
        whole = mojibake.garbling_cost(text) - mojibake.garbling_cost(parts[0] + new + parts[2])
        assert mojibake._drop(text[left:a], parts[1], new, text[b:right]) == pytest.approx(whole)


def test_pages_with_runs_hold_every_run():
    rng = random.Random(10)
    pool = "ab Ã¼â‚¬Ð°Ñ€в–’ê°€한漢é\U0001f600"
    for _ in range(300):
        text = "".join(rng.choices(pool, k=rng.randint(1, 30)))
        want = [n for n in mojibake.READ_AS if any(mojibake._UTF8.search(mojibake._bytes(r.group(), n)) for r in mojibake._RUNS[n].finditer(text))]
        assert set(want) <= set(mojibake._pages_with_runs(text))


def test_pair_table_is_bounded():
    assert len(mojibake._Folded.kept) < 700
    assert {mojibake._FOLD[ord(c)] for c in "ไทยहिन्दीعربي"} == {"￿"} and mojibake._FOLD[ord("é")] == "é"


def test_short_words_follow_their_line(spark):
    texts = [f"Проверка связи и готова {i}" for i in range(40)] + [f"И снова проверка и связь {i}" for i in range(40)] + ["Caffè è tè"] * 9
    df = spark.createDataFrame(list(enumerate([*texts, _garbled("И снова проверка и связь", "cp1252", "cp1251")])), "doc_id long, text string")
    got = {r.doc_id: r.restored for r in mojibake.repair_documents(df, mojibake.corpus_pairs(df)).collect()}
    assert got == {89: "И снова проверка и связь"}
