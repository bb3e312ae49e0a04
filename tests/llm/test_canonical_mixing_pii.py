from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from leadframe.functions import dims
from leadframe.llm import canonical, mixing, pii

REFERENCE = ["I", "II", "III", "AVR", "AVL", "AVF", *[f"V{i}" for i in range(1, 7)], *[f"CS {i}-{i + 1}" for i in range(1, 10, 2)], *[f"DD {i}-{i + 1}" for i in range(1, 20, 2)], "RA 1-2", "RV 1-2", "HIS D", "HIS M", "HIS P", "ABL D", "ABL P"]
MEANT = {
    "lead 1": "I", "Limb Lead II": "II", "ecg-aVF": "AVF", "A VF": "AVF", "av_r": "AVR", "V 01": "V1", "v_6": "V6", "chest laed V3*": "V3", "imb lead III": "III", "CS34": "CS 3-4", "cs 9 10": "CS 9-10", "CS 5−6": "CS 5-6",
    "DD1718": "DD 17-18", "DD. 11/12": "DD 11-12", "duodecpolar 3-4": "DD 3-4", "duodecaploar 13-14 (old)": "DD 13-14", "coronary snius_1-2": "CS 1-2", "rihgt atrium 1-2": "RA 1-2", "right ventrilce 1-2": "RV 1-2", "HISD": "HIS D",
    "H1S M": "HIS M", "HSI P": "HIS P", "his bundle mid": "HIS M", "albation dist": "ABL D", "AB L P": "ABL P", "abl cath prox": "ABL P", "CS 11-12": None, "DD 21-22": None, "V9": None, "AVX": None, "HIS X": None, "ECG": None, "RV 5-6": None,
    "press 1": None, "": None, "   ": None, "?": None, "left atrium 1-2": None, "x" * 50_000: None, "I": "I",
}


PLACES = {"CS": "coronary sinus", "DD": "duodecapolar", "RA": "right atrium", "RV": "right ventricle", "HIS": "his bundle", "ABL": "ablation catheter"}
PARTS = {"D": "distal", "M": "mid", "P": "proximal"}


def _long(label):
    place, _, part = label.partition(" ")
    return f"{PLACES[place]} {PARTS.get(part, part)}" if part else f"surface lead {label}"


def _reference(spark):
    return spark.createDataFrame([(i + 1, x, "x", _long(x)) for i, x in enumerate(REFERENCE)], "label_id int, label string, value string, long string")


def test_words_are_learnt_from_longer_names(spark):
    got = {r["word"]: r["meaning"] for r in canonical.words_of_names(_reference(spark), "label", "long").collect()}
    assert got == {
        "CORONARY": "CS", "SINUS": "CS", "DUODECAPOLAR": "DD", "ATRIUM": "RA", "VENTRICLE": "RV", "RIGHT": "", "BUNDLE": "HIS", "ABLATION": "ABL", "CATHETER": "ABL", "DISTAL": "D", "MID": "M", "PROXIMAL": "P", "SURFACE": "", "LEAD": "",
    }


def test_only_rare_tokens_pair_and_none_is_lost(spark):
    """A token that all entries share pairs nothing by itself; every entry at or above the threshold is found."""
    r = random.Random(5)
    names = [" ".join(["HOT", *r.sample(["ANNE", "BERT", "CORA", "DIRK", "EMMA", "FRED", "GRET", "HUGO"], r.randint(1, 3))]) for _ in range(40)]
    ref = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "id int, text string")
    typed = ["HOT", *{" ".join(r.sample(x.split(), r.randint(1, len(x.split())))) for x in names}]
    out = {x["value"]: x for x in canonical.map_to_reference(spark.createDataFrame([(t,) for t in typed], "t string"), "t", ref, "id", "text").collect()}
    df = {w: sum(w in x.split() for x in names) for x in names for w in x.split()}
    weight = lambda ws: sum(math.log(1 + len(names) / df[w]) ** 2 for w in ws)
    for t in typed:
        score = {i: weight(set(t.split()) & set(x.split())) / math.sqrt(weight(t.split()) * weight(x.split())) for i, x in enumerate(names)}
        best = max(score.values())
        want = min(i for i, s in score.items() if abs(s - best) < 1e-8) if best >= 0.9 else None
        assert out[t]["id"] == want, (t, want, out[t])
    assert out["HOT"]["score"] == 0


def test_labels(spark):
    ref = _reference(spark)
    values = spark.createDataFrame([(x, 1) for x in [*MEANT, *MEANT, None]], "typed string, label_id int")
    out = canonical.map_to_reference(values, "typed", ref, "label_id", "label", canonical.CHANNEL_WORDS, canonical.CHANNEL_NAMES, long_text="long")
    got = {r["value"]: REFERENCE[r["label_id"] - 1] if r["label_id"] else None for r in out.collect()}
    assert got == MEANT
    assert canonical.map_to_reference(values, "typed", ref.limit(0), "label_id", "label").filter("label_id is not null").count() == 0
    assert canonical.map_to_reference(values.limit(0), "typed", ref, "label_id", "label").count() == 0


def _osa(a, b):
    d = {}
    for i in range(-1, len(a) + 1):
        d[i, -1] = i + 1
    for j in range(-1, len(b) + 1):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_repair_finds_every_close_word(spark):
    words = ["ATRIUM", "SINUS", "HIS", "LEAD", "DUODECAPOLAR", "PROXIMAL", "V"]
    r = random.Random(6)

    def spoil(w):
        i, c = r.randrange(len(w)), r.choice("AEXQ")
        return r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[: max(0, i - 1)] + w[i : i + 1] + w[max(0, i - 1) : i] + w[i + 1 :]])

    tokens = sorted({spoil(r.choice(words)) for _ in range(150)} | {spoil(spoil("DUODECAPOLAR")) for _ in range(60)} | set(words))
    vocabulary = spark.createDataFrame([(w, w) for w in words], "word string, meaning string")
    got = {x["token"]: x["word"] for x in canonical.repair(spark.createDataFrame([(t,) for t in tokens], "token string"), vocabulary).collect()}
    for t in tokens:
        near = [w for w in words if t == w or (len(t) >= 3 and len(w) >= 3 and _osa(t, w) <= 1)]
        if len(near) == 1:
            assert got.get(t) == near[0], t
        if not near and not any(_osa(t, w) <= 3 for w in words if len(w) >= 8):
            assert t not in got


def test_number_tokens():
    assert canonical.tokens("CS 05-06") == ["CS", "5-6"] and canonical.tokens("DD1920") == ["DD", "19-20"] and canonical.tokens("V01") == ["V", "1"] and canonical.tokens(None) == []


# ---- mixing ----------------------------------------------------------------------------------------------------------


def _mixed(spark, rows, targets, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    out = mixing.mix(docs, t, **options)
    return out, {r["source"]: r for r in mixing.shares(out, t).collect()}


def test_shares_and_caps(spark):
    r = random.Random(1)
    rows = [(i, r.choices(["hot", "mid", "small"], [30, 6, 2])[0], r.randrange(5, 400)) for i in range(4000)]
    targets = [("hot", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 4)]
    out, by = _mixed(spark, rows + rows[:100], targets)
    assert out.count() == 4000
    for s, share, cap in targets:
        assert abs(by[s]["actual_share"] - share) < 0.002 and by[s]["most_copies"] <= cap
    # Rates are tilted exponentially in the tokens, one tilt per source.
    scale = {s: [n for _, x, n in rows if x == s] for s in ("hot", "mid", "small")}
    for s, _, cap in targets:
        mean = sum(scale[s]) / len(scale[s])
        tilts = [math.log(x["rate"]) * mean / x["n_tokens"] for x in out.filter(F.col("source") == s).limit(50).collect() if 0 < x["rate"] < cap]
        assert not tilts or max(tilts) - min(tilts) < 1e-6
    again, _ = _mixed(spark, rows, targets)
    assert {tuple(x) for x in out.select("doc_id", "copies").collect()} == {tuple(x) for x in again.select("doc_id", "copies").collect()}


def test_mixing_edges(spark):
    rows = [(1, "a", 10), (2, "a", 0), (3, None, 5), (4, "other", 5), (5, "b", 10)]
    out, by = _mixed(spark, rows, [("a", 0.5, 2), ("b", 0.5, 2), ("absent", 0.5, 9)], fill=1.0)
    copies = {r["doc_id"]: r["copies"] for r in out.collect()}
    assert copies[1] == 2 and copies[5] == 2 and copies[3] == copies[4] == 0 and 1 <= copies[2] <= 2 and by["absent"]["actual_share"] == 0
    assert mixing.mix(out.select("doc_id", "source", "n_tokens").limit(0), spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")).count() == 0
    _, by = _mixed(spark, [(i, "a", 10) for i in range(100)], [("a", 1.0, 3)], total=505.0)
    assert by["a"]["tokens_taken"] in (500, 510)


def test_tilts_solve_the_dual(spark):
    h = spark.createDataFrame([("a", 10, 5), ("a", 100, 3), ("a", 1000, 1)], "source string, n_tokens bigint, n bigint")
    for goal in (50.0, 900.0, 1350.0, 3000.0, 4000.0):
        x = mixing.solve_tilts(h, {"a": goal}, {"a": 3}, {"a": 150.0})["a"]
        f = sum(n * t * min(3.0, math.exp(min(x * t / 150, 700))) for t, n in ((10, 5), (100, 3), (1000, 1)))
        assert abs(f - goal) < 1e-6 * goal


def test_tokens(spark):
    from tokenizers import Tokenizer

    texts = ["hello world", "", None, "Ein fröhlicher Wecker 🙂 <|endoftext|>", "a " * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    t = Tokenizer.from_file(mixing.TOKENIZER)
    t.encode_special_tokens = True
    assert [r["n_tokens"] for r in mixing.with_tokens(df).orderBy("doc_id").collect()] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


# ---- personal information --------------------------------------------------------------------------------------------

# Templates with made-up values: «kind|text» marks what must be found.
TEXTS = [
    "Write to «email|jo.doe+x@mail.example» please.", "«email|A_B@LETTERS.INVALID» wrote.", "mail: «email|jo [at] mail [dot] example», ok", "«email|jo (at) mail.example»", "Reply to «email|jo-3.doe @ mail.example .» soon".replace(" .»", "» ."), "Contact «email|jo at mail dot example» now",
    "Tel. «phone|+49 30 23125 662», gern", "Call «phone|(555) 016-3895» today", "Text «phone|15550148892» any evening", "«phone|+1-555-019-5407 ext. 86»", "rang «phone|0049 (0)30 23125-091» back", "unter «phone|030/23125584» anrufen", "Appelez le «phone|+33 1 99 00 71 23»", "«phone|07700 900048»",
    "Passport no. «identity|000-60-6430» had", "Meine Ausweisnummer «identity|L04X04T29» wurde", "Steuernummer «identity|QQ 33 53 72 C» stand", "ma carte d’identité n° «identity|X9374926».", "Me pidieron el DNI «identity|000021420423».", "my social security number, «identity|Z-1822091-K», by mistake", "ID card: «identity|00/141/01476» The finish",
    "Ship to «address|120 Quarry St», 21507", "at «address|Flat 3, 145 Saltmarsh Street», 71747 X", "to «address|Unit 21/72 Copperbeech Lane»", "Abzuholen in «address|Quarrystraße 75a».", "in «address|Am Millhof 9».", "Livré au «address|29, avenue du Mill Pond», X", "au «address|43 bis chemin de Saltmarsh»", "en «address|C/ Saltmarsh 53», 2.º B", "«address|Avenida de Heron 98»",
    "Thanks to «person|Ruben Tarnrood» from support!", "Frau «person|INES ORBELANSSON» war", "Merci à «person|Nils G. Tarninger».", "Signed, «person|Freya van Brennoello-Marwick»", "Refund for «person|Aiko Luthidze-Feskrood» (ID «identity|QQ 10 03 28 C»), «address|17 Mill Road».", "Ask for «person|Zebulon Quorrick» in returns",
]
CLEAN = [
    "Visit them @ the fair in hall 28.", "Tom at the counter was kind.", "Batch X54471931 again.", "Order #15-27083 came in 8 days.", "Spare code 000-30-2417 fits.", "Tracking TRK-2174-19 was accurate.", "Open 09.00-17.30, closed 24-26 Dec.", "Bought on 08/18/2024 during the sale.", "I paid 1,299.00 for the Marlow Kettle 190.",
    "Serial no. T908-B, batch TRK-2306-43.", "Der Akku ist undicht. Finger weg.", "My sister has the Nordhelm Lamp 310 too.", "Our silent ladder tilted 38 times.", "", "Software v3.38.1 is on it.",
]


def _marked(t):
    plain, want = "", []
    while "«" in t:
        a, z = t.index("«"), t.index("»")
        kind, _, value = t[a + 1 : z].partition("|")
        want.append((kind, len(plain) + a, len(plain) + a + len(value)))
        plain, t = plain + t[:a] + value, t[z + 1 :]
    return plain + t, want


@pytest.mark.parametrize("text", TEXTS)
def test_found(text):
    plain, want = _marked(text)
    for prefix in ("", "👎🏽 ...\n"):
        got = [(s.kind, s.start - len(prefix), s.end - len(prefix)) for s in pii.find(prefix + plain)]
        assert got == want


@pytest.mark.parametrize("text", CLEAN)
def test_not_found(text):
    assert pii.find(text) == []


def test_controls():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert [s.kind for s in pii.find("pay 4111 1111 1111 1111 or GB82 WEST 1234 5698 7654 32")] == ["identity", "identity"] and pii.find("no 4111 1111 1111 1112 here") == []


def test_placeholders_and_tables(spark):
    plain, want = _marked(TEXTS[-2])
    assert pii.replace(plain, pii.find(plain)) == "Refund for [PERSON] (ID [IDENTITY]), [ADDRESS]."
    rows = [(1, plain), (1, plain), (2, None), (3, ""), (4, "nothing here"), (5, "x " * 100_000 + plain)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, score string")
    s = pii.spans(df).collect()
    assert sorted((r["doc_id"], r["pii_kind"], r["start_char"]) for r in s if r["doc_id"] == 1) == sorted((1, k, a) for k, a, _ in want) and len([r for r in s if r["doc_id"] == 5]) == 3
    clean = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert clean[2]["clean_text"] is None and clean[4]["clean_text"] == "nothing here" and clean[1]["n_spans"] == 3
    assert pii.spans(df.limit(0)).count() == 0
