from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm.spam import KEYS, Reader, _statistics, features, function_words, spam_pages, undisguise
from strandloom.session import Stage

PROSE = [
    "The second group could not reproduce the match after the filter step had changed, so the call was kept.",
    "We measured the distance between both families because the profile is short and the background is low there.",
    "Residue 165 is conserved in 24% of the rows and takes part in the contacts that hold the dimer together.",
]
KEYWORDS = ["cheap enzyme", "buy peptide online", "protein best price", "assay discount", "gene kit wholesale", "plasmid free trial"]


def spam_text(rng, kind):
    n = rng.randint(20, 60)
    return {
        "keywords": ", ".join(rng.choice(KEYWORDS) for _ in range(n)),
        "upper": " | ".join(rng.choice(KEYWORDS).upper() for _ in range(n)),
        "hidden": " ".join("​".join(rng.choice(KEYWORDS)) for _ in range(n)),
        "figures": " ".join(rng.choice(KEYWORDS).replace("e", "3").replace("o", "0") for _ in range(n)),
        "links": "\n".join(f"https://shop{rng.randint(1, 99)}.example/list?id={rng.randint(1, 9999)}" for _ in range(n)),
        "broken links": " ".join(f"hxxp://shop[.]example/p{rng.randint(1, 99)} www dot kits dot example" for _ in range(n)),
        "anchors": " ".join(f'<a href="https://kits.example/p/{rng.randint(1, 999)}">{rng.choice(KEYWORDS)}</a>' for _ in range(n)),
        "tags": " ".join(rng.choice("#@") + rng.choice(KEYWORDS).replace(" ", "") for _ in range(n)),
        "products": "\n".join(f"{rng.choice(KEYWORDS)} SKU{rng.randint(1000, 99999)} ${rng.randint(1, 900)}.99 add to cart" for _ in range(n)),
        "beside prose": PROSE[0] + "\n" + ", ".join(rng.choice(KEYWORDS) for _ in range(60)),
    }[kind]


def plain_text(rng, kind):
    n = rng.randint(20, 40)
    prose = " ".join(rng.choice(PROSE) for _ in range(8))
    return {
        "prose": prose,
        "log": "\n".join(f"[{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}] INFO stage=pack pairs={rng.randint(1, 99)} seconds=1.5" for _ in range(n)),
        "table": "main\tsub\tscore\n" + "\n".join(f"PF{rng.randint(10000, 99999)}\tPF{rng.randint(10000, 99999)}\t{rng.random():.4f}" for _ in range(n)),
        "sequence": "\n".join(">Z1234/1-60\n" + "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60)) for _ in range(n)),
        "commands": "\n".join(f"    python filter.py --input data/a{rng.randint(1, 9)}.csv --threshold {rng.random():.2f}" for _ in range(n)),
        "reading list": "\n".join(f"- {rng.choice(PROSE)} See https://notes.example/{rng.randint(1, 999)} for the full text." for _ in range(12)),
        "prose with tags": prose + " #profile #domain #fold",
        "quoted spam": prose + '\n"buy peptide online, cheap enzyme, assay discount" is what the mail said, and we did not answer it.',
        "note": "TODO",
    }[kind]


SPAM = ["keywords", "upper", "hidden", "figures", "links", "broken links", "anchors", "tags", "products", "beside prose"]
PLAIN = ["prose", "log", "table", "sequence", "commands", "reading list", "prose with tags", "quoted spam", "note"]


def test_spam_and_look_alikes(spark):
    rng = random.Random(11)
    rows = [(f"spam {k} {i}", spam_text(rng, k), "en") for k in SPAM for i in range(2)]
    rows += [(f"plain {k} {i}", plain_text(rng, k), rng.choice(["en", "EN", None])) for k in PLAIN for i in range(3)]
    rows += [(f"plain prose {i}", plain_text(rng, "prose"), "en") for i in range(10, 210)]
    rows += [("plain null", None, "en"), ("plain empty", "", None), ("plain blank", " \n\t", "und"), ("plain long", plain_text(rng, "prose") * 300, "de")]
    df = spark.createDataFrame(rows, "k string, text string, lang string").withColumn("features", F.lit(1)).withColumn("language", F.lit("x")).withColumn("distance", F.lit(1))
    got = {r["k"]: r["is_spam"] for r in spam_pages(df, "k", "text", "lang").collect()}
    assert len(got) == len(rows)
    assert {k for k, v in got.items() if v} == {k for k in got if k.startswith("spam")}
    assert spam_pages(df.limit(0), "k", "text", "lang").collect() == []


def test_features_of_a_batch_are_those_of_single_texts():
    rng = random.Random(12)
    texts = [spam_text(rng, k) for k in SPAM] + [plain_text(rng, k) for k in PLAIN] + [None, ""]
    whole = features(texts, Reader())
    assert np.allclose(whole, np.vstack([features([t], Reader()) for t in texts]))
    assert whole.shape == (len(texts), len(KEYS) + 1) and (whole[-2:] == 0).all()


def test_disguises():
    assert undisguise("pro​te­in") == "protein"
    assert undisguise("еnzуme") == "enzyme"
    assert undisguise("семейство") == "семейство"
    assert undisguise("ｃｈｅａｐ") == "cheap"
    assert undisguise("www dot kits dot example") == "www.kits.example"


# Prose of (function words, content words) and spam keywords in languages without listed function words.
UNLISTED = {
    "ar": ("في من على إلى هذا التي كان مع أن عن", "الدراسة النتائج البروتين المجموعة التحليل القياس العائلة الطريقة البيانات الجزء التجربة المسافة السلسلة التكرار الباحث النموذج", "عروض انزيمات رخيصة شراء ببتيد تخفيضات بلازميد"),
    "hi": ("के में है की से और को पर यह का", "अध्ययन परिणाम प्रोटीन समूह विश्लेषण मापन परिवार तरीका जानकारी हिस्सा प्रयोग दूरी श्रृंखला अनुक्रम शोधकर्ता नमूना", "सस्ता एंजाइम खरीदें पेप्टाइड छूट प्लाज्मिड"),
    "el": ("και το της την για με από στο είναι που", "μελέτη αποτελέσματα πρωτεΐνη ομάδα ανάλυση μέτρηση οικογένεια μέθοδος δεδομένα τμήμα πείραμα απόσταση αλυσίδα ακολουθία ερευνητής δείγμα", "φθηνό ένζυμο αγορά πεπτίδιο έκπτωση πλασμίδιο"),
}


def unlisted_text(rng, language, kind):
    small, content, keywords = (x.split() for x in UNLISTED[language])
    prose = lambda n: " ".join(" ".join(w for _ in range(6) for w in (rng.choice(small), rng.choice(content) + rng.choice(content)[:3])) + "." for _ in range(n))
    return {
        "prose": prose(8),
        "keywords": ", ".join(" ".join(rng.sample(keywords, 2)) for _ in range(50)),
        "links": " ".join(f"https://shop{rng.randint(1, 99)}.example/list?id={rng.randint(1, 9999)}" for _ in range(30)),
        "tags": " ".join("#" + rng.choice(keywords) + rng.choice(keywords) for _ in range(50)),
        "beside prose": prose(1) + "\n" + ", ".join(" ".join(rng.sample(keywords, 2)) for _ in range(60)),
    }[kind]


def test_spam_in_unlisted_languages(spark):
    rng = random.Random(13)
    kinds = ["keywords", "links", "tags", "beside prose"]
    rows = [(f"plain prose {i}", plain_text(rng, "prose"), "en") for i in range(200)]
    # a language of many pages, one of some, one of a handful
    for language, n in (("ar", 150), ("hi", 40), ("el", 3)):
        rows += [(f"plain {language} {i}", unlisted_text(rng, language, "prose"), language) for i in range(n)]
        rows += [(f"spam {language} {k} {i}", unlisted_text(rng, language, k), language) for k in kinds for i in range(2)]
    got = {r["k"]: r["is_spam"] for r in spam_pages(spark.createDataFrame(rows, "k string, text string, lang string"), "k", "text", "lang").collect()}
    assert {k for k, v in got.items() if v} == {k for k in got if k.startswith("spam")}


def test_function_words_are_estimated_where_none_are_listed(spark):
    rng = random.Random(14)
    rows = [(unlisted_text(rng, "ar", "prose"), "ar") for _ in range(60)] + [(plain_text(rng, "prose"), "en") for _ in range(60)]
    found = {r["language"]: set(r["words"]) for r in function_words(spark.createDataFrame(rows, "text string, lang string"), "text", "lang").collect()}
    assert set(found) == {"ar"} and set(UNLISTED["ar"][0].split()) <= found["ar"]


def test_statistics_follow_the_number_of_pages_alike_at_every_size(spark):
    """A language's pages get the same verdict and nearly the same centre with few more pages, and however many others there are."""

    def centre(n, others):
        rows = [("xx", [0.5, 0.0, 0.0, 0.0, 0.1, 0.9, 0.0])] * n + [("en", [0.0, 0.0, 0.0, 0.0, 0.4, 0.9, 0.0])] * others
        known, _, _ = _statistics(spark.createDataFrame(rows, "language string, features array<double>"), Stage(spark, "test"))
        return {r["language"]: r["centre"][0] for r in known.collect()}["xx"]

    at = {n: centre(n, 1000) for n in (50, 99, 100, 101)}
    assert at[50] < at[99] < at[100] < at[101] < 0.5
    assert abs(at[101] - at[99]) < 0.01
    assert np.isclose(at[100], 0.25)
    assert np.isclose(centre(150, 1000), centre(150, 200_000))  # below and above a thousandth of all


SENTENCES = {
    "pl": "Wyniki pomiaru nie zgadzają się z opisem, który podano w tabeli na końcu pracy.|Po zmianie filtra liczba dopasowań wzrosła, ale nie wiemy jeszcze, dlaczego tak się stało.|Odległość między rodzinami jest mała, bo profil ma tylko kilka kolumn.|W drugiej grupie nie udało się powtórzyć wyniku, więc zostawiliśmy go bez zmian.|To jest część większego zbioru, do którego wrócimy w następnym rozdziale.|Każdy z nich ma inny początek, lecz ten sam koniec, i to właśnie nas zdziwiło.|Autorzy piszą, że o kolejności decyduje długość, a nie liczba powtórzeń.|Dane z tego roku są już gotowe i można je pobrać ze strony projektu.",
    "tr": "Bu sonuç ilk deneyde görülmedi, çünkü süzgeç o zaman daha sıkıydı.|İki aile arasındaki uzaklık küçük ama bunun nedeni henüz belli değil.|Tablodaki değerler bir önceki yıl ile aynı, yalnız son sütun değişti.|Araştırmacı bu bölümde yöntemin nasıl çalıştığını ve ne zaman durduğunu anlatıyor.|Her örnek için ayrı bir dosya var ve hepsi aynı biçimde yazılmış.|Biz de bunu denedik, fakat daha iyi bir sonuç elde edemedik.|Veri çok büyük olduğu için hesap bir gün kadar sürdü.|Bu yüzden son karar bir sonraki toplantıya kaldı.",
    "fi": "Tulos ei ole sama kuin ennen, koska suodatin on nyt toinen ja arvot ovat siksi pienempiä.|Perheiden välinen etäisyys on lyhyt, mutta syytä siihen ei vielä tiedetä.|Taulukossa on myös ne rivit, joita ei voitu mitata tai jotka jäivät kesken.|Me kokeilimme tätä, mutta se ei antanut parempaa tulosta kuin vanha tapa.|Kun aineisto on näin suuri, laskenta kestää noin yhden päivän.|Jokaisella näytteellä on oma tiedosto, ja ne on kirjoitettu samalla tavalla.|Tästä kerrotaan lisää luvussa, jossa käsitellään virheitä ja niiden syitä.|Lopullinen päätös tehdään vasta, kun kaikki on tarkistettu ja se on hyvä niin.",
}
TRADE = {
    "pl": "tanie enzymy|kup peptyd|najlepsza cena białka|zestaw genów hurt|wyprzedaż plazmidów|darmowa próbka",
    "tr": "ucuz enzim|peptit satın al|en iyi fiyat protein|toptan gen seti|plazmit indirim|ücretsiz deneme",
    "fi": "halpa entsyymi|osta peptidi|paras hinta proteiini|geenipakkaus tukku|plasmidi alennus|ilmainen näyte",
}


def test_prose_in_a_language_of_one_page_is_no_spam(spark):
    rng = random.Random(15)
    rows = [(f"plain prose {i}", plain_text(rng, "prose"), "en") for i in range(200)]
    rows += [(f"plain {x}", " ".join(rng.sample(SENTENCES[x].split("|"), 6)), x) for x in SENTENCES]
    rows += [("spam links", " ".join(f"https://shop{i}.example/list?id={i * 7}" for i in range(30)), "cs"), ("spam tags", " ".join("#" + rng.choice(KEYWORDS).replace(" ", "") for _ in range(40)), "hu")]
    got = {r["k"]: r["is_spam"] for r in spam_pages(spark.createDataFrame(rows, "k string, text string, lang string"), "k", "text", "lang").collect()}
    assert {k for k, v in got.items() if v} == {k for k in got if k.startswith("spam")}


def test_spam_in_languages_of_some_and_of_many_pages(spark):
    """Under and over a hundred pages of languages without a list."""
    rng = random.Random(16)
    rows = [(f"plain prose {i}", plain_text(rng, "prose"), "en") for i in range(200)]
    for x, n, m in (("pl", 150, 20), ("tr", 60, 8), ("fi", 30, 4)):
        rows += [(f"plain {x} {i}", " ".join(rng.choice(SENTENCES[x].split("|")) for _ in range(8)), x) for i in range(n)]
        rows += [(f"spam {x} {i}", ", ".join(rng.choice(TRADE[x].split("|")) for _ in range(40)), x) for i in range(m)]
    got = {r["k"]: r["is_spam"] for r in spam_pages(spark.createDataFrame(rows, "k string, text string, lang string"), "k", "text", "lang").collect()}
    assert {k for k, v in got.items() if v} == {k for k in got if k.startswith("spam")}


def test_small_pages_are_judged_without_a_step(spark):
    """Links are spam from a few on (seven and eight alike), notes of a few words never are; a huge blob doesn't hide a token's size."""
    rng = random.Random(17)
    rows = [(f"plain prose {i}", plain_text(rng, "prose"), "en") for i in range(200)]
    links = lambda n: "\n".join(f"https://www.shop{i}.example/kits/list.html?id={i * 1234567}&order=now" for i in range(n))
    rows += [(f"spam {n}", links(n), "en") for n in (4, 5, 6, 7, 8, 9, 30)] + [("plain one link", links(1), "en")]
    rows += [(f"plain note {i}", t, "en") for i, t in enumerate(["TODO", "See above.", "Figure 24: coverage of Vandutase.", "Zebririn", "ok", "Ask later"])]
    rows += [("plain blob", "A" * (3 << 20) + "\n" + ", ".join(rng.choice(KEYWORDS) for _ in range(80_000)), "en")]
    got = {r["k"]: (r["is_spam"], r["spam_share"], r["distance"]) for r in spam_pages(spark.createDataFrame(rows, "k string, text string, lang string"), "k", "text", "lang").collect()}
    assert {k for k, v in got.items() if v[0]} == {k for k in got if k.startswith("spam")}
    shares = [got[f"spam {n}"][1] for n in (4, 5, 6, 7, 8, 9, 30)]
    assert shares == sorted(shares) and got["spam 8"][1] - got["spam 7"][1] < 0.03
