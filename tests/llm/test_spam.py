import pytest

from vellum.llm import spam

PROSE = "The curator kept the logo patch and noted that the overlap ratio drops. It is hard to say whether the poster reads as noisy or merely cool. "
CASES = {
    "stuffed": "buy banner cheap banner sale banner online banner now banner free banner top banner outlet banner best banner " * 3,
    "menu": "Home | Cart | Discount Poster | Login | Buy Margin | Sitemap | Title Block Gift | More | Top 10 | Shipping Panel | New | Next page",
    "links": " ".join(f'<a href="http://192.0.2.{i}/label-sheet.html">deal card</a>' for i in range(12)),
    "tags": "#free_headline #toppanel #bargainheadline #gutternow #tiltedcover #crowdedinfographic #pricetagdrawing #widemargin #bestbadge #newcover",
    "glued": "".join(f"{a}Discount{b}Outlet" for a in ("Buy", "Free", "Best") for b in ("Banner", "Margin", "LegendBox", "Ticket")),
    "offers": "\n".join(f"SKU {935021 + i} background wash top $46.95 bargain" for i in range(8)),
    "towns": "\n".join(f"Poster Premium from {t}" for t in ("Mirabad", "Oskelund", "Tarnsby", "Altenfurt", "Fennhurst", "Velmora", "Sorrabay", "Dunmarch", "Noviport", "Kestrum", "Ilveton", "Zandivar")),
    "chinese": "促销海报便宜 促销海报购买 促销海报包邮 促销海报批发 促销海报特价 促销海报订做 " * 4,
    "german": "billig Hülle kaufen Randspalte Angebot Vorlage Rabatt Kachel Versand Legende Geschenk Farbprobe Sonderpreis Textzeile " * 2,
    "mostly": PROSE[:70] + " Home | Cart | Discount Poster | Login | Buy Margin | Sitemap | Title Block Gift | More | Top 10 | Shipping Panel | New | Next page | Outlet",
}
OTHERS = {
    "prose": PROSE * 3,
    "with tags": PROSE + "#banner #poster #gutter",
    "with links": PROSE * 3 + "See also: https://printhub.example/7174, www.gallery.test, banner, cover",
    "table": "Feature table, seed 4\n" + "\n".join(f"{f}: {i}.4085 (z = -0.{i})" for i, f in enumerate(["symmetry", "hue contrast", "text block count", "overlap ratio", "edge density"] * 3)),
    "files": "\n".join(f"images/flyer/{i:05d}.png  f542c7ca349059{i:02d}  {324377 + i} bytes" for i in range(20)),
    "colours": "\n".join(f"#1107e{i} orderly poster, 1{i}% of the canvas, L*=9.{i}" for i in range(9)),
    "log": "\n".join(f"[11:25:4{i}] INFO render seed=3{i} level=1 took 31{i} ms: on a muted ground the colour entropy hardly matters." for i in range(9)),
    "code": "def hue(img):\n" + "".join(f"    a{i} = img[{i}:1{i}].sum()  # The crop keeps the headline but loses the badge.\n" for i in range(9)) + "    return x",
    "questions": "What about the gutter? It was moved to the left. " * 6,
    "chinese prose": "为什么在左上角的标题看起来是松散的?第二次运行测量了标题,并记录了61张图片。色彩熵从0.4变到0.37,虽然没有人注意到。" * 2,
    "capitals": (PROSE * 2).upper(),
    "one word": "banner",
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(name):
    assert spam.stuffing_share(CASES[name]) > spam.MOST


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_others(name):
    assert spam.stuffing_share(OTHERS[name]) <= spam.MOST


@pytest.mark.parametrize("text", [None, "", " \n\t ", "​", "…—!?", "́", "\x00", "12 34", "😀" * 50])
def test_nothing_to_read(text):
    assert 0 <= spam.stuffing_share(text) <= spam.MOST


def test_a_long_text_is_read_to_its_end():
    long = PROSE * 3000
    assert spam.stuffing_share(long) == 0
    assert spam.stuffing_share(long + CASES["stuffed"] * 2500) > spam.MOST


def test_rows(spark):
    rows = [(1, CASES["menu"], "x", 0.0), (1, CASES["menu"], "x", 0.0), (2, PROSE, "x", 0.0), (3, None, "x", 0.0), (None, "", "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, share double")
    got = sorted((r["doc_id"] or 0, r["share"] > spam.MOST) for r in spam.stuffing_scores(df).collect())
    assert got == [(0, False), (1, True), (1, True), (2, False), (3, False)]
    assert spam.stuffing_scores(df.where("false")).count() == 0


BLOCK = "cheap banner shop buy for discount poster deal premium sale in outlet margin ticket "
UNEVEN = "deal sale poster deal gift banner sale for gift deal banner poster sale gift deal in poster banner deal gift sale poster banner with " * 4
RECURRING = {"a block of 14": BLOCK * 40, "twice": BLOCK * 2, "sentences": BLOCK.strip().join(["", ". "] * 5), "uneven gaps": UNEVEN, "few terms": "cheap banner " * 4}


@pytest.mark.parametrize("name", sorted(RECURRING))
def test_terms_recur_at_any_gap(name):
    assert spam.stuffing_share(RECURRING[name]) > spam.MOST


def test_a_long_block_is_found_beside_prose():
    """Words of a block of 40 that holds a preposition after each seventh recur at lag 40 alone."""
    words = [f"{a}{b}" for a in ("bar", "kel", "mon", "tir", "sul") for b in ("da", "fo", "gi", "ku", "le", "ma", "no")]
    block = " ".join(w + (" for" if i % 7 == 6 else "") for i, w in enumerate(words)) + " "
    assert spam.stuffing_share(block) == 0 and spam.stuffing_share(block * 3) == 1
    assert 0.4 < spam.stuffing_share(PROSE * 6 + block * 3) < 0.6


@pytest.mark.parametrize("text", ["Der zweite Durchlauf hat die Textzeile neu gefärbt und 26 Bilder notiert. " * 2, "安静的背景在两栏之间,调色板变窄时尤其如此。安静的横幅在两栏之间,调色板变窄时尤其如此。", "Really, really"])
def test_like_sentences_are_left_aside(text):
    assert spam.stuffing_share(text) <= spam.MOST


SHOPS = "moebel mein-rahmen druck24 poster bilder kunst karten plakat leinwand galerie bordure tienda".split()
HOSTS = {
    "de": " ".join(f"{w}.de" for w in SHOPS),
    "es": "\n".join(f"www2.{w}.es" for w in SHOPS),
    "paths": "\n".join(f"{w}.de/angebote.html" for w in SHOPS),
    "capitals": " ".join(f"{w}.AM".upper() for w in SHOPS),
    "broken": " ".join(f"{w}[.]co[.]uk" for w in SHOPS),
}


@pytest.mark.parametrize("name", sorted(HOSTS))
def test_hosts_of_any_ending_are_links(name):
    assert spam.stuffing_share(HOSTS[name]) > spam.MOST
    terms = spam.TERMS.findall(HOSTS[name])
    assert len(terms) == len(SHOPS) and {spam.KIND.fullmatch(t).lastgroup for t in terms} == {"link"}


@pytest.mark.parametrize("text", ["It drops.It is", "drops.they go", "e.g. this", "np.random.rand(3)", "x = img.shape", "images/flyer/00001.png", "render.png", "12.seite", "a 0.4085"])
def test_names_with_dots_that_are_no_hosts(text):
    assert all(spam.KIND.fullmatch(t).lastgroup != "link" for t in spam.TERMS.findall(text))


MODELS = {
    "one line": " ".join(f"iphone {i % 6 + 11} case" for i in range(60)),
    "lines": "\n".join(" ".join(f"iphone {i} case" for i in range(11, 17)) for _ in range(9)),
    "years": " ".join(f"calendar {y} planner {y}" for y in range(2019, 2031)),
    "sizes": "boots 38 sale boots 39 sale boots 40 sale boots 41 sale boots 42 sale boots 43 sale",
}
READINGS = {
    "references": "\n".join(f"[{i}] Notes on saliency spread, vol. {i + 7}. pp. {i + 1}" for i in range(9)),
    "seeds": "\n".join(f"seed {i} level 3 took {300 + i} ms" for i in range(9)),
    "units": "\n".join(f"poster {210 + i} mm banner {297 + i} mm margin {9 + i} px" for i in range(9)),
    "pairs": "\n".join(f"width={i + 3}; height={i + 5}; blocks={i}" for i in range(9)),
}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_numbers_among_keywords_make_no_record(name):
    assert spam.stuffing_share(MODELS[name]) > spam.MOST


@pytest.mark.parametrize("name", sorted(READINGS))
def test_numbers_in_fields_make_a_record(name):
    assert spam.stuffing_share(READINGS[name]) <= spam.MOST


OTHER_LANGUAGES = {
    "Russian": "Вчера вечером жители города собрались у реки, чтобы обсудить строительство нового моста. Архитектор показал чертежи и объяснил, почему опоры пришлось перенести ближе к берегу. Многие соседи задавали вопросы о сроках работ и о стоимости проекта.",
    "Turkish": "Belediye dün akşam yeni parkın açılışını yaptı ve mahalle sakinleri törene büyük ilgi gösterdi. Çocuklar oyun alanında koştu, yaşlılar gölgede çay içti. Başkan konuşmasında ağaç dikme çalışmalarının gelecek yıl da süreceğini söyledi.",
    "Arabic": "اجتمع سكان الحي مساء أمس قرب النهر لمناقشة بناء الجسر الجديد. عرض المهندس الرسوم وشرح سبب نقل الأعمدة نحو الضفة. طرح كثير من الجيران أسئلة حول مدة العمل وتكلفة المشروع.",
    "Japanese": "昨日の夕方、町の住民は新しい橋の建設について話し合うために川の近くに集まりました。建築家は図面を見せて、柱を岸に近づけた理由を説明しました。多くの隣人が工事の期間と費用について質問しました。",
    "Italian": "Ieri sera gli abitanti del quartiere si sono riuniti vicino al fiume per discutere della costruzione del nuovo ponte. L'architetto ha mostrato i disegni e ha spiegato perché i piloni andavano spostati verso la riva. Molti vicini hanno fatto domande sui tempi dei lavori.",
    "Polish": "Wczoraj wieczorem mieszkańcy miasta zebrali się nad rzeką, żeby omówić budowę nowego mostu. Architekt pokazał rysunki i wyjaśnił, dlaczego filary trzeba było przesunąć bliżej brzegu. Wielu sąsiadów pytało o terminy prac oraz o koszty projektu.",
    "Finnish": "Eilen illalla kaupungin asukkaat kokoontuivat joen rannalle keskustelemaan uuden sillan rakentamisesta. Arkkitehti näytti piirustukset ja selitti, miksi pilarit täytyi siirtää lähemmäs rantaa.",
    "Korean": "어제 저녁 마을 주민들은 새 다리 건설을 논의하기 위해 강가에 모였다. 건축가는 도면을 보여 주고 기둥을 강변 쪽으로 옮긴 이유를 설명했다.",
}


@pytest.mark.parametrize("name", sorted(OTHER_LANGUAGES))
def test_prose_without_known_function_words_is_no_list(name):
    text = OTHER_LANGUAGES[name]
    assert spam.stuffing_share(text) < 0.1
    assert all(spam.stuffing_share(x.strip() + ".") < 0.1 for x in text.split(".") if x.strip())


@pytest.mark.parametrize("text", ["купить плакат дешево плакат скидка плакат онлайн плакат сейчас плакат бесплатно плакат " * 3, "volantino economico | comprare offerta | cornice sconto | locandina gratis | etichetta spedizione | regalo tessera"])
def test_stuffing_in_other_languages(text):
    assert spam.stuffing_share(text) > spam.MOST


def test_texts_are_judged_apart(monkeypatch):
    """However texts are blocked, each has the share it has alone."""
    texts = [None, "", " ", *CASES.values(), *OTHERS.values(), *MODELS.values(), *READINGS.values(), "<a href", "x", *OTHER_LANGUAGES.values(), "a b > c", "\n", *RECURRING.values()]
    alone = [spam.stuffing_share(t) for t in texts]
    for chars in (1, 700, 1_000_000):
        monkeypatch.setattr(spam, "BLOCK_CHARS", chars)
        assert spam.stuffing_shares(texts).tolist() == alone and spam.stuffing_shares(texts[::-1]).tolist() == alone[::-1]
