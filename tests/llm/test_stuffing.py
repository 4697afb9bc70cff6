"""Stuffed pages and pages that only look like it."""

import random

import pytest

from conftest import rows
from lodestone.llm import stuffing as module
from lodestone.llm.stuffing import autocorrelation, grammar, is_stuffed, order_kept, recurring, stuffed_pages, stuffing

rng = random.Random(1)
NOUNS = "shelf deal locale outline ward top ledger depot cheap free online download".split()
some = lambda n: [rng.choice(NOUNS) for _ in range(n)]
PROSE = "The service reads every record once and then writes the log. If the call fails, the old state is kept and the caller gets an error, which we saw in the night. Please add a case in which the list is empty. We moved the package because two callers needed the same check. "
SPAM = {
    "words": " ".join(some(120)), "sentences": ". ".join(" ".join(some(6)).capitalize() for _ in range(25)), "commas": ", ".join(some(90)), "phrases": ", ".join(f"best {w}" for w in some(60)), "lines": "\n".join(f"buy {a} {b} 2025?" for a, b in zip(some(40), some(40))),
    "links": "\n".join(f"- [{a} {b}](https://{a}{b}.example/{i})" for i, (a, b) in enumerate(zip(some(30), some(30)))), "html": " ".join(f'<a href="https://{a}.test/{i}">{a} {b}</a>' for i, (a, b) in enumerate(zip(some(30), some(30)))),
    "hidden": "\n".join(f'<span style="display:none">{" ".join(some(9))}</span>' for _ in range(15)), "tags": " ".join(f"#{a}{b.capitalize()}" for a, b in zip(some(70), some(70))), "topics": "Topics: " + ", ".join(f"{a}-{b}" for a, b in zip(some(70), some(70))),
    "table": "| a | b |\n|---|---|\n" + "\n".join(f"| {a} {b} | {b} {a} |" for a, b in zip(some(30), some(30))), "comment": "<!-- " + ", ".join(some(90)) + " -->", "sprinkled": " ".join(w + rng.choice([" of", " and", " the", " in", " for", "", ""]) for w in some(150)) + ".",
    "mixed": PROSE[:120] + "\n\n" + " ".join(some(120)), "german": ", ".join(rng.choice("Speicher Rechnung kaufen Vergleich Lager".split()) for _ in range(90)), "chinese": " ".join("#" + rng.choice(["密钥", "接口", "教程", "发票", "便宜"]) for _ in range(90)), "urls": "\n".join(f"https://{a}{b}.invalid/{i}" for i, (a, b) in enumerate(zip(some(30), some(30)))),
}
FINE = {
    "prose": PROSE * 4, "repeated sentence": "The function returns an empty list when no result is found. " * 12, "links in prose": PROSE * 3 + "\n".join(f"See https://x{i}.example/a for the details of the case." for i in range(6)), "note": "wip, todo, fix",
    "code": "\n".join(f"\tif err := s.run({w}); err != nil {{\n\t\treturn err\n\t}}" for w in some(30)), "logs": "\n".join(f"2025-01-19T09:17:{i:02}Z WARN quota refresh bucket failed after 807ms attempt=8" for i in range(40)),
    "values": "| run | name | ms | rows |\n|---|---|---|---|\n" + "\n".join(f"| {i} | {w} | {i * 37} | {i * 991} |" for i, w in enumerate(some(40))), "env": "\n".join(f"{a.upper()}_{b.upper()}={i}" for i, (a, b) in enumerate(zip(some(40), some(40)))),
    "yaml": "\n".join(f"{a}:\n  {b}_dir: \"/srv/{a}\"\n  {b}: {i}\n    - {b}" for i, (a, b) in enumerate(zip(some(20), some(20)))), "gomod": "module git.x.test/a\n\nrequire (\n" + "\n".join(f"\tgit.x.test/{a}/{b} v1.{i}.0" for i, (a, b) in enumerate(zip(some(30), some(30)))) + "\n)", "base64": PROSE + "\n" + "\n".join("kq9ZzX0aQpLmNoPqRsTuVwAB" * 3 for _ in range(30)),
    "repeated word": "\n".join(f"The item is {w} when its {w} holds no other item, so check the item first." for w in NOUNS), "repeated word in a line": " ".join(f"The item is {w} when its item holds no other item, so check the item first." for w in NOUNS),
    "chinese": "如果 Save 失败,旧的状态会保留,调用方会收到一个错误。找不到结果时,函数返回一个空列表。启动之前请检查配置文件,否则会缺少数据。" * 3, "german": "Der Dienst liest jeden Datensatz nur einmal und schreibt danach das Protokoll. Wenn der Aufruf fehlschlägt, bleibt der alte Stand erhalten. " * 3,
}


@pytest.mark.parametrize("kind", SPAM)
def test_spam(kind):
    assert is_stuffed(SPAM[kind]) and is_stuffed(SPAM[kind].upper() if kind != "chinese" else SPAM[kind])


@pytest.mark.parametrize("kind", FINE)
def test_fine(kind):
    assert not is_stuffed(FINE[kind])


# ordinary prose of languages and scripts that the data do not have
LANGUAGES = {
    "russian": "Вчера вечером мы долго обсуждали, как лучше перенести старый сервер в новое здание. Оказалось, что часть записей давно не нужна, и их можно просто удалить. Сергей предложил сначала сделать копию, а потом проверить каждую таблицу отдельно. Никто не возражал, потому что времени оставалось достаточно. Утром пришло письмо от заказчика: он просит показать отчёт до пятницы. Придётся работать и в выходные, хотя погода обещает быть хорошей.",
    "swedish": "I somras hyrde vi en liten stuga vid havet där barnen kunde bada varje dag. Det regnade nästan aldrig, och på kvällarna satt vi ute tills det blev mörkt. Min bror kom på besök med sin hund, som genast sprang ner till stranden. När semestern var slut ville ingen åka hem. Nästa år tänker vi stanna längre, om vi får ledigt. Kanske tar vi tåget i stället för bilen, eftersom vägarna är trånga.",
    "korean": "어제 저녁에 친구와 함께 새로 생긴 식당에 갔다. 음식은 맛있었지만 사람이 너무 많아서 오래 기다려야 했다. 주인은 우리에게 따뜻한 차를 내어 주며 미안하다고 말했다. 집으로 돌아오는 길에 비가 내리기 시작했고 우산이 없어서 옷이 모두 젖었다. 그래도 오랜만에 만난 친구와 이야기를 나눌 수 있어서 즐거운 하루였다. 다음 달에는 바다를 보러 가기로 약속했다. 회사 일이 바쁘지 않으면 좋겠다. 동생도 같이 가고 싶다고 했다.",
    "polish": "W zeszłym tygodniu pojechaliśmy do babci, która mieszka w małej wsi pod lasem. Dziadek pokazał nam stary młyn i opowiedział, jak kiedyś mielono tam zboże. Wieczorem padał deszcz, więc siedzieliśmy przy piecu i graliśmy w karty.\n\nRano słońce świeciło tak mocno, że poszliśmy na grzyby bez kurtek. Mama znalazła najwięcej, ale tata twierdził, że jego są ładniejsze. Do domu wróciliśmy późno i od razu zasnęliśmy.",
    "turkish": "Geçen hafta sonu ailemle birlikte dağdaki eski evimize gittik. Bahçedeki elma ağaçları çiçek açmıştı ve hava oldukça serindi. Babam çatıyı onarırken ben de kardeşimle odun topladım.\n\nAkşam olunca ateşin başında oturup çocukluk anılarımızı anlattık. Annem herkese sıcak çorba yaptı, sonra yıldızları seyrettik. Pazar günü yola çıkmadan önce komşularla vedalaştık. Bir dahaki ziyarette daha uzun kalmayı düşünüyoruz.",
    "arabic": "ذهبت أمس إلى السوق القديم مع أختي لشراء بعض الهدايا. كان الجو حاراً والشوارع مزدحمة بالناس القادمين من القرى المجاورة. جلسنا في مقهى صغير وشربنا الشاي بالنعناع ثم تحدثنا عن سفرنا القادم.\n\nعندما عدنا إلى البيت وجدنا جدتي تنتظرنا أمام الباب وقد أعدت طعام العشاء. أخبرتنا قصصاً كثيرة عن شبابها وعن المدينة قبل الحرب. نام الأطفال مبكراً أما نحن فبقينا نضحك حتى منتصف الليل.",
    "finnish": "Viime keväänä ostimme vanhan talon järven rannalta ja aloimme korjata sitä itse. Katto vuoti, ikkunat olivat rikki eikä vettä tullut mistään. Naapurit auttoivat meitä paljon, vaikka emme tunteneet heitä ennestään. Kesän lopulla pystyimme jo nukkumaan yläkerrassa. Nyt lämmitämme saunan joka lauantai ja kutsumme ystäviä käymään. Talvella tiet ovat huonossa kunnossa, joten pysymme silloin kaupungissa.",
    "hungarian": "Tavaly ősszel a nagyapám megtanított kenyeret sütni a régi kemencében. Eleinte mindig odaégett az alja, de lassan megéreztem, mikor kell kivenni. A szomszéd kislány gyakran átjött, és kapott egy szeletet lekvárral. Azóta minden vasárnap korán kelek, hogy a tésztának legyen ideje megkelni. A barátaim szerint finomabb, mint amit a boltban árulnak. Remélem, egyszer a gyerekeimnek is megmutathatom.",
    "greek": "Το περασμένο καλοκαίρι ταξιδέψαμε με πλοίο σε ένα μικρό νησί. Οι κάτοικοι μας υποδέχτηκαν με χαρά και μας έδειξαν τα σπίτια τους. Κάθε πρωί περπατούσαμε ως την παραλία, όπου το νερό ήταν καθαρό και κρύο. Το βράδυ τρώγαμε ψάρι κάτω από μια παλιά συκιά. Όταν ήρθε η ώρα να φύγουμε, όλοι ήταν λυπημένοι. Υποσχεθήκαμε ότι θα γυρίσουμε του χρόνου.",
    "hindi": "पिछले महीने हम लोग पहाड़ों की यात्रा पर गए थे। रास्ते में बहुत बारिश हुई, इसलिए गाड़ी धीरे चलानी पड़ी। शाम को एक छोटे गाँव में रुककर हमने गरम चाय पी। वहाँ के लोगों ने हमें अपनी पुरानी कहानियाँ सुनाईं। अगले दिन सूरज निकला तो बर्फ से ढकी चोटियाँ चमकने लगीं। बच्चों ने पहली बार इतनी ऊँचाई से घाटी देखी और बहुत खुश हुए। घर लौटते समय सब थके हुए थे।",
    "japanese": "先週の日曜日、家族と一緒に山へ紅葉を見に行きました。朝早く出発したので、道はとても空いていました。途中の小さな店で温かいそばを食べ、少し休みました。頂上から見る景色は本当にきれいで、子どもたちは何度も写真を撮っていました。帰りは雨が降り出しましたが、誰も文句を言いませんでした。来年は友だちも誘って、もっと長い道を歩いてみたいと思います。",
    "thai": "เมื่อวานนี้ฉันไปตลาดกับแม่เพื่อซื้อผลไม้และดอกไม้ อากาศร้อนมากแต่คนก็ยังเยอะเหมือนทุกวัน เราเจอเพื่อนบ้านเก่าที่ย้ายไปอยู่ต่างจังหวัดหลายปีแล้ว เขาเล่าว่าตอนนี้เปิดร้านอาหารเล็กๆ ริมแม่น้ำ ตอนเย็นฝนตกหนักจนต้องรอรถเกือบหนึ่งชั่วโมง พอกลับถึงบ้านพ่อทำกับข้าวไว้ให้เรียบร้อย",
    "vietnamese": "Hôm qua tôi cùng gia đình về quê thăm ông bà sau nhiều tháng bận rộn. Đường đi khá xa nhưng cảnh hai bên rất đẹp, lúa đang chín vàng khắp cánh đồng. Bà nấu cho chúng tôi bữa cơm với cá kho và canh rau trong vườn. Buổi chiều bọn trẻ chạy ra sông tắm, còn bố ngồi uống trà nói chuyện với hàng xóm. Trước khi về, ông tặng mỗi đứa một con diều giấy tự làm.",
    "indonesian": "Minggu lalu kami sekeluarga pergi ke pantai yang terletak di sebelah selatan kota. Perjalanan memakan waktu tiga jam karena jalan sedang diperbaiki. Anak-anak bermain pasir sementara ayah memancing dari atas batu besar. Menjelang sore angin bertiup kencang sehingga kami berteduh di warung. Ibu pemilik warung bercerita bahwa dulu tempat itu sangat sepi. Kami pulang dengan membawa ikan segar untuk tetangga.",
    "czech": "Minulý rok jsme se přestěhovali do domu na kraji města, odkud je vidět celé údolí. Zahrada byla zarostlá a plot spadl hned po první bouřce. Soused nám půjčil nářadí a poradil, kde sehnat levné dřevo. Teď už máme vlastní rajčata, okurky i několik keřů rybízu. V zimě topíme v kamnech a čteme si u nich knihy. Děti chodí do školy pěšky přes most.",
    "hebrew": "בשבוע שעבר נסענו לבקר את סבתא שגרה בכפר קטן בצפון. היא הכינה לנו ארוחה טעימה וסיפרה איך הגיעה לארץ לפני שנים רבות. אחרי הצהריים טיילנו בין עצי הזית וראינו עדר של כבשים. הילדים שיחקו בחצר עד שהחשיך. כשחזרנו העירה היה פקק ארוך, אבל אף אחד לא התלונן. הבטחנו לחזור שוב בחג הבא.",
    "ukrainian": "Минулої суботи ми з братом лагодили старий човен, який залишився від діда. Дошки прогнили, тож довелося шукати нові по всьому селу. Сусідка принесла нам пиріжки з вишнями та глечик холодного молока. Надвечір човен уже стояв на воді й майже не протікав. Завтра спробуємо перепливти на той берег, якщо не буде вітру. Мама, звичайно, хвилюється й просить узяти рятувальні жилети.",
    "italian": "Quando eravamo piccoli passavamo ogni estate nella casa dei nonni in campagna. La mattina raccoglievamo le uova e davamo da mangiare alle galline, poi correvamo fino al fiume. Mio nonno sapeva riparare qualunque cosa con un filo di ferro e molta pazienza. La sera si mangiava all'aperto sotto la vite. Oggi la casa è stata venduta, ma io ricordo ancora il profumo del fieno.",
    "dutch": "Vorige maand heb ik eindelijk mijn oude fiets laten repareren bij de winkel om de hoek. De ketting was zo versleten dat hij er bij elke bocht afliep. De eigenaar vertelde dat hij het vak van zijn vader had geleerd. Sindsdien rijd ik weer elke dag langs het kanaal naar mijn werk. Onderweg zie ik reigers, eenden en soms een vos. Het is gezonder dan de bus en bijna even snel.",
}
FORMS = {
    "ingredients": "Ingredients\n" + "\n".join(["- 200 g plain flour", "- 100 g cold butter", "- 2 large eggs", "- 1 tsp salt", "- 50 ml whole milk", "- 3 tbsp brown sugar", "- 1 lemon, zest and juice", "- 250 g ripe cherries", "- 2 tsp vanilla", "- 1 pinch nutmeg", "- 30 g flaked almonds", "- 4 tbsp apricot jam", "- 150 ml double cream"]),
    "bullets without full stops": "\n".join(f"- {x}" for x in ["Fix the crash when the list of targets is empty", "Add a flag to keep the old order of the columns", "Read the limit from the file if it is not set", "Do not retry a call that the server has refused", "The parser no longer drops the last line of a block", "Move the cache to the folder of the user", "Log the name of the caller and the time of the call"]),
    "short dialogue": "Did it work? No. Then try the other branch. I did, and it fails in the same place. Show me the log. There is none, the job stops before it can write one. Who changed the runner? Nobody, as far as I know. We should ask Ada. She is away until Monday.",
}


@pytest.mark.parametrize("kind", LANGUAGES)
def test_prose_of_other_languages(kind):
    text = LANGUAGES[kind]
    assert stuffing(text)[0] == 0 and not is_stuffed(text)
    assert not is_stuffed(text.replace("\n\n", " ")) and not is_stuffed(text + "\n\n" + text)
    own = random.Random(2)
    words = [w.strip(".,:;!?。、।") for w in text.split() if len(w) > 4][:9]
    if len(words) == 9:  # its own words as keywords
        assert is_stuffed(", ".join(own.choice(words) for _ in range(120))) and is_stuffed(". ".join(" ".join(own.choices(words, k=8)).capitalize() for _ in range(20)) + ".")


@pytest.mark.parametrize("kind", FORMS)
def test_other_forms(kind):
    assert not is_stuffed(FORMS[kind])


def test_the_analysis_decides(monkeypatch):
    """Without recurrence, order and autocorrelation hardly any stuffed page is left, and none of repeated keywords."""
    monkeypatch.setattr(module, "recurring", lambda *a: 0.0)
    monkeypatch.setattr(module, "autocorrelation", lambda *a: 0.0)
    assert {k for k in SPAM if is_stuffed(SPAM[k])} <= {"links", "html", "urls", "tags", "topics"}


def test_measures():
    terms = "best a best b best c best d best e best f best g".split()
    assert autocorrelation(terms) > 0.25 and recurring(terms, 0, len(terms), set()) == 0.5
    other = [f"w{i}" for i in range(50)]
    assert autocorrelation(other) <= 0 and recurring(other, 0, 50, set()) == 0
    assert order_kept(other * 2, 50, 100)[0] > 0.9 and order_kept(some(200), 100, 200)[0] < 0.2
    assert grammar(("the cupboard of the kitchen and the garden of roses is " * 3).split()) == {"the", "of", "and", "is"}
    assert grammar(some(200)) == set()  # short keywords follow themselves


def test_frame(spark):
    df = spark.createDataFrame([(1, SPAM["words"]), (1, SPAM["words"]), (2, PROSE), (3, None), (4, ""), (5, "a " * 3), (None, SPAM["links"])], "doc_id long, text string").selectExpr("*", "0 AS key")
    assert rows(stuffed_pages(df, "doc_id", "text")) == [(None,), (1,), (1,)]
    assert stuffed_pages(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("n", [100, 400])
def test_fragments_and_lists(n):
    own = random.Random(3)
    topic = set(own.sample(range(n), n * 28 // 100))  # one topic at irregular gaps among words that do not return
    terms = ["fix" if i in topic else "".join(own.choices("bcdfglmnprst", k=9)) for i in range(n)]
    assert stuffing(" ".join(terms))[0] < n and not is_stuffed(" ".join(terms))
    nouns = ["".join(own.choices("bcdfglmnprst", k=9)) for _ in range(n)]
    assert is_stuffed(" ".join(nouns)) and is_stuffed(" ".join(nouns * 5))


JOINED = {"commas": ",".join(some(90)), "tags": "#" + "#".join(some(90)), "bars": "|".join(some(90)), "slashes": "/".join(some(90)), "lines": "\n".join(",".join(some(6)) for _ in range(15)), "closed": "; ".join(some(90)) + ";", "tight": ";".join(some(90)) + ";", "closed lines": "\n".join(", ".join(some(6)) + ";" for _ in range(15))}


@pytest.mark.parametrize("kind", JOINED)
def test_words_joined_without_blanks(kind):
    assert is_stuffed(JOINED[kind])


def test_encoded_lines_and_paths_stay_solid():
    own = random.Random(5)
    blob = "\n".join("".join(own.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=76)) for _ in range(60))
    paths = "\n".join(f"internal/{a}/{b}/{c}/store" for a, b, c in zip(some(60), some(60), some(60)))
    code = "\n".join(f"{a}->{b}({c});" for a, b, c in zip(some(60), some(60), some(60)))
    assert stuffing(blob)[0] == stuffing(paths)[0] == stuffing(code)[0] == 0
