"""Labelled spans for the personal-information tagger, composed from rules.

Names, numbers and addresses are made up; carrier sentences put them in and
out of context. Look-alikes that are no personal information (dates, lot and
order numbers, places, titles with a lone name) are part of the texts and stay
unlabelled. ``corpus`` adds unlabelled background: pieces of a bounded sample
of real texts, labelled by the same surface rules where they are certain.
"""

from __future__ import annotations

import random
import re

# Given names, from many languages.
GIVEN = """Adam Aisha Akira Alba Amara Ana Anders Anja Anna Ansel Astrid Ayako Beatriz Bela Benno Birgit Bram Bruno Carla Carmen Cem Chiara Clara Claire Colm Dagny Daniel Daria David Deniz Diego Dmitri Dora Edith Elena Elias
Emil Emma Emre Erik Eva Farah Felix Fiona Florian Freya Gerda Gianni Goran Greta Hana Hannah Hans Hassan Heidi Helena Hilde Hiro Hugo Ida Igor Ilse Imran Ines Ingrid Irena Isabel Ismael Ivan James Jana Jean Joana Johan John
Jonas Jorge Julia Karim Karin Kasper Katja Kenji Kofi Lars Laura Layla Leila Lena Leon Liam Lina Lotte Louis Lucia Luis Luka Maja Manuel Marco Maren Maria Marie Mark Marta Mary Mateo Max Mei Mia Milan Mina Mireille Mohamed
Nadia Naomi Natasha Nils Nina Noah Noemi Nora Olaf Olga Omar Oscar Owen Paula Pavel Peter Petra Pia Pieter Priya Rafael Raj Ravi Renata Robert Rosa Ruth Samir Sanna Sara Sarah Sofia Sonja Stefan Susan Sven Tamara Tariq
Thea Theo Thomas Tobias Tomas Ursula Uwe Vera Viktor Wanda Wei Yara Yasmin Yuki Yusuf Zoe Zora""".split()
# Parts that surnames are composed of.
STEMS = "Ander Aver Berg Black Brack Brandt Carl Dolv Eck Fair Fern Fisk Gold Grel Hall Harn Holm Hov Jask Jens Kess Kort Lam Lind Lund Mar Mer Merr Morv Nesk Nor Olm Orl Peder Plim Pol Pry Quil Ras Ros Rusk Sax Schmid Sund Stav Tan Tans Thor Tren Urb Vel Vosk Walt Wend Win Yel".split()
ENDS = "a adze aga arsky ault bury brook dóttir edze eira elli en enko ens er ero eros ez field hart ia ić ington ley mann mark mond moor more oğlu ova ova quist ski sen son ström szky ton vault wald wick".split()
# Particles of surnames, and whole surnames (also words of other use).
PARTICLES = "van|von|de|de la|del|da|di|dos|du|van der|Le|El|bin|al".split("|")
FAMILIES = "Smith Lane Do Young Street Gall Souza Cruz Beethoven Garcia March Wood Hill Fischer Rossi Dubois Park Church Day Long Brown King Nguyen Lopez Meyer Silva Moreau Jones Miller Costa".split()
GIVEN_WORDS = "Will Diane Ludwig Anh Juan Mark May April June Grace Hope Rose Art Bill Jan Faith Drew Marie Dawn Frank".split()
# Given and family names in other scripts, to be combined.
RUSSIAN = ("Иван Ольга Дмитрий Анна Сергей Мария Алексей Елена Павел Наталья Юрий Светлана".split(), "Петров Смирнова Кузнецов Волкова Соколов Морозова Лебедев Новикова Попов Орлова Зайцев".split())
GREEK = ("Γιώργος Ελένη Νίκος Μαρία Δημήτρης Κατερίνα Σπύρος".split(), "Παππάς Νικολάου Γεωργίου Δημητρίου Ιωάννου Αντωνίου".split())
ARABIC = ("محمد فاطمة أحمد ليلى يوسف مريم".split(), "حسن علي الخطيب منصور القاسم".split())
HEBREW = ("אברהם שרה דוד רחל יעקב".split(), "כהן לוי מזרחי פרידמן".split())
HINDI = ("राज प्रिया अमित सुनीता विजय".split(), "शर्मा सिंह वर्मा गुप्ता पटेल".split())
CHINESE = ("王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗郑", "小明伟芳娜敏静丽强磊军洋艳勇杰娟涛超秀英建国华平桂兰文玉志红霞明")
JAPANESE = ("佐藤 鈴木 高橋 田中 渡辺 伊藤 山本 中村 小林 加藤".split(), "太郎 花子 健太 美咲 翔太 陽子 大輔 直美".split())
THAI = ("สมชาย สมหญิง วิชัย มาลี".split(), "ใจดี สุขใจ ทองดี ศรีสุข".split())
# Parts of street addresses.
STREETS = "Alder Bellfounder Birch Castle Chapel Church Copperfield Elm Ferryman Garden Gooseberry Heron High Hill Juniper Kiln King Lantern Larch Maple Market Mill Millrace Mint Oak Old Orchard Park Quarry River Ropewalk Rose Saltern School Station Tannery Thistle Victoria Water Weaver West".split()
KINDS = "Street St. St Road Rd. Rd Avenue Ave Lane Ln Drive Dr Close Court Ct Terrace Blvd Boulevard Way Place Square Row Walk Crescent".split()
GERMAN = "Linden Erlen Birken Garten Gerber Reiher Lärchen Salz Mühl Schul Berg Haupt Bahnhof Ufer Wald Rosen".split()
GERMAN_KINDS = "straße strasse weg gasse platz allee ring str.".split()
FRENCH = "de la Tannerie|des Saules|du Moulin|du Moulin-Vieux|des Hérons|de la Gare|de l'Église|Victor Hugo|des Lilas|du Port|de la Fontaine".split("|")
FRENCH_KINDS = "rue avenue boulevard bd av. chemin place allée quai impasse route".split()
SPANISH_KINDS = "Calle|C/|Avenida|Avda.|Plaza|Paseo|Camino|Cl.|Rua|Via".split("|")
SPANISH = "Mayor|del Molino|de la Paz|de España|de las Flores|Viejo|del Curtidor|de la Garza|Salinas|del Puerto|de los Alerces|Real|de la Fuente|Cervantes|del Río".split("|")
TOWN_A = "Ard Bel Brin Cald Cor Dray Dun Eld Elm Fair Fen Gar Grim Harn Hol Ist Jor Kel Lor Mar Nor Os Pel Quin Ros Sel Tor Ul Ver Wil Yar Zel".split()
TOWN_B = "a am an bur by den fa ga gate han in lan lo ming mis nor ny o on ra ro sto ti ver wi".split()
TOWN_C = "borough bridge by cliff combe dale don field ford gate ham haven holm ley mere mouth port shaw stead ton well wick worth".split()
MAILS = "example.com example.org example.net mail.example post.example web.invalid inbox.test uni.example.org kidney-mail.example clinic.example my-mail.example.com".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
MONTHS = "January February March April May June July August September October November December".split()
DRUGS = "brenagliflozin Pelvanza Tormexxa quoradin Synpelvy Xitorma Brenoxa aspirin Metformin Lisinopril".split()

Piece = tuple[str, str]  # text, type ("" for none)


def town(r: random.Random) -> str:
    return r.choice(TOWN_A) + (r.choice(TOWN_B) if r.random() < 0.8 else "") + r.choice(TOWN_C)


def given(r: random.Random) -> str:
    g = r.choice(GIVEN)
    return f"{g}-{r.choice(GIVEN)}" if r.random() < 0.1 else g


def surname(r: random.Random) -> str:
    s = r.choice(STEMS) + r.choice(ENDS)
    return f"{s}-{r.choice(STEMS) + r.choice(ENDS)}" if r.random() < 0.03 else s


def name(r: random.Random) -> str:
    g, s = given(r), surname(r)
    y = r.random()
    if y < 0.02:
        return other_name(r, r.choice([RUSSIAN, RUSSIAN, GREEK, ARABIC, HEBREW, HINDI]))
    if y < 0.16:
        g = r.choice(GIVEN_WORDS) if r.random() < 0.5 else g
        s = r.choice(FAMILIES) if r.random() < 0.6 else s
    if 0.1 < y < 0.24:
        return f"{g} {r.choice(PARTICLES)} {s}"
    if y > 0.92:
        return f"{g} {s}".lower()
    x = r.random()
    out = f"{s}, {g}" if x < 0.15 else f"{g} {r.choice('ABCDEFGHJKLMNPRSTW')}. {s}" if x < 0.35 else f"{g} {s}"
    return out.upper() if r.random() < 0.1 else out


def other_name(r: random.Random, lists: tuple[list[str], list[str]]) -> str:
    a, b = r.choice(lists[0]), r.choice(lists[1])
    return f"{a} {b}" if r.random() < 0.8 else f"{b} {a}"


def chinese_name(r: random.Random) -> str:
    return r.choice(CHINESE[0]) + "".join(r.choice(CHINESE[1]) for _ in range(r.choice((1, 2, 2))))


def japanese_name(r: random.Random) -> str:
    return r.choice(JAPANESE[0]) + r.choice(("", "", " ")) + r.choice(JAPANESE[1])


def any_name(r: random.Random) -> str:
    """Two made-up words of any letters: for carriers that leave no doubt."""
    x = r.random()
    if x < 0.5:
        return name(r)
    word = lambda: "".join(r.choice("bcdfghjklmnprstvz") * (r.random() < 0.9) + r.choice("aeiouy") + r.choice(["", "", "n", "r", "l", "s", "ng", "th"]) for _ in range(r.randint(1, 3))).capitalize()
    parts = [word() for _ in range(r.choice((2, 2, 2, 3)))]
    out = " ".join(w if len(w) > 1 else w + "an" for w in parts)
    return out.lower() if x > 0.9 else out


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def spell(r: random.Random, form: str) -> str:
    """``form`` with a digit for each ``#``, one from 2 on for ``N``, a letter for ``L``."""
    return "".join(r.choice("0123456789") if c == "#" else r.choice("23456789") if c == "N" else r.choice("ABCDEFGHJKLMNPRSTWXYZ") if c == "L" else c for c in form)


# Forms of telephone numbers (see spell).
PHONES = """N##-N##-####|(N##) N##-####|(N##)N##-####|N##.N##.####|+1 N## N## ####|+1-N##-N##-####|+1N##N######|1-N##-N##-####|1N##N######|+1 (N##) N##-####|N##-555-####|(N##) 555-####|N##.555.####|1N##555####|+1 N## 555 ####
07### ######|07### ### ###|07#########|+44 7### ######|+44 7### ### ###|+447#########|020 7### ####|+44 20 #### ####|0161 ### ####|01### ######|07700 900###|+44 7700 900 ###
+49 N# ########|+49 N### ######|030/#######|030 ########|0171 #######|0171/#######|+49 30 #####-###|+49 (0)89 ######|+49N#########|089-######|0N### ######|+49 30 23125 ###|030/23125###|+493023125###
0# ## ## ## ##|0#########|+33 # ## ## ## ##|+33#########|0#.##.##.##.##|06 ## ## ## ##|01 99 00 ## ##|+33199 00####
+34 ### ### ###|+34#########|6## ### ###|9## ## ## ##|6## ## ## ##
1N#########|1N# #### ####|+86 1N# #### ####|+86 1N#########|010-########|0N##-#######
+91 N#### #####|+91-N#########|N#### #####|0N0-####-####|+81 N0-####-####|+66 N# ### ####|08N-###-####|+7 9## ###-##-##|8 (9##) ###-##-##|+7 (###) ###-##-##|+30 69# ### ####|+972 5#-###-####|+20 1## ### ####|+55 ## 9####-####|+31 6 ########|+41 79 ### ## ##|+43 664 #######|+61 4## ### ###|04## ### ###""".replace("\n", "|").split("|")
# Forms of identity and patient numbers that show what they are.
CLEAR_IDS = "###-##-####|9##-##-####|LL######L|LL ## ## ## L|QQ######L|QQ ## ## ## L|########L|########-L|X#######L|Y-#######-L|Z #######L|X########|Z ########".split("|")
# Forms that need a word beside them.
OTHER_IDS = "### ## ####|#########|###-###-####|### ### ####|##########|9## ## ####|9########|999 ### ####|999-###-####|999#######|#### #### ####|########|########|######|#######|L#########|## ###### L ###|# ## ## ## ### ### ##|###############|######19##########|####################|###-######|##-######|######/####|######-####|L-######|##.###.###-L|LL#######|## ## ######|###-###-### ##".split("|")


def phone(r: random.Random) -> str:
    return spell(r, r.choice(PHONES))


def id_number(r: random.Random) -> str:
    out = spell(r, r.choice(OTHER_IDS if r.random() < 0.6 else CLEAR_IDS))
    return f"{out[:-1]}X" if len(out) == 18 and out.isdigit() and r.random() < 0.3 else out


def clear_id(r: random.Random) -> str:
    return spell(r, r.choice(CLEAR_IDS))


def mail(r: random.Random) -> str:
    g, s = given(r).lower(), (r.choice(STEMS) + r.choice("a aga arsky ault bury brook eira elli enko ens ero eros hart ington ley mann moor more ova quist sen wick".split())).lower()
    g = re.sub(r"[^a-z-]", "", g)
    user = r.choice([f"{g}.{s}", f"{g}-{s}.{r.randint(1950, 2006)}", f"{g}_{s}", f"{s}_{g}", f"{g}+health", f"{g[0]}{s}{r.randint(1, 99)}", f"{s}{digits(r, 4)}"])
    host = r.choice(MAILS) if r.random() < 0.5 else "".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.randint(2, 9))) + r.choice([".com", ".com", ".org", ".net", ".de", ".fr", ".es", ".co.uk", ".io", ".edu", ".cn", ".ru", ".in", ".jp"])
    host = r.choice(["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "gmx.de", "web.de", "orange.fr", "mail.ru", "qq.com"]) if r.random() < 0.2 else host
    x = r.random()
    if x < 0.2:
        user = r.choice([f"{g}{digits(r, 2)}", "".join(r.choice("abcdefghijklmnoprstuvwxyz_.") for _ in range(r.randint(3, 10))).strip("._") + "a", f"{g}{s}", g, s, f"{g}.{s[0]}"])
    if x < 0.5:
        return f"{user}@{host}"
    if x < 0.58:
        return f"{user} @ {host}"
    at, dot = r.choice([(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), ("[at]", "[dot]"), (" (at) ", "."), (" at ", "."), ("(at)", "."), (" [at] ", "."), (" arroba ", " punto ")])
    if r.random() < 0.6:
        user = user.replace(".", dot)
    return f"{user}{at}{host.replace('.', dot)}"


def address(r: random.Random) -> str:
    n, t, zipc = r.randint(1, 399), town(r), digits(r, 5)
    x = r.random()
    if x < 0.55:
        street = f"{r.choice(['Old ', '', '', '']) + r.choice(STREETS)} {r.choice(KINDS)}"
        unit = r.choice(["", "", f"Apt {r.randint(1, 90)}, ", f"Unit {r.randint(1, 40)}, ", f"Flat {r.randint(1, 40)}, ", f"Suite {r.randint(1, 40)}, "])
        letter = r.choice(["", "", "a", "b", "c"])
        flat = f", Flat {r.randint(1, 40)}" if not unit and r.random() < 0.4 else ""
        tail = r.choice(["", f" {zipc}", f" QQ{r.randint(1, 20)} {r.randint(1, 9)}ZZ"])
        return f"{unit}{n}{letter} {street}{flat}, {t}{tail}"
    if x < 0.72:
        return f"{r.choice(GERMAN) + r.choice(GERMAN_KINDS)} {n}{r.choice(['', '', 'a'])}, {zipc} {t}"
    if x < 0.87:
        return f"{n}{r.choice(['', '', ' bis'])}{r.choice([' ', ', '])}{r.choice(FRENCH_KINDS)} {r.choice(FRENCH)}, {zipc} {t}"
    if x < 0.93:
        return f"{r.choice(SPANISH_KINDS)} {r.choice(SPANISH)} {n}, {zipc} {t}"
    place = r.choice("Berlin|München|Wien|Paris|Lyon|Madrid|Sevilla|London|Leeds|Boston|Austin, TX|Portland, OR|Chicago, IL|Dublin|Toronto".split("|"))
    own = surname(r)
    return r.choice([f"{n} {own} {r.choice(KINDS)}, {place} {zipc}", f"{own.lower().capitalize()}{r.choice(GERMAN_KINDS)} {n}, {zipc} {place}", f"{n} {r.choice(FRENCH_KINDS)} {own}, {zipc} {place}", f"{r.choice(SPANISH_KINDS)} {own} {n}, {zipc} {place}", f"{n} {own} {r.choice(KINDS)}, {place}", f"{n} {r.choice(STREETS)} {r.choice(KINDS)}, Apt {r.randint(1, 99)}, {place} {zipc}", f"{r.choice(GERMAN)}{r.choice(GERMAN_KINDS)} {n}, {place}"]).replace(" , ", ", ")


def chinese_address(r: random.Random) -> str:
    return r.choice("北京 上海 广州 杭州 成都".split()) + "市" + r.choice("中山 人民 解放 建设 和平 长江".split()) + r.choice("路街") + f"{r.randint(1, 399)}号" + r.choice(("", f"{r.randint(1, 30)}栋{r.randint(101, 909)}室"))


MAKERS = {"n": ("name", name), "p": ("phone", phone), "i": ("id_number", id_number), "e": ("email", mail), "a": ("address", address), "o": ("name", any_name), "k": ("id_number", clear_id), "cn": ("name", chinese_name), "jp": ("name", japanese_name), "ca": ("address", chinese_address)} | {k: ("name", lambda r, w=w: other_name(r, w)) for k, w in (("ru", RUSSIAN), ("gr", GREEK), ("ar", ARABIC), ("he", HEBREW), ("hi", HINDI), ("th", THAI))}

# Carrier sentences; {n} name, {p} phone, {i} id number, {e} email, {a} address; {t} town, {s} lone surname, {g} lone given name, {d} drug, {#k} k digits, {D} day, {M} month, {y} year.
CARRIERS = """Please ask for {n} at the desk, phone {p}.|My name is {n}, in case the clinic reads this.|I am {n} and I live at {a}.|We live at {a}, so the hospital is close.|Send the box to {n}, {a}, and I will pay.|They mailed it to {a} instead of my parents.
Contact: {e} / {p}.|Contact {n}, {p}.|Email me at {e} and I will forward it.|The report went to {e} by mistake.|write to {e}.|Mi correo es {e}, respondo por la noche.|Mon adresse est {a} si quelqu'un veut m'écrire.|Me llamo {n} y vivo en {a}.
Je m'appelle {n}, mon numéro est le {p}.|Ich heiße {n} und wohne in der {a}.|Ruf mich bitte an: {p}, abends geht es am besten.|Mein Name ist {n}.|SSN {i} was printed on the letter.|My NHS number is {i} and nobody finds me.|Patient no. {i} is what the wristband said.
The form still lists my number as {i}, which is wrong.|The nurse, {n}, told me to write down {i}.|My mother ({n}, born in spring) takes it too.|I saw Dr. {n} in the renal unit last week.|Has anyone seen Dr. {n} about this?|He signed as {n} and gave {a} as his home.
\n- {n}\n|Sincerely, {n}|Sincerely, {n} ({e})|Thanks, {n}|Call my wife at {p} or {p} if I do not answer.|You can text me on {p} after work.|Selling spare strips, text {p}|tel {p}|phone: {p}, mail: {e}|reach {n} on {p} or {e}|{n} from {t} wrote to me.|insurance no. {i}, {n}
{n} said the dose of {d} was fine.|my doctor {n} and her nurse {n} agree.|Mrs. {n} lives at {a}.|Herr {n} hat angerufen, Tel. {p}.|{e}|{n}|{k}|MRN {i}.|Deliver to: {n}, {a}. Phone {p}.
The trial is listed as TRX{#8} and the box says lot {#3}-{#2}-{#3}.|The trial is listed as TRX{#7} and the box says lot {#3}-{#1}-{#3}.|Order {#3}-{#3}-{#2} from the pharmacy app.|Ticket {y}-{#3}-{#2} is still open since {D}.|Version {#2}.{#2}.{#3}.{#1} of the app crashed @ {#1}:{#2}.
Ask u/strip_counter_{#2} or @renal_{#3} about it.|Dr. {s} said to wait.|Mrs. {s} vs. the clinic is a case.|Fabry Disease and Type Two are different things, Mister Mod.|Walking down Memory Lane here, {#2} years after the first dose.|The Green Heron Renal Unit in {t} has {#2} beds.|The Blue Lake Heart Center in {t} is full.
On {D} night I woke at {#1}:{#2} with chills.|Every {D} I get headaches.|Since {M} {#1} I take it with rice.|Around {M} {#1} my GP moved me from {d} to {d}.|Before {d} I used {d} for {#2} weeks.|The letter dated {#2} {M} {y} names {d}.|I started {d} on {y}-0{#1}-1{#1} after my aunt saw it.
The nurse counted {#2},{#3} reports in {y}.|See www.example.org/page.html?id={#3} for more.|J. R. {s} et al. describe fog in {#2} adults.|At {#2} mg I had chills; at {#3} mg more.|M. {s} et Mme {s} sont venus.|La Dra. {s} dice que no.|Dr. {s}建议换成{#2} mg的片剂。|Setzen Sie das Mittel ab.|Die Krankenkasse zahlt nichts.
I paid {#3} for {#2} tablets in {t}.|We drove {#2} miles to {t}.|My {D} in {t} was good, {g} helped.|{g} told me to rest.|My A1c went from {#1}.{#1} to {#1}.{#1}.|The C-peptide result of {#2}.{#2} came back on {D} at 1{#1}:{#2}.|My GP wrote it down.|Room {#3}, Floor {#1}.|Batch no. {#8}, exp {y}.|ISBN {#3}-{#1}-{#2}-{#6}.
My sugars went {#3}-{#3}-{#3} within three months.|My readings were {#3}-{#2}-{#3} and {#3}-{#3}-{#3} today.|Pressure {#3}/{#2}, then {#3}/{#2}.|Lot {#8}, box {#3}-{#2}-{#3}.|My {d} pen broke on {#2} {M} {y}, so I have none.|My visit in {t} is on {#1} {M} {y}, and until then I wait.|between {y}-0{#1}-1{#1} and {#2} {M}|from {#1} to {#2} {M} {y}|Send it to {n}, {a}, and I will pay the postage.|Send the kit to {n}, {a}.|{n}, {a}|Ship to: {n}, {a}|I live at {a} with {n}.|{n} und wohne in der {a}.
She gave {a} as home.|They moved to {a}.|Nach {#1} Tagen war es weg.|Über {#2} Nutzer berichten davon.|Gegen {#1}:{#2} Uhr war es gut.|Ich trinke {#1},{#1} Liter am Tag.|Ma glycémie restait à {#1},{#1} malgré {d}.|Gracias, mañana pregunto.|Overall, I was fine in {t}. Nobody asked about {d}.|Eventually, {t} Pharmacy closed. Going there again.|I will ask my endo in {t} about {d}.|in the {t} leaflet of {M} - a locum laughed about it in {t}|Patient no. {i}.|NHS number is {i}|SSN {i}
They mailed the box to {a} instead of my place.|The parcel went to {a} again.|Mail the letter to {a}.|They sent the kit to {a} by mistake.|The courier came to {a} twice.|bring it to {a} please|She signed as {n} and gave {a}.|return it to {n}, {a}.|My new address: {a}.|Ich wohne in der {a}.|Vivo en {a}.|J'habite au {a}.
{n} asked me to call {p}.|Dr. {n} said to call {p}.|I wrote to {e} and called {p}.|My mom, {n}, is fine.|{n} ({e})|ask {n} or {n} about it.
EDIT: thanks everyone, answered.|Type Two Diabetes Clinic.|Long Term Care Act {y}.|New Year in Old {t}.|United Kingdom and South Africa.|Prior Authorization Form {#4}.|It cost {#4} in {y}.|Nr. {#2} auf der Liste.|Im {#2}. Quartal {y} stieg es.|
谢谢大家的回复，今天好多了。|（这是我自己的经历，仅供参考。）|医生说：“先停药三天！”，后来好了。|我从{#1}月开始吃{d}，有点头晕。|薬を飲んでから眠れません。ありがとう。|ขอบคุณครับ กินยาแล้วดีขึ้น|Спасибо за ответ, мне стало лучше.|После {d} болит голова, это нормально?|Ευχαριστώ πολύ για την απάντηση.|شكرا جزيلا على الرد|मुझे अब बेहतर लग रहा है
Die Apotheke in {t} hatte es nicht.|Mir hat der Arzt in {t} {d} gegeben.|por la lluvia en {t} no fui|Tomo {d} por la noche.|« Revenez lundi », a dit la pharmacienne.|Next {D} I will ask.|After {d}, my brother had cramps.|{d}, however, did nothing.|{d} or {d}, that is the question.|Will {d} help me?|As always, I was late.|Do I need {d}?|In {t} the Dra. {s} was kind.|Severe nausea, {#2} days in.|an A1c of {#2}.{#1} after the {M} visit
My social security number is {i}.|my SSN: {i}|ssn {i}|social security no. {i}|NHS no {i}|NHS number: {i}.|national insurance number {i}|NI number {i}|My Aadhaar number is {i}|aadhaar {i}|passport no {i}|Passport number: {i}|health card number {i}|health insurance number {i}|Medicare number {i}|member ID {i}|insurance ID: {i}|hospital number {i}|patient ID {i}|Patient number: {i}|medical record number {i}|chart no. {i}|ID number {i}|ID: {i}
Meine Versichertennummer ist {i}.|Versicherungsnummer {i}|Sozialversicherungsnummer: {i}|Krankenversichertennummer {i}|Personalausweis {i}|Patientennummer {i}|numéro de sécurité sociale : {i}|Mon numéro de sécu est le {i}.|n° de sécurité sociale {i}|mon NIR est {i}|Mi DNI es {i}.|DNI {i}|NIE {i}|número de la seguridad social {i}|número de paciente {i}|codice fiscale {i}|BSN {i}|CPF {i}|身份证号{i}|我的身份证号码是{i}。|身份证：{i}|病历号{i}|医保号{i}|СНИЛС {i}|ИНН {i}|номер полиса {i}|마이 번호 {i}
call me on {p}|Call me at {p}.|my cell is {p}|My mobile: {p}|cell {p}|mob {p}|Phone {p}|phone number is {p}|text me at {p}, please|You can reach me at {p} any time.|whatsapp {p}|WhatsApp: {p}|ring {p} after six|his line is {p}|their line: {p}|{o} at the front desk, line {p}|{o} is on {p}|my husband {o} had the same|the bill names {o} instead of me|Je m'appelle {o} et je prends {d}.|They moved to {a} last summer.|fax {p}|Tel: {p}|T: {p}|my number is {p}|the clinic's number is {p}|dial {p}|her number {p} is wrong|Handy {p}|Meine Nummer ist {p}.|Telefon: {p}|Tel.: {p}|ruf an unter {p}|mon portable : {p}|Appelez-moi au {p}.|tél. {p}|téléphone {p}|mi teléfono es {p}|llámame al {p}|móvil {p}|tel. {p}|电话{p}|我的电话是{p}，谢谢。|手机号：{p}|联系电话 {p}|打{p}找我|微信同号{p}|電話番号は{p}です。|携帯 {p}|โทร {p}|телефон {p}|мой номер {p}|звоните {p}|τηλ. {p}|فون {p}|फोन {p}
i met {o} at the clinic yesterday|I spoke with {o} on the phone.|{o} told me to stop taking {d}.|nurse {o} was kind|Dr {o} changed my dose.|my name is {o}|My name's {o} and I'm new here.|I'm {o}, hello.|this is {o} writing|signed, {o}|Regards,\n{o}|Best,\n{o}|Cheers, {o}|- {o}|— {o}|thanks to {o} for the help|my neighbour {o} takes {d}|my husband {o} and I|my son {o}, aged {#1}|the surgeon was {o}.|ask for {o}|talk to {o} about it|{o} from billing called|Patient: {o}|Name: {o}|patient name {o}, dob {y}|prescribed by {o}|my pharmacist {o} said no|my endocrinologist, {o}, agreed|A friend, {o}, had the same.|they confused me with {o}
i am {o} and i live at {a}|i saw {o} again today and got {d}|yesterday {o} called me from {p}|Ich bin {o}.|Gestern hat mich {o} angerufen.|Frau {o} war nett.|Mein Arzt {o} sagt nein.|je suis {o}|Le docteur {o} m'a dit d'arrêter.|Soy {o}.|La doctora {o} me lo recetó.|mi médico {o} dice que sí|{o} schrieb mir.|{o} m'a écrit.|{o} me escribió.
我叫{cn}，今年{#2}岁。|医生{cn}说可以停药。|{cn}医生建议我换药。|我是{cn}。|昨天{cn}给我打电话了。|请找{cn}。|患者{cn}，男，{#2}岁。|我的朋友{cn}也吃{d}。|姓名：{cn}|护士{cn}很好。|联系人{cn}，电话{p}|我住在{ca}。|地址：{ca}|寄到{ca}，{cn}收。|{jp}と申します。|私の名前は{jp}です。|{jp}先生に相談しました。|担当の{jp}さんは親切でした。
Меня зовут {ru}.|Доктор {ru} сказал пить {d}.|Вчера {ru} звонила мне.|Моя соседка {ru} тоже принимает {d}.|С уважением, {ru}|Врач {ru} отменил {d}.|Пациент {ru}|Спросите {ru}.|{ru} посоветовал сдать анализы.|Με λένε {gr}.|Ο γιατρός {gr} είπε όχι.|Η {gr} με πήρε τηλέφωνο.|اسمي {ar}.|الطبيب {ar} قال لي|اتصلت بي {ar} أمس|שמי {he}.|ד״ר {he} אמר|मेरा नाम {hi} है।|डॉक्टर {hi} ने कहा|ผมชื่อ {th}|ฉันชื่อ {th} ค่ะ|คุณ {th} โทรมา|I saw Dr. {ru} today.|I saw Dr. {cn} today.|My doctor {gr} said no.|I met {cn} at the clinic.|{ru} told me so.
drop me a line: {e}|mail me: {e}|e-mail {e}|my email is {e} if anyone wants it|contact {e}|{e} is my address|send it to {e}, please|Schreib mir an {e}.|Meine Mail: {e}|écrivez-moi à {e}|mon mail : {e}|escríbeme a {e}|邮箱{e}|我的邮箱是{e}|почта {e}|メールは{e}です。
I live at {a}.|my address is {a}|ship it to {a} please|Address: {a}|home: {a}|I moved to {a} last {M}.|the clinic at {a} closed|Ich wohne {a}.|Adresse: {a}|J'habite {a}.|Vivo en {a}.|Mi dirección es {a}.|The pharmacy is at {a}.|we are at {a}, come by
I have taken {d} for {#4} days.|Order no. {#8} shipped.|Order {#3}-{#3}-{#4} arrived.|tracking {#12} says delivered|Batch {#6} was recalled.|Lot no. {#7}|Invoice {#6} is unpaid.|NDC {#5}-{#4}-{#2}|serial number {#9} of my pump|Trial NCT{#8} is open.|PMID {#8}|ref {#6}/{#2}|ISBN 978-{#1}-{#4}-{#4}-{#1}|model {#3}-{#4}|version {#1}.{#1}.{#4}|It said error {#6}.|The bill was {#1},{#3},{#3} rupees.|I weigh {#3} and {#3} before.|sugar {#3} {#3} {#3} in three days|{#3}, {#3}, {#3} and {#3} steps|My readings: {#3} {#2} {#2}|{#2}/{#2}/{y}|{y}/{#2}/{#2}|{#2}.{#2}.{y}|{#2}-{#2}-{y} is the date|{#2} {#2} {#2} {#2} are the doses|cost {#5}.{#2} in all|page {#3}-{#3}|between {#4} and {#4} units|IP 192.168.{#1}.{#2}
feeling better now thanks|i took it at night and slept fine|my doctor said no|his wife told me so|I was calm because nothing happened|Good Morning everyone|Happy New Year all|Blood Sugar Diary|World Health Organization|Food and Drug Administration|The New England Journal|Mayo Clinic says no|Johns Hopkins is far|St Mary Hospital is full|Los Angeles and San Diego|New York Times|Lake Superior Clinic|Vitamin Shoppe|Trader Joes|Green Tea and Black Coffee|Thank You So Much|Side Effects Of {d}|Dr. {s} and Nurse {g} were kind|{g} is my cat|Mr. {s} lives next door|my friend {g} said hi|Prof. {s} wrote it|i asked {g} about it|Hi {g}, thanks|Dear Dr. {s}, hello|ask @{#2}{g} or u/{g}_{s}|see r/{s}help|{s} v. {s}|the {s} study of {y}|{s} and {s} found it|{s} syndrome is rare|医生说没事。|王医生说没事。|李先生也吃这个药。|今天去了北京。|先生に聞きました。|Доктор сказал нет.|Москва большая.|Иван сказал да.|Ο γιατρός είπε.|سألت الطبيب|डॉक्टर ने कहा"""


def fill(r: random.Random, carrier: str) -> list[Piece]:
    out: list[Piece] = []
    for part in re.split(r"(\{[^}]*\})", carrier):
        if not (part.startswith("{") and part.endswith("}")):
            out.append((part, ""))
            continue
        k = part[1:-1]
        if k in MAKERS:
            kind, make = MAKERS[k]
            out.append((make(r), kind))
        elif k[0] == "#":
            out.append((digits(r, int(k[1:])), ""))
        else:
            out.append((str({"t": town, "s": surname, "g": given, "d": lambda x: x.choice(DRUGS), "D": lambda x: x.choice(DAYS), "M": lambda x: x.choice(MONTHS), "y": lambda x: x.randint(2001, 2025)}[k](r)), ""))
    return out


LIST = [c for line in CARRIERS.split("\n") for c in line.replace("\\n", "\n").split("|") if c.strip()]


def example(r: random.Random, background: list[str], words: int = 3) -> tuple[str, list[tuple[int, int, str]]]:
    """A text and its labelled spans."""
    parts: list[Piece] = []
    for _ in range(r.randint(1, words)):
        if background and r.random() < 0.45:
            parts.append((r.choice(background), ""))
        else:
            parts += fill(r, r.choice(LIST))
        parts.append((r.choice([" ", " ", " ", "\n", "\n\n"]), ""))
    text, spans = "", []
    for s, kind in parts:
        if kind:
            spans.append((len(text), len(text) + len(s), kind))
        text += s
    x = r.random()
    turned = text.upper() if x < 0.04 else text.swapcase() if x < 0.06 else text
    if 0.06 <= x < 0.1:
        turned = text.lower()
    if len(turned) == len(text):  # ß and the like would shift the labels
        text = turned
    return text, spans
