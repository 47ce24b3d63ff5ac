"""Word lists and hand-labelled units the boundary tagger is trained on."""

from __future__ import annotations

# Abbreviations that don't end a sentence before a capital (they stand before a name or noun).
TITLES = "Dr Mr Mrs Ms Mx Prof Rev St Sra Sr Dra Srta Mme Mlle Mgr Fr Hr Frl med Dipl Ing Bzgl bzgl Lic Don Dña Gen Col Capt Lt Sgt Hon डॉ श्री प्रो vgl Vgl sog".split()
# Abbreviations that stand before a number.
NUMBER_ABBREVIATIONS = "No Nos Nr Nrn núm Núm n.º no nº pág Pág págs pp p S Fig Figs Tab Abb Sect sect Sec sec Art art Abs Vol vol ch Chap chap cap Cap Eq eq approx Approx ca Ca env Env aprox Aprox ungef fl ver v".split()
# Other abbreviations; they end a sentence only before a capital that starts one.
ABBREVIATIONS = "al vs v.s e.g i.e i.v viz cf Cf etc resp yrs yr hrs hr wk wks mo mos mg ml kg lb lbs oz min sec max avg est incl excl dept univ Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Wed Thu Fri Sat Sun usw bzw ggf evtl inkl zzgl ex p.ex p.ej ej Ud Uds Vd Vds EE UU tel Tel ext Ext Inc Ltd Co Corp Jr Jr Sen tab tabl tbl subsp spp".split()
# German words before an ordinal number ("am 3. März").
ORDINAL_BEFORE = "am im vom zum beim der die das dem den des ab bis seit jeder jedem jeden ihr ihrem ihren mein meinem meinen unser unserem".split()
# Words before a letter that is no initial ("vitamin D.").
BEFORE_LETTER = "vitamin type hepatitis cystatin group plan appendix table exhibit class grade section option factor protein part step and or than do did am was level category influenza interferon".split()

#: Units by language; each entry is one unit. Headings and list entries have no language.
SEEDS: dict[str, list[str]] = {
    "heading": [
        "What the letter said", "Blood pressure vs. last spring", "Dose log: 20 mg and less", "Month 3 on the new plan", "Effects, June 2021", "Questions for the nurse", "Notes from a waiting room",
        "What I tried after 14 days", "Summary", "Diary of a slow week", "Results No. 3", "血压记录", "副作用について", "Nebenwirkungen", "Effets indésirables", "Efectos adversos", "खुराक का विवरण",
    ],
    "item": [
        "walking, 20 min.", "Is it rash or hives?", "Aspirin 100 mg, 7:30", "no grapefruit after 9:15", "call the desk about the form", "Sodium: 4.1", "Dry skin (day 9)", "Swimming, 45 min.", "Tired or dizzy?", "ask Dr. Holm", "Potassium: 3.9", "no coffee", "Sleep!", "take it with food, e.g. toast",
    ],
    "en": [
        "The doctor saw me at noon.", "I felt dizzy for three days.", "Did anyone else get a rash?", "It stopped after 4.5 weeks!", "Dr. Holm raised the dose to 20 mg.", "Mrs. Lark vs. the insurer was a long story about a bill.",
        "Take it with food, e.g. a slice of bread, no later than 9:15 p.m.", "I woke at 4:30 a.m.", "By 4:30 a.m. on day 12 the pain was gone.", "We got home at 6 p.m.", "No. 14 on the page was a cough, with 3.5% of reports.", "J. R. Tolver et al. describe a cough in 12 adults.", "A note by M. B. Gray is on page 3.", "P. Q. Orr asked for more.", "A. Smith called my sister.",
        "My nurse said: \"We can't tell yet.\"", "\"Wait a week. Then call me,\" the doctor said after reading my chart.", "'Not again!' was all my brother said about it.", "She wrote \"Was it the tea? Or the soup?\" on a note and left it there.", "Hmm... the pain came back after a week.", "So... it was the pills.",
        "The U.S. label lists a cough; the E.U. text lists a rash.", "He lives in the U.S. now and takes nothing.", "See www.example.org/page.html?id=9 for the details.", "App version 4.12.7.1 crashed @ 9:12.", "(The sodium was repeated on May 4.)", "(It went well.)", "pH was 7.2 and ketones were 1.3 mmol/l at 9:30.", "eGFR fell to 54.2 ml/min, which no one had expected in May.", "C-peptide was low.", "mRNA levels were fine.",
        "The man (aged 54 yrs., 80.5 kg) reported hives!", "A rate of .50 per year, or 12.5 per 1.000 in the old notation, was given.", "Was it the salt, the stress, etc., or simply age?!", "About approx. 30 people, i.e. 4%, had a headache.", "The dose went from 2.5 mg to 5 mg (see Fig. 3 and Tab. 12).", "They dropped it from sect. 4.8.", "I take vitamin D.", "It was worse on 2021-03-04.", "The next visit is on May 12.", "I paid 30 dollars in 2019.", "My result was 6.1.", "Everyone said it was fine, so did I.", "They moved to St. Albans.", "I saw Prof. Hale, who agreed.",
        "That was plan B.", "Why me?", "Never mind.", "The thread quoted \"stop it. Now.\" and nothing else.", "My type is 2.", "On Monday I felt better (at last).", "Ask u/some_user_3 or @renal about it.", "Most cases, 80%, were mild.", "The clinic - a small one - closed at 5:30.", "At 10mg I slept; at 20mg I did not.", "I weigh 140 lb.", "He had 3 tablets left at 23 min.", "We walked 5 km.", "Word list: and the of to in day.", "Mild signs, like itching.",
    ],
    "de": [
        "Der Arzt hat mich um 9:30 Uhr gesehen.", "Am 3. März war der Wert bei 4,5 und damit höher als im Vorjahr.", "Im 2. Quartal 2014 stieg der Wert auf 8,1 mg/dl.", "Seit ca. 5 Wochen nehme ich das Mittel, d. h. 20 mg am Abend.", "Die Kasse zahlt z. B. nur 30% der Kosten!", "Bzgl. der Kosten hat mir niemand geantwortet.", "Hat jemand nach 3 Tagen auch Kopfweh bekommen?", "Mein Bruder fragte: „Muss das sein?“ und ging.", "„Warten Sie ab. Ruhig.“, sagte die Ärztin.", "Meine Ärztin, Dr. med. Holm, ist zufrieden.", "Er legte die Packung Nr. 4 zurück.", "Die Übelkeit war nach 5 Tagen weg.", "Sie sagte: „Alles gut.“", "Das war 2014.", "Ich schlafe gut, aber zu kurz.", "Vgl. Tab. 3 im Heft.", "Wir sehen uns usw. nächste Woche.", "Mein Wert war 12.", "Größere Sorgen habe ich nicht.", "Über 40 Nutzer schreiben davon.",
    ],
    "fr": [
        "Le médecin m'a vu à midi.", "Quelle douleur depuis lundi !", "Est-ce que quelqu'un a eu mal après 3 semaines ?", "Mon frère répète « Ça ira ! » et part au travail.", "« Attendez un peu. Revenez demain », a dit le médecin.", "M. Holm et Mme Lark ont signalé un malaise dès le 4 mai.", "Je prends ce comprimé depuis env. 30 jours, à raison de 20 mg.", "Ma valeur est à 4,5 mg/dl, cf. le tableau no 7 du carnet.", "Le Dr Holm pense que l'étude p. ex. de 2014 ne compte pas.", "J'ai perdu 3,5 kg en 4 semaines.", "La pharmacie n'avait plus rien.", "Elle a dit : « Tout va bien. »", "À 9:30, c'était fini.", "Il est parti en 2012.", "Dr. Holm est absent.", "Voilà... rien de neuf.",
    ],
    "es": [
        "El médico me vio a las 9:30.", "¿Alguien más tuvo dolor después de 3 días?", "¡Qué alivio cuando bajó a 120!", "Según la hoja, pág. 12, aparece en 30% de los casos.", "La Dra. Holm dice que es normal, p. ej. por el calor.", "El Sr. Lark perdió 3,5 kg en 4 semanas.", "¿Es mejor tomarla con agua o, como dice Ud., sin ella?", "«Espere un poco. Vuelva el martes», me dijo el doctor.", "Mañana tengo cita en el núm. 8 de la calle.", "Mi valor subió al 4,5 %, aprox. 20 puntos más que en 2014.", "Llevo 5 semanas con la dosis de 20 mg.", "Ella dijo: «Todo bien.»", "No sé.", "Fue en 2012.", "¡No!",
    ],
    "zh": [
        "医生让我停药三天。", "有人也头晕吗？", "下降得真快！", "你会在意它从5.1掉到3.2吗？！", "医生说：“先等等。明天再来。”然后就走了。", "他问：“是不是感冒？”我也不清楚。", "（这只是我的看法。）", "说明书第3.5节写着：“如有不适，请停药！”，我没看到。", "老实说……这比我想的难。", "发生率是3.5%（只有20人）。", "Dr. Holm建议换成20 mg的片剂。", "昨天9:30我有点心慌，血压是120/80。", "我住的小城只有3家药房；最近的一家也要走20分钟。", "换药之后好多了。", "“好。”她说。", "母亲每天走5公里，体重还是50.5公斤左右。", "eGFR没有变化。",
    ],
    "ja": [
        "医者に三日休むように言われた。", "同じ症状の方はいますか？", "本当に驚いた！", "母は「水を飲みなさい！」と言う。", "先生に「すぐやめてください。また来てください。」と言われた。", "「様子を見ましょう」とだけ言って、診察は終わった。", "ええと……まだ分かりません。", "風邪かな？と思って、説明書（第3版）を読んだ。", "v3.12のアプリで記録すると、平均は5.1でした。", "薬局では10 mgが在庫切れです。", "朝7:30に飲むと、眠くなります。", "Aspirinを飲み始めて5日目に、めまいが出ました。", "（これは個人の感想です。）", "体重が5.5キロも減った！",
    ],
    "hi": [
        "डॉक्टर ने मुझे देखा।", "क्या किसी और को भी चक्कर आए?", "रात 4:25 बजे पसीना आया!", "उसने कहा, \"अभी रुको। कल आना।\" और चला गया।", "डॉ. Holm ने कहा कि खुराक 20 mg ही रहेगी।", "मेरी शुगर 5.5 से 6.1 हो गई।", "क्या यह aspirin की वजह से है या गर्मी की?", "मैं 5 दिन से दवा ले रहा हूँ।", "दुकान में 4 गोलियाँ थीं।", "मान 3.5 mg/dl था, जो पिछले साल से कम है।", "aspirin से मुझे नींद आती है।",
    ],
    "th": [
        "เมื่อวานนอนไม่หลับ", "ฉันกินยามา5วันแล้ว", "มีใครปวดหัวเหมือนกันไหม", "ค่าของแม่อยู่ที่5.1เมื่อวาน", "หมอบอกว่าให้ลดเหลือ20มิลลิกรัม", "น้ำหนักหายไป3กิโล", "ฉันกินยาaspirinมา9วันแล้ว", "เมื่อคืนตื่นตอน4:30",
    ],
}
