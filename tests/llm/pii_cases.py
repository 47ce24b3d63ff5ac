"""Hand-labelled sentences, written without the training texts' generator."""

# Each item: text, then its spans as (type, surface).
CASES = [
    ("You can text me on 212-867-5309 after lunch.", [("phone", "212-867-5309")]),
    ("For the records, SSN 123-45-6789 belongs to me.", [("id_number", "123-45-6789")]),
    ("My neighbour Nguyen Van Thanh takes the same pills.", [("name", "Nguyen Van Thanh")]),
    ("i talked to maren lindquist about the rash", [("name", "maren lindquist")]),
    ("Вчера доктор Иван Петров отменил таблетки.", [("name", "Иван Петров")]),
    ("我叫王小明，吃这个药三年了。", [("name", "王小明")]),
    ("Write to jane dot doe at gmail dot com if you have spare strips.", [("email", "jane dot doe at gmail dot com")]),
    ("Ich wohne in der Hauptstraße 5, 10115 Berlin.", [("address", "Hauptstraße 5, 10115 Berlin")]),
    ("我的手机是13812345678，晚上联系。", [("phone", "13812345678")]),
    ("Mon numéro de sécurité sociale est 1 84 12 75 108 042 36.", [("id_number", "1 84 12 75 108 042 36")]),
    ("Reach me at bob.keller@fastmail.com any evening.", [("email", "bob.keller@fastmail.com")]),
    ("The discharge letter went to priya_rao88@yahoo.in instead of my own mailbox.", [("email", "priya_rao88@yahoo.in")]),
    ("Dr. Susan Whitaker lowered my dose to five milligrams.", [("name", "Susan Whitaker")]),
    ("The pharmacist, Tom Hargreaves, was puzzled too.", [("name", "Tom Hargreaves")]),
    ("Call the night line at (617) 253-1000 when the fever climbs.", [("phone", "(617) 253-1000")]),
    ("My mobile is +44 7911 123456, leave a message.", [("phone", "+44 7911 123456")]),
    ("Meine Nummer ist 0171 2345678, bitte nur abends.", [("phone", "0171 2345678")]),
    ("Appelez-moi au 06 12 34 56 78 après le travail.", [("phone", "06 12 34 56 78")]),
    ("NHS number 943 476 5919 is on every letter they send.", [("id_number", "943 476 5919")]),
    ("My Aadhaar number 2345 6789 0123 was on the form.", [("id_number", "2345 6789 0123")]),
    ("Mi DNI es 12345678Z y no lo encuentran.", [("id_number", "12345678Z")]),
    ("They delivered the cooler to 742 Evergreen Terrace, Springfield 62704 by mistake.", [("address", "742 Evergreen Terrace, Springfield 62704")]),
    ("We moved to 18 Rosewood Avenue, Leeds last summer.", [("address", "18 Rosewood Avenue, Leeds")]),
    ("J'habite au 12 rue Lafayette, 75009 Paris.", [("address", "12 rue Lafayette, 75009 Paris")]),
    ("Vivo en Calle Serrano 21, 28001 Madrid.", [("address", "Calle Serrano 21, 28001 Madrid")]),
    ("Ship the pump to Flat 4, 27 Baker Street, London.", [("address", "Flat 4, 27 Baker Street, London")]),
    ("Patient: Olivia Martinez, seen twice in March.", [("name", "Olivia Martinez")]),
    ("Regards, Kwame Mensah", [("name", "Kwame Mensah")]),
    ("my husband lukas brandt had the same cramps", [("name", "lukas brandt")]),
    ("Frau Katharina Vogel hat mich gut beraten.", [("name", "Katharina Vogel")]),
    ("Je m'appelle Camille Laurent et je prends ce traitement.", [("name", "Camille Laurent")]),
    ("Soy Alejandro Romero, tengo diabetes desde niño.", [("name", "Alejandro Romero")]),
    ("医生陈志强说先停一周。", [("name", "陈志强")]),
    ("Меня зовут Ольга Соколова, мне сорок лет.", [("name", "Ольга Соколова")]),
    ("I phoned Ingeborg van der Meer about the refund.", [("name", "Ingeborg van der Meer")]),
    ("Ask Chidi Okafor at the front desk, his line is 301-496-4000.", [("name", "Chidi Okafor"), ("phone", "301-496-4000")]),
    ("Mail the form to hello(at)renalhelp(dot)org please.", [("email", "hello(at)renalhelp(dot)org")]),
    ("Contact me: sam [at] outlook [dot] com", [("email", "sam [at] outlook [dot] com")]),
    ("My medical record number 48210377 is misprinted.", [("id_number", "48210377")]),
    ("Her insurance ID: A123456789 expired.", [("id_number", "A123456789")]),
    ("我的身份证号是110101199003077758。", [("id_number", "110101199003077758")]),
    ("Ruf Jonas Wagner unter 030 90182 0 an.", [("name", "Jonas Wagner"), ("phone", "030 90182 0")]),
    ("My fasting sugar was 212 and 186 on two mornings.", []),
    ("On 2021-04-17 the nurse changed my patch.", []),
    ("The box says lot 4471-AB and expires 2026.", []),
    ("Order 5501234567 has not shipped yet.", []),
    ("Johns Hopkins Hospital has a long waiting list.", []),
    ("Dr. Whitaker said to wait another week.", []),
    ("I take Vitamin D and Omega Three every morning.", []),
    ("Nobody in Green Valley stocks this brand.", []),
    ("My A1c fell from 9.1 to 6.8 in six months.", []),
    ("Thanks everyone, that helped a lot.", []),
    ("See page 44 of the leaflet, then 3 of 10 patients had nausea.", []),
    ("The Mayo Clinic and the Food and Drug Administration disagree.", []),
    ("Happy Friday to all of you in Lower Saxony.", []),
    ("今天医生说没有问题，谢谢大家。", []),
    ("Сегодня мне стало намного лучше, спасибо.", []),
    ("Ich nehme seit Montag nur noch die halbe Dosis.", []),
    ("Trial NCT04512345 is still recruiting.", []),
    ("I was calm because nothing bad happened.", []),
]
