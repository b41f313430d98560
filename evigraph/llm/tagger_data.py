"""Labelled spans for the character tagger: texts made from parts, every span known.

Nothing here is taken from a table the tagger is meant to read. Sentences are put together from
general office and software language; half of all names are composed of random syllables, and
ordinary words are replaced by made-up ones now and then, so that shape and context must carry
the decision. Plain sentences hold look-alikes: product and place names, weekdays, classes,
ticket, version and batch numbers, hosts, digests and dates.

``Maker(seed)`` draws texts; ``Maker(seed, "held")`` draws from names, streets, hosts and
sentences that the other never uses.
"""

from __future__ import annotations

import random
import string
import unicodedata
from collections.abc import Callable

Span = tuple[str, str]

# Common given and family names of several languages.
GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas
Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret Donald Ashley Steven Kimberly Andrew Emily
Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Timothy Stephanie Hans Greta Jürgen Ursula Klaus
Sabine Wolfgang Heike Dieter Birgit Pierre Camille Jacques Élodie Luc Margaux Étienne Solène Giovanni Francesca Luca Chiara Carlos
Lucía Javier Carmen Miguel Sofía Anders Astrid Bjarne Freja Piotr Agnieszka Krzysztof Zofia Ivan Natasha Sergei Olga Mehmet Ayşe
Hiroshi Yuki Takeshi Sakura Wei Mei Rajesh Priyanka Arjun Deepa Kwame Abena Chidi Ngozi Fatima Hassan Leila Omar Anna Noor Émile Zoé Rosa""".split()
FAMILY = """Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Wilson Anderson Taylor Moore Jackson
Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell
Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Bauer Dubois Moreau Laurent Lefèvre Roux Fournier Girard Bonnet
Rossi Russo Ferrari Esposito Bianchi Romano Fernández González Muñoz Ibáñez Ortega Hansen Johansen Lindberg Nyström Eriksson Kowalski
Nowak Wiśniewski Zieliński Petrov Ivanov Sokolov Popescu Yılmaz Demir Tanaka Suzuki Watanabe Nguyen Tran Patel Sharma Mensah Okafor
Haddad O'Brien O'Connor McDonald MacLeod""".split()
HELD_GIVEN = "Walter Beatrice Roland Hedwig Gaspard Ottilie Benedikt Marguerite Sigrid Tomasz Renata Horacio Yolanda Ravi Imani Kofi Aurélie Dagmar Leopold Philippa Cedric Winifred".split()
HELD_FAMILY = "Abernathy Blackwood Castellano Dumont Engström Fitzgerald Grünewald Hargreaves Iversen Jankowski Kirchner Lombardi Montague Nakamura Oyelaran Pemberton Quesada Rutherford Stavros Thibault Vasquez Whitlock Zimmermann".split()
_ON = "b br c ch d dr f fl g gr h j k kl l m n p ph qu r s sch sh st t th tr v w wh y z".split()
_NUCLEUS = "a e i o u a e i o ai ea ee ei ia ie io oa oe ou ö ü é".split()
_END = "l n r s t m nd ng ck rd rt lt st ld ll rn x th".split()
_SUFFIX = "son sen man mann berg stein field ford ton ham wood well ley worth by wick ski sky ov ova ez es elli ini ino escu dottir ander ström quist lund dal vik mark ard eau ier ou moor gate shaw combe mere land hoff huber bach vast var".split()
STREET = "High Church Park Victoria Green Manor Kings Queens Springfield York Windsor Grange Mill Chestnut Elm Pine Oak Washington Lincoln Jefferson Franklin Sunset Lakeview Hillcrest Juniper Magnolia Birch Walnut".split()
HELD_STREET = "Primrose Rosewood Heather Ferndale Beechwood Stonegate".split()
TOWN = ["Springdale", "Riverton", "Milltown", "Oakham", "Fairview", "Bristol", "Salem", "Madison", "Clinton", "Georgetown", "New Haven", "Bad Homburg", "Saint Malo", "Cedar Falls", "Long Beach", "Upper Marlow", "Kiel", "Rouen", "Lyon", "Graz"]
HOSTS = "mail company office inbox post webmail firm studio uni campus clinic shop bank letter corp".split()
TLDS = "com org net de fr jp io eu co.uk example test invalid info".split()
NOUN = """report invoice printer laptop budget calendar meeting server database password account contract project deadline order
shipment warehouse customer ticket release branch build test deployment backup index query table column schema view key cache queue
worker thread session cookie token user role permission group folder file document page form button field menu screen dialog list
map graph node edge path route endpoint request response header payload message event log trace metric alert dashboard chart
snapshot version change patch rule policy filter sort join merge split copy export import migration rollout schedule job task step
stage template layout theme icon image link anchor label note comment review approval claim catalog ledger registry adapter
handler controller service module library package plugin driver proxy gateway router balancer monitor collector importer exporter
resolver mapper parser writer reader viewer editor builder runner planner checker toggle flag variant fragment span cursor digest
fingerprint manifest envelope literal constraint trigger transition sequence statement matrix board topic sprint backlog""".split()
ADJ = """new old big small late early broken empty full local remote shared private public daily weekly monthly final first second
missing wrong right slow fast heavy light red green blue manual automatic optional required nested flat stale fresh hidden visible
pending closed open locked free busy unknown known primary secondary global partial complete duplicate unique valid invalid typed
masked merged indexed deferred recursive generic foreign verbose""".split()
VERB = """checks reads writes sends opens closes moves copies finds loses keeps drops adds removes updates deletes creates builds breaks
fixes starts stops blocks hides shows counts lists sorts groups splits merges joins links marks reports rejects accepts renders
validates replaces ignores imports exports stores skips""".split()
TEAM = "Sales Marketing Finance Legal Support Operations Security Research Design Logistics Procurement Compliance Engineering Payroll".split()
BRAND = """Blue Silver Golden Crystal Rapid Bright Solar Lunar Polar Alpine Pacific Atlantic Northern Southern Eagle Falcon Tiger River
Mountain Forest Ocean Thunder Copper Granite Maple Willow Amber Velvet Central Grand Royal Iron Quiet Main Marble Cloud Storm Garden
Cedar Lantern Harbor Bridge Delta Orbit Canyon Summit Meadow Apollo Titan Phoenix Zephyr Nova Vega Pegasus Hydra Comet Nebula
Aurora Saturn Neptune Jupiter Mercury Otter Badger Heron Raven Lynx Panther Bison Cobra Marigold Tulip Orchid Lotus Clover Fern Ivy
North South East West High Low Upper Old New First Second Prime Core Open Smart Live Fast Deep Clear Pure True Red Green White Black""".split()
HEADS = "Theme Palette Mode Gateway Board Service Suite Platform Edition Studio Portal Project Program Tower Bridge Station Dashboard Index Street Harbor Center Report Budget Manager Viewer".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December".split()
PLACES = "London Paris Berlin Madrid Tokyo Boston Chicago Vienna Zurich Oslo Dublin Lisbon Warsaw Prague Munich Hamburg Marseille Kyoto Osaka".split()
TEAM += "Accounting Hosting Staging Monitoring Onboarding Training Testing Shipping Billing Planning Hiring Backend Frontend Analytics Helpdesk Catalog Storage Network".split()
LEADS = "Yesterday Today Tomorrow Now Then Later Perhaps Maybe Also Sometimes Finally Meanwhile Afterwards Soon Often Still Once Again Luckily Usually Recently Later Yet However Therefore Indeed Clearly Sadly Apparently".split()
COMMON = """the a an this that these those my our your his her their some any each every no of in on at by for with from to into over under about
after before during since until and or but so because if when while where who which what how why is are was were be been has have had do
does did will would can could may might must should not only just also very too more most less few many much other same such than then
there here now again always never often soon still already yet asked called came went said told gave took made met saw knew helped wrote
visited invited booked ordered bought sold paid signed sent brought moved stayed worked started stopped waited answered agreed refused
neighbour friend doctor teacher driver guest visitor colleague cousin uncle brother sister mother father nurse clerk tenant child room
table house garden school hospital lunch dinner party trip train car key letter parcel book photo story question idea plan week month year
people thing place side hand part time day night morning evening water music market street town country""".split()
DE_COMMON = """der die das den dem des ein eine einen einem und oder aber weil wenn bevor nach vor mit ohne für gegen über unter zwischen ist sind war wird
werden hat haben nicht nie immer wieder jede jeder alle keine noch schon sehr auch nur hier dort dann später neu alt gut prüft zeigt sperrt meldet
sammelt ersetzt schreibt liest löscht bleibt fehlt wartet beginnt endet kommt geht steht liegt gilt folgt""".split()
DE_NOUN = """Rechnung Lieferung Sitzung Anfrage Antwort Bestellung Prüfung Freigabe Übersicht Tabelle Spalte Ansicht Vorlage Meldung Warteschlange Schnittstelle Zuordnung Kante Quelle Abfrage Auswertung Buchung Besprechung Verwaltung Ablauf Anlage Ausgabe Auftrag
Bericht Bestand Blatt Datei Dienst Drucker Eingabe Eintrag Ergebnis Fehler Feld Gruppe Haus Kiste Konto Lager Lauf Leitung Liste Menge Monat Morgen Abend
Muster Nachricht Ordner Paket Plan Projekt Punkt Raum Regel Reihe Rolle Schlüssel Schritt Seite Speicher Stelle Stunde System Tag Team Teil Termin Titel
Umgebung Verbindung Verlauf Version Vertrag Verzeichnis Vorgang Woche Zahl Zeile Zeit Ziel Zugang Zustand Zweig Änderung Öffnung Übung""".split()
_DE_FIRST = """Ab An Auf Aus Bei Ein Nach Rück Über Um Unter Ver Vor Zu Arbeits Daten Eigen Fach Farb Grund Hand Haupt Moment Jahres Kosten Lade Markt Netz Papier
Preis Rechts Sach Sicht Sitz Speicher Sprach Stand Steuer Tages Umsatz Verkehrs Wagen Wasser Zahl Zeit Zwischen""".split()
_DE_LAST = """frage fragen nahme aufnahme gabe lage stellung führung nung schrift wahl zeile punkt satz teil plan werk zeug blatt stück fall gang halt weg raum zahl lauf
bestand prüfung meldung ordnung bindung leitung folge ebene grenze stufe menge dauer summe""".split()
DE_ADJ = "neue alte offene letzte erste fehlende doppelte gültige veraltete geprüfte lange kurze".split()
FR_NOUN = "facture livraison réunion demande réponse commande table colonne vue page requête règle clé trace étape version liste file".split()
JA_NOUN = "会議 資料 予算 請求 発注 画面 設定 更新 削除 検索 登録 通知 権限 認証 履歴 項目 一覧 接続 差分 仕様 案件 課題 監査 観測 遷移 証跡 担当 予定 部署 倉庫 製品 在庫 試験 結果 報告".split()
JA_FAMILY = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 清水 山崎 池田 橋本 阿部 石川 前田 藤田 後藤 岡田 長谷川 村上 近藤 石井 坂本 遠藤 青木 藤井 西村 福田 太田 三浦 岡本".split()
JA_GIVEN = "翔太 健一 誠 大輔 直樹 美咲 陽子 恵子 由美 愛 拓也 達也 和夫 幸子 智子 裕子 亮 真由美 香織 健太 優子 浩二 明美 隆".split()
HELD_JA_FAMILY, HELD_JA_GIVEN = "桐生 水無瀬 東雲 久我山 結城 白鳥沢".split(), "琴音 蒼介 雅彦 千鶴 遥香 修平".split()
_JA_NAME = "風霧虹雪月朝星雲花水桜白青夜千見島村代影露宮野森沢原庭峰柳空鳥川台崎田山木松竹梅藤桐沼谷岡坂浜江戸倉条城塚"
_JA_FIRST = "結大小美千蓮陽彩悠真直葵樹春波尋太向花斗央人子奈菜香介輔郎也希紗里沙莉緒"
JA_PREF, JA_CITY, JA_TOWN = "東西南北中上下大小高青白赤黒金銀空風虚幻架仮想星", "緑光風星雲朝夕海山川橋浜松竹", "本中上下東西南北元新泉栄旭若白花月霧"
FIELDS = "note message text memo remark summary subject detail info log error reason title content reply question answer description comments".split()
PERSON_KEYS = "owner author reviewer editor customer client contact manager assignee requester approver reporter sender recipient employee patient tenant buyer seller signer name user.name display_name fullName contactName approved_by requested.by signedBy".split()
PHONE_KEYS = "phone tel mobile fax telephone cell hotline callback phoneNumber contact.phone sms caller whatsapp".split()
MAIL_KEYS = "email mail e-mail replyTo sender recipient login principal user.email mailto account contact".split()
PLACE_KEYS = "address addr location shipTo billTo street residence deliveryAddress home office".split()

# What surrounds one or two items; {N} a name, {M} one with capitals, {F} a family name after a title, {E} e-mail, {P} phone, {A} address, {I} number
# with its label, {t} a thing, {d} a day, {n} a count. Grouped by language.
PEOPLE = """{N} {did} the {t} {when}.|{N} has {done} the {t} and left.|I met {N} at the {t} {when}.|We asked {N} to {do} the {t}.|{N} and {N} will {do} the {t}.|
The {t} was {done} by {N}.|According to {N}, the {t} is {a}.|{N}, who {did} the {t}, is on leave.|Dear {N}, the {t} is ready.|Hi {N}, could you {do} the {t}?|Kind regards, {N}|Best wishes, {N}|
Cheers - {N}|Assigned to {N} {when}.|Please forward the {t} to {N}.|Talk to {N} or {N} about the {t}.|{N} wrote: the {t} is {a}.|{N} thinks the {t} {v} the {t}.|{N}'s {t} is {a}.|Please ring {N} at {P} {when}.|
You can reach {N} via {P} or {E}.|{N} <{E}>|{N} ({E})|{N} ({P}) {did} the {t}.|{N} [{E}; {P}] wants the {t}.|from {N} to {N}|To: {N}; Cc: {N}|seen by {N}, {d}|{N}: please {do} the {t}|{title} {F} {did} the {t} {when}.|
Ask {title} {F} about the {t}.|A call from {title} {F}; {they} will {do} the {t}.|Dear {title} {F}, the {t} is late.|phone {P}, {title} {F} answers|{title} {F} and {title} {F} agree.|{N} lives at {A} now.|{N} relocated from {A} to {A}.|
Relocate {N} from {A} into the {t}.|The desk of {N} is at {A}.|{key}: {N}|{key}={N}|{key} = {N}; {pkey}={P}|{key}: {N}, {P}|{key}: {N} / {E}|approved: {N}|Signed, {N}|-- {N}|thank you, {N}|The {t} belongs to {N}.|Welcome {N} to the {t} team.|
Only {N} knows the {t}.|Is {N} still in {place}?|We saw {N} with the {t}.|Invoice for {N}, {A}|{N} opened the {t}, then {N} closed it.|{I} belongs to {N}.|{N} confirmed {I} over the phone.|{I}, checked with {N} at the desk.|
copy to {N} {E}|{N} was asked to {do} the {t}.|{N} reports that the {t} {v} when {N} {v} it.|
{w} {w} {M} {w} {w}|{w} {w} {w} {M}.|{w} {M} {w} {w} {w} {w}|{w} {M} {w} {M} {w}.|{lead} {M} {w} {w} the {t}.|{lead} {M} {did} it.|{W} {w} {M} {w} {w} {d}.|The {w} with {M} was {w} to {d}.|{lead}, {M} {w} {w} {w}.|{W} {w} {title} {F} {w} {w}.|{w} {P}, {w} {w} {title} {F}|{w} {w} {w} {title} {F}|{W} {w} {title} {F}|{lead} {w} {title} {F} and {M} {w} {w}.|{key}: {N}|{key}: {N}|{w} {w} {w} -- {M}|{w}, {M}|{M} {w} {w} {w} {d}.|{M} {w} {w} the {t}.|
{W} {w} {M} {w} {A}.|{W} {M} {w} {P}.|{w} {w} {M}, {w} {w}|{w} {M} {w} {E} {w}.""".replace("\n", "").split("|")
THINGS = """Call {P} {when}.|Phone: {P}|Tel. {P}|Reach us at {P} or {E}.|The number {P} is {a}.|{pkey}: {P}|{pkey}={P}|fax {P}, mail {E}|dial {P} for the {t}|text {P}|Write to {E} {when}.|Send the {t} to {E}.|{mkey}: {E}|{mkey}={E}|
The account {E} was {done}.|{E} {did} the {t}.|Message for {E} came back.|Delivery to {E} failed {n} times; check the {t}.|{E} is locked after {n} tries.|{E} signed in.|Someone gave {E} as the address for the {t}.|Subscribe {E} to the {t}.|Deliver it to {A} {when}.|
The {t} goes to {A}.|{akey}: {A}|{akey}={A}|Parcel for {A} is {a}.|Their office at {A} is {a}.|{A} is the former address of the {t}.|Living at {A} since {n} years|The team went to {A}, and letters go to {E} since.|Send the badge to {A} {when}.|The page still has {A} for the {t}.|
Customer stated {I} while the {t} was {a}.|Field held {I} in the open.|They typed {I} into the {t}.|here is my {I}.|{I} was found in the {t}|{w} {w} {P} {w} {w}|{W} {w} {E} {w} {w}.|{w} {w} {A} {w} {w}|{w} {I} {w} {w}.|{w} {P}|{A}|{P}|{E}|{W} {w} {I} {w} the {t} {w} {w}.|{w} {w} {w} {I} {w} {M} {w} {w}.|{W} {w} {A}, {w} {w} {w} {E} {w}.|User mailed {I}.|the record carries {I}|{I}""".replace("\n", "").split("|")
GERMAN = """{N} hat die {g} geprüft.|Bitte rufen Sie {N} unter {P} zurück.|Termin mit {N} am Montag.|Mit {N} wegen der {g} sprechen.|Kontakt: {N}, {P}|{N} anrufen ({P}), wenn die {g} da ist.|Frau {F} wartet auf die {g}.|Herr {F} hat die {g} bestätigt.|
Kollegin {N} kennt die {g}.|Unser Kunde {N} zieht um: {D}.|Die Mieterin {N} wohnt seit Mai in der {D}.|Paket an {D} senden.|Adresse: {D}|Die {g} geht an {D}.|Fragen bitte an {E}.|Mail an {E} kam zurück.|{J}, genannt von Frau {F}.|Herr {F} nannte {J}.|Mit freundlichen Grüßen, {N}|
Ansprechpartnerin ist {N}.|Zuständig: {N}|{G} {M} {u} {u} {g}.|{u} {u} {M} {u} {u}|{G} {g} {u} {u} {M} {u}.|{G} {u} Herrn {F} {u} {g}.|{G} {g} {u} {D} {u}.|{u} {P} {u} {g}|{G} {M} und {M} {u} {u} {g}.""".replace("\n", "").split("|")
FRENCH = """{N} a relu la {f}.|Merci de joindre {N} au {P} demain.|Appeler {N} au {P} avant midi.|Réunion avec {N} mardi.|Madame {F} attend la {f}.|M. {F} a signé la {f}.|Mme {F} demande la {f}.|Contact : {N}, {P}|Adresse : {R}.|Envoyer la {f} au {R}.|Colis pour le {R}.|
Répondre à {E} ce soir.|Le message pour {E} est revenu.|Mme {F} a transmis {K}.|M. {F} a communiqué {K}.|Cordialement, {N}|{K} noté dans la {f}.|{N} habite au {R}.""".replace("\n", "").split("|")
JAPANESE = """{Y}さんが{j}を確認しました。|{Y}さんに{j}を依頼した。|{Y}様より{j}の連絡。|{y}様の{H}を受領。|{y}さんの{H}が{j}にある。|責任者：{Y}|連絡者：{Y}、{Q}|氏名：{Y}|{Y}（{Q}）|電話は{Q}です。|{j}の問い合わせは{Q}まで。|{Y}さんからの着信（{Q}）。|メール：{E}|{E}に{j}を送ってください。|
返信先は{E}です。|住所：{L}|{L}に{j}を届ける。|配送先は{L}です。|{Y}が{j}を登録。|{y}部長と{j}の打合せ。|作成者 {Y}""".replace("\n", "").split("|")
HELD = """Around dusk {N} repaired the bicycle.|Nobody except {N} understood the recipe.|Dinner alongside {N} slipped past {d}.|Reminder: {N} needs spectacles.|We congratulate {N} heartily.|Unless {N} objects, {N} chairs the panel.|
Whenever {title} {F} phones, jot that down.|A paramedic claimed {N} had fainted twice.|Across the hallway {N} tuned a violin.|Kindly hand the umbrella over to {N}, {A}.|Scribble to {E} otherwise dial {P}.|Twins of {N} grew up near {A}.|Grandma handed {I} across the counter.|
{N} reserved seats.|Vorgestern hat {N} Kuchen gebacken.|Ce soir {N} chante avec {N}.|{Y}さんは笑った。|A choir featuring {N} performed.|Painted by {N}, framed by {N}.|Rumour says {N} quit.""".replace("\n", "").split("|")


def _ascii(s: str) -> str:
    """A word as it stands in a mail address."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if c.isascii() and c not in " '") or "x"


class Maker:
    """Draws texts as lists of (piece, label)."""

    def __init__(self, seed: int, part: str = "train") -> None:
        self.r = random.Random(seed)
        self.held = part == "held"

    def one(self, xs: list[str] | str) -> str:
        return self.r.choice(xs)

    def digits(self, shape: str) -> str:
        return "".join(self.one(string.digits) if c == "#" else self.one("ABCDEFGHJKLMNPRSTWXYZ") if c == "?" else c for c in shape)

    def compound(self) -> str:
        """A German noun of two parts."""
        return self.one(_DE_FIRST) + self.one(_DE_LAST)

    # names
    def coined(self) -> str:
        """A word of random syllables."""
        n = self.r.choice([1, 2, 2, 2, 3])
        body = "".join((self.one(_ON) if i or self.r.random() < 0.8 else "") + self.one(_NUCLEUS) + (self.one(_END) if self.r.random() < 0.35 else "") for i in range(n))
        if self.r.random() < 0.05:
            body = self.one("ñåčšžøłéáóúüö") + body[1:]
        return (body + (self.one(_SUFFIX) if self.r.random() < 0.5 else self.one(_END)))[:15]

    def family(self) -> str:
        k = self.r.random()
        if k < 0.35:
            return self.one(HELD_FAMILY if self.held else FAMILY)
        made = self.coined().title()
        return self.one(["O'", "O'", "Mc", "de ", "van ", "Mac"]) + made if k < 0.40 else f"{made}-{self.coined().title()}" if k < 0.47 else made

    def given(self) -> str:
        return self.one(HELD_GIVEN if self.held else GIVEN) if self.r.random() < 0.6 else self.coined().title()[:9]

    def name(self, lower: bool = True) -> str:
        """A full name; all in lower case now and then, unless nothing but its capitals could tell it from the words around."""
        g, f, k = self.given(), self.family(), self.r.random()
        initial = self.one(string.ascii_uppercase)
        n = f"{g} {f}" if k < 0.6 else f"{f}, {g}" if k < 0.68 else f"{g[0]}. {f}" if k < 0.8 else f"{g} {initial}. {f}" if k < 0.9 else f"{g} {self.given()} {f}" if k < 0.94 else f"{g}-{self.given()} {f}"
        k = self.r.random()
        return n.upper() if k < 0.07 else n.lower() if k < 0.13 and lower else n

    def ja_family(self) -> str:
        if self.r.random() < 0.35:
            return self.one(HELD_JA_FAMILY if self.held else JA_FAMILY)
        return "".join(self.one(_JA_NAME) for _ in range(self.r.choice([2, 2, 3])))

    def ja_name(self) -> str:
        first = self.one(HELD_JA_GIVEN if self.held else JA_GIVEN) if self.r.random() < 0.35 else "".join(self.one(_JA_FIRST) for _ in range(self.r.choice([1, 2, 2])))
        return self.ja_family() + self.one(["", "", " ", "　"]) + first

    # other items
    def host(self) -> str:
        name = self.one(HOSTS) if self.r.random() < 0.3 else self.coined()
        if self.r.random() < 0.25:
            name = f"{name}{self.one(['-', '.'])}{self.one(HOSTS)}"
        return f"{_ascii(name)}.{self.one(TLDS)}"

    def email(self) -> str:
        g, f, h = _ascii(self.given()), _ascii(self.family()), self.host()
        user = self.one([f"{g}.{f}", f"{g}-{f}", f"{g}{f}", f"{g[0]}{f}{self.r.randint(1, 99)}", f"{g}+{self.one(NOUN)}", g, f"{g}_{f}", f"{g[0]}.{f}", f"{f}{self.r.randint(1, 2024)}"])
        k = self.r.random()
        if k < 0.6:
            e = f"{user}@{h}"
            return e.upper() if self.r.random() < 0.08 else e.title() if self.r.random() < 0.09 else e
        at, dot = self.one([(" [at] ", "."), (" (at) ", " (dot) "), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" AT ", " DOT ")])
        return f"{user}{at}{h.replace('.', dot)}"

    def phone(self) -> str:
        return self.digits(self.one([
            "+1 ### ### ####", "+1-###-###-####", "(###) ###-####", "###.###.####", "##########", "### ### ####", "+44 20 #### ####", "0#### ######", "0### ### ####", "+49 ## ##### ###", "0##/#######",
            "0###/######", "+49 ### #######", "+33 # ## ## ## ##", "0033#########", "0# ## ## ## ##", "(0#) #### ####", "+61 # #### ####", "0##-###-####", "+34 ### ## ## ##", "+39 ## #### ####",
        ]))

    def ja_phone(self) -> str:
        p = self.digits(self.one(["0#0-####-####", "0#-####-####", "+81 #0-####-####", "0###-##-####"]))
        return p.translate({ord(c): chr(ord(c) + 0xFEE0) for c in "+0123456789-"}) if self.r.random() < 0.3 else p

    def numbered(self, kinds: list[tuple[list[str], list[str]]]) -> list[Span]:
        labels, shapes = self.r.choice(kinds)
        label = self.one(labels)
        return [(label + self.one([" ", ": ", " "]), "O")] * bool(label) + [(self.digits(self.one(shapes)), "ID_NUMBER")]

    def number(self) -> list[Span]:
        return self.numbered([
            (["SSN", "social security number", "social security no.", ""], ["###-##-####", "### ## ####"]), (["NI number", "NINO", "insurance number", ""], ["??######?", "?? ## ## ## ?"]),
            (["DNI", "identity card"], ["########?"]), (["passport", "passport no.", "passport number", ""], ["?########", "??#######"]),
            (["driver licence", "driving licence no.", "licence"], ["??###-####-####", "?####-#####-#####"]), (["national id", "citizen number", "id card no."], ["####-####-####", "#### #### ####"]),
        ])

    def address(self) -> str:
        s = (self.one(HELD_STREET if self.held else STREET) if self.r.random() < 0.5 else self.coined().title()) if self.r.random() < 0.85 else f"{self.coined().title()} {self.one(STREET)}"
        a = f"{self.r.randint(1, 9999 if self.r.random() < 0.2 else 399)} {self.one(['', '', 'Old ', 'W. ', 'North ', 'E. ', 'Upper ', 'New '])}{s} {self.one('Street St Avenue Ave Lane Rd Road Court Blvd Drive Way Place'.split())}"
        if self.r.random() < 0.4:
            n = self.r.randint(1, 60)
            a += self.one([f", Apt {n}{self.one('ABC')}", f", Unit {n}", f" #{n}", f", Apt {n}", f", Suite {n}", f", Flat {n}"])
        if self.r.random() < 0.65:
            a += f", {self.one(TOWN) if self.r.random() < 0.5 else self.coined().title()}"
            if self.r.random() < 0.5:
                a += f", {self.digits('?? #####')}"
        return a

    def de_address(self) -> str:
        s = f"{self.one(STREET) if self.r.random() < 0.4 else self.coined().title()}{self.one(['straße', 'str.', 'weg', 'gasse', 'allee', 'platz', 'ring', 'ufer'])} {self.r.randint(1, 399)}{self.one(['', '', 'a', 'b'])}"
        return f"{s}, {self.digits('#####')} {self.one(TOWN) if self.r.random() < 0.5 else self.coined().title()}" if self.r.random() < 0.85 else s

    def fr_address(self) -> str:
        what = self.one(["de la Paix", "du Marché", "des Lilas", "de l'Église", "Victor Hugo", "du Lac", "des Écoles"]) if self.r.random() < 0.4 else self.one(["de la ", "du ", "des ", "de "]) + self.coined().title() + (f" {self.coined().title()}" if self.r.random() < 0.2 else "")
        return f"{self.r.randint(1, 399)} {self.one(['rue', 'chemin', 'avenue', 'allée', 'boulevard', 'place', 'quai'])} {what}" + (f", {self.digits('#####')} {self.one(TOWN) if self.r.random() < 0.5 else self.coined().title()}" if self.r.random() < 0.85 else "")

    def ja_address(self) -> str:
        two = lambda a, b: self.one(a) + self.one(b)
        return two(JA_PREF, JA_PREF) + self.one("県県県府") + two(JA_CITY, JA_PREF + JA_CITY) + self.one("市市区") + two(JA_TOWN, JA_TOWN + JA_CITY) + self.one(["町", "町", ""]) + self.one(["-".join(str(self.r.randint(1, 30)) for _ in range(3)), f"{self.r.randint(1, 9)}丁目{self.r.randint(1, 30)}番{self.r.randint(1, 20)}号"])

    # sentences
    def word(self, xs: list[str]) -> str:
        """A word of the list, or now and then one that no list has."""
        return self.coined() if self.r.random() < 0.08 else self.one(xs)

    def thing(self) -> str:
        k = self.r.random()
        return f"{self.word(ADJ)} {self.word(NOUN)}" if k < 0.55 else f"{self.word(NOUN)} {self.word(NOUN)}" if k < 0.75 else self.word(NOUN)

    def slots(self) -> dict[str, Callable[[], list[Span]]]:
        o = lambda f: lambda: [(f(), "O")]
        item = lambda f, k: lambda: [(f(), k)]
        did = lambda: (lambda v: (v[:-1] if v.endswith("es") else v[:-1] + "e" if v.endswith("ees") else v[:-1]) + ("d" if v.endswith("es") else "ed"))(self.one(VERB))
        return {
            "N": item(self.name, "NAME"), "M": item(lambda: self.name(False), "NAME"), "F": item(self.family, "NAME"), "E": item(self.email, "EMAIL"), "P": item(self.phone, "PHONE"), "A": item(self.address, "ADDRESS"),
            "D": item(self.de_address, "ADDRESS"), "R": item(self.fr_address, "ADDRESS"), "L": item(self.ja_address, "ADDRESS"), "Y": item(self.ja_name, "NAME"), "y": item(self.ja_family, "NAME"),
            "Q": item(self.ja_phone, "PHONE"), "I": self.number,
            "J": lambda: self.numbered([(["Steuer-ID", "Steuernummer", "die Steuer-ID"], ["## ### ### ###", "###########"]), (["Ausweis", "Ausweisnummer", "den Ausweis"], ["?########"])]),
            "K": lambda: self.numbered([(["numéro de sécurité sociale", "n° de sécurité sociale", "NIR"], ["# ## ## ## ### ###"]), (["passeport", "le passeport"], ["##??#####"])]),
            "H": lambda: self.numbered([(["個人番号", "マイナンバー"], ["############", "#### #### ####"]), (["旅券番号", "パスポート番号"], ["??#######"])]),
            "t": o(self.thing), "a": o(lambda: self.word(ADJ)), "v": o(lambda: self.one(VERB)), "do": o(lambda: self.one("check read send open close move copy find keep drop update fix sign review".split())),
            "did": o(did), "done": o(did), "when": o(lambda: self.one(["today", "tomorrow", f"on {self.one(DAYS)}", "before noon", "after lunch", "at once", f"in {self.r.randint(2, 90)} minutes", "as soon as you can", f"by {self.one(DAYS)}", "once the window opens"])),
            "they": o(lambda: self.one(["she", "he", "they"])), "title": o(lambda: self.one("Mr Mrs Ms Mx Dr. Prof. Miss Mr. Mrs. Dr".split())), "d": o(lambda: self.one(DAYS)), "n": o(lambda: str(self.r.randint(2, 90))),
            "w": o(lambda: self.coined() if self.r.random() < 0.12 else self.one(COMMON)), "W": o(lambda: self.one(COMMON).title()), "lead": o(lambda: self.one(LEADS)),
            "u": o(lambda: self.one(DE_COMMON)), "G": o(lambda: self.one(DE_COMMON).title()),
            "place": o(lambda: self.one(PLACES)), "key": o(lambda: self.one(PERSON_KEYS)), "pkey": o(lambda: self.one(PHONE_KEYS)), "mkey": o(lambda: self.one(MAIL_KEYS)), "akey": o(lambda: self.one(PLACE_KEYS)),
            "g": o(lambda: (f"{self.one(DE_ADJ)} " if self.r.random() < 0.5 else "") + (self.compound() if self.r.random() < 0.4 else self.one(DE_NOUN))), "f": o(lambda: self.one(FR_NOUN)), "j": o(lambda: self.one(JA_NOUN)),
        }

    def filled(self, form: str) -> list[Span]:
        slots, out = self.slots(), []
        while form:
            head, _, rest = form.partition("{")
            out += [(head, "O")] * bool(head)
            name, _, form = rest.partition("}")
            if name:
                out += slots[name]()
        return out

    def carrier(self) -> list[Span]:
        if self.held:
            return self.filled(self.one(HELD))
        k = self.r.random()
        return self.filled(self.one(PEOPLE if k < 0.42 else THINGS if k < 0.7 else GERMAN if k < 0.8 else FRENCH if k < 0.89 else JAPANESE))

    def brand(self) -> str:
        return " ".join(self.one(BRAND) for _ in range(self.r.choice([1, 1, 2]))) + " " + self.one(HEADS)

    def plain(self) -> list[Span]:
        r, t, n = self.r, self.thing, lambda: self.word(NOUN)
        camel = lambda k: "".join(self.one(NOUN).title() for _ in range(k))
        hexes = lambda k: "".join(self.one("0123456789abcdef") for _ in range(k))
        big = lambda lo, hi: str(r.randint(10**lo, 10**hi))
        past = lambda: self.one(VERB)[:-1].removesuffix("e") + "ed"
        w = lambda: self.coined() if r.random() < 0.12 else self.one(COMMON)
        noun = lambda: self.compound() if r.random() < 0.4 else self.one(DE_NOUN)
        u, g = lambda: self.one(DE_COMMON), lambda: f"{self.one(DE_ADJ)} {noun()}" if r.random() < 0.5 else noun()
        ly = lambda: (self.one([*ADJ, *VERB]).rstrip("s") if r.random() < 0.8 else self.coined()) + "ly"
        mark = lambda: " ".join((self.one(BRAND) if r.random() < 0.6 else self.one([*NOUN, *ADJ]).title()) for _ in range(r.choice([1, 1, 2])))
        code = lambda: self.digits(self.one(["#########-##-####", "########", "#########", "#############", "###############", "####-##", "####-###", "##-####", "20##.#.##", "20##.##.#", "##.##.####", "#.##.###", "######-####", "####-##-##", "##:##:##", "###-##", "####-####-##", "#####-#-###"]))
        what = lambda: self.one("Batch Lot Job Run Order Part Serial Record Row Epoch Timestamp Build Version Rule Case Ticket Item Block Chunk Page Line Offset Sequence Revision Release Port Shard".split())
        made = r.choice([
            lambda: f"{what()} {code()} {self.one(['was', 'is', 'and', past(), w()])} {w()}.", lambda: f"{what()} {code()} {past()} {code()}, {w()} {w()} {code()}.", lambda: f"{what()} {n()} {w()} {code()}, {w()} {code()}.", lambda: f"{n()} {code()} {w()} {w()}", lambda: f"{self.one(NOUN).title()} {w()} {w()} {code()}.",
            lambda: self.one([self.one(NOUN), self.one(ADJ), past(), self.one(VERB)]).upper(), lambda: f"{self.one([self.one(NOUN), self.one(ADJ), self.one(COMMON), self.one(VERB)]).title()} {w()} {w()} {t()} {w()}.", lambda: f"{self.one(LEADS)} {w()} {t()} {past()} {w()} {t()}.", lambda: " ".join(w() for _ in range(r.randint(2, 9))),
            lambda: f"{self.one(TEAM)} {past()} {r.randint(2, 999)} {n()}s {w()} {w()} {t()}.", lambda: f"{self.one(TEAM)} {w()} {w()} {t()}.", lambda: f"{w().title()} {camel(r.choice([2, 3]))} {w()} {w()} {t()} {self.one(VERB)} {w()}.", lambda: f"{camel(r.choice([2, 3]))} {past()} the {t()}.", lambda: f"{w()} {w()} {self.brand()} {w()} {w()} {t()}.", lambda: f"{self.brand()} {w()} {self.one(BRAND)} {self.one(BRAND)} {self.one(HEADS)} {w()}.",
            lambda: f"{self.one(['The', 'A', 'Each', w().title()])} {t()} {ly()} {self.one(VERB)} the {t()} {w()} the {t()}.", lambda: f"{mark()} {self.one(HEADS)} and {mark()} {self.one(HEADS)} {w()} the {t()}.", lambda: f"{mark()} {self.one(HEADS)} {w()} {w()} {w()} {t()}.",
            lambda: f"{u().title()} {noun()} {u()} {u()} {g()} {u()}, {u()} {u()} {noun()} {u()} {u()} {u()}. {noun()} {u()} {w()}.", lambda: f"{noun()} {u()} {w()} {u()}.", lambda: f"{self.one(TEAM)} {past()} {r.randint(2, 999)} {n()}s {w()} the {t()}, {w()} {w()} {t()} {self.one(VERB)} its {n()}.",
            lambda: f"{u().title()} {g()} {u()} {u()} {g()} {u()}, {u()} {u()} {g()} {u()}.", lambda: f"{u().title()} {g()} {u()} {g()}: {u()} {g()} {u()} {u()} {u()} {g()}.", lambda: f"{u().title()} {u()} {g()} {u()} {g()} {u()} {r.randint(2, 90)} {g()} {u()} {u()} {g()} {u()}.", lambda: f"{u().title()} {self.one(DE_NOUN)} {u()} {u()} {g()} {u()}, {u()} {u()} {g()} {u()} {u()}.",
            lambda: f"{self.one(DE_NOUN)} {u()} {u()} {g()}.", lambda: f"{u().title()} {u()} {g()} {u()} {u()} {u()} {g()} {u()} {u()}, {u()} {u()} {g()} {u()} {self.one(DE_NOUN)} {u()}.", lambda: f"{w().title()} {w()} {w()} {w()} {self.one(DAYS)} {w()} {self.one(PLACES)}.",
            lambda: f"The {t()} {self.one(VERB)} the {t()} {self.one(['before', 'without', 'near', 'inside', 'against', 'behind'])} the {n()}.", lambda: f"{self.one(TEAM)} {past()} {r.randint(2, 900)} {n()}s {self.one(['after', 'during', 'under', 'beside'])} the {t()}, {self.one(['because', 'until', 'while', 'since'])} the {t()} {self.one(VERB)} it.",
            lambda: f"A {t()} that {self.one(VERB)} the {t()} should not {self.one(['stop', 'hide', 'block', 'delay'])} the {t()}.", lambda: f"Every {t()} has {self.one(['its', 'one', 'a', 'no'])} {n()}, a {t()} and its {t()}.",
            lambda: f"If the {t()} is {self.one(ADJ)}, the {n()} page gives {self.one(['no', 'one', 'the old', 'another'])} {t()}.", lambda: f"We {past()} the {t()} in step {r.randint(1, 30)} and {past()} the {t()} later.",
            lambda: f"Look at {camel(2)}{self.one(['Test', 'Service', 'Dao', 'Adapter', 'Impl', ''])} to see how the {t()} {self.one(VERB)} it.", lambda: f"Put @{self.one(['Transactional', 'Override', 'Autowired', 'Test', 'Deprecated', 'PathVariable'])} on the {t()}.",
            lambda: f"{self.one(['Trace', 'Span', 'Commit', 'Hash'])} {hexes(r.choice([8, 16, 32]))} took {r.randint(3, 99)} ms.", lambda: f"Server 10.{r.randint(0, 255)}.{r.randint(0, 9)}.{r.randint(1, 255)} gave {r.randint(400, 599)}.",
            lambda: f"The total was {big(7, 9)}, not {big(7, 9)}.", lambda: f"Case {r.randint(1000, 9999)}-{r.randint(2, 99)} repeats {r.randint(1000, 9999)}-{r.randint(2, 99)}.", lambda: f"Timestamp {big(12, 13)} is wrong.", lambda: f"Version {r.randint(2015, 2030)}.{r.randint(1, 12)}.{r.randint(1, 28)} broke at step {r.randint(2, 99)}.",
            lambda: f"Lot {big(8, 9)}-{r.randint(2, 99)}-{r.randint(1000, 9999)} was sent again.", lambda: f"Container {self.one(NOUN)}@sha256:{hexes(16)} is live.", lambda: f"Section {r.randint(2015, 2030)}.{r.randint(1, 12)}.{r.randint(1, 28)} covers the {t()}.",
            lambda: f"Wait {r.choice([100, 2500, 60000])} ms and use port {r.randint(1000, 9999)}.", lambda: f"Dates follow ISO {self.one(['8601', '27001', '3166', '639'])} in the {t()}.", lambda: f"{self.brand()} is the {self.one(['usual', 'default', 'new'])} {n()} of the {t()}.", lambda: f"{self.brand()} and {self.brand()} use the {t()}.",
            lambda: f"{self.one(BRAND)} {self.one(BRAND)} {self.one(HEADS)} {past()} on {self.one(DAYS)}.", lambda: f"Our {self.one(['release', 'train', 'launch', 'rollout'])} {self.one(BRAND)} {self.one(BRAND)} waits for the {t()}.", lambda: f"The {self.one(TEAM)} team in {self.one(PLACES)} meets on {self.one(DAYS)}.", lambda: f"{self.one(DAYS)} and {self.one(DAYS)} are free in {self.one(PLACES)}.",
            lambda: f"Question {r.randint(1, 60)}: which {n()} owns the {t()}?", lambda: f"{t()} {n()}", lambda: f"{self.one(['TODO', 'OPEN', 'DONE', 'FAILED', 'INFO', 'WARN', self.one(ADJ), self.one(FIELDS)])}", lambda: hexes(r.choice([8, 16, 32])), lambda: f"{t()} -> {t()}", lambda: f"GET /api/{self.one(NOUN)}s/{r.randint(1, 9999)} {r.randint(200, 504)}", lambda: f"{self.one(FIELDS)}: {t()}",
            lambda: f"Die {self.one(DE_ADJ)} {self.one(DE_NOUN)} {self.one(['zeigt', 'sperrt', 'sammelt', 'meldet', 'ersetzt'])} die {self.one(DE_ADJ)} {self.one(DE_NOUN)}, sobald die {self.one(DE_NOUN)} fertig ist.", lambda: f"Wir haben {r.randint(2, 90)} Zeilen der {self.one(DE_NOUN)} gelöscht, weil die {self.one(DE_NOUN)} fehlt.",
            lambda: f"Ohne {self.one(DE_NOUN)} bleibt die {self.one(DE_ADJ)} {self.one(DE_NOUN)} nach dem Lauf leer und wird der Leitung gemeldet.", lambda: f"La {self.one(FR_NOUN)} doit précéder chaque {self.one(FR_NOUN)} pendant {r.randint(2, 90)} jours.", lambda: f"Après la {self.one(FR_NOUN)}, l’équipe garde {r.randint(2, 90)} lignes de la {self.one(FR_NOUN)} et la {self.one(FR_NOUN)} n’existe plus.",
            lambda: f"Sans {self.one(FR_NOUN)}, le service compare la {self.one(FR_NOUN)} avec la {self.one(FR_NOUN)}.", lambda: f"{self.one(JA_NOUN)}と{self.one(JA_NOUN)}の{self.one(JA_NOUN)}を表示します。", lambda: f"{self.one(JA_NOUN)}がない場合、{self.one(JA_NOUN)}を保存する。", lambda: f"{r.randint(2, 90)}件の{self.one(JA_NOUN)}が{self.one(JA_NOUN)}に残りました。",
            lambda: f"{self.one(JA_NOUN)}の{self.one(JA_NOUN)}は{self.one(JA_NOUN)}の後に確認してください。", lambda: f"夜の{self.one(JA_NOUN)}で{self.one(JA_NOUN)}を変更し、{self.one(JA_NOUN)}を更新する必要があります。",
        ])()
        return [(made, "O")]

    def text(self) -> list[Span]:
        """A few sentences, about half of them with items."""
        out: list[Span] = []
        if self.r.random() < 0.3:  # texts under a field name; the name says nothing about items
            out.append((self.one(FIELDS) + ": ", "O"))
        k = self.r.random()
        for i in range(1 if k < 0.3 else 2 if k < 0.65 else 3):
            if i:
                out.append((self.one([" ", "\n", " "]), "O"))
            out.extend(self.carrier() if self.r.random() < 0.6 else self.plain())
        return out
