"""The labelled table for personal information, made by rule from contexts and fillers that are none of the documents'.

``labelled(rows, seed, part)`` has at most ``rows`` texts, the documented bound of the training sample. ``⏎`` is a line break; slots of a context: N name,
T title or nothing, E e-mail, P phone, I identity number, A address, the rest numbers and words that are no entity. Contexts and
fillers are dealt into five parts by their order; ``part="train"`` uses four of them and ``part="held"`` the fifth, so that a held-out text
has neither a context nor a name, street, town or host of the training texts.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")
LABELLED_ROWS = 12000

CONTEXTS = {
    "en": """You can reach {N} under {P} during office hours.|Our landlord {T}{N} lives at {A}.|The parcel for {T}{N} went to {A} by mistake.|For refunds write to {E} and quote your order.|Emergency contact: {N} ({P})|My sister {N} will pick up the keys.|Delivery was refused by {N}.
{T}{N} left a voicemail, the number is {P}.|Insurance holder: {N}, {A}|The clinic moved to {A}.|Her passport number is {I}.|Social security number: {I}|He gave badge {I} at the gate.|National insurance no {I} was missing.|Driver licence {I}, issued to {N}|patient={N};dob=unknown;phone={P}|guest list: {N}, {N}, {N}
From: {N} <{E}>|To: {E}|Please forward the invoice to {E}; thank you.|{N} called twice from {P}.|The interview with {N} starts soon.|This recipe was translated by {N}.|Yours sincerely,⏎{N}|Cheers,⏎{N}⏎{E}|The tenant, {N}, pays monthly.|I met {T}{N} at the bakery, and {N} came later.|Questions? {E} or {P}.
Bring the form to {A} before noon.|Return address: {A}|witness {N}, id {I}|Tenant {N} ({I}) moved out.|{N} ({I}) passed the exam|number {I} is on the deed|the form gives {I}|name={N} email={E} tel={P}|{{"customer": "{N}", "phone": "{P}", "address": "{A}"}}|{{"id_number": "{I}", "name": "{N}"}}|author: {N}|- {N}: {P}|* {N}, {E}|dear {T}{N}, your appointment is confirmed|ask for {N} at the counter
ring me at {P} when you land|text {P} and say hello|My employee ID is {I} and my mailbox is {E}.|{N} bought the piano from {N}.|{T}{N} agreed, {T}{N} did not.|We owe this idea to {N}, who died young.|photo by {N}|Translated by {N} and {N}.|{N} and {N} got married in spring.|{N}'s bicycle was stolen.|Is {N} still in charge?|signature {N}
Tax ID {I} belongs to the bakery.|His identity card ({I}) expired.|taxpayer identification number {I}|You will find us at {A}.|I grew up at {A}, next to the dairy.|Our new office: {A}.|Rent is due at {A}.|Visitors: please write to {A}.|{N}, {A}, {P}|"{N}" <{E}>|{N} / {P} / {E}|{N} | {E} | {P}|Phone: {P}, fax: {P}|mobile {P}|T: {P} E: {E}
The lawyer of {T}{N} objected.|Only {N} knows the recipe.|Both {T}{N} and her neighbour {N} voted.|Thank you {N}!|Hello {N}, how are you?|hi {N}, did the plumber come?|the plumber is {N}, call {P}|as {N} said, winter is early|lease signed by {N} on behalf of {N}|My cousin forwarded {E} to me.|The choir was founded by {T}{N}.|{T}{N}, please come to the desk.|{N} reports a leak in the cellar.|{N} from accounting fixed the spreadsheet.|Visit {N} in room {d}.|mail me: {E}|The badge reads {I}.|badge number {I}|ID: {I}|Passport: {I}|passport {I}; visa pending|ssn: {I}|identity no. {I}""",
    "de": """Sie erreichen {T}{N} unter {P}.|Unsere Vermieterin {T}{N} wohnt in der {A}.|Das Paket für {T}{N} ging an {A}.|Schreiben Sie an {E}.|Notfallkontakt: {N} ({P})|Meine Schwester {N} holt die Schlüssel.|Personalausweis {I} von {N}|Die Steuernummer lautet {I}.|Reisepass Nr. {I}|Sozialversicherungsnummer: {I}|Ausweis: {I}
Mit besten Grüßen⏎{N}|Ansprechpartnerin: {N}, {E}|Die Praxis ist jetzt hier: {A}.|Lieferadresse: {A}|{N} hat zweimal angerufen.|{T}{N} kommt am Montag.|Rufen Sie {P} an.|Das Rezept stammt von {N}.|Telefon {P}, Mail {E}|wohnhaft {A}|Mieter: {N}, {A}|Zeuge {N} bestätigte das.|Nummer {I} steht in der Akte.|Mieterin {N} ({I}) zog aus.|gez. {N}|Herr {N} und Frau {N} sind verreist.|Laut {T}{N} regnet es bald.|Postanschrift: {A}.|Kundin {N}, Tel.: {P}""",
    "es": """Puede llamar a {T}{N} al {P}.|Nuestra casera {T}{N} vive en {A}.|El paquete de {T}{N} llegó a {A}.|Correo: {E}|En caso de urgencia: {N} ({P})|Mi hermana {N} recoge las llaves.|Documento de identidad {I}|Su NIE es {I}.|Pasaporte {I}, titular {N}|DNI: {I}|con número fiscal {I}|Atentamente,⏎{N}|Contacto: {N}, {E}
La consulta está ahora en {A}.|Dirección de envío: {A}|{N} llamó dos veces.|{T}{N} viene el lunes.|Llame al {P}, por favor.|La receta es de {N}.|tel. {P}, correo {E}|domicilio: {A}|El testigo {N} lo confirmó.|El número {I} consta en el acta.|Según {T}{N}, mañana llueve.|Cliente: {N}, móvil {P}|Fdo.: {N}|Gracias a {N} por la foto.""",
    "fr": """Vous pouvez joindre {T}{N} au {P}.|Notre propriétaire {T}{N} habite {A}.|Le colis de {T}{N} est parti au {A}.|Courriel : {E}|En cas d'urgence : {N} ({P})|Ma sœur {N} prend les clés.|Carte d'identité {I}|Numéro fiscal : {I}|Passeport n° {I}, titulaire {N}|Sécurité sociale {I}|Bien cordialement,⏎{N}|Contact : {N}, {E}
Le cabinet se trouve désormais {A}.|Adresse de livraison : {A}|{N} a appelé deux fois.|{T}{N} vient lundi.|Appelez le {P}, merci.|La recette est de {N}.|tél. : {P}, courriel {E}|demeurant {A}|Le témoin {N} l'a confirmé.|Le chiffre {I} est sur l'acte.|Numéro {I} au dossier.|Selon {T}{N}, il pleuvra.|Cliente : {N}, portable {P}|Signé : {N}|Merci à {N} pour la photo.|Écrire à {E}""",
    "zh": """房东{N}住在{A}。|快递送到{A}。|我的电话是{P}。|拨打{P}找{N}。|发邮件到{E}即可。|紧急联系人：{N}（{P}）|姐姐{N}来取钥匙。|他的身份证是{I}。|护照号码：{I}|身份证号码{I}，姓名{N}|诊所搬到了{A}。|收件人：{N}，{A}，{P}|老师{N}来过两次电话。|{N}先生周一来。|{N}女士不在。|证人{N}已确认。|客户{N}，手机{P}
电邮：{E}|签名：{N}|据{N}说，明天下雨。|菜谱由{N}翻译。|感谢{N}的照片。|请把表格交给{N}。|户籍地址：{A}|{N}和{N}结婚了。|问一下{N},电话{P}。|地址是{A},邮箱{E}。|护照{I}。|证件号:{I}""",
}
# Layouts of any language: tables, keys, signatures.
ANYWHERE = """| {N} | {P} | {A} ||| {N} | {E} ||{N};{A};{P};{E}|{N},{E},{P}|{N}\t{P}\t{E}|name: {N}⏎phone: {P}|address: {A}⏎mail: {E}|{{"contact": "{N}", "email": "{E}"}}|{{"tel": "{P}"}}|user={E}|from={E} to={E}|cc {E}, {E}|sender: {N}; {E}|id={I}|({N}, {E})|[{N}] {P}|{N}⏎{A}|{N}⏎{A}⏎{P}|{A}|{A}⏎{P}|{E}|{P}|{N}, {A}|WhatsApp: {P} - {N}"""
# Phrases before and after an entity, combined freely: before "/" any phrase may stand, after it any may follow.
BEFORE = {
    "en": {
        "N": "according to|a letter from|we hired|I asked|they elected|the dentist is|my aunt is|seen with|thanks to|painted by|sung by|repaired by|paid by|owned by|filed by|on behalf of|next to|sorry,|unlike|as|with|and then|because|when|did|has|was|is|if|whether|that|for|behind|only|even|please thank|remember|greet|fire|promote|coach|judge|neighbour|bass:|goal:|owner:|host:|pilot|chef|the mayor,|our baker,|my boss|congratulations,|dear|hello|hi|bye|attn:|c/o|name:|by|regards,⏎|best wishes,⏎|sincerely,⏎|thank you,⏎|signed:",
        "E": "mail|write to|send it to|my address is|reach us via|cc|use|log in as|bounced:|unsubscribe|from|to|email:|e-mail|the inbox|account|at|or|copy|forward to|contact|recipient|reply to",
        "P": "call|dial|phone|ring|text|fax|my cell is|tel|tel.|tel:|number:|or|reach me at|under|on|at|the new number is|this is my number|her number:|hotline|whatsapp|mobile:|by phone:|landline|call back|voicemail",
        "I": "passport|passport no.|passport number|id|id card|identity number|identity card no.|ssn|ssn:|social security no|tax number|tax id|taxpayer id|badge|badge no.|badge number|employee badge|licence|driver license|national id|insurance number|the number on the card is|identification:|her id is|holder of passport",
        "A": "at|to|from|lives at|moved to|ship to|deliver to|address:|the house is|near|located at|come to|send it to|billing address|pick it up at|resident of|office:|visit us:|stored at|rented|return to|we meet at|mail to",
    },
    "de": {
        "N": "laut|ein Brief von|wir danken|ich fragte|gemalt von|gesungen von|bezahlt von|Trauzeugin|mit|und|weil|ob|dass|für|neben|nur|sogar|Liebe|Lieber|Hallo|z. Hd.|Name:|von|Grüße⏎|Herzlich⏎|gezeichnet:|Bürgermeister|unser Bäcker|die Ärztin|Nachbar|Mitarbeiterin|beauftragt:|durch",
        "E": "Mail an|schreiben an|per E-Mail:|Adresse|oder|von|an|E-Mail:|unter",
        "P": "Tel.|Telefon:|Handy|anrufen:|oder|unter|Fax|Mobil|Rückruf|Rufnummer",
        "I": "Ausweis|Ausweisnummer|Personalausweis Nr.|Reisepass|Passnummer|Steuernummer|Steuer-ID|Identifikationsnummer|Dienstausweis|Sozialversicherungsnummer",
        "A": "in der Nähe von|wohnt|Adresse:|Anschrift|liefern an|nach|aus|bei|gesendet an|Praxis:|zieht in die|Büro:|an",
    },
    "es": {
        "N": "según|una carta de|contratamos a|pregunté a|pintado por|cantado por|pagado por|con|y|porque|si|que|para|junto a|solo|incluso|Querida|Estimado|Hola|Nombre:|de|Saludos,⏎|Un abrazo,⏎|firmado:|el alcalde|nuestra panadera|la doctora|el vecino|por|gracias,",
        "E": "escriba a|correo:|mande a|o|de|a|e-mail|buzón",
        "P": "tel.|teléfono:|móvil|llame al|o|al|fax|número",
        "I": "DNI|NIE|NIF|pasaporte|pasaporte n.º|documento|número de identidad|carné de identidad|identificación",
        "A": "en|a|desde|vive en|dirección:|domicilio en|enviar a|se mudó a|oficina:|cerca de",
    },
    "fr": {
        "N": "selon|une lettre de|nous avons embauché|j'ai demandé à|peint par|chanté par|payé par|avec|et|parce que|si|que|pour|près de|même|Chère|Cher|Bonjour|Nom :|de|Amitiés,⏎|Bises,⏎|signé :|le maire|notre boulangère|la docteure|le voisin|par|merci,",
        "E": "écrire à|courriel :|envoyer à|ou|de|à|e-mail|mél :",
        "P": "tél.|téléphone :|portable|appeler le|ou|au|fax|numéro",
        "I": "passeport|passeport n°|carte d'identité|numéro de sécurité sociale|identité|numéro fiscal|matricule|CNI",
        "A": "au|à|depuis|habite|adresse :|domicilié|livrer au|a déménagé au|bureau :|près du",
    },
    "zh": {
        "N": "据|请问|感谢|告诉|交给|由|找|和|与|姓名：|姓名:|收件人：|联系人:|客户|老师|同事|因为|如果|给|送给|签名：|负责人|医生|邻居|店主",
        "E": "邮箱：|写信到|发到|或|电邮|邮件:|邮箱",
        "P": "电话：|手机|拨打|或|致电|号码是|电话:|联系电话|传真",
        "I": "身份证|身份证号：|护照|护照号|证件号码|证件:|身份证号码为|护照号码",
        "A": "地址：|住在|寄到|送到|位于|搬到|在|地址:|家住|寄往|收货地址",
    },
}
AFTER = {
    "en": "/| called|, please| sold the bakery| was late| is on holiday| will come in March| has two dogs| from the bank|'s car broke down| and her cousin|, who sings,| agreed| or so| before lunch| by Friday| again| for details| if it rains| instead| twice| (new)| only| said no|, thanks| today| never replied|; see below| - urgent|?|!|.| and|, or| on behalf of us| in the cellar| at noon| for years| works too| expired| went missing| is wrong| is listed twice| goes here",
    "de": "/| hat angerufen|, bitte| war krank| ist im Urlaub| kommt im Juli| hat zwei Hunde| von der Bank| und ihr Bruder| stimmte zu| vor dem Essen| noch einmal|, falls es regnet| stattdessen|, danke| heute|?|!|.| und|, oder| ist falsch| fehlt| gilt nicht mehr| singt im Chor| am Montag|; siehe unten",
    "es": "/| llamó|, por favor| estaba enfermo| está de viaje| viene en julio| tiene dos perros| del banco| y su primo| aceptó| antes de comer| otra vez|, si llueve|, gracias| hoy|?|!|.| y|, o| es falso| falta| caducó| canta en el coro| el lunes|; véase abajo",
    "fr": "/| a appelé|, merci| était malade| est en voyage| vient en juillet| a deux chiens| de la banque| et son cousin| a accepté| avant midi| encore| s'il pleut|, merci bien| aujourd'hui| ?| !|.| et|, ou| est faux| manque| a expiré| chante en chœur| lundi|; voir plus bas",
    "zh": "/|来过|，谢谢|生病了|在休假|下个月来|有两只狗|说不行|同意了|今天|。|，|？|！|和|已过期|写错了|不见了|唱歌很好听|周五|即可|吧|的",
}
_KEYS = {
    "N": "name Name NAME owner contact Contact author guest client Name, nombre nom Kunde cliente 姓名 联系人".split(),
    "E": "email mail Email E-Mail e-mail correo courriel 邮箱 mailto".split(),
    "P": "phone tel Tel. Phone mobile Telefon teléfono tél. 电话 手机 fax".split(),
    "I": "id id_no passport ssn ID badge Ausweis DNI passeport 身份证 护照".split(),
    "A": "address Address addr Anschrift dirección adresse 地址 home office".split(),
}
PLAIN = {
    "en": """A {w} fell over.|A {z} and nobody cares.|I like {G}, {d} minutes from work.|Crowds filled {G} and {G}, {d} people each.|They closed {G} for repairs.|{Q} and {G}, {d} trees each.|if a {z}, step back|Suppose the {z}; then stop.|When a {z}, the {z}.|the {z}|"a {w}"|I carried {d} boxes.|backup/{m}{m}.zip|{{"file": "img/{m}{m}{d}.jpg", "size": {m}}}|see {w}s/{m}{m}.txt|eggs {d}@{f} each|root@{w}-{d} rebooted|speed {d}@{d}rpm|ping @{w}{d} about it|set {d}@{d}hz, {d}x{d}|I would rather wait.|Listen: the {z}.|NOTICE the {z}|DRAFT: a {z}|(drums, cheerful)|(sirens, far away)|Bake it for {d} minutes at {m} degrees, then let it rest.|The ferry to {Q} leaves at {c}.|Invoice {h} was settled in {M}.|Parcel {h} is stuck in customs.|Our score went from {f} to {f} within a week.|Tickets cost {f} euros; children pay half.|We hiked from {Q} to {Q} in {d} hours.|Chapter {d} explains the {w} in depth.
Release {v} fixes the {w} crash.|commit {x} touched {d} files|GET /api/{w}/{m} returned {d}|{{"item": {d}, "weight": {f}, "path": "store/{x}.png"}}|[{c}] worker {d} idle, queue {m}|uuid {u} not found|Screen size is 2560x1440 at 60Hz.|ask @{w}_team about the {w}|Room {d}, {d} chairs, one {w}.|The {Q} exhibition closes in {M}.|A poster for {Q} covers the wall.
Rain is likely on {M} {d}.|ISBN {h} is out of print.|Serial {h} belongs to the old {w}.|Lot {h} has {d} pieces.|row {d}: {f}; {f}; {f}|WARNING disk {d} at {f} percent|Cut the {w} in two and weigh each half.|Why would anyone paint a {w} green?|He says the {w} is too heavy.|Nobody claimed the {w} last winter.|Put {d} eggs and the {w} aside.|Which {w} costs less than {d} dollars?
The orchestra tunes while a {w} rolls across the floor.|Two plumbers argue about a {w}.|An elderly gardener waters the {w}.|Then the goalkeeper limps off, holding a {w}.|Add salt, stir, and wait for {d} seconds.|Never store the {w} near an oven.|See figures {d}-{d} and table {d}.|Batch {d}-{d}-{d} failed twice.|From {f} to {f} the curve is flat.|Sales rose by {f} percent in {M}.|Answer B is wrong since the {w} is missing.|Model {h} is sold out.|Case {h} was closed.|Reference {h} refers to an older contract.|HTTP_{d} and ERR_{d} mean the same.
NOTE {x} pending|TRACE id={u} size={m} ratio=0.{d}|{c} {c} {f} {m}|The {Q} team won {d}:{d}.|People like the {Q} edition better.|"{Q}" is a song about a {w}.|The {Q} train is late.|We compared {Q} with {Q}.|Open {w}.cfg, set depth={d}, save.|temperature={f} humidity={f} door={d}|Only {d} of {m} seats are taken.|Everyone laughed when the {w} fell.|Turn left, then climb {d} stairs.|The museum guide hides behind a {w}.|Chess club meets in {M}.|The price fell from {m} to {m}.|Stir until smooth. Serve warm.|No parking. Keep left.|Read me first.|Warm light, soft wind, slow river.|Today it snowed. Tomorrow it thaws.|Most of it is luck.|I think {Q} is overrated.|(applause) a {w} (whistling)|[{c}] GUEST {d}: pass me the {w}, would you?|{c} caller {d} hangs up|Weight {d} kg, height {d} cm.|{d} {d} {d} {d}|{h}|{m}{m}|{m} {m} {m}|ref {m} {m} {m}|counter {m}-{m}|key {h} missing|Order {h} contains a {w} and {d} screws.""",
    "de": """Das Gemüse {d} Minuten kochen und abgießen.|Der Zug nach {Q} fährt um {c}.|Rechnung {h} wurde im {M} bezahlt.|Die Fähre kostet {f} Euro.|Im Garten steht ein alter Brunnen.|Kapitel {d} erklärt den Ablauf.|Der Gärtner gießt die Rosen und pfeift.|Wir wanderten {d} Stunden durch den Nebel.|Version {v} behebt den Absturz.|Die Ausstellung {Q} schließt bald.|Ein Hund bellt, dann wird es still.|Von {f} bis {f} bleibt die Kurve flach.|Niemand hat den Schirm gesehen.|Bestellung {h} enthält {d} Schrauben.|Die Antwort ist falsch, weil der Schlüssel fehlt.|Zwei Klempner streiten über ein Rohr.|Alle lachten, als der Kuchen fiel.|Bitte Türen schließen und leise sein.""",
    "es": """Hervir la verdura {d} minutos y escurrir.|El tren a {Q} sale a las {c}.|La factura {h} se pagó en {M}.|El billete cuesta {f} euros.|En el jardín hay un pozo viejo.|El capítulo {d} explica el proceso.|El jardinero riega las rosas y silba.|Caminamos {d} horas bajo la niebla.|La versión {v} corrige el fallo.|La exposición {Q} cierra pronto.|Un perro ladra y luego hay silencio.|De {f} a {f} la curva es plana.|Nadie ha visto el paraguas.|El pedido {h} lleva {d} tornillos.|La respuesta es falsa porque falta la llave.|Dos fontaneros discuten por un tubo.|Todos rieron cuando cayó el pastel.|Cierren las puertas, por favor.""",
    "fr": """Cuire les légumes {d} minutes puis égoutter.|Le train pour {Q} part à {c}.|La facture {h} a été réglée en {M}.|Le billet coûte {f} euros.|Dans le jardin il y a un vieux puits.|Le chapitre {d} explique la marche à suivre.|Le jardinier arrose les roses et siffle.|Nous avons marché {d} heures dans la brume.|La version {v} corrige le défaut.|L'exposition {Q} ferme bientôt.|Un chien aboie, puis plus rien.|De {f} à {f} la courbe est plate.|Personne n'a vu le parapluie.|La commande {h} contient {d} vis.|La réponse est fausse car la clé manque.|Deux plombiers se disputent un tuyau.|Tout le monde a ri quand le gâteau est tombé.|Fermez les portes, merci.""",
    "zh": """蔬菜煮{d}分钟后捞出。|去{Q}的火车{c}出发。|发票{h}已在上周付清。|船票{f}元。|花园里有一口老井。|第{d}章解释了流程。|园丁一边浇花一边吹口哨。|我们在雾里走了{d}小时。|新版本{v}修复了崩溃。|展览很快就要结束。|狗叫了几声，然后安静下来。|从{f}到{f}曲线很平。|没有人见过那把雨伞。|订单{h}里有{d}颗螺丝。|答案不对，因为钥匙不见了。|两个水管工在争论一根管子。|蛋糕掉下来时大家都笑了。|请关好门，保持安静。|这一页写满了字。|这一天很冷。|那一排座位空着，票价{f}元。|这一章最难。|这一周下雨。|这一片草地长{m}米。|这一堂课很短。|乙项更可靠。|丁项不对。|今天下雪，明天放晴。|会议推迟到下午。|这道题选乙。|选择甲项更合适。|乙项从来没有人选。|这段音频太短了。|第一段长{f}米。|一段绳子长{d}米，宽{d}厘米。|这项任务花了{f}小时。|游客先吃饭，然后走向车站。|选甲说明读懂了。|选乙提高了难度。|选丙说得通。|学生认为气氛是轻松的。|如果农民想挪动水缸，就不会锁上仓库。|剧场里的灯太暗，看不清台词。|裁缝正在缝补衣服，周围有些嘈杂。|根据新的规定，方案二更合理。|别把没看到的东西算进去。|成绩从{f}升到{m}。|奶奶把旧毛衣拆了重新织。|小猫躲在沙发后面睡着了。|价格从{m}降到{m}。""",
}
# Parts of sentences without entities: who, does, what, where or when.
PARTS = {
    "en": (
        "a tired plumber|the youngest child|our neighbour|someone in a raincoat|the choir|an owl|the bakery|a stranger with a cane|every passenger|the tall dentist|two farmers|a goat|the committee|most visitors|this gadget|the recipe|nobody|the goalkeeper|a retired sailor|the radio host|an apprentice|the landlady|whoever came last|the printer|a swarm of bees|the cashier with glasses|an electrician on a ladder|a {w}|the {w}|the {z} while the cook|the chess player|Grandmother|The engineer|Winter|Breakfast|Traffic|Homework|Their tent|Both skaters",
        "folds|ignores|sells|paints|forgets|drops|throws away|borrows|weighs|cleans|burns|is selling|was painting|has dropped|will replace|should avoid|cannot lift|asks about|shouts at|dreams of|sits on|walks past|runs into|stares at|dances around|seems bored by|begins peeling|keeps scrubbing|stopped chewing|looks proud of",
        "a {w}|the {w}|an old {w}|the broken {w}|{d} eggs|some bread|the heavy {w} and a {w}|a purple {w}|its {w}|the same {w} again|the last {w} on the shelf|fresh snow|cold soup|the wooden {w}|what is left|a pile of leaves|the smallest {w}|the blue {w}, not the grey one",
        "in the attic|near the {w}|during the storm|at {c}|without a word|for {f} euros|after {d} minutes|on a {M}|while it rains|because dinner is late|until the shop closes|under a cloudy sky|with both hands|as if asleep|twice a week|before the bell|behind the barn|beside a {w}|inside the tent|(laughing)|at {Q}|every {d} days|and then sits down|but not today",
    ),
    "de": (
        "ein müder Klempner|das jüngste Kind|unser Nachbar|jemand im Regenmantel|der Chor|eine Eule|die Bäckerei|der große Zahnarzt|zwei Bauern|eine Ziege|der Ausschuss|niemand|der Torwart|ein alter Seemann|die Vermieterin|der Drucker|der Winter|das Frühstück|die Köchin|ein Lehrling|der Wasserhahn|eine Streichholzschachtel|der zweite Durchgang|das Ergebnis|die Dachrinne|ein Rasenmäher|die Nachtschicht|ein Staubsauger|die Wandfarbe|der Entwurf|ein Schneeball",
        "faltet|vergisst|verkauft|malt|wirft|trägt|reinigt|verbrennt|sucht|findet|hat verloren|wird ersetzen|soll meiden|fragt nach|träumt von|steht vor|tanzt um|sieht gelangweilt aus neben|stiehlt|brachte|lieferte|zerbrach|verschwand mit|quietschte wie|bestätigte|widersprach|überholte|verursachte",
        "einen Apfel|die Gabel|das alte Sofa|den kaputten Wecker|{d} Eier|etwas Brot|die schwere Kiste Obst|ein lila Kissen|denselben Löffel|frischen Schnee|kalte Suppe|den Rest|einen Haufen Laub|die blaue Tasse|den Schlüsselbund",
        "auf dem Dachboden|neben der Scheune|während des Sturms|um {c}|ohne ein Wort|für {f} Euro|nach {d} Minuten|im {M}|bei Regen|weil das Essen kalt ist|mit beiden Händen|zweimal pro Woche|vor dem Läuten|im Zelt|aber heute nicht|hinter dem Haus|zum roten Ziegeldach|mit verbogener Klinge|aus feinem Leder|bei offenem Tor|zur rostigen Pumpe|vom nassen Rasen|am steilen Hang|zum Bahnsteig|zur Kasse|beim Aufräumen|im kleinen Saal",
    ),
    "es": (
        "un fontanero cansado|la niña pequeña|nuestro vecino|alguien con gabardina|el coro|un búho|la panadería|el dentista alto|dos campesinos|una cabra|el comité|nadie|el portero|un marinero viejo|la casera|la impresora|el invierno|el desayuno|la cocinera|un aprendiz|el segundo examen|el tornillo|la aspiradora|el resultado|la bombilla|el colador|la mecedora|un destornillador|el paraguas|la tormenta",
        "dobla|olvida|vende|pinta|tira|lleva|limpia|quema|busca|encuentra|ha perdido|va a cambiar|debe evitar|pregunta por|sueña con|está frente a|baila alrededor de|roba|rompió|perdió|midió|corrió hacia|trajo|sacudió|mordió|arregló|aplastó|sostuvo",
        "una manzana|el tenedor|el sofá viejo|un reloj roto|{d} huevos|algo de pan|la caja de fruta|un cojín morado|la misma cuchara|nieve fresca|sopa fría|el resto|un montón de hojas|la taza azul|las llaves",
        "en el desván|junto al granero|durante la tormenta|a las {c}|sin decir nada|por {f} euros|tras {d} minutos|en {M}|cuando llueve|porque la cena está fría|con ambas manos|dos veces por semana|antes de la campana|en la tienda|pero hoy no|detrás de la casa",
    ),
    "fr": (
        "un plombier fatigué|la plus jeune|notre voisin|quelqu'un en imperméable|la chorale|un hibou|la boulangerie|le grand dentiste|deux paysans|une chèvre|le comité|personne|le gardien|un vieux marin|la logeuse|l'imprimante|l'hiver|le petit déjeuner|la cuisinière|un apprenti|le deuxième essai|le robinet|l'aspirateur|le résultat|l'ampoule|la passoire|un tournevis|le parapluie|l'orage|la brouette",
        "plie|oublie|vend|peint|jette|porte|lave|brûle|cherche|trouve|a perdu|va remplacer|doit éviter|demande|rêve de|se tient devant|danse autour de|vole|cassa|perdit|mesura|apporta|secoua|mordit|répara|écrasa|tenait",
        "une pomme|la fourchette|le vieux canapé|un réveil cassé|{d} œufs|du pain|la caisse de fruits|un coussin violet|la même cuillère|de la neige|la soupe froide|le reste|un tas de feuilles|la tasse bleue|les clés",
        "au grenier|près de la grange|pendant l'orage|à {c}|sans un mot|pour {f} euros|après {d} minutes|en {M}|quand il pleut|car le dîner est froid|des deux mains|deux fois par semaine|avant la cloche|sous la tente|mais pas aujourd'hui|derrière la maison",
    ),
    "zh": (
        "修理工|这项工作|一项新规定|那段路|这段话|第三项|事项表|小朋友|邻居|穿雨衣的人|合唱团|猫头鹰|面包店|牙医|农民|一只山羊|委员会|守门员|老水手|房东太太|打印机|冬天|早餐|厨娘|学徒|高个子选手|白头发的爷爷|成年人|任何人|方案|时间|金色的鱼|江水|温度|钱包|于是他们|马路对面的车|石头|黄色的花|全体成员|周末的集市|张开的伞|关门的铺子|路过的骑手|乐队|游客",
        "折好了|忘记了|卖掉了|画了|扔了|抬着|洗干净|烧掉了|正在找|发现|弄丢了|准备换|应该避开|问起|梦见|站着看|绕着跳舞|偷走了|安装|成为|包住|计算|向着|和平地看着|连续喊|强调|易于理解",
        "一个苹果|叉子|旧沙发|坏掉的闹钟|{d}个鸡蛋|一些面包|沉重的水果箱|紫色靠垫|同一把勺子|新下的雪|冷汤|剩下的部分|一堆树叶|蓝色杯子|那串钥匙|白色的毛巾|高高的梯子|金属零件|段落|章节|曲子|水管|一张纸|三张邮票|方向盘",
        "在阁楼上|挨着谷仓|暴风雨期间|大约{c}|一言不发|花了{f}元|过了{d}分钟|等到{M}|因为晚饭凉了|用双手|每周两次|铃响之前|帐篷里|不过今天没有|房子后面|温室外面|石阶上|江边|马上|平时|周围很安静|成功之后|向左走|时常如此|于心不忍",
    ),
}
TITLES = {"en": "Mr. Ms. Mrs. Dr. Prof. Miss Sir Mr Mrs", "de": "Herr Frau Dr. Prof. Herrn", "es": "Sr. Sra. Dña. Dr. Dra. Don Doña Srta.", "fr": "M. Mme Mlle Dr Me Monsieur Madame", "zh": ""}
FIRST = {
    "en": "Abigail Alison Amber Andrew Anthony Audrey Barbara Beatrice Bernard Bethany Brenda Brian Cameron Carol Catherine Charlotte Christopher Craig Deborah Dennis Diana Donald Dorothy Douglas Edward Eleanor Elizabeth Emily Eric Fiona Francis Frederick Gareth Geoffrey Gillian Gordon Gregory Harriet Heather Howard Jacob Janet Jasmine Jeremy Joanna Jonathan Joseph Judith Justin Keith Kenneth Kimberly Lauren Leonard Linda Lydia Malcolm Marcus Marjorie Matthew Melissa Michael Monica Nathan Nicholas Olivia Pamela Patrick Philippa Rachel Raymond Rebecca Richard Roger Samantha Sandra Sharon Sheila Stephen Steven Timothy Tracey Trevor Valerie Vincent Virginia Walter William Yvonne Zachary Ian Amy Roy Jill Joy Kim Liam Maya Noah Owen Priya Ravi Yusuf Aisha Kenji Olga Tariq",
    "de": "Andreas Angelika Annegret Bernd Birgit Brigitte Christian Claudia Dagmar Dieter Dietmar Dorothea Eberhard Elfriede Erika Ernst Frank Franziska Gerhard Gisela Günter Hannelore Hans Harald Hartmut Helga Helmut Herbert Holger Horst Irmgard Jens Jutta Karin Karl Katrin Kerstin Kurt Lothar Lutz Manfred Marlies Matthias Monika Norbert Petronella Rainer Renate Rolf Rüdiger Silke Stefan Steffen Susanne Thorsten Torsten Ursula Volker Waltraud Werner Wolfgang Wolfram",
    "es": "Adrián Alejandro Alfonso Almudena Alicia Andrés Antonio Araceli Beatriz Carlos Carmen Concepción Consuelo Cristina Daniel Diego Dolores Eduardo Emilio Enrique Esperanza Eugenia Fernando Francisco Gabriel Gonzalo Guillermo Gustavo Ignacio Isabel Javier Joaquín Jorge José Josefa Juan Julián Lorena Luis Manuel Marcos María Mercedes Miguel Montserrat Nuria Pablo Paloma Patricia Pedro Rafael Raúl Ricardo Rosario Salvador Santiago Sergio Silvia Teresa Tomás Vicente Yolanda",
    "fr": "Adrien Agathe Alain Amandine André Antoine Arnaud Audrey Aurore Baptiste Bernadette Bertrand Brigitte Bruno Camille Cédric Céline Christophe Claire Colette Corinne Delphine Denis Didier Dominique Édouard Émilie Estelle Fabien Fabrice Florence Frédéric Geneviève Georges Gérard Gilles Guillaume Henri Isabelle Jacques Jean Josiane Julien Karine Laurence Laurent Loïc Lucie Marcel Mathilde Maxime Mireille Monique Nathalie Nicolas Odette Pascal Patrice Philippe Pierrick Quentin Raymond Régine Rémi Roland Sandrine Sébastien Simone Solange Sylvie Thierry Valérie Véronique Xavier Yann Yves",
}
LAST = {
    "en": "Abbott Armstrong Atkinson Baldwin Bannister Barrett Bennett Bradshaw Brennan Brown Buchanan Callahan Campbell Chandler Clarke Coleman Connolly Cunningham Davidson Dawson Donovan Edwards Ellis Fairbanks Ferguson Finch Fletcher Gallagher Gibbs Goodwin Graham Greene Griffiths Hammond Harrison Hawkins Henderson Higgins Holloway Hughes Iqbal Jackson Jenkins Johnson Kapoor Kennedy Khan Lambert Lawson Lee Lindqvist MacDonald Marshall Mitchell Mukherjee Murphy Nakamura Newman Nguyen Novak Okafor Osborne Papadakis Parker Patel Pearson Petrov Phillips Quigley Ramsey Reynolds Richardson Robinson Rossi Sanders Sato Schultz Shaw Simmons Singh Smith Spencer Stephenson Stevens Sullivan Sutherland Taylor Thompson Turner Underhill Vaughan Wainwright Walsh Warner Watkins Whitaker Wilkinson Wong Wright Yamamoto Young Zhang Zielinski",
    "de": "Albrecht Bachmann Baumgartner Behrens Bergmann Böhm Brandt Braun Busch Dietrich Ebert Engelhardt Fischer Frank Friedrich Fuchs Gärtner Graf Groß Günther Haas Hahn Hartmann Heinrich Herrmann Hoffmann Huber Jäger Jansen Kaiser Keller Klein Koch Köhler König Krause Krüger Kühn Lange Lehmann Linke Ludwig Maier Martin Meyer Möller Müller Neumann Otto Peters Pohl Richter Roth Sauer Schäfer Schmidt Schneider Scholz Schreiber Schröder Schubert Schulze Schuster Schwarz Seidel Simon Sommer Stein Thomas Vogel Vogt Wagner Weber Weiß Werner Winkler Winter Wolff Zimmermann",
    "es": "Aguilar Alonso Álvarez Arroyo Ballesteros Benítez Blanco Bravo Caballero Cabrera Calvo Campos Carmona Castillo Castro Cortés Crespo Delgado Díaz Domínguez Escobar Esteban Fernández Flores Fuentes Gallego García Garrido Gil Giménez Gómez González Guerrero Gutiérrez Hernández Herrera Hidalgo Ibáñez Iglesias Jiménez León López Lozano Marín Márquez Martínez Medina Méndez Molina Montero Morales Moreno Muñoz Navarro Nieto Núñez Ortega Ortiz Parra Pascual Peña Pérez Prieto Ramírez Ramos Reyes Rodríguez Romero Rubio Ruiz Sánchez Santana Santos Sanz Serrano Soler Soto Suárez Torres Vargas Vázquez Vega Velasco Vidal",
    "fr": "André Aubert Barbier Baron Bernard Berger Bertrand Besson Blanchard Bonnet Boucher Bourgeois Boyer Brun Brunet Caron Charpentier Chevalier Clément Colin Cordier Cousin Da Silva David Delacroix Denis Deschamps Dubois Dufour Dumas Dupont Durand Duval Étienne Fabre Faure Fleury Fontaine Fournier Gaillard Garnier Gauthier Gérard Girard Giraud Guérin Guillot Hamel Henry Hubert Jacquet Joly Lacroix Lambert Langlois Laurent Lebrun Leclercq Lefebvre Legrand Lemaire Lemoine Leroy Lévêque Marchand Masson Mercier Meunier Michel Moreau Morel Morin Moulin Nguyen Noël Olivier Paris Pelletier Perret Perrin Petit Picard Poirier Prévost Renard Renaud Richard Rivière Robin Rousseau Roux Royer Simon Thomas Vasseur Vidal Vincent",
}
ZH_GIVEN = "建国志远雨晴思源浩然子墨若曦诗语俊杰文博嘉怡佳琪雪梅春燕海波永康国庆晓东红霞小龙天佑亦菲一诺梦洁振华立新家豪宏达丽娟桂芝长青成功学友"
STREETS = {
    "en": "Abbey Acorn Albert Aspen Bakers Beech Bellevue Birchwood Bishop Brewery Bridgewater Canal Castle Chestnut Churchill Cliff Coventry Dairy Elmwood Fairview Fernwood Foundry Franklin Garfield Glebe Grange Hawthorn Hickory Highfield Holly Jefferson Kensington Lakeview Laurel Lincoln Linden Madison Magnolia Manor Meadow Monroe Northfield Park Pine Poplar Priory Regent Riverside Rosewood Sheffield Spruce Sunset Sycamore Union Vicarage Victoria Walnut Washington Wellington Windsor Wood",
    "de": "Ahornblatt Bahnhof Berliner Bismarck Buchen Dorf Eichen Erlen Fichten Frieden Friedrich Hafen Hermann Industrie Jahn Kapellen Kastanien Kiefern Königs Lessing Lindauer Luther Marien Markt Mozart Nelken Park Post Rathaus Ring Schloss Schul Tannen Tulpen Ulmen Wiesen Ziegel",
    "es": "Alcalá Bailén Bilbao Cervantes Colón Constitución Fuencarral Goya Huertas Independencia Jardines Libertad Magdalena Mayoral Nueva Palacio Quevedo Recoletos Rosales Sagasta Sevilla Trafalgar Velázquez Victoria Zurbano",
    "fr": "Aristide Bastille Bellevue Carnot Commerce Écoles Fontaines Gambetta Jaurès Lafayette Lavande Liberté Lilas Marronniers Moulin Pasteur Peupliers République Rosiers Verdun Victoire Voltaire Hugo Zola",
}
TOWNS = {
    "en": "Bedford|Brighton|Burlington|Cambridge|Canterbury|Cheltenham|Concord|Dayton|Dover|East Grinstead|Evanston|Fairfield|Glenwood Springs|Great Malvern|Greenville|Guildford|Hartford|Ipswich|Kendal|Lancaster|Little Rock|Long Eaton|Manchester|Milton|New Bedford|Newport|Norwich|Oxford|Palm Springs|Plymouth|Redditch|Salem|Santa Rosa|Shrewsbury|South Bend|Springfield|Stratford|Taunton|Upton|Wakefield|Warwick|Wichita Falls|York",
    "de": "Aachen|Augsburg|Bad Homburg|Bamberg|Bielefeld|Bonn|Bremen|Celle|Darmstadt|Erfurt|Essen|Flensburg|Freiburg|Fulda|Göttingen|Halle (Saale)|Hannover|Jena|Kassel|Kiel|Köln|Leipzig|Lübeck|Mainz|Marburg|München|Münster|Offenbach am Main|Passau|Potsdam|Rostock|Trier|Ulm|Weimar|Worms|Würzburg",
    "es": "Albacete|Alcázar de San Juan|Almería|Ávila|Badajoz|Burgos|Cádiz|Ciudad Real|Córdoba|Cuenca|Girona|Granada|Huelva|Jaén|La Coruña|Las Rozas|Lugo|Málaga|Mérida|Murcia|Oviedo|Palencia|Pamplona|Salamanca|Santander|Segovia|Soria|Teruel|Toledo|Valladolid|Vigo|Zamora|Zaragoza",
    "fr": "Aix-en-Provence|Angers|Annecy|Arles|Avignon|Bayonne|Besançon|Blois|Bordeaux|Brest|Caen|Chartres|Colmar|Dijon|Fontenay-aux-Roses|Grenoble|La Rochelle|Le Mans|Lille|Limoges|Lorient|Lyon|Metz|Nancy|Nantes|Neuilly-sur-Seine|Nîmes|Orléans|Pau|Poitiers|Quimper|Reims|Rennes|Rouen|Saint-Malo|Toulouse|Tours|Troyes|Vannes",
}
ZH_TOWN = "北京市 上海市 广州市 深圳市 成都市 杭州市 南京市 武汉市 西安市 苏州市 天津市 长沙市 青岛市 郑州市 浙江省宁波市 广东省佛山市 福建省厦门市".split()
ZH_DISTRICT = "朝阳区 海淀区 浦东新区 天河区 南山区 武侯区 西湖区 玄武区 江汉区 雁塔区 姑苏区 和平区 岳麓区 市南区 金水区".split()
ZH_STREET = "建设路 解放路 和平路 文化路 长江路 学院路 南京路 胜利街 幸福街 花园路 体育路 新华街 友谊路 朝阳巷 前进巷 平安里".split()
HOSTS = "postbox.ro kurier.eu firma.biz gardenclub.us hospital.gov webhaus.at correo.mx poste.ch buero.li zahnarzt.me atelier.fm verein.tv sub.domain.dk north.edu.au shop.co.nz inbox.ie mailer.se netz.nl provider.it klinik.be cloud.io dev.app team.dev 163.cn qq.cn".split()
NOUNS = "abacus anvil banjo barrel blender bracelet broom cabbage cactus carpet cello chisel clarinet cushion doorbell dumpling envelope faucet fiddle freezer funnel guitar hammock hinge icebox jersey jigsaw lampshade lasagna mattress muffin napkin necklace onion oven paddock pancake parrot pillow pitcher pulley pumpkin radiator sandal screwdriver shovel sofa spoon stapler sweater thermostat toaster tractor trombone tweezers waffle wallet wardrobe wrench xylophone yogurt zipper".split()
DESCRIBING = "wobbly rickety moldy crinkled squeaky grimy threadbare lumpy frayed chipped knobbly soggy crusty gaudy shabby flimsy lukewarm brimming sticky tattered wrinkled greasy brittle bulky wispy fluffy jagged lanky muffled nimble pudgy rugged scruffy slippery tangled unkempt wicker".split()
DOING = "squeaks rattles dangles wobbles jingles sputters flutters sizzles topples creaks drips collapses bounces twirls shivers vanishes sparkles snores giggles stumbles".split()
PLACES = "Tower Gallery Valley Theatre Bay Castle Station Museum Library Festival Hotel Stadium Beach Lake Island Forest Project Series Hall Bridge Park Square Market Pier Garden House Arena Club".split()
_HEADS = "Bex Clun Dow Frob Gris Jupp Knev Lom Mub Nup Pliv Quen Rusk Slad Tew Vosp Wim Yar Zeb Abr Ond Ugl Istr Evr Chal Stro Phel Thra Brie Dwel Skor Twa Jo Ha Mirz Ro Ka Su".split()
_TAILS = {
    "en": "combe ridgeley stow thwaite bury shaw hurst den mere by wick ham ingdon sworth nett low cott more kins sby ough ister ard an en on ell in".split(),
    "de": "hausen kamp brock wald lich ler ner ke sen hardt gruber huber ing rich old mann schmid bach er el".split(),
    "es": "ández erro úa ales oria uelos arte izo ando eda iga oso illa ero".split(),
    "fr": "elin oux andre ouin ard ault igny ois oin et ourt eux eau ier elle".split(),
}


def part_of(items: list, part: str | None) -> list:
    """All items, or those of four fifths (``train``), or of the last fifth (``held``)."""
    return items if part is None or len(items) < 5 else items[4::5] if part == "held" else [x for i, x in enumerate(items) if i % 5 != 4]


class _Fill:
    def __init__(self, rng: random.Random, lang: str, part: str | None):
        self.r, self.lang, self.part = rng, lang, part
        self.who = ("info", "desk")

    def pick(self, items: list) -> str:
        n = len(items)
        if self.part is None or n < 5:
            return items[self.r.randrange(n)]
        if self.part == "held":
            return items[5 * self.r.randrange(n // 5) + 4]
        j = self.r.randrange(n - n // 5)
        return items[j + j // 4]

    def digits(self, pattern: str) -> str:
        """Zeros become digits, ``A`` a capital letter, ``a`` one of either or a digit."""
        r = self.r
        return "".join(r.choice("0123456789") if c == "0" else r.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "A" else r.choice("CFGHJKLMNPRTVWXYZ0123456789") if c == "a" else c for c in pattern)

    def zeros(self, pattern: str) -> str:
        return re.sub("0", lambda _: str(self.r.randrange(10)), pattern)

    def coined(self) -> str:
        r = self.r
        return (self.pick(_HEADS) + r.choice(("", "", "ar", "el", "os", "im"))).capitalize() + self.pick(_TAILS.get(self.lang, _TAILS["en"]))

    def family(self) -> str:
        r = self.r
        lang = self.lang if self.lang in LAST else "en"
        one = self.pick(LAST[lang].split()) if r.random() < 0.4 else self.coined()
        roll = r.random()
        if roll < 0.08:
            return f"{one}-{self.coined()}"
        if roll < 0.12:
            return r.choice({"en": ("Mc", "van ", "Mac"), "de": ("von ", "von der ", "zu "), "es": ("de ", "de la ", "del "), "fr": ("de ", "de la ", "du ", "Le ")}[lang]) + one
        if roll < 0.14 and lang == "en":
            return "O'" + one
        return f"{one} {self.pick(LAST['es'].split())}" if lang == "es" and roll > 0.85 else one

    def first(self) -> str:
        lang = self.lang if self.lang in FIRST else "en"
        return self.pick(FIRST[lang].split()) if self.r.random() < 0.75 else self.coined()

    def N(self) -> str:
        r = self.r
        if self.lang == "zh":
            from tracewright.llm.pii_words import ZH_FAMILY

            return self.pick(list(ZH_FAMILY)) + "".join(self.pick(list(ZH_GIVEN)) for _ in range(r.choice((1, 2, 2))))
        first, last = self.first(), self.family()
        self.who = (first.lower(), last.lower())
        form = r.random()
        if form < 0.46:
            return f"{first} {last}"
        if form < 0.55:
            return f"{first} {r.choice('ABCDEFGHJKLMNOPRSTVW')}. {last}"
        if form < 0.65:
            return f"{last}, {first}"
        if form < 0.73:
            return f"{last.upper()} {first}"
        if form < 0.81:
            return f"{first} {last}".upper()
        if form < 0.88:
            return f"{first} {last}".lower()
        return f"{first[0]}. {last}"

    def E(self) -> str:
        r = self.r
        a, b = (re.sub(r"[^a-z0-9]", "", x) or "x" for x in self.who)
        local = r.choice((f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a[0]}{b}", f"{b}{r.randrange(10, 2000)}", "".join(r.choice("abcdefghjkmnpqrstuvwxyz0123456789") for _ in range(r.randrange(4, 10))), f"{a}.{b}+news", a, f"{a[0]}.{b}"))
        host = self.pick(HOSTS)
        if r.random() < 0.3:
            host = f"{self.coined().lower()}.{r.choice(host.split('.')[-1:] + ['com', 'org', 'net'])}"
            host = re.sub(r"[^a-z0-9.]", "", host)
        if r.random() < 0.15:
            host = f"{r.choice(('mx', 'web', 'it', 'hr'))}-{r.choice(('a', 'one', 'b2'))}.{host}"
        form, dot = r.random(), host.replace(".", " [dot] ")
        if form < 0.60:
            out = f"{local}@{host}"
        elif form < 0.66:
            out = f"{local} @ {host}"
        elif form < 0.76:
            out = f"{local} [at] {dot}"
        elif form < 0.83:
            out = f"{local} (at) {host}"
        elif form < 0.88:
            out = f"{local}＠{host}"
        elif form < 0.96:
            out = f"{local.replace('.', ' dot ') if r.random() < 0.3 else local} at {host.replace('.', ' dot ')}"
        else:
            out = f"{local}(at){host.replace('.', '(dot)')}"
        return out.upper() if r.random() < 0.08 else out

    def P(self) -> str:
        pats = {
            "en": "(000) 000-0000,000-000-0000,000.000.0000,1-000-000-0000,+1 000 000 0000,+10000000000,+1 (000) 000-0000,000 000 0000 ext. 00,(000) 000-0000 ext. 000,000-000-0000 x00,000-000-0000 extension 000,+44 00 0000 0000,+44 0000 000000,000 0000 0000,00000 000000,0000000000,+61 0 0000 0000,+44 (0)00 0000 0000",
            "de": "+49 00 00000000,+49 000 0000000,0049 00 0000000,+49 (0)00 000000,000 00000000,0000/000000,00000 00000,0000 0000000,+43 0 000 00 00,+49 00 000000-00,000 0000-000,+49 00 00000000 Durchwahl 00,+4900000000000",
            "es": "000 00 00 00,000000000,+34 000 00 00 00,+34 000 000 000,0034 000 000 000,000 000 000,+34000000000,000-000-000,+34 000 00 00 00 ext. 00",
            "fr": "00 00 00 00 00,00.00.00.00.00,0000000000,+33 0 00 00 00 00,0033 0 00 00 00 00,+33 (0)0 00 00 00 00,00-00-00-00-00,+33000000000,00 00 00 00 00 poste 00",
            "zh": "000-0000-0000,00000000000,+86 000 0000 0000,000-00000000,000-0000 0000,(0000)0000000,(000)00000000,0086 000 0000 0000,+86-000-0000-0000,0000-0000000,000-00000000-000",
        }
        out = self.digits(self.r.choice(pats[self.lang].split(",")))
        return out.translate({ord("0") + i: 0xFF10 + i for i in range(10)}) if self.lang == "zh" and self.r.random() < 0.12 else out

    def I(self) -> str:  # noqa: E743
        pats = {
            "en": "000-00-0000,000 00 0000,000000000,AA000000A,AA 00 00 00 A,A00000000,A0000000,AA0000000,0000 0000 0000,AAA-00000,A-000000,00-0000000,AA-0000-00,A000-0000-0000",
            "de": "AaaaaaaaA,A00A00A00,AaaA00a00,00 000 000 000,00000000000,000/000/00000,00 000000 A 000,A00000000,0000000000A0",
            "es": "00000000A,00000000-A,X0000000A,Y0000000A,Z-0000000-A,00.000.000-A,AAA000000,A00000000",
            "fr": "0 00 00 00 000 000,0 00 00 00 000 000 00,000000000000000,00AA00000,000000000000,00 00 000 000 000,AA00AA000",
            "zh": "000000000000000000,00000000000000000X,A00000000,AA0000000,000000000000000",
        }
        return self.digits(self.r.choice(pats[self.lang].split(",")))

    def A(self) -> str:
        r, d = self.r, self.digits
        n = str(r.randrange(1, 400)) + (r.choice("abc") if r.random() < 0.08 else "")
        lang = self.lang
        if lang == "zh":
            road = self.pick(ZH_STREET) if r.random() < 0.7 else self.pick(list("金银水木山天云龙凤松柳梅竹")) + self.pick(list("桥河井塔门林湖泉")) + r.choice("路街巷")
            out = self.pick(ZH_TOWN) + (self.pick(ZH_DISTRICT) if r.random() < 0.8 else self.pick(list("东西南北新")) + self.pick(list("江湖城港岗")) + "区") + road + f"{r.randrange(1, 400)}号"
            return out + r.choice(("", f"{r.randrange(1, 30)}栋{r.randrange(101, 1700)}室", f"{r.randrange(1, 9)}单元{r.randrange(101, 1700)}室", f"{r.randrange(1, 30)}号楼{r.randrange(101, 1700)}室", f"{r.randrange(1, 30)}层", f"{r.randrange(1, 30)}幢{r.randrange(1, 9)}单元{r.randrange(101, 1700)}"))
        town = self.pick(TOWNS[lang].split("|")) if r.random() < 0.6 else r.choice({"en": ("", "", "New ", "Port ", "Old ", "Lower "), "de": ("", "", "Bad ", "Neu-"), "es": ("", "Villa ", "San ", "Puerto "), "fr": ("", "Saint-", "La ", "Le ")}[lang]) + self.coined()
        if lang == "es" and r.random() < 0.15:
            town += r.choice((" del Río", " de la Sierra", " del Mar"))
        if lang == "fr" and r.random() < 0.2:
            town += r.choice(("-sur-Loire", "-les-Bains", "-en-Forêt", "-le-Haut"))
        sep = r.choice((", ", ", ", ", ", "\n"))
        street = self.pick(STREETS[lang].split()) if r.random() < 0.6 else self.coined()
        box = r.random() < 0.09
        if lang == "de":
            if r.random() < 0.75:
                road = street + r.choice("straße str. weg gasse allee platz ring ufer -Straße -Weg".split()) if r.random() < 0.8 else f"{street}er {r.choice(('Straße', 'Weg', 'Landstraße', 'Allee'))}"
            else:
                road = f"{r.choice(('Am', 'An der', 'Im', 'Zum', 'Auf dem', 'Hinter der'))} {r.choice((street, street + 'hof', street + 'tor'))}"
            first = self.zeros("Postfach 00 00") if box else f"{road} {n}" + r.choice(("", "", "", ", 2. Stock", ", Hinterhaus", f", Wohnung {r.randrange(1, 30)}", f" // {r.randrange(1, 9)}"))
            return f"{first}{sep}{r.choice(('', '', 'D-'))}{d('00000')} {town}"
        if lang == "es":
            kind = r.choice(("Calle", "C/", "Avda.", "Avenida", "Plaza", "Paseo", "Camino", "Ronda", "Avda. de", "Calle de la", "Calle del", "Paseo de los"))
            two = f" {self.coined()}" if r.random() < 0.3 else ""
            unit = r.choice(("", "", ", 3.º A", ", 2º B", ", piso 4", ", bajo izq.", ", 1.º", ", esc. 2, 4.º C"))
            first = self.zeros("Apartado de Correos 000") if box and r.random() < 0.5 else self.zeros("Apartado 000") if box else f"{kind} {street}{two}{r.choice((', ', ' ', ' n.º '))}{n}{unit}"
            return f"{first}{sep}{d('00000')} {town}"
        if lang == "fr":
            kind = r.choice(("rue", "rue de la", "rue des", "rue du", "avenue", "avenue de", "boulevard", "chemin du", "chemin de la", "place", "impasse des", "quai de la", "allée des"))
            bis = r.choice(("", "", "", " bis", " ter"))
            tail = r.choice(("", "", "", ", appt 0", ", 2e étage", ", bât. B"))
            two = f"-{self.coined()}" if r.random() < 0.2 else f" {self.coined()}" if r.random() < 0.2 else ""
            first = self.zeros(r.choice(("BP 000", "BP 00", "CS 00000"))) if box else f"{n}{bis}{r.choice((', ', ' ', ' '))}{kind} {street}{two}{self.zeros(tail)}"
            return f"{first}{sep}{d('00000')} {town}"
        kind = r.choice("Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr. Court Boulevard Blvd Way Terrace Crescent Close Place".split())
        two = f"{self.pick(STREETS['en'].split())} " if r.random() < 0.12 else ""
        unit = r.choice(("", "", "", f", Apt {r.randrange(1, 90)}", f", Apt. {r.randrange(1, 9)}{r.choice('ABCD')}", f", Suite {r.randrange(1, 900)}", f", Flat {r.randrange(1, 40)}", f" Unit {r.randrange(1, 40)}", f",\nFlat {r.randrange(1, 40)},", f" #{r.randrange(1, 99)}"))
        code = r.choice((d(", AA 00000"), d(", AA 00000-0000"), d(" 00000"), d(" AA0 0AA"), d(", AA00 0AA"), "", d("\nAA0A 0AA")))
        if box:
            first = f"{r.choice(('P.O. Box', 'PO Box', 'Post Office Box', 'p.o. box'))} {r.randrange(1, 9000)}"
        else:
            lead = f"{r.choice(('Flat', 'Unit', 'Suite', 'Apartment'))} {r.randrange(1, 60)}, " if r.random() < 0.12 else ""
            first = f"{lead}{n} {two}{street} {kind}{'' if lead else unit}"
        out = f"{first}{sep if not first.endswith(',') else ' '}{town}{code}"
        form = r.random()
        return out.lower() if form < 0.1 else out.upper() if form < 0.13 else out

    def other(self, slot: str) -> str:
        r = self.r
        if slot == "Q":
            if self.lang == "zh":
                return self.pick(list("东南西北")) + r.choice("湾门岭滩")
            return r.choice((f"{self.coined()} {self.pick(PLACES)}", f"{self.pick(NOUNS).capitalize()} {self.pick(PLACES)}", f"{self.pick(NOUNS).capitalize()} {self.pick(NOUNS).capitalize()}", f"{self.pick(STREETS['en'].split())} {self.pick(PLACES)}"))
        months = {"en": "March April July October Monday Friday", "de": "März Juli Oktober", "es": "marzo julio octubre", "fr": "mars juillet octobre", "zh": "三月 七月"}
        made = {
            "d": lambda: str(r.randrange(1, 60)),
            "f": lambda: f"{r.randrange(1, 1000)}.{r.randrange(100)}",
            "m": lambda: str(r.randrange(100, 999_999)),
            "w": lambda: (self.pick(DESCRIBING) + " " if r.random() < 0.35 else "") + self.pick(NOUNS),
            "z": lambda: self.pick(NOUNS) + " " + self.pick(DOING),
            "G": lambda: f"{self.pick(STREETS['en'].split()) if r.random() < 0.6 else self.coined()} {r.choice('Street Road Lane Avenue Drive Court Square Terrace Way Close'.split())}",
            "c": lambda: f"{r.randrange(24):02d}:{r.randrange(60):02d}" + r.choice(("", f":{r.randrange(60):02d}")),
            "M": lambda: r.choice(months[self.lang].split()),
            "u": lambda: "-".join(self.hex(k) for k in (8, 4, 4, 4, 12)),
            "x": lambda: self.hex(r.choice((7, 10, 16))),
            "v": lambda: f"{r.randrange(9)}.{r.randrange(60)}.{r.randrange(60)}",
            "h": lambda: self.digits(r.choice("000-00-0000,00-000-000,000 000 000,00000000,AA-0000,000-000000,0000-0000-0000,00.000,0000 00 00,A00000,000/00,0000 000 0000".split(","))),
        }
        return made[slot]()

    def hex(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n))


def contexts(block: str) -> list[str]:
    """The contexts of a block; a bar with a blank on a side belongs to the context."""
    return [x for line in block.split("\n") for x in re.split(r"(?<![| ])\|(?! )|(?<=\|)\|(?=\|)|(?<= \|)\|", line) if x.strip()]


def _render(template: str, fill: _Fill) -> tuple[str, list[tuple[str, int, int]]]:
    kinds = {"N": "name", "E": "email", "P": "phone", "I": "id_number", "A": "address"}
    text, spans = "", []
    titled = False
    for piece in re.split(r"(\{\{|\}\}|\{[A-Za-z]\})", template.replace("⏎", "\n")):
        if piece in ("{{", "}}"):
            text += piece[0]
        elif re.fullmatch(r"\{[A-Za-z]\}", piece):
            slot = piece[1]
            if slot == "T":
                titles = TITLES[fill.lang].split()
                titled = bool(titles) and fill.r.random() < 0.55
                text += fill.r.choice(titles) + " " if titled else ""
            elif slot in kinds:
                value = fill.family() if slot == "N" and titled and fill.r.random() < 0.4 else getattr(fill, slot)()
                titled = titled and slot != "N"
                spans.append((kinds[slot], len(text), len(text) + len(value)))
                text += value
            else:
                text += fill.other(slot)
        else:
            text += piece
    return text, spans


def _phrase(rng: random.Random, lang: str, part: str | None) -> str:
    """A context put together from a phrase before and one after an entity, sometimes two in a row."""
    out = ""
    for _ in range(1 if rng.random() < 0.75 else 2):
        kind = rng.choice("NNNNNEPIA")
        before = rng.choice(part_of(BEFORE[lang][kind].split("|"), part)) if rng.random() < 0.9 else ""
        gap = "" if lang == "zh" or before.endswith("⏎") or not before else " "
        if before and not out and rng.random() < 0.6:
            before = before[0].upper() + before[1:]
        after = rng.choice(part_of(AFTER[lang].split("|"), part))
        title = "{T}" if kind == "N" and rng.random() < 0.5 else ""
        out += (" " if out and lang != "zh" else "") + before + gap + title + "{" + kind + "}" + ("" if after == "/" else after)
    return out + rng.choice(("", "", ".", "。" if lang == "zh" else "."))


def _record(rng: random.Random, part: str | None) -> str:
    """A context laid out as fields: any of the kinds in any order, with one separator, with or without keys, quotes or brackets."""
    kinds = rng.sample("NEPIA", rng.randrange(1, 5))
    sep = rng.choice(part_of([", ", "; ", " | ", ";", ",", "\t", " - ", "⏎", " / ", "|", " ", "  ", " · ", "\t", " -- "], part))
    keyed = rng.random()
    colon = rng.choice((": ", ":", "=", " = ", " "))
    fields = []
    for k in kinds:
        key = rng.choice(part_of(_KEYS[k], part))
        if keyed < 0.2 and colon != " ":
            fields.append(f'"{key}"{colon if "=" not in colon else ": "}"{{{k}}}"')
        elif keyed < 0.5 or (k == "I" and rng.random() < 0.5):
            fields.append(f"{key}{colon}{{{k}}}")
        elif keyed < 0.6:
            fields.append(f"<{{{k}}}>" if k == "E" else f"({{{k}}})")
        elif keyed < 0.7 and rng.random() < 0.4:
            fields.append(rng.choice(("{d}", "{x}", "{w}", "{m}", "{f}")) + sep + f"{{{k}}}")
        else:
            fields.append(f"{{{k}}}")
    out = sep.join(fields)
    return f"{{{{{out}}}}}" if keyed < 0.2 and sep == ", " else f"| {out} |" if sep == " | " else out


def _sentence(rng: random.Random, lang: str, part: str | None) -> str:
    """A sentence without entities, put together from its parts, here and there with capitals or brackets."""
    words = [rng.choice(part_of(x.split("|"), part)) for x in PARTS[lang]]
    if rng.random() < 0.3:
        words.insert(0, words.pop())
    if rng.random() < 0.2:
        words = words[:2]
    out = ("" if lang == "zh" else " ").join(words)
    roll = rng.random()
    out = out[0].upper() + out[1:] if roll < 0.7 else f"({out})" if roll < 0.75 else re.sub(r"\{[a-zA-Z]\}|\w+", lambda m: m[0] if m[0][0] == "{" else m[0].upper(), out) if roll < 0.78 else out
    return out + rng.choice(("。", "，", "。") if lang == "zh" else (".", ".", ".", "?", "", ";", "!"))


def _plain_record(rng: random.Random) -> str:
    """Fields without any entity."""
    sep = rng.choice((", ", "; ", " | ", ";", ",", "\t", " - ", "⏎", " "))
    return sep.join(rng.choice(("{d}", "{x}", "{w}={m}", "{f}", "{Q}", "{w}", "{c}", "{w}: {h}", "{v}", "{w}_{d}", "{M}", "{u}", "{x}.png", "({x})", "[{c}]", "{w}/{x}", "{x}")) for _ in range(rng.randrange(2, 6)))


def labelled(rows: int = LABELLED_ROWS, seed: int = 17, part: str | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """At most ``rows`` labelled texts: an entity context, often with plain sentences before and after, with or without a stop between."""
    rng = random.Random(seed)
    langs = ["en"] * 10 + ["de"] * 4 + ["es"] * 4 + ["fr"] * 4 + ["zh"] * 4
    whole = {k: part_of(contexts(v), part) + part_of(contexts(ANYWHERE), part) for k, v in CONTEXTS.items()}
    plain = {k: part_of(contexts(v), part) for k, v in PLAIN.items()}

    def with_entity(lang: str) -> str:
        roll = rng.random()
        return rng.choice(whole[lang]) if roll < 0.4 else _phrase(rng, lang, part) if roll < 0.75 else _record(rng, part)

    def without(lang: str) -> str:
        roll = rng.random()
        return rng.choice(plain[lang]) if roll < 0.42 else _sentence(rng, lang, part) if roll < 0.76 else _plain_record(rng)

    out = []
    for _ in range(rows):
        lang = rng.choice(langs)
        fill = _Fill(rng, lang, part)
        parts, roll = [], rng.random()
        if roll < 0.35 or roll > 0.8:
            parts.append(_render(without(lang), fill))
        if roll < 0.7:
            parts.append(_render(with_entity(lang), fill))
        if roll > 0.4:
            own = lang if rng.random() < 0.8 else "en"
            parts.append(_render(with_entity(own) if rng.random() < 0.2 else without(own), _Fill(rng, own, part)))
        text, spans = "", []
        for t, s in parts:
            if text:
                text += rng.choice(("\n", " ", " ", ". " if text[-1].isalnum() else " ", "" if lang == "zh" else " "))
            spans += [(k, a + len(text), b + len(text)) for k, a, b in s]
            text += t
        out.append((text, spans))
    return out
