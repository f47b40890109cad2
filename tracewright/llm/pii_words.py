"""Closed word classes that the field for personal information may look at by their identity.

All of them are function words, titles, cue words and type words of a language at large; no name, street, town or topic word is
among them. A word outside these lists is seen by its shape, its ends and its neighbours only.
"""

from __future__ import annotations

FUNCTION = """
a an the and or but nor if then than that this these those there here of at in on to from by for with without within into onto over under after before between through until since about as is are was were be been being has have had do does did
will would shall should can could may might must not no yes it its he she they we you i me him her them us my his their our your who whom whose which what when where why how all any each every both few more most other some such only own same so too very just also now again still once via per
der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren wird wurde wurden hat haben hatte mit ohne von vom zu zum zur bei beim nach vor seit für auf aus über unter durch gegen um an am im in als wie wenn dass ob er sie es wir ihr ich mich mir sich sein seine ihre unser bitte auch noch nur sehr so da dort hier hinter neben zwischen
el la los las un una unos unas y e o u pero ni que de del al a en con sin por para entre desde hasta sobre tras se lo le les su sus mi tu es son era fue fueron ha han había no sí si como cuando donde quien cual este esta estos estas ese esa eso muy ya aún también más
le la les un une des du de d l et ou mais ni que qui quoi dont où à au aux en dans par pour sur sous avec sans entre vers chez depuis jusqu est sont était été a ont avait ne pas plus se s ce cet cette ces son sa ses leur leurs mon ma votre vos notre il elle on nous vous ils elles je y aussi très déjà si comme quand n qu c j m t
nobody someone something anyone anything nothing everything another one two three four five six seven eight nine ten first second third next last never always often already yet soon up down out off away left right because while though although unless whether against along across around behind below beneath beside near outside toward like unlike except during who's it's don't let there's many much less least either neither else ever even rather quite almost enough get got make made take took put go went come came say said see saw give gave let keep kept find found
dieser diese dieses diesen jener jene welche welcher welches man etwas nichts alles jeder jede jedes schon dann danach denn also doch mal wieder immer nie niemand jemand eben kaum bereits während bis bevor nachdem weil obwohl damit sondern beide beiden zwei drei vier fünf einige viele wenige mehr weniger kann können könnte muss müssen soll sollte will wollte darf werden werde worden sei wäre hätte habe gewesen derselbe dieselbe dasselbe denselben demselben selbe selben ersten zweiten dritten letzten ganz ohne neben zwischen dabei dazu davon darauf darin ins ans
mismo misma mismos otro otra otros otras ninguno ninguna ningún algún alguna algo alguien nadie nada todo toda todos todas cada poco mucho mucha muchos tan tanto antes después luego mientras aunque pues entonces aquí allí así ahora siempre nunca casi sólo solo puede pueden pudo debe hay hubo había sido siendo estar estaba estaban están está tiene tuvo hace hizo sea sería habría hubiera primera primero segundo segunda tercero último dos tres cuatro cinco les nos él ella ellos junto según contra durante hacia
même mêmes autre autres aucun aucune quelque quelques quelqu rien tout toute tous toutes chaque peu beaucoup trop tant avant après ensuite puis pendant bien quoique alors donc ainsi ici là maintenant toujours jamais presque seulement peut peuvent doit faut sera serait aurait avoir être fait deux trois quatre cinq premier première deuxième troisième dernier lui eux contre selon jusque ceci cela ça celui celle ceux
"""

# Word classes: one feature a class, whatever the word.
CLASSES = {
    "title": "mr mrs ms miss mx sir madam dame lord lady dr prof professor doctor rev herr herrn frau fräulein hr fr don doña sr sra srta señor señora dn dña dra monsieur madame mademoiselle mme mlle mm me maître",
    "street": "street st str avenue ave av avda avenida road rd lane ln drive dr court ct boulevard blvd way terrace crescent close place pl square sq row alley parkway highway hwy walk mews gardens hill straße strasse gasse weg platz allee ring ufer damm steig calle c plaza paseo camino carretera ronda travesía rue chemin quai impasse place route cours allée sentier",
    "unit": "apartment apt flat suite ste unit floor fl room building bldg block stock wohnung hinterhaus whg piso planta puerta bajo esc escalera izq dcha bis ter étage appartement appt bâtiment bât résidence porte",
    "box": "box po p.o postfach apartado bp cs pobox correos",
    "place": "hall bridge park tower station museum theatre theater market gallery valley bay castle church school university college library hotel center centre garden harbor harbour beach lake river mount mountain island forest farm mill pier dock gate house arena stadium festival project set series edition team club company group lab institute records press studio airport port square plaza café street brücke schule kirche museo puente parque musée pont parc",
    "idcue": "ssn id identity identification passport badge tax taxpayer licence license insurance nino tin itin ein national social security ausweis ausweisnummer personalausweis reisepass pass passnummer reisepassnummer steuernummer steuer idnr identifikationsnummer sozialversicherungsnummer personalnummer dienstausweis dni nif nie cif pasaporte documento identidad fiscal passeport identité cni nir sécurité sociale fiscale matricule",
    "number": "number no nr num number numéro numero nummer n nº núm",
    "phonecue": "phone telephone tel tél fon telefon mobil mobile cell handy fax whatsapp sms call calls dial ring text hotline anruf anrufen erreichbar teléfono telefono móvil llame llamar téléphone portable appelez appeler joindre durchwahl poste extension ext",
    "mailcue": "mail email mails emails mailto write writes inbox address cc bcc sender recipient reply forward e-mail correo escriba escribir courriel mél écrire écrivez schreiben mailadresse",
    "place_cue": "address addressed live lives living resident resides deliver delivered delivery send sent ship shipped located anschrift adresse wohnhaft wohnt liefern lieferung schicken senden domicilio dirección direccion vive reside enviar envío adresse domicile habite demeurant livrer livraison envoyer envoyez residence",
    "person": "name named called contact contacts signed sign signature author written reviewed reviewer checked editor annotator customer client patient tenant witness guest member participant applicant speaker caller employee nurse teacher colleague manager attn attention regards sincerely thanks cheers best yours unterschrieben unterschrift gez kunde kundin mieter mieterin patient patientin zeuge zeugin prüfer prüferin bearbeiter bearbeiterin ansprechpartner ansprechpartnerin kontakt grüße gruß nombre firmado firma cliente paciente testigo revisor revisora contacto saludos atentamente nom prénom signé signature client cliente patiente témoin relecteur relectrice contactez contact cordialement salutations",
    "town": "new old upper lower great little north south east west port saint sainte st ste bad ober unter neu neustadt san santa santo villa puerto puente la le les las los sur sous lès am an der im bei del de",
    "month": "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo janvier février mars avril juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche",
    "particle": "von van ter mc mac bin ibn o",
    "count": "page pages item items order invoice version build step steps row rows line lines case ticket job run runs key note part chapter section figure table article lot batch commit block frame frames second seconds minute minutes hour hours kilometers meters percent euro euros dollars usd eur seite zeile schritt sekunden minuten página fila paso segundos minutos page ligne étape secondes minutes factura rechnung facture bestellung pedido commande model task index serial sku port code clip session shard option turn level score rank grade",
}

# Characters of Chinese: common family names, parts of addresses, and characters of function words and cues.
ZH_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文简阮庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍韦申尤毕聂丛焦向柳邢路岳齐梅莫庄辛管祝左涂谷祁舒耿牟卜詹关苗凌费纪靳盛童欧甄阳裴席卫查屈鲍覃霍翁隋甘景单包司柏宁柯阚车冉解强柴边"
ZH_PLACE = "省市区县镇乡村路街道巷弄号栋幢楼层室单元座院苑里州旗"
ZH_KEPT = "的了在是和与及或给向由被把将请联系电话手机邮箱信地址姓名身份证护照号码寄到住签字人员老师先生女士同事客户致打拨写送本我你他她您们这那有为对从于并也都就说叫已未不无个位名"


def known() -> frozenset[str]:
    """Every word of the closed lists."""
    return frozenset(FUNCTION.split()) | frozenset(w for v in CLASSES.values() for w in v.split())
