"""Labelled training texts for the personal-data tagger, written by a seeded generator.

There are no labelled rows for these fields, so spans are known by construction: a text is put together from pieces, and
a piece that is personal data carries its kind. Nothing is taken from the tables that are tagged. Names are common given
names and surnames of five languages and words of like sound; numbers and addresses follow the formats in public use;
what surrounds them are labels of everyday letters and loose words of the languages, in any order, so that the tagger
learns shapes and neighbourhoods instead of sentences. Look-alikes (stock, contract and company numbers, ships and
projects with given names, streets without a number) carry no kind.
"""

from __future__ import annotations

import random

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "PERSON_NAME")
LANGS = ("pl", "de", "fr", "es", "en")

# Common given names and surnames, and endings of further surnames.
GIVEN = {
    "pl": "Adam Agata Agnieszka Aleksandra Andrzej Anna Barbara Beata Bogdan Bożena Czesław Danuta Dariusz Dorota Edward Elżbieta Ewa Franciszek Grażyna Grzegorz Halina Henryk Irena Iwona Jacek Jadwiga Jakub Jan Janina Jerzy Joanna Józef Justyna Kamil Katarzyna Kazimierz Krystyna Krzysztof Leszek Łukasz Maciej Magdalena Małgorzata Marcin Marek Maria Mariusz Marta Michał Mirosław Monika Paweł Piotr Rafał Renata Robert Roman Ryszard Sebastian Sławomir Stanisław Stefan Sylwia Tadeusz Teresa Tomasz Urszula Wanda Wiesław Wiktor Władysław Wojciech Zbigniew Zofia Zygmunt".split(),
    "de": "Alexander Alfred Andrea Andreas Angelika Anja Anke Anna Annette Barbara Bernd Bettina Birgit Brigitte Christa Christian Christine Claudia Daniel Dieter Dirk Elisabeth Erika Eva Frank Friedrich Gabriele Georg Gerhard Günter Hans Heike Heinz Helga Helmut Herbert Horst Ingrid Jan Jens Joachim Jörg Jürgen Karin Karl Klaus Lars Manfred Maria Markus Martin Martina Matthias Michael Monika Nicole Norbert Olaf Peter Petra Rainer Ralf Renate Rolf Sabine Silke Stefan Susanne Thomas Torsten Ulrich Ulrike Ursula Uwe Volker Walter Werner Wolfgang".split(),
    "fr": "Alain André Anne Antoine Aurélie Bernard Brigitte Catherine Céline Chantal Charles Christelle Christian Christine Christophe Claire Claude Daniel David Denis Didier Dominique Élodie Emmanuel Éric Florence Franck François Françoise Frédéric Gérard Guillaume Guy Hélène Henri Isabelle Jacques Jean Jérôme Julien Laurence Laurent Louis Luc Lucie Marc Marie Martine Mathieu Maurice Michel Monique Nathalie Nicolas Olivier Pascal Patrick Paul Philippe Pierre René Robert Roger Sandrine Sébastien Serge Simone Sophie Stéphane Sylvie Thérèse Thierry Thomas Valérie Véronique Vincent Yves".split(),
    "es": "Adrián Alberto Alejandro Alfonso Álvaro Ana Andrés Ángel Antonio Beatriz Begoña Carlos Carmen Carolina Catalina Cristina Daniel David Diego Dolores Eduardo Elena Emilio Enrique Esteban Eva Fernando Francisco Gabriel Gloria Gonzalo Guillermo Héctor Ignacio Inés Irene Isabel Jaime Javier Jesús Joaquín Jorge José Josefa Juan Julia Julio Laura Lorenzo Lucía Luis Manuel Marcos Margarita María Marta Mercedes Miguel Mónica Natalia Nuria Óscar Pablo Patricia Pedro Pilar Rafael Ramón Raquel Raúl Ricardo Roberto Rocío Rosa Rubén Sergio Silvia Susana Teresa Tomás Vicente Víctor".split(),
    "en": "Adam Alan Alice Amy Andrew Anne Anthony Barbara Benjamin Brian Carol Caroline Catherine Charles Christopher Claire Daniel David Deborah Diana Donald Edward Elizabeth Emily Emma Eric Fiona Frank George Grace Graham Hannah Helen Henry Ian Jack James Jane Jennifer Jessica John Jonathan Joseph Karen Katherine Keith Kenneth Kevin Laura Linda Lucy Margaret Mark Martin Mary Matthew Michael Nancy Nicholas Oliver Patricia Paul Peter Philip Rachel Richard Robert Rose Ruth Samuel Sarah Scott Sharon Simon Stephen Steven Susan Thomas Timothy Victoria William".split(),
}
SURNAMES = {
    "pl": "Adamczyk Bąk Baran Błaszczyk Chmielewski Czarnecki Dąbrowski Duda Dudek Gajewski Głowacki Górski Grabowski Jabłoński Jankowski Jaworski Kaczmarek Kamiński Kowalczyk Kowalski Kozłowski Król Krawczyk Kubiak Kucharski Lewandowski Lis Maciejewski Majewski Malinowski Mazur Michalak Nowak Nowakowski Olszewski Ostrowski Pawlak Pawłowski Piotrowski Rutkowski Sadowski Sawicki Sikora Sikorski Stępień Szewczyk Szymański Tomaszewski Urbański Walczak Wieczorek Wilk Wiśniewski Witkowski Włodarczyk Wojciechowski Woźniak Wójcik Wróbel Wróblewski Wysocki Zając Zakrzewski Zawadzki Zieliński".split(),
    "de": "Albrecht Arnold Bauer Beck Becker Berger Braun Busch Fischer Frank Franke Friedrich Fuchs Graf Groß Günther Haas Hahn Hartmann Herrmann Hoffmann Hofmann Horn Huber Jung Kaiser Keller Klein Koch Köhler König Kraus Krause Krüger Kuhn Kühn Lang Lange Lehmann Ludwig Maier Mayer Meier Meyer Möller Müller Neumann Otto Peters Pfeiffer Pohl Richter Roth Sauer Schäfer Schmid Schmidt Schmitt Schmitz Schneider Scholz Schreiber Schröder Schubert Schulte Schulz Schumacher Schuster Schwarz Seidel Simon Sommer Stein Thomas Vogel Vogt Voigt Wagner Walter Weber Weiß Werner Winkler Winter Wolf Ziegler Zimmermann".split(),
    "fr": "André Aubert Barbier Bertrand Blanc Blanchard Bonnet Boucher Bourgeois Boyer Brun Caron Chevalier Clément Colin David Denis Deschamps Dubois Dufour Dumas Dumont Dupont Dupuis Durand Duval Fabre Faure Fontaine Fournier Gaillard Garnier Gauthier Gautier Gérard Giraud Girard Guérin Henry Hubert Jacquet Joly Lacroix Lambert Laurent Leclerc Lecomte Lefebvre Lefèvre Legrand Lemaire Lemoine Leroux Leroy Lucas Marchand Marie Martin Martinez Masson Mathieu Mercier Meunier Meyer Michel Moreau Morel Morin Muller Nicolas Noël Olivier Perrin Petit Picard Renard Renaud Rey Richard Rivière Robert Robin Roche Rousseau Roussel Roux Roy Simon Thomas Vidal Vincent".split(),
    "es": "Aguilar Alonso Álvarez Blanco Calvo Campos Cano Castillo Castro Cortés Cruz Delgado Díaz Díez Domínguez Fernández Fuentes Gallego García Garrido Gil Giménez Gómez González Guerrero Gutiérrez Hernández Herrera Ibáñez Iglesias Jiménez León López Lorenzo Lozano Marín Márquez Martín Martínez Medina Méndez Molina Montero Morales Moreno Moya Muñoz Navarro Núñez Ortega Ortiz Parra Pascual Peña Pérez Prieto Ramírez Ramos Rodríguez Romero Rubio Ruiz Sáez Sánchez Santana Santiago Santos Sanz Serrano Soler Soto Suárez Torres Vargas Vázquez Vega Velasco Vicente Vidal".split(),
    "en": "Adams Allen Anderson Baker Barnes Bell Bennett Brooks Brown Butler Campbell Carter Clark Collins Cook Cooper Cox Davies Davis Edwards Ellis Evans Fisher Foster Goldberg Gray Green Griffiths Hall Harris Harrison Hill Holmes Howard Hughes Hunt Jackson James Jenkins Johnson Jones Kelly Kennedy King Knight Lee Lewis Marshall Martin Mason Matthews Miller Mills Mitchell Moore Morgan Morris Murphy Murray Owen Palmer Parker Patel Phillips Powell Price Reid Reynolds Richards Roberts Robinson Rogers Russell Scott Shaw Simpson Smith Stevens Stewart Taylor Thomas Thompson Turner Walker Walsh Ward Watson Webb White Williams Wilson Wood Wright Young".split(),
}
ENDINGS = {
    "pl": "czyk owicz ewicz ski cki dzki owski ewski iński ak ek ik iak yński ko uk arz".split(),
    "de": "mann berg berger bach bacher feld stein meier mayer hoff hauer ner ler rich ke er dorf".split(),
    "fr": "ard aud ault eau eux et ette ier ière in ois on ot ou ac ec illon".split(),
    "es": "ez az ado ano aga arra era ero eta illa illo ón oso ín ueta".split(),
    "en": "son ton ley ford field man wood well worth ham ing er ers by".split(),
}
# Words of everyday use.
WORDS = {
    "pl": "zakup dostawa usługa naprawa przegląd wymiana montaż sprzęt materiał silnik pompa kabel lampa mebel papier odzież żywność paliwo pojazd część zestaw system budynek magazyn wykonawca zamawiający oferta umowa termin cena gwarancja protokół odbiór dokument wniosek załącznik warunek wymagany nowy mały duży zgodnie oraz dla przy przed po nie jest są będzie należy obejmuje dotyczy proszę pan pani jego jej nasz ten ta który był była ma mają nie ale też o za on ona jutro wczoraj list spotkanie dom pytanie prosić przyjść w z na do od lub wraz każdy według instrukcja szkolenie transport sztuka komplet rok miesiąc dzień".split(),
    "de": "Lieferung Wartung Reparatur Austausch Einbau Gerät Motor Pumpe Kabel Lampe Möbel Papier Kleidung Kraftstoff Fahrzeug Ersatzteil Satz Anlage Gebäude Lager Auftragnehmer Auftraggeber Angebot Vertrag Frist Preis Gewährleistung Protokoll Abnahme Unterlage Antrag Anhang Bedingung der die das ein eine und oder für mit von nach vor bei im ist sind wird werden muss soll alle bitte Sie sich wir uns ihr sein dieser diese war wurde hat haben nicht auch an auf aus zu zum zur er sie morgen gestern Brief Treffen Haus Frage kommen fragen neu klein groß gemäß sowie Schulung Transport Stück Jahr Monat Tag".split(),
    "fr": "fourniture entretien réparation remplacement montage matériel moteur pompe câble lampe meuble papier vêtement carburant véhicule pièce lot système bâtiment dépôt titulaire acheteur offre contrat délai prix garantie réception document demande annexe condition le la les un une des et ou pour avec de du à en sur est sont sera doit tous nous vous leur son sa ce qui que par chez avant après sans faire avoir il elle demain hier lettre réunion maison question nouveau petit grand selon ainsi que formation transport unité an mois jour".split(),
    "es": "suministro mantenimiento reparación sustitución montaje equipo motor bomba cable lámpara mueble papel ropa combustible vehículo pieza juego sistema edificio almacén contratista comprador oferta contrato plazo precio garantía recepción documento solicitud anexo condición el la los las un una y o para con de del a en sobre es son será debe todos su sus este esta que por antes después sin hay tiene está hace él ella mañana ayer carta reunión casa pregunta nuevo pequeño grande según así como formación transporte unidad año mes día".split(),
    "en": "supply maintenance repair replacement fitting equipment engine pump cable lamp furniture paper clothing fuel vehicle part set system building depot contractor buyer offer contract deadline price warranty acceptance document request annex condition the a an and or for with of from to in on is are will must all please her his our your this that was were been has have not but by at it she he they about before after until tomorrow yesterday letter meeting house question ask send come new small large under as well training transport unit year month day".split(),
}
TRADES = {
    "pl": "Zakład Stolarski|Usługi Transportowe|Firma Budowlana|Sklep|Warsztat Samochodowy|Biuro Rachunkowe|Gabinet|Pracownia|Hurtownia|Kancelaria|Auto Serwis|F.H.|P.P.H.U.|Firma Usługowa|Przedsiębiorstwo Handlowe|Piekarnia|Drukarnia|Zakład Ślusarski|Zakład Fryzjerski|Zakład Szklarski|Zakład Szewski|Studio|Apteka|Usługi Ogólnobudowlane|Stacja Paliw|PHU|F.H.U.|Firma",
    "de": "Malerbetrieb|Bäckerei|Autohaus|Schlosserei|Zimmerei|Elektro|Büro|Praxis|Druckerei|Gärtnerei|Dachdeckerei|Kanzlei|Werkstatt|Metallbau|Architekturbüro|Spedition|Fa.|Baugeschäft|Atelier|Raumausstattung|Ingenieurgesellschaft|Malermeister|Planungsbüro",
    "fr": "Boulangerie|Plomberie|Maçonnerie|Imprimerie|Serrurerie|Étude|Électricité|Transports|Peinture|Librairie|Établissements|Ets|Charpente|Bureau d'études|Ferronnerie|Maison|Scierie|Atelier|Atelier de couture|Vitrerie|Pharmacie|Société|Couverture",
    "es": "Panadería|Fontanería|Carpintería|Imprenta|Cerrajería|Taller|Transportes|Pinturas|Librería|Despacho|Instalaciones|Asesoría|Electricidad|Comercial|Gestoría|Hermanos|Herrería",
    "en": "Bakery|Plumbing|Joinery|Printing|Garage|Workshop|Transport|Painting|Consulting|Law Office|Trading|Services|Electrical|Farm|Builders",
}
BUSINESS = "Bau|Handel|Consult|Service|Group|Industrie|Solutions|Import-Export|Technik|Elektro|Agro|Plast|Stahl|Druck|Pack|Med|Optik|Auto|Foto|Chemie|Holding|Budowa|Invest|Partner|Serwis|Distribution|Conseil|Électronique|Sistemas|Servicios|Ingeniería|Engineering|Marine|Control|Data|Green|Power|Tech|Metal|Logistic|Clean"
LEGAL = "GmbH|GmbH & Co. KG|AG|KG|OHG|e.K.|S.A.R.L.|SARL|SAS|S.A.S.|SA|S.A.|SNC|S.L.|S.L.U.|SL|Sp. z o.o.|sp. z o. o.|spółka z ograniczoną odpowiedzialnością|Spółka Akcyjna|S.C.|sp. j.|s.r.o.|a.s.|S.r.l.|S.p.A.|B.V.|N.V.|AB|Ltd|Ltd.|LLC|Inc.|plc|Oy|||Besloten Vennootschap|Naamloze Vennootschap|société par actions simplifiée|Société à responsabilité limitée|société anonyme|Aktiengesellschaft|Gesellschaft mit beschränkter Haftung|Kommanditgesellschaft|Sociedad Limitada|Sociedad Anónima|spółka jawna|Spółka cywilna|Limited|Aktiebolag|společnost s ručením omezeným|Srl|Spa|SP ZOO|Sp. zo.o.|G.m.b.H.|GmbH+Co KG|A.G."
LABELS = {
    "PERSON_NAME": {
        "pl": "kontakt|osoba kontaktowa|osoba odpowiedzialna|kierownik|sekretarz|podpisał|przyjął|wydał|rozmawiał z|prowadzący sprawę|pełnomocnik|właściciel|pan|pani|inż.|dr|mgr|ppłk|przewodniczący komisji|członek|koordynator|do rąk|do wiadomości|do rąk własnych|dzierżawca|komisja w składzie|nadzoruje|upoważniona osoba|wynajmujący|informacje u|odpowiada|użytkownik|dla|wniosek złożyła|szczegóły u|lokator|odbierający|w imieniu zamawiającego|Sz. P.|rzecznik|opiekun|p.",
        "de": "Ansprechpartner|Ansprechpartnerin|Kontakt|Herr|Frau|Dr.|Dipl.-Ing.|z. Hd.|Bearbeiter|unterzeichnet von|Leiter|Inhaber|im Auftrag|Sachbearbeiterin|Kollege|Zeuge|Geschäftsführer",
        "fr": "contact|M.|M.|M.|Mme|Monsieur|Madame|responsable|à l'attention de|signé par|gérant|directeur|chargé du dossier|personne à joindre|le colonel|suivi par|maître",
        "es": "contacto|Sr.|Sra.|D.|Dña.|responsable|a la atención de|firmado por|gerente|director|persona de contacto|tramitado por|propietario|capitán",
        "en": "contact|Mr|Mr|Mrs|Ms|Dr|attention|signed by|manager|owner|please ask for|handled by|regards,|officer|on behalf of|witness",
    },
    "PHONE": {
        "pl": "tel.|telefon|tel. kom.|tel/fax|faks|nr telefonu|komórka|dzwonić pod|telefon kontaktowy|pod numerem|kom:|infolinia|całodobowo|fax|numer|nowy nr|aktualny numer|zapasowy|dyżur|lub|pod nr|sekretariat|dzwonić|prosimy dzwonić",
        "de": "Tel.|Telefon|Mobil|Fax|Rufnummer|erreichbar unter|Durchwahl|Tel.-Nr.|Handy",
        "fr": "tél.|téléphone|portable|fax|joindre au|mobile|standard|numéro",
        "es": "tel.|teléfono|móvil|fax|llamar al|tfno.|telf.|centralita",
        "en": "phone|tel.|mobile|fax|call|telephone|ring|cell|Tel",
    },
    "EMAIL": {
        "pl": "e-mail|mail|adres e-mail|poczta|pisać na|email|wysłać na adres|korespondencja|pytania na|skrzynka|pliki na|lub|zgłoszenia",
        "de": "E-Mail|Mail|an|schriftlich an|elektronisch unter|Mailadresse",
        "fr": "courriel|e-mail|adresse électronique|écrire à|mél|par mail",
        "es": "correo|e-mail|correo electrónico|escribir a|enviar a|email",
        "en": "e-mail|email|write to|mail|send to|reach us at",
    },
    "ADDRESS": {
        "pl": "adres|zam.|zamieszkały|siedziba|pod adresem|miejsce|odbiór|magazyn|dostarczyć na|biuro|lokal|wjazd|obiekt|zwrot sprzętu|plac budowy|pokój przy|adres korespondencyjny|zamieszkała przy|mieszkanie przy|budynek przy",
        "de": "Anschrift|wohnhaft|Adresse|Lieferort|Büro|abzugeben in|Sitz|wohnt",
        "fr": "adresse|domicilié|demeurant|siège|livraison|bureau|habite au|domicile :",
        "es": "dirección|domicilio|sede|entrega en|oficina|vive en|residente en",
        "en": "address|lives at|office at|deliver to|resident at|premises",
    },
    "ID_NUMBER": {
        "pl": "PESEL|nr PESEL|dowód osobisty|seria i numer dowodu|dow. os.|numer ewidencyjny|legitymujący się|paszport|nr dowodu|nr ewidencyjny PESEL|PESEL:|legitymacja|nr ewid.|nr legitymacji|numer osoby",
        "de": "Steuer-ID|Steueridentifikationsnummer|Ausweis-Nr.|IdNr.|Reisepass|Personalausweis|persönliche Steuernummer",
        "fr": "NIR|n° de sécurité sociale|numéro INSEE|sécu|n° sécu|passeport|carte d'identité",
        "es": "DNI|NIE|D.N.I.|documento|con DNI|NIF personal|pasaporte",
        "en": "NI number|national insurance no.|passport|SSN|ID card",
    },
}
LEADS = {
    "pl": "nr katalogowy|numer seryjny|nr części|nr magazynowy|partia|umowa nr|faktura|zlecenie|norma|rysunek|NIP|REGON|KRS|sprawa|indeks|kod CPV|symbol|wzór|nr postępowania|znak|pozycja|konto|nr rejestracyjny",
    "de": "Artikelnummer|Seriennummer|Teile-Nr.|Los|Vertrag Nr.|Rechnung|Auftrag|Norm|Zeichnung|USt-IdNr.|HRB|Aktenzeichen|CPV|Konto|Kundennummer",
    "fr": "référence|numéro de série|lot|contrat n°|facture|commande|norme|plan|SIRET|SIREN|dossier|CPV|compte|TVA",
    "es": "referencia|número de serie|lote|contrato n.º|factura|pedido|norma|plano|CIF|expediente|CPV|cuenta",
    "en": "part no.|serial number|batch|contract no.|invoice|order|standard|drawing|VAT|company number|file|CPV|account|stock number",
}
THINGS = {
    "pl": "okręt|statek|łódź|projekt|program|operacja|ćwiczenie|szkoła im.|odmiana|zadanie|system|akcja|hala|kuter|namiot typu|konkurs",
    "de": "Schiff|Projekt|Boot|Programm|Sorte|Modell|Aktion|Fähre",
    "fr": "navire|projet|bateau|programme|opération|modèle",
    "es": "buque|proyecto|barco|programa|operación|modelo",
    "en": "ship|project|boat|programme|operation|model|storm",
}
WORKS = {
    "pl": "remont|przebudowa|zamknięta|droga przy|odcinek|skrzyżowanie|oświetlenie|chodnik wzdłuż|objazd przez|most przy|wyjazd z|parking przy|tunel pod",
    "de": "Sanierung|Ausbau|Kreuzung|gesperrt ist die|Beleuchtung|Brücke an der",
    "fr": "réfection de la|travaux|carrefour|éclairage|pont de la",
    "es": "obras en la|reforma|cruce de la|alumbrado|puente de la",
    "en": "roadworks on|closure of|junction with|lighting of|bridge on",
}
_FOLD = str.maketrans("ąćęłńóśźżäöüßéèêëíáúñôîçûàïâ", "acelnoszzaouseeeeiaunoicuaia")


def pick(r: random.Random, words: str) -> str:
    return r.choice(words.split("|"))


class Maker:
    """Writes texts; write() gives a text and its spans."""

    def __init__(self, seed: int | str):
        self.r = random.Random(seed)

    # --- sounds and names ----------------------------------------------------------------------------------------
    def sound(self, n: int) -> str:
        r = self.r
        return "".join(r.choice("b c d f g h j k l m n p r s t v w z br cz dr gr kl kr ph pl pr rz sch sk st sz tr".split()) + r.choice("a a e e i i o o u y ie au ou".split()) for _ in range(n))

    def word(self) -> str:
        """A made-up word that is nobody's name by its neighbourhood."""
        r = self.r
        if r.random() < 0.35:  # simple syllables, often open ones
            return "".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.choice([2, 2, 3, 3, 4, 5]))) + r.choice(["", "", "", "n", "r", "s", "x"])
        return self.sound(r.choice([1, 2, 2, 3])) + r.choice(["", "", "", "d", "g", "k", "l", "m", "n", "r", "s", "t", "x"])

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def lang(self) -> str:
        return self.r.choices(LANGS, [7, 2.5, 2.5, 2.5, 1.5])[0]

    def surname(self, lang: str) -> str:
        r = self.r
        if r.random() < 0.35:
            return r.choice(SURNAMES[lang])
        last = (self.sound(r.choice([1, 1, 2, 2, 3])) + r.choice(["", "b", "d", "l", "m", "n", "r", "t"]) + r.choice(ENDINGS[lang])).capitalize()
        if r.random() < 0.06:
            i = r.randrange(1, len(last))
            last = last[:i] + r.choice("abcdeklmnorstz") + last[i + r.choice([0, 1]) :]
        return last

    def person(self, lang: str, known: float = 0.94) -> str:
        r = self.r
        given = r.choice(GIVEN[lang]) if r.random() < known else self.word().capitalize()
        last = self.surname(lang)
        if lang == "pl" and given.endswith("a") and last.endswith(("ski", "cki", "dzki")) and r.random() < 0.8:
            last = last[:-1] + "a"
        if r.random() < 0.09:
            last += "-" + self.surname(lang)
        elif lang == "es" and r.random() < 0.3:
            last += " " + self.surname(lang)
        if r.random() < 0.07 and lang in ("fr", "de"):
            given += "-" + r.choice(GIVEN[lang])
        elif r.random() < 0.05:
            given += " " + r.choice([r.choice(GIVEN[lang]), r.choice("ABCDEFGHJKLMPRSTW") + "."])
        if lang == "pl" and r.random() < 0.1:  # oblique cases
            if given.endswith("a"):
                given = given[:-1] + r.choice(["y", "ie", "ę", "ą"])
                last = last[:-1] + "iej" if last.endswith("ka") else last
            else:
                given += r.choice(["a", "owi", "em"])
                last += r.choice(["ego", "emu", "m"]) if last.endswith("i") else r.choice(["a", "owi", "em"])
        if r.random() < 0.12:
            given = given[0] + "."
        if r.random() < 0.13:
            last = last.upper()
        x = r.random()
        text = f"{given} {last}" if x < 0.66 else f"{last} {given}" if x < 0.87 else f"{last}, {given}"
        x = r.random()
        return text.upper() if x < 0.1 else text.lower() if x < 0.025 else text

    # --- numbers and addresses -----------------------------------------------------------------------------------
    def email(self, lang: str) -> str:
        r = self.r
        g, s = r.choice(GIVEN[lang]).lower().translate(_FOLD), self.surname(lang).lower().translate(_FOLD)
        user = r.choice([f"{g}.{s}", f"{s}.{g}", f"{g}_{s}", f"{g[0]}{s}", f"{g[0]}.{s}", f"{s}{r.randint(1, 99)}", g, s, f"{self.word()}.{self.word()}", self.word(), f"{self.word()}-{self.word()}", f"{self.word()}+{s}", f"{self.word()}{r.randint(1, 2030)}"])
        host = self.word() + r.choice(["", "", f"-{self.word()}", f".{self.word()}"]) + "." + r.choice("pl de fr es com eu org net info com.pl gov.pl edu co.uk test example invalid local mil.pl".split())
        at = r.choices(["@", " @ ", "[at]", " [at] ", "(at)", " (at) ", " at "], [80, 4, 4, 3, 3, 4, 1])[0]
        text = user + at + host
        if at != "@" and r.random() < 0.15:
            text = text.replace(".", r.choice([" dot ", "(dot)", "[dot]", " . "]))
        return text.upper() if r.random() < 0.1 else text

    def _grouped(self, n: int) -> str:
        """n digits in groups, as people write a number."""
        r, left, groups = self.r, n, []
        size = r.choice([2, 3, 3])
        while left:
            k = min(left, size if r.random() < 0.8 else r.choice([2, 3, 4]))
            groups.append(self.digits(k))
            left -= k
        return r.choice([" ", " ", " ", "-", ".", "", " "]).join(groups)

    def phone(self, lang: str) -> str:
        r = self.r
        code, n = {"pl": ("48", 9), "de": ("49", r.choice([9, 10, 10, 11])), "fr": ("33", 9), "es": ("34", 9), "en": ("44", 10)}[lang]
        x = r.random()
        if x < 0.3:
            body = self._grouped(n)
            return r.choice([f"+{code}", f"00{code}", f"+{code} ", f"+{code} ", f"00{code} ", f"(+{code}) ", f"({code}) ", f"+{code}-"]) + body
        if x < 0.4:
            return f"+{code} (0){r.choice(['', ' '])}{self._grouped(n - 1)}"
        if x < 0.52:
            k = r.choice([2, 2, 3, 4])
            return f"({r.choice(['', '0'])}{self.digits(k)}){r.choice([' ', '', ' '])}{self._grouped(n - k)}"
        if lang in ("de", "en") or x < 0.58:
            k = r.choice([2, 3, 3, 4])
            return f"0{self.digits(k)}{r.choice(['/', ' ', '-', ' / '])}{self._grouped(n - k)}"
        if lang == "fr":
            return r.choice([" ", " ", ".", "-", ""]).join([f"0{r.randint(1, 9)}", *(self.digits(2) for _ in range(4))])
        if lang == "pl":
            sep = r.choice([" ", " ", "-", "-", "", "."])
            groups = r.choice([(3, 3, 3), (3, 3, 3), (2, 3, 2, 2), (3, 2, 2, 2)])
            return sep.join(self.digits(k) for k in groups)
        return r.choice("6789") + self.digits(2) + r.choice([" ", " ", "-", ""]).join(["", *(self.digits(k) for k in r.choice([(3, 3), (2, 2, 2)]))])

    def pesel(self) -> str:
        r = self.r
        year, month = r.choice([(r.randint(30, 99), r.randint(1, 12)), (r.randint(0, 12), r.randint(21, 32))])
        body = f"{year:02d}{month:02d}{r.randint(1, 28):02d}{self.digits(4)}"
        return body + str(-sum(int(a) * b for a, b in zip(body, (1, 3, 7, 9) * 3, strict=False)) % 10)

    def natural_id(self, lang: str) -> str:
        r, d = self.r, self.digits
        letter = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTWXYZ") for _ in range(n))
        if lang == "pl":
            return self.pesel() if r.random() < 0.65 else letter(r.choice([3, 3, 3, 2])) + r.choice([" ", " ", ""]) + d(r.choice([6, 6, 7]))
        if lang == "de":
            return r.choice([f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"{letter(1)}{d(2)}{letter(2)}{d(4)}"])
        if lang == "fr":
            n = [r.choice("12"), d(2), f"{r.randint(1, 12):02d}", f"{r.randint(1, 95):02d}", d(3), d(3), d(2)]
            return r.choice([" ", " ", ""]).join(n if r.random() < 0.8 else n[:-1])
        if lang == "es":
            return r.choice([f"{d(8)}{r.choice(['', '-', ' '])}{letter(1)}", f"{r.choice('XYZ')}{r.choice(['', '-'])}{d(7)}{r.choice(['', '-'])}{letter(1)}", f"{d(2)}.{d(3)}.{d(3)}-{letter(1)}"])
        return r.choice([f"{letter(2)} {d(2)} {d(2)} {d(2)} {letter(1)}", f"{letter(2)}{d(6)}{letter(1)}", f"{d(3)}-{d(2)}-{d(4)}", d(9)])

    def street(self, lang: str) -> str:
        """A street by name, without number."""
        r, name = self.r, (self.word() + r_end(self.r, lang)).capitalize()
        if r.random() < 0.12:
            name = f"{r.choice(GIVEN[lang])} {self.surname(lang)}"
        elif r.random() < 0.15:
            name += " " + self.word().capitalize()
        if lang == "pl":
            return f"{pick(r, 'ul.|ul.|ul.|ul|ulica|ulicy|al.|aleja|Al.|pl.|plac|os.|osiedle|rondo|skwer')} {r.choice(['', '', '', '', r.choice(['1', '3', '11', '29']) + ' '])}{name}"
        if lang == "de":
            return r.choice([f"{name}{pick(r, 'str.|straße|strasse|weg|gasse|platz|allee|ring|damm|ufer')}", f"{pick(r, 'Am|An der|Im|Zum|Auf dem|Alte')} {name}{pick(r, '|weg|platz|berg|tor|allee|graben')}", f"{name}{pick(r, 'er Str.|er Straße|er Weg|-Straße|-Platz')}"])
        if lang == "fr":
            return f"{pick(r, 'rue|rue|rue|avenue|av.|boulevard|bd|chemin|place|quai|allée|impasse|route|cours')} {pick(r, 'de |du |des |de la |de l’|d’||')}{name}"
        if lang == "es":
            return f"{pick(r, 'Calle|C/|calle|Avda.|Avenida|Av.|Plaza|Pza.|Paseo|Ronda|Camino|Travesía')} {pick(r, 'de |del |de la ||')}{name}"
        return f"{name} {pick(r, 'Street|St|Road|Rd|Lane|Avenue|Close|Drive|Way|Square|Terrace|Court')}"

    def address(self, lang: str) -> str:
        r, n = self.r, str(self.r.choice([self.r.randint(1, 30), self.r.randint(1, 250)]))
        street = self.street(lang)
        if lang == "pl":
            text = f"{street} {n}" + r.choice(["", "", "", r.choice(["a", "b", "A", "B", "C"]), f"/{r.randint(1, 90)}", f"/{r.randint(1, 90)}", f" m. {r.randint(1, 90)}", f" m.{r.randint(1, 90)}", f" lok. {r.randint(1, 40)}", f"-{r.randint(2, 90)}"])
        elif lang == "de":
            text = f"{street} {n}" + r.choice(["", "", "", "a", " b", f"-{r.randint(2, 90)}"])
        elif lang == "fr":
            text = f"{n}{r.choice(['', '', '', ' bis', ' ter', ' B'])}{r.choice([' ', ' ', ', '])}{street}"
        elif lang == "es":
            text = f"{street}{r.choice([' ', ' ', ', ', ', nº ', ' n.º '])}{n}" + r.choice(["", "", "", f", {r.randint(1, 9)}º {r.choice('ABCD')}", f", {r.randint(1, 9)}º"])
        else:
            text = r.choice([f"{n} {street}", f"{n} {street}", f"Flat {r.randint(1, 40)}, {n} {street}"])
        return text.upper() if r.random() < 0.12 else text

    def postcode(self, lang: str) -> str:
        r, d = self.r, self.digits
        return {"pl": f"{d(2)}-{d(3)}", "en": f"{r.choice(['SW', 'M', 'LS', 'EH', 'B'])}{r.randint(1, 30)} {d(1)}{r.choice(['AB', 'QT', 'XY'])}"}.get(lang, d(5)) + " " + self.word().capitalize()

    # --- what is no personal data --------------------------------------------------------------------------------
    def code(self) -> str:
        """A number or code as goods, contracts and companies bear them."""
        r, d = self.r, self.digits
        letter = lambda: r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return r.choice([
            lambda: d(r.randint(4, 14)), lambda: "-".join(d(r.choice([2, 3, 3, 4, 5])) for _ in range(r.randint(2, 4))), lambda: " ".join(d(3) for _ in range(3)), lambda: "/".join([d(r.randint(1, 4)), str(r.randint(2015, 2030))]),
            lambda: f"{letter()}{d(r.randint(2, 7))}", lambda: f"{letter()}{letter()}-{d(3)}-{letter()}{d(3)}", lambda: f"{d(4)}-{d(2)}-{d(3)}-{d(4)}", lambda: f"{d(r.choice([2, 3]))}/{r.randint(2015, 2030)}/{letter()}{letter()}", lambda: f"{d(8)}-{d(1)}", lambda: f"{r.randint(2015, 2030)}/S {d(3)}-{d(6)}",
            lambda: f"{d(3)}-{d(3)}-{d(2)}-{d(2)}", lambda: f"{d(4)}.{d(4)}/{d(2)}", lambda: f"PL{d(10)}", lambda: f"DE{d(9)}", lambda: f"{d(3)} {d(3)} {d(3)} {d(5)}", lambda: f"{letter()}{letter()}{letter()}.{d(3)}.{d(2)}.{r.randint(2015, 2030)}", lambda: f"0{d(1)}/{d(7)}", lambda: f"ISO {d(4)}:{r.randint(1998, 2025)}",
        ])()

    def figure(self) -> str:
        r = self.r
        return r.choice([
            lambda: f"{r.randint(2, 9000)} {pick(r, 'szt.|kg|m|mm|km|l|zł|EUR|PLN|Stück|pcs|unités|uds.|%|kpl.|t|V|kW|miesięcy|dni|Monate|mois|meses')}", lambda: f"{r.randint(1, 31):02d}.{r.randint(1, 12):02d}.{r.randint(2015, 2030)}", lambda: f"{r.randint(2015, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(7, 20)}:{r.choice(['00', '15', '30', '45'])}",
            lambda: f"{r.randint(1, 999)} {r.randint(100, 999)},{self.digits(2)} {pick(r, 'zł|EUR|€')}", lambda: f"{self.word().capitalize()}-{r.randint(1, 999)}", lambda: f"{r.randint(2, 60)} x {r.randint(2, 900)}", lambda: f"{r.randint(1, 99)},{self.digits(2)} mm", lambda: f"@ {r.randint(1, 90)} {pick(r, 'zł|EUR')}", lambda: f"@{self.word()}", lambda: f"@{self.word()}_{self.word().capitalize()}", lambda: f"{self.word().capitalize()} {self.word()}",
        ])()

    def lookalike(self, lang: str) -> str:
        r, x = self.r, self.r.random()
        if x < 0.5:
            return f"{pick(r, LEADS[lang])}{r.choice([' ', ' ', ': ', ' nr '])}{self.code()}"
        if x < 0.68:
            name = r.choice(GIVEN[lang])
            name = r.choice([name, f"{name}-{r.randint(1, 2030)}", f"{name} {r.choice(['II', 'III', 'IV'])}"])
            return f"{pick(r, THINGS[lang])} {r.choice(['„%s”', '\"%s\"', '«%s»', '%s', '„%s”']) % name}"
        if x < 0.85:
            return f"{pick(r, WORKS[lang])} {self.street(lang)}" + r.choice(["", "", f" {pick(r, 'jest|w|na odcinku|ist|est|es|is')} {r.choice(WORDS[lang])}"])
        if x < 0.9:
            return f"{pick(r, 'termin|w terminie|po|Frist|délai|plazo|within')} {r.randint(1, 90)} {pick(r, 'dni|Tage|jours|días|days')}{r.choice([', ', ' '])}{pick(r, 'godz.|o godz.|um|à|a las|at')} {r.randint(7, 18)}{r.choice([':', '.'])}{r.choice(['00', '10', '15', '30', '40'])}"
        if x < 0.95:
            return f"{pick(r, 'kod pocztowy |PLZ |code postal |C.P. ||')}{self.postcode(lang)}"
        return self.firm(lang)

    def goods(self, lang: str) -> str:
        """What is bought, with a model or a quantity."""
        r = self.r
        words = [r.choice(WORDS[lang]) for _ in range(r.choice([1, 2, 2, 3]))]
        model = r.choice([f"{self.word().capitalize()}-{r.randint(1, 999)}", f"{self.word().capitalize()}-{r.randint(1, 999)}", f"{self.word().capitalize()} {r.randint(1, 999)}", f"{self.word().upper()}-{r.randint(1, 99)}{r.choice('ABC')}", self.word().capitalize()])
        text = " ".join([*words, model])
        if r.random() < 0.5:
            text = f"{r.choice(WORDS[lang]).capitalize()}{r.choice([': ', ' – ', ' '])}{text}"
        return text

    def loose(self, lang: str, n: int) -> str:
        """Words in any order, with what texts of goods hold."""
        r, out = self.r, []
        for _ in range(n):
            x = r.random()
            out.append(r.choice(WORDS[lang]) if x < 0.7 else r.choice([str(r.randint(2, 60)), f"{r.choice(WORDS[lang]).capitalize()} {r.randint(2, 90)}"]) if x < 0.78 else self.word() if x < 0.83 else self.word().capitalize() if x < 0.89 else self.figure() if x < 0.97 else self.code())
            if r.random() < 0.08:
                out[-1] += r.choice([",", ";", ":", " –", ".", " -"])
            elif r.random() < 0.03:
                out[-1] = f"({out[-1]})"
        text = " ".join(out)
        return text[:1].upper() + text[1:] if r.random() < 0.7 else text

    # --- businesses ----------------------------------------------------------------------------------------------
    def firm(self, lang: str) -> str:
        r = self.r
        cap = lambda: self.word().capitalize()
        own = r.choice([f"{cap()} {cap()}", f"{cap()} {cap()}", f"{cap()}-{self.word()}", f"{cap()} {cap()} {cap()}", self.word().capitalize(), self.word().capitalize() + self.word(), f"{self.word().capitalize()} {self.word().capitalize()}", f"{self.word().capitalize()}-{self.word().capitalize()}", self.surname(lang), "".join(r.choice("ABCDEFGHKLMNPRSTW") for _ in range(r.choice([2, 3, 4])))])
        kind = pick(r, BUSINESS) if r.random() < 0.5 else self.sound(r.choice([1, 2])).capitalize() + pick(r, "ics|ments|tek|ik|mer|tas|ine|aero|sys|tron|lux|max|nik|pol|ex|al|on|us|is|ia")
        if r.random() < 0.1:
            kind = kind[: r.choice([3, 4, 5])] + "."
        parts = [own, kind if r.random() < 0.8 else "", pick(r, LEGAL)]
        if r.random() < 0.3:
            parts[:2] = parts[1::-1]
        text = " ".join(x for x in parts if x)
        if r.random() < 0.15:
            text = f"{pick(r, TRADES[lang])} {text}"
        if r.random() < 0.1:
            text += f" {pick(r, '-|–|,|(')} {pick(r, 'Filiale|oddział|Niederlassung|agence|sucursal|branch|dział|nr|Werk|division|zakład|usine')} {r.choice([self.word().capitalize(), self.digits(1), r.choice(WORDS[lang]).capitalize()])}"
        elif r.random() < 0.08:
            text += r.choice(["_", "_", " #", " / "]) + self.digits(r.choice([3, 4, 6, 7]))
        x = r.random()
        return text.upper() if x < 0.12 else text.lower() if x < 0.16 else text

    def business(self, lang: str) -> list[tuple[str, str]]:
        r = self.r
        if r.random() < 0.55:
            out = [(r.choice(["", "", "", "", pick(r, "Consortium |Konsortium: |UTE |Groupement |Lider: |Messrs ")]) + self.firm(lang), "")]
        else:
            trade, own = pick(r, TRADES[lang]), r.choice([self.word().capitalize() + self.word(), self.word().capitalize(), self.word().upper(), ""])
            own = r.choice(["%s", "„%s”", '"%s"', "«%s»", "%s"]) % own if own else ""
            mark = " ".join(x for x in r.choice([(trade, own), (own, trade)]) if x)
            person = self.person(lang, 1.0)
            while "," in person:
                person = self.person(lang, 1.0)
            sep = r.choice([" ", " ", " ", " - ", " – ", ", "])
            out = r.choice([[(mark + sep, ""), (person, "PERSON_NAME")], [(person, "PERSON_NAME"), (sep + mark, "")], [(person, "PERSON_NAME"), (sep + mark, "")]])
            if r.random() < 0.12:
                out += [(" " + pick(r, LEGAL), "")]
        while r.random() < 0.33:
            kind = r.choice(["PHONE", "PHONE", "EMAIL", "ADDRESS", "ID_NUMBER"])
            out += [(r.choice([", ", " - ", "; ", " ", " – ", " / "]), ""), *self.stated(kind, lang, 0.5)]
        if r.random() < 0.08:
            out += [(r.choice([", ", " - ", "; "]) + self.lookalike(lang), "")]
        return out

    # --- pieces and texts ----------------------------------------------------------------------------------------
    def value(self, kind: str, lang: str) -> str:
        return {"EMAIL": self.email, "PHONE": self.phone, "ID_NUMBER": self.natural_id, "ADDRESS": self.address, "PERSON_NAME": self.person}[kind](lang)

    def stated(self, kind: str, lang: str, labelled: float = 0.8) -> list[tuple[str, str]]:
        """A value with or without its label. Numbers of persons are hardly told from others without."""
        r = self.r
        if r.random() > (0.93 if kind == "ID_NUMBER" else labelled):
            return [(self.value(kind, lang), kind)]
        label = pick(r, LABELS[kind][lang])
        if r.random() < 0.12:
            label += r.choice([" i ", "/", " / ", ", "]) + pick(r, LABELS[kind][lang])
        if r.random() < 0.15:
            label = " ".join(r.choice(WORDS[lang]) for _ in range(r.choice([1, 2]))) + ("" if kind in ("PERSON_NAME", "ADDRESS", "EMAIL") and r.random() < 0.5 else " " + label)
        if r.random() < 0.2:
            label = label[:1].upper() + label[1:] if r.random() < 0.6 else label.upper()
        out = [(label + r.choice([" ", " ", ": ", ": ", " – ", " - ", ":"]), ""), (self.value(kind, lang), kind)]
        if kind == "ADDRESS" and r.random() < 0.4:
            place = self.postcode(lang)
            out = [*out, (r.choice([", ", " ", "; "]) + place, "")] if r.random() < 0.65 else [(out[0][0] + place + r.choice([", ", " ", "; "]), ""), out[1]]
        return out

    def told(self, lang: str) -> list[tuple[str, str]]:
        """One to four values in a row, as a contact line has them."""
        r = self.r
        out: list[tuple[str, str]] = []
        for k in range(r.choices([1, 2, 3, 4], [5, 5, 2, 0.6])[0]):
            kind = r.choices(["PERSON_NAME", "PHONE", "EMAIL", "ADDRESS", "ID_NUMBER"], [5, 3, 2.6, 2.6, 2])[0]
            sep = r.choice([", ", ", ", "; ", " ", " / ", " – ", "\n", ". ", pick(r, " lub | i | oder | und | ou | et | o | y | or | and | oraz ")]) if k else ""
            part = self.stated(kind, lang)
            if k and r.random() < 0.15:
                part = [(" (", ""), *part, (")", "")]
                sep = ""
            out += [(sep, ""), *part]
        if r.random() < 0.35:
            out = [(self.loose(lang, r.choice([1, 2, 3])) + " ", ""), *out]
        if r.random() < 0.35:
            out += [(r.choice([" ", " ", ", "]) + " ".join(r.choice(WORDS[lang]) for _ in range(r.choice([1, 2, 4]))), "")]
        return out

    def order(self) -> list[tuple[str, str]]:
        r, lang = self.r, self.lang()
        out: list[tuple[str, str]] = []
        for k in range(r.choices([1, 2, 3, 4, 6], [3, 5, 4, 2, 0.6])[0]):
            x = r.random()
            piece = [(self.goods(lang), "")] if x < 0.15 else [(self.loose(lang, r.choice([1, 2, 3, 5, 8, 12, 18])), "")] if x < 0.45 else self.told(lang) if x < 0.83 else [(self.lookalike(lang), "")]
            if k:
                sep = r.choice([". ", ". ", ", ", "; ", " – ", "\n", " ", " ", " ", " ", ": ", " - ", ".. ", " / "])
                piece = [(" (", ""), *piece, (")", "")] if r.random() < 0.12 else [(sep, ""), *piece]
            out += piece
        if r.random() < 0.4:
            out.append((r.choice([".", ".", "!", ";", " "]), ""))
        return out

    def write(self) -> tuple[str, list[tuple[int, int, str]]]:
        pieces = self.business(self.lang()) if self.r.random() < 0.36 else self.order()
        text, spans = "", []
        for s, kind in pieces:
            if kind:
                spans.append((len(text), len(text) + len(s), kind))
            text += s
        return text, spans


def r_end(r: random.Random, lang: str) -> str:
    """Endings of street names."""
    return r.choice({"pl": ["ska", "owa", "na", "cka", "skiego", "ego", "a", "ów", "wa"], "de": ["", "er", "en", "burg", "hof"], "fr": ["", "s", "es", "y"], "es": ["", "a", "os", "al"], "en": ["", "ton", "field", "s"]}[lang])
