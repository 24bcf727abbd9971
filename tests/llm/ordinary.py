"""Ordinary sentences of letters and notes, written by hand, with their personal data marked. They are not trained on;
what earlier states missed in them showed which neighbourhoods the training texts lacked, so they are no blind test."""

import re

SENTENCES = """
Please call [PERSON_NAME:John Smith] on [PHONE:020 7946 0958] before Friday.
[PERSON_NAME:Rachel Goldberg] lives at [ADDRESS:14 Abbey Road], not far from Abbey Wood.
Send the invoice to [EMAIL:m.harris@example.org] or to the office in Leeds.
The meeting with Mr [PERSON_NAME:David Thompson] was moved to 14:30 on 3 May.
Order 4711-22 holds 300 pumps and 12 engines, delivery within 30 days.
Her phone is [PHONE:+44 7700 900123]; her sister's is [PHONE:07700 900456].
The storm Emily closed the road for 3 days.
Regards, [PERSON_NAME:Susan Miller], [EMAIL:susan.miller@post.example]
Bitte wenden Sie sich an [PERSON_NAME:Friedrich Vogel], Telefon [PHONE:030 1234567].
Frau [PERSON_NAME:Ingrid Schuster] wohnt in der [ADDRESS:Lindenstraße 8] in 50674 Köln.
Der Vertrag Nr. 2023/118 läuft am 31.12.2026 aus.
Die Rechnung geht an [PERSON_NAME:Bernd Lange], [ADDRESS:Am Stadtpark 21], [EMAIL:b.lange@firma.example].
Das Schiff „Elisabeth“ liegt seit 2 Tagen im Hafen.
Rückfragen unter [PHONE:+49 221 998877] oder per Mail an [EMAIL:info@rathaus.example].
Die Steuer-ID von [PERSON_NAME:Petra Hoffmann] lautet [ID_NUMBER:47 036 892 816].
Die Firma Nordbau GmbH liefert 200 Stück bis Montag.
Contactez [PERSON_NAME:Sophie Lefebvre] au [PHONE:01 45 67 89 10] pour toute question.
Le dossier est suivi par M. [PERSON_NAME:Julien Moreau], [ADDRESS:12 rue des Lilas], 69003 Lyon.
Les travaux de la rue Victor Hugo durent 6 mois.
Madame [PERSON_NAME:Claire Fontaine] a signé le contrat n° 2024-077.
Écrivez à [EMAIL:claire.fontaine@mairie.example] avant le 5 juin.
Numéro de sécurité sociale : [ID_NUMBER:2 85 05 78 006 084 36].
Le garage est fermé ; le portable de [PERSON_NAME:Pierre Garnier] est le [PHONE:06.12.34.56.78].
Menuiserie Duval et fils livre 40 portes en 15 jours.
Llame a [PERSON_NAME:Carlos Navarro] al [PHONE:91 555 12 34].
La oficina está en [ADDRESS:Calle Mayor 45], 28013 Madrid.
[PERSON_NAME:Lucía Ortega Ruiz], con DNI [ID_NUMBER:12345678Z], firmó ayer.
El expediente 88/2025 tiene 14 páginas y 3 anexos.
Escriba a [EMAIL:ayuda@correo.example] o pase por la [ADDRESS:Plaza del Sol, 3].
El barco Santa María vuelve el lunes.
Sprawę prowadzi pan [PERSON_NAME:Jan Kowalski], tel. [PHONE:22 621 45 67].
Proszę przekazać dokumenty [PERSON_NAME:Annie Nowak] do piątku.
Spotkałem wczoraj [PERSON_NAME:Jana Kowalskiego] na dworcu.
Mieszkam przy [ADDRESS:ul. Długiej 17 m. 4], 00-238 Warszawa.
Numer PESEL pacjentki to [ID_NUMBER:85042312345], a telefon [PHONE:601-234-567].
Faktura FV/12/2025 opiewa na 1 250,00 zł.
Na ulicy Polnej trwa remont chodnika.
Wiadomość wysłała [PERSON_NAME:Katarzyna Zielińska] z adresu [EMAIL:k.zielinska@poczta.example].
Statek „Maria” wypłynął o 6:30.
Zakład Stolarski [PERSON_NAME:Piotr Wrona], [ADDRESS:os. Słoneczne 5/12], NIP 525-000-11-22.
"""
MARK = re.compile(r"\[([A-Z_]+):([^\]]*)\]")


def cases() -> list[tuple[str, set[tuple[int, int, str]]]]:
    out = []
    for line in filter(None, SENTENCES.strip().split("\n")):
        text, at, spans = "", 0, set()
        for m in MARK.finditer(line):
            text += line[at : m.start()]
            spans.add((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out
