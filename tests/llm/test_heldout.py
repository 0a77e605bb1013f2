"""Recall of personal information on sentences that were written apart from the detectors and from the tables.

Each line is kind, language and a sentence with the value in double braces.
"""

import re
from collections import defaultdict

import pytest

pytest.importorskip("studflow.llm")
from studflow.llm import personal  # noqa: E402

SENTENCES = """
email|en|You can always reach me under {{laura.bianchi@brickmail.org}} in the evening.
email|en|My new address is {{j.smith+club@uni.example.co.uk}}, the old one bounces.
email|en|Mails to {{info_desk@south-hall.museum}} were never answered.
email|en|He signs as {{tom at brickhub dot net}} in the forum.
email|en|Contact: {{support[at]partsbin[dot]com}} (weekdays only)
email|en|The list owner is {{owner (at) lists.example.edu}}.
email|en|I forwarded it to {{r2d2@droids.io}} and waited.
email|en|<{{mary-ann@post.example}}> wrote that the wheels are loose.
email|en|Please unsubscribe {{old.account.99@webmail.test}}!
email|en|jane can be found as {{jane_AT_mail_DOT_com}} these days.
email|en|Use {{john dot smith at mail dot com}} for the invoice.
email|de|Schreib mir doch an {{k.vogel@post.example.de}}, dann schicke ich die Liste.
email|de|Die Adresse lautet {{petra(at)steinwelt.example}} und wird täglich gelesen.
email|de|Rückmeldungen bitte an {{werkstatt@bau-freunde.example}}.
email|de|Unter {{m.huber [at] verein [punkt] at}} erreicht man den Vorstand.
email|de|Ich habe {{info@modellbau-nord.example}} schon zweimal angeschrieben.
email|de|Meine Mailadresse: {{lena99@kasten.example.org}}
email|fr|Écrivez à {{camille.durand@courriel.example.fr}} avant vendredi.
email|fr|Mon adresse est {{j.petit@boite.example}}, merci de répondre vite.
email|fr|Le club répond à {{contact@briques-du-sud.example}} en deux jours.
email|fr|Envoyez le plan à {{atelier (arobase) briques.example}} ou par la poste.
email|fr|Pour les pièces, {{pieces@depot.example.fr}} suffit.
email|es|Escríbeme a {{lucia.romero@correo.example.es}} cuando puedas.
email|es|Mi correo es {{paco_77@buzon.example}} y lo leo cada noche.
email|es|El pedido se confirma en {{ventas@ladrillos.example.com}}.
email|es|Manda las fotos a {{taller [arroba] piezas [punto] es}} por favor.
email|es|Sin respuesta de {{soporte@tienda.example.es}} desde el lunes.
phone|en|Call me on {{+1 (202) 555-0143}} after six.
phone|en|The shop's number is {{(415) 555-0132}}, ask for the back room.
phone|en|Ring {{020 7946 0958}} if the parcel is late.
phone|en|Her mobile is {{+44 7700 900123}}.
phone|en|Text {{312-555-0187}} with the part number.
phone|en|Fax: {{+1 212 555 0100}}
phone|en|Dial {{001 604 555 0199}} from abroad.
phone|en|My landline, {{01632 960983}}, still works.
phone|en|Reach the desk at {{202.555.0170}} until noon.
phone|en|New number: {{+353 1 555 0123}}.
phone|de|Ruf mich unter {{0170 1234567}} an, am besten abends.
phone|de|Telefon {{030 9018 2345}}, Zimmer vier.
phone|de|Meine Nummer ist {{+49 89 5550123}}.
phone|de|Handy: {{0151/23456789}}
phone|de|Wir sind unter {{(0221) 4710 123}} zu erreichen.
phone|de|Aus der Schweiz {{+41 44 668 18 00}} wählen.
phone|de|Tel.: {{0043 1 5550178}}
phone|fr|Appelez le {{01 42 68 53 00}} pour réserver.
phone|fr|Mon portable : {{06 12 34 56 78}}.
phone|fr|Le numéro est {{+33 1 70 18 99 00}}, demandez le magasin.
phone|fr|Joignable au {{04.91.55.01.23}} le matin.
phone|fr|Depuis la Belgique : {{0032 2 555 12 12}}
phone|fr|Tél. {{+33 (0)3 88 55 01 44}}
phone|es|Llámame al {{+34 612 345 678}} mañana.
phone|es|El teléfono es {{0034 91 555 01 23}}.
phone|es|Mi móvil nuevo: {{+34 699 55 01 02}}
phone|es|Desde México marca {{+52 55 5550 1234}}.
phone|es|Tel. {{+34 93 555 12 34}}, de nueve a dos.
id_number|en|Her SSN is {{219-09-9999}}, do not share it.
id_number|en|Passport {{GB1234567}} was left at the desk.
id_number|en|National insurance number {{AB 12 34 56 C}} on the form.
id_number|en|Social security number: {{078 05 1120}}.
id_number|en|My passport number is {{X12345678}}.
id_number|en|Tax number {{98 765 432 101}} appears twice.
id_number|en|Identity card {{L8988901C}} expires soon.
id_number|en|The insurance number {{QQ123456B}} is hers.
id_number|de|Meine Steuer-ID {{86 095 742 719}} steht oben.
id_number|de|Steuernummer: {{21 815 08150}}
id_number|de|Personalausweis {{T220001293}} liegt bei.
id_number|de|Reisepass {{C01X00T47}} ist abgelaufen.
id_number|de|Ausweisnummer {{L01X00T471}} eintragen.
id_number|de|Die Steuer-ID lautet {{12345678911}}.
id_number|fr|Passeport n° {{12AB34567}} perdu hier.
id_number|fr|Numéro fiscal {{12 34 567 890 123}} à vérifier.
id_number|fr|Pièce d'identité n° {{880692310285}} fournie.
id_number|fr|Mon passeport {{09PP12345}} est valable.
id_number|fr|Le numéro fiscal {{1234567890123}} manque.
id_number|es|DNI {{12345678Z}} adjunto.
id_number|es|Mi NIE es {{X1234567L}}.
id_number|es|Pasaporte {{AAA123456}} caducado.
id_number|es|NIF: {{87654321-X}} en la factura.
id_number|es|Documento de identidad {{45 678 901 234}} revisado.
address|en|Send the box to {{12 Baker Street, London NW1 6XE}} by Friday.
address|en|We moved to {{4410 Oak Avenue, Springfield, IL 62704}} last year.
address|en|The workshop is at {{7 Mill Lane, Norwich}}.
address|en|Deliver to {{221B Park Road, Leeds LS1 4AP}} please.
address|en|Her flat, {{18 Queen's Court, Flat 3, Bristol}}, is upstairs.
address|en|Meet at {{900 West Lake Drive, Apt. 12, Austin, TX 78701}}.
address|en|Write to {{35 Long Acre Way, Dublin}} for a catalogue.
address|en|I live at {{2 Church Close, Oxford OX4 1AB}}.
address|en|Returns: {{1500 Industrial Boulevard, Newark, NJ 07102}}
address|de|Schick es an {{Lindenstraße 14, 10969 Berlin}}.
address|de|Wir wohnen {{Am Markt 3, 99084 Erfurt}}.
address|de|Die Werkstatt: {{Gartenweg 7a, 80331 München}}.
address|de|Abholung {{Alte Gasse 22, 60313 Frankfurt}} ab zehn.
address|de|Unser Lager liegt {{Bahnhofsplatz 1, 70173 Stuttgart}}.
address|de|Paket an {{Goetheallee 55, 22765 Hamburg}} verschickt.
address|de|Treffpunkt ist {{An der Alster 12, 20099 Hamburg}}.
address|de|Adresse: {{Schillerstr. 8, 04109 Leipzig}}
address|de|Besuch uns in {{Kirchplatz 9, 48143 Münster}}!
address|fr|Livrez au {{12 rue de la Paix, 75002 Paris}}.
address|fr|J'habite {{3 bis avenue Victor Hugo, 69006 Lyon}}.
address|fr|Le local est {{45, boulevard de la Mer, 06300 Nice}}.
address|fr|Envoyez tout au {{8 place du Marché, 67000 Strasbourg}}.
address|fr|Rendez-vous {{27 quai des Belges, 13001 Marseille}}.
address|fr|Adresse : {{101 chemin des Vignes, 31400 Toulouse}}
address|fr|Notre dépôt, {{5 impasse des Lilas, 44000 Nantes}}, ferme tôt.
address|es|Envíalo a {{Calle Mayor 15, 28013 Madrid}}.
address|es|Vivo en {{Avenida de la Constitución 4, 41001 Sevilla}}.
address|es|El taller está en {{Plaza de España 2, 50001 Zaragoza}}.
address|es|Recogida: {{Paseo del Prado 30, 28014 Madrid}}
address|es|Nos vemos en {{Calle de Alcalá 101, 3º A, 28009 Madrid}}.
address|es|La tienda, {{Ronda Norte 8, 30009 Murcia}}, abre a las nueve.
address|es|Spedire a {{Via Roma 12, 00184 Roma}} senza firma.
name|en|My friend {{Laura Bianchi}} lives here.
name|en|Best,\\n{{Maria Lopez}}
name|en|Sincerely, {{Tom Baker}}
name|en|Regards\\n{{John Smith}}
name|en|I met {{Jean Dupont}} yesterday.
name|en|Yesterday {{Sarah Connolly}} brought the missing wheels.
name|en|Dear Mr. {{Whitfield Barnes}}, your order is ready.
name|en|Thank you, {{Priya Raman}}, for the instructions.
name|en|The tower was designed by {{Emily Stanhope}} in a week.
name|en|According to {{Dr. Alan Merrick|Alan Merrick}} the hinge is too weak.
name|en|Signed: {{Grace O'Neill}}
name|en|From: {{Peter van Houten}}
name|en|{{Michael J. Carter}} wrote a long review.
name|en|Photos by {{Hannah Weiss}} and a friend.
name|en|Ask {{Oliver Kent}} for the key.
name|en|We saw {{James McAllister}} at the fair.
name|en|Hello {{Rebecca Lindqvist}}, welcome to the club.
name|en|The prize went to {{Daniel Okafor}} again.
name|en|{{Thomas Greene}} said it would hold.
name|en|Spoke with {{Ines Carvalho}} about the delivery.
name|de|Liebe {{Monika Schäfer}}, vielen Dank für das Bild.
name|de|Mit freundlichen Grüßen,\\n{{Stefan Krüger}}
name|de|Herr {{Günter Baumann}} hat die Brücke vermessen.
name|de|Gestern war {{Sabine Vogt}} in der Werkstatt.
name|de|Das Modell stammt von {{Lukas Steinberg}}.
name|de|Frau {{Dr. Heike Albrecht|Heike Albrecht}} leitet den Kurs.
name|de|Laut {{Jürgen Pohl}} fehlen zwei Steine.
name|de|Ich heiße {{Katrin Zimmermann}} und baue Schiffe.
name|de|Hallo {{Markus Engel}}, passt der Termin?
name|de|Unterschrieben von {{Petra Neuhaus}}.
name|de|{{Wolfgang Rieger}} sagte, es sei fertig.
name|de|Danke an {{Birgit Hofmann}} für die Teile.
name|fr|Bonjour {{Camille Lefèvre}}, le colis est parti.
name|fr|Merci à {{Julien Moreau}} pour son aide.
name|fr|Madame {{Hélène Garnier}} préside le jury.
name|fr|Cordialement,\\n{{Philippe Roux}}
name|fr|J'ai rencontré {{Sophie Marchand}} au salon.
name|fr|Le plan vient de {{Antoine Lemaire}}.
name|fr|Selon {{Nathalie Perrin}}, la tour penche.
name|fr|Je m'appelle {{Élodie Fontaine}}.
name|fr|M. {{François Leclerc}} a reconstruit la gare.
name|fr|Monsieur {{Pierre de Villiers}} arrive demain.
name|fr|Cher {{Nicolas Giraud}}, voici la liste.
name|es|Hola {{Carmen Ortega}}, ya llegó la caja.
name|es|Gracias a {{Pablo Navarro}} por las fotos.
name|es|Señor {{Miguel Ángel Torres|Miguel Ángel}}, firme aquí.
name|es|Me llamo {{Lucía Herrero}} y colecciono trenes.
name|es|Saludos,\\n{{Javier Molina}}
name|es|Ayer vi a {{Elena Castillo}} en la feria.
name|es|Según {{Sergio Vidal}} falta una pieza.
name|es|Estimada {{Marta Iglesias}}, adjunto el plano.
name|es|La maqueta es de {{Alejandro Ruiz}}.
name|es|Mi amiga {{Rosa Delgado}} vive en Cádiz.
name|es|Don {{Enrique Salas}} abrió el taller.
phone|en|My extension moved to {{(646) 555-0109}} last week.
phone|de|Unsere Hotline {{0800 5550123}} ist kostenlos.
phone|fr|Standard : {{+32 2 555 01 01}}, poste douze.
phone|es|Whatsapp {{+34 655 01 23 45}} solo tardes.
email|en|Backup contact is {{e.okafor@night-shift.example}} now.
email|de|Fragen beantwortet {{frage@steinebox.example}} gern.
email|fr|Répondez à {{secretariat@musee.example.fr}} directement.
email|es|Dudas a {{dudas@club-piezas.example}} antes del jueves.
id_number|en|Passport no. {{LK7654321}} stamped twice.
id_number|de|Ausweis {{L22N01T45}} vorgelegt.
id_number|fr|Numéro fiscal : {{30 23 217 600 053}}
id_number|es|NIF {{11223344-B}} correcto.
address|en|Parcel for {{64 Harbour View Terrace, Cork}} returned.
address|de|Post an {{Rosenweg 31, 93047 Regensburg}} bitte.
address|fr|Au {{19 cours Lafayette, 69003 Lyon}} sonnez deux fois.
address|es|Mandar a {{Camino Viejo 6, 46010 Valencia}} hoy.
name|en|Then {{Bronwyn Tadgell}} turned the crank.
name|en|Neighbour {{Oswin Prakash}} lent us the truck.
name|en|Hi {{Tamsin Achebe}}, did the pins fit?
name|en|Checked by {{Rhodri Vance}} on arrival.
name|de|Abends kam {{Thorben Quast}} vorbei.
name|de|Mein Name ist {{Swantje Petersen}}.
name|de|Sehr geehrte Frau {{Annegret Wohlleben}}, anbei der Plan.
name|fr|Hier {{Maëlys Tanguy}} a dit oui.
name|fr|Construit par {{Gwenaëlle Le Bris|Gwenaëlle Le}} en mai.
name|fr|Vérifié par {{Yannick Ollivier}}.
name|es|Hola {{Nerea Etxeberria}}, gracias.
name|es|Construido por {{Iker Zabaleta}} en abril.
name|es|Ayer {{Ainhoa Goñi}} trajo el motor.
email|en|Ping {{q.zed_4@deep.sub.example.io}} about it.
email|de|Antworten an {{noreply-2@haus.example}} gehen verloren.
phone|en|The museum line {{+1 415 555 0111}} is busy.
phone|de|Unter {{+43 660 1234567}} meldet sich niemand.
phone|fr|Rappelez {{06.98.76.54.32}} ce soir.
id_number|de|Meine Steuer-ID ist {{65 929 970 489}}.
id_number|en|Her passport {{PA9876543}} is blue.
id_number|es|Su pasaporte {{XDB654321}} llegó tarde.
address|en|Our club meets at {{80 Station Road, Derby DE1 2RR}} monthly.
address|de|Der Laden {{Marktstraße 2, 97070 Würzburg}} schließt.
name|en|Cheers, {{Frank Delaney}}
name|de|Gruß, {{Dieter Lang}}
name|fr|Amicalement, {{Claire Aubert}}
name|es|Atentamente, {{Isabel Prieto}}
"""
#: Nothing personal in these.
PLAIN_SENTENCES = """
Mating: stud@hole at 3.0 units, build 20240117.
The Grand Harbour Crane needs 1204 parts and 36 pins.
Step 12: add Slab 2 x 4 to the left wall.
Version 2.14.0 of the Castle Keep was released on 2024-01-17.
Part 3001 costs 0.12, part 3002 costs 0.15.
Die Große Brücke hat 88 Teile.
La Tour Rouge compte 412 pièces.
El Castillo Blanco tiene 77 ventanas.
Order 4071-22-018 is still open.
Walk down Oak Street until the Old Mill.
Coordinates (120, 555, 48) are off by one.
The Night Tram came second, Quay Arcade won.
"""


def cases():
    for line in SENTENCES.strip().split("\n"):
        kind, language, text = line.split("|", 2)
        text = text.replace("\\n", "\n")
        want = re.search(r"\{\{(.*?)\}\}", text)[1]
        shown, _, value = want.partition("|")
        yield kind, language, text.replace("{{" + want + "}}", shown), value or shown


def recall():
    hit, missed = defaultdict(lambda: [0, 0]), []
    for kind, language, text, value in cases():
        got = [(k, personal.value(text[a:b])) for a, b, k in personal.resolved(personal.detect(text), set())]
        ok = (kind, value) in got
        hit[kind][0] += ok
        hit[kind][1] += 1
        if not ok:
            missed.append((kind, language, text, value, got))
    return hit, missed


def test_recall_on_other_sentences():
    assert len(list(cases())) >= 200 and {c[1] for c in cases()} == {"en", "de", "fr", "es"}
    hit, missed = recall()
    for kind in personal.KINDS:
        assert hit[kind][0] >= 0.9 * hit[kind][1], (kind, hit[kind], missed)


def test_nothing_in_plain_sentences():
    for text in PLAIN_SENTENCES.strip().split("\n"):
        assert personal.detect(text) == [], text
