"""Train the tagger of `pii.py` from labelled spans: python -m kithgraph.llm.pii_train TABLES_DIR OUT.npz

Two kinds of labelled lines are used, at most LIMIT together (a documented bound: only the classifier is fitted on a
sample). Lines of sources.body and claims.quote are labelled by the forms the tables' personal data take and by the
names of the known people, in any case of letters. Generated lines put spans made by the rules of this module (names
of many languages and scripts, numbers, streets and addresses of many countries) into lines of the tables and into
plain sentences, so that the tagger learns what such things look like and not the people of one table. Some forms are
held out of training altogether; precision and recall of exact spans are measured on held-out lines of the tables and
on the held-out forms.
"""

from __future__ import annotations

import os
import random
import re
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")  # each worker process uses one core
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import numpy as np

from kithgraph.llm import pii
from kithgraph.llm.tagger import PAD, Tagger, encode

LIMIT = 90_000
HIDDEN = 32
HELD = 5_000

_U = "".join(chr(c) for c in range(0x41, 0x250) if chr(c).isupper())
_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
EMAIL = re.compile(r"[\w.+-]+(?:@ ?| ?[\[(]at[\])] ?| at (?=[\w-]+ dot ))[\w-]+(?:(?:\.| ?[\[(]dot[\])] ?| dot )\w+)+")
PHONE = re.compile(
    r"(?<![\w+])(?:\+44 20 7946 0\d{3}|020 7946 0\d{3}|\+1[ -]\d{3}[ -]555[ -]01\d\d(?: ext\. ?\d+)?|\(\d{3}\) 555-01\d\d|\d{3}\.555\.01\d\d|\d{3}55501\d\d|\+49 \(0\)30 23125 \d{3}|\+33199 00\d{4}|01 99 00 \d\d \d\d|\+61 2 5550 \d{4}"
    rf"|{_DIGIT} {_DIGIT} {_DIGIT}, {_DIGIT} {_DIGIT} {_DIGIT}, {_DIGIT} {_DIGIT} {_DIGIT} {_DIGIT})(?!\w)"
)
ID = re.compile(r"(?<![\w.+-])(?:[A-Z]{2}-\d{3}-\d{4}-[A-Z]|X\d{8}|[A-Z]{2} \d\d \d\d \d\d [A-Z]|[A-Z]{2}\d{6}[A-Z]|\d{8}-[A-Z]|\d\d \d{3} \d{3} \d{3}|(?:000|666) \d\d \d{4}|(?:000|666)-\d\d-\d{4})(?![\w-])")
_W = rf"[{_U}][\w'’]+"
STREET = re.compile(
    rf"(?<!\w)(?:\d{{1,4}} (?:{_W} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Terrace|Close|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Blvd|Boulevard)\b(?:, (?:Unit|Suite|Apt|Flat|Floor) \w+|, #\w+)?"
    rf"|\d{{1,3}}(?: bis| ter)?,? (?:rue|avenue|chemin|quai|boulevard|place|allée|impasse) (?:de la |du |des |de l['’]|d['’]|de )?{_W}"
    rf"|(?:Avenida|Calle|Paseo|Plaza|Camino)(?: del| de la| de los| de)? {_W} \d{{1,4}}|(?:(?:Am|Alte|Im|Zum|An der) )?{_W[:-1]}*(?:straße|strasse|weg|allee|gasse|platz|ring) \d{{1,3}}[a-z]?|(?:Am|Im|Zum|Alte|An der) {_W} \d{{1,3}}[a-z]?)(?!\w)"
)
NAME = re.compile(rf"(?<![\w@.+-])(?:(?P<a>[\w'’]+),? (?:[{_U}]\.? )?(?P<b>[\w'’]+)|(?P<c>\w)\.? (?P<d>[\w'’]{{3,}})|(?P<e>[\w'’]{{3,}}),? (?P<f>\w)\b\.?)(?![\w@])")
_LABEL = re.compile(r"^[ \t]*(?:\[[\d:.]+\][ \t]*|>>[ \t]*|<v |\*\*)?([^\n:<>*\[\]()\d]{2,24}[ ,.][^\n:<>*\[\]()\d]{1,32}?)[ \t]*(?::|\*\*|>|[ \t]\d+:\d\d[ \t]*$)")
_WORDS = re.compile(r"[\w'’]+")


def label(text: str, given: set[str], family: set[str]) -> list[tuple[int, int, int]]:
    """(start, end, type number) of the pieces of a line of the tables, by the forms above."""
    taken = np.zeros(len(text) + 1, dtype=bool)
    out = []
    m = _LABEL.match(text)
    speaker = m.span(1) if m else (-1, -1)

    def take(s: int, e: int, kind: int) -> None:
        if not taken[s:e].any():
            taken[s:e] = True
            out.append((s, e, kind))

    for kind, form in enumerate((EMAIL, PHONE, ID, STREET)):
        for m in form.finditer(text):
            take(*m.span(), kind)
    at = 0
    while m := NAME.search(text, at):
        s, e = m.span()
        lower = {k: v.lower() for k, v in m.groupdict().items() if v}
        named = speaker[0] <= s and e <= speaker[1] + 1
        ok = False
        if "a" in lower:
            ok = (lower["a"] in given and lower["b"] in family and "," not in m[0]) or (lower["a"] in family and lower["b"] in given)
        elif "c" in lower:
            ok = lower["d"] in family and (m["c"].isupper() or named)
        else:
            ok = lower["e"] in family and (m["f"].isupper() or named) and ("," in m[0])
        if ok:
            take(s, e, 4)
            at = e
        else:
            at = (_WORDS.match(text, s).end() if text[s : s + 1].strip() else s + 1) or s + 1
    return sorted(out)


def people(sf_dir: str, texts: list[str]) -> tuple[set[str], set[str]]:
    """(given names, surnames) in small letters: of the known people, and of those who are named only in texts."""
    import duckdb

    q = lambda s: duckdb.sql(s.replace("@", sf_dir + "/")).fetchall()
    given, family = set(), set()
    for (name,) in q("select canonical_name from '@entity_candidates.parquet' where entity_type = 'person'"):
        w = name.lower().split()
        if len(w) == 2:
            given.add(w[0])
            family.add(w[1])
    for (h,) in q("select attendee_hints from '@sources.parquet'"):
        for m in re.finditer(r'"name": "([^" ]+) ([^" ]+)"', h or ""):
            if m[1].lower() in given:
                family.add(m[2].lower())
    for table, column in (("mentions", "surface_form"), ("entities", "canonical_name")):
        for (name,) in q(f"select {column} from '@{table}.parquet' where entity_type = 'person'"):
            w = (name or "").lower().split()
            if len(w) == 2 and w[0] in given and w[1].isalpha():
                family.add(w[1])
    common: dict[str, int] = {}
    after: dict[str, int] = {}
    pair = re.compile(rf"\b([{_U}]\w+) ([{_U}][\w'’]+)")
    for t in texts:
        for w in re.findall(r"\b[a-zà-ÿ]{3,}\b", t):
            common[w] = common.get(w, 0) + 1
        for m in pair.finditer(t):
            if m[1].lower() in given:
                after[m[2].lower()] = after.get(m[2].lower(), 0) + 1
    family |= {w for w, n in after.items() if common.get(w, 0) <= n // 2 and w not in given and len(w) > 3}
    return given, family - {"the", "and"}


# --- generated spans ----------------------------------------------------------------------------------------------

# Parts of names and streets by language, from which spans are made.
GIVEN = {
    "en": "Alice Brian Carol Derek Edith Frank Grace Harold Irene Jack Kelly Liam Megan Nathan Olive Peter Rachel Simon Tara Walter Emily George Hannah Oscar".split(),
    "de": "Anke Bernd Dieter Elke Friedrich Gisela Heike Jürgen Karin Lothar Monika Norbert Petra Rüdiger Sabine Uwe Wolfgang Ludwig Käthe".split(),
    "fr": "Amélie Benoît Chloé Didier Élodie François Geneviève Hervé Inès Jacques Laurence Mathieu Noémie Odile Pascal Solène Thierry Yves".split(),
    "es": "Álvaro Beatriz Carlos Dolores Esteban Fernanda Gonzalo Inés Javier Lucía Marcos Nuria Óscar Pilar Ramón Sofía Tomás Ximena Lucia".split(),
    "it": "Alessia Bruno Chiara Davide Elena Fabio Giulia Lorenzo Marta Nicola Ornella Paolo Rosa Stefano Vera Massimo".split(),
    "nl": "Anna Bram Daan Eline Femke Gijs Hanneke Jeroen Lotte Maarten Pieter Roos Sanne Teun Wout".split(),
    "pl": "Agata Bartosz Cezary Dorota Ewa Grzegorz Halina Jakub Katarzyna Łukasz Małgorzata Paweł Stanisław Zofia".split(),
    "jp": "Akira Daiki Emi Hiroshi Izumi Kaito Mei Naoko Ren Sakura Taro Yui Yoko Kenji".split(),
    "in": "Aarav Deepa Farhan Gauri Harish Ishaan Kavya Lakshmi Mohan Neha Rajesh Sunita Tanvi Vijay Arjun".split(),
    "ar": "Ahmed Fatima Hassan Khalid Layla Mariam Omar Rania Samir Yasmin Zainab Tariq".split(),
    "cn": "Wei Li Fang Jing Min Xiu Hao Lei Yan Jun Na Qiang".split(),
    "af": "Amara Chidi Folake Ifeoma Jabari Kwame Ngozi Thandiwe Zuri Tunde".split(),
    "ru": "Анна Борис Виктор Галина Дмитрий Елена Иван Ксения Людмила Михаил Наталья Ольга Пётр Сергей Татьяна Юлия".split(),
    "gr": "Αλέξανδρος Βασιλική Γιώργος Δήμητρα Ελένη Κώστας Μαρία Νίκος Σοφία Χρήστος".split(),
}
FAMILY = {
    "en": "Ashcroft Bradley Carter Dalton Ellison Fletcher Gibson Harper Irving Jennings Knight Lawson Mitchell Norris O'Brien Parsons Quinn Reynolds Smith Turner Walsh Young McCarthy Smith-Jones".split(),
    "de": "Becker Fischer Hoffmann Krüger Lehmann Müller Neumann Richter Schäfer Schmidt Schulz Vogel Weiß Zimmermann Ahn".split(),
    "fr": "Bernard Chevalier Dubois Fournier Girard Lefèvre Marchand Moreau Perrin Rousseau Simon Vidal Lemaître".split(),
    "es": "Álvarez Castillo Díaz Fernández García Herrera Iglesias López Muñoz Ortega Peña Ramírez Suárez Vázquez Ibáñez".split(),
    "it": "Bianchi Colombo Esposito Ferrari Gallo Lombardi Moretti Ricci Romano Russo Santoro Vitale".split(),
    "nl": "Bakker Jansen Kuipers Mulder Smit Visser Vos Berg Dijk Vries Boer".split(),
    "pl": "Kowalski Nowak Wiśniewska Wójcik Kamiński Zielińska Szymański Dąbrowska Mazur".split(),
    "jp": "Fujita Hayashi Ito Kobayashi Nakamura Sato Suzuki Tanaka Watanabe Yamamoto Ono".split(),
    "in": "Agarwal Banerjee Chopra Desai Gupta Iyer Joshi Kapoor Menon Patel Reddy Sharma Verma".split(),
    "ar": "Haddad Khoury Mansour Nasser Rahman Saleh Aziz Farouk Hakim Darwish".split(),
    "cn": "Chen Huang Li Liu Ng Sun Wang Wu Xu Zhang Zhao".split(),
    "af": "Adeyemi Boateng Chukwu Dlamini Mensah Mwangi Nkosi Okafor Owusu".split(),
    "ru": "Иванов Петрова Смирнов Кузнецова Соколов Попова Волков Морозова Новиков Лебедева".split(),
    "gr": "Παπαδόπουλος Γεωργίου Νικολαΐδης Δημητρίου Οικονόμου Ιωάννου".split(),
}
PARTICLES = {"de": ["von", "von der", "zu"], "nl": ["van", "van der", "van den", "de"], "fr": ["de", "du", "de la"], "es": ["de", "de la", "del"], "it": ["di", "de", "della"], "ar": ["al", "el", "bin"]}
WHOLE = {"zh": ["王伟", "李芳", "张敏", "刘洋", "陈静"], "ja": ["田中太郎", "佐藤花子", "鈴木一郎"], "ko": ["김민수", "이서연", "박지훈"]}
CARRIERS = {
    "en": ["We met {} yesterday.", "Please ask {} about it.", "{} will send the draft.", "According to {}, the deal is done.", "The note came from {} last week.", "I spoke with {} about pricing", "cc {} on the thread.", "Thanks, {}!", "{}: let us start.", "Attendees: {}", "Reach me at {} after six.", "Contact: {}", "It was sent to {}.", "My details are {}, as before.", "She lives at {} now.", "Ship it to {} by Monday.", "- {}", "{}", "signed by {} and filed", "Dr. {} agreed with the plan.", "spoke to {} in the hall"],
    "de": ["Wir haben {} getroffen.", "Bitte {} fragen.", "{} schickt den Entwurf.", "Kontakt: {}"],
    "fr": ["Nous avons vu {} hier.", "Merci de demander à {}.", "{} enverra le projet.", "Contact : {}"],
    "es": ["Vimos a {} ayer.", "Pregunta a {} por favor.", "{} enviará el borrador.", "Contacto: {}"],
    "it": ["Abbiamo visto {} ieri.", "Chiedi a {}.", "{} manda la bozza."],
    "ru": ["Мы встретили {} вчера.", "Спросите {} об этом.", "{} пришлёт черновик.", "По словам {}, всё готово."],
    "gr": ["Είδαμε τον {} χθες.", "Ρωτήστε {} για αυτό."],
    "zh": ["昨天我们见到了{}。", "请问{}。"], "ja": ["{}さんに会いました。", "{}に聞いてください。"], "ko": ["{} 씨를 만났습니다."],
}
PLAIN = [
    "The total was $1,250,000 over 18 months.", "Order 4711-2210 shipped on 2024-03-12.", "Version 2.14.3 of the Project Falcon roadmap is due.", "See Annual Report page 14.", "New York and San Francisco are on the list.", "The meeting is at 14:30 on Monday.",
    "Invoice 20240117 covers Q3 and Q4.", "IBAN DE89 3704 0044 0532 0130 00 is on the invoice.", "The Board Meeting was moved.", "IP 192.168.0.14 answered in 20 ms.", "Room 204, Building C", "We raised 3.5 million in 2021.", "Series B closed in March.", "Good Morning Everyone", "The Blue River Fund led the round.",
    "Наш отдел закончил отчёт в срок.", "Die Sitzung wurde auf Montag verschoben.", "La Banque Centrale a publié le rapport.", "Ticket ABC-1234 is closed.", "ISBN 978-3-16-148410-0", "Tracking 1Z 999 AA1 01 2345 6784", "Lot 12/2024, batch 77", "The Great Wall project", "Thank You All", "United Kingdom sales grew", "Call me at noon", "alex was late", "Hi Maria, thanks for the notes.", "Robert: yes.",
]
STREETS = {
    "en": ("{n} {w} {k}", "Baker Church Elm Garden High King Lake Maple Mill Oak Park Queen River Spring Station Victoria Willow".split(), "Street Road Avenue Lane Drive Close Court St Ave Rd Boulevard Way Square Crescent".split()),
    "de": ("{w}{k} {n}", "Haupt Bahnhof Garten Schiller Goethe Linden Wald Berg Kirch Mozart".split(), "straße weg allee platz gasse ring str.".split()),
    "fr": ("{n}{b} {k} {w}", "Victor-Hugo Voltaire Pasteur Foch Molière Gambetta Jaurès République".split(), ["rue", "avenue", "boulevard", "place", "rue de la", "rue du", "allée des", "quai de"]),
    "es": ("{k} {w} {n}", "Mayor Real Alcalá Cervantes Goya Velázquez Colón Luna".split(), ["Calle", "Avenida", "Plaza", "Calle de", "Paseo de la", "Camino del"]),
    "it": ("{k} {w} {n}", "Garibaldi Roma Dante Mazzini Verdi Cavour Manzoni Torino".split(), ["Via", "Corso", "Piazza", "Viale", "Via della"]),
    "pl": ("{k} {w} {n}", "Marszałkowska Długa Polna Leśna Słoneczna".split(), ["ul.", "al."]),
    "nl": ("{w}{k} {n}", "Prinsen Keizers Dorps Kerk Molen Stations".split(), ["gracht", "straat", "weg", "laan"]),
    "pt": ("{k} {w} {n}", "Augusta Liberdade Flores Aurora".split(), ["Rua", "Rua da", "Avenida"]),
}
#: Kinds of generated spans that training never sees.
HELD_OUT = {"it street", "pt street", "jp name", "in name", "phone fr", "phone in", "id iban-less nino"}


def _digits(form: str, r: random.Random) -> str:
    return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "@" else c for c in form)


PHONES = {
    "us": ["(###) ###-####", "###-###-####", "+1 ### ### ####", "+1 (###) ###-#### x##", "1-###-###-####", "###.###.####", "+1-###-###-#### ext. ###"], "uk": ["+44 #### ######", "+44 (0)20 #### ####", "0#### ######", "07### ######", "020 #### ####"],
    "de": ["+49 ### #######", "0### #######", "0##/#######", "+49 (0)## ########", "(030) ######"], "fr": ["0# ## ## ## ##", "+33 # ## ## ## ##", "+33 (0)# ## ## ## ##"], "es": ["+34 ### ### ###", "9## ### ###"], "in": ["+91 ##### #####", "0##-########"], "au": ["+61 # #### ####", "(0#) #### ####", "04## ### ###"], "jp": ["+81 3-####-####", "03-####-####"],
}
IDS = {"ssn": ["###-##-####", "### ## ####"], "nino": ["@@ ## ## ## @", "@@######@"], "passport": ["@########", "@@#######", "@@-###-####-@"], "dni": ["########-@", "########@"], "tax": ["## ### ### ###", "##-#######"]}
SPELT = "zero one two three four five six seven eight nine oh".split()
HOSTS = "example.com mail.example.org acme.co.uk post.example.net firma.de uni-stadt.de correo.es corp.example.io".split()


def made(r: random.Random, held: bool) -> tuple[str, str, int, str]:
    """(kind, span, type number, language) of one generated span."""
    while True:
        t = r.choices(range(5), (15, 15, 12, 16, 42))[0]
        lang = "en"
        if t == 4:
            key = r.choice(list(GIVEN) + ["zh", "ja", "ko"])
            kind = f"{key} name"
            lang = key if key in CARRIERS and r.random() < 0.8 or key in WHOLE else "en"
            if key in WHOLE:
                span = r.choice(WHOLE[key])
            else:
                g, f = r.choice(GIVEN[key]), r.choice(FAMILY[key])
                if key in ("ru", "gr"):
                    span = r.choice([f"{g} {f}", f"{f} {g}", f"{g[0]}. {f}"])
                else:
                    if key in PARTICLES and r.random() < 0.4:
                        f = f"{r.choice(PARTICLES[key])} {f}"
                    x = r.random()
                    span = f"{g} {f}" if x < 0.55 else f"{f}, {g}" if x < 0.63 else f"{g[0]}. {f}" if x < 0.73 else f"{g[0]}.{f}" if x < 0.76 else f"{f}, {g[0]}." if x < 0.82 else f"{g} {r.choice('ABCDEFGHJKLMNPRST')}. {f}" if x < 0.87 else f"{g} {f}".lower() if x < 0.95 else f"{g} {f}".upper()
        elif t == 3:
            key = r.choice(list(STREETS))
            kind = f"{key} street"
            form, w, k = STREETS[key]
            span = form.format(n=f"{r.randint(1, 399)}{r.choice(['', '', '', '', 'a', 'b'])}", w=r.choice(w), k=r.choice(k), b=r.choice(["", "", ",", " bis"]))
            if key == "en" and r.random() < 0.3:
                span += r.choice([", Apt {}", ", Unit {}", ", Flat {}", ", Suite {}", " #{}"]).format(r.randint(1, 40))
            lang = key if key in CARRIERS and r.random() < 0.5 else "en"
        elif t == 1:
            key = r.choice([*PHONES, "spelt"])
            kind = f"phone {key}"
            if key == "spelt":
                w = [r.choice(SPELT) for _ in range(r.choice([7, 10, 10, 11]))]
                span = (r.choice([" ", ", "]) if len(w) < 10 else " ").join(w) if r.random() < 0.5 else f"{' '.join(w[:3])}, {' '.join(w[3:6])}, {' '.join(w[6:])}"
            else:
                span = _digits(r.choice(PHONES[key]), r)
        elif t == 2:
            key = r.choice(list(IDS))
            kind = f"id {key}"
            span = _digits(r.choice(IDS[key]), r)
        else:
            key = r.choice(["plain", "plain", "plain", "bracket", "spelt"])
            kind = f"email {key}"
            k = r.choice([k for k in GIVEN if k not in ("ru", "gr")])
            user = r.choice(["{g}.{f}", "{g}", "{g[0]}{f}", "{f}.{g[0]}", "{g}_{f}{n}", "{g}+{n}"]).format(g=r.choice(GIVEN[k]).lower(), f=r.choice(FAMILY[k]).lower().replace("'", ""), n=r.randint(1, 99))
            host = r.choice(HOSTS)
            span = f"{user}@{host}" if key == "plain" else f"{user} {r.choice(['(at)', '[at]'])} {host if r.random() < 0.5 else host.replace('.', ' [dot] ')}" if key == "bracket" else f"{user} at {host.replace('.', ' dot ')}"
        if (kind in HELD_OUT) == held:
            return kind, span, t, lang


def generated(r: random.Random, neutral: list[str], held: bool = False) -> tuple[str, list[tuple[int, int, int]], str]:
    """(line, spans, kind of its first span): spans put into a sentence, a list, or a line of the tables."""
    if not held and r.random() < 0.2:
        return "\n" + (r.choice(PLAIN) if r.random() < 0.6 else f"{r.choice(PLAIN)} {r.choice(neutral)}"), [], "plain"
    kind, span, t, lang = made(r, held)
    parts = [(span, t)]
    joins = [""]
    while r.random() < 0.3 and len(parts) < 4:
        _, other, u, _ = made(r, held)
        parts.append((other, u))
        joins.append(r.choice([" and ", ", ", " & ", "; ", " / ", " with ", " or ", " "]) if lang not in WHOLE else "、")
    carrier = r.choice(CARRIERS.get(lang, CARRIERS["en"]))
    if lang == "en" and r.random() < 0.35 and neutral:
        words = r.choice(neutral).split(" ")
        at = r.randint(0, len(words))
        carrier = " ".join([*words[:at], "{}", *words[at:]]).replace("{", "{", 1) if "{" not in "".join(words) else carrier
    before, after = carrier.split("{}", 1)
    text, spans = "\n" + before, []
    for join, (piece, u) in zip(joins, parts):
        text += join
        spans.append((len(text), len(text) + len(piece), u))
        text += piece
    return text + after, spans, kind


def _invent(text: str, spans: list[tuple[int, int, int]], r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The line with some letters and digits of its pieces exchanged, in the same form."""
    chars = list(text)
    for s, e, kind in spans:
        if kind in (1, 2):
            for i in range(s, e):
                if chars[i].isdigit() and r.random() < 0.35:
                    chars[i] = r.choice("0123456789")
        elif kind in (0, 4):
            for i in range(s + 1, e):
                if chars[i].isalpha() and chars[i].islower() and chars[i].isascii() and chars[i - 1].isalpha() and r.random() < 0.12:
                    chars[i] = r.choice("abcdefghijklmnoprstuvwz")
    return "".join(chars), spans


def examples(sf_dir: str, seed: int = 3):
    """(lines of the tables with spans, generated lines with spans, held-out forms with spans)."""
    import duckdb

    q = lambda s: [t for (t,) in duckdb.sql(s.replace("@", sf_dir + "/")).fetchall()]
    texts = q("select quote from '@claims.parquet' where quote is not null") + q("select body from '@sources.parquet' where body is not null")
    given, family = people(sf_dir, texts)
    r = random.Random(seed)
    r.shuffle(texts)
    seen: dict[str, int] = {}
    some, none = [], []
    for t in texts:
        for _, read in pii.lines(t):
            seen[read] = seen.get(read, 0) + 1
            if seen[read] > 1 or len(read) > pii.WINDOW:
                continue
            spans = label(read[1:], given, family)
            (some if spans else none).append((read, [(s + 1, e + 1, k) for s, e, k in spans]))
        if len(some) >= LIMIT // 2:
            break
    r.shuffle(none)
    often = [row for row in none if seen[row[0]] > 20][:400]  # region marks and the like: rare among distinct lines, not in texts
    none = none[: LIMIT // 4] + 12 * often
    rows = some[: LIMIT // 2] + none
    r.shuffle(rows)
    neutral = [t[1:] for t, _ in none if ":" not in t and "{" not in t]
    new = [generated(r, neutral) for _ in range(LIMIT // 4)]
    held = [generated(r, neutral, held=True) for _ in range(3000)]
    return rows, [(t, s) for t, s, _ in new if len(t) <= pii.WINDOW], held


def scores(found, gold) -> str:
    rows = []
    for k, name in enumerate(pii.TYPES):
        a, b = {x for x in found if x[-1] == k}, {x for x in gold if x[-1] == k}
        rows.append(f"{name} p {len(a & b) / max(1, len(a)):.4f} r {len(a & b) / max(1, len(b)):.4f} n {len(b)}")
    return "; ".join(rows)


def evaluate(model: Tagger, held) -> str:
    spans = pii._spans([row[0] for row in held], model)
    found = {(n, *pii.trimmed(row[0], s, e, k), k) for n, (row, own) in enumerate(zip(held, spans)) for s, e, k in own}
    return scores(found, {(n, s, e, k) for n, row in enumerate(held) for s, e, k in row[1]})


def main(sf_dir: str, out: str, epochs: int = 24, start: str | None = None, batch: int = 256, workers: int = 7) -> None:
    """Train from scratch, or go on from stored weights at a lower rate."""
    rows, new, forms = examples(sf_dir)
    held, train = rows[:HELD], rows[HELD:] + new[HELD // 4 :]
    held_new = new[: HELD // 4]
    print(len(train), "lines", scores(set(), {(n, *x) for n, (_, s) in enumerate(train) for x in s}), flush=True)
    r = random.Random(5)
    steps = epochs * (len(train) // batch)
    began = time.time()

    def batches():
        done = 0
        for _ in range(epochs):
            order = sorted(range(len(train)), key=lambda i: len(train[i][0]) + r.random() * 12)
            groups = [order[i : i + batch] for i in range(0, len(order) - batch + 1, batch)]
            r.shuffle(groups)
            for g in groups:
                part = [_invent(*train[i], r) if r.random() < 0.5 else train[i] for i in g]
                x, lengths = encode([t for t, _ in part])
                y = np.zeros(x.shape, dtype=np.int64)
                for i, (_, spans) in enumerate(part):
                    for s, e, k in spans:
                        y[i, s:e] = 2 * k + 2
                        y[i, s] = 2 * k + 1
                assert (x[:, 0] != PAD).all()
                yield x, lengths, y, done / steps
                done += 1

    model = Tagger.load(start) if start else Tagger(HIDDEN, pii.TAGS)
    mean = [0.0]

    def report(step: int, loss: float) -> None:
        mean[0] = loss if step == 1 else 0.98 * mean[0] + 0.02 * loss
        if step % 400 == 0:
            print(step, "of", steps, f"loss {mean[0]:.4f}, {time.time() - began:.0f} s;", evaluate(model, held[:1500]), flush=True)
            model.save(out)

    model.fit(batches(), rate=0.003 if start else 0.004, report=report, workers=workers)
    model.save(out)
    print("held-out lines:", evaluate(model, held), flush=True)
    print("generated, held out:", evaluate(model, held_new), flush=True)
    print("forms never seen:", evaluate(model, forms), flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:3], *map(int, sys.argv[3:4]), *sys.argv[4:5])
